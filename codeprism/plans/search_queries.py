"""Queries over lexical, symbol and vector search, fusion and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.embedding import embedding_text, magnitude, with_embedding
from ..functions.text import feature_tokens, token_estimate, tokens
from ..operators import fusion, search
from ..operators.postings import Index
from ..views import ctes, view

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_indexes: dict = {}


def index_of(spark, sf_dir, name: str) -> Index:
    """The search index of a view, made on first use and kept for this application as long as its table stays the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    key = spark.sparkContext.applicationId, sf_dir, name
    stamp = files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()
    if _indexes.get(key, (None,))[0] != stamp:
        _indexes[key] = stamp, Index.create(view(spark, sf_dir, name), tuple(search.LEXICAL))
    return _indexes[key][1]


TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


def hits(column: str, term: tuple[str, ...]) -> str:
    """Times that the tokens of a term stand side by side in a token list."""
    if len(term) == 1:
        return f"len(list_filter({column}, lambda x: x = '{term[0]}'))"
    test = " AND ".join(f"{column}[i + {k}] = '{t}'" for k, t in enumerate(term))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: {test}))"


def bm25_sql(view_cte: str, source: str, columns: dict[str, float], terms: list[tuple[str, ...]], indexed: list[str], per_column: bool, keep: str) -> str:
    """CTEs up to `scored`, which has the kept columns, build_variant where there is one, and score."""
    toks = ", ".join(f"{TOKENS.format(c)} AS t_{c}" for c in indexed)
    length = " + ".join(f"len(t_{c})" for c in indexed)
    if per_column:
        tfs = [f"{w} * {hits('t_' + c, t)}" for t in terms for c, w in columns.items()]
    else:
        tfs = [" + ".join(f"{w} * {hits('t_' + c, t)}" for c, w in columns.items()) for t in terms]
    tf = ", ".join(f"CAST({x} AS DOUBLE) AS f{i}" for i, x in enumerate(tfs))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(tfs)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / a))" for i in range(len(tfs)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(tfs)))
    return f"""WITH {view_cte},
tk AS (SELECT {keep}, {toks} FROM {source}),
tf AS (SELECT {keep}, {length} AS d, {tf} FROM tk),
st AS (SELECT count(*) AS n, avg(d) AS a, {df} FROM tf),
scored AS (SELECT {keep}, {score} AS score FROM tf, st WHERE {some})"""


ALL = ["qualified_name", "signature", "documentation", "source_text"]
QUERY, TERMS = "pour keit with", [("pour",), ("keit",), ("with",)]
VARIANTS = ("id, qualified_name, build_variant", "v_symbol_variants")
LEXICAL_SQL = bm25_sql(ctes("symbol_variants"), VARIANTS[1], search.LEXICAL, TERMS, ALL, False, VARIANTS[0])


@register("bm25_top_k", LEXICAL_SQL + " SELECT id, build_variant, round(score, 6) AS score FROM scored WHERE build_variant IN ('en', 'de') ORDER BY scored.score DESC, build_variant, id LIMIT 20")
def bm25_top_k(spark, sf_dir):
    """Best variants in two builds; statistics cover all builds."""
    found = search.lexical_search(view(spark, sf_dir, "symbol_variants"), QUERY, ("en", "de"), 20, index_of(spark, sf_dir, "symbol_variants"))
    return found.select("id", "build_variant", F.round("score", 6).alias("score"))


@register(
    "bm25_phrase",
    bm25_sql(ctes("symbol_variants"), VARIANTS[1], search.LEXICAL, [("the", "of"), ("src1", "doc7")], ALL, False, VARIANTS[0])
    + " SELECT id, build_variant, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, build_variant, id LIMIT 20",
)
def bm25_phrase(spark, sf_dir):
    """Terms of several tokens are phrases."""
    found = search.lexical_search(view(spark, sf_dir, "symbol_variants"), "the_of src1::doc7", None, 20, index_of(spark, sf_dir, "symbol_variants"))
    return found.select("id", "build_variant", F.round("score", 6).alias("score"))


@register(
    "symbol_search",
    bm25_sql(ctes("symbol_variants"), VARIANTS[1], search.SYMBOL, [("src3", "doc23"), ("en",)], ALL, True, VARIANTS[0])
    + """, top AS (SELECT * FROM scored ORDER BY score DESC, build_variant, id LIMIT 20)
SELECT id, qualified_name, round(score + CASE WHEN lower(trim(qualified_name)) = 'src3::doc23 en' THEN 2.0 WHEN lower(trim(qualified_name)) LIKE '%::src3::doc23 en' THEN 1.0 ELSE 0.0 END, 6) AS score FROM top""",
)
def symbol_search(spark, sf_dir):
    found = search.symbol_search(view(spark, sf_dir, "symbol_variants"), "src3::doc23 en", None, 20, index_of(spark, sf_dir, "symbol_variants"))
    return found.select("id", "qualified_name", F.round("score", 6).alias("score"))


@register(
    "standalone_search",
    bm25_sql(ctes("symbols", "symbol_variants"), "v_symbols", {"qualified_name": 8.0, "signature": 4.0}, [("pour",), ("canon", "doc407")], ["qualified_name", "signature"], False, "id, qualified_name")
    + " SELECT id, round(score, 6) AS score FROM scored AS s WHERE NOT EXISTS (SELECT 1 FROM v_symbol_variants AS v WHERE v.symbol_id = s.id) ORDER BY s.score DESC, id LIMIT 15",
)
def standalone_search(spark, sf_dir):
    found = search.standalone_search(view(spark, sf_dir, "symbol_variants"), view(spark, sf_dir, "symbols"), "pour canon::doc407", 20, 5, index_of(spark, sf_dir, "symbols"))
    return found.select("id", F.round("score", 6).alias("score"))


SYMBOL_COLUMNS = {"qualified_name": 8.0, "signature": 4.0}


def both_hits(first: str, second: str) -> str:
    """SQL of variant hits, then canonical symbols without variants, 20 in all."""
    inner = bm25_sql(ctes("symbols", "symbol_variants"), "v_symbols", SYMBOL_COLUMNS, [(first,), (second,)], list(SYMBOL_COLUMNS), False, "id, qualified_name")
    outer = bm25_sql(ctes("symbol_variants"), VARIANTS[1], search.LEXICAL, [(first,), (second,)], ALL, False, VARIANTS[0])
    return f"""SELECT id, qualified_name, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY kind, x.score DESC, build_variant, id) AS INTEGER) AS position FROM (
SELECT * FROM (SELECT 0 AS kind, id, qualified_name, build_variant, score FROM ({outer} SELECT * FROM scored) ORDER BY score DESC, build_variant, id LIMIT 20)
UNION ALL SELECT 1, id, qualified_name, '', score FROM ({inner} SELECT * FROM scored AS s WHERE NOT EXISTS (SELECT 1 FROM v_symbol_variants AS v WHERE v.symbol_id = s.id))
) AS x QUALIFY position <= 20"""


@register("hits_with_standalone", both_hits("doc12", "doc417"))
def hits_with_standalone(spark, sf_dir):
    """Few variants match, so canonical symbols without variants fill the page."""
    found = search.hits_with_standalone(view(spark, sf_dir, "symbol_variants"), view(spark, sf_dir, "symbols"), "doc12 doc417", 20, index_of(spark, sf_dir, "symbol_variants"), index_of(spark, sf_dir, "symbols"))
    return found.select("id", "qualified_name", F.round("score", 6).alias("score"), "position")


INDEXED = " UNION ALL ".join(f"SELECT id, unnest({TOKENS.format(c)}) AS term FROM {{rows}}" for c in ALL)


@register("index_terms", f"WITH {ctes('symbol_variants')} SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM ({INDEXED.replace('{rows}', 'v_symbol_variants')}) AS x GROUP BY term")
def index_terms(spark, sf_dir):
    """All terms of the index with their documents and occurrences."""
    return counts_of(index_of(spark, sf_dir, "symbol_variants"))


def counts_of(index: Index):
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.postings().groupBy("term").agg(F.count("*").alias("documents"), F.sum(total).alias("occurrences"))


@register(
    "index_terms_after_changes",
    f"""WITH {ctes('symbol_variants')},
v AS (SELECT id, qualified_name, signature, documentation, CASE WHEN build_variant = 'fr' THEN 'une autre source' ELSE source_text END AS source_text FROM v_symbol_variants WHERE build_variant <> 'es')
SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM ({INDEXED.replace('{rows}', 'v')}) AS x GROUP BY term""",
)
def index_terms_after_changes(spark, sf_dir):
    """An index of its own, whose French rows are replaced and Spanish ones removed, and which is then compacted."""
    rows = view(spark, sf_dir, "symbol_variants")
    index = Index.create(rows, tuple(search.LEXICAL))
    index.apply(rows.where("build_variant = 'fr'").withColumn("source_text", F.lit("une autre source")), rows.where("build_variant = 'es'").select("id"))
    index.compact()
    return counts_of(index)


AXES = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
AXES_SQL = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in AXES) + "]"


@register(
    "vector_top_k",
    f"""WITH {ctes('embeddings')}, s AS (SELECT variant_id, build_variant, list_cosine_similarity(CAST(vector AS DOUBLE[]), {AXES_SQL}) AS score FROM v_embeddings WHERE model = 'local' AND build_variant IN ('en', 'de'))
SELECT variant_id, build_variant, round(score, 6) AS score FROM s ORDER BY s.score DESC, build_variant, variant_id LIMIT 20""",
)
def vector_top_k(spark, sf_dir):
    found = search.vector_search(view(spark, sf_dir, "embeddings"), AXES, "local", ("en", "de"), 20)
    return found.select("variant_id", "build_variant", F.round("score", 6).alias("score"))


@register(
    "valid_embeddings",
    f"WITH {ctes('embeddings')} SELECT variant_id, round(sqrt(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x))), 6) AS magnitude, len(vector) AS dimensions FROM v_embeddings WHERE len(vector) > 0",
)
def valid_embeddings(spark, sf_dir):
    rows = search.valid_embeddings(view(spark, sf_dir, "embeddings"))
    return rows.select("variant_id", F.round(magnitude(F.col("vector")), 6).alias("magnitude"), F.size("vector").cast("long").alias("dimensions"))


@register(
    "embedding_text",
    f"WITH {ctes('symbol_variants')} SELECT id, length(t) AS n, sha256(t) AS digest FROM (SELECT id, substr(concat_ws(chr(10), nullif(qualified_name, ''), nullif(signature, ''), nullif(documentation, ''), nullif(source_text, '')), 1, 32000) AS t FROM v_symbol_variants) AS x",
)
def embedding_texts(spark, sf_dir):
    rows = view(spark, sf_dir, "symbol_variants")
    text = rows.select("id", embedding_text(*[F.col(c) for c in ALL]).alias("t"))
    return text.select("id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


@register(
    "feature_tokens",
    """WITH w AS (SELECT c_custkey, regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[A-Za-z_][A-Za-z0-9_]*|\\d+') AS ws FROM customer),
t AS (SELECT c_custkey, unnest(ws) AS w FROM w),
g AS (SELECT c_custkey, w AS token FROM t UNION ALL SELECT c_custkey, substr(w, i, 3) FROM t, unnest(range(1, length(w) - 1)) AS u(i) WHERE length(w) >= 3)
SELECT c_custkey, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, min(token) AS first_token FROM g GROUP BY c_custkey""",
)
def feature_token_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(feature_tokens(F.concat_ws(" ", "c_name", "c_mktsegment"))).alias("token"))
    return rows.groupBy("c_custkey").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.min("token").alias("first_token"))


@register("feature_hash_embedding")
def feature_hash_embedding(spark, sf_dir):
    """Local embeddings of the variants' names; BLAKE2b has no SQL equivalent, so a test holds them against hashlib."""
    rows = with_embedding(view(spark, sf_dir, "symbol_variants").select("id", "qualified_name"), F.col("qualified_name"), dimensions=64)
    return rows.select("id", F.round(magnitude(F.col("vector")), 6).alias("magnitude"), F.size("vector").alias("dimensions"))


@register("text_tokens", f"SELECT lang, count(*) AS documents, CAST(sum(len({TOKENS.format('text')})) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def text_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))


VECTOR_RANKS = f"SELECT 'vector' AS backend, variant_id AS key, row_number() OVER (ORDER BY list_cosine_similarity(CAST(vector AS DOUBLE[]), {AXES_SQL}) DESC, build_variant, variant_id) AS rank FROM v_embeddings"
LEXICAL_RANKS = "SELECT 'lexical' AS backend, id AS key, row_number() OVER (ORDER BY score DESC, build_variant, id) AS rank FROM scored"
SYMBOL_RANKS = "SELECT 'symbol' AS backend, id AS key, row_number() OVER (ORDER BY qualified_name, id) AS rank FROM v_symbol_variants WHERE kind = 'function'"
FUSED_SQL = LEXICAL_SQL.replace(f"WITH {ctes('symbol_variants')}", f"WITH {ctes('symbol_variants', 'embeddings')}") + f""",
r AS (SELECT * FROM ({LEXICAL_RANKS}) WHERE rank <= 40 UNION ALL SELECT * FROM ({SYMBOL_RANKS}) WHERE rank <= 40 UNION ALL SELECT * FROM ({VECTOR_RANKS}) WHERE rank <= 40),
f AS (SELECT key, sum(CASE backend WHEN 'lexical' THEN 1.0 WHEN 'symbol' THEN 1.15 ELSE 0.9 END / (60 + rank)) AS score,
             min(CASE backend WHEN 'lexical' THEN 0 WHEN 'symbol' THEN 1 ELSE 2 END * 1000 + rank) AS place FROM r GROUP BY key)"""


def ranked(spark, sf_dir):
    """The first 40 of three backends as (backend, rank, key)."""
    variants, embeddings = view(spark, sf_dir, "symbol_variants"), view(spark, sf_dir, "embeddings")
    lexical = search.lexical_search(variants, QUERY, None, 40, index_of(spark, sf_dir, "symbol_variants")).select(F.lit("lexical").alias("backend"), F.col("id").alias("key"), "score", "build_variant")
    vector = search.vector_search(embeddings, AXES, "local", None, 40).select(F.lit("vector").alias("backend"), F.col("variant_id").alias("key"), "score", "build_variant")
    order = Window.partitionBy("backend").orderBy(F.desc("score"), "build_variant", "key")
    found = lexical.unionAll(vector).withColumn("rank", F.row_number().over(order)).select("backend", "rank", "key")
    names = variants.where("kind = 'function'").orderBy("qualified_name", "id").limit(40)
    symbol = names.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("qualified_name", "id")))
    return found.unionAll(symbol.select(F.lit("symbol").alias("backend"), "rank", F.col("id").alias("key")))


@register("rank_fusion", FUSED_SQL + " SELECT key, round(score, 9) AS score, CAST(floor(place / 1000) AS INTEGER) AS first_backend, CAST(place % 1000 AS INTEGER) AS first_rank FROM f")
def rank_fusion(spark, sf_dir):
    out = fusion.fuse(ranked(spark, sf_dir))
    return out.select("key", F.round("score", 9).alias("score"), "first_backend", "first_rank")


@register(
    "rerank",
    FUSED_SQL
    + """, c AS (SELECT f.key, f.score, v.qualified_name, list_distinct(regexp_extract_all(lower(qualified_name || ' ' || signature || ' ' || documentation), '[A-Za-z_][A-Za-z0-9_]*')) AS own, CAST(v.start_line AS INTEGER) AS degree
      FROM f JOIN v_symbol_variants AS v ON v.id = f.key)
SELECT key, round(score * (1 + 0.35 * len(list_intersect(own, ['pour', 'keit', 'with'])) / 3.0 + 0.2 * CASE WHEN contains('pour keit with', lower(qualified_name)) THEN 1 ELSE 0 END)
             / CASE WHEN degree > 12 THEN sqrt(degree / 12.0) ELSE 1 END, 9) AS reranked FROM c""",
)
def rerank(spark, sf_dir):
    """Fused candidates with names; the start line stands in for a degree."""
    names = view(spark, sf_dir, "symbol_variants").select(F.col("id").alias("key"), "qualified_name", "signature", "documentation", F.col("start_line").alias("degree"))
    out = fusion.rerank(fusion.fuse(ranked(spark, sf_dir)).join(names, "key"), QUERY)
    return out.select("key", F.round("reranked", 9).alias("reranked"))


@register(
    "context_packing",
    FUSED_SQL
    + """, i AS (SELECT f.key, f.score, length(v.source_text) AS n FROM f JOIN v_symbol_variants AS v ON v.id = f.key),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)
SELECT key, CAST(least(n, 8000 - before) AS BIGINT) AS kept_chars, least(n, 8000 - before) < n AS cut, CAST(ceil(least(n, 8000 - before) / 4.0) AS BIGINT) AS tokens FROM u WHERE before < 8000""",
)
def context_packing(spark, sf_dir):
    """Sources of the fused candidates in order, up to 8000 characters."""
    sources = view(spark, sf_dir, "symbol_variants").select(F.col("id").alias("key"), F.length("source_text").cast("long").alias("n"), "source_text")
    items = fusion.fuse(ranked(spark, sf_dir)).join(sources, "key")
    out = fusion.pack(items, [F.desc("score"), F.col("key")], "n", 8000)
    kept = F.col("kept_chars").cast("long")
    return out.select("key", kept.alias("kept_chars"), "cut", token_estimate(F.substring("source_text", F.lit(1), kept.cast("int"))).alias("tokens"))
