"""Lexical search with BM25 over weighted columns, symbol search and vector search.

With an index (postings.Index) a search reads the postings of its terms, takes the best rows
and joins the few to their columns. Without one, bm25() works out the term counts of each row
with array functions, which reads and splits all texts twice: once for the statistics of the
whole table, once for the scores. Both give the same scores.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embedding import cosine, is_valid
from ..functions.text import let, phrases, tokens
from .lookups import scope_filter, standalone
from .page import bounded_page, checked_limit
from .postings import K1, LEAST_IDF, B, Index

LEXICAL = {"qualified_name": 8.0, "signature": 4.0, "documentation": 2.0, "source_text": 1.0}
SYMBOL = {"qualified_name": 12.0, "signature": 6.0}


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """How often the tokens of a phrase stand side by side."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    at = F.sequence(F.lit(0), F.greatest(F.size(toks) - len(phrase), F.lit(0)))
    hit = lambda i: functools.reduce(operator.and_, [F.get(toks, i + k).eqNullSafe(F.lit(p)) for k, p in enumerate(phrase)])
    return F.size(F.filter(at, hit))


def bm25(df: DataFrame, query: str, weights: dict[str, float], indexed: tuple[str, ...] = tuple(LEXICAL), per_column: bool = False) -> DataFrame | None:
    """df's matching rows with `score`; None for a query without terms.

    The length of a row is the token count of all indexed columns; statistics cover the whole
    of df. per_column counts a term in each weighted column as a term of its own, as with a
    column filter.
    """
    terms = phrases(query)
    if not terms:
        return None
    names = [c for c in indexed if c in df.columns]

    def counted_tokens(t: Column) -> Column:
        length = functools.reduce(operator.add, [F.size(t[c]) for c in names])
        if per_column:
            tf = [phrase_count(t[c], p) * w for p in terms for c, w in weights.items() if c in names]
        else:
            tf = [functools.reduce(operator.add, [phrase_count(t[c], p) * w for c, w in weights.items() if c in names]) for p in terms]
        return F.struct(length.alias("d"), F.array(*[x.cast("double") for x in tf]).alias("tf"))

    width = len(terms) * (len([c for c in weights if c in names]) if per_column else 1)
    once = let(F.struct(*[tokens(F.col(c)).alias(c) for c in names]), counted_tokens)
    counted = df.withColumn("_c", once).withColumn("_d", F.col("_c.d")).withColumn("_tf", F.col("_c.tf"))
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_d").alias("_avg"), F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(width)]).alias("_df")
    )
    joined = counted.where(F.exists("_tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        n, df_, x = F.col("_n"), F.col("_df")[i], F.col("_tf")[i]
        idf = F.log((n - df_ + 0.5) / (df_ + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        return idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))

    score = functools.reduce(operator.add, [part(i) for i in range(width)])
    return joined.withColumn("score", score).drop("_c", "_d", "_tf", "_n", "_avg", "_df")


def empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False)).withColumn("score", F.lit(0.0))


def best(rows: DataFrame, query: str, weights: dict[str, float], per_column: bool, scope: tuple[str, ...] | None, limit: int, index: Index | None) -> DataFrame:
    """The best rows with `score`, by score, then build and id. The scope drops rows after scoring."""
    order = [F.desc("score"), F.col("build_variant"), F.col("id")]
    if index is None:
        found = bm25(rows, query, weights, per_column=per_column)
        return scope_filter(empty(rows) if found is None else found, scope).orderBy(*order).limit(checked_limit(limit))
    found = index.scores(query, weights, per_column)
    if found is None:
        return empty(rows)
    top = scope_filter(found, scope).orderBy(*order).limit(checked_limit(limit)).select("id", "score")
    return rows.join(F.broadcast(top), "id").orderBy(*order)  # at most `limit` rows


def lexical_search(variants: DataFrame, query: str, scope: tuple[str, ...] | None = None, limit: int = 20, index: Index | None = None) -> DataFrame:
    """Best variants, by score, then build and id."""
    return best(variants, query, LEXICAL, False, scope, limit, index)


def symbol_search(variants: DataFrame, query: str, scope: tuple[str, ...] | None = None, limit: int = 20, index: Index | None = None) -> DataFrame:
    """As lexical_search over names and signatures; names equal to, or ending in ::, the query gain after the limit."""
    top = best(variants, query, SYMBOL, True, scope, limit, index)
    name, wanted = F.lower(F.trim("qualified_name")), query.strip().casefold()
    bonus = F.when(name == wanted, 2.0).when(F.endswith(name, F.lit("::" + wanted)), 1.0).otherwise(0.0)
    return top.withColumn("score", F.col("score") + bonus).orderBy(F.desc("score"), "qualified_name", "id")


def standalone_search(variants: DataFrame, symbols: DataFrame, query: str, limit: int = 20, found: int = 0, index: Index | None = None) -> DataFrame:
    """Canonical symbols without variants, scored over all canonical symbols, for what is left of a limit."""
    weights = {c: w for c, w in LEXICAL.items() if c in symbols.columns}
    if index is None:
        hits = bm25(symbols, query, weights)
    else:
        hits = index.scores(query, weights)
        hits = None if hits is None else hits.select("id", "score").join(symbols, "id")
    hits = empty(symbols) if hits is None else hits
    return standalone(variants, hits).orderBy(F.desc("score"), "id").limit(max(0, limit - found))


def hits_with_standalone(variants: DataFrame, symbols: DataFrame, query: str, limit: int = 20, index: Index | None = None, symbol_index: Index | None = None) -> DataFrame:
    """id, qualified_name, score, position: variant hits, then standalone symbols up to the limit in all. Without a scope only."""
    first = lexical_search(variants, query, None, limit, index).select(F.lit(0).alias("kind"), "id", "qualified_name", "build_variant", "score")
    rest = standalone_search(variants, symbols, query, limit, 0, symbol_index).select(F.lit(1).alias("kind"), "id", "qualified_name", F.lit("").alias("build_variant"), "score")
    order = Window.partitionBy().orderBy("kind", F.desc("score"), "build_variant", "id")  # at most twice the limit
    every = first.unionAll(rest).withColumn("position", F.row_number().over(order))
    return every.where(F.col("position") <= limit).select("id", "qualified_name", "score", "position")


def vector_search(embeddings: DataFrame, query: list[float], model: str, scope: tuple[str, ...] | None = None, limit: int = 20) -> DataFrame:
    """variant_id, build_variant, score by exact cosine; names are joined to the result, not to all vectors."""
    if not query or not all(abs(x) < float("inf") for x in query) or not any(query):
        raise ValueError("a query vector is finite and not zero")
    rows = scope_filter(embeddings, scope).where(F.col("model") == model)
    wrong = rows.where(F.size("vector") != len(query)).limit(1).count()
    if wrong:
        raise ValueError(f"vectors of {model} do not have {len(query)} dimensions")
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select("variant_id", "build_variant", score.alias("score")).orderBy(F.desc("score"), "build_variant", "variant_id").limit(checked_limit(limit))


def missing_embeddings(variants: DataFrame, embeddings: DataFrame, model: str, limit: int = 1000) -> DataFrame:
    """Variants without a vector of the model, as a page by id."""
    have = embeddings.where(F.col("model") == model).select(F.col("variant_id").alias("id"))
    return bounded_page(variants.join(have, "id", "left_anti").select("id", "build_variant"), [F.col("id")], limit)


def valid_embeddings(rows: DataFrame) -> DataFrame:
    return rows.where(is_valid(F.col("vector")))
