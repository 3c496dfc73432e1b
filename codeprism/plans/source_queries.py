"""Queries over sources and sinks: files are made from the driver tables in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import compilation, facts, workload
from ..sources.staging import new_path
from ..views import ctes, view
from . import incremental

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def stream(spark, sf_dir):
    """Fact streams of all units: hello, and per unit begin, its symbols and edges, and complete; those of src3 failed, src5's has no end."""
    rows = view(spark, sf_dir, "symbol_variants")
    request = F.col("translation_unit_id").alias("request_id")
    symbol = rows.select(F.lit("fact").alias("type"), F.lit("symbol").alias("fact"), request, "id", "symbol_id", "qualified_name", "kind", "path", "start_line", "end_line", "signature", "is_definition", "translation_unit_id", "build_configuration_id", "build_variant")
    edge = rows.select(F.lit("fact").alias("type"), F.lit("edge").alias("fact"), request, F.concat(F.lit("e_"), "id").alias("id"), F.col("symbol_id").alias("source_id"), F.lit("sym_0").alias("target_id"), F.lit("references").alias("relation"), "translation_unit_id", "build_configuration_id", "build_variant")
    units = rows.select(request).distinct()
    begin = units.select(F.lit("begin").alias("type"), "request_id")
    end = units.where("request_id <> 'tu_src5'").select(F.lit("complete").alias("type"), "request_id", (F.col("request_id") != "tu_src3").alias("success"))
    hello = spark.createDataFrame([("hello", facts.PROTOCOL, facts.COMPILER, sorted(facts.CAPABILITIES))], "type string, protocol int, clang_major int, capabilities array<string>")
    path = new_path(spark, "stream")
    for i, part in enumerate((hello, begin, symbol, edge, end)):
        part.select(F.to_json(F.struct(*part.columns))).write.option("compression", "gzip" if i % 2 else "none").text(f"{path}/{i}")
    records = facts.read(spark, f"{path}/*")
    facts.check_handshake(records)
    return facts.admitted(records)


@register(
    "fact_stream",
    f"""WITH {ctes('symbol_variants')}, v AS (SELECT * FROM v_symbol_variants WHERE translation_unit_id NOT IN ('tu_src3', 'tu_src5'))
SELECT 'symbol' AS kind, id, symbol_id AS subject, qualified_name AS object, build_variant FROM v
UNION ALL SELECT 'edge', 'e_' || id, symbol_id, 'sym_0', build_variant FROM v""",
)
def fact_stream(spark, sf_dir):
    """Rows of streams that ended well, by kind."""
    admitted = stream(spark, sf_dir)
    symbols = facts.table(admitted, "symbol").select(F.lit("symbol").alias("kind"), "id", F.col("symbol_id").alias("subject"), F.col("qualified_name").alias("object"), "build_variant")
    return symbols.unionAll(facts.table(admitted, "edge").select(F.lit("edge"), "id", "source_id", "target_id", "build_variant"))


@register("fact_references", f"WITH {ctes('cfg_blocks', 'cfg_edges')} SELECT 'cfg_edge_v1' AS kind, 'target_block_id' AS \"column\", target_block_id AS value FROM v_cfg_edges WHERE target_block_id NOT IN (SELECT id FROM v_cfg_blocks WHERE role <> 'exceptional_exit') GROUP BY ALL UNION ALL SELECT 'cfg_edge_v1', 'source_block_id', source_block_id FROM v_cfg_edges WHERE source_block_id NOT IN (SELECT id FROM v_cfg_blocks WHERE role <> 'exceptional_exit') GROUP BY ALL")
def fact_references(spark, sf_dir):
    """References that lead nowhere, in a stream whose exceptional exits are missing."""
    graphs = view(spark, sf_dir, "cfg_graphs").select(F.lit("cfg_graph_v1").alias("fact"), "id", F.lit(None).cast("string").alias("graph_id"), F.lit(None).cast("string").alias("source_block_id"), F.lit(None).cast("string").alias("target_block_id"))
    blocks = view(spark, sf_dir, "cfg_blocks").where("role <> 'exceptional_exit'").select(F.lit("cfg_block_v1"), "id", "graph_id", F.lit(None), F.lit(None))
    edges = view(spark, sf_dir, "cfg_edges").select(F.lit("cfg_edge_v1"), "id", "graph_id", "source_block_id", "target_block_id")
    rows = graphs.unionAll(blocks).unionAll(edges).withColumn("type", F.lit("fact"))
    path = new_path(spark, "stream")
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(path)
    return facts.unresolved(facts.read(spark, path))


@register(
    "compilation_database",
    """SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS position, '/p' || CAST(p_partkey % 7 AS VARCHAR) || '/f ' || CAST(p_partkey AS VARCHAR) || '.cpp' AS source_path,
       CASE WHEN p_partkey % 2 = 0 THEN 'c++ -c -I inc ' ELSE 'c++ -DX=1 2 --output ' END || 'f ' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.cpp -o x.o' ELSE '.o -Irel/../inc -MTkept' END AS arguments,
       CASE WHEN p_partkey % 2 = 0 THEN '-I /p' || CAST(p_partkey % 7 AS VARCHAR) || '/inc' ELSE '-DX=1 2 -I/p' || CAST(p_partkey % 7 AS VARCHAR) || '/inc -MTkept' END AS clang_arguments
FROM part""",
)
def compilation_database(spark, sf_dir):
    """A database with one entry per part, with arguments as a list or as a shell command; repeated at its end."""
    k = F.col("p_partkey").cast("string")
    file = F.concat(F.lit("f "), k, F.lit(".cpp"))
    even = F.col("p_partkey") % 2 == 0
    listed = F.array(F.lit("c++"), F.lit("-c"), F.lit("-I"), F.lit("inc"), file, F.lit("-o"), F.lit("x.o"))
    command = F.concat(F.lit("c++ '-DX=1 2' --output \"f "), k, F.lit('.o" -Irel/../inc -MTkept'))
    entry = F.struct(F.concat(F.lit("/p"), (F.col("p_partkey") % 7).cast("string")).alias("directory"), file.alias("file"), F.when(even, listed).alias("arguments"), F.when(~even, command).alias("command"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.to_json(entry).alias("e"))
    ordered = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))), lambda x: x["e"]), ",").alias("x"))  # a database is one JSON value
    path = new_path(spark, "database")
    ordered.select(F.concat(F.lit("["), "x", F.lit(","), "x", F.lit("]"))).coalesce(1).write.text(path)
    rows = compilation.load(spark, path, "b")
    return rows.select("position", "source_path", F.array_join("arguments", " ").alias("arguments"), F.array_join("clang_arguments", " ").alias("clang_arguments"))


@register(
    "embedding_sink",
    f"WITH {ctes('embeddings')} SELECT variant_id, model, CAST(len(vector) AS INTEGER) AS dimensions, round(2 * sqrt(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x))), 6) AS magnitude, build_variant FROM v_embeddings WHERE build_variant = 'fr' UNION ALL SELECT variant_id, model, CAST(len(vector) AS INTEGER), round(sqrt(list_sum(list_transform(CAST(vector AS DOUBLE[]), lambda x: x * x))), 6), build_variant FROM v_embeddings WHERE build_variant <> 'fr'",
)
def embedding_sink(spark, sf_dir):
    """Vectors put into a store, the French ones twice, the second time doubled."""
    store = incremental.Store(spark, new_path(spark, "store"))
    rows = view(spark, sf_dir, "embeddings").select("variant_id", "model", F.col("vector").cast("array<double>").alias("vector"), "build_variant")
    store.put_embeddings(rows)
    store.put_embeddings(rows.where("build_variant = 'fr'").withColumn("vector", F.transform("vector", lambda x: x * 2)))
    return store.read("embeddings").select("variant_id", "model", "dimensions", F.round("magnitude", 6).alias("magnitude"), "build_variant")


@register("workload_calls", "SELECT 'build' || CAST(b AS VARCHAR) AS build_variant, 'unit' || CAST(u AS VARCHAR) AS caller_unit, 'unit' || CAST(CASE WHEN f = 39 THEN (u + 1) % 100 ELSE u END AS VARCHAR) AS callee_unit, count(*) AS calls FROM range(2) AS x(b), range(100) AS y(u), range(40) AS z(f) GROUP BY ALL")
def workload_calls(spark, sf_dir):
    """Calls between units of the standard workload: 100 units, 2 builds, 40 functions."""
    tables = workload.generate(spark, workload.Workload())
    unit = tables["symbol_variants"].select("symbol_id", "build_variant", "translation_unit_id")
    sites = tables["callsites"].select(F.col("id").alias("callsite_id"), F.col("translation_unit_id").alias("caller_unit"))
    called = tables["call_targets"].select("callsite_id", F.col("target_symbol_id").alias("symbol_id"), "build_variant").join(sites, "callsite_id")
    return called.join(unit, ["symbol_id", "build_variant"]).groupBy("build_variant", "caller_unit", F.col("translation_unit_id").alias("callee_unit")).agg(F.count("*").alias("calls"))
