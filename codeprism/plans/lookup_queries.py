"""Queries over lookups, joins and small aggregates, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..operators import lookups, search
from ..operators.page import bounded_page
from ..views import ctes, view

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def order_sql(order: tuple[str, ...]) -> str:
    out = []
    for c in order:
        if c[0] == "!":
            out.append(f"CASE WHEN {c[1:]} = 'certain' THEN 0 ELSE 1 END")
        else:
            out.append(f"{c[1:]} DESC" if c[0] == "-" else f"{c} NULLS FIRST")
    return ", ".join(out)


#: The key that each page is asked for; None asks for the first page of the whole table.
KEYS = {
    "cfg_graphs": "fn_7",
    "cfg_blocks": "g_7",
    "cfg_elements": "g_7",
    "cfg_edges": "g_7",
    "callsites": "fn_7",
    "call_targets": "site_7_1",
    "data_flow_analyses": "g_7",
    "memory_locations": "a_7",
    "data_accesses": "a_7",
    "data_flow_evidence": "a_7",
    "function_summaries": "fn_7",
    "summary_effects": "sum_7",
    "summary_return_origins": "sum_7",
    "interprocedural_flows": "sum_7",
}
LIMIT = 25


def page_query(name: str, key: str | None):
    spec = lookups.LOOKUPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = view(spark, sf_dir, "cfg_blocks") if spec.blocks else None
        return lookups.page(name, view(spark, sf_dir, spec.table), key, limit=LIMIT, blocks=blocks)

    run.__doc__ = f"Page of the {spec.table} view, key {key}."
    joins = "".join(f" JOIN v_cfg_blocks AS j{i} ON j{i}.id = t.{c}" for i, (c, _) in enumerate(spec.blocks))
    extra = "".join(f", j{i}.block_index AS {a}" for i, (_, a) in enumerate(spec.blocks))
    hit = " OR ".join(f"t.{k} = '{key}'" for k in spec.keys) if key else "true"
    names = dict.fromkeys([spec.table, *(["cfg_blocks"] if spec.blocks else [])])
    sql = f"""WITH {ctes(*names)},
p AS (SELECT t.*{extra} FROM v_{spec.table} AS t{joins} WHERE {hit}),
n AS (SELECT *, row_number() OVER (ORDER BY {order_sql(spec.order)}) AS rn, count(*) OVER () AS every FROM p)
SELECT * EXCLUDE (rn, every), every > {LIMIT} AS truncated FROM n WHERE rn <= {LIMIT}"""
    return run, sql


for _name, _key in KEYS.items():
    QUERIES[f"page_{_name}"], ORACLE[f"page_{_name}"] = page_query(_name, _key)
    QUERIES[f"first_{_name}"], ORACLE[f"first_{_name}"] = page_query(_name, None)


def point_query(table: str, key: str, scope: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lookups.point(view(spark, sf_dir, table), key, scope)

    return run, f"WITH {ctes(table)} SELECT * FROM v_{table} WHERE id = '{key}' AND build_variant IN ({', '.join(repr(s) for s in scope)})"


for _name, _table, _key, _scope in (("get_cfg_graph", "cfg_graphs", "g_7", ("beta",)), ("get_callsite", "callsites", "site_7_1", ("F", "O"))):
    QUERIES[_name], ORACLE[_name] = point_query(_table, _key, _scope)

RANK = "row_number() OVER (PARTITION BY symbol_id ORDER BY is_definition DESC, build_variant, translation_unit_id, id)"


@register(
    "get_symbol",
    f"WITH {ctes('symbol_variants')} SELECT * FROM v_symbol_variants WHERE symbol_id = 'sym_7' AND build_variant IN ('en', 'de') ORDER BY is_definition DESC, build_variant, translation_unit_id, id LIMIT 1",
)
def get_symbol(spark, sf_dir):
    return lookups.get_symbol(view(spark, sf_dir, "symbol_variants"), "sym_7", ("en", "de"))


@register(
    "get_symbols",
    f"""WITH {ctes('symbol_variants')},
w AS (SELECT * FROM (VALUES (0, 'sym_9'), (1, 'var_3'), (2, 'missing'), (3, 'sym_9')) AS x(position, key)),
b AS (SELECT *, {RANK} AS rn FROM v_symbol_variants)
SELECT w.position, w.key, coalesce(e.id, s.id) AS id, coalesce(e.qualified_name, s.qualified_name) AS qualified_name, coalesce(e.build_variant, s.build_variant) AS build_variant
FROM w LEFT JOIN b AS e ON e.id = w.key LEFT JOIN b AS s ON s.symbol_id = w.key AND s.rn = 1""",
)
def get_symbols(spark, sf_dir):
    return lookups.get_symbols(view(spark, sf_dir, "symbol_variants"), ["sym_9", "var_3", "missing", "sym_9"])


@register(
    "all_symbols",
    f"""WITH {ctes('symbol_variants', 'symbols')}
SELECT symbol_id, id, qualified_name, build_variant FROM v_symbol_variants WHERE build_variant IN ('en', 'default')
UNION ALL SELECT id, id, qualified_name, 'default' FROM v_symbols AS s WHERE NOT EXISTS (SELECT 1 FROM v_symbol_variants AS v WHERE v.symbol_id = s.id)""",
)
def all_symbols(spark, sf_dir):
    return lookups.all_symbols(view(spark, sf_dir, "symbol_variants"), view(spark, sf_dir, "symbols"), ("en", "default"))


@register("occurrences", f"WITH {ctes('occurrences')} SELECT * FROM v_occurrences WHERE symbol_id = 'sym_3' AND build_variant IN ('alpha', 'beta')")
def occurrences(spark, sf_dir):
    rows = lookups.scope_filter(view(spark, sf_dir, "occurrences"), ("alpha", "beta"))
    return rows.where("symbol_id = 'sym_3'").orderBy("build_variant", "path", "start_line", "start_column")


@register("canonical_symbols", f"WITH {ctes('symbol_variants')}, r AS (SELECT *, {RANK} AS rn FROM v_symbol_variants) SELECT * EXCLUDE (rn) FROM r WHERE rn = 1")
def canonical_symbols(spark, sf_dir):
    return lookups.preferred(view(spark, sf_dir, "symbol_variants"))


@register("build_variants", f"WITH {ctes('symbol_variants')} SELECT build_variant, count(*) AS variants, count(DISTINCT translation_unit_id) AS units FROM v_symbol_variants GROUP BY build_variant")
def build_variants(spark, sf_dir):
    rows = view(spark, sf_dir, "symbol_variants").groupBy("build_variant")
    return rows.agg(F.count("*").alias("variants"), F.countDistinct("translation_unit_id").alias("units")).orderBy("build_variant")


@register(
    "translation_unit_states",
    f"""WITH {ctes('translation_units', 'build_configurations', 'dependencies')},
d AS (SELECT translation_unit_id AS id, count(DISTINCT path || '|' || content_hash) AS n, min(path || '|' || content_hash) AS first_dependency FROM v_dependencies GROUP BY 1)
SELECT u.id, u.build_configuration_id, u.content_hash, u.analysis_backend, u.advanced_facts_complete, u.build_variant, c.source_path, c.command_hash,
       coalesce(d.n, 0) AS dependencies, d.first_dependency
FROM v_translation_units AS u JOIN v_build_configurations AS c ON c.id = u.build_configuration_id LEFT JOIN d ON d.id = u.id""",
)
def translation_unit_states(spark, sf_dir):
    rows = lookups.translation_unit_states(*(view(spark, sf_dir, t) for t in ("translation_units", "build_configurations", "dependencies")))
    first = F.get("dependencies", F.lit(0))
    named = rows.withColumn("first_dependency", F.concat(first["path"], F.lit("|"), first["content_hash"]))
    return named.withColumn("dependencies", F.size("dependencies").cast("long"))


@register(
    "missing_embeddings",
    f"""WITH {ctes('symbol_variants', 'embeddings')},
p AS (SELECT id, build_variant FROM v_symbol_variants AS v WHERE NOT EXISTS (SELECT 1 FROM v_embeddings AS e WHERE e.variant_id = v.id AND e.model = 'local')),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS every FROM p)
SELECT id, build_variant, every > 50 AS truncated FROM n WHERE rn <= 50""",
)
def missing_embeddings(spark, sf_dir):
    return search.missing_embeddings(view(spark, sf_dir, "symbol_variants"), view(spark, sf_dir, "embeddings"), "local", 50)


@register("embedding_count", f"WITH {ctes('embeddings')} SELECT model, count(*) AS embeddings FROM v_embeddings GROUP BY model")
def embedding_count(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").groupBy("model").agg(F.count("*").alias("embeddings"))


FACTS = ("symbol_variants", "occurrences", "edges", "callsites", "call_targets", "cfg_graphs", "cfg_blocks", "cfg_elements", "cfg_edges", "data_accesses", "memory_locations", "function_summaries", "summary_effects", "embeddings")


@register("fact_counts", f"WITH {ctes(*FACTS)} " + " UNION ALL ".join(f"SELECT '{t}' AS fact, count(*) AS rows FROM v_{t}" for t in FACTS))
def fact_counts(spark, sf_dir):
    out = None
    for t in FACTS:
        one = view(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("fact"), "rows")
        out = one if out is None else out.unionAll(one)
    return out


@register("stable_ids", "SELECT o_orderkey, 'summary_' || substr(sha256('fn' || chr(0) || CAST(o_custkey AS VARCHAR) || chr(0) || o_orderpriority || chr(0)), 1, 32) AS id FROM orders")
def stable_ids(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", stable_id("summary", F.lit("fn"), F.col("o_custkey"), F.col("o_orderpriority")).alias("id"))


@register("ordered_distinct", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY l_partkey")
def ordered_distinct(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return lookups.ordered_distinct(rows, "l_partkey", "position")


@register(
    "latency_report",
    """SELECT event_type, count(*) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS worst,
       bool_and(value <= 1000) AS within_budget FROM events GROUP BY event_type""",
)
def latency_report(spark, sf_dir):
    """Nearest-rank percentiles, maxima and a budget per query kind."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type")
    return rows.agg(
        F.count("*").alias("samples"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
        F.max("value").alias("worst"),
        F.bool_and(F.col("value") <= 1000).alias("within_budget"),
    )


@register(
    "solution_hashes",
    "SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS VARCHAR) || chr(31) || l_returnflag, chr(30) ORDER BY CAST(l_partkey AS VARCHAR) || chr(31) || l_returnflag)) AS hash FROM lineitem GROUP BY l_orderkey",
)
def solution_hashes(spark, sf_dir):
    from ..functions.ids import folded_hash

    return folded_hash(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_partkey", "l_returnflag")


@register("index_totals", f"WITH {ctes('function_summaries')} SELECT build_variant, count(*) AS summaries, CAST(sum(CASE WHEN complete THEN 1 ELSE 0 END) AS BIGINT) AS complete FROM v_function_summaries GROUP BY ROLLUP (build_variant)")
def index_totals(spark, sf_dir):
    rows = view(spark, sf_dir, "function_summaries").rollup("build_variant")
    return rows.agg(F.count("*").alias("summaries"), F.count_if("complete").alias("complete"))


@register(
    "list_builds",
    f"""WITH {ctes('symbol_variants')}, b AS (SELECT DISTINCT build_variant AS name FROM v_symbol_variants),
n AS (SELECT name, row_number() OVER (ORDER BY name) AS rn, count(*) OVER () AS every FROM b) SELECT name, every > 3 AS truncated FROM n WHERE rn <= 3""",
)
def list_builds(spark, sf_dir):
    names = view(spark, sf_dir, "symbol_variants").select(F.col("build_variant").alias("name")).distinct()
    return bounded_page(names, [F.col("name")], 3)
