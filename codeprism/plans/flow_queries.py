"""Queries over data flow, summaries and the composed control- and data-flow services."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, graph, solver
from ..views import ctes, view
from . import services

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


DEFINES = "kind IN (" + ", ".join(f"'{k}'" for k in flow.DEFINITIONS) + ")"


@register(
    "last_definition",
    f"WITH {ctes('data_accesses')} SELECT id, last_value(CASE WHEN {DEFINES} THEN id END IGNORE NULLS) OVER (PARTITION BY graph_id, block_id, location_id ORDER BY sequence, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition_id FROM v_data_accesses",
)
def last_definition(spark, sf_dir):
    return flow.last_definition(view(spark, sf_dir, "data_accesses")).select("id", "definition_id")


@register("block_definitions", f"WITH {ctes('data_accesses')} SELECT graph_id, block_id, location_id, max_by(id, sequence) AS definition_id FROM v_data_accesses WHERE {DEFINES} GROUP BY 1, 2, 3")
def block_definitions(spark, sf_dir):
    return flow.block_definitions(view(spark, sf_dir, "data_accesses"))


#: Definitions travel over feasible edges as long as the block on the way does not define their location.
REACHING = f"""WITH RECURSIVE {ctes('data_accesses', 'cfg_edges')},
a AS (SELECT *, {DEFINES} AS defines FROM v_data_accesses),
g AS (SELECT graph_id, block_id, location_id, max_by(id, sequence) AS id FROM a WHERE defines GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT graph_id, source_block_id AS s, target_block_id AS t FROM v_cfg_edges WHERE feasible),
i AS (SELECT g.graph_id, e.t AS block_id, g.location_id, g.id FROM g JOIN e ON e.graph_id = g.graph_id AND e.s = g.block_id
      UNION SELECT i.graph_id, e.t, i.location_id, i.id FROM i JOIN e ON e.graph_id = i.graph_id AND e.s = i.block_id
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.graph_id = i.graph_id AND g.block_id = i.block_id AND g.location_id = i.location_id)),
l AS (SELECT *, last_value(CASE WHEN defines THEN id END IGNORE NULLS) OVER (PARTITION BY graph_id, block_id, location_id ORDER BY sequence, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS local FROM a)
SELECT l.graph_id, CASE WHEN l.defines THEN 'overwrites' ELSE 'reaching_definition' END AS relation, coalesce(l.local, i.id) AS source_access_id, l.id AS target_access_id
FROM l LEFT JOIN i ON l.local IS NULL AND i.graph_id = l.graph_id AND i.block_id = l.block_id AND i.location_id = l.location_id WHERE coalesce(l.local, i.id) IS NOT NULL"""


@register("reaching_definitions", REACHING)
def reaching_definitions(spark, sf_dir):
    found = flow.reaching_definitions(*(view(spark, sf_dir, t) for t in ("cfg_blocks", "cfg_edges", "data_accesses")))
    return found.select("graph_id", "relation", "source_access_id", "target_access_id")


@register("flow_rounds")
def flow_rounds(spark, sf_dir):
    """Rounds and certainty of each graph's solution; the order of updates has no SQL form."""
    found = flow.reaching_definitions(*(view(spark, sf_dir, t) for t in ("cfg_blocks", "cfg_edges", "data_accesses")))
    return found.groupBy("graph_id").agg(F.max("iteration_count").alias("rounds"), F.bool_and("converged").alias("converged"), F.count_if(F.col("certainty") == "certain").alias("certain"))


@register(
    "local_effects",
    f"WITH {ctes('data_accesses', 'memory_locations')} SELECT a.graph_id, a.id AS source_access_id, CASE WHEN a.{DEFINES} THEN 'write' ELSE 'read' END AS kind, l.kind AS location_kind, a.location_id FROM v_data_accesses AS a JOIN v_memory_locations AS l ON l.id = a.location_id WHERE l.kind IN ('parameter', 'global', 'field', 'dereference') AND a.kind <> 'parameter_definition'",
)
def local_effects(spark, sf_dir):
    return flow.local_effects(view(spark, sf_dir, "data_accesses"), view(spark, sf_dir, "memory_locations"))


FLAGS = {"has_target": "l_partkey % 5 <> 0", "dependent": "l_suppkey % 2 = 0", "constructor": "l_linenumber = 7", "method": "l_partkey % 3 <> 0", "lambda": "l_partkey % 11 = 0", "functor": "l_partkey % 13 = 0", "virtual": "l_suppkey % 3 <> 0", "qualified": "l_partkey % 17 = 0", "final": "l_suppkey % 5 = 0"}


@register(
    "dispatch_classification",
    "WITH f AS (SELECT *, "
    + ", ".join(f"{e} AS f_{n}" for n, e in FLAGS.items())
    + """ FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN NOT f_has_target AND f_dependent THEN 'dependent_template' WHEN NOT f_has_target THEN 'unresolved_indirect' WHEN f_constructor THEN 'constructor'
WHEN NOT f_method THEN 'direct' WHEN f_lambda THEN 'lambda' WHEN f_functor THEN 'functor' WHEN NOT f_virtual OR f_qualified THEN 'direct' WHEN f_final THEN 'devirtualized' ELSE 'virtual' END AS dispatch_kind FROM f""",
)
def dispatch_classification(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("f", F.struct(*[F.expr(e).alias(n) for n, e in FLAGS.items()]))
    return rows.select("l_orderkey", "l_linenumber", flow.dispatch_kind(F.col("f")).alias("dispatch_kind"))


EDGE_FLAGS = {"exception": "event_type = 'error'", "default": "event_id % 7 = 0", "case": "event_id % 6 = 0", "break": "event_id % 5 = 0", "continue": "event_id % 11 = 0", "goto": "event_id % 13 = 0", "return": "event_type = 'purchase'", "loop_back": "user_id % 4 = 0", "true": "event_id % 2 = 0", "false": "event_id % 3 = 0"}


@register("edge_classification", "SELECT event_id, CASE " + " ".join(f"WHEN {e} THEN '{n}'" for n, e in EDGE_FLAGS.items()) + " ELSE 'fallthrough' END AS kind FROM events")
def edge_classification(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("f", F.struct(*[F.expr(e).alias(n) for n, e in EDGE_FLAGS.items()]))
    return rows.select("event_id", flow.edge_kind(F.col("f")).alias("kind"))


@register(
    "external_targets",
    f"""WITH {ctes('callsites')}, k AS (SELECT 'm' || CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size > 10)
SELECT s.id, s.target_set_complete AND k.id IS NOT NULL AS target_set_complete, CASE WHEN k.id IS NULL THEN 'resolved_target_external_or_unindexed' ELSE s.unresolved_reason END AS unresolved_reason, k.id AS static_target_symbol_id
FROM v_callsites AS s LEFT JOIN k ON k.id = s.static_target_symbol_id""",
)
def external_targets(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 10").select(F.concat(F.lit("m"), F.col("p_partkey")).alias("id"))
    return flow.downgrade_external(view(spark, sf_dir, "callsites"), known).select("id", "target_set_complete", "unresolved_reason", "static_target_symbol_id")


@register(
    "resolution_overlay",
    f"""WITH {ctes('callsites', 'call_targets')}, r AS (SELECT callsite_id, confidence > 0.95 AS c, derivation AS d FROM v_call_targets WHERE certainty = 'possible')
SELECT s.id, coalesce(r.c, s.target_set_complete) AS target_set_complete, coalesce(r.d, s.unresolved_reason) AS unresolved_reason FROM v_callsites AS s LEFT JOIN r ON r.callsite_id = s.id""",
)
def resolution_overlay(spark, sf_dir):
    r = view(spark, sf_dir, "call_targets").where("certainty = 'possible'").select("callsite_id", (F.col("confidence") > 0.95).alias("target_set_complete"), F.col("derivation").alias("unresolved_reason"))
    return flow.overlay_resolutions(view(spark, sf_dir, "callsites"), r).select("id", "target_set_complete", "unresolved_reason")


POINTS = "SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts, bool_and(l_returnflag <> 'R') AS complete, bool_or(l_tax > 0.07) AS has_null FROM lineitem GROUP BY l_orderkey"


@register(
    "alias_evidence",
    f"WITH p AS ({POINTS}) SELECT l_orderkey AS location_id, unnest(parts) AS target_id, CASE WHEN complete AND NOT has_null AND len(parts) = 1 THEN 'must_alias' ELSE 'may_alias' END AS relation, CASE WHEN complete AND NOT has_null AND len(parts) = 1 THEN 'certain' ELSE 'possible' END AS certainty FROM p",
)
def alias_evidence(spark, sf_dir):
    return flow.alias_evidence(points_to(spark, sf_dir).select(F.col("l_orderkey").alias("location_id"), F.col("parts").alias("locations"), F.array().cast("array<bigint>").alias("functions"), "complete", "has_null"))


@register(
    "indirect_calls",
    f"WITH p AS ({POINTS}) SELECT l_orderkey AS callsite_id, unnest(parts) AS target_symbol_id, CASE WHEN complete AND NOT has_null AND len(parts) = 1 THEN 'certain' ELSE 'possible' END AS certainty, CAST(CASE WHEN complete AND NOT has_null AND len(parts) = 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, complete AS target_set_complete FROM p",
)
def indirect_calls(spark, sf_dir):
    return flow.resolve_indirect(points_to(spark, sf_dir).select(F.col("l_orderkey").alias("callsite_id"), F.col("parts").alias("functions"), "complete", "has_null"))


def points_to(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
    return rows.agg(F.collect_set("l_partkey").alias("parts"), F.bool_and(F.col("l_returnflag") != "R").alias("complete"), F.bool_or(F.col("l_tax") > 0.07).alias("has_null"))


def solver_tables(spark, sf_dir):
    """A call graph over all customers: each function calls two others and writes through its parameter."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = max(1, customers.count())
    f = customers.select("c_custkey", (F.col("c_custkey") % 7 == 3).alias("odd"))
    name = lambda c: F.concat(F.lit("f"), c)
    prov = [F.lit("tu").alias("translation_unit_id"), F.lit("cfg").alias("build_configuration_id"), F.lit("alpha").alias("build_variant")]
    k = F.col("c_custkey")
    summaries = f.select(
        F.concat(F.lit("s"), k).alias("id"), name(k).alias("function_symbol_id"), F.array(F.lit("reference")).alias("parameter_modes"), F.array(F.concat(F.lit("p"), k)).alias("parameter_location_ids"),
        F.when(F.col("odd"), F.array(F.lit("volatile_access"))).otherwise(F.array().cast("array<string>")).alias("local_incomplete_reasons"), *prov,
    )
    calls = f.select("c_custkey", F.explode(F.array((k * 3 + 1) % n, (k * 5 + 2) % n)).alias("to")).where("c_custkey % 4 <> 0")
    site = F.concat_ws("_", F.lit("c"), "c_custkey", "to")
    sites = calls.select(site.alias("id"), name(k).alias("owner_symbol_id"), F.lit(True).alias("target_set_complete"), *prov).distinct()
    targets = calls.select(F.concat(F.lit("t"), site).alias("id"), site.alias("callsite_id"), name(F.col("to")).alias("target_symbol_id"), F.lit("certain").alias("certainty")).distinct()
    empty = F.array().cast("array<string>")
    effects = f.where("c_custkey % 3 = 0").select(
        F.concat(F.lit("e"), k).alias("id"), F.concat(F.lit("s"), k).alias("summary_id"), F.lit("write").alias("kind"), F.lit("parameter").alias("location_kind"), F.lit("certain").alias("certainty"),
        F.lit(0).alias("parameter_index"), empty.alias("access_path"), F.concat(F.lit("p"), k).alias("location_id"), F.concat(F.lit("a"), k).alias("source_access_id"),
    )
    origins = f.where("c_custkey % 5 = 0").select(
        F.concat(F.lit("o"), k).alias("id"), F.concat(F.lit("s"), k).alias("summary_id"), F.lit("location").alias("kind"), F.lit("parameter").alias("location_kind"), F.lit("certain").alias("certainty"),
        F.lit(0).alias("parameter_index"), empty.alias("access_path"), F.concat(F.lit("p"), k).alias("location_id"), F.lit(None).cast("string").alias("callsite_id"),
    )
    bindings = calls.select(
        F.concat(F.lit("s"), k).alias("caller_summary_id"), site.alias("callsite_id"), F.lit(0).alias("argument_index"), F.concat(F.lit("p"), k).alias("location_id"), F.lit("parameter").alias("location_kind"),
        F.lit(0).alias("parameter_index"), empty.alias("access_path"), F.lit(True).alias("writeback_candidate"), F.lit(True).alias("complete"),
    ).distinct()
    results = calls.where("to % 2 = 0").select(F.concat(F.lit("s"), k).alias("caller_summary_id"), site.alias("callsite_id"), F.concat(F.lit("r"), k).alias("location_id"), F.concat(F.lit("d"), site).alias("definition_access_id")).distinct()
    return {"summaries": summaries, "sites": sites, "targets": targets, "effects": effects, "origins": origins, "bindings": bindings, "results": results}


#: In this graph a function has a write effect through its parameter for each access that it, or
#: anything it calls, makes; and it is incomplete if anything it calls is.
CALLS = "c AS (SELECT DISTINCT a, b FROM (SELECT c_custkey AS a, (c_custkey * 3 + 1) % (SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, (c_custkey * 5 + 2) % (SELECT count(*) FROM customer) FROM customer WHERE c_custkey % 4 <> 0) AS x WHERE b IN (SELECT c_custkey FROM customer)), x AS (SELECT c_custkey AS a, c_custkey AS b FROM customer UNION SELECT x.a, c.b FROM x JOIN c ON c.a = x.b)"


@register(
    "summary_effects_solved",
    f"WITH RECURSIVE {CALLS} SELECT 's' || CAST(a AS VARCHAR) AS summary_id, 'a' || CAST(b AS VARCHAR) AS source_access_id FROM x WHERE b % 3 = 0",
)
def summary_effects_solved(spark, sf_dir):
    return solver.solve(solver_tables(spark, sf_dir), hashes=False)["effects"].select("summary_id", "source_access_id").distinct()


@register(
    "summary_completeness",
    f"WITH RECURSIVE {CALLS}, m AS (SELECT DISTINCT a FROM (SELECT c_custkey AS a, (c_custkey * 3 + 1) % (SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, (c_custkey * 5 + 2) % (SELECT count(*) FROM customer) FROM customer WHERE c_custkey % 4 <> 0) AS y WHERE b NOT IN (SELECT c_custkey FROM customer)) SELECT 's' || CAST(x.a AS VARCHAR) AS id, NOT bool_or(b % 7 = 3 OR b IN (SELECT a FROM m)) AS complete FROM x GROUP BY x.a",
)
def summary_completeness(spark, sf_dir):
    return solver.solve(solver_tables(spark, sf_dir), hashes=False)["summaries"].select("id", "complete")


@register("summary_flows")
def summary_flows(spark, sf_dir):
    """Cross-call flows by kind; small fixtures hold them against expected rows."""
    return solver.solve(solver_tables(spark, sf_dir), hashes=False)["flows"].groupBy("kind", "certainty").agg(F.count("*").alias("flows"))


@register(
    "control_flow",
    f"""WITH {ctes('cfg_graphs', 'cfg_blocks', 'cfg_edges', 'cfg_elements')},
g AS (SELECT *, row_number() OVER (ORDER BY build_variant, build_configuration_id, translation_unit_id, function_symbol_id, id) AS gn FROM v_cfg_graphs WHERE function_symbol_id = 'fn_7'),
b AS (SELECT 'block' AS part, g.gn, b.graph_id, b.id, row_number() OVER (ORDER BY g.gn, b.block_index, b.id) AS used FROM g JOIN v_cfg_blocks AS b ON b.graph_id = g.id),
e AS (SELECT 'edge' AS part, g.gn, e.graph_id, e.id, row_number() OVER (ORDER BY g.gn, s.block_index, e.successor_index, t.block_index, e.kind, e.feasible DESC, e.id) AS used
      FROM g JOIN v_cfg_edges AS e ON e.graph_id = g.id JOIN v_cfg_blocks AS s ON s.id = e.source_block_id JOIN v_cfg_blocks AS t ON t.id = e.target_block_id),
n AS (SELECT 'element' AS part, g.gn, n.graph_id, n.id, row_number() OVER (ORDER BY g.gn, b.block_index, n.element_index, n.id) AS used
      FROM g JOIN v_cfg_elements AS n ON n.graph_id = g.id JOIN v_cfg_blocks AS b ON b.id = n.block_id),
l AS (SELECT min(gn) AS stop FROM (SELECT gn FROM b WHERE used = 12 UNION ALL SELECT gn FROM n WHERE used = 45 UNION ALL SELECT gn FROM e WHERE used = 60) AS x)
SELECT part, graph_id, id FROM (SELECT * FROM b WHERE used <= 12 UNION ALL SELECT * FROM n WHERE used <= 45 UNION ALL SELECT * FROM e WHERE used <= 60) AS y, l WHERE l.stop IS NULL OR gn <= l.stop""",
)
def control_flow(spark, sf_dir):
    """Blocks, elements and edges of a function's graphs under budgets that all graphs share."""
    tables = {t: view(spark, sf_dir, t) for t in ("cfg_graphs", "cfg_blocks", "cfg_elements", "cfg_edges")}
    return services.control_flow(tables, "fn_7", max_blocks=12, max_elements=45, max_edges=60).select("part", "graph_id", "id")


@register(
    "data_flow",
    f"""WITH {ctes('data_flow_analyses', 'cfg_graphs', 'data_accesses', 'cfg_blocks', 'memory_locations', 'data_flow_evidence', 'function_summaries', 'summary_effects', 'summary_return_origins', 'interprocedural_flows')},
g AS (SELECT *, row_number() OVER (ORDER BY build_variant, build_configuration_id, translation_unit_id, function_symbol_id, id) AS gn FROM v_cfg_graphs WHERE function_symbol_id = 'fn_7'),
a AS (SELECT a.id, g.gn FROM g JOIN v_data_flow_analyses AS a ON a.graph_id = g.id),
x AS (SELECT 'location' AS part, a.gn, l.id, row_number() OVER (ORDER BY a.gn, l.kind, l.name, l.id) AS used, 8 AS budget FROM a JOIN v_memory_locations AS l ON l.analysis_id = a.id
      UNION ALL SELECT 'access', a.gn, c.id, row_number() OVER (ORDER BY a.gn, b.block_index, c.sequence, c.id), 30 FROM a JOIN v_data_accesses AS c ON c.analysis_id = a.id JOIN v_cfg_blocks AS b ON b.id = c.block_id
      UNION ALL SELECT 'evidence', a.gn, e.id, row_number() OVER (ORDER BY a.gn, CASE WHEN e.certainty = 'certain' THEN 0 ELSE 1 END, e.relation, e.source_access_id NULLS FIRST, e.source_location_id NULLS FIRST, e.target_access_id NULLS FIRST, e.target_location_id NULLS FIRST, e.id), 60 FROM a JOIN v_data_flow_evidence AS e ON e.analysis_id = a.id),
l AS (SELECT min(gn) AS stop FROM x WHERE used = budget),
k AS (SELECT part, id FROM x, l WHERE used <= budget AND (l.stop IS NULL OR gn <= l.stop)),
s AS (SELECT id FROM v_function_summaries WHERE function_symbol_id = 'fn_7' ORDER BY build_variant, build_configuration_id, translation_unit_id, id LIMIT 20),
r AS (SELECT 'effect' AS part, 1 AS n, id, row_number() OVER (ORDER BY CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END, is_local DESC, kind NULLS FIRST, id) AS i FROM v_summary_effects WHERE summary_id IN (SELECT id FROM s)
      UNION ALL SELECT 'origin', 2, id, row_number() OVER (ORDER BY CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END, is_local DESC, kind NULLS FIRST, id) FROM v_summary_return_origins WHERE summary_id IN (SELECT id FROM s)
      UNION ALL SELECT 'flow', 3, id, row_number() OVER (ORDER BY CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END, CASE WHEN target_certainty = 'certain' THEN 0 ELSE 1 END, kind NULLS FIRST, callsite_id NULLS FIRST, id) FROM v_interprocedural_flows WHERE caller_summary_id IN (SELECT id FROM s) OR callee_summary_id IN (SELECT id FROM s)),
p AS (SELECT part, id, row_number() OVER (ORDER BY n, i) AS used FROM r)
SELECT * FROM k UNION ALL SELECT part, id FROM p WHERE used <= 60 - (SELECT count(*) FROM k WHERE part = 'evidence')""",
)
def data_flow(spark, sf_dir):
    """Locations, accesses and evidence of a function; then its summaries' effects, origins and flows, as far as the budget of evidence goes."""
    names = ("cfg_graphs", "data_flow_analyses", "memory_locations", "data_accesses", "cfg_blocks", "data_flow_evidence", "function_summaries", "summary_effects", "summary_return_origins", "interprocedural_flows")
    tables = {t: view(spark, sf_dir, t) for t in names}
    return services.data_flow(tables, "fn_7", max_locations=8, max_accesses=30, max_evidence=60).select("part", "id")


@register("calls_service", f"WITH {ctes('callsites', 'call_targets')} SELECT s.id AS callsite_id, t.id AS target_id FROM v_callsites AS s JOIN v_call_targets AS t ON t.callsite_id = s.id WHERE target_symbol_id = 'fn_7' AND s.build_variant = 'F' ORDER BY CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END, confidence DESC, s.build_variant, path, start_line, start_column, callsite_id, target_symbol_id, target_id LIMIT 100")
def calls_service(spark, sf_dir):
    found = services.calls(view(spark, sf_dir, "callsites"), view(spark, sf_dir, "call_targets"), "fn_7", "incoming", ("F",), ("F", "O"))
    return found.select("callsite_id", "target_id")
