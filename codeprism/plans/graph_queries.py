"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..views import ctes, view

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


EDGE = "id, source_id, target_id, relation, build_variant"


@register(
    "neighbors_one",
    f"""WITH {ctes('edges')}, r AS (SELECT *, row_number() OVER (ORDER BY relation, source_id, target_id, build_variant, id) AS n FROM v_edges WHERE source_id = 'p7' OR target_id = 'p7')
SELECT {EDGE}, CAST(n AS INTEGER) AS position FROM r WHERE n <= 20""",
)
def neighbors_one(spark, sf_dir):
    found = graph.neighbors(view(spark, sf_dir, "edges"), "p7", per_node=20)
    return spark.createDataFrame([(*r.values(), i + 1) for i, r in enumerate(found)], "id string, source_id string, target_id string, relation string, build_variant string, position int")


@register(
    "neighbors_two",
    f"""WITH {ctes('edges')}, a AS (SELECT *, row_number() OVER (ORDER BY relation, source_id, target_id, build_variant, id) AS n FROM v_edges WHERE source_id = 'c7'),
f AS (SELECT target_id AS node, min(n) AS seq FROM a WHERE n <= 5 GROUP BY 1),
b AS (SELECT e.*, row_number() OVER (PARTITION BY f.node ORDER BY relation, source_id, target_id, build_variant, id) AS n FROM v_edges AS e JOIN f ON e.source_id = f.node)
SELECT {EDGE} FROM a WHERE n <= 5 UNION SELECT {EDGE} FROM b WHERE n <= 5""",
)
def neighbors_two(spark, sf_dir):
    found = graph.neighbors(view(spark, sf_dir, "edges"), "c7", depth=2, direction="outgoing", per_node=5)
    return spark.createDataFrame([tuple(r.values()) for r in found], "id string, source_id string, target_id string, relation string, build_variant string")


@register("put_edges", f"WITH {ctes('edges')} SELECT relation, count(*) AS edges FROM v_edges GROUP BY relation UNION ALL SELECT 'contains', count(*) FROM nation")
def put_edges(spark, sf_dir):
    """New edges join, those with a known id do not."""
    edges = view(spark, sf_dir, "edges")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.concat(F.lit("n"), F.col("n_nationkey"))
    new = nation.select(F.concat(name, F.lit(">contains")).alias("id"), F.lit("r").alias("source_id"), name.alias("target_id"), F.lit("contains").alias("relation"), F.lit("F").alias("build_variant"))
    return graph.put_edges(edges, new.unionByName(edges.limit(100))).groupBy("relation").agg(F.count("*").alias("edges"))


SEED = "SELECT 5 AS id UNION ALL SELECT 11"


@register("forward_closure", f"WITH RECURSIVE {ctes('calls')}, x AS ({SEED} UNION SELECT c.b FROM x JOIN v_calls AS c ON c.a = x.id) SELECT id FROM x")
def forward_closure(spark, sf_dir):
    return graph.forward_callees(view(spark, sf_dir, "calls"), spark.createDataFrame([(5,), (11,)], "id long"))


@register("reverse_closure", f"WITH RECURSIVE {ctes('calls')}, x AS ({SEED} UNION SELECT c.a FROM x JOIN v_calls AS c ON c.b = x.id) SELECT id FROM x WHERE id NOT IN (5, 11)")
def reverse_closure(spark, sf_dir):
    return graph.reverse_callers(view(spark, sf_dir, "calls"), spark.createDataFrame([(5,), (11,)], "id long"))


@register(
    "strong_components",
    f"WITH RECURSIVE {ctes('calls')}, x AS (SELECT a, b FROM v_calls UNION SELECT x.a, c.b FROM x JOIN v_calls AS c ON c.a = x.b), n AS (SELECT a AS id FROM v_calls UNION SELECT b FROM v_calls) SELECT n.id, least(n.id, coalesce(min(p.a), n.id)) AS component FROM n LEFT JOIN (SELECT p.a, p.b FROM x AS p JOIN x AS q ON q.a = p.b AND q.b = p.a) AS p ON p.b = n.id GROUP BY n.id",
)
def strong_components(spark, sf_dir):
    return graph.strong_components(view(spark, sf_dir, "calls"))


@register(
    "weak_components",
    f"WITH RECURSIVE {ctes('calls')}, e AS (SELECT a, b FROM v_calls UNION SELECT b, a FROM v_calls), x AS (SELECT a, b FROM e UNION SELECT x.a, e.b FROM x JOIN e ON e.a = x.b) SELECT a AS id, least(a, min(b)) AS component FROM x WHERE a IN (SELECT a FROM e WHERE a <> b) GROUP BY a",
)
def weak_components(spark, sf_dir):
    return graph.components(view(spark, sf_dir, "calls"))


@register(
    "override_targets",
    f"""WITH RECURSIVE {ctes('callsites', 'call_targets', 'overrides')},
s AS (SELECT * FROM v_callsites WHERE dispatch_kind = 'virtual'),
o AS (SELECT source_id, target_id FROM v_overrides),
x AS (SELECT DISTINCT static_target_symbol_id AS root, o.source_id AS id FROM s JOIN o ON o.target_id = static_target_symbol_id UNION SELECT x.root, o.source_id FROM x JOIN o ON o.target_id = x.id)
SELECT s.id AS callsite_id, x.id AS target_symbol_id, 'possible' AS certainty, CAST(0.5 AS DOUBLE) AS confidence, 'indexed_override_candidate' AS derivation, s.build_variant
FROM s JOIN x ON x.root = s.static_target_symbol_id WHERE x.id <> x.root AND NOT EXISTS (SELECT 1 FROM v_call_targets AS t WHERE t.callsite_id = s.id AND t.target_symbol_id = x.id)""",
)
def override_targets(spark, sf_dir):
    sites = view(spark, sf_dir, "callsites")
    one = view(spark, sf_dir, "overrides").drop("build_variant")
    overrides = one.crossJoin(F.broadcast(sites.select("build_variant").distinct()))  # the same hierarchy in each of a few builds
    return graph.override_targets(sites, view(spark, sf_dir, "call_targets"), overrides)


EVIDENCE = f"""WITH {ctes('callsites', 'call_targets')},
e AS (SELECT s.id AS callsite_id, s.owner_symbol_id, s.path, s.start_line, s.start_column, s.build_variant, t.id AS target_id, t.target_symbol_id, t.certainty, t.confidence, t.derivation
      FROM v_callsites AS s JOIN v_call_targets AS t ON t.callsite_id = s.id),
n AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END, confidence DESC, build_variant, path, start_line, start_column, callsite_id, target_symbol_id, target_id) AS rn,
             count(*) OVER () AS every FROM e WHERE {{}})"""


def evidence_query(incoming: bool):
    column = "target_symbol_id" if incoming else "owner_symbol_id"

    def run(spark, sf_dir):
        return graph.call_evidence(view(spark, sf_dir, "callsites"), view(spark, sf_dir, "call_targets"), "fn_7", incoming, ("F", "O"), 20)

    return run, EVIDENCE.format(f"{column} = 'fn_7' AND build_variant IN ('F', 'O')") + " SELECT * EXCLUDE (rn, every), every > 20 AS truncated FROM n WHERE rn <= 20"


for _name, _incoming in (("incoming_calls", True), ("outgoing_calls", False)):
    QUERIES[_name], ORACLE[_name] = evidence_query(_incoming)


@register("callees", EVIDENCE.format("owner_symbol_id = 'fn_7'") + " SELECT owner_symbol_id AS source_id, target_symbol_id AS target_id, build_variant, certainty FROM n WHERE rn <= 25")
def callees(spark, sf_dir):
    return graph.callers_or_callees(view(spark, sf_dir, "edges"), view(spark, sf_dir, "callsites"), view(spark, sf_dir, "call_targets"), "fn_7", False)


@register("callers_by_edges", f"WITH {ctes('edges')} SELECT source_id, target_id, build_variant, CAST(NULL AS VARCHAR) AS certainty FROM v_edges WHERE relation = 'calls' AND target_id = 'p9' ORDER BY source_id, target_id, build_variant LIMIT 25")
def callers_by_edges(spark, sf_dir):
    """A symbol without call evidence falls back to its edges."""
    return graph.callers_or_callees(view(spark, sf_dir, "edges"), view(spark, sf_dir, "callsites"), view(spark, sf_dir, "call_targets"), "p9", True)


@register(
    "merged_graph",
    f"""WITH {ctes('callsites', 'call_targets', 'edges')},
k AS (SELECT s.owner_symbol_id AS source_id, t.target_symbol_id AS target_id, s.build_variant, min(CASE WHEN certainty = 'certain' THEN 0 ELSE 1 END) AS c
      FROM v_callsites AS s JOIN v_call_targets AS t ON t.callsite_id = s.id GROUP BY ALL)
SELECT count(*) AS edges, CAST(sum(c) AS BIGINT) AS certain FROM (SELECT 0 AS c FROM v_edges UNION ALL SELECT CASE WHEN c = 0 THEN 1 ELSE 0 END FROM k) AS x""",
)
def merged_graph(spark, sf_dir):
    sites, targets = view(spark, sf_dir, "callsites"), view(spark, sf_dir, "call_targets")
    t = targets.select(F.col("id").alias("target_id"), "callsite_id", "target_symbol_id", "certainty")
    evidence = sites.select(F.col("id").alias("callsite_id"), "owner_symbol_id", "build_variant").join(t, "callsite_id")
    merged = graph.merged_edges(view(spark, sf_dir, "edges"), evidence)
    return merged.agg(F.count("*").alias("edges"), F.count_if("certain").alias("certain"))


@register(
    "cfg_reachability",
    f"""WITH RECURSIVE {ctes('cfg_blocks', 'cfg_edges')},
x AS (SELECT graph_id, id FROM v_cfg_blocks WHERE block_index = 0 UNION SELECT x.graph_id, e.target_block_id FROM x JOIN v_cfg_edges AS e ON e.graph_id = x.graph_id AND e.source_block_id = x.id AND e.feasible)
SELECT b.*, x.id IS NOT NULL AS reachable FROM v_cfg_blocks AS b LEFT JOIN x ON x.graph_id = b.graph_id AND x.id = b.id""",
)
def cfg_reachability(spark, sf_dir):
    return graph.reachable_blocks(view(spark, sf_dir, "cfg_blocks"), view(spark, sf_dir, "cfg_edges"))


@register("hub_degrees", f"WITH {ctes('edges')} SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM v_edges UNION ALL SELECT target_id FROM v_edges) AS x GROUP BY node HAVING count(*) > 12")
def hub_degrees(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    ends = edges.select(F.col("source_id").alias("node")).unionAll(edges.select("target_id"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).where("degree > 12")
