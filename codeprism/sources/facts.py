"""Fact streams: JSON lines of hello, begin, facts and complete, plain or gzipped.

The compiler itself stays outside; its facts are the source of everything else here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS

PROTOCOL, COMPILER = 5, 18
ENVELOPE = "type string, request_id string, success boolean, fact string, protocol int, clang_major int, capabilities array<string>, message string, value string"
#: What a producer must be able to do.
CAPABILITIES = frozenset(
    "direct_calls full_ast includes inherits lambda_metadata macro_provenance occurrences overrides pp_callbacks source_manager symbols "
    "template_metadata uses_type function_cfg_v1 callsites_v1 dispatch_targets_v1 macro_expansion_stack template_relationships_v1 "
    "intraprocedural_dataflow_v1 points_to_v1 function_summaries_v1 interprocedural_bindings_v1".split()
)
#: Fact kinds by the table they become.
KINDS = {
    "symbol": "symbol_variants",
    "occurrence": "occurrences",
    "edge": "edges",
    "cfg_graph_v1": "cfg_graphs",
    "cfg_block_v1": "cfg_blocks",
    "cfg_element_v1": "cfg_elements",
    "cfg_edge_v1": "cfg_edges",
    "callsite_v1": "callsites",
    "call_target_v1": "call_targets",
    "data_flow_analysis_v1": "data_flow_analyses",
    "memory_location_v1": "memory_locations",
    "data_access_v1": "data_accesses",
    "data_flow_evidence_v1": "data_flow_evidence",
    "function_summary_v1": "function_summaries",
    "summary_effect_v1": "summary_effects",
    "summary_return_origin_v1": "summary_return_origins",
    "call_argument_binding_v1": "call_argument_bindings",
    "call_result_binding_v1": "call_result_bindings",
}
#: Which column of which kind must name a row of which other kind.
REFERENCES = (
    ("cfg_block_v1", "graph_id", "cfg_graph_v1"),
    ("cfg_element_v1", "block_id", "cfg_block_v1"),
    ("cfg_edge_v1", "source_block_id", "cfg_block_v1"),
    ("cfg_edge_v1", "target_block_id", "cfg_block_v1"),
    ("call_target_v1", "callsite_id", "callsite_v1"),
    ("data_flow_analysis_v1", "graph_id", "cfg_graph_v1"),
    ("memory_location_v1", "analysis_id", "data_flow_analysis_v1"),
    ("data_access_v1", "analysis_id", "data_flow_analysis_v1"),
    ("data_access_v1", "location_id", "memory_location_v1"),
    ("summary_effect_v1", "summary_id", "function_summary_v1"),
    ("summary_return_origin_v1", "summary_id", "function_summary_v1"),
    ("call_argument_binding_v1", "caller_summary_id", "function_summary_v1"),
    ("call_result_binding_v1", "caller_summary_id", "function_summary_v1"),
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Envelope columns and the whole line as `line`; a line that is no JSON object has a null type."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    return lines.select("line", F.from_json("line", ENVELOPE).alias("e")).select("line", "e.*")


def check_handshake(records: DataFrame, required: set[str] = CAPABILITIES) -> None:
    """Every hello must have the protocol, the compiler version and the required capabilities."""
    hellos = records.where("type = 'hello'").select("protocol", "clang_major", "capabilities").distinct().collect()
    if not hellos:
        raise ValueError("the stream has no hello")
    for h in hellos:
        if h["protocol"] != PROTOCOL or h["clang_major"] != COMPILER:
            raise ValueError(f"protocol {h['protocol']} of compiler {h['clang_major']}; needed are {PROTOCOL} and {COMPILER}")
        if missing := required - set(h["capabilities"] or ()):
            raise ValueError(f"missing capabilities: {', '.join(sorted(missing))}")


def admitted(records: DataFrame) -> DataFrame:
    """Facts of requests that began once and have one, successful, complete record; others yield nothing."""
    ends = records.where("type IN ('begin', 'complete')").groupBy("request_id").agg(
        F.count_if(F.col("type") == "begin").alias("begins"), F.count_if(F.col("type") == "complete").alias("ends"), F.bool_and(F.coalesce("success", F.col("type") == "begin")).alias("good")
    )
    whole = ends.where("begins = 1 AND ends = 1 AND good").select("request_id")
    return records.where("type = 'fact'").join(whole, "request_id", "left_semi")


def table(facts: DataFrame, kind: str) -> DataFrame:
    """Typed rows of one fact kind; the fact's columns stand beside the envelope."""
    schema = SCHEMAS[KINDS[kind]]
    return facts.where(F.col("fact") == kind).select(F.from_json("line", schema).alias("r")).select("r.*")


def unresolved(facts: DataFrame) -> DataFrame:
    """(kind, column, value) of references to rows that the facts do not hold; empty if all is well."""
    out = None
    for kind, column, other in REFERENCES:
        have = table(facts, other).select(F.col("id").alias(column))
        one = table(facts, kind).where(F.col(column).isNotNull()).join(have, column, "left_anti")
        one = one.select(F.lit(kind).alias("kind"), F.lit(column).alias("column"), F.col(column).alias("value")).distinct()
        out = one if out is None else out.unionAll(one)
    return out


#: Which rows must stand in the same graph or analysis as the row that they name: kind, column, other kind, shared column.
SHARED = (
    ("cfg_element_v1", "block_id", "cfg_block_v1", "graph_id"),
    ("cfg_edge_v1", "source_block_id", "cfg_block_v1", "graph_id"),
    ("cfg_edge_v1", "target_block_id", "cfg_block_v1", "graph_id"),
    ("data_access_v1", "location_id", "memory_location_v1", "analysis_id"),
    ("data_access_v1", "block_id", "cfg_block_v1", "graph_id"),
    ("data_access_v1", "analysis_id", "data_flow_analysis_v1", "graph_id"),
    ("memory_location_v1", "analysis_id", "data_flow_analysis_v1", "graph_id"),
    ("data_flow_evidence_v1", "source_access_id", "data_access_v1", "analysis_id"),
    ("data_flow_evidence_v1", "target_access_id", "data_access_v1", "analysis_id"),
    ("data_flow_evidence_v1", "source_location_id", "memory_location_v1", "analysis_id"),
    ("data_flow_evidence_v1", "target_location_id", "memory_location_v1", "analysis_id"),
)


def crossing(facts: DataFrame) -> DataFrame:
    """(kind, column, value) of references into another graph or analysis; empty if all is well."""
    out = None
    for kind, column, other, shared in SHARED:
        there = table(facts, other).select(F.col("id").alias(column), F.col(shared).alias("_there"))
        one = table(facts, kind).where(F.col(column).isNotNull()).select(column, shared).join(there, column)
        one = one.where(~F.col(shared).eqNullSafe(F.col("_there"))).select(F.lit(kind).alias("kind"), F.lit(column).alias("column"), F.col(column).alias("value")).distinct()
        out = one if out is None else out.unionAll(one)
    return out


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """All tables of the admitted facts; raises if a reference leads nowhere, or into another graph or analysis. Of rows with one id one stays."""
    bad = unresolved(facts).limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['kind']}.{r['column']} names {r['value']}, which is not there" for r in bad))
    bad = crossing(facts).limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['kind']}.{r['column']} names {r['value']} of another graph or analysis" for r in bad))
    out = {}
    for kind, name in KINDS.items():
        t = table(facts, kind)
        key = [c for c in ("id",) if c in t.columns]
        out[name] = t.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json(F.struct(*t.columns))))).where("_n = 1").drop("_n") if key else t
    return out
