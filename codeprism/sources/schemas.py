"""Fixed schemas of the fact tables, and what their rows must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 10
PROV = "translation_unit_id string, build_configuration_id string, build_variant string"
SPAN = "struct<path:string,start_line:int,end_line:int,start_column:int,end_column:int>"
PLACE = "path string, start_line int, end_line int, start_column int, end_column int"

SCHEMAS = {
    "symbol_variants": f"id string, symbol_id string, qualified_name string, kind string, {PLACE}, signature string, documentation string, source_hash string, source_text string, is_definition boolean, metadata map<string,string>, {PROV}",
    "occurrences": f"id string, symbol_id string, enclosing_symbol_id string, kind string, {PLACE}, metadata map<string,string>, {PROV}",
    "edges": f"id string, source_id string, target_id string, relation string, {PROV}",
    "embeddings": "variant_id string, model string, dimensions int, magnitude double, vector array<double>, build_variant string",
    "cfg_graphs": f"id string, function_symbol_id string, entry_block_id string, normal_exit_block_id string, exceptional_exit_block_id string, clang_major int, fact_schema_version int, build_options map<string,boolean>, {PROV}",
    "cfg_blocks": f"id string, graph_id string, block_index int, role string, reachable boolean, terminator_kind string, terminator_text string, terminator_spelling_span {SPAN}, terminator_expansion_span {SPAN}, label_kind string, label_text string, {PROV}",
    "cfg_elements": f"id string, graph_id string, block_id string, element_index int, kind string, statement_class string, text string, spelling_span {SPAN}, expansion_span {SPAN}, metadata map<string,string>, {PROV}",
    "cfg_edges": f"id string, graph_id string, source_block_id string, target_block_id string, kind string, successor_index int, feasible boolean, {PROV}",
    "callsites": f"id string, owner_symbol_id string, dispatch_kind string, spelling_span {SPAN}, {PLACE}, expansion_stack array<struct<macro_symbol_id:string,name:string,spelling_span:{SPAN},expansion_span:{SPAN}>>, static_target_symbol_id string, target_set_complete boolean, unresolved_reason string, callee_text string, {PROV}",
    "call_targets": f"id string, callsite_id string, target_symbol_id string, certainty string, confidence double, confidence_reason string, derivation string, evidence_span {SPAN}, {PROV}",
    "data_flow_analyses": f"id string, graph_id string, complete boolean, incomplete_reasons array<string>, iteration_count int, max_iterations int, max_alias_targets int, max_access_path_depth int, max_locations int, {PROV}",
    "memory_locations": f"id string, analysis_id string, graph_id string, kind string, name string, type_name string, declaration_symbol_id string, base_location_id string, access_path array<string>, is_volatile boolean, is_atomic boolean, {PROV}",
    "data_accesses": f"id string, analysis_id string, graph_id string, block_id string, cfg_element_id string, location_id string, kind string, sequence int, span {SPAN}, expression string, pointee_symbol_ids array<string>, points_to_complete boolean, {PROV}",
    "data_flow_evidence": f"id string, analysis_id string, graph_id string, relation string, certainty string, reason string, source_access_id string, target_access_id string, source_location_id string, target_location_id string, evidence_span {SPAN}, {PROV}",
    "function_summaries": f"id string, function_symbol_id string, graph_id string, analysis_id string, parameter_modes array<string>, parameter_location_ids array<string>, local_complete boolean, local_incomplete_reasons array<string>, complete boolean, incomplete_reasons array<string>, recursive boolean, iteration_count int, max_scc_iterations int, max_scc_size int, max_summary_effects int, solution_hash string, {PROV}",
    "summary_effects": f"id string, summary_id string, kind string, location_kind string, certainty string, reason string, parameter_index int, access_path array<string>, location_id string, source_access_id string, is_local boolean, via_callsite_id string, target_symbol_id string, {PROV}",
    "summary_return_origins": f"id string, summary_id string, kind string, certainty string, reason string, location_kind string, parameter_index int, access_path array<string>, location_id string, callsite_id string, is_local boolean, via_callsite_id string, target_symbol_id string, {PROV}",
    "call_argument_bindings": f"id string, caller_summary_id string, callsite_id string, argument_index int, location_id string, location_kind string, parameter_index int, access_path array<string>, writeback_candidate boolean, complete boolean, incomplete_reason string, {PROV}",
    "call_result_bindings": f"id string, caller_summary_id string, callsite_id string, location_id string, definition_access_id string, {PROV}",
    "interprocedural_flows": f"id string, kind string, caller_summary_id string, callee_summary_id string, callsite_id string, target_symbol_id string, target_certainty string, certainty string, reason string, argument_index int, caller_location_id string, callee_location_id string, caller_access_id string, {PROV}",
    "translation_units": "id string, build_configuration_id string, source_path string, content_hash string, diagnostics array<string>, analysis_backend string, advanced_facts_complete boolean, build_variant string",
    "build_configurations": "id string, source_path string, directory string, arguments array<string>, command_hash string, output string, build_variant string",
    "dependencies": "translation_unit_id string, path string, content_hash string, build_variant string",
    "build_variants": "name string, compilation_database string, target string, platform string, metadata map<string,string>, reindex_required boolean",
}

#: The closed sets of names.
ENUMS = {
    ("symbol_variants", "kind"): "file function method class struct enum namespace variable type_alias macro unknown",
    ("edges", "relation"): "contains references calls inherits overrides uses_type includes instantiates specializes generated_by_macro",
    ("occurrences", "kind"): "declaration definition reference call type macro_expansion",
    ("cfg_blocks", "role"): "normal entry normal_exit exceptional_exit",
    ("cfg_edges", "kind"): "fallthrough true false case default loop_back break continue return goto exception",
    ("callsites", "dispatch_kind"): "direct constructor virtual devirtualized lambda generic_lambda functor dependent_template unresolved_indirect",
    ("call_targets", "certainty"): "certain possible",
    ("memory_locations", "kind"): "local parameter global return dereference field unknown",
    ("data_accesses", "kind"): "parameter_definition initialization assignment compound_assignment increment decrement call_return unknown_clobber read call_argument return_value condition",
    ("data_flow_evidence", "relation"): "reaching_definition overwrites must_alias may_alias",
    ("summary_effects", "kind"): "read write escape",
    ("summary_return_origins", "kind"): "location call_result constant unknown",
    ("interprocedural_flows", "kind"): "argument_to_parameter return_to_caller writeback",
}


def violations(name: str, df: DataFrame) -> DataFrame:
    """Rows that break an invariant of their table, with `problem`."""
    problem = F.when(F.lit(False), F.lit(""))
    for (table, column), values in ENUMS.items():
        if table == name and column in df.columns:
            problem = problem.when(~F.coalesce(F.col(column).isin(*values.split()), F.lit(False)), F.lit(f"{column} is not a known value"))
    if {"start_line", "end_line"} <= set(df.columns):
        problem = problem.when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit("a span starts at line 1 or later and ends no earlier"))
    if "confidence" in df.columns:
        problem = problem.when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence is from 0 to 1"))
    if name == "data_flow_evidence":
        pair = lambda what: F.col(f"source_{what}_id").isNotNull() & F.col(f"target_{what}_id").isNotNull()
        problem = problem.when(pair("access") == pair("location"), F.lit("evidence has one pair, of accesses or of locations"))
    return df.withColumn("problem", problem).where("problem IS NOT NULL")


def conform(name: str, df: DataFrame) -> DataFrame:
    """df with the columns and types of a table; missing columns are null."""
    out: list[Column] = []
    for field in df.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields:
        have = F.col(field.name) if field.name in df.columns else F.lit(None)
        out.append(have.cast(field.dataType).alias(field.name))
    return df.select(*out)
