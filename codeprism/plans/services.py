"""Composed services: control flow, data flow and calls of one function under budgets.

Each relation is read once for all graphs of the function, and running counts in the total
order say what the budgets, which all graphs share, still cover. When a budget is used up, the
graphs after the one that used it up are left out.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.lookups import LOOKUPS, checked_scope, order_of
from ..operators.page import bounded_page

#: The most that one request may ask for.
MAXIMA = {"graphs": 20, "blocks": 500, "elements": 2000, "edges": 2000, "analyses": 20, "locations": 1000, "accesses": 2000, "evidence": 2000, "calls": 100}


def within(name: str, value: int) -> int:
    if not 1 <= value <= MAXIMA[name]:
        raise ValueError(f"{name} must be from 1 to {MAXIMA[name]}")
    return value


def resolve_scope(requested: tuple[str, ...] | None, allowed: tuple[str, ...]) -> tuple[str, ...]:
    """The builds asked for, which must be among the allowed ones; all allowed ones for none."""
    scope = checked_scope(requested or allowed)
    missing = [n for n in scope if n not in allowed]
    if missing:
        raise ValueError(f"builds that are not available: {', '.join(missing)}")
    return scope


def graphs_of(graphs: DataFrame, function: str, scope, limit: int) -> DataFrame:
    """graph_id and its place gn, of the function's first graphs, with `more` if there are others."""
    rows = graphs.where(F.col("function_symbol_id") == function)
    if scope is not None:
        rows = rows.where(F.col("build_variant").isin(*scope))
    order = order_of(LOOKUPS["cfg_graphs"])
    page = bounded_page(rows, order, limit)
    return page.select(F.col("id").alias("graph_id"), F.row_number().over(Window.partitionBy().orderBy(*order)).alias("gn"), F.col("truncated").alias("more"))


def covered(parts: dict[str, tuple[DataFrame, list, int]]) -> DataFrame:
    """part, gn, graph_id, id, truncated of what the budgets cover.

    Per part: rows with gn and id, their order within a graph, and the budget. Only budget + 1
    rows of a part are sorted in one task.
    """
    taken = None
    for name, (rows, order, budget) in parts.items():
        probe = rows.orderBy("gn", *order).limit(budget + 1)
        every = Window.partitionBy().orderBy("gn", *order)
        one = probe.withColumn("used", F.row_number().over(every)).withColumn("short", F.count("*").over(Window.partitionBy()) > budget)
        one = one.where(F.col("used") <= budget).select(F.lit(name).alias("part"), "gn", "graph_id", "id", (F.col("used") == budget).alias("last"), "short")
        taken = one if taken is None else taken.unionAll(one)
    stop = F.min(F.when(F.col("last"), F.col("gn"))).over(Window.partitionBy())
    marked = taken.withColumn("stop", stop).withColumn("truncated", F.max("short").over(Window.partitionBy()))
    return marked.where(F.col("stop").isNull() | (F.col("gn") <= F.col("stop"))).select("part", "gn", "graph_id", "id", "truncated")


def control_flow(tables: dict[str, DataFrame], function: str, scope=None, max_graphs: int = 20, max_blocks: int = 500, max_elements: int = 2000, max_edges: int = 2000) -> DataFrame:
    """Blocks, elements (where given) and edges of a function's graphs."""
    g = F.broadcast(graphs_of(tables["cfg_graphs"], function, scope, within("graphs", max_graphs)))
    index = tables["cfg_blocks"].select("graph_id", F.col("id").alias("bid"), "block_index")
    parts = {"block": (tables["cfg_blocks"].join(g, "graph_id"), ["block_index", "id"], within("blocks", max_blocks))}
    if "cfg_elements" in tables:
        rows = tables["cfg_elements"].join(g, "graph_id").join(index.withColumnRenamed("bid", "block_id"), ["graph_id", "block_id"])
        parts["element"] = (rows, ["block_index", "element_index", "id"], within("elements", max_elements))
    rows = tables["cfg_edges"].join(g, "graph_id")
    for end, alias in (("source_block_id", "si"), ("target_block_id", "ti")):
        rows = rows.join(index.select("graph_id", F.col("bid").alias(end), F.col("block_index").alias(alias)), ["graph_id", end])
    parts["edge"] = (rows, ["si", "successor_index", "ti", "kind", F.desc("feasible"), "id"], within("edges", max_edges))
    return covered(parts)


def data_flow(tables: dict[str, DataFrame], function: str, scope=None, max_graphs: int = 20, max_locations: int = 1000, max_accesses: int = 2000, max_evidence: int = 2000) -> DataFrame:
    """Locations, accesses and evidence of a function's analyses; then, of what is left of the
    evidence budget, effects, return origins and cross-call flows of its summaries (where given)."""
    g = F.broadcast(graphs_of(tables["cfg_graphs"], function, scope, within("graphs", max_graphs)))
    analyses = F.broadcast(tables["data_flow_analyses"].join(g, "graph_id").select(F.col("id").alias("analysis_id"), "graph_id", "gn"))
    of = lambda name: tables[name].drop("graph_id").join(analyses, "analysis_id")
    index = tables["cfg_blocks"].select(F.col("id").alias("block_id"), "block_index")
    parts = {
        "location": (of("memory_locations"), ["kind", "name", "id"], within("locations", max_locations)),
        "access": (of("data_accesses").join(index, "block_id"), ["block_index", "sequence", "id"], within("accesses", max_accesses)),
        "evidence": (of("data_flow_evidence"), order_of(LOOKUPS["data_flow_evidence"]), within("evidence", max_evidence)),
    }
    out = covered(parts)
    if "function_summaries" not in tables:
        return out
    left = max_evidence - out.where("part = 'evidence'").count()
    summaries = tables["function_summaries"].where(F.col("function_symbol_id") == function)
    names = [r["id"] for r in summaries.orderBy(*order_of(LOOKUPS["function_summaries"])).limit(max_graphs).select("id").collect()]
    taken: list[tuple] = []  # at most max_evidence rows
    for name, table in (("effect", "summary_effects"), ("origin", "summary_return_origins"), ("flow", "interprocedural_flows")):
        if left <= 0 or table not in tables or not names:
            break
        rows = tables[table]
        ends = ("caller_summary_id", "callee_summary_id") if table == "interprocedural_flows" else ("summary_id",)
        page = bounded_page(rows.where(functools.reduce(operator.or_, [F.col(c).isin(names) for c in ends])), order_of(LOOKUPS[table]), left)
        found = page.select("id", "truncated").collect()
        taken += [(name, 0, None, r["id"], r["truncated"]) for r in found]
        left -= len(found)
    more = out.sparkSession.createDataFrame(taken, "part string, gn int, graph_id string, id string, truncated boolean")
    return out.unionAll(more)


def calls(sites: DataFrame, targets: DataFrame, symbol: str, direction: str, requested, allowed: tuple[str, ...], limit: int = 100) -> DataFrame:
    if direction not in ("incoming", "outgoing"):
        raise ValueError("a direction is incoming or outgoing")
    return graph.call_evidence(sites, targets, symbol, direction == "incoming", resolve_scope(requested, allowed), within("calls", limit))
