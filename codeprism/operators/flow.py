"""Data-flow operators on facts: classification, reaching definitions, aliases, overlays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Access kinds that define a location.
DEFINITIONS = ("parameter_definition", "initialization", "assignment", "compound_assignment", "increment", "decrement", "call_return", "unknown_clobber")
MAX_ROUNDS = 64
#: Reasons of an analysis that a summary takes over.
CRITICAL_REASONS = (
    "access_path_cap_exceeded",
    "alias_target_cap_exceeded",
    "atomic_access",
    "inline_assembly",
    "iteration_cap_exceeded",
    "location_cap_exceeded",
    "union_storage",
    "volatile_access",
)


def is_definition(kind: Column) -> Column:
    return kind.isin(*DEFINITIONS)


def edge_kind(flags: Column) -> Column:
    """The kind of a control-flow edge from boolean flags, by precedence."""
    order = ("exception", "default", "case", "break", "continue", "goto", "return", "loop_back", "true", "false")
    out = F.when(F.lit(False), F.lit(""))
    for name in order:
        out = out.when(flags[name], F.lit(name))
    return out.otherwise(F.lit("fallthrough"))


def dispatch_kind(f: Column) -> Column:
    """How a call is dispatched, from raw flags of the site. The first rule that fits decides."""
    return (
        F.when(~f["has_target"] & f["dependent"], "dependent_template")
        .when(~f["has_target"], "unresolved_indirect")
        .when(f["constructor"], "constructor")
        .when(~f["method"], "direct")
        .when(f["lambda"], "lambda")
        .when(f["functor"], "functor")
        .when(~f["virtual"] | f["qualified"], "direct")
        .when(f["final"], "devirtualized")
        .otherwise("virtual")
    )


def downgrade_external(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites whose static target is not indexed become incomplete and lose the target."""
    known = symbols.select(F.col("id").alias("static_target_symbol_id"), F.lit(True).alias("known")).distinct()
    joined = sites.join(known, "static_target_symbol_id", "left")
    external = F.col("static_target_symbol_id").isNotNull() & F.col("known").isNull()
    return (
        joined.withColumn("target_set_complete", F.col("target_set_complete") & ~external)
        .withColumn("unresolved_reason", F.when(external, "resolved_target_external_or_unindexed").otherwise(F.col("unresolved_reason")))
        .withColumn("static_target_symbol_id", F.when(~external, F.col("static_target_symbol_id")))
        .drop("known")
    )


def overlay_resolutions(sites: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Completeness and reason of a site, replaced by those of its resolution."""
    r = resolutions.select(F.col("callsite_id").alias("id"), F.col("target_set_complete").alias("rc"), F.col("unresolved_reason").alias("rr"))
    joined = sites.join(r, "id", "left")
    return joined.withColumn("target_set_complete", F.coalesce("rc", "target_set_complete")).withColumn("unresolved_reason", F.coalesce("rr", "unresolved_reason")).drop("rc", "rr")


def last_definition(accesses: DataFrame) -> DataFrame:
    """Each access with the definition of its location that comes last before it in its block, or null."""
    before = Window.partitionBy("graph_id", "block_id", "location_id").orderBy("sequence", "id").rowsBetween(Window.unboundedPreceding, -1)
    return accesses.withColumn("definition_id", F.last(F.when(is_definition(F.col("kind")), F.col("id")), ignorenulls=True).over(before))


def block_definitions(accesses: DataFrame) -> DataFrame:
    """The definition of each location that leaves each block: the last one."""
    own = accesses.where(is_definition(F.col("kind")))
    return own.groupBy("graph_id", "block_id", "location_id").agg(F.max_by("id", F.struct("sequence", "id")).alias("definition_id"))


def solve_graph(blocks: list, predecessors: dict, accesses: dict, rounds: int = MAX_ROUNDS) -> tuple[list[tuple], int, bool]:
    """Evidence (relation, source, target, certain), rounds and convergence of one graph.

    blocks are in ascending order and updated in place, each round in that order; the round
    that changes nothing counts. accesses: block -> [(id, location, is definition)] in order.
    """
    leave: dict = {}
    enter: dict = {}

    def merged(block) -> dict:
        before = predecessors.get(block, [])
        states = [leave[p] for p in before if p in leave]
        out = {}
        for location in {k for s in states for k in s}:
            sets = [s[location] for s in states if location in s]
            whole = len(states) == len(before) and len(sets) == len(states) and all(c for _, c in sets)
            out[location] = (frozenset().union(*(d for d, _ in sets)), whole)
        return out

    count, converged = 0, False
    while count < rounds and not converged:
        count, converged = count + 1, True
        for block in blocks:
            state = merged(block)
            after = state | {location: (frozenset([i]), True) for i, location, defines in accesses.get(block, ()) if defines}
            if enter.get(block) != state or leave.get(block) != after:
                enter[block], leave[block], converged = state, after, False
    evidence = []
    for block in blocks:
        state = dict(enter.get(block, {}))
        for i, location, defines in accesses.get(block, ()):
            reaching, whole = state.get(location, (frozenset(), False))
            certain = whole and len(reaching) == 1
            evidence += [("overwrites" if defines else "reaching_definition", d, i, certain) for d in sorted(reaching)]
            if defines:
                state[location] = (frozenset([i]), True)
    return evidence, count, converged


EVIDENCE = "graph_id string, relation string, source_access_id string, target_access_id string, certainty string, iteration_count int, converged boolean"


def reaching_definitions(blocks: DataFrame, edges: DataFrame, accesses: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Reaching-definition and overwrites evidence of every graph.

    The number of rounds depends on the order of in-place updates, so each graph is solved as
    one group; a graph is a function's body and its size is bound by that.
    """
    rows = (
        blocks.select("graph_id", F.lit("block").alias("what"), F.col("id").alias("x"), F.lit(None).cast("string").alias("y"), F.col("block_index").cast("long").alias("n"), F.lit(False).alias("f"), F.lit(None).cast("string").alias("z"))
        .unionAll(edges.where("feasible").select("graph_id", F.lit("edge"), "source_block_id", "target_block_id", F.lit(0).cast("long"), F.lit(False), F.lit(None).cast("string")))
        .unionAll(accesses.select("graph_id", F.lit("access"), "id", "block_id", F.col("sequence").cast("long"), is_definition(F.col("kind")), "location_id"))
    )

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = pdf[pdf["what"] == "block"].sort_values(["n", "x"])["x"].tolist()
        predecessors: dict = {}
        for s, t in sorted(set(zip(pdf.loc[pdf["what"] == "edge", "x"], pdf.loc[pdf["what"] == "edge", "y"]))):
            predecessors.setdefault(t, []).append(s)
        of: dict = {}
        for r in pdf[pdf["what"] == "access"].sort_values(["n", "x"]).itertuples():
            of.setdefault(r.y, []).append((r.x, r.z, r.f))
        evidence, count, converged = solve_graph(b, predecessors, of, rounds)
        out = [(key[0], rel, s, t, "certain" if c else "possible", count, converged) for rel, s, t, c in evidence]
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    return rows.groupBy("graph_id").applyInPandas(solve, EVIDENCE)


def alias_evidence(points_to: DataFrame) -> DataFrame:
    """(location_id, target_id, relation, certainty) from (location_id, locations, functions, complete, has_null).

    An alias is certain only if the set is complete and holds one location and nothing else.
    """
    must = F.col("complete") & ~F.col("has_null") & (F.size("functions") == 0) & (F.size("locations") == 1)
    return points_to.select(
        "location_id",
        F.explode("locations").alias("target_id"),
        F.when(must, "must_alias").otherwise("may_alias").alias("relation"),
        F.when(must, "certain").otherwise("possible").alias("certainty"),
    )


def resolve_indirect(points_to: DataFrame) -> DataFrame:
    """(callsite_id, target_symbol_id, certainty, confidence, target_set_complete) from (callsite_id, functions, complete, has_null)."""
    one = F.col("complete") & ~F.col("has_null") & (F.size("functions") == 1)
    return points_to.select(
        "callsite_id",
        F.explode("functions").alias("target_symbol_id"),
        F.when(one, "certain").otherwise("possible").alias("certainty"),
        F.when(one, 1.0).otherwise(0.5).alias("confidence"),
        F.col("complete").alias("target_set_complete"),
    )


def local_effects(accesses: DataFrame, locations: DataFrame) -> DataFrame:
    """Effects a function has on storage outside it: (graph_id, source_access_id, kind, location_kind, location_id).

    Parameters, globals, fields and dereferences count; definitions write, other accesses read.
    """
    outer = locations.where(F.col("kind").isin("parameter", "global", "field", "dereference")).select(F.col("id").alias("location_id"), F.col("kind").alias("location_kind"))
    kind = F.when(is_definition(F.col("kind")), "write").otherwise("read")
    return accesses.where("kind <> 'parameter_definition'").join(outer, "location_id").select("graph_id", F.col("id").alias("source_access_id"), kind.alias("kind"), "location_kind", "location_id")


def seed_reasons(reasons: Column) -> Column:
    """The reasons of an analysis that make a summary incomplete, sorted."""
    return F.array_sort(F.array_intersect(reasons, F.array(*[F.lit(r) for r in CRITICAL_REASONS])))
