"""Graph operators over edge tables: neighbours, closures, components, call evidence.

Closures are loops of joins in which only the newest level meets the edges; each level is a
staged table, so plans stay short and lost executors cost one level. A loop ends when a level
finds nothing new, so cycles are no problem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, staged
from .lookups import scope_filter
from .page import bounded_page, certain_first

DIRECTIONS = ("outgoing", "incoming", "both")
#: Edges up to which closures and strongly connected components are worked out by one task.
ONE_TASK = 3_000_000
#: Rounds in which a graph of more edges is trimmed, before one component after another is taken out.
TRIMS = 8
#: Distinct links up to which components are found in one task.
FEW_LINKS = 200_000


def put_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with those of more whose id is new; of equal new ids one is taken."""
    new = more.dropDuplicates(["id"]).join(edges.select("id"), "id", "left_anti")
    return edges.unionByName(new)


def neighbors(edges: DataFrame, start: str, relations=None, depth: int = 1, direction: str = "both", max_edges: int | None = None, per_node: int | None = None, scope=None) -> list[dict]:
    """Edges in the order a breadth-first search meets them, each once; nodes once, whatever their build.

    Each level is one job: the frontier's edges, ranked per node and cut to per_node, in the
    order of the frontier. The driver holds what was found, which max_edges bounds.
    """
    if depth < 1 or (max_edges is not None and max_edges < 1) or (per_node is not None and per_node < 1) or direction not in DIRECTIONS:
        raise ValueError("depth and limits are at least one; direction is outgoing, incoming or both")
    spark = edges.sparkSession
    rows = scope_filter(edges, scope)
    if relations:
        rows = rows.where(F.col("relation").isin(*sorted(relations)))
    found: dict[str, dict] = {}
    visited, frontier = {start}, [start]
    columns = ["id", "source_id", "target_id", "relation", "build_variant"]
    for _ in range(depth):
        if not frontier or (max_edges is not None and len(found) >= max_edges):
            break
        at = spark.createDataFrame(list(enumerate(frontier)), "seq int, node string")  # at most max_edges rows
        ends = {"outgoing": ["source_id"], "incoming": ["target_id"], "both": ["source_id", "target_id"]}[direction]
        met = None
        for end in ends:
            hits = rows.select(*columns).withColumn("node", F.col(end))
            if end == "target_id" and direction == "both":
                hits = hits.where(F.col("source_id") != F.col("target_id"))  # a loop counts once
            met = hits if met is None else met.unionAll(hits)
        ranked = met.join(F.broadcast(at), "node").withColumn(
            "n", F.row_number().over(Window.partitionBy("seq").orderBy("relation", "source_id", "target_id", "build_variant", "id"))
        )
        if per_node is not None:
            ranked = ranked.where(F.col("n") <= per_node)
        # edges that were met before are no news but keep their rank at their node
        if max_edges is not None:
            ranked = ranked.orderBy("seq", "n").limit(max_edges + len(found))
        frontier = []
        for r in ranked.orderBy("seq", "n").collect():
            found.setdefault(r["id"], {c: r[c] for c in columns})
            if max_edges is not None and len(found) >= max_edges:
                break
            near = r["target_id"] if r["node"] == r["source_id"] else r["source_id"]
            if near not in visited:
                visited.add(near)
                frontier.append(near)
    return list(found.values())


def closure(edges: DataFrame, seed: DataFrame, keys: tuple[str, ...] = (), one_task: int | None = None) -> DataFrame:
    """(keys.., id, level) of all that seed (keys.., id) reaches over edges (keys.., a, b), itself at level 0.

    The edges are staged, so that no level works them out anew. Without keys, up to one_task
    (ONE_TASK) edges are searched by one task. What was found before is one table of files.
    """
    e = staged(edges.select(*keys, "a", "b").distinct(), "closure-edges")
    first = seed.select(*keys, F.col("id").cast(e.schema["a"].dataType)).distinct()
    if not keys and e.count() <= (ONE_TASK if one_task is None else one_task):
        return closure_in_one_task(e, first)
    seen = staged(first.withColumn("level", F.lit(0)), "closure")
    parts, newest, level = [seen], seen, 0
    while True:
        level += 1
        met = newest.withColumnRenamed("id", "a").join(e, [*keys, "a"]).select(*keys, F.col("b").alias("id")).distinct()
        known = all_of(parts)
        newest = staged(met.join(known.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("level", F.lit(level)), "closure")
        if newest.isEmpty():
            drop_staged(newest, e)
            return known
        parts.append(newest)


def all_of(parts: list[DataFrame]) -> DataFrame:
    """The rows of staged tables of one schema, as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.staged_path for p in parts])


def numbered(ends: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Sorted distinct values of arrays of one type, and each array as places in them."""
    every = pa.chunked_array(ends).unique()
    every = every.take(pc.sort_indices(every))
    return every, [pc.index_in(x, value_set=every).to_numpy(zero_copy_only=False) for x in ends]


def joined(columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """Columns of batches as one array without nulls; empty without batches."""
    found = pa.chunked_array(columns, kind).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def adjacency(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of n nodes by source: those of x lie in the second array from first[x] to first[x + 1]."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def closure_in_one_task(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """closure() without keys, level by level over arrays."""
    seed = seed.where("id IS NOT NULL")
    rows = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").unionAll(seed.select("id", F.lit(None).cast(edges.schema["b"].dataType)))
    schema = seed.select("id", F.lit(0).alias("level")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(0), b.column(1)) for b in batches]
        if not found:
            return
        a, b = (joined([x[k] for x in found], found[0][0].type) for k in (0, 1))
        start, edge = pc.is_null(b), pc.is_valid(b)
        names, (s, a, b) = numbered([a.filter(start), a.filter(edge), b.filter(edge)])
        first, to = adjacency(len(names), a, b)
        level = np.full(len(names), -1, np.int32)
        newest, n = s, 0
        while len(newest):
            level[newest] = n
            lo, size = first[newest], first[newest + 1] - first[newest]
            met = to[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            newest, n = np.unique(met[level[met] < 0]), n + 1
        at = np.flatnonzero(level >= 0)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(level[at])], ["id", "level"])

    return rows.coalesce(1).mapInArrow(run, schema)


def reverse_callers(calls: DataFrame, seed: DataFrame) -> DataFrame:
    """Ids that reach the seed over calls (a, b), without the seed."""
    back = closure(calls.select(F.col("b").alias("a"), F.col("a").alias("b")), seed)
    return back.select("id").join(seed.select("id"), "id", "left_anti")


def forward_callees(calls: DataFrame, seed: DataFrame) -> DataFrame:
    """Ids that the seed reaches over calls (a, b), and the seed."""
    return closure(calls, seed).select("id")


def override_targets(sites: DataFrame, targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidate targets of virtual sites: transitive overriders of the static target, per build.

    (callsite_id, target_symbol_id, certainty, confidence, derivation, build_variant) without
    pairs that are there already. Old candidates are left out of targets first. The closure
    starts from the distinct static targets, not from the sites.
    """
    own = targets.where("derivation <> 'indexed_override_candidate'")
    virtual = sites.where("dispatch_kind = 'virtual' AND static_target_symbol_id IS NOT NULL")
    edges = overrides.select("build_variant", F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    seeds = virtual.select("build_variant", F.col("static_target_symbol_id").alias("root")).distinct()
    # pairs (root, id): the root travels along as a key
    pairs = closure_from(edges, seeds)
    met = virtual.select("build_variant", F.col("id").alias("callsite_id"), F.col("static_target_symbol_id").alias("root"))
    found = met.join(pairs, ["build_variant", "root"]).select("callsite_id", F.col("id").alias("target_symbol_id"), "build_variant")
    new = found.join(own.select("callsite_id", "target_symbol_id"), ["callsite_id", "target_symbol_id"], "left_anti")
    return new.select(
        "callsite_id",
        "target_symbol_id",
        F.lit("possible").alias("certainty"),
        F.lit(0.5).alias("confidence"),
        F.lit("indexed_override_candidate").alias("derivation"),
        "build_variant",
    )


def closure_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(build_variant, root, id): what each root reaches over its build's edges, without the root itself."""
    first = seeds.join(edges, (seeds["root"] == edges["a"]) & (seeds["build_variant"] == edges["build_variant"]))
    newest = staged(first.select(seeds["build_variant"], "root", F.col("b").alias("id")).where("id <> root").distinct(), "overrides")
    parts = [newest]
    while True:
        met = newest.withColumnRenamed("id", "a").join(edges, ["build_variant", "a"]).select("build_variant", "root", F.col("b").alias("id")).where("id <> root").distinct()
        known = parts[0]
        for p in parts[1:]:
            known = known.unionAll(p)
        newest = staged(met.join(known, ["build_variant", "root", "id"], "left_anti"), "overrides")
        if newest.isEmpty():
            drop_staged(newest)
            return known
        parts.append(newest)


def call_evidence(sites: DataFrame, targets: DataFrame, symbol: str, incoming: bool, scope=None, limit: int = 100) -> DataFrame:
    """Sites and targets where symbol is called (incoming) or calls: certain first, then by confidence and place."""
    s = scope_filter(sites, scope).select(F.col("id").alias("callsite_id"), "owner_symbol_id", "path", "start_line", "start_column", "build_variant")
    t = targets.select(F.col("id").alias("target_id"), "callsite_id", "target_symbol_id", "certainty", "confidence", "derivation")
    s, t = (s, t.where(F.col("target_symbol_id") == symbol)) if incoming else (s.where(F.col("owner_symbol_id") == symbol), t)
    order = [certain_first(), F.desc("confidence"), "build_variant", "path", "start_line", "start_column", "callsite_id", "target_symbol_id", "target_id"]
    return bounded_page(s.join(t, "callsite_id"), order, limit)


def tarjan(nodes: list, adjacent: dict) -> list[list]:
    """Strongly connected components, callees before callers, members sorted. No recursion."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(nodes):
        if root in index:
            continue
        work = [(root, iter(sorted(adjacent.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for near in rest:
                if near not in index:
                    index[near] = low[near] = len(index)
                    stack.append(near)
                    on.add(near)
                    work.append((near, iter(sorted(adjacent.get(near, ())))))
                    break
                if near in on:
                    low[node] = min(low[node], index[near])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    out.append(sorted(members))
    return out


def strong(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of each node's strongly connected component over edges a -> b, callees before callers. No recursion."""
    first, to = (x.tolist() for x in adjacency(n, a, b))
    index, low, of, at, stack = [-1] * n, [0] * n, [-1] * n, first[:n], []
    met = made = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [root]
        index[root] = low[root] = met
        met += 1
        stack.append(root)
        while work:
            node = work[-1]
            if at[node] < first[node + 1]:
                near = to[at[node]]
                at[node] += 1
                if index[near] < 0:
                    index[near] = low[near] = met
                    met += 1
                    stack.append(near)
                    work.append(near)
                elif of[near] < 0 and index[near] < low[node]:
                    low[node] = index[near]
                continue
            work.pop()
            if work and low[node] < low[work[-1]]:
                low[work[-1]] = low[node]
            if low[node] == index[node]:
                while of[node] < 0:
                    of[stack.pop()] = made
                made += 1
    return np.array(of, np.int64)


def components_and_levels(edges: DataFrame) -> DataFrame:
    """(id, component, size, level) of staged edges (a, b) by one task; level: the longest way down to a component that calls no other."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(0), b.column(1)) for b in batches]
        if not found:
            return
        names, (a, b) = numbered([joined([x[k] for x in found], found[0][0].type) for k in (0, 1)])
        del found
        of = strong(len(names), a, b)
        least = np.full(of.max() + 1, len(names))
        np.minimum.at(least, of, np.arange(len(names)))
        # callees have lower numbers, so that their levels are known
        out, into = of[a], of[b]
        out, into = out[out != into], into[out != into]
        order = np.argsort(out, kind="stable")
        level = [0] * len(least)
        for x, y in zip(out[order].tolist(), into[order].tolist()):
            if level[y] >= level[x]:
                level[x] = level[y] + 1
        size = np.bincount(of)
        for i in range(0, len(names), 1 << 17):  # in batches
            k = of[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [names.slice(i, len(k)), names.take(pa.array(least[k])), pa.array(size[k], pa.int64()), pa.array(np.array(level)[k], pa.int32())], ["id", "component", "size", "level"]
            )

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}, size long, level int")


def strong_components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(id, component): component is the smallest id that each reaches and that reaches it.

    Up to one_task (ONE_TASK) edges are worked out in one task. Of more, nodes that nothing
    calls or that call nothing are trimmed, and the component of the node with the most edges
    is what it reaches both ways; edges that leave what it reaches only one way or not at all
    lie in no component. That goes on until few edges are left, or, once such a component is
    small, colours spread over the edges: the smallest id that reaches a node is its colour, and
    what reaches the root of its colour backwards within the colour is that root's component.
    """
    one_task = ONE_TASK if one_task is None else one_task
    e = staged(edges.select("a", "b").distinct(), "scc")
    left = e.count()
    if left <= one_task:
        return components_and_levels(e).select("id", "component")
    nodes = staged(e.select(F.col("a").alias("id")).union(e.select("b")).distinct(), "scc")
    live, parts, pivots, trims = e, [], True, 0

    def kept(rows: DataFrame) -> None:
        nonlocal live, left
        after = staged(rows, "scc")
        if live is not e:
            drop_staged(live)
        live, left = after, after.count()

    while left > one_task:
        before = left
        kept(live.where("a <> b").join(live.where("a <> b").select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.where("a <> b").select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        trims += 1
        if left <= one_task or left < before and (trims < TRIMS or left < 0.9 * before):
            continue
        if pivots:
            ends = live.groupBy(F.col("a").alias("id")).count().join(live.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("more")), "id")
            pivot = ends.orderBy(F.desc(F.col("count") * F.col("more")), "id").limit(1).select("id")
            pivot = staged(pivot, "scc")
            ahead = closure(live, pivot, one_task=one_task).select("id", F.lit(1).alias("f"))
            back = closure(live.select(F.col("b").alias("a"), F.col("a").alias("b")), pivot, one_task=one_task).select("id", F.lit(2).alias("f"))
            sides = staged(ahead.unionAll(back).groupBy("id").agg(F.sum("f").alias("f")), "scc")
            inside = sides.where("f = 3").select("id")
            found = staged(inside.crossJoin(F.broadcast(inside.agg(F.min("id").alias("component")))), "scc")
            pivots = found.count() * 100 >= left
        else:
            found = staged(coloured(live), "scc")
            sides = found.select("id", F.lit(3).alias("f"))
        parts.append(found)
        side = lambda c: sides.select(F.col("id").alias(c), F.col("f").alias(f"f{c}"))
        split = live.join(side("a"), "a", "left").join(side("b"), "b", "left")
        kept(split.where("fa <=> fb AND coalesce(fa, 0) <> 3").select("a", "b"))
    if left:
        parts.append(staged(components_and_levels(live).select("id", "component"), "scc"))
    if not parts:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(all_of(parts), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def coloured(live: DataFrame) -> DataFrame:
    """(id, component) of one round of colours: the components of those that only have their own colour's nodes behind them."""
    nodes = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    colour = staged(nodes.withColumn("c", F.col("id")), "scc")
    while True:
        pushed = live.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("p"))
        now = staged(colour.join(pushed, "id", "left").select("id", F.least("c", F.coalesce("p", "c")).alias("c")), "scc")
        same = now.join(colour, ["id", "c"], "left_anti").isEmpty()
        drop_staged(colour)
        colour = now
        if same:
            break
    inside = live.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
    back = inside.select(F.col("ca").alias("c"), F.col("b").alias("a"), F.col("a").alias("b"))
    roots = colour.where("id = c").select("c", "id")
    return closure(back, roots, keys=("c",)).select("id", F.col("c").alias("component"))


def call_order(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(id, component, size, level) of all nodes of edges (a, b): their strongly connected component, and how many components lie below it at most."""
    one_task = ONE_TASK if one_task is None else one_task
    e = staged(edges.select("a", "b").distinct(), "order")
    if e.count() <= one_task:
        return staged(components_and_levels(e), "order")
    of = staged(strong_components(e, one_task), "order")
    name = lambda c: of.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    above = staged(e.join(name("a"), "a").join(name("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "order")
    todo, levels, n = staged(of.select("component").distinct(), "order"), [], 0
    while not todo.isEmpty():
        low = staged(todo.join(above.select(F.col("a").alias("component")).distinct(), "component", "left_anti").select("component", F.lit(n).alias("level")), "order")
        levels.append(low)
        rest, under = staged(todo.join(low, "component", "left_anti"), "order"), staged(above.join(low.select(F.col("component").alias("b")), "b", "left_anti").select("a", "b"), "order")
        drop_staged(todo, above)
        todo, above, n = rest, under, n + 1
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    return staged(of.join(sizes, "component").join(all_of(levels), "component").select("id", "component", "size", "level"), "order")


def reachable_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks with `reachable`: over feasible successors from their graph's first block. Others stay, flagged."""
    entry = blocks.where("block_index = 0").select("graph_id", "id")
    feasible = edges.where("feasible").select("graph_id", F.col("source_block_id").alias("a"), F.col("target_block_id").alias("b")).distinct()
    met = closure(feasible, entry, keys=("graph_id",)).select("graph_id", "id", F.lit(True).alias("reachable"))
    return blocks.join(met, ["graph_id", "id"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def merged_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges and call evidence as edges, without those that the edges hold already.

    An edge with evidence takes its certainty; certain ones come first in later limits.
    """
    key = ["source_id", "target_id", "relation", "build_variant"]
    calls = evidence.select(
        F.col("owner_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id"), F.lit("calls").alias("relation"), "build_variant",
        F.col("target_id").alias("id"), "certainty",
    )
    best = calls.groupBy(*key).agg(F.min(certain_first()).alias("c"), F.min("id").alias("id"))
    named = edges.select("id", *key).join(best.drop("id"), key, "left")
    new = best.join(edges.select(*key), key, "left_anti").select("id", *key, "c")
    return named.unionAll(new.select(*named.columns)).withColumn("certain", F.coalesce(F.col("c") == 0, F.lit(False))).drop("c")


def fan_out(edges: DataFrame, node: str, limit: int) -> DataFrame:
    """A node's edges, certain first, up to limit; `truncated` if one more is hidden."""
    rows = edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    return bounded_page(rows, [F.desc("certain"), "relation", "source_id", "target_id", "build_variant", "id"], limit)


def callers_or_callees(edges: DataFrame, sites: DataFrame, targets: DataFrame, symbol: str, incoming: bool, scope=None, limit: int = 25) -> DataFrame:
    """Call evidence of a symbol; where there is none, its `calls` edges."""
    found = call_evidence(sites, targets, symbol, incoming, scope, limit)
    seen = found.select(F.col("owner_symbol_id").alias("source_id"), F.col("target_symbol_id").alias("target_id"), "build_variant", "certainty")
    if not seen.isEmpty():
        return seen
    end = "target_id" if incoming else "source_id"
    plain = scope_filter(edges, scope).where((F.col("relation") == "calls") & (F.col(end) == symbol))
    return plain.orderBy("source_id", "target_id", "build_variant").limit(limit).select("source_id", "target_id", "build_variant", F.lit(None).cast("string").alias("certainty"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id reachable.

    Up to FEW_LINKS distinct links are joined up in one task. Beyond: alternating large-star and small-star steps (Kiveris et al. 2014) on a table of links,
    each round cut by a staged table, until the table no longer changes. Minima are combined
    map-side; a hub's links meet its minimum in a join that can be split when skewed. Links
    with a null end and loops are ignored.
    """
    e = staged(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def mark(t: DataFrame):
        return t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(e)
    if before[0] <= FEW_LINKS:
        return components_in_one_task(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(least.select("u", F.col("m").alias("v")).unionAll(moved).distinct(), "links")
        drop_staged(e)
        e, now = after, mark(after)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def components_in_one_task(links: DataFrame) -> DataFrame:
    """components() of at most FEW_LINKS links (u, v) by union-find."""
    schema = links.select(F.col("u").alias("id"), F.col("v").alias("component")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        kind = None
        for b in batches:
            kind = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                root[max(x, y)] = min(x, y)
        if root:
            yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in root], kind)], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, schema)
