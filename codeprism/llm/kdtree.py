"""Exact top-k inner products with KD-trees per shard.

A bounded sample of the vectors cuts space into cells by median splits. Every vector goes to
its cell, and a cell of many vectors (also of one very common vector) is dealt to shards by
hash. Each shard becomes one tree: median splits of the widest side, tight bounding boxes,
leaves of up to LEAF vectors. Neighbouring shards make a stripe, which one task searches. A
box bounds the product from above (each component takes the better of its two ends).

For each query one priority queue holds the nodes of all trees of a stripe. The node of the
best bound is opened first, until none reaches the k-th score found so far. Queries search the
stripe of the cell with the best bound first; their k-th score goes with them to those other
stripes that hold a cell whose bound reaches it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, pick, staged

K, SCALE, STEP = 20, 64, 20
LEAF = 512
#: Values of the sample that cuts space, values and number of the cells' boxes, values in a
#: shard and in a stripe (a value is one component of one vector).
SAMPLE, BOXES, CELLS, SHARD, STRIPE = 1 << 21, 1 << 18, 1024, 1 << 18, 1 << 21
#: Queries in a block and in a group, which meets a stripe in one task.
BLOCK, GROUP = 512, 8192
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Integers below this are exact in a double.
EXACT = 2.0**53
FOUND = "query_id long, vec_id long, score long"


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one dimension; what overflows a double counts as the largest one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x * scale))


def small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def halves(x: np.ndarray, order: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """A median split of rows by the widest side; None if they are all equal."""
    part = x[order]
    with np.errstate(over="ignore"):
        width = part.max(0) - part.min(0)
    axis = int(np.argmax(width))
    if not width[axis] > 0:
        return None
    by = np.argpartition(part[:, axis], len(order) // 2)
    return axis, order[by[: len(order) // 2]], order[by[len(order) // 2 :]]


class Cells:
    """Cells of space from a sample of vectors, as axis and cut of each inner node."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.next = [], [], []
        self.count = 0
        self._split(sample, np.arange(len(sample)), cells)
        self.axis, self.cut, self.next = np.array(self.axis, int), np.array(self.cut, float), np.array(self.next, int).reshape(-1, 2)

    def _split(self, x: np.ndarray, order: np.ndarray, cells: int) -> int:
        """The place of a node; that of the i-th leaf is -1 - i."""
        found = halves(x, order) if cells > 1 and len(order) > 1 else None
        if found:
            axis, _, right = found
            cut = x[right, axis].min()
            below = x[order, axis] < cut
            if below.any():
                at = len(self.axis)
                self.axis.append(axis), self.cut.append(cut), self.next.append(None)
                left = self._split(x, order[below], cells // 2)
                self.next[at] = (left, self._split(x, order[~below], cells - cells // 2))
                return at
        self.count += 1
        return -self.count

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int) if len(self.axis) else np.full(len(x), -1)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            at[live] = self.next[node, (x[live, self.axis[node]] >= self.cut[node]).astype(int)]
        return -1 - at


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A tree: rows in the order of its leaves; of each node its box, smallest id, children (or -1) and rows."""
    order, lo, hi, first, child, span = np.arange(len(ids)), [], [], [], [], []

    def node(a: int, b: int) -> int:
        at, rows = len(lo), order[a:b]
        part = x[rows]
        lo.append(part.min(0)), hi.append(part.max(0)), first.append(ids[rows].min()), child.append((-1, -1)), span.append((a, b))
        if b - a > LEAF and (found := halves(x, rows)):
            middle = a + len(found[1])
            order[a:b] = np.concatenate(found[1:])
            left = node(a, middle)
            child[at] = (left, node(middle, b))
        return at

    node(0, len(ids))
    return {"ids": ids[order], "x": small(x[order]), "lo": small(np.array(lo)), "hi": small(np.array(hi)), "first": np.array(first), "child": np.array(child), "span": np.array(span)}


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of queries with what lies in boxes, safe against rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
        size = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
        safe = np.where(size < EXACT, top, top + size * (q.shape[1] * 1e-15))
    return np.nan_to_num(safe, nan=np.inf, posinf=np.inf, neginf=-np.inf)


class Forest:
    """The trees of a stripe. visited counts the vectors that were scored."""

    def __init__(self, trees: list[dict]):
        rows = np.cumsum([0, *(len(t["ids"]) for t in trees)])
        nodes = np.cumsum([0, *(len(t["first"]) for t in trees)])
        self.roots = nodes[:-1].tolist()
        self.ids = np.concatenate([t["ids"] for t in trees])
        self.x, self.lo, self.hi = (np.concatenate([t[k].astype(np.float64) for t in trees]) for k in ("x", "lo", "hi"))
        self.first = np.concatenate([t["first"] for t in trees]).tolist()
        self.child = np.concatenate([np.where(t["child"] < 0, -1, t["child"] + n) for t, n in zip(trees, nodes)]).tolist()
        self.span = np.concatenate([t["span"] + n for t, n in zip(trees, rows)]).tolist()
        self.largest = np.maximum(np.abs(self.lo).max(1), np.abs(self.hi).max(1)).tolist()
        self.visited = 0

    def scores(self, q: np.ndarray, a: int, b: int, least: int, exact: bool) -> list[tuple[int, int]]:
        """(-score, id) of rows a to b whose score is at least that given, kept within a long; exact: doubles hold it."""
        x, ids = self.x[a:b], self.ids[a:b]
        self.visited += b - a
        if exact:
            s = x @ q
            fit = np.flatnonzero(s >= least)
            return list(zip((-s[fit]).astype(np.int64).tolist(), ids[fit].tolist())) if len(fit) else []
        whole = [int(v) for v in q]
        out = [min(max(sum(int(v) * w for v, w in zip(row, whole)), LEAST), MOST) for row in x]
        return [(-s, i) for s, i in zip(out, ids.tolist()) if s >= least]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, least: list[int]) -> Iterator[tuple[int, int, int]]:
        """(query id, vec id, score): the best k of each query that score at least what is given, without vectors of its own id."""
        for own, v, row, kth in zip(ids.tolist(), q, bounds(q, self.lo, self.hi).tolist(), least):
            best: list[tuple[int, int]] = []
            reach = EXACT / max(1.0, float(np.abs(v).max())) / len(v)
            last = (-kth, MOST)  # what a hit must come before or equal
            queue = [(-row[r], self.first[r], r) for r in self.roots]
            heapq.heapify(queue)
            while queue:
                top, first, at = heapq.heappop(queue)
                if top > last[0]:
                    break
                if top == last[0] and first > last[1]:
                    continue
                if self.child[at][0] < 0:
                    hits = self.scores(v, *self.span[at], -last[0], self.largest[at] < reach)
                    best = heapq.nsmallest(k, best + [h for h in hits if h[1] != own]) if hits else best
                    if len(best) == k:
                        last = min(last, best[-1])
                else:
                    for c in self.child[at]:
                        if -row[c] <= last[0]:
                            heapq.heappush(queue, (-row[c], self.first[c], c))
            yield from ((own, i, -s) for s, i in best)


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, step: int = STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best k of each query, ties to smaller ids.

    Queries are the rows whose id (a whole number) is divisible by step; candidates all rows of
    the same dimension and another id. Vectors that are null, empty or hold null or non-finite
    components, and rows with a null id, take no part. A repeated row counts once. Several
    vectors under one id are candidates each; if that id is a query, its ranks are of the
    products with all of them together. Scores are exact; those beyond a long count as its
    nearest end. An empty table gives no rows; other columns are ignored.
    """
    rows = pick(vectors, id=vec_id, v=embedding).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    ready = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & fit).dropDuplicates(["id", "v"])
    base = staged(ready.withColumn("dim", F.size("v")), "knn")
    dims = {r["dim"]: (r["n"], r["queries"]) for r in base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % step == 0).alias("queries")).collect()}
    parts = [p for d, (n, queries) in sorted(dims.items()) if queries for p in one_dimension(base.where(F.col("dim") == d), d, n, queries, k, scale, step)]
    drop_staged(base)
    if not parts:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def plant(rows: DataFrame, dim: int, n: int, scale: int) -> tuple[DataFrame, dict]:
    """The trees (shard, stripe, data), and the plan: boxes of the cells and the stripes of each."""
    cells = max(1, min(CELLS, BOXES // dim, -(-n * dim // SHARD)))
    wanted = max(1, min(SAMPLE // dim, 64 * cells))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(n)) < 2 * wanted) if n > 2 * wanted else rows
    sample = matrix(drawn.select("v").limit(4 * wanted).toArrow().column(0), scale) if cells > 1 else np.zeros((0, dim))
    space = Cells(sample, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = space.of(matrix(b.column("v"), scale))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(at, pa.int32())], ["id", "v", "cell"])

    placed, held = rows.select("id", "v", F.lit(0).alias("cell")), {0: n}
    if space.count > 1:
        placed = staged(rows.select("id", "v").mapInArrow(place, "id long, v array<double>, cell int"), "knn-cells")
        held = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most CELLS rows
    shards = [max(1, -(-held.get(c, 0) * dim // SHARD)) for c in range(space.count)]
    first = np.cumsum([0, *shards])
    of_cell = rows.sparkSession.createDataFrame([(c, int(first[c]), m) for c, m in enumerate(shards)], "cell int, first int, shards int")

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"), scale)
        order = np.lexsort((*x.T[:1], ids))
        tree = build(ids[order], x[order])
        lo, hi = tree["lo"][:1].astype(np.float64), tree["hi"][:1].astype(np.float64)
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "cell": table.column("cell").slice(0, 1).combine_chunks(),
                "lo": pa.array(lo.tolist(), pa.list_(pa.float64())),
                "hi": pa.array(hi.tolist(), pa.list_(pa.float64())),
                "data": pa.array([pickle.dumps(tree)], pa.binary()),
            }
        )

    dealt = placed.join(F.broadcast(of_cell), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id", "v"), "shards").cast("int"))
    per_stripe = max(1, STRIPE // SHARD)
    trees = staged(
        dealt.select("shard", "cell", "id", "v").groupBy("shard").applyInArrow(grow, "shard int, cell int, lo array<double>, hi array<double>, data binary")
        .withColumn("stripe", F.expr(f"shard div {per_stripe}").cast("int")),
        "knn-trees",
    )
    if space.count > 1:
        drop_staged(placed)
    if first[-1] <= per_stripe:  # all queries meet the only stripe
        return trees, {"lo": np.zeros((1, dim)), "hi": np.zeros((1, dim)), "stripes": [(0, 0)]}
    lo, hi = np.full((space.count, dim), np.inf), np.full((space.count, dim), -np.inf)
    sides = trees.select("cell", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("cell", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
    for r in sides.collect():  # at most BOXES rows
        lo[r["cell"], r["pos"]], hi[r["cell"], r["pos"]] = r["lo"], r["hi"]
    full = np.flatnonzero(np.isfinite(lo[:, 0]))
    stripes = [(int(first[c]) // per_stripe, (int(first[c + 1]) - 1) // per_stripe) for c in full]
    return trees, {"lo": lo[full], "hi": hi[full], "stripes": stripes}


def one_dimension(rows: DataFrame, dim: int, n: int, queries: int, k: int, scale: int, step: int) -> list[DataFrame]:
    """Tables (query_id, vec_id, score) that together hold the best k of each query."""
    trees, plan = plant(rows, dim, n, scale)
    count = 1 + max(last for _, last in plan["stripes"])
    # as many groups as keep a task's queries bounded, and all cores busy on few stripes
    groups = max(-(-queries // GROUP), min(-(-queries // BLOCK), -(-rows.sparkSession.sparkContext.defaultParallelism // count)))
    asked = rows.where(F.col("id") % step == 0).select("id", "v", F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(groups)).cast("int").alias("g"))
    trees_of = trees.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("kind"), "shard", "data")

    def stage(questions: DataFrame, home: bool) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first in range(0, b.num_rows, BLOCK):
                    part = b.slice(first, BLOCK)
                    ids, g, least = (part.column(c).to_numpy() for c in ("id", "g", "least"))
                    x = matrix(part.column("v"), scale)
                    top = bounds(x, plan["lo"], plan["hi"])
                    own = [plan["stripes"][c] for c in np.argmax(top, axis=1)]
                    at_home = np.array([a + i % (z - a + 1) for (a, z), i in zip(own, ids.tolist())])
                    wanted: dict[int, np.ndarray] = {}
                    if home:
                        wanted = {s: at_home == s for s in set(at_home.tolist())}
                    else:
                        reach = top >= least[:, None]
                        for c, (a, z) in enumerate(plan["stripes"]):
                            if reach[:, c].any():
                                for s in range(a, z + 1):
                                    wanted[s] = wanted.get(s, False) | reach[:, c] & (at_home != s)
                    cells = [(s, h, rows) for s, mask in wanted.items() for h in set(g[mask].tolist()) if len(rows := np.flatnonzero(mask & (g == h)))]
                    data = [pickle.dumps((ids[r], small(x[r]), least[r].tolist())) for _, _, r in cells]
                    columns = [[s for s, _, _ in cells], [h for _, h, _ in cells], [1] * len(cells), [0] * len(cells)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(data, pa.binary())], ["stripe", "g", "kind", "shard", "data"])

        sent = questions.mapInArrow(send, "stripe int, g int, kind int, shard int, data binary")
        # a stripe's trees pass by before the blocks of queries that meet them
        cells = trees_of.unionAll(sent).repartition(count * groups, "stripe", "g").sortWithinPartitions("stripe", "g", "kind", "shard")
        return staged(cells.mapInArrow(meet, FOUND), "knn-found")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, forest = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                stripe, g, kind = (b.column(c)[i].as_py() for c in range(3))
                if (stripe, g) != cell:
                    cell, held, forest = (stripe, g), [], None
                data = pickle.loads(b.column(4)[i].as_py())
                if kind == 0:
                    held.append(data)
                    continue
                forest = forest or Forest(held)
                ids, q, least = data
                found = list(forest.search(ids, q.astype(np.float64), k, least))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    parts = [stage(asked.withColumn("least", F.lit(LEAST).cast("long")), True)]
    if count > 1:
        kth = parts[0].groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("least"))
        carried = asked.join(kth, F.col("id") == F.col("query_id"), "left").withColumn("least", F.coalesce("least", F.lit(LEAST).cast("long")))
        parts.append(stage(carried.select("id", "v", "g", "least"), False))
    drop_staged(trees)
    return parts
