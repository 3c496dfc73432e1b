"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The flow
sends words from patterns to source quotas; the k-th repetition of a pattern's words costs k
a word, so costs are convex and repetitions come last. Each pattern's flow is then filled
with documents in the order of a seeded hash, whole documents only.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pick, staged, whole

SHARE, CAP, WEIGHTS = 1.5, 2, (5.0, 2.0, 1.0)
#: Levels of 8 bits by which a hash threshold is narrowed down.
LEVELS = 4
#: Documents of a pattern that may fill what is left below the threshold.
ROUNDS = 3
#: Rows up to which the thresholds are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Water-filling: share x all words by weight, no target above cap x its source's size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = dict(zip(order, cycle(weights)))
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        over = [s for s in order if s in open_ and left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in order if s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(patterns: dict[str, tuple[list, int]], quotas: dict, repeats: int = CAP) -> dict[str, dict]:
    """Words from each pattern (members, words) to each of its sources: successive shortest paths.

    Every unit of the k-th repetition costs k. The graph has a node per pattern and source,
    so its size follows the number of patterns, not that of documents.
    """
    arcs: list[list] = []  # to, capacity, cost
    leaving: dict = defaultdict(list)

    def arc(a, b, capacity: int, cost: int) -> None:
        leaving[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        leaving[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    at: dict = {}
    for p, (members, words) in patterns.items():
        for k in range(repeats):
            arc("in", ("p", p), words, k)
        for s in members:
            at[p, s] = len(arcs)
            arc(("p", p), ("s", s), words * repeats, 0)
    for s, quota in quotas.items():
        arc(("s", s), "out", round(quota), 0)
    while True:
        cost, via, queue, waiting = {"in": 0}, {}, deque(["in"]), {"in"}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k in leaving[a]:
                b, capacity, c = arcs[k]
                if capacity > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], via[b] = cost[a] + c, (a, k)
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if "out" not in via:
            break
        path, b = [], "out"
        while b != "in":
            b, k = via[b]
            path.append(k)
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    out: dict[str, dict] = defaultdict(dict)
    for (p, s), k in at.items():
        out[p][s] = arcs[k ^ 1][1]
    return out


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def keyed(doc_id: Column, text: Column, source: Column, many: bool, seed: int) -> list[Column]:
    """Pattern, size and hash of a row; the hash is a number from 0 to 2^32 - 1."""
    members = F.coalesce(F.array_sort(F.array_distinct(source)), F.array().cast("array<string>")) if many else F.array(source)
    return [
        F.to_json(members).alias("pattern"),
        members.alias("members"),
        size_of(text).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 32).alias("h"),
    ]


def solve(base: DataFrame, **shares) -> DataFrame:
    """Per pattern: full repetitions, the hash below which rows are taken once more, a few more such
    hashes, and size and target of its first source. base has pattern, members, size and h."""
    found = base.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).collect()
    patterns = {r["pattern"]: (list(r["members"]), r["size"]) for r in found}
    sizes: dict = defaultdict(int)
    for own, size in patterns.values():
        for s in own:
            sizes[s] += size
    wanted = targets(dict(sizes), **shares)
    flow = min_cost_flow(patterns, wanted)
    full, part = {}, {}
    for p, (_, size) in patterns.items():
        full[p], part[p] = divmod(sum(flow[p].values()), size) if size else (0, 0)
    below, left = narrow(base, {p: n for p, n in part.items() if n})
    extra = top_up(base, below, {p: n for p, n in left.items() if n > 0})
    plan = base.sparkSession.createDataFrame(
        [
            (p, full[p], below.get(p, 0), extra.get(p, []), sizes[own[0]] if own else 0, float(wanted[own[0]]) if own else 0.0)
            for p, (own, _) in patterns.items()
        ],
        "pattern string, full long, below long, extra array<long>, source_size long, target double",
    )
    return F.broadcast(plan) if len(patterns) <= BROADCAST_ROWS else plan


def copies() -> Column:
    more = (F.col("h") < F.col("below")) | F.array_contains("extra", F.col("h"))
    return F.when(F.col("size") > 0, F.col("full") + more.cast("long")).otherwise(F.lit(0))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **shares) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    source is a string or an array of strings (a document of several sources; source_size
    and target are then those of its first source in code point order, nulls last). A null
    source is a source of its own; a document with an empty or null array belongs to none, and
    takes nothing, with a source_size and target of 0; a null text has size 0, and rows of size 0 take nothing.
    Rows that are equal in id and text are taken together. An empty table gives no rows;
    other columns are ignored. taken is size times the number of repetitions, at most CAP.
    The driver holds one figure per source and pattern and up to 256 per pattern and level.
    """
    rows = pick(docs, doc_id=doc_id, text=text, source=source)
    many = rows.schema["source"].dataType.typeName() == "array"
    base = staged(rows.select("doc_id", "source", *keyed(F.col("doc_id"), F.col("text"), F.col("source"), many, seed)), "mix")
    return base.join(solve(base, **shares), "pattern").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies()).alias("taken")
    )


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **shares) -> DataFrame:
    """The rows of docs as often as mix() takes them, with all their columns."""
    plain, names, c = whole(docs, doc_id=doc_id, text=text, source=source)
    many = docs.schema[source].dataType.typeName() == "array"
    keys = keyed(c["doc_id"], c["text"], c["source"], many, seed)
    base = staged(plain.select(*keys), "mix")
    taken = plain.select("*", *keys).join(solve(base, **shares), "pattern").where(copies() > 0)
    again = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), copies())))
    return again.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def narrow(base: DataFrame, wanted: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """Of each pattern the hash threshold whose documents below have just up to the words wanted.

    Level by level, the sums of 256 hash ranges say in which range the threshold lies; each
    level sums map-side, so a pattern with most of the rows costs no task more than others.
    """
    spark = base.sparkSession
    below, left = dict.fromkeys(wanted, 0), dict(wanted)
    if not wanted:
        return below, left
    for level in range(LEVELS):
        shift = 32 - 8 * (level + 1)
        at = spark.createDataFrame([(p, lo) for p, lo in below.items()], "pattern string, lo long")
        if len(below) <= BROADCAST_ROWS:
            at = F.broadcast(at)
        inside = (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + (1 << (shift + 8)))
        sums = (
            base.join(at, "pattern")
            .where(inside)
            .groupBy("pattern", F.shiftright("h", shift).alias("k"))
            .agg(F.sum("size").alias("size"))
            .orderBy("pattern", "k")
            .collect()
        )
        seen: dict[str, int] = defaultdict(int)
        done = set()
        for r in sums:
            p = r["pattern"]
            if p in done:
                continue
            if seen[p] + r["size"] > left[p]:
                below[p] = r["k"] << shift
                done.add(p)
            else:
                seen[p] += r["size"]
                below[p] = (r["k"] + 1) << shift  # all ranges up to here fit
        for p in left:
            left[p] -= seen[p]
    return below, left


def top_up(base: DataFrame, below: dict[str, int], left: dict[str, int]) -> dict[str, list[int]]:
    """Of each pattern the hashes of documents not yet taken that fill what is left.

    Each round takes the largest document that fits; the last takes that of the nearest size, if
    it brings the words closer to what is wanted. Rows of one hash are taken together.
    """
    taken: dict[str, list[int]] = {p: [] for p in left}
    open_ = dict(left)
    for last in [False] * (ROUNDS - 1) + [True]:
        open_ = {p: n for p, n in open_.items() if n > 0}
        if not open_:
            break
        rows = [(p, below[p], n, taken[p]) for p, n in open_.items()]
        at = base.sparkSession.createDataFrame(rows, "pattern string, below long, left long, taken array<long>")
        if len(rows) <= BROADCAST_ROWS:
            at = F.broadcast(at)
        free = base.join(at, "pattern").where((F.col("h") >= F.col("below")) & (F.col("size") < 2 * F.col("left")) & ~F.array_contains("taken", F.col("h")))
        sizes = free.groupBy("pattern", "h").agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        off = F.abs(F.col("size") - F.col("left"))
        fits = off < F.col("left") if last else (F.col("size") <= F.col("left")) & (F.col("size") > 0)
        best = sizes.where(fits).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), F.col("h").alias("h"), F.col("size").alias("size"))).alias("b"))
        found = {r["pattern"]: r["b"] for r in best.collect()}
        for p, b in found.items():
            taken[p].append(b["h"])
            open_[p] -= b["size"]
        open_ = {p: n for p, n in open_.items() if p in found or not last}
    return taken
