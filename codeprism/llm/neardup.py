"""Near-duplicates by b-bit MinHash.

Each document's set of word shingles gets BANDS x ROWS minima. Bands of ROWS minima make
candidate groups; B low bits of each minimum, packed into longs, estimate the similarity of
candidates by bit counts, corrected for chance collisions. What may reach the threshold is
confirmed on the full sets, and confirmed links make the components.

No group emits all its pairs. Documents with equal sets are first collapsed to one. Then each
group's members meet its smallest id only. Where a group still holds several components, the
estimate says which of them may be linked; of those a spanning forest is kept, whose trees are
families of components. In a family the sets of all but the largest component meet the sets
of the whole family, block by block, through an inverted index, so that no pair is a row.

The chance that BANDS bands miss a pair at the threshold is (1 - 0.75^4)^32, 5 in a million;
the estimate's cut lies four standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..operators.graph import components
from .common import SMALL_BATCHES, WordHash, drop_staged, hashed_texts, mix, pick, settings, slices, staged, whole, worker_memo

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, B = 32, 4, 4
HASHES = BANDS * ROWS
LONGS = HASHES * B // 64
CUT = 0.59
#: Shingles hashed at once, members of a block of a large group, documents that share a copy
#: of a hub, shingles in a block of a family.
CHUNK, BLOCK, SHARE, FAMILY = 1 << 16, 2048, 64, 1_000_000
#: Bytes of text split at once.
SLICE = 4 << 20
#: Tasks that a band's members are dealt to, so that a very common band is not one task's.
SALTS = 16
#: Rows up to which the list of documents to confirm is broadcast; beyond, texts are shuffled.
BROADCAST_ROWS = 200_000
SIG = [f"s{i}" for i in range(LONGS)]

_random = np.random.Generator(np.random.PCG64(2011))
A = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
C = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
BAND_SALT = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)
FACTORS = [np.uint64(0x9E3779B97F4A7C15) ** np.uint64(i) for i in range(SHINGLE)]


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of word hashes; fewer than SHINGLE words are one shingle."""
    n = len(w)
    if n == 0:
        return w
    size = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        out = sum(w[i : n - size + 1 + i] * FACTORS[i] for i in range(size))
        return np.unique(mix(out ^ np.uint64(size)))


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for first, last in slices(texts, SLICE):
        yield from map(shingles, hashed_texts(texts.slice(first, last - first), worker_memo("words", WordHash)))


def chunked(texts: pa.Array) -> Iterator[tuple[list[np.ndarray], int]]:
    """Sets of about CHUNK shingles together, with the place of the first."""
    first, sets, size = 0, [], 0
    for x in sets_of(texts):
        if sets and size + len(x) > CHUNK:
            yield sets, first
            first, sets, size = first + len(sets), [], 0
        sets.append(x)
        size += len(x)
    if sets:
        yield sets, first


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits that stand for the set), s0.. and bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Packed low bits and band keys of non-empty sets."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        least, v = np.empty((HASHES, len(sets)), np.uint32), np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, A[i], out=v)
            np.add(v, C[i], out=v)
            np.minimum.reduceat(v, starts, out=least[i])
        low = (least & np.uint32((1 << B) - 1)).astype(np.uint64).T.reshape(len(sets), LONGS, 64 // B)
        packed = np.bitwise_or.reduce(low << (np.arange(64 // B, dtype=np.uint64) * np.uint64(B)), axis=2)
        m = least.astype(np.uint64).reshape(BANDS, ROWS, -1)
        key = np.zeros((BANDS, len(sets)), np.uint64) + BAND_SALT[:, None]
        for r in range(ROWS):
            key = mix(key ^ (m[:, r] + np.uint64(r << 32)))
        return packed.view(np.int64), key.T.copy().view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets, first in chunked(b.column("text")):
                n = np.array(list(map(len, sets)))
                full = np.flatnonzero(n)
                sig, keys = np.zeros((len(sets), LONGS), np.int64), np.zeros((0, BANDS), np.int64)
                h = np.zeros((2, len(sets)), np.uint64)
                with np.errstate(over="ignore"):
                    if len(full):
                        sig[full], keys = block([sets[i] for i in full])
                        for i in full:
                            h[:, i] = mix(sets[i]).sum(), mix(sets[i] * np.uint64(3)).sum()
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(sets)), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in h)]
                    + [pa.array(sig[:, i]) for i in range(LONGS)]
                    + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "h1", "h2", *SIG, "bands"],
                )

    longs = ", ".join(f"{s} long" for s in SIG)
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, {longs}, bands array<long>")


def estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose estimated similarity reaches CUT."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), *[F.col(s).alias(f"a_{s}") for s in SIG])
    right = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), *[F.col(s).alias(f"b_{s}") for s in SIG])

    def differing(x: Column, y: Column) -> Column:
        """Fields of B bits that differ: fold each field onto its lowest bit and count."""
        d = x.bitwiseXOR(y)
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    same = F.lit(HASHES) - sum(differing(F.col(f"a_{s}"), F.col(f"b_{s}")) for s in SIG)
    chance = 2.0**-B
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    joined = pairs.join(right, "b").join(left, "a")
    return joined.where(sizes & ((same / HASHES - chance) / (1 - chance) >= CUT)).select("a", "b")


def with_sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """wanted (doc_id, group, part, kind) with `data`, the set of the document's text."""
    texts = docs.join(F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a document that is wanted several times comes in neighbouring rows: work its set out once
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            firsts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1] or texts[k] != texts[k - 1]]
            made = [x.tobytes() for x in sets_of(texts.take(pa.array(firsts, pa.int64())))]
            out = [made[k] for k in np.searchsorted(firsts, np.arange(len(ids)), "right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group", "part", "kind", "doc_id", "label")), pa.array(out, pa.binary())], SETS)

    made = texts.select("doc_id", "text", "group", "part", "kind", "label")
    made = made.mapInArrow(sets, "group long, part long, kind int, doc_id long, label long, data binary")
    parts = max(8, rows // 20_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return made.repartition(parts, "group", "part").sortWithinPartitions("group", "part", "kind")


SETS = ["group", "part", "kind", "doc_id", "label", "data"]
PAIR = "a long, b long"


def pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the threshold.

    A hub's set is sent once for every SHARE of its pairs, each other set once per pair; the
    sets of a share pass by one at a time.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = pairs.join(degree, "a").select(F.col("a").alias("group"), "b", F.pmod(F.xxhash64("b"), "shares").alias("part"), F.lit(0).cast("long").alias("label"))
    members = dealt.select(F.col("b").alias("doc_id"), "group", "part", F.lit(1).alias("kind"), "label")
    wanted = staged(members.unionAll(dealt.select(F.col("group").alias("doc_id"), "group", "part", F.lit(0).alias("kind"), "label").distinct()), "wanted")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for b in batches:
            found: list[tuple[int, int]] = []
            for a, kind, other, data in zip(*(b.column(c).to_pylist() for c in ("group", "kind", "doc_id")), b.column("data")):
                x = np.frombuffer(data.as_buffer(), np.uint64)
                if kind == 0:
                    hub, held = a, x.copy()
                elif a == hub and len(x) and len(held):
                    at = np.searchsorted(held, x)
                    both = int((held[np.minimum(at, len(held) - 1)] == x).sum())
                    if 100 * both >= PERCENT * (len(x) + len(held) - both):
                        found.append((a, other))
            yield pairs_batch(found)

    return with_sets(docs, wanted, wanted.count()).mapInArrow(compare, PAIR)


def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `label`, the component of doc_id so far."""
    return rows.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")


def forest(groups: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of labels: a spanning forest of those that the estimate does not keep apart.

    Looks at groups that hold several components, without their hubs, which all members met
    already. Groups are cut into blocks of about BLOCK members by hash; every two blocks meet.
    """
    rows = named(groups.where("members > 2 AND doc_id <> hub").select("key", "members", "doc_id"), labels)
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(mixed, "key").join(reps.select("doc_id", "n_shingles", *SIG), "doc_id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "n_shingles", *SIG)
    # i and j name a cell of the group; its rows pass by together
    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(cell: list[tuple]) -> list[tuple[int, int]]:
        own, label, n = (np.array([r[k] for r in cell], np.int64) for k in range(3))
        sig = np.array([r[3:] for r in cell], np.int64).view(np.uint64)
        i, j = own.min(), own.max()
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for x in range(len(cell)):
            others = np.arange(x + 1, len(cell)) if i == j else np.flatnonzero(own == j) if own[x] == i else np.zeros(0, int)
            others = others[label[others] != label[x]]
            others = others[np.minimum(n[others], n[x]) * 100 >= np.maximum(n[others], n[x]) * PERCENT]
            d = sig[others] ^ sig[x]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            same = HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1)
            near = others[(same / HASHES - 2.0**-B) / (1 - 2.0**-B) >= CUT]
            for y in np.unique(label[near]).tolist():
                a, b = find(int(label[x])), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(label[x]), y))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:3] != at:
                    if cell:
                        yield pairs_batch(pairs_of(cell))
                    at, cell = r[:3], []
                cell.append(r[3:])
        if cell:
            yield pairs_batch(pairs_of(cell))

    return cells.mapInArrow(run, PAIR).distinct()


def families(trees: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between the components of a family, at least one for any two that are linked.

    A family's documents are dealt to blocks of about FAMILY shingles by hash; those outside
    its largest component also visit all other blocks, where they are held against the
    inverted index of the block.
    """
    family = components(trees).select(F.col("id").alias("label"), F.col("component").alias("group"))
    rows = staged(named(reps.select("doc_id", "n_shingles"), labels).join(family, "label"), "families")
    per_label = rows.groupBy("group", "label").agg(F.sum("n_shingles").alias("n"))
    largest = per_label.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil(F.sum("n") / FAMILY).alias("parts"))
    rows = rows.join(largest, "group").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    small = rows.where("label <> main")
    visits = small.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("to <> part").withColumn("part", F.col("to"))
    kinds = ((rows.where("label = main"), 0), (small, 1), (visits, 2))  # indexed; indexed and held against; held against
    wanted = None
    for some, kind in kinds:
        some = some.select("doc_id", "group", "part", F.lit(kind).alias("kind"), "label")
        wanted = some if wanted is None else wanted.unionAll(some)
    wanted = staged(wanted, "wanted")

    def links(index: list[tuple], probes: list[tuple]) -> list[tuple[int, int]]:
        data = np.concatenate([x for _, _, x in index])
        sizes = np.array([len(x) for _, _, x in index])
        owner = np.repeat(np.arange(len(index)), sizes)
        order = np.argsort(data, kind="stable")
        data, owner = data[order], owner[order]
        label = np.array([k for _, k, _ in index])
        found = []
        for i, own, x in probes:
            lo, hi = np.searchsorted(data, x, "left"), np.searchsorted(data, x, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(index))
            linked = np.flatnonzero((100 * both >= PERCENT * (sizes + len(x) - both)) & (label != own))
            _, first = np.unique(label[linked], return_index=True)
            found += [(index[k][0], i) for k in linked[first]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, probes = None, [], []
        for b in batches:
            for group, part, kind, i, label, data in zip(*(b.column(c).to_pylist() for c in SETS[:5]), b.column("data")):
                if (group, part) != at:
                    if index and probes:
                        yield pairs_batch(links(index, probes))
                    at, index, probes = (group, part), [], []
                row = (i, label, np.frombuffer(data.as_buffer(), np.uint64).copy())
                if kind < 2:
                    index.append(row)
                if kind > 0:
                    probes.append(row)
                if len(probes) >= BLOCK and kind == 2:  # all of the index has passed by
                    if index:
                        yield pairs_batch(links(index, probes))
                    probes = []
        if index and probes:
            yield pairs_batch(links(index, probes))

    return with_sets(docs, wanted, wanted.count()).mapInArrow(run, PAIR)


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after more links (a, b)."""

    def of(side: str) -> DataFrame:
        return labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))

    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between)
    old = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    old = old.select("id", F.coalesce("to", "component").alias("component"))
    return staged(old.unionAll(joined).distinct(), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Null, empty and blank texts have no shingles and are linked with nothing. Ids are taken
    for unique: rows that repeat an id share its component, and of different texts under one
    id one stands for all. A row with a null id has the component of its equals, null if they
    have no id either, and then is kept. An empty table gives no rows; other columns are
    ignored. Texts are taken whole.
    """
    with settings(docs.sparkSession, SMALL_BATCHES):
        return judged_rows(pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))


def judged_rows(rows: DataFrame) -> DataFrame:
    """near_duplicates() of rows (doc_id, text); what runs Python is done when it returns."""
    sigs = staged(signatures(rows), "signatures")
    classes = sigs.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = staged(
        sigs.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")),
        "members",
    )
    chosen = members.where("doc_id = rep AND n_shingles > 0").select("doc_id").distinct()
    # of several texts under one id that with the least hash stands for all, on every run
    own = [c for c in sigs.columns if c != "doc_id"]
    one = sigs.join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*own), F.struct("h1", "h2")).alias("s"))
    reps = staged(one.select("doc_id", "s.*"), "reps")
    drop_staged(sigs)
    keys = reps.select("doc_id", F.explode("bands").alias("key")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # counted by part of a band first; the few bands that several documents share go to all parts
    counted = keys.groupBy("key", "salt").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members"))
    hubs = counted.groupBy("key").agg(F.min("hub").alias("hub"), F.sum("members").alias("members"), F.collect_list("salt").alias("salts")).where("members > 1")
    salted = hubs.select("key", "hub", "members", F.explode("salts").alias("salt"))
    groups = staged(keys.join(salted, ["key", "salt"]).select("key", "doc_id", "hub", "members"), "groups")
    star = groups.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = staged(estimate(star, reps), "likely")
    labels = staged(components(confirm(likely, rows)), "labels")
    trees = staged(forest(groups, labels, reps), "trees")
    if not trees.isEmpty():
        labels = merge(labels, families(trees, labels, reps, rows))
    drop_staged(groups, reps)
    judged = members.join(labels, F.col("rep") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return judged.select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns.

    Rows that repeat an id count as one document: of each id the row with the least hash of
    its columns stays. Rows with a null id stay.
    """
    judged = staged(near_duplicates(docs, doc_id, text).select("doc_id", "kept"), "kept")
    gone = judged.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")).distinct()
    plain, names, c = whole(docs, doc_id=doc_id)
    if not judged.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        key = f"_{names.index(doc_id)}"
        fields = [f for f in plain.columns if f != key]
        first = F.min_by(F.struct(*fields), F.xxhash64(*[f for f in fields if not isinstance(plain.schema[f].dataType, MapType)])).alias("s")
        repeated = plain.where(c["doc_id"].isNotNull()).groupBy(key).agg(first).select(key, "s.*").select(*plain.columns)
        plain = repeated.unionAll(plain.where(c["doc_id"].isNull()))
    few = gone.count() <= BROADCAST_ROWS
    return plain.join(F.broadcast(gone) if few else gone, c["doc_id"] == F.col("gone"), "left_anti").toDF(*names)
