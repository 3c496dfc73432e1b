"""Scores of a probabilistic suffix tree over words.

The tree's root is the smoothed unigram distribution. A context of up to `depth` words is a
node if its suffix is one, it was seen `least` times or more in training and its next-word
distribution diverges from that of its suffix: the gain in log-likelihood over the suffix,
which is its count times the Kullback-Leibler divergence, must reach `gain`. A node discounts
each next word seen twice or more by `discount` and gives the rest of its mass to its suffix,
so every distribution sums to one. A word is scored by the longest suffix of what comes before that is a node, which
hands down to its own suffixes through the smoothing.

Texts become chunks of hashed tokens. A chunk sends its distinct n-grams with its own counts
to the owner of each key range, which adds up over chunks and answers in the order asked. So
a frequent word costs one row per chunk, no task holds the model, and what is gathered grows
with the corpus. Divergence and the number of distinct next words are sums over occurrences
(a next word seen c times adds c times 1/c), so they are gathered alike.

Words are told apart by 64-bit hashes. n-grams and contexts go by fewer bits, which grow with
the corpus: enough that one in SPARE of them shares its key with another.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, WordHash, distinct, drop_staged, forget_memo, hashed_texts, mix, pick, slices, staged, worker_memo

FOLDS, HELD_OUT = 5, 1
SPARE = 1 << 20
#: Tokens in a chunk, keys in a range, bytes of text split at once.
CHUNK, RANGE, SLICE = 1_000_000, 3_000_000, 4 << 20
#: The end of a text, which no word can equal, as it holds white space.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
ODD, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Tree:
    """What makes a context a node, and the bits of keys."""

    depth: int = 5
    least: int = 16
    discount: float = 0.75
    gain: float = 4.0
    bits: int = 64

    def rounds(self) -> list[tuple[int, ...]]:
        """Phases of questions, by round: counts of words; counts of n-grams of depth 1; sums over the
        contexts of depth 1 and counts of n-grams of depth 2; and so on. Odd phases sum, even ones count."""
        return [(0,), (2,)] + [(2 * d - 1, 2 * d + 2) for d in range(1, self.depth)] + [(2 * self.depth - 1,)]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of whole texts: chunk, vocab (word hashes, frequent ones first), codes (a word's place there), ids, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, parts, size = 0, [], [], 0

        def out() -> pa.RecordBatch:
            vocab, codes = np.unique(np.concatenate(parts), return_inverse=True)  # truly without repeats
            by_count = np.argsort(-np.bincount(codes), kind="stable")  # small codes for frequent words compress better
            rank = np.empty(len(vocab), np.uint32)
            rank[by_count] = np.arange(len(vocab), dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{seq}"]),
                    pa.array([vocab[by_count].tobytes()], pa.binary()),
                    pa.array([planes(rank[codes])], pa.binary()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    pa.array([len(vocab)], pa.int64()),
                    pa.array([len(codes)], pa.int64()),
                ],
                ["chunk", "vocab", "codes", "ids", "sizes", "words", "tokens"],
            )

        for b in batches:
            of_batch = b.column("doc_id").to_pylist()
            for first, last in slices(b.column("text"), SLICE):
                for i, words in zip(of_batch[first:last], hashed_texts(b.column("text").slice(first, last - first), worker_memo("words", WordHash))):
                    part = np.append(words, END)
                    if parts and size + len(part) > CHUNK:
                        yield out()
                        seq, ids, parts, size = seq + 1, [], [], 0
                    ids.append(i)
                    parts.append(part)
                    size += len(part)
        if parts:
            yield out()

    return docs.mapInArrow(run, "chunk string, vocab binary, codes binary, ids array<long>, sizes array<long>, words long, tokens long")


def score(chunk: dict, corpus: tuple[int, int], tree: Tree) -> Generator:
    """Yields {phase: (keys, values)} and gets {phase: an answer per key}; returns the scores.

    Keys are in order. corpus has the training tokens and distinct words, known once the first
    question is answered.
    """
    vocab = np.frombuffer(chunk["vocab"], np.uint64)
    order = np.argsort(vocab)
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    vocab, codes = vocab[order], rank[from_planes(chunk["codes"], np.uint32)]
    sizes = np.array(chunk["sizes"])
    held = np.array([held_out(i) for i in chunk["ids"]], bool)
    train = np.repeat(~held, sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)  # of a token in its text
    end = np.searchsorted(vocab, END)
    spare = np.uint64(64 - tree.bits)

    counts = (yield {0: (vocab, np.bincount(codes[train], minlength=len(vocab)).astype(np.uint32)[:, None])})[0][:, 0]
    tokens, words = corpus
    seen = counts[codes].astype(np.float64)
    unigram = np.log((counts + 0.5) / (tokens + 0.5 * (words + 1)))
    p = np.exp(unigram)[codes]
    word = vocab[codes]

    def grams(depth: int, context: np.ndarray, count: np.ndarray):
        """Contexts of one more word to the left, how often they were seen, and who asks for what."""
        # the text's end stands before its start
        before = np.full(len(codes), END)
        before[depth:] = word[:-depth]
        before[place == depth - 1] = END
        with np.errstate(over="ignore"):
            context = mix(context * ODD ^ (before + np.uint64(depth)))
        # a context of this depth is the n-gram that the token before ended
        n = np.zeros(len(codes))
        n[1:] = count[:-1]
        n[place < depth - 1] = 0
        if depth == 1:
            n[place == 0] = counts[end]
        able = np.flatnonzero((n >= tree.least) & (count >= 2))
        with np.errstate(over="ignore"):
            keys, at = distinct(mix(context[able] * TURN ^ word[able]) >> spare)
        return context, n, able, at, (keys, np.bincount(at, weights=train[able], minlength=len(keys)).astype(np.uint32)[:, None])

    context, n, able, at, question = grams(1, np.zeros(len(codes), np.uint64), seen)
    answer = yield {2: question}
    inner = np.ones(len(codes), bool)  # whether the suffix of a position's context is a node
    for depth in range(1, tree.depth + 1):
        count = np.zeros(len(codes))
        count[able] = answer[2 * depth][at, 0]
        # how often each context was seen, and sums over its occurrences in training
        asked = np.flatnonzero((n >= tree.least) & inner)
        keys, whose = distinct(context[asked] >> spare)
        total = np.zeros(len(keys))
        total[whose] = n[asked]
        use = (count[asked] > 0) & train[asked]
        where, by = asked[use], whose[use]
        gains = np.log((count[where] - tree.discount) / n[where] / p[where])
        sums = [np.bincount(by, weights=x, minlength=len(keys)) for x in (None, 1 / count[where], gains)]
        question = {2 * depth - 1: (keys, np.stack([total, *sums], axis=1).astype(np.float32))}
        if depth < tree.depth:
            deeper = grams(depth + 1, context, count)
            question[2 * depth + 2] = deeper[-1]
        answer = yield question
        rest = answer[2 * depth - 1][:, 0].astype(np.float64)
        node = rest < 1
        p[asked] *= rest[whose]
        hit = (count[asked] > 0) & node[whose]
        p[asked[hit]] += (count[asked[hit]] - tree.discount) / n[asked[hit]]
        inner = np.zeros(len(codes), bool)
        inner[asked] = node[whose]
        if depth < tree.depth:
            context, n, able, at, _ = deeper

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts)

    return chunk["ids"], held, sizes, per_text((seen > 0).astype(np.int64)), per_text((unigram / np.log(10))[codes]), per_text(np.log10(p))


def kind_of(phase: int):
    return np.float32 if phase % 2 else np.uint32


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, compressed: the high bytes of keys in order shrink well."""
    data = np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def from_planes(data: bytes, kind) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(data[:8], "little")
    plain = pa.Codec("zstd").decompress(data[8:], n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def key_planes(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return planes(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def from_key_planes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


COUNTS = (np.uint8, np.uint16, np.uint32, np.uint64)


def node_rest(tree: Tree, total: np.ndarray, covered: np.ndarray, types: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The mass that a context hands to its suffix; 1 where its distribution does not diverge enough to be a node."""
    rest = np.maximum(1 - (covered - tree.discount * types) / np.maximum(total, 1), 1e-12)
    return np.where((covered > 0) & (gain + (total - covered) * np.log(rest) >= tree.gain), rest, 1.0)[:, None]


def packed(phase: int, sums: np.ndarray) -> bytes:
    """Sums as bytes; counts in as few as the largest needs, which the first byte tells."""
    if phase % 2:
        return b"f" + planes(sums.astype(np.float32))
    k = next(k for k, t in enumerate(COUNTS) if sums.max(initial=0) <= np.iinfo(t).max)
    return bytes([k]) + planes(sums.astype(COUNTS[k]))


def unpacked(data: bytes) -> np.ndarray:
    return from_planes(data[1:], np.float32 if data[:1] == b"f" else COUNTS[data[0]])


def replay(chunk: dict, corpus: tuple[int, int], tree: Tree, done: int):
    """The questions of a chunk after `done` answered rounds, or its scores after all."""
    steps = score(chunk, corpus, tree)
    question = next(steps)
    try:
        for phases in tree.rounds()[:done]:
            got = {}
            for p in phases:
                parts = [unpacked(a[2]) for a in sorted(chunk["answers"]) if a[0] == p]
                flat = np.concatenate(parts) if parts else np.zeros(0, kind_of(p))
                got[p] = flat.reshape(len(question[p][0]), 1)
            question = steps.send(got)
    except StopIteration as end:
        return end.value
    return question


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        r = {n: b.column(n)[i].as_py() for n in ("chunk", "vocab", "codes", "ids", "sizes", "answers")}
        r["answers"] = [(a["phase"], a["part"], a["data"]) for a in r["answers"] or ()]
        yield r


def ask(state: DataFrame, done: int, parts: int, corpus: tuple[int, int], tree: Tree) -> DataFrame:
    """The answers of one round: chunk, phase, part, data, total, words."""
    space = tree.bits if done else 64
    bounds = np.array([(k << space) // parts for k in range(1, parts)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_memo()  # this worker may have made chunks
        for b in batches:
            for r in rows_of(b):
                for phase, (keys, values) in replay(r, corpus, tree, done).items():
                    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                    rows = [(k, a, e) for k, (a, e) in enumerate(zip(cuts, cuts[1:])) if e > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([phase] * len(rows), pa.int32()),
                            pa.array([x[0] for x in rows], pa.int32()),
                            pa.array([r["chunk"]] * len(rows), pa.string()),
                            pa.array([key_planes(keys[a:e]) for _, a, e in rows], pa.binary()),
                            pa.array([planes(values[a:e]) for _, a, e in rows], pa.binary()),
                        ],
                        ["phase", "part", "chunk", "keys", "values"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answer() -> pa.RecordBatch:
            phase, part = at
            own, place = distinct(np.concatenate([k for _, k, _ in held]))
            values = np.concatenate([v for _, _, v in held])
            sums = np.stack([np.bincount(place, weights=values[:, c], minlength=len(own)) for c in range(values.shape[1])], axis=1)
            words = int((sums[:, 0] > 0).sum()) if phase == 0 else 0
            stats = [(int(sums[:, 0].sum()) if phase == 0 else 0, words)] + [(0, 0)] * (len(held) - 1)
            if phase % 2:
                total = np.zeros(len(own))
                total[place] = values[:, 0]  # all chunks know the same
                sums = node_rest(tree, total, *sums[:, 1:].T)
            elif phase:
                sums[sums < 2] = 0  # n-grams seen once are not stored
            out, a = [], 0
            for _, k, _ in held:
                out.append(packed(phase, sums[place[a : a + len(k)]]))
                a += len(k)
            columns = ([c for c, _, _ in held], [phase] * len(held), [part] * len(held), out, *zip(*stats))
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["chunk", "phase", "part", "data", "total", "words"])

        for b in batches:
            for i in range(b.num_rows):
                phase, part, chunk, keys, values = (b.column(k)[i].as_py() for k in range(5))
                if (phase, part) != at:
                    if held:
                        yield answer()
                    at, held = (phase, part), []
                keys = from_key_planes(keys)
                held.append((chunk, keys, from_planes(values, kind_of(phase)).reshape(len(keys), -1)))
        if held:
            yield answer()

    sent = state.mapInArrow(send, "phase int, part int, chunk string, keys binary, values binary")
    return (
        sent.repartition(parts * len(tree.rounds()[done]), "phase", "part")
        .sortWithinPartitions("phase", "part", "chunk")
        .mapInArrow(add, "chunk string, phase int, part int, data binary, total long, words long")
    )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per input row.

    A null or empty text is its end token alone. Texts whose id as text has a CRC-32 of
    HELD_OUT modulo FOLDS are scored but not learnt from; a null id counts as the empty text
    there. Repeated rows are learnt from and scored as often as they come. Without training
    texts all scores are those of the smoothing alone. An empty table gives no rows; other
    columns are ignored. Ids are whole numbers, as numbers or as text. Texts are taken whole; counts cover all training texts.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = staged(chunks(rows), "chunks", SMALL_BATCHES)
    size = made.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    answers, corpus = [], (0, 0)
    tree = replace(tree, bits=min(64, ((size["tokens"] or 1) * SPARE).bit_length()))

    def state() -> DataFrame:
        if not answers:
            return made.withColumn("answers", F.lit(None).cast("array<struct<phase:int,part:int,data:binary>>"))
        every = functools.reduce(DataFrame.unionAll, answers).select("chunk", F.struct("phase", "part", "data").alias("answer"))
        return made.join(every.groupBy("chunk").agg(F.collect_list("answer").alias("answers")), "chunk", "left")

    for done in range(len(tree.rounds())):
        keys = size["tokens"] if done else size["words"]
        found = staged(ask(state(), done, max(least, (keys or 0) // RANGE), corpus, tree), "answers", SMALL_BATCHES)
        if not done:
            got = found.agg(F.sum("total"), F.sum("words")).first()
            corpus = (got[0] or 0, got[1] or 0)
        answers.append(found)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in rows_of(b):
                ids, held, n, known, base, own = replay(r, corpus, tree, len(tree.rounds()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), corpus[0], np.int64)), pa.array(base), pa.array(own)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = staged(state().mapInArrow(finish, schema), "scores", SMALL_BATCHES)
    drop_staged(made, *answers)
    return out
