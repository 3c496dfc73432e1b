"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of at most CAPACITY ids. The histogram of piece
lengths is placed longest first: each length goes to the open packs with the most room, and
only the counts of packing patterns change. Pieces then meet the patterns by their rank
within their length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, give_back, pick, slices, staged, word_table, worker_memo

CAPACITY, END = 4096, 2
#: Pieces that share a rank counter: a share of all, so that no length makes a large group.
GROUPS, LEAST = 65_536, 64
#: Punctuation that the tokenizer splits from a letter before it, and longest word kept in the memo.
TAIL, LONGEST = ".,;:!?*#$%&|", 64
#: Words encoded at once: what the tokenizer holds of a word is many times its ids.
WORDS = 4096
#: Words whose ids a Python worker remembers; the memo is emptied when full.
MEMO = 150_000
#: Bytes of text worked on at once.
SLICE = 2 << 20


class WordIds(dict):
    """Memo from a word (bytes without ASCII white space) to its ids as little-endian bytes.

    The tokenizer never joins characters across white space, so the ids of a text are those of
    its words in order. Between a letter and punctuation after it the tokenizer splits, so ids
    of letters with punctuation behind are those of the letters and of the punctuation. Words
    of letters only are one unit each, whose last id alone bears the end mark: many of them
    are encoded as one string and told apart by it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, words: list[str]) -> list[bytes]:
        some = (words[i : i + WORDS] for i in range(0, len(words), WORDS))
        return [np.array(e.ids, "<u4").tobytes() for x in some for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        return [x for i in range(0, len(words), WORDS) for x in self.encode_some_letters(words[i : i + WORDS])]

    def encode_some_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a letter that the tokenizer's normal form takes apart
            return self.encode(words)
        data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = self.encode([tail])[0]
        return self.tails[tail]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. When full, the memo starts anew with the words met again."""
        if len(self) > MEMO:
            self.older.clear()
            self.older.update(self)
            self.clear()
        out = list(map(self.get, words))
        new = []
        for k, (w, x) in enumerate(zip(words, out)):
            if x is None:
                x = self.older.get(w)
                if x is None:
                    new.append(k)
                else:
                    out[k] = self[w] = x
        if not new:
            return out
        cores: dict[str, int] = {}
        whole, tailed, odd = [], [], []
        for k, s in zip(new, b" ".join([words[k] for k in new]).decode("utf-8", "replace").split(" ")):
            if s.isalpha():
                whole.append((k, cores.setdefault(s, len(cores))))
                continue
            core = s.rstrip(TAIL)
            if core.isalpha():
                tailed.append((k, cores.setdefault(core, len(cores)), s[len(core) :]))
            else:
                odd.append((k, s))
        ids = self.encode_letters(list(cores))
        for k, core in whole:
            out[k] = ids[core]
        for k, core, tail in tailed:
            out[k] = ids[core] + self.tail(tail)
        for (k, _), x in zip(odd, self.encode([s for _, s in odd])):
            out[k] = x
        self.update([(words[k], out[k]) for k in new if len(words[k]) <= LONGEST])
        return out


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last in slices(b.column("text"), SLICE):
                memo = worker_memo(f"ids:{path}", lambda: WordIds(path))
                texts = b.column("text").slice(first, last - first).fill_null("")
                # the tokenizer takes its special tokens before it lower-cases
                offsets, places, words = word_table(texts, pc.invert(pc.match_substring(texts, "<|")))
                of_word = memo.ids(words)
                flat, sizes = np.frombuffer(b"".join(of_word), "<u4"), np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
                starts = np.cumsum(sizes) - sizes
                n = sizes[places]
                until = np.concatenate([[0], np.cumsum(n)])
                small = np.int32 if max(len(flat), until[-1]) < 2**31 else np.int64
                at = np.repeat((starts[places] - until[:-1]).astype(small), n)
                at += np.arange(until[-1], dtype=small)
                ids = flat[at].tobytes()
                rows: list[tuple[int, int, int, int, int]] = []
                for i, (a, e) in enumerate(zip(until[offsets], until[offsets[1:]])):
                    text = ids[4 * a : 4 * e] + end
                    total = len(text) // 4
                    for start in range(0, total, capacity):
                        part = text[4 * start : 4 * (start + capacity)]
                        rows.append((first + i, start, len(part) // 4, zlib.crc32(part), total))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
            give_back()

    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def place(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, times), ...]), by shortest-pack-first.

    The longest lengths come first; each piece goes to the pack with the most room left, and
    a new pack is opened only where no pack has room. Work and result follow the number of
    different lengths, not that of pieces.
    """
    open_: dict[int, list[list]] = {}  # room -> [packs, runs]
    rooms: list[int] = []  # heap of -room
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, packs: int, runs: list[tuple[int, int]]) -> None:
        if not room:
            done.append((packs, runs))
            return
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append([packs, runs])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                times = min(left, capacity // length)
                packs, rest = divmod(left, times)
                put(capacity - times * length, packs, [(length, times)])
                if rest:
                    put(capacity - rest * length, 1, [(length, rest)])
                break
            group = open_[room]
            packs, runs = group.pop()
            if not group:
                del open_[room]
                heapq.heappop(rooms)
            used = min(packs, left)
            if used < packs:
                put(room, packs - used, runs)
            left -= used
            again = runs[-1][0] == length
            put(room - length, used, runs[:-1] + [(length, runs[-1][1] + 1)] if again else runs + [(length, 1)])
    return done + [(packs, runs) for group in open_.values() for packs, runs in group]


class Places:
    """Where the piece of a length and rank goes: runs of ranks, sorted by length and first rank."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        next_rank: dict[int, int] = {}
        table, first = [], 0
        for packs, runs in patterns:
            offset = 0
            for length, times in runs:
                rank = next_rank.get(length, 0)
                table.append((length, rank, first, offset, times))
                next_rank[length] = rank + packs * times
                offset += length * times
            first += packs
        t = np.array(sorted(table), np.int64).reshape(-1, 5)
        self.length, self.rank, self.first, self.offset, self.times = t.T
        self.key = (self.length << 48) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        pack, slot = np.divmod(rank - self.rank[at], self.times[at])
        return self.first[at] + pack, self.offset[at] + slot * length


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the end id. Every row is packed on its own, so
    repeated rows and ids are packed as often as they come; null ids are allowed. Ties of
    rank are settled by (doc_id, start, ids_crc32); rows equal in all of these are alike. An
    empty table gives no rows; other columns are ignored. The driver holds the histogram (at
    most capacity lengths) and at most capacity + GROUPS rank offsets.
    """
    made = staged(pieces(pick(docs, doc_id=doc_id, text=text), tokenizer, capacity), "pieces", SMALL_BATCHES)
    spark = made.sparkSession
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(LEAST, sum(histogram.values()) // GROUPS)
    salts = spark.createDataFrame([(x, -(-n // target)) for x, n in histogram.items()], "length long, salts long")
    salted = made.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "salts"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").collect()
    groups = np.array([(r["length"], r["salt"], r["n"]) for r in counts], np.int64).reshape(-1, 3)
    key = (groups[:, 0] << 40) + groups[:, 1]
    before = np.cumsum(groups[:, 2]) - groups[:, 2]
    starts = np.searchsorted(groups[:, 0], groups[:, 0])  # first group of each length
    base = before - before[starts] if len(groups) else before
    places = Places(place(histogram, capacity))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank.cast("long")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "rank")
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, r = (b.column(c).to_numpy() for c in ("length", "salt", "rank"))
            sequence, offset = places.find(length, r + base[np.searchsorted(key, (length << 40) + salt)])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
