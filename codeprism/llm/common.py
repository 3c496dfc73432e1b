"""Shared helpers: column picking, staged tables, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Words that one Python worker remembers the hash of; the memo is emptied when full.
MEMO = 200_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names.

    Other columns, also those that differ only in case or repeat a name, are ignored;
    of a repeated name the first is taken.
    """
    names = df.columns
    at = {alias: names.index(name) for alias, name in columns.items()}
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{i}").alias(alias) for alias, i in at.items()])


def whole(df: DataFrame, **columns: str) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """df with plain column names, its own names, and the wanted columns: for results with all columns of df."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain, names, {alias: F.col(f"_{names.index(name)}") for alias, name in columns.items()}


def work_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codeprism-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_root(spark)}/codeprism-{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Nothing reads the shuffles of a staged write again, so their files go with it.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For rows with large binary columns.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def staged(df: DataFrame, tag: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with settings(spark, CLEANUP | (conf or {})):
        df.select("*").write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate value once and pass it to body (a one-element array and a lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


class WordHash(dict):
    """Memo from a word (bytes) to its 64-bit hash. When full, it starts anew with the words met again."""

    older: dict = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


#: Seconds after which a memo that nothing asked for is given up, so that an idle worker holds no memory.
IDLE = 3.0

_memos: dict = {}
_asked = [0.0]


def worker_memo(key: str, make):
    """The memo of this worker process under a key. It outlives tasks; a memo of another key gives way, and one that is not asked for in IDLE seconds goes."""
    _asked[0] = time.monotonic()
    memo = _memos.get(key)
    if memo is None:
        if not _memos:
            threading.Thread(target=forget_idle, daemon=True).start()
        _memos.clear()
        _memos[key] = memo = make()
    return memo


def forget_idle() -> None:
    """Give up the memo, and what the allocators hold, once it is idle."""
    time.sleep(IDLE)
    while (left := _asked[0] + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    forget_memo()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return what the allocators hold, but nothing uses, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def forget_memo() -> None:
    _memos.clear()


def word_table(texts: pa.Array, lower: pa.Array | bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of Arrow strings as offsets by text, places in a list of distinct words, and that list.

    A-Z are lower-cased (with an array: where it is true), then texts are split at ASCII white
    space. Null texts have no words.
    """
    texts = texts.fill_null("")
    if lower is True:
        texts = pc.ascii_lower(texts)
    elif lower is not False:
        texts = pc.if_else(lower, pc.ascii_lower(texts), texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    places, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # what a split leaves before leading and after trailing white space
        full = places != words.index(b"")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        places = places[full]
    return offsets, places, words


def slices(texts: pa.Array, size: int):
    """(first, last) of runs of texts of about so many bytes, at least one text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + size, "right")))
        yield first, last
        first = last
    pa.default_memory_pool().release_unused()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order without repeats, and the place of each key there.

    Sorts the high bits with positions in the low ones, which is several times faster than an
    argsort. Where two keys differ in the bits left out only, and so may come out of order, the
    argsort is done after all.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    up = np.uint64(64 - max(1, int(keys.max()).bit_length()))
    order = (np.sort(((keys << up) & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    first = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def hashed(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def hashed_texts(texts: pa.Array, memo: WordHash) -> list[np.ndarray]:
    """The word hashes of each text."""
    offsets, places, words = word_table(texts)
    all_ = hashed(words, memo)[places] if len(places) else np.zeros(0, np.uint64)
    return [all_[a:b] for a, b in zip(offsets, offsets[1:])]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
