"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id: cut points come from a sample of the ids that is drawn by
payload size, so that shards are about equally large however the ids lie; a shard's files roll
by compressed size. The cut points do not show in the records, only in the file names, and a
sample by hash is the same on every run.
Headers and digests are made anew from the payloads, with a fixed date, so equal tables give
equal bytes. A file is written under a temporary name and renamed when whole; the manifest
table, committed last, lists the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, staged

#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
#: Compressed size at which a file is rolled, and payload size of a shard.
ROLL_BYTES, SHARD_BYTES = 32 << 20, 48 << 20
#: Sampled ids per shard, from which its ends are taken, and most shards; beyond that they get larger.
DRAWN, SHARDS = 64, 1 << 15
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
ID = "<urn:codeprism:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long"


def filesystem(uri: str):
    """File system and path of a uri, for any store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def header_value(text: str) -> str:
    """Percent-encode what may not stand in a header line."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    fields = {"WARC-Type": kind, "WARC-Date": DATE} | fields | {"WARC-Block-Digest": "sha1:" + base32(block), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": ID.format(page_id),
        "WARC-Target-URI": header_value(url or f"urn:codeprism:no-url:{page_id}"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Refers-To": ID.format(refers_to), "WARC-Profile": PROFILE}, http)


class Shard:
    """The files of one shard, each under a temporary name until it is whole."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = filesystem(root)
        self.shard, self.roll, self.seq, self.out = shard, roll, 0, None
        self.done: list[tuple[int, str, int, int]] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{TaskContext.get().taskAttemptId()}"
            self.out, self.bytes, self.records = self.fs.open_output_stream(self.temp), 0, 0
            info = f"software: codeprism\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            fields = {"WARC-Record-ID": f"<urn:codeprism:file:{self.name}>", "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}
            self._write(record("warcinfo", fields, info))
        self._write(data)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.bytes))
            self.out, self.seq = None, self.seq + 1


def cut_points(sizes: DataFrame) -> list[int]:
    """Ids at which all shards but the first begin, from rows (page_id, digest, n); an id of several shards' size repeats.

    Payloads are drawn by a hash of id and digest with a chance in proportion to their size, so
    the driver gets about DRAWN ids per shard.
    """
    total = sizes.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    shards = min(SHARDS, -(-total // SHARD_BYTES))
    if shards < 2:
        return []
    share = F.col("size") * (DRAWN * shards / total)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(7), "page_id", "digest"), 11) / float(1 << 53)
    grouped = sizes.where(F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.sum(F.col("n") + 1).alias("size"))
    drawn = grouped.where(luck < share).select("page_id", F.greatest(share, F.lit(1.0)).alias("weight")).toArrow()
    ids, weight = drawn.column("page_id").to_numpy(), drawn.column("weight").to_numpy()
    if not len(ids):
        return []
    order = np.lexsort((weight, ids))
    ends = np.cumsum(weight[order])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards)
    return ids[order][np.minimum(at, len(ids) - 1)].tolist()


def shards_of(cuts: list[int]) -> tuple[Column, Column]:
    """The first and the last shard of a row's id, by binary search: one shard, but for ids that fill several. Null ids are in the first."""
    if not cuts:
        return F.lit(0), F.lit(0)
    points = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")  # folded into one constant
    powers = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])

    def before(fits) -> Column:
        """How many cut points fit, which those ahead of one that fits do too."""
        step = lambda at, p: F.when(F.coalesce(fits(F.get(points, at + p - 1)), F.lit(False)), at + p).otherwise(at)
        return F.aggregate(powers, F.lit(0), step)

    first, last = before(lambda c: c < F.col("page_id")), before(lambda c: c <= F.col("page_id"))
    # an id that is the end of one shard only begins the next
    return F.when(last - first > 1, first).otherwise(last), last


def write(pages: DataFrame, root: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Write one record per input row below root; returns root and the committed manifest.

    Null payloads are empty, null urls get a placeholder. Of rows with equal payloads of at
    least REVISIT_BYTES that with the largest id is a response (all of them, if several share
    that id), the others are revisits without payload; rows with a null id are responses of
    the first shard. Rows of one id that fill several shards are dealt to them by their
    payload and url. Repeated rows are written as often as they come. An empty table gives an
    empty manifest; other columns are ignored.
    """
    spark = pages.sparkSession
    root = root or new_path(spark, "warc")
    text = F.coalesce("payload", F.lit(""))
    rows = pick(pages, page_id=page_id, url=url, payload=payload).select(
        F.col("page_id").cast("long").alias("page_id"), "url", text.alias("payload"), F.sha1(text).alias("digest"), F.octet_length(text).cast("long").alias("n")
    )
    narrow = staged(rows.select("page_id", "digest", "n"), "warc-digests")
    large = narrow.where(F.col("n") >= REVISIT_BYTES)
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    revisits = large.join(firsts, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    cuts = cut_points(narrow)
    first, last = shards_of(cuts)
    # a revisit's decision goes to the shards of its id beside the pages, and sorts before its page
    none = lambda kind: F.lit(None).cast(kind)
    decided = revisits.select(F.explode(F.sequence(first, last)).alias("shard"), "page_id", none("string").alias("url"), none("string").alias("payload"), none("long").alias("n"), "digest", "refers_to", F.lit(0).alias("kind"))
    dealt = (first + F.pmod(F.xxhash64("digest", "url"), last - first + 1)).cast("int")
    both = decided.unionAll(rows.select(dealt.alias("shard"), "page_id", "url", "payload", "n", "digest", none("long").alias("refers_to"), F.lit(1).alias("kind")))
    placed = (
        both.repartitionById(len(cuts) + 1, F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    )
    _make_dir(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, first = None, [], (None, None, None)
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                shard, page, target, body, size, digest, refers_to, kind = r
                if kind == 0:
                    first = page, digest, refers_to
                    continue
                refers_to = first[2] if first[:2] == (page, digest) else None
                body = body if refers_to is None else None
                if current is None or current.shard != shard:
                    if current is not None:
                        current.close()
                        done += current.done
                    current = Shard(root, shard, roll)
                current.add(page_record(page, target, (body or "").encode("utf-8", "surrogatepass"), size, digest, refers_to))
        if current is not None:
            current.close()
            done += current.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "file", "records", "bytes"])

    made = placed.mapInArrow(run, MANIFEST)
    made.write.parquet(f"{root}/manifest")
    return root, spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _make_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base32(block):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    return fields, block


def read(root: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page record.

    Block digests, and payload digests of responses, are checked against the bytes; record
    counts against the manifest. A mismatch raises an error.
    """
    files = max(1, manifest.count())

    def id_of(urn: str | None) -> int | None:
        value = urn[len(ID) - 3 : -1] if urn else "None"
        return None if value == "None" else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, base = filesystem(root)
                out: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} in {name}")
                        out.append((id_of(fields["WARC-Record-ID"]), size, digest, kind, id_of(fields.get("WARC-Refers-To"))))
                if len(out) != records:
                    raise ValueError(f"{name} holds {len(out)} records; the manifest has {records}")
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("file", "records").repartition(files).mapInArrow(run, schema)
