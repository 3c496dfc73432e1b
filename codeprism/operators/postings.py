"""A search index: postings by term, kept up to date in segments.

A posting tells for a term and a row its count and positions in each indexed column. Postings
lie in folders by a hash of the term and are sorted by term in their files, so a query reads
the folders of its terms and, in them, the row groups that hold them. A change adds a segment
with the changed rows and a list of ids whose earlier postings no longer count; the manifest
holds the statistics of all live rows, and its commit is the change. compact() makes one
segment of all.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import phrases, tokens
from ..sources.staging import Manifests, new_path

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders by hash of the term, and postings from which a folder's rows are dealt to several tasks.
BUCKETS, TASK_ROWS = 32, 1 << 22
#: Ids up to which the list of what no longer counts is broadcast; beyond, it is joined by shuffle.
BROADCAST_IDS = 100_000
POSTINGS = "term string, id string, build_variant string, d int, n array<int>, at array<array<int>>"
DOCS = "id string, build_variant string, d int"


def postings_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Postings of rows (id, build_variant and the indexed columns); d is the tokens of all columns of a row."""
    split = rows.select("id", "build_variant", *[tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, doc, column, at = [], [], [], []
            for c in range(width):
                lists = b.column(2 + c)
                sizes = np.diff(lists.offsets.to_numpy())
                words.append(lists.flatten())
                doc.append(np.repeat(np.arange(len(lists)), sizes))
                column.append(np.full(sizes.sum(), c))
                at.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
            code, doc, column, at = coded.indices.to_numpy(), *map(np.concatenate, (doc, column, at))
            if not len(code):
                continue
            length = np.bincount(doc, minlength=b.num_rows)
            order = np.lexsort((at, column, code, doc))
            code, doc, column, at = code[order], doc[order], column[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
            group = np.repeat(np.arange(len(first)), np.diff([*first, len(code)]))
            counts = np.bincount(group * width + column, minlength=len(first) * width)
            outer = pa.array(np.arange(len(first) + 1) * width, pa.int32())
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(at, pa.int32()))
            of = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[first])),
                    b.column(0).take(of),
                    b.column(1).take(of),
                    pa.array(length[doc[first]], pa.int32()),
                    pa.ListArray.from_arrays(outer, pa.array(counts, pa.int32())),
                    pa.ListArray.from_arrays(outer, inner),
                ],
                ["term", "id", "build_variant", "d", "n", "at"],
            )

    return split.mapInArrow(run, POSTINGS)


class Index:
    """Postings below a folder. Ids are unique among live rows; rows without a build have an empty one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    @classmethod
    def create(cls, rows: DataFrame, columns: tuple[str, ...], root: str | None = None) -> Index:
        """An index over the named columns of rows; rows need an id, and may have a build_variant."""
        index = cls(rows.sparkSession, root or new_path(rows.sparkSession, "index"))
        index.manifests.commit(1, {"columns": [c for c in columns if c in rows.columns], "segments": [], "gone": [], "rows": 0, "tokens": 0})
        index.apply(rows)
        return index

    def state(self) -> dict:
        number, found = self.manifests.latest()
        if found is None:
            raise ValueError(f"no index at {self.root}")
        return found | {"number": number}

    def apply(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Index changed rows instead of earlier ones of the same id, and drop rows of removed ids."""
        now = self.state()
        segment, rows, count, tokens_ = now["number"], changed, now["rows"], now["tokens"]
        ids = [x.select(F.col("id").cast("string").alias("id")) for x in (changed, removed) if x is not None]
        if now["segments"] and ids:
            gone = self.docs(now).join(functools.reduce(DataFrame.unionAll, ids).distinct(), "id", "left_semi")
            gone.write.parquet(f"{self.root}/gone-{segment}")
            lost = self.spark.read.schema(DOCS).parquet(f"{self.root}/gone-{segment}").agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
            if lost[0]:
                now["gone"].append([segment, lost[0]])
                count, tokens_ = count - lost[0], tokens_ - lost[1]
        if rows is not None:
            if "build_variant" not in rows.columns:
                rows = rows.withColumn("build_variant", F.lit(""))
            rows = rows.select(F.col("id").cast("string").alias("id"), "build_variant", *now["columns"])
            size = functools.reduce(operator.add, [F.size(tokens(F.col(c))) for c in now["columns"]])
            rows.select("id", "build_variant", size.alias("d")).write.parquet(f"{self.root}/docs-{segment}")
            more = self.spark.read.schema(DOCS).parquet(f"{self.root}/docs-{segment}").agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
            self._write(postings_of(rows, now["columns"]), segment, more[1])
            now["segments"].append(segment)
            count, tokens_ = count + more[0], tokens_ + more[1]
        self.manifests.commit(now["number"] + 1, {k: now[k] for k in ("columns", "segments", "gone")} | {"rows": count, "tokens": tokens_})

    def _write(self, rows: DataFrame, segment: int, size: int) -> None:
        """Postings by folder; a folder of many rows, as that of a very common term, is dealt to several tasks."""
        deal = max(1, size // (BUCKETS * TASK_ROWS))
        parts = rows.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")).withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(deal)))
        sorted_ = parts.repartition(F.col("bucket"), F.col("deal")).drop("deal").sortWithinPartitions("bucket", "term")
        sorted_.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/postings-{segment}")

    def compact(self) -> None:
        """One segment of all live rows; the files of earlier ones stay for readers of earlier manifests."""
        now = self.state()
        segment = now["number"]
        self.docs(now).write.parquet(f"{self.root}/docs-{segment}")
        self._write(self.postings(None, now), segment, now["tokens"])
        self.manifests.commit(segment + 1, {"columns": now["columns"], "segments": [segment], "gone": [], "rows": now["rows"], "tokens": now["tokens"]})

    def _live(self, name: str, schema: str, now: dict, keep: Column | None = None) -> DataFrame:
        """Rows of all segments that no later change replaced or removed."""
        out = None
        for segment in now["segments"]:
            path = f"{self.root}/{name}-{segment}"
            rows = self.spark.read.schema(schema).parquet(path)
            rows = rows if keep is None else rows.where(keep)
            later = [g for g in now["gone"] if g[0] > segment]
            if later:
                gone = functools.reduce(DataFrame.unionAll, [self.spark.read.schema(DOCS).parquet(f"{self.root}/gone-{g}").select("id") for g, _ in later])
                rows = rows.join(F.broadcast(gone) if sum(n for _, n in later) <= BROADCAST_IDS else gone, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def docs(self, now: dict | None = None) -> DataFrame:
        """id, build_variant and d, the number of tokens, of all live rows."""
        return self._live("docs", DOCS, now or self.state()).select("id", "build_variant", "d")

    def postings(self, terms: list[str] | None = None, now: dict | None = None) -> DataFrame:
        """Live postings, of all terms or of those given."""
        keep = None
        if terms is not None:
            folders = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
            keep = F.col("bucket").isin(folders) & F.col("term").isin(terms)
        rows = self._live("postings", POSTINGS + ", bucket int", now or self.state(), keep)
        return rows.select("term", "id", "build_variant", "d", "n", "at")

    def scores(self, query: str, weights: dict[str, float], per_column: bool = False) -> DataFrame | None:
        """id, build_variant and BM25 score of the rows that match; None for a query without terms.

        A term of several tokens is a phrase. The length of a row is the token count of all
        indexed columns, and statistics cover all live rows. per_column counts a term in each
        weighted column as a term of its own, as with a column filter.
        """
        terms, now = phrases(query), self.state()
        if not terms:
            return None
        used = [(now["columns"].index(c), w) for c, w in weights.items() if c in now["columns"]]
        rows = self.postings(sorted({t for p in terms for t in p}), now)

        def counted(p: list[str], columns: list[tuple[int, float]]) -> Column:
            """The weighted count of a term in a row's postings, which `found` holds where a term is a phrase."""
            if len(p) == 1:
                own = functools.reduce(operator.add, [F.get("n", F.lit(c)) * w for c, w in columns])
                return F.coalesce(F.sum(F.when(F.col("term") == p[0], own)), F.lit(0.0)).cast("double")

            def at(k: int, c: int) -> Column:
                own = F.filter(F.collect_list(F.struct("term", "at")), lambda x: x["term"] == p[k])
                return F.coalesce(F.get(F.get(own, F.lit(0))["at"], F.lit(c)), F.array().cast("array<int>"))

            def times(c: int) -> Column:
                return F.size(F.filter(at(0, c), lambda i: functools.reduce(operator.and_, [F.array_contains(at(k, c), i + k) for k in range(1, len(p))])))

            return functools.reduce(operator.add, [times(c) * w for c, w in columns]).cast("double")

        tf = [counted(p, [u]) for p in terms for u in used] if per_column else [counted(p, used) for p in terms]
        names = [f"f{i}" for i in range(len(tf))]
        met = rows.groupBy("id", "build_variant", "d").agg(*[x.alias(n) for x, n in zip(tf, names)])
        held = met.agg(*[F.count_if(F.col(n) > 0).alias(f"d{n}") for n in names])
        joined = met.where(functools.reduce(operator.or_, [F.col(n) > 0 for n in names])).crossJoin(F.broadcast(held))  # one row of counts
        mean = now["tokens"] / max(1, now["rows"])

        def part(n: str) -> Column:
            x, df = F.col(n), F.col(f"d{n}")
            idf = F.log((now["rows"] - df + 0.5) / (df + 0.5))
            idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
            return idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("d") / mean))

        return joined.select("id", "build_variant", functools.reduce(operator.add, [part(n) for n in names]).alias("score"))
