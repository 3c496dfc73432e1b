"""Tables written to the shared folder to cut lineage in loops."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@contextlib.contextmanager
def plain_unions(spark: SparkSession):
    """No unions that keep the partitioning of their parts: with adaptive execution, which may merge
    the partitions of some parts only, Spark 4.1 fails on them (`Can't zip RDDs`)."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def work_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="codeprism-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_root(spark)}/codeprism-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Manifests:
    """Numbered manifests below a folder, each written once and whole; the highest number counts.

    A reader sees the state before or after a commit and never neither: no manifest is ever
    changed or deleted by a commit. Of two writers that commit the same number one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.read_text = spark._jvm.org.apache.commons.io.IOUtils.toString

    def latest(self) -> tuple[int, dict | None]:
        """The highest number and its content; 0 and None before the first commit."""
        found = self.fs.globStatus(self.path(f"{self.root}/MANIFEST.*"))
        numbers = [int(f.getPath().getName().rpartition(".")[2]) for f in found or ()]
        if not numbers:
            return 0, None
        stream = self.fs.open(self.path(f"{self.root}/MANIFEST.{max(numbers)}"))
        try:
            return max(numbers), json.loads(self.read_text(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> None:
        final, temp = self.path(f"{self.root}/MANIFEST.{number}"), self.path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(temp, final):
            self.fs.delete(temp, False)
            raise RuntimeError(f"another writer committed {final} first")
