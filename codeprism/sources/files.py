"""Source text of symbols, read from files below a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 8 << 20


def read_symbols(spark: SparkSession, root: str, symbols: DataFrame) -> DataFrame:
    """symbols (id, path, start_line, end_line) with `text`, or `error` where there is none.

    Paths stay below the root, files are at most MAX_BYTES, bytes that are no UTF-8 are
    replaced, and lines are joined by newlines. Spark reads the files, so they may lie in any
    store; each distinct file is read once.
    """
    root = root.rstrip("/")
    escapes = F.rlike("path", F.lit(r"(^|/)\.\.(/|$)")) | F.startswith("path", F.lit("/"))
    marked = symbols.withColumn("escapes", escapes)
    names = [r["path"] for r in marked.where(~F.col("escapes")).select("path").distinct().collect()]  # a page of symbols
    have = spark._jvm.org.apache.hadoop.fs.Path
    fs = have(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [(n, fs.getFileStatus(have(f"{root}/{n}")).getPath().toString()) for n in names if fs.exists(have(f"{root}/{n}"))]
    if there:
        raw = spark.read.format("binaryFile").load([full for _, full in there]).select(F.col("path").alias("full"), "length", "content")
        text = F.when(F.col("length") <= MAX_BYTES, F.make_valid_utf8(F.col("content").cast("string")))
        named = raw.join(F.broadcast(spark.createDataFrame(there, "path string, full string")), "full")
        joined = marked.join(named.select("path", "length", F.split(text, "\n", -1).alias("lines")), "path", "left")
    else:
        joined = marked.withColumn("length", F.lit(None).cast("long")).withColumn("lines", F.lit(None).cast("array<string>"))
    error = (
        F.when(F.col("escapes"), "the path leaves the root")
        .when(F.col("length").isNull(), "there is no such file")
        .when(F.col("length") > MAX_BYTES, "the file is too large")
        .when(F.col("start_line") > F.size("lines"), "the symbol starts past the end of the file")
    )
    text = F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return joined.withColumn("error", error).select("id", F.when(F.col("error").isNull(), text).alias("text"), "error")
