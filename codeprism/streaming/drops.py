"""Fact streams that arrive as files in a folder: an extension, not part of the batch contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.facts import ENVELOPE


def facts(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Records of new files as a stream, with the time at which each was read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), F.from_json("value", ENVELOPE).alias("e"), F.current_timestamp().alias("read_at")).select("line", "e.*", "read_at")


def fact_rates(records: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Facts per kind and window; what comes later than `late` is left out and its state is dropped."""
    stamped = records.where("type = 'fact'").withWatermark("read_at", late)
    return stamped.groupBy(F.window("read_at", window), "fact").agg(F.count("*").alias("facts"))
