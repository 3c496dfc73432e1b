"""Bounded pages: a total order, a limit and an explicit truncated flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LIMIT = 10_000


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}, not {limit}")
    return limit


def certain_first(column: str = "certainty") -> Column:
    return F.when(F.col(column) == "certain", 0).otherwise(1)


def bounded_page(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first limit rows in a total order, with `truncated` on each.

    limit + 1 rows are taken (TakeOrderedAndProject), so the flag needs no count of the rest.
    """
    probe = df.orderBy(*order).limit(checked_limit(limit) + 1)
    every = Window.partitionBy().orderBy(*order)
    numbered = probe.withColumn("_rank", F.row_number().over(every)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("_rank") <= limit).drop("_rank")
