"""Reciprocal-rank fusion, reranking and packing by characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER

RRF = 60
WEIGHTS = {"lexical": 1.0, "symbol": 1.15, "vector": 0.9}
OVERLAP, EXACT, HUB = 0.35, 0.2, 12


def fuse(ranked: DataFrame) -> DataFrame:
    """key, score and the first backend and rank, from (backend, rank, key).

    A key that a backend returns twice counts with its first rank there; the later one still
    takes up a rank. Ties are ordered by first backend (lexical, symbol, vector), then rank.
    """
    first = ranked.groupBy("backend", "key").agg(F.min("rank").alias("rank"))
    weight = F.coalesce(*[F.when(F.col("backend") == b, w) for b, w in WEIGHTS.items()])
    order = F.coalesce(*[F.when(F.col("backend") == b, i) for i, b in enumerate(WEIGHTS)])
    place = F.struct(order.alias("backend_order"), "rank")
    out = first.groupBy("key").agg(F.sum(weight / (RRF + F.col("rank"))).alias("score"), F.min(place).alias("p"))
    return out.select("key", "score", F.col("p.backend_order").alias("first_backend"), F.col("p.rank").alias("first_rank"))


def rerank(candidates: DataFrame, query: str) -> DataFrame:
    """candidates (key, score, qualified_name, signature, documentation, degree) with `reranked`.

    Shared identifiers and a name within the query raise the score; hubs lower it.
    """
    lowered = F.lit(query.casefold())
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(IDENTIFIER), F.lit(0)))
    own = F.regexp_extract_all(F.lower(F.concat_ws(" ", "qualified_name", "signature", "documentation")), F.lit(IDENTIFIER), F.lit(0))
    overlap = F.size(F.array_intersect(terms, own)) / F.greatest(F.size(terms), F.lit(1))
    exact = F.contains(lowered, F.lower("qualified_name")).cast("double")
    hub = F.when(F.col("degree") > HUB, F.sqrt(F.col("degree") / HUB)).otherwise(1.0)
    return candidates.withColumn("reranked", F.col("score") * (1 + OVERLAP * overlap + EXACT * exact) / hub)


def pack(items: DataFrame, order: list, length: str, budget: int) -> DataFrame:
    """Items that fit a budget of characters in an order, the one that overflows cut, none after it.

    Adds used (characters up to here) and kept_chars. items is a bounded candidate list.
    """
    before = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = items.withColumn("before", F.coalesce(F.sum(length).over(before), F.lit(0)))
    fit = used.where(F.col("before") < budget)
    return fit.withColumn("kept_chars", F.least(F.col(length), budget - F.col("before"))).withColumn("cut", F.col("kept_chars") < F.col(length))
