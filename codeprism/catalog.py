"""All queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import flow_queries, graph_queries, incremental_queries, lookup_queries, retrieval_queries, search_queries, source_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (lookup_queries, search_queries, graph_queries, flow_queries, incremental_queries, retrieval_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_retrieval"](spark, sf_dir)
