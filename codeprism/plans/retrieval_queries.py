"""The flagship query: hybrid retrieval over the variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embedding import hash_tokens
from ..views import view
from . import retrieval
from .search_queries import index_of

QUERIES, ORACLE = {}, {}


def engine(spark, sf_dir) -> retrieval.Engine:
    """Edges between symbols of neighbouring documents stand in for a call graph; vectors are the embeddings table."""
    variants = view(spark, sf_dir, "symbol_variants")
    ids = variants.select("symbol_id", "build_variant", F.substring("symbol_id", 5, 9).cast("int").alias("k")).distinct()
    near = ids.select(F.col("symbol_id").alias("source_id"), F.concat(F.lit("sym_"), (F.col("k") * 7 + 3) % 400).alias("target_id"), F.lit("calls").alias("relation"), "build_variant")
    evidence = near.select(F.col("source_id").alias("owner_symbol_id"), F.col("target_id").alias("target_symbol_id"), F.lit("certain").alias("certainty"), F.lit(1.0).alias("confidence"), F.lit("direct").alias("derivation"), "build_variant").where("hash(owner_symbol_id) % 2 = 0")
    embed = lambda text: hash_tokens(text.lower().split(), 64)
    return retrieval.Engine(variants, near, evidence, view(spark, sf_dir, "embeddings"), embed=embed, index=index_of(spark, sf_dir, "symbol_variants"))


def hybrid_retrieval(spark, sf_dir):
    """No SQL form: the expansion depends on the order in which budgets are used up. Tests use small graphs."""
    return retrieval.items_table(spark, retrieval.retrieve(engine(spark, sf_dir), "pour keit with src3 doc23", max_tokens=4000))


QUERIES["hybrid_retrieval"] = hybrid_retrieval
