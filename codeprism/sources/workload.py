"""A deterministic workload of facts: units x builds x functions, in a ring of calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import stable_id


@dataclass(frozen=True)
class Workload:
    units: int = 100
    builds: int = 2
    functions: int = 40

    def __post_init__(self):
        if min(self.units, self.builds, self.functions) < 1:
            raise ValueError("a workload has units, builds and functions")


def generate(spark: SparkSession, spec: Workload) -> dict[str, DataFrame]:
    """symbol_variants, callsites and call_targets; each function calls the next, the last the first of the next unit."""
    n = spec.units * spec.functions
    base = spark.range(n * spec.builds).select(
        (F.col("id") % n).alias("k"), F.concat(F.lit("build"), F.floor(F.col("id") / n)).alias("build_variant")
    )
    unit = lambda k: F.concat(F.lit("unit"), F.floor(k / spec.functions))
    symbol = lambda k: stable_id("symbol", unit(k), k % spec.functions)
    k = F.col("k")
    prov = [unit(k).alias("translation_unit_id"), F.concat(F.lit("config_"), unit(k)).alias("build_configuration_id"), "build_variant"]
    site = stable_id("callsite", F.col("build_variant"), k)
    return {
        "symbol_variants": base.select(
            stable_id("variant", F.col("build_variant"), k).alias("id"), symbol(k).alias("symbol_id"), F.concat(unit(k), F.lit("::function"), k % spec.functions).alias("qualified_name"),
            F.lit("function").alias("kind"), F.concat(unit(k), F.lit(".cpp")).alias("path"), (k % spec.functions * 5 + 1).cast("int").alias("start_line"), (k % spec.functions * 5 + 4).cast("int").alias("end_line"),
            F.lit("int function(int value)").alias("signature"), F.lit("").alias("documentation"), F.concat(F.lit("return value + "), k).alias("source_text"), F.lit(True).alias("is_definition"), *prov,
        ),
        "callsites": base.select(site.alias("id"), symbol(k).alias("owner_symbol_id"), F.lit("direct").alias("dispatch_kind"), symbol((k + 1) % n).alias("static_target_symbol_id"), F.lit(True).alias("target_set_complete"), *prov),
        "call_targets": base.select(
            stable_id("target", F.col("build_variant"), k).alias("id"), site.alias("callsite_id"), symbol((k + 1) % n).alias("target_symbol_id"), F.lit("certain").alias("certainty"), F.lit(1.0).alias("confidence"), F.lit("direct").alias("derivation"), *prov,
        ),
    }
