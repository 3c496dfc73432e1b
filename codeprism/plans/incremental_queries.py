"""Queries over incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.staging import new_path
from ..views import ctes, view
from . import incremental

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def units(spark, sf_dir):
    """Units as they were, and as they are: every ninth has another command, every tenth another source."""
    state = view(spark, sf_dir, "translation_units").select("id", F.substring("id", 4, 20).cast("long").alias("k"), "content_hash", "analysis_backend", "advanced_facts_complete")
    state = state.withColumn("command_hash", F.concat(F.lit("c"), F.col("k") % 5)).withColumn("source_path", F.concat(F.lit("s"), "k"))
    current = state.where("k % 13 <> 0").select("id", "source_path", "analysis_backend", F.when(F.col("k") % 9 == 0, "other").otherwise(F.col("command_hash")).alias("command_hash"))
    sources = state.where("k % 17 <> 0").select(F.col("source_path").alias("path"), F.when(F.col("k") % 10 == 0, "edited").otherwise(F.col("content_hash")).alias("content_hash"))
    deps = view(spark, sf_dir, "dependencies").distinct()
    headers = deps.groupBy("path").agg(F.max("content_hash").alias("content_hash"))
    return state, current, sources.unionAll(headers), deps


CHANGED = f"""WITH {ctes('translation_units', 'dependencies')},
s AS (SELECT id, CAST(substr(id, 4) AS BIGINT) AS k, content_hash, advanced_facts_complete FROM v_translation_units),
d AS (SELECT DISTINCT * FROM v_dependencies),
h AS (SELECT path, max(content_hash) AS now FROM d GROUP BY path),
stale AS (SELECT DISTINCT translation_unit_id FROM d JOIN h USING (path) WHERE d.content_hash <> h.now)"""


@register("changed_units", CHANGED + " SELECT id FROM s WHERE k % 13 <> 0 AND (k % 9 = 0 OR k % 10 = 0 OR k % 17 = 0 OR NOT advanced_facts_complete OR id IN (SELECT translation_unit_id FROM stale))")
def changed_units(spark, sf_dir):
    state, current, hashes, deps = units(spark, sf_dir)
    return incremental.changed_units(current, state, hashes, deps)


@register("removed_units", CHANGED + " SELECT id FROM s WHERE k % 13 = 0")
def removed_units(spark, sf_dir):
    state, current, _, _ = units(spark, sf_dir)
    return incremental.removed_units(current, state)


GONE = "SELECT DISTINCT 'tu_' || source AS id FROM documents WHERE source IN ('src1', 'src4', 'src9')"


def gone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IN ('src1', 'src4', 'src9')")
    return docs.select(F.concat(F.lit("tu_"), "source").alias("id")).distinct()


@register("unit_deletion", f"WITH {ctes('symbol_variants')}, g AS ({GONE}) SELECT * FROM v_symbol_variants WHERE translation_unit_id NOT IN (SELECT id FROM g)")
def unit_deletion(spark, sf_dir):
    return incremental.without_units(view(spark, sf_dir, "symbol_variants"), gone(spark, sf_dir))


@register("affected_symbols", f"WITH {ctes('symbol_variants')}, g AS ({GONE}) SELECT DISTINCT symbol_id FROM v_symbol_variants WHERE translation_unit_id IN (SELECT id FROM g)")
def affected_symbols(spark, sf_dir):
    return incremental.affected_symbols(view(spark, sf_dir, "symbol_variants"), gone(spark, sf_dir))


@register("orphan_symbols", f"WITH {ctes('symbol_variants', 'symbols')}, g AS ({GONE}) SELECT id, qualified_name FROM v_symbols AS s WHERE NOT EXISTS (SELECT 1 FROM v_symbol_variants AS v WHERE v.symbol_id = s.id AND v.translation_unit_id NOT IN (SELECT id FROM g))")
def orphan_symbols(spark, sf_dir):
    left = incremental.without_units(view(spark, sf_dir, "symbol_variants"), gone(spark, sf_dir))
    return incremental.orphans(view(spark, sf_dir, "symbols"), left).select("id", "qualified_name")


@register("unused_configurations", f"WITH {ctes('build_configurations', 'translation_units')} SELECT * FROM v_build_configurations AS c WHERE NOT EXISTS (SELECT 1 FROM v_translation_units AS u WHERE u.build_configuration_id = c.id AND u.analysis_backend = '1-URGENT')")
def unused_configurations(spark, sf_dir):
    return incremental.unused_configurations(view(spark, sf_dir, "build_configurations"), view(spark, sf_dir, "translation_units").where("analysis_backend = '1-URGENT'"))


@register(
    "embedding_invalidation",
    f"WITH {ctes('symbol_variants', 'embeddings')} SELECT variant_id, model FROM v_embeddings WHERE variant_id NOT IN (SELECT id FROM v_symbol_variants WHERE build_variant = 'fr')",
)
def embedding_invalidation(spark, sf_dir):
    """French variants get another signature; their vectors go, unchanged ones keep theirs."""
    old = view(spark, sf_dir, "symbol_variants")
    new = old.where("build_variant IN ('fr', 'es')").withColumn("signature", F.when(F.col("build_variant") == "fr", "changed").otherwise(F.col("signature")))
    return incremental.upsert_variants(old, new, view(spark, sf_dir, "embeddings"))[1].select("variant_id", "model")


@register(
    "canonical_refresh",
    f"""WITH {ctes('symbol_variants', 'symbols')}, g AS ({GONE}),
a AS (SELECT DISTINCT symbol_id FROM v_symbol_variants WHERE translation_unit_id IN (SELECT id FROM g)),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY is_definition DESC, build_variant, translation_unit_id, id) AS rn FROM v_symbol_variants)
SELECT s.id, coalesce(r.qualified_name, s.qualified_name) AS qualified_name, coalesce(r.signature, s.signature) AS signature
FROM v_symbols AS s LEFT JOIN r ON r.symbol_id = s.id AND r.rn = 1 AND s.id IN (SELECT symbol_id FROM a)""",
)
def canonical_refresh(spark, sf_dir):
    variants = view(spark, sf_dir, "symbol_variants")
    return incremental.refresh_canonical(view(spark, sf_dir, "symbols"), variants, incremental.affected_symbols(variants, gone(spark, sf_dir)))


@register(
    "store_commit",
    f"""WITH {ctes('symbol_variants')}
SELECT id, qualified_name, CASE WHEN translation_unit_id = 'tu_src1' THEN 'changed' ELSE signature END AS signature, translation_unit_id, build_variant
FROM v_symbol_variants WHERE translation_unit_id NOT IN ('tu_src4', 'tu_src9') AND NOT (translation_unit_id = 'tu_src1' AND kind = 'class')""",
)
def store_commit(spark, sf_dir):
    """A store that takes one batch with two units changed and removed, read back: src1 has no classes any more, src4 is empty and src9 gone."""
    store = incremental.Store(spark, new_path(spark, "store"))
    rows = view(spark, sf_dir, "symbol_variants").select("id", "qualified_name", "kind", "signature", "translation_unit_id", "build_variant")
    store.commit({"symbol_variants": rows})
    batch = rows.where("translation_unit_id = 'tu_src1' AND kind <> 'class'").withColumn("signature", F.lit("changed"))
    ids = lambda *units: spark.createDataFrame([(u,) for u in units], "id string")
    store.apply(ids("tu_src1", "tu_src4"), ids("tu_src9"), {"symbol_variants": batch})
    return store.read("symbol_variants").drop("kind")


@register(
    "store_ingestion",
    f"""WITH {ctes('symbol_variants')},
n AS (SELECT id, symbol_id, CASE WHEN build_variant = 'en' AND source = 'src1' THEN 'renamed' ELSE qualified_name END AS qualified_name, is_definition, build_variant, translation_unit_id
      FROM (SELECT *, substr(translation_unit_id, 4) AS source FROM v_symbol_variants) AS v WHERE NOT (build_variant = 'en' AND source = 'src9')),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY is_definition DESC, build_variant, translation_unit_id, id) AS rn FROM n)
SELECT symbol_id AS id, qualified_name FROM r WHERE rn = 1""",
)
def store_ingestion(spark, sf_dir):
    """Canonical symbols after three builds came in, one of them a second time with a unit changed and one gone."""
    store = incremental.Store(spark, new_path(spark, "store"))
    columns = ["id", "symbol_id", "qualified_name", "signature", "documentation", "source_text", "is_definition", "build_variant", "translation_unit_id"]
    rows = view(spark, sf_dir, "symbol_variants").select(*columns)
    rows = rows.withColumn("translation_unit_id", F.concat_ws("@", "translation_unit_id", "build_variant"))
    units = rows.select(F.col("translation_unit_id").alias("id"), "build_variant").distinct()
    for build in [r["build_variant"] for r in rows.select("build_variant").distinct().orderBy("build_variant").collect()]:  # a few builds
        one = F.col("build_variant") == build
        store.ingest(build, {"symbol_variants": rows.where(one), "translation_units": units.where(one)})
    edited = rows.where("translation_unit_id = 'tu_src1@en'").withColumn("qualified_name", F.lit("renamed"))
    left = units.where("build_variant = 'en' AND id <> 'tu_src9@en'")
    store.ingest("en", {"symbol_variants": edited, "translation_units": units.where("id = 'tu_src1@en'")}, left)
    return store.read("symbols").select("id", "qualified_name")


@register("impacted_functions", f"WITH RECURSIVE {ctes('calls')}, x AS (SELECT 5 AS id UNION SELECT c.a FROM x JOIN v_calls AS c ON c.b = x.id) SELECT CAST(id AS BIGINT) AS id FROM x")
def impacted_functions(spark, sf_dir):
    return incremental.impacted_functions(view(spark, sf_dir, "calls"), spark.createDataFrame([(5,)], "id long"))
