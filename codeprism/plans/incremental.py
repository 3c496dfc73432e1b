"""Incremental maintenance: change detection, snapshots and what follows from a changed unit.

Tables are Parquet files in partitions by build and by a hash of what a row belongs to. A
commit writes anew only the partitions that it touches and then a numbered manifest, which
lists the files of every partition: readers see the state before or after it, never a mixture.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph, lookups, solver
from ..sources.schemas import VERSION
from ..sources.staging import Manifests, drop_staged, plain_unions, staged

#: Tables whose rows belong to a translation unit.
OWNED = ("symbol_variants", "occurrences", "edges", "cfg_graphs", "cfg_blocks", "cfg_elements", "cfg_edges", "callsites", "call_targets", "data_flow_analyses", "memory_locations", "data_accesses", "data_flow_evidence", "function_summaries", "summary_effects", "summary_return_origins", "call_argument_bindings", "call_result_bindings", "dependencies")


def changed_units(current: DataFrame, state: DataFrame, hashes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Ids of current units to analyse again: new ones, and those whose command, backend,
    completeness, source or any dependency changed or is gone.

    current: id, source_path, command_hash, analysis_backend and, where a backend does not make
    all facts, the advanced_facts_complete to expect (else true); state: id, command_hash,
    content_hash, analysis_backend, advanced_facts_complete; hashes: path, content_hash of files
    as they are; dependencies: translation_unit_id, path, content_hash as they were.
    """
    now = hashes.select(F.col("path").alias("source_path"), F.col("content_hash").alias("now_hash"))
    expected = F.col("advanced_facts_complete") if "advanced_facts_complete" in current.columns else F.lit(True)
    current = current.select("id", "source_path", "command_hash", "analysis_backend", expected.alias("expected"))
    old = state.select("id", F.col("command_hash").alias("old_command"), F.col("content_hash").alias("old_hash"), F.col("analysis_backend").alias("old_backend"), "advanced_facts_complete")
    joined = current.join(old, "id", "left").join(now, "source_path", "left")
    differs = (
        F.col("old_command").isNull()
        | (F.col("old_command") != F.col("command_hash"))
        | (F.col("old_backend") != F.col("analysis_backend"))
        | (F.coalesce("advanced_facts_complete", F.lit(False)) != F.col("expected"))
        | ~F.col("old_hash").eqNullSafe(F.col("now_hash"))
    )
    files = dependencies.join(hashes.withColumnRenamed("content_hash", "now_hash"), "path", "left")
    stale = files.where(~F.col("content_hash").eqNullSafe(F.col("now_hash"))).select(F.col("translation_unit_id").alias("id")).distinct()
    return joined.where(differs).select("id").union(current.select("id").join(stale, "id", "left_semi")).distinct()


def removed_units(current: DataFrame, state: DataFrame) -> DataFrame:
    return state.select("id").join(current.select("id"), "id", "left_anti")


def without_units(table: DataFrame, units: DataFrame, column: str = "translation_unit_id") -> DataFrame:
    """Rows of other units."""
    return table.join(units.select(F.col("id").alias(column)), column, "left_anti").select(*table.columns)


def affected_symbols(variants: DataFrame, units: DataFrame) -> DataFrame:
    return variants.join(units.select(F.col("id").alias("translation_unit_id")), "translation_unit_id", "left_semi").select("symbol_id").distinct()


def orphans(symbols: DataFrame, variants: DataFrame) -> DataFrame:
    return lookups.standalone(variants, symbols)


def unused_configurations(configurations: DataFrame, units: DataFrame) -> DataFrame:
    return configurations.join(units.select(F.col("build_configuration_id").alias("id")), "id", "left_anti")


def upsert_variants(old: DataFrame, new: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants after an upsert by id, and embeddings without those of changed snapshots."""
    columns = [c for c in old.columns if c != "id"]
    changed = new.alias("n").join(old.alias("o"), "id").where(F.xxhash64(*[f"n.{c}" for c in columns]) != F.xxhash64(*[f"o.{c}" for c in columns])).select("id")
    kept = old.join(new.select("id"), "id", "left_anti").unionByName(new)
    return kept, embeddings.join(changed.withColumnRenamed("id", "variant_id"), "variant_id", "left_anti")


def refresh_canonical(symbols: DataFrame, variants: DataFrame, affected: DataFrame) -> DataFrame:
    """Canonical rows: those of affected symbols picked anew, equal ones left as they are."""
    hits = variants.join(affected.select("symbol_id"), "symbol_id", "left_semi")
    picked = lookups.preferred(hits).select(F.col("symbol_id").alias("id"), *[c for c in symbols.columns if c != "id"])
    new = picked.join(symbols, symbols.columns, "left_anti")
    return symbols.join(new.select("id"), "id", "left_anti").unionByName(new)


def impacted_functions(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Functions whose summaries a change may touch: the changed ones and all that reach them over calls (a, b)."""
    return changed.select("id").union(graph.reverse_callers(calls, changed)).distinct()


def refresh_summaries(tables: dict[str, DataFrame], calls: DataFrame, changed: DataFrame, limits: solver.Limits | None = None) -> dict[str, DataFrame]:
    """Solved rows of impacted functions; callees take part in the solution but are not written."""
    impacted = impacted_functions(calls, changed)
    needed = graph.forward_callees(calls, impacted)
    inside = dict(tables)
    inside["summaries"] = tables["summaries"].join(needed.select(F.col("id").alias("function_symbol_id")), "function_symbol_id", "left_semi")
    solved = solver.solve(inside, limits)
    own = solved["summaries"].join(impacted.select(F.col("id").alias("function_symbol_id")), "function_symbol_id", "left_semi")
    ids = own.select(F.col("id").alias("summary_id"))
    return {"summaries": own, "effects": solved["effects"].join(ids, "summary_id", "left_semi"), "origins": solved["origins"].join(ids, "summary_id", "left_semi"), "flows": solved["flows"].join(ids.withColumnRenamed("summary_id", "caller_summary_id"), "caller_summary_id", "left_semi")}


def migrate(units: DataFrame, version: int) -> DataFrame:
    """Units of an older schema version are flagged for analysis; newer versions are refused."""
    if version > VERSION:
        raise ValueError(f"schema version {version} is newer than {VERSION}")
    return units if version == VERSION else units.withColumn("advanced_facts_complete", F.lit(False))


#: What the rows of a table belong to, where that is no translation unit.
KEYS = {"translation_units": "id", "build_configurations": "id", "symbols": "id", "embeddings": "variant_id", "build_variants": "name", "solved_summaries": "id", "solved_effects": "summary_id", "solved_origins": "summary_id", "solved_flows": "caller_summary_id"}
#: Tables that the summary solver reads, by its names for them.
SOLVER = {"summaries": "function_summaries", "sites": "callsites", "targets": "call_targets", "effects": "summary_effects", "origins": "summary_return_origins", "bindings": "call_argument_bindings", "results": "call_result_bindings"}
PARTS = 16
CANDIDATE = "indexed_override_candidate"


class Store:
    """Tables below a folder in partitions; the manifest is the commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root)

    def manifest(self) -> dict:
        number, found = self.manifests.latest()
        found = found or {"version": VERSION, "tables": {}, "schemas": {}, "builds": []}
        if found["version"] > VERSION:
            raise ValueError(f"schema version {found['version']} is newer than {VERSION}")
        return found | {"snapshot": number}

    def read(self, name: str, builds: tuple[str, ...] | None = None, snapshot: dict | None = None) -> DataFrame:
        """A table, or its rows of some builds, of which only the partitions are listed and read."""
        m = snapshot or self.manifest()
        schema = T.StructType.fromJson(m["schemas"][name])
        paths = m["tables"][name]
        if builds is not None and "build_variant" in schema.names:
            wanted = {m["builds"].index(b) for b in builds if b in m["builds"]}
            paths = {p: at for p, at in paths.items() if int(p.partition("/")[0]) in wanted}
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{at}" for at in paths.values()])
        return df if builds is None or "build_variant" not in schema.names else df.where(F.col("build_variant").isin(*builds))

    @staticmethod
    def part(name: str, df: DataFrame) -> Column:
        key = KEYS.get(name, "translation_unit_id")
        return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(PARTS)).cast("int") if key in df.columns else F.lit(0)

    def commit(self, tables: dict[str, DataFrame], touched: dict[str, DataFrame] | None = None) -> int:
        """Write tables and switch the manifest; tables that are not named stay as they are.

        touched may name for a table the rows (before and after) that change; only the
        partitions that hold them are then written, and the others keep their files.
        """
        m = self.manifest()
        n = m["snapshot"] + 1
        build = lambda df: F.col("build_variant") if "build_variant" in df.columns else F.lit("")
        partly = {t for t in tables if touched is not None and t in touched and t in m["tables"]}
        rows_of = {t: touched[t] if t in partly else df for t, df in tables.items()}
        places = [df.select(F.lit(t).alias("t"), build(df).alias("b"), self.part(t, df).alias("k")).distinct() for t, df in rows_of.items()]
        found = functools.reduce(DataFrame.unionAll, places).collect() if places else []  # at most tables x builds x PARTS
        builds = m["builds"] + sorted({r["b"] for r in found} - set(m["builds"]), key=lambda b: (b is not None, b or ""))
        number = lambda df: functools.reduce(lambda c, i: c.when(build(df).eqNullSafe(F.lit(builds[i])), i), range(len(builds)), F.when(F.lit(False), 0)).cast("int")
        dirty = {t: {(builds.index(r["b"]), r["k"]) for r in found if r["t"] == t} for t in tables}

        def write(name: str) -> dict[str, str]:
            """The folders of the partitions that a table's files went to."""
            placed = tables[name].withColumns({"_b": number(tables[name]), "_k": self.part(name, tables[name])})
            if name in partly:
                if not dirty[name]:
                    return {}
                placed = placed.where(functools.reduce(lambda c, p: c | ((F.col("_b") == p[0]) & (F.col("_k") == p[1])), dirty[name], F.lit(False)))
            path = f"snapshot-{n}/{name}"
            placed.repartition("_b", "_k").write.mode("overwrite").partitionBy("_b", "_k").parquet(f"{self.root}/{path}")
            out = {}
            for f in self.manifests.fs.globStatus(self.manifests.path(f"{self.root}/{path}/_b=*/_k=*")) or ():
                b, k = f.getPath().getParent().getName()[3:], f.getPath().getName()[3:]
                out[f"{b}/{k}"] = f"{path}/_b={b}/_k={k}"
            return out

        new = {"version": VERSION, "tables": dict(m["tables"]), "schemas": dict(m["schemas"]), "builds": builds}
        with ThreadPoolExecutor(4) as pool:  # tables are written by jobs of their own
            written = dict(zip(tables, pool.map(write, tables)))
        for name, df in tables.items():
            kept = {p: at for p, at in m["tables"].get(name, {}).items() if tuple(map(int, p.split("/"))) not in dirty[name]} if name in partly else {}
            new["tables"][name] = kept | written[name]
            new["schemas"][name] = df.schema.jsonValue()
        self.manifests.commit(n, new)
        return n

    def replaced(self, gone: DataFrame, batch: dict[str, DataFrame], m: dict) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Of each table of units: its rows without those of gone units and with those of a batch; and what changed."""
        out, touched = {}, {}
        for name in (*OWNED, "translation_units"):
            column = "id" if name == "translation_units" else "translation_unit_id"
            new = batch.get(name)
            if name not in m["tables"]:
                if new is not None:
                    out[name] = new
                continue
            old = self.read(name, snapshot=m)
            kept = without_units(old, gone, column)
            out[name] = kept if new is None else kept.unionByName(new, allowMissingColumns=True)
            lost = old.join(gone.select(F.col("id").alias(column)), column, "left_semi").select(*old.columns)
            touched[name] = lost if new is None else lost.unionByName(new, allowMissingColumns=True)
        return out, touched

    def apply(self, changed: DataFrame, removed: DataFrame, batch: dict[str, DataFrame]) -> int:
        """Replace the rows of changed and removed units by those of a batch, in one commit; returns its number."""
        gone = changed.select("id").union(removed.select("id")).distinct()
        with plain_unions(self.spark):
            return self.commit(*self.replaced(gone, batch, self.manifest()))

    def ingest(self, build: str, batch: dict[str, DataFrame], current: DataFrame | None = None, limits: solver.Limits | None = None) -> int:
        """Take a batch of facts of one build into the store, in one commit; returns how many summaries were solved anew.

        The batch's units replace their earlier rows; with current (ids of all units of the
        build as it is) the others of the build go. What follows is brought up to date from the
        store as it then is: override candidates of virtual calls, summaries of functions whose
        callees changed, canonical symbols, vectors of changed variants. Symbols without
        variants, configurations without units go, and the build needs no reindexing.
        """
        with plain_unions(self.spark):
            return self._ingest(build, batch, current, limits)

    def _ingest(self, build: str, batch: dict[str, DataFrame], current: DataFrame | None, limits: solver.Limits | None) -> int:
        m = self.manifest()
        spark = self.spark
        ids = lambda df, c: df.select(F.col(c).alias("id"))
        nothing = spark.createDataFrame([], "id string")
        units = batch.get("translation_units")
        gone = nothing if units is None else ids(units, "id")
        if current is not None and "translation_units" in m["tables"]:
            mine = self.read("translation_units", (build,), m)
            gone = gone.union(ids(mine, "id").join(current.select("id"), "id", "left_anti"))
        gone = staged(gone.distinct(), "gone-units")
        out, touched = self.replaced(gone, batch, m)
        before = {t: self.read(t, snapshot=m) for t in m["tables"]}

        if "call_targets" in out and "callsites" in out and "edges" in out:
            self._refresh_candidates(build, out, touched)
        solved = 0
        if "function_summaries" in out and all(t in out for t in SOLVER.values()):
            solved = self._refresh_solutions(build, before, out, touched, gone, batch, limits)
        if "symbol_variants" in out:
            self._refresh_names(before, out, touched, gone, batch)
        self._refresh_builds(build, before, out, touched, batch)
        self.commit(out, touched)
        drop_staged(gone)
        return solved

    def _refresh_candidates(self, build: str, out: dict, touched: dict) -> None:
        """Override candidates of a build's virtual calls, as the facts now are."""
        targets = out["call_targets"]
        mine = targets.where(F.col("build_variant") == build)
        sites = out["callsites"].where(F.col("build_variant") == build)
        overrides = out["edges"].where((F.col("relation") == "overrides") & (F.col("build_variant") == build))
        found = graph.override_targets(sites, mine, overrides)
        place = sites.select(F.col("id").alias("callsite_id"), *[c for c in ("translation_unit_id", "build_configuration_id") if c in sites.columns])
        named = found.join(place, "callsite_id").withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(CANDIDATE), "build_variant", "callsite_id", "target_symbol_id"), 256))
        new = staged(named, "candidates")
        old = mine.where(F.col("derivation") == CANDIDATE)
        stays = F.coalesce(F.col("derivation") != CANDIDATE, F.lit(True)) | (F.col("build_variant") != build)
        out["call_targets"] = targets.where(stays).unionByName(new, allowMissingColumns=True)
        differ = new.join(old.select("id"), "id", "left_anti").unionByName(old.join(new.select("id"), "id", "left_anti"), allowMissingColumns=True)
        if "call_targets" in touched:
            # what a removed unit's callsite had is among the rows of that unit already
            touched["call_targets"] = touched["call_targets"].unionByName(differ, allowMissingColumns=True)

    def _refresh_solutions(self, build: str, before: dict, out: dict, touched: dict, gone: DataFrame, batch: dict, limits: solver.Limits | None) -> int:
        """Solutions of the functions that the change may touch: those of changed units and all that reach them, before or after."""
        def calls(tables: dict[str, DataFrame]) -> DataFrame:
            if "callsites" not in tables or "call_targets" not in tables:
                return self.spark.createDataFrame([], "a string, b string")
            sites = tables["callsites"].where(F.col("build_variant") == build).select(F.col("id").alias("callsite_id"), F.col("owner_symbol_id").alias("a"))
            return sites.join(tables["call_targets"].select("callsite_id", F.col("target_symbol_id").alias("b")), "callsite_id").select("a", "b").distinct()

        changed = batch["function_summaries"].select(F.col("function_symbol_id").alias("id")) if "function_summaries" in batch else self.spark.createDataFrame([], "id string")
        if "function_summaries" in before:
            lost = before["function_summaries"].join(gone.select(F.col("id").alias("translation_unit_id")), "translation_unit_id", "left_semi")
            changed = changed.union(lost.select(F.col("function_symbol_id").alias("id")))
            changed = changed.union(graph.reverse_callers(calls(before), changed))
        changed = staged(changed.distinct(), "changed-functions")
        mine = {k: out[t].where(F.col("build_variant") == build) if "build_variant" in out[t].columns else out[t] for k, t in SOLVER.items()}
        made = refresh_summaries(mine, calls(out), changed, limits)
        fresh = {k: staged(df.withColumn("build_variant", F.lit(build)) if "build_variant" not in df.columns else df, f"solved-{k}") for k, df in made.items()}
        summaries = out["function_summaries"]
        own = fresh["summaries"].select("id")
        for k, df in fresh.items():
            name, key = f"solved_{k}", KEYS[f"solved_{k}"]
            if name not in before:
                out[name] = df
                continue
            old = before[name]
            alive = old.join(summaries.select(F.col("id").alias(key)), key, "left_semi")
            out[name] = alive.join(own.withColumnRenamed("id", key), key, "left_anti").select(*old.columns).unionByName(df, allowMissingColumns=True)
            dead = old.join(summaries.select(F.col("id").alias(key)), key, "left_anti").select(*old.columns)
            touched[name] = dead.unionByName(old.join(own.withColumnRenamed("id", key), key, "left_semi").select(*old.columns)).unionByName(df, allowMissingColumns=True)
        drop_staged(changed)
        return fresh["summaries"].count()

    def _refresh_names(self, before: dict, out: dict, touched: dict, gone: DataFrame, batch: dict) -> None:
        """Canonical symbols of the variants that changed, and no vectors of variants that are gone or changed."""
        variants = out["symbol_variants"]
        affected = batch["symbol_variants"].select("symbol_id") if "symbol_variants" in batch else self.spark.createDataFrame([], "symbol_id string")
        if "symbol_variants" in before:
            affected = affected.union(affected_symbols(before["symbol_variants"], gone))
        affected = affected.distinct()
        if "symbols" in before:
            symbols = before["symbols"]
        else:
            symbols = lookups.preferred(variants.limit(0)).select(F.col("symbol_id").alias("id"), "qualified_name", "signature", "documentation", "source_text")
        renewed = refresh_canonical(symbols, variants, affected)
        named = batch["symbols"].select(*symbols.columns) if "symbols" in batch else symbols.limit(0)
        alone = orphans(renewed, variants)
        out["symbols"] = renewed.join(alone.select("id"), "id", "left_anti").select(*symbols.columns).unionByName(named.join(renewed.select("id"), "id", "left_anti"))
        touched["symbols"] = affected.select(F.col("symbol_id").alias("id")).union(alone.select("id")).union(named.select("id"))
        if "embeddings" in before and "symbol_variants" in before:
            old = before["symbol_variants"]
            columns = [c for c in old.columns if c != "id" and old.schema[c].dataType.typeName() != "map"]
            same = old.select("id", F.xxhash64(*columns).alias("h")).join(variants.select("id", F.xxhash64(*columns).alias("h")), ["id", "h"], "left_semi")
            stale = before["embeddings"].join(same.select(F.col("id").alias("variant_id")), "variant_id", "left_anti")
            known = old.select(F.col("id").alias("variant_id"))
            stale = stale.join(known, "variant_id", "left_semi").select(*before["embeddings"].columns)
            out["embeddings"] = before["embeddings"].join(stale.select("variant_id", "model"), ["variant_id", "model"], "left_anti").select(*before["embeddings"].columns)
            touched["embeddings"] = stale

    def _refresh_builds(self, build: str, before: dict, out: dict, touched: dict, batch: dict) -> None:
        """Configurations by id, without unused ones; the build itself is up to date."""
        new, old = batch.get("build_configurations"), before.get("build_configurations")
        if new is not None or old is not None:
            every = new if old is None else old if new is None else old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)
            if "translation_units" in out:
                idle = unused_configurations(every, out["translation_units"]).select("id")
                every = every.join(idle, "id", "left_anti").select(*every.columns)
            out["build_configurations"] = every
        rows = before.get("build_variants")
        given = batch.get("build_variants")
        if given is None:
            given = self.spark.createDataFrame([(build, None)], "name string, reindex_required boolean")
        given = given.where(F.col("name") == build).withColumn("reindex_required", F.lit(False))
        if rows is None:
            out["build_variants"] = given
        else:
            mine = rows.where(F.col("name") == build).withColumn("reindex_required", F.lit(False))
            fresh = given if "build_variants" in batch else mine.unionByName(given.join(mine.select("name"), "name", "left_anti"), allowMissingColumns=True)
            out["build_variants"] = rows.where(F.col("name") != build).unionByName(fresh, allowMissingColumns=True)

    def remove_build(self, name: str) -> bool:
        """Drop a build from every table, and what only it held: canonical symbols and vectors. False if no table has it."""
        m = self.manifest()
        tables = {t: self.read(t, snapshot=m) for t in m["tables"]}
        have = {t: df for t, df in tables.items() if "build_variant" in df.columns and not self.read(t, (name,), m).isEmpty()}
        if not have:
            return False
        out = {t: df.where(~F.col("build_variant").eqNullSafe(F.lit(name))) for t, df in have.items()}
        touched = {t: self.read(t, (name,), m) for t in have}
        if "symbol_variants" in out and "symbols" in tables:
            symbols, left = tables["symbols"], out["symbol_variants"]
            affected = touched["symbol_variants"].select("symbol_id").distinct()
            renewed = refresh_canonical(symbols, left, affected)
            out["symbols"] = renewed.join(orphans(renewed, left).select("id"), "id", "left_anti").select(*symbols.columns)
            touched["symbols"] = affected.select(F.col("symbol_id").alias("id"))
        if "build_variants" in tables:
            out["build_variants"] = tables["build_variants"].where(F.col("name") != name)
        with plain_unions(self.spark):
            self.commit(out, touched)
        return True

    def put_embeddings(self, rows: DataFrame) -> int:
        """Upsert vectors (variant_id, model, vector, build_variant): all or none, one dimension per model."""
        from ..functions.embedding import is_valid, magnitude

        if not rows.where(~F.coalesce(is_valid(F.col("vector")), F.lit(False))).isEmpty():
            raise ValueError("vectors are finite and not zero")
        known = self.manifest()["tables"]
        old = self.read("embeddings") if "embeddings" in known else None
        new = rows.select("variant_id", "model", F.size("vector").alias("dimensions"), magnitude(F.col("vector")).alias("magnitude"), "vector", "build_variant")
        every = new if old is None else old.select(*new.columns).join(new.select("variant_id", "model"), ["variant_id", "model"], "left_anti").unionByName(new)
        if not every.groupBy("model").agg(F.countDistinct("dimensions").alias("n")).where("n > 1").isEmpty():
            raise ValueError("vectors of a model have one dimension")
        with plain_unions(self.spark):
            return self.commit({"embeddings": every}, {"embeddings": new})
