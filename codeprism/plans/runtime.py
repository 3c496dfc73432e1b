"""A project: its configuration, its store of facts, indexing and the tools over it.

The compiler stays outside: an analyser is a function from the configurations to analyse to
tables of facts. `stream_analyser` reads the fact streams that an outer one left in a folder.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import embedding_text, with_embedding
from ..functions.ids import stable_id
from ..operators import search
from ..operators.postings import Index
from ..sources import compilation, connectors, facts
from ..sources.schemas import SCHEMAS
from . import incremental, surface

PREFIX = "CODEPRISM_"


@dataclass(frozen=True)
class Config:
    """Settings of a project; from_environment() reads each from its name in capitals after PREFIX."""

    store: str = ""
    root: str = ""
    builds: tuple[str, ...] = ()
    facts: str = ""
    backend: str = "native"
    facts_complete: bool = True
    tokens: int = 16_000
    results: int = 20
    embeddings: str = "local"
    embeddings_url: str = ""
    embeddings_model: str = "local"
    embeddings_key: str = ""
    dimensions: int = 384
    timeout: float = 30.0
    llm_url: str = ""
    llm_model: str = ""
    llm_key: str = ""
    host: str = "127.0.0.1"
    port: int = 8000

    SECRET = ("embeddings_key", "llm_key")

    def __post_init__(self):
        if min(self.tokens, self.results, self.dimensions, self.port) < 1 or self.timeout <= 0:
            raise ValueError("tokens, results, dimensions, port and timeout are positive")
        if self.embeddings not in ("local", "http", "none"):
            raise ValueError("embeddings are local, http or none")
        if self.embeddings == "http" and not (self.embeddings_url and self.embeddings_model):
            raise ValueError("embeddings over http need a url and a model")
        if bool(self.llm_url) != bool(self.llm_model):
            raise ValueError("a language model needs a url and a model")

    def __repr__(self) -> str:
        shown = {f.name: "***" if f.name in self.SECRET and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}
        return f"Config({', '.join(f'{k}={v!r}' for k, v in shown.items())})"

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] | None = None, **given) -> Config:
        """Settings from the environment; those that are given count more."""
        environment = os.environ if environment is None else environment
        out = {}
        for f in fields(cls):
            text = environment.get(PREFIX + f.name.upper())
            if text is None:
                continue
            kind = type(f.default)
            try:
                out[f.name] = (
                    tuple(x.strip() for x in text.split(",") if x.strip()) if kind is tuple
                    else {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[text.lower()] if kind is bool
                    else kind(text)
                )
            except (ValueError, KeyError):
                raise ValueError(f"{PREFIX}{f.name.upper()} is not a {kind.__name__}") from None
        return cls(**out | {k: v for k, v in given.items() if v is not None})


def file_hashes(paths: DataFrame) -> DataFrame:
    """path and content_hash (SHA-256; null for what is no file) of distinct paths that the executors can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = []
            for name in names:
                try:
                    with open(name, "rb") as f:
                        found.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["path", "content_hash"])

    return paths.select("path").distinct().mapInArrow(run, "path string, content_hash string")


def stream_analyser(spark: SparkSession, path: str, required: set[str] = facts.CAPABILITIES) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """An analyser over fact streams in files: those rows whose configuration is to be analysed."""

    def analyse(configurations: DataFrame) -> dict[str, DataFrame]:
        records = facts.read(spark, path)
        facts.check_handshake(records, set(required))
        wanted = configurations.select(F.col("id").alias("build_configuration_id"))
        made = facts.tables(facts.admitted(records))
        return {t: df.join(wanted, "build_configuration_id", "left_semi").select(*df.columns) if "build_configuration_id" in df.columns else df for t, df in made.items()}

    return analyse


def unit_of(configuration_id: Column) -> Column:
    return stable_id("unit", configuration_id)


class Project:
    """A store and what can be done with it."""

    def __init__(self, spark: SparkSession, config: Config):
        if not config.store:
            raise surface.NotConfigured("no store is configured")
        self.spark, self.config = spark, config
        self.store = incremental.Store(spark, config.store)
        self.index_root = f"{config.store.rstrip('/')}/index"

    # indexing

    def index_build(self, build: str, database: str, analyse: Callable[[DataFrame], dict[str, DataFrame]], check_paths: bool = True) -> dict[str, int]:
        """Bring a build up to date: only configurations that changed are analysed, units that are gone are removed.

        Returns counts: indexed, skipped and removed units, solved summaries, and rows by table.
        """
        configurations = compilation.load(self.spark, database, build, check_paths)
        current = configurations.withColumn("unit", unit_of(F.col("id")))
        known = self.store.manifest()["tables"]
        empty = lambda t: self.spark.createDataFrame([], SCHEMAS[t])
        old = {t: self.store.read(t, (build,)) if t in known else empty(t) for t in ("translation_units", "build_configurations", "dependencies")}
        commands = old["build_configurations"].select(F.col("id").alias("build_configuration_id"), "command_hash")
        state = old["translation_units"].join(commands, "build_configuration_id", "left")
        deps = old["dependencies"]
        hashes = file_hashes(current.select(F.col("source_path").alias("path")).union(deps.select("path"))).where("content_hash IS NOT NULL")
        hashes = incremental.staged(hashes, "hashes")
        settled = current.select(F.col("unit").alias("id"), "source_path", "command_hash", F.lit(self.config.backend).alias("analysis_backend"), F.lit(self.config.facts_complete).alias("advanced_facts_complete"))
        changed = incremental.staged(incremental.changed_units(settled, state, hashes, deps), "changed-units")
        removed = incremental.removed_units(settled, state).count()
        count = changed.count()
        batch: dict[str, DataFrame] = {}
        if count:
            todo = current.join(changed.select(F.col("id").alias("unit")), "unit", "left_semi")
            own = todo.select(F.col("id").alias("build_configuration_id"), F.col("unit").alias("translation_unit_id"))
            for t, df in analyse(todo).items():
                if {"translation_unit_id", "build_configuration_id"} <= set(df.columns):  # units are named after their configuration
                    df = df.drop("translation_unit_id").join(own, "build_configuration_id").select(*df.columns)
                batch[t] = incremental.staged(df, f"batch-{t}")
            now = hashes.select(F.col("path").alias("source_path"), "content_hash")
            batch["translation_units"] = todo.join(now, "source_path", "left").select(
                F.col("unit").alias("id"), F.col("id").alias("build_configuration_id"), "source_path", "content_hash", F.array().cast("array<string>").alias("diagnostics"),
                F.lit(self.config.backend).alias("analysis_backend"), F.lit(self.config.facts_complete).alias("advanced_facts_complete"), F.lit(build).alias("build_variant"),
            )
            batch["build_configurations"] = todo.select("id", "source_path", "directory", "arguments", "command_hash", "output", F.lit(build).alias("build_variant"))
        before = self.store.read("symbol_variants", (build,)).select("id") if "symbol_variants" in known else None
        solved = self.store.ingest(build, batch, settled.select("id"))
        self.refresh_index(build, before)
        report = {"indexed": count, "skipped": current.count() - count, "removed": removed, "solved_summaries": solved}
        return report | {t: df.count() for t, df in batch.items()} | {"embedded": self.embed_missing()}

    def refresh_index(self, build: str, before: DataFrame | None) -> None:
        """Postings of a build's variants, as they now are, instead of those before."""
        if "symbol_variants" not in self.store.manifest()["tables"]:
            return
        rows = self.store.read("symbol_variants", (build,))
        index = Index(self.spark, self.index_root)
        if index.manifests.latest()[1] is None:
            Index.create(self.store.read("symbol_variants"), tuple(search.LEXICAL), self.index_root)
            return
        names = index.state()["columns"]
        gone = before.join(rows.select("id"), "id", "left_anti") if before is not None else rows.select("id").limit(0)
        index.apply(rows.select("id", "build_variant", *names), gone)

    def embed_missing(self, page: int = 10_000) -> int:
        """Vectors for variants that have none, page by page; returns how many."""
        if self.config.embeddings == "none" or "symbol_variants" not in self.store.manifest()["tables"]:
            return 0
        total = 0
        while True:
            variants = self.store.read("symbol_variants")
            have = self.store.read("embeddings") if "embeddings" in self.store.manifest()["tables"] else self.spark.createDataFrame([], SCHEMAS["embeddings"])
            missing = search.missing_embeddings(variants, have, self.model, page).select("id")
            rows = variants.join(F.broadcast(missing), "id", "left_semi")  # a page
            text = embedding_text(*[F.col(c) for c in search.LEXICAL])
            named = rows.select(F.col("id").alias("variant_id"), F.lit(self.model).alias("model"), "build_variant", text.alias("text"))
            made = incremental.staged(self.embedded(named).select("variant_id", "model", "vector", "build_variant"), "vectors")
            n = made.count()
            if n:
                self.store.put_embeddings(made)
            total += n
            if n < page:
                return total

    @property
    def model(self) -> str:
        return self.config.embeddings_model

    def embedded(self, rows: DataFrame) -> DataFrame:
        """rows with the vector of their `text`, by the configured provider."""
        if self.config.embeddings == "local":
            return with_embedding(rows, F.col("text"), dimensions=self.config.dimensions)
        return connectors.hosted_embeddings(rows, "text", connectors.embedding_endpoint(self.config.embeddings_url, self.model, self.config.embeddings_key or None, self.config.timeout))

    def embed_query(self, query: str) -> list[float]:
        if self.config.embeddings == "local":
            one = self.spark.createDataFrame([(query,)], "text string")
            return list(with_embedding(one, F.col("text"), dimensions=self.config.dimensions).first()["vector"])
        call = connectors.embedding_endpoint(self.config.embeddings_url, self.model, self.config.embeddings_key or None, self.config.timeout)
        return connectors.vectors_of(call([query]), 1)[0]

    def remove_build(self, build: str) -> bool:
        had = self.store.read("symbol_variants", (build,)).select("id") if "symbol_variants" in self.store.manifest()["tables"] else None
        done = self.store.remove_build(build)
        index = Index(self.spark, self.index_root)
        if done and had is not None and index.manifests.latest()[1] is not None:
            index.apply(None, had)
        return done

    # queries

    def builds(self) -> tuple[str, ...]:
        known = self.store.manifest()["tables"]
        return tuple(r["name"] for r in self.store.read("build_variants").orderBy("name").collect()) if "build_variants" in known else ()

    def tools(self) -> surface.Tools:
        """The tools over the store as it now is."""
        known = self.store.manifest()["tables"]
        tables = {t: self.store.read(t) if t in known else self.spark.createDataFrame([], schema) for t, schema in SCHEMAS.items()}
        provider = connectors.chat(self.config.llm_url, self.config.llm_model, self.config.llm_key or None) if self.config.llm_url else None
        have = self.builds()
        if missing := [b for b in self.config.builds if b not in have]:
            raise ValueError(f"builds that are not indexed: {', '.join(missing)}")
        index = Index(self.spark, self.index_root)
        s = tables["callsites"].select(F.col("id").alias("callsite_id"), "owner_symbol_id", "build_variant")
        evidence = s.join(tables["call_targets"].select("callsite_id", "target_symbol_id", "certainty", "confidence", "derivation"), "callsite_id")
        tools = surface.Tools(tables, self.config.builds or have, self.config.root or None, provider, evidence)
        tools.index = index if index.manifests.latest()[1] is not None else None
        if self.config.embeddings != "none" and "embeddings" in known:
            tools.embed, tools.model = self.embed_query, self.model
        if self.config.facts:
            tools.indexer = lambda build, database: self.index_build(build, database, stream_analyser(self.spark, self.config.facts))
        return tools

    def doctor(self) -> dict:
        """What is configured and what the store holds, without secrets and absolute paths."""
        m = self.store.manifest()
        return {
            "snapshot": m["snapshot"],
            "schema_version": m["version"],
            "tables": {t: len(parts) for t, parts in sorted(m["tables"].items())},
            "builds": list(self.builds()),
            "search_index": Index(self.spark, self.index_root).manifests.latest()[0] > 0,
            "source_root": bool(self.config.root),
            "fact_streams": bool(self.config.facts),
            "embeddings": self.config.embeddings,
            "language_model": bool(self.config.llm_url),
        }
