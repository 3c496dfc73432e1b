"""Point reads, scans and pages over the fact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page import bounded_page, certain_first


def scope_filter(df: DataFrame, scope: tuple[str, ...] | None) -> DataFrame:
    """Rows of the builds in scope; tables are partitioned by build, so this prunes."""
    return df if scope is None else df.where(F.col("build_variant").isin(*scope))


def project_of(projects: DataFrame, name: str | None = None) -> str:
    """The id of the project asked for; without a name, of the only one there is."""
    rows = projects.where(F.col("root") == name) if name is not None else projects
    found = rows.select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError("there is no such project" if not found else "a project must be named, as there are several")
    return found[0]["id"]


def checked_scope(names: tuple[str, ...]) -> tuple[str, ...]:
    """Ordered distinct build names: 1 to 16, without white space, of up to 128 characters."""
    names = tuple(dict.fromkeys(names))
    if not 1 <= len(names) <= 16:
        raise ValueError("a scope has 1 to 16 builds")
    if any(not n or len(n) > 128 or any(c.isspace() for c in n) for n in names):
        raise ValueError("build names have 1 to 128 characters and no white space")
    return names


@dataclass(frozen=True)
class Lookup:
    """order: of the page. A leading `-` is descending, `!` puts certain values first."""

    table: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    limit: int
    #: (table, own column, alias of the joined index) of blocks that the order needs
    blocks: tuple[tuple[str, str], ...] = ()


LOOKUPS = {
    "cfg_graphs": Lookup("cfg_graphs", ("function_symbol_id",), ("build_variant", "build_configuration_id", "translation_unit_id", "function_symbol_id", "id"), 100),
    "cfg_blocks": Lookup("cfg_blocks", ("graph_id",), ("block_index", "id"), 1000),
    "cfg_elements": Lookup("cfg_elements", ("graph_id",), ("of_block", "element_index", "id"), 2000, (("block_id", "of_block"),)),
    "cfg_edges": Lookup("cfg_edges", ("graph_id",), ("source_index", "successor_index", "target_index", "kind", "-feasible", "id"), 2000, (("source_block_id", "source_index"), ("target_block_id", "target_index"))),
    "callsites": Lookup("callsites", ("owner_symbol_id",), ("build_variant", "build_configuration_id", "translation_unit_id", "path", "start_line", "start_column", "id"), 100),
    "call_targets": Lookup("call_targets", ("callsite_id",), ("!certainty", "-confidence", "target_symbol_id", "derivation", "id"), 100),
    "data_flow_analyses": Lookup("data_flow_analyses", ("graph_id",), ("build_variant", "graph_id", "id"), 100),
    "memory_locations": Lookup("memory_locations", ("analysis_id",), ("kind", "name", "id"), 1000),
    "data_accesses": Lookup("data_accesses", ("analysis_id",), ("of_block", "sequence", "id"), 2000, (("block_id", "of_block"),)),
    "data_flow_evidence": Lookup("data_flow_evidence", ("analysis_id",), ("!certainty", "relation", "source_access_id", "source_location_id", "target_access_id", "target_location_id", "id"), 2000),
    "function_summaries": Lookup("function_summaries", ("function_symbol_id",), ("build_variant", "build_configuration_id", "translation_unit_id", "id"), 100),
    "summary_effects": Lookup("summary_effects", ("summary_id",), ("!certainty", "-is_local", "kind", "id"), 1000),
    "summary_return_origins": Lookup("summary_return_origins", ("summary_id",), ("!certainty", "-is_local", "kind", "id"), 1000),
    "interprocedural_flows": Lookup("interprocedural_flows", ("caller_summary_id", "callee_summary_id"), ("!certainty", "!target_certainty", "kind", "callsite_id", "id"), 1000),
}


def order_of(lookup: Lookup) -> list:
    """Nulls come first in ascending columns."""
    out = []
    for c in lookup.order:
        if c[0] == "!":
            out.append(certain_first(c[1:]).asc())
        else:
            out.append(F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc_nulls_first())
    return out


def page(name: str, facts: DataFrame, key: str | None = None, scope: tuple[str, ...] | None = None, limit: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """One page of a lookup; key may match any of its key columns."""
    spec = LOOKUPS[name]
    rows = scope_filter(facts, scope)
    if key is not None:
        hit = F.col(spec.keys[0]) == key
        for k in spec.keys[1:]:
            hit = hit | (F.col(k) == key)
        rows = rows.where(hit)
    for column, alias in spec.blocks:
        rows = rows.join(blocks.select(F.col("id").alias(column), F.col("block_index").alias(alias)), column)
    return bounded_page(rows, order_of(spec), limit or spec.limit)


def point(facts: DataFrame, key: str, scope: tuple[str, ...] | None = None, column: str = "id") -> DataFrame:
    """The row with an id, if it is in scope."""
    return scope_filter(facts, scope).where(F.col(column) == key)


PREFERRED = ("is_definition DESC", "build_variant", "translation_unit_id", "id")


def preferred(variants: DataFrame, by: str = "symbol_id") -> DataFrame:
    """One row per symbol: a definition before others, then the first build, unit and id.

    min_by over a struct combines map-side, so a symbol with very many variants is no
    bottleneck.
    """
    rank = F.struct(~F.col("is_definition"), "build_variant", "translation_unit_id", "id")
    columns = [c for c in variants.columns if c != by]
    best = variants.groupBy(by).agg(F.min_by(F.struct(*columns), rank).alias("b"))
    return best.select(by, *[f"b.{c}" for c in columns])


def get_symbol(variants: DataFrame, key: str, scope: tuple[str, ...] | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The preferred variant whose symbol id or own id is key.

    With canonical symbols, and `default` in scope (or no scope), one of them is taken where no
    variant is found; the columns that it has not are null.
    """
    hits = scope_filter(variants, scope).where((F.col("symbol_id") == key) | (F.col("id") == key))
    order = [F.desc("is_definition"), F.col("build_variant"), F.col("translation_unit_id"), F.col("id")]
    if symbols is None or (scope is not None and "default" not in scope):
        return hits.orderBy(*order).limit(1)
    canonical = symbols.where(F.col("id") == key).select(F.col("id").alias("symbol_id"), *symbols.columns)
    canonical = canonical.withColumn("build_variant", F.lit("default")).withColumn("_kind", F.lit(1))
    every = hits.withColumn("_kind", F.lit(0)).unionByName(canonical.select(*[c for c in canonical.columns if c in (*hits.columns, "_kind")]), allowMissingColumns=True)
    return every.orderBy("_kind", *order).limit(1).drop("_kind")


def get_symbols(variants: DataFrame, keys: list[str], scope: tuple[str, ...] | None = None) -> DataFrame:
    """position, key and the variant of each key, in the given order with repeats; null where missing.

    A variant's own id beats the preferred variant of a symbol id.
    """
    rows = scope_filter(variants, scope)
    wanted = rows.sparkSession.createDataFrame(list(enumerate(keys)), "position int, key string")  # as many rows as were asked for
    hits = rows.where(F.col("id").isin(*keys) | F.col("symbol_id").isin(*keys))
    exact = hits.where(F.col("id").isin(*keys)).select(F.col("id").alias("key"), F.lit(0).alias("r"), "id", "qualified_name", "build_variant")
    symbol = preferred(hits).select(F.col("symbol_id").alias("key"), F.lit(1).alias("r"), "id", "qualified_name", "build_variant")
    best = exact.unionAll(symbol).groupBy("key").agg(F.min_by(F.struct("id", "qualified_name", "build_variant"), "r").alias("b"))
    return F.broadcast(wanted).join(best, "key", "left").select("position", "key", "b.id", "b.qualified_name", "b.build_variant")


def all_symbols(variants: DataFrame, symbols: DataFrame, scope: tuple[str, ...] | None) -> DataFrame:
    """Variants in scope, and canonical symbols without a variant if scope holds `default`."""
    found = scope_filter(variants, scope).select("symbol_id", "id", "qualified_name", "build_variant")
    if scope is not None and "default" not in scope:
        return found
    alone = standalone(variants, symbols).select(F.col("id").alias("symbol_id"), "id", "qualified_name", F.lit("default").alias("build_variant"))
    return found.unionAll(alone)


def standalone(variants: DataFrame, symbols: DataFrame) -> DataFrame:
    """Canonical symbols without variants."""
    return symbols.join(variants.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def translation_unit_states(units: DataFrame, configurations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Units with their configuration and sorted dependencies."""
    deps = dependencies.groupBy(F.col("translation_unit_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("path", "content_hash"))).alias("dependencies"))
    named = configurations.select(F.col("id").alias("build_configuration_id"), "source_path", "command_hash")
    empty = F.array().cast("array<struct<path:string,content_hash:string>>")
    return units.join(named, "build_configuration_id").join(deps, "id", "left").withColumn("dependencies", F.coalesce("dependencies", empty))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position at which each first came."""
    return df.groupBy(value).agg(F.min(position).alias(position))
