"""Interprocedural function summaries: effects and return origins carried over calls.

Callees come first. Up to ONE_GROUP functions, the call graph of each build is cut into its
connected parts, and each part is solved as one group. Larger graphs, and those of which a part
has more than ROWS moved effects, are solved level by level of their strongly connected
components: a function that is not recursive takes one step over its callees' solved rows by joins;
a recursive component is solved in groups, each with all its calls and a share of the accesses that
effects come from, as effects of different accesses never meet.

All is solved to the end, whatever the sizes. Only a caller that passes Limits has components and
effects cut where they say, and such summaries marked.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id, stable_id_python
from ..sources.staging import drop_staged, staged
from .graph import all_of, call_order, components, tarjan

MAX_PATH = 8
#: Functions up to which connected parts are solved as one group each.
ONE_GROUP = 20_000
#: Moved effects that one group should hold at most.
ROWS = 100_000
WRITTEN_THROUGH = ("reference", "pointer", "rvalue_reference")


@dataclass(frozen=True)
class Limits:
    """Where a caller wants the solution cut: rounds in a component, functions in one that is solved, effects of a function."""

    rounds: int = 32
    component: int = 128
    effects: int = 1024

    def __post_init__(self):
        if min(self.rounds, self.component, self.effects) < 1:
            raise ValueError("limits are at least one")


def both(*certain: bool) -> str:
    return "certain" if all(certain) else "possible"


class TooMany(Exception):
    """A group has more moved effects than it may hold."""


class Part:
    """One connected part of a build's call graph; tables are lists of dicts. Summaries that "solved" names stand as they are."""

    def __init__(self, tables: dict[str, list[dict]], limits: Limits | None, most: int | None = None):
        self.limits, self.most, self.made = limits, most, 0
        self.summaries = {s["id"]: s for s in sorted(tables["summaries"], key=lambda s: s["id"])}
        self.bind = {(b["caller_summary_id"], b["callsite_id"], b["argument_index"]): b for b in tables["bindings"]}
        self.result = {(r["caller_summary_id"], r["callsite_id"]): r for r in tables["results"]}
        solved = set(tables.get("solved", ()))
        self.open = [i for i in self.summaries if i not in solved]
        bodies, targets = defaultdict(list), defaultdict(list)
        for s in self.summaries.values():
            bodies[s["function_symbol_id"]].append(s)
        for t in tables["targets"]:
            targets[t["callsite_id"]].append(t)
        self.sites: dict[str, list] = {i: [] for i in self.summaries}
        place = lambda r: (r["translation_unit_id"], r["build_configuration_id"])
        of = defaultdict(list)
        for site in tables["sites"]:
            of[site["owner_symbol_id"], *place(site)].append(site)
        # of each caller: sites with their targets, and of each target the bodies it may run
        for i, s in self.summaries.items():
            for site in of[s["function_symbol_id"], *place(s)]:
                calls = []
                for t in targets[site["id"]]:
                    every = bodies[t["target_symbol_id"]]
                    calls.append((t, [x for x in every if place(x) == place(s)] or every))
                self.sites[i].append((site, calls))
        self.local = {k: {i: {} for i in self.summaries} for k in ("effects", "origins")}
        for k in self.local:
            for r in tables[k]:
                if r["summary_id"] in self.summaries:
                    self.local[k][r["summary_id"]][r["id"]] = r
        self.effects, self.origins = ({i: dict(sorted(x.items())) for i, x in self.local[k].items()} for k in self.local)
        self.reasons = {i: frozenset(s["local_incomplete_reasons"] or ()) for i, s in self.summaries.items()}

    def calls(self, caller: str):
        for site, calls in self.sites[caller]:
            for t, callees in calls:
                for callee in callees:
                    yield site, t, callee, len(callees) > 1

    def solve(self, flows: bool = True) -> dict[str, list[dict]]:
        calls = {i: {c["id"] for _, _, c, _ in self.calls(i)} & set(self.open) for i in self.open}
        rounds, recursive = {}, set()
        for members in tarjan(self.open, calls):
            recursive |= set(members) if len(members) > 1 else {m for m in members if m in calls[m]}
            if self.limits is None:
                rounds |= dict.fromkeys(members, self.settle(members))
                continue
            large = len(members) > self.limits.component
            converged = False
            for n in range(1, (1 if large else self.limits.rounds) + 1):
                new = {m: self.transfer(m, large) for m in members}
                converged = all(new[m] == (self.effects[m], self.origins[m], self.reasons[m]) for m in members)
                for m in members:
                    self.effects[m], self.origins[m], self.reasons[m] = new[m]
                    rounds[m] = n
                if converged:
                    break
            if not converged and not large:
                for m in members:
                    self.reasons[m] |= {"scc_iteration_cap_exceeded"}
        out = []
        for i in self.open:
            s, reasons = self.summaries[i], sorted(self.reasons[i])
            parts = [sorted((x["id"], x["certainty"]) for x in t[i].values()) for t in (self.effects, self.origins)]
            out.append(
                {k: s[k] for k in ("id", "function_symbol_id", "translation_unit_id", "build_configuration_id", "build_variant")}
                | {"complete": not reasons, "incomplete_reasons": reasons, "recursive": i in recursive, "iteration_count": rounds.get(i, 0)}
                | {"solution_hash": stable_id_python("solution", *parts, reasons)}
            )
        return {
            "summaries": out,
            "effects": [x for i in self.open for x in self.effects[i].values()],
            "origins": [x for i in self.open for x in self.origins[i].values()],
            "flows": self.flows() if flows else [],
        }

    def settle(self, members: list[str]) -> int:
        """Solves a component to its fixpoint; returns the rounds that takes.

        A round gives what transfer() of all members gives, but moves only rows that the last one changed.
        """
        above, asked = defaultdict(list), defaultdict(list)
        for m in members:
            results = {o.get("callsite_id") for o in self.local["origins"][m].values() if o["kind"] == "call_result"}
            for n, (site, t, callee, unsure) in enumerate(self.calls(m)):
                above[callee["id"]].append((m, n, site, t, unsure))
                if site["id"] in results:
                    asked[callee["id"]].append((m, n, site, t, unsure))
        rounds = max(self.spread(self.effects, above, self.rebased), self.spread(self.origins, asked, self.returned), self.explain(members, above))
        for m in members:
            self.effects[m], self.origins[m] = (dict(sorted(x[m].items())) for x in (self.effects, self.origins))
        return rounds

    def spread(self, rows: dict[str, dict], above: dict[str, list], move) -> int:
        """Moves rows to the callers `above` until none changes. Of equal moved rows the last in the order of calls and ids counts."""
        last, n, still = {}, 0, 0
        changed = [(callee, r) for callee in above for r in rows[callee].values()]
        while changed or not n:
            n, new, still = n + 1, {}, still + 1
            for callee, r in changed:
                for caller, place, site, t, unsure in above.get(callee, ()):
                    moved = move(caller, site, t, r, unsure)
                    if moved is None:
                        continue
                    key, at = (caller, moved["id"]), (place, r["id"])
                    old = last.get(key)
                    if old is None or at >= old:
                        new[key] = moved
                        if at != old:
                            last[key], still = at, 0
                            self.made += old is None
                            if self.most is not None and self.made > self.most:
                                raise TooMany
            changed = []
            for (caller, i), moved in new.items():
                old = rows[caller].get(i)
                if old is not None and still > len(last) + 1:
                    # values that go round in a loop of calls for ever: the less certain one stays
                    moved["certainty"] = both(moved["certainty"] == "certain", old["certainty"] == "certain")
                    moved["location_id"] = max(moved["location_id"], old["location_id"], key=str)
                if moved != old:
                    rows[caller][i] = moved
                    changed.append((caller, moved))
        return n

    def explain(self, members: list[str], above: dict[str, list]) -> int:
        """Reasons of a component's members, until none changes."""
        why = "callee_summary_incomplete"
        new = {m: frozenset(self.said(m) | ({why} if any(self.reasons[c["id"]] for _, _, c, _ in self.calls(m)) else set())) for m in members}
        n = 0
        while True:
            n += 1
            new = {m: r for m, r in new.items() if r != self.reasons[m]}
            if not new:
                return n
            bad = [m for m in new if not self.reasons[m]]
            self.reasons |= new
            new = {caller: self.reasons[caller] | {why} for m in bad for caller, *_ in above.get(m, ())}

    def said(self, caller: str) -> set[str]:
        """Reasons in a caller's own facts, its calls and their bindings."""
        reasons = set(self.summaries[caller]["local_incomplete_reasons"] or ())
        for site, calls in self.sites[caller]:
            if not site["target_set_complete"] or not calls:
                reasons.add("unknown_or_external_call_target")
            for _, callees in calls:
                if not callees:
                    reasons |= {"external_or_unindexed_callee_body", "unknown_or_external_call_target"}
                if len(callees) > 1:
                    reasons.add("multiple_callee_body_variants")
                for callee in callees:
                    for k in range(len(callee["parameter_location_ids"] or ())):
                        b = self.bind.get((caller, site["id"], k))
                        if b is None:
                            reasons.add("missing_call_argument_binding")
                        elif not b["complete"]:
                            reasons.add("incomplete_call_argument_binding")
        return reasons

    def transfer(self, caller: str, large: bool):
        """Effects, origins and reasons of a caller from its own facts and its callees as they stand."""
        reasons = self.said(caller)
        if large:
            reasons.add("scc_size_cap_exceeded")
        effects, origins = dict(self.local["effects"][caller]), dict(self.local["origins"][caller])
        for site, calls in self.sites[caller]:
            for t, callees in calls:
                unsure = len(callees) > 1
                for callee in callees:
                    if self.reasons[callee["id"]]:
                        reasons.add("callee_summary_incomplete")
                    for e in self.effects[callee["id"]].values():
                        moved = self.rebased(caller, site, t, e, unsure)
                        if moved is not None:
                            effects[moved["id"]] = moved
                    for o in list(origins.values()):
                        if o["kind"] == "call_result" and o.get("callsite_id") == site["id"]:
                            for x in self.origins[callee["id"]].values():
                                moved = self.returned(caller, site, t, x, unsure)
                                origins[moved["id"]] = moved
        ordered = dict(sorted(effects.items()))
        if len(ordered) > self.limits.effects:
            ordered = dict(list(ordered.items())[: self.limits.effects])
            reasons.add("summary_effect_cap_exceeded")
        return ordered, dict(sorted(origins.items())), frozenset(reasons)

    def place_of(self, caller: str, site: dict, fact: dict):
        """Where a callee's storage lies in the caller: the binding's place with the paths joined; None if unbound."""
        b = self.bind.get((caller, site["id"], fact["parameter_index"]))
        if b is None:
            return None
        path = ((b["access_path"] or []) + (fact["access_path"] or []))[:MAX_PATH]
        return {"location_kind": b["location_kind"], "parameter_index": b["parameter_index"], "access_path": path, "location_id": b["location_id"]}

    def moved(self, caller: str, site: dict, t: dict, fact: dict, unsure: bool, at: dict) -> dict:
        return at | {
            "summary_id": caller,
            "certainty": both(t["certainty"] == "certain", fact["certainty"] == "certain", not unsure),
            "is_local": False,
            "via_callsite_id": site["id"],
            "target_symbol_id": t["target_symbol_id"],
        }

    def rebased(self, caller: str, site: dict, t: dict, e: dict, unsure: bool) -> dict | None:
        if e["parameter_index"] is not None:
            at = self.place_of(caller, site, e)
            if at is None:
                return None
        elif e["location_kind"] in ("global", "field"):
            at = {k: e[k] for k in ("location_kind", "parameter_index", "access_path", "location_id")}
        else:
            return None
        # keyed by the access it came from, so recursion adds no rows
        key = (caller, e["kind"], at["location_kind"], at["parameter_index"], at["access_path"], site["id"], t["target_symbol_id"], e["source_access_id"])
        return self.moved(caller, site, t, e, unsure, at) | {"id": stable_id_python("summary_effect", *key), "kind": e["kind"], "source_access_id": e["source_access_id"]}

    def returned(self, caller: str, site: dict, t: dict, o: dict, unsure: bool) -> dict:
        at = {k: o[k] for k in ("location_kind", "parameter_index", "access_path", "location_id")}
        if o["parameter_index"] is not None:
            at = self.place_of(caller, site, o) or {"location_kind": "unknown", "parameter_index": None, "access_path": [], "location_id": None}
        key = (caller, site["id"], t["target_symbol_id"], at["location_kind"], at["parameter_index"], at["access_path"], at["location_id"])
        kind = "location" if at["location_kind"] is not None else "unknown"
        return self.moved(caller, site, t, o, unsure, at) | {"id": stable_id_python("summary_return", *key), "kind": kind, "callsite_id": None}

    def flows(self) -> list[dict]:
        out: dict[str, dict] = {}

        def add(kind: str, caller: str, callee: dict, site: dict, t: dict, sure: bool, index=None, own=None, other=None, access=None) -> None:
            key = (kind, caller, callee["id"], site["id"], t["target_symbol_id"], index, own, other, access)
            i = stable_id_python("interprocedural_flow", *key)
            out[i] = {
                "id": i, "kind": kind, "caller_summary_id": caller, "callee_summary_id": callee["id"], "callsite_id": site["id"],
                "target_symbol_id": t["target_symbol_id"], "target_certainty": t["certainty"], "certainty": both(t["certainty"] == "certain", sure),
                "argument_index": index, "caller_location_id": own, "callee_location_id": other, "caller_access_id": access, "build_variant": site["build_variant"],
            }

        for caller in self.open:
            for site, t, callee, unsure in self.calls(caller):
                for k, location in enumerate(callee["parameter_location_ids"] or ()):
                    b = self.bind.get((caller, site["id"], k))
                    if b is not None:
                        add("argument_to_parameter", caller, callee, site, t, b["complete"] and not unsure, k, b["location_id"], location)
                for e in self.effects[callee["id"]].values():
                    k = e["parameter_index"]
                    if e["kind"] != "write" or k is None or (callee["parameter_modes"] or [])[k : k + 1] == [] or callee["parameter_modes"][k] not in WRITTEN_THROUGH:
                        continue
                    b = self.bind.get((caller, site["id"], k))
                    if b is not None and b["writeback_candidate"]:
                        add("writeback", caller, callee, site, t, e["certainty"] == "certain" and b["complete"] and not unsure, k, b["location_id"], e["location_id"])
                r = self.result.get((caller, site["id"]))
                if r is not None:
                    for o in self.origins[callee["id"]].values():
                        add("return_to_caller", caller, callee, site, t, o["certainty"] == "certain" and not unsure, None, r["location_id"], o["location_id"], r["definition_access_id"])
        return [out[i] for i in sorted(out)]


SCHEMAS = {
    "summaries": "id string, function_symbol_id string, translation_unit_id string, build_configuration_id string, build_variant string, complete boolean, incomplete_reasons array<string>, recursive boolean, iteration_count int, solution_hash string",
    "effects": "id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path array<string>, location_id string, source_access_id string, is_local boolean, via_callsite_id string, target_symbol_id string",
    "origins": "id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path array<string>, location_id string, callsite_id string, is_local boolean, via_callsite_id string, target_symbol_id string",
    "flows": "id string, kind string, caller_summary_id string, callee_summary_id string, callsite_id string, target_symbol_id string, target_certainty string, certainty string, argument_index int, caller_location_id string, callee_location_id string, caller_access_id string, build_variant string",
}
INPUTS = ("summaries", "effects", "origins", "bindings", "results", "sites", "targets")


def solve(tables: dict[str, DataFrame], limits: Limits | None = None, hashes: bool = True) -> dict[str, DataFrame]:
    """Solved summaries, effects, origins and flows of every build from the tables in INPUTS, whole unless limits are given.

    Without hashes, a graph that is solved by levels has none in its summaries.
    """
    if tables["summaries"].count() > ONE_GROUP:
        return Levels(tables, limits).solve(hashes)
    summaries = tables["summaries"]
    owner = summaries.select(F.concat_ws(":", "build_variant", "function_symbol_id").alias("f"), "id", "function_symbol_id", "translation_unit_id", "build_configuration_id", "build_variant")
    sites = tables["sites"].select(F.col("id").alias("callsite_id"), "owner_symbol_id", "build_variant")
    calls = tables["targets"].select("callsite_id", "target_symbol_id").join(sites, "callsite_id")
    links = calls.select(F.concat_ws(":", "build_variant", "owner_symbol_id").alias("a"), F.concat_ws(":", "build_variant", "target_symbol_id").alias("b"))
    part = components(links)

    of_summary = owner.select(F.col("id").alias("sid"), "f")
    of_site = tables["sites"].select(F.col("id").alias("sid"), F.concat_ws(":", "build_variant", "owner_symbol_id").alias("f"))

    def placed(joined: DataFrame, columns: list[str]) -> DataFrame:
        """Rows as JSON with the part of their function `f`; a function without calls is a part of its own."""
        flat = joined.select("f", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
        return flat.join(part, flat["f"] == part["id"], "left").select(F.coalesce("component", "f").alias("part"), "row")

    def through(df: DataFrame, column: str, owners: DataFrame) -> DataFrame:
        return placed(df.join(owners, df[column] == owners["sid"]), df.columns)

    rows = {
        "summaries": placed(summaries.withColumn("f", F.concat_ws(":", "build_variant", "function_symbol_id")), summaries.columns),
        "sites": placed(tables["sites"].withColumn("f", F.concat_ws(":", "build_variant", "owner_symbol_id")), tables["sites"].columns),
        "targets": through(tables["targets"], "callsite_id", of_site),
        "effects": through(tables["effects"], "summary_id", of_summary),
        "origins": through(tables["origins"], "summary_id", of_summary),
        "bindings": through(tables["bindings"], "caller_summary_id", of_summary),
        "results": through(tables["results"], "caller_summary_id", of_summary),
    }
    every = None
    for kind, df in rows.items():
        df = df.select("part", F.lit(kind).alias("kind"), "row")
        every = df if every is None else every.unionAll(df)

    most = ROWS if limits is None else None

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        given: dict[str, list] = {k: [] for k in INPUTS}
        for kind, row in sorted(zip(pdf["kind"], pdf["row"])):
            given[kind].append(json.loads(row))
        try:
            solved = Part(given, limits, most).solve()
        except TooMany:
            solved = {"over": [{}]}
        return pd.DataFrame([(k, json.dumps(r)) for k, rs in solved.items() for r in rs], columns=["kind", "row"])

    solved = every.groupBy("part").applyInPandas(run, "kind string, row string")
    if limits is None:
        solved = staged(solved, "solver-parts")
        if not solved.where("kind = 'over'").isEmpty():
            drop_staged(solved)
            return Levels(tables, limits).solve(hashes)
    return {k: solved.where(F.col("kind") == k).select(F.from_json("row", schema).alias("r")).select("r.*") for k, schema in SCHEMAS.items()}


def text(value: Column) -> Column:
    """As Python's str()."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def quoted(value: Column) -> Column:
    """As Python's repr() of a string of printable characters, line ends and tabs."""
    for c, escape in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(c), F.lit(escape))
    plain = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("\\'")), F.lit("'"))
    out = F.when(F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"')), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(plain)
    return F.coalesce(out, F.lit("None"))


def listed(values: Column, of=quoted) -> Column:
    """As Python's str() of a list."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, of), ", "), F.lit("]")), F.lit("None"))


class Levels:
    """The solution of a call graph level by level, in tables of effects and origins without the ids of moved rows, which follow from the rest."""

    def __init__(self, tables: dict[str, DataFrame], limits: Limits | None):
        self.tables, self.limits = tables, limits
        place = ["translation_unit_id", "build_configuration_id"]
        self.s = s = staged(tables["summaries"].dropDuplicates(["id"]).withColumn("f", F.concat_ws(":", "build_variant", "function_symbol_id")), "solver-s")
        sites = tables["sites"].select(F.col("id").alias("callsite_id"), F.concat_ws(":", "build_variant", "owner_symbol_id").alias("f"), "build_variant", "target_set_complete", *place).distinct()
        own = s.select(F.col("id").alias("caller"), F.col("f").alias("of"), *[F.col(p).alias(f"own_{p}") for p in place])
        same = F.col("translation_unit_id").eqNullSafe(F.col("own_translation_unit_id")) & F.col("build_configuration_id").eqNullSafe(F.col("own_build_configuration_id"))
        at = own.join(sites, (F.col("of") == F.col("f")) & same).drop("of", "f", *place)
        t = tables["targets"]
        t = t.select("callsite_id", "target_symbol_id", F.col("certainty").alias("target_certainty"), F.to_json(F.struct(*t.columns)).alias("j")).distinct()
        t = t.select("callsite_id", "target_symbol_id", "target_certainty", F.row_number().over(Window.partitionBy("callsite_id").orderBy("j")).alias("pos"))
        t = t.withColumn("target", F.lit(True))
        at = at.join(t, "callsite_id", "left").withColumn("f", F.concat_ws(":", "build_variant", "target_symbol_id"))
        body = s.select(F.col("id").alias("callee"), "f", *place, "parameter_modes", "parameter_location_ids")
        at = at.join(body, "f", "left").withColumn("here", F.coalesce(F.col("target") & F.col("callee").isNotNull() & same, F.lit(False)))
        one = Window.partitionBy("caller", "callsite_id", "build_variant", "target_set_complete", "pos")
        at = at.withColumn("any", F.max("here").over(one)).where("here OR NOT any")
        at = at.withColumn("callee", F.when(F.col("target"), F.col("callee"))).withColumn("unsure", F.count("callee").over(one) > 1)
        b = tables["bindings"]
        b = b.where("argument_index IS NOT NULL").groupBy("caller_summary_id", "callsite_id", "argument_index").agg(F.max_by(F.struct(*b.columns), F.to_json(F.struct(*b.columns), {"ignoreNullFields": "false"})).alias("b"))
        b = b.withColumn("b", F.struct(*[F.col(f"b.{c}").alias(c) for c in ("location_kind", "parameter_index", "access_path", "location_id", "writeback_candidate", "complete")]))
        b = b.groupBy(F.col("caller_summary_id").alias("caller"), "callsite_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("argument_index").cast("int"), "b"))).alias("bound"))
        at = at.join(b, ["caller", "callsite_id"], "left")
        calls = staged(at.select("caller", "callsite_id", "build_variant", "target_set_complete", "target", "pos", "target_symbol_id", "target_certainty", "callee", "unsure", "parameter_modes", "parameter_location_ids", "bound"), "solver-calls")
        order = call_order(calls.where("callee IS NOT NULL").select(F.col("caller").alias("a"), F.col("callee").alias("b")))
        loops = calls.where("caller = callee").select(F.col("caller").alias("id")).distinct().withColumn("loop", F.lit(True))
        n = s.select("id").join(order, "id", "left").join(loops, "id", "left")
        n = n.select(F.col("id").alias("s"), F.coalesce("component", "id").alias("component"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("loop", F.lit(False)).alias("loop"))
        large, recursive = F.lit(False) if limits is None else F.col("size") > limits.component, F.col("loop") | (F.col("size") > 1)
        self.nodes = staged(n.select("s", "component", "level", recursive.alias("recursive"), F.when(large, "large").when(recursive, "group").otherwise("plain").alias("way")), "solver-nodes")
        caller = self.nodes.select(F.col("s").alias("caller"), "component", "level", "way")
        callee = self.nodes.select(F.col("s").alias("callee"), F.col("component").alias("other"))
        joined = calls.join(caller, "caller").join(callee, "callee", "left").withColumn("inner", F.coalesce(F.col("other") == F.col("component"), F.lit(False)))
        self.calls = staged(joined, "solver-calls")
        drop_staged(calls)
        self.unsure = not self.calls.where("unsure").isEmpty()
        self.local = {k: staged(self.given(k), f"solver-{k}") for k in ("effects", "origins")}
        self.results = not self.local["origins"].where("kind = 'call_result'").isEmpty()
        self.parts: dict[str, list[DataFrame]] = {"effects": [], "origins": [], "reasons": []}

    def given(self, kind: str) -> DataFrame:
        """Local rows: of those with one id in a summary the last, as JSON, counts."""
        df = self.tables[kind].join(self.s.select(F.col("id").alias("summary_id")), "summary_id", "left_semi")
        last = df.groupBy("summary_id", "id").agg(F.max_by(F.struct(*df.columns), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("r")).select("r.*")
        return self.shaped(last, kind)

    def shaped(self, df: DataFrame, kind: str) -> DataFrame:
        """Columns as in SCHEMAS, those that are not there null."""
        schema = df.sparkSession.createDataFrame([], SCHEMAS[kind]).schema
        return df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema])

    @staticmethod
    def named(df: DataFrame, kind: str) -> DataFrame:
        """With the ids of moved rows."""
        if kind == "effects":
            moved = stable_id("summary_effect", *[text(F.col(c)) for c in ("summary_id", "kind", "location_kind", "parameter_index")], listed(F.col("access_path")), *[text(F.col(c)) for c in ("via_callsite_id", "target_symbol_id", "source_access_id")])
        else:
            moved = stable_id("summary_return", *[text(F.col(c)) for c in ("summary_id", "via_callsite_id", "target_symbol_id", "location_kind", "parameter_index")], listed(F.col("access_path")), text(F.col("location_id")))
        return df.withColumn("id", F.coalesce("id", moved))

    def solved(self, kind: str) -> DataFrame | None:
        return all_of(self.parts[kind]) if self.parts[kind] else None

    def joined(self, kind: str, calls: DataFrame) -> DataFrame | None:
        """Calls with their callees' rows `e`, as solved, or local ones within a large component."""
        out = None
        for rows, some in ((self.solved(kind), calls.where("NOT inner")), (self.local[kind], calls.where("inner"))):
            if rows is not None and (rows is not self.local[kind] or self.inner):
                e = self.named(rows, kind).select(F.col("summary_id").alias("callee"), F.struct(*rows.columns).alias("e"))
                met = some.join(e, "callee")
                out = met if out is None else out.unionAll(met)
        return out

    def step(self, kind: str, calls: DataFrame) -> DataFrame | None:
        """Moved rows of the callers of calls, each once; of equal ones the last in the order of targets, bodies and ids counts."""
        met = self.joined(kind, calls)
        if met is None:
            return None
        b = F.try_element_at("bound", F.col("e.parameter_index"))
        path = F.slice(F.concat(F.coalesce(F.col("b.access_path"), F.array().cast("array<string>")), F.coalesce(F.col("e.access_path"), F.array().cast("array<string>"))), 1, MAX_PATH)
        has = F.col("e.parameter_index").isNotNull()
        met = met.withColumn("b", F.when(has, b))
        if kind == "effects":
            met = met.where(F.when(has, F.col("b").isNotNull()).otherwise(F.coalesce(F.col("e.location_kind").isin("global", "field"), F.lit(False))))
            kept, key = {"source_access_id": F.col("e.source_access_id"), "kind": F.col("e.kind")}, ["kind", "location_kind", "parameter_index", "access_path", "source_access_id"]
            ends = {}
        else:
            key, ends = ["location_kind", "parameter_index", "access_path", "location_id"], {"location_kind": F.lit("unknown"), "access_path": F.array().cast("array<string>")}
            kept = {}
        unbound = has & F.col("b").isNull()
        at = {c: F.when(unbound, ends.get(c, F.lit(None))).when(has, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")) for c in ("location_kind", "parameter_index", "location_id")}
        at["access_path"] = F.when(unbound, ends.get("access_path", F.lit(None))).when(has, path).otherwise(F.col("e.access_path"))
        certain = F.coalesce((F.col("target_certainty") == "certain") & (F.col("e.certainty") == "certain"), F.lit(False)) & ~F.col("unsure")
        rows = met.select("caller", "callsite_id", "target_symbol_id", "callee", "pos", *[c.alias(k) for k, c in (at | kept).items()], certain.alias("certain"), F.col("e.id").alias("eid"))
        by = ["caller", "callsite_id", "target_symbol_id", *key]
        last = rows.groupBy("callee", *by).agg(F.max_by(F.struct("certain", "location_id"), F.struct("pos", "callee", "eid")).alias("v"), F.max(F.struct("pos", "callee", "eid")).alias("o") if self.unsure else F.lit(None).alias("o"))
        if self.unsure:
            last = last.groupBy(*by).agg(F.max_by("v", "o").alias("v"))
        place = F.col("location_id") if "location_id" in key else F.col("v.location_id")
        out = last.select(*by, place.alias("location_id_"), F.when(F.col("v.certain"), "certain").otherwise("possible").alias("certainty")).drop("location_id").withColumnRenamed("location_id_", "location_id")
        out = out.withColumnsRenamed({"caller": "summary_id", "callsite_id": "via_callsite_id"}).withColumn("is_local", F.lit(False))
        if kind == "origins":
            out = out.withColumn("kind", F.when(F.col("location_kind").isNotNull(), "location").otherwise("unknown"))
        return self.shaped(out, kind)

    def solve(self, hashes: bool) -> dict[str, DataFrame]:
        self.inner = not self.nodes.where("way = 'large'").isEmpty()
        found = self.nodes.groupBy("level").agg(F.count_if(F.col("way") == "group").alias("groups")).orderBy("level").collect()
        static = staged(self.reasons_of_calls(), "solver-reasons")
        for level, groups in found:
            self.level(level, groups, static)
        r = all_of(self.parts["reasons"])
        out = self.s.join(r, self.s["id"] == r["s"]).withColumn("complete", F.size("incomplete_reasons") == 0)
        if hashes:
            pair = lambda x: F.concat(F.lit("("), quoted(x["id"]), F.lit(", "), quoted(x["certainty"]), F.lit(")"))
            for k in ("effects", "origins"):
                ids = self.named(self.solved(k), k).groupBy(F.col("summary_id").alias("s")).agg(F.sort_array(F.collect_list(F.struct("id", "certainty"))).alias(f"of_{k}"))
                out = out.join(ids, "s", "left").withColumn(k, F.when(F.col(f"of_{k}").isNull(), "[]").otherwise(listed(F.col(f"of_{k}"), pair)))
            out = out.withColumn("solution_hash", stable_id("solution", F.col("effects"), F.col("origins"), listed(F.col("incomplete_reasons"))))
        return {"summaries": self.shaped(out, "summaries"), "effects": self.shaped(self.named(self.solved("effects"), "effects"), "effects"), "origins": self.shaped(self.named(self.solved("origins"), "origins"), "origins"), "flows": self.flows()}

    def reasons_of_calls(self) -> DataFrame:
        """(s, reasons): what a caller's sites, targets, bodies and bindings say, and its own reasons."""
        k = F.sequence(F.lit(0), F.size("parameter_location_ids") - 1)
        some = F.col("callee").isNotNull() & F.coalesce(F.size("parameter_location_ids") > 0, F.lit(False))
        b = lambda x: F.try_element_at("bound", x)
        tests = {
            "unknown_or_external_call_target": ~F.coalesce("target_set_complete", F.lit(False)) | F.col("target").isNull() | F.col("callee").isNull(),
            "external_or_unindexed_callee_body": F.col("target").isNotNull() & F.col("callee").isNull(),
            "multiple_callee_body_variants": F.col("unsure"),
            "missing_call_argument_binding": F.when(some, F.col("bound").isNull() | F.exists(k, lambda x: b(x).isNull())),
            "incomplete_call_argument_binding": F.when(some & F.col("bound").isNotNull(), F.exists(k, lambda x: b(x).isNotNull() & ~F.coalesce(b(x)["complete"], F.lit(False)))),
        }
        said = self.calls.groupBy("caller").agg(*[F.max(F.coalesce(t, F.lit(False))).alias(r) for r, t in tests.items()])
        every = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in tests]), lambda x: x.isNotNull())
        none = F.array().cast("array<string>")
        own = self.s.select(F.col("id").alias("s"), F.array_distinct(F.coalesce("local_incomplete_reasons", none)).alias("own"))
        joined = own.join(said.select(F.col("caller").alias("s"), every.alias("said")), "s", "left")
        return joined.select("s", "own", F.array_union("own", F.coalesce("said", none)).alias("reasons"))

    def level(self, level: int, groups: int, static: DataFrame) -> None:
        nodes = self.nodes.where((F.col("level") == level) & (F.col("way") != "group"))
        calls = self.calls.where((F.col("level") == level) & (F.col("way") != "group") & F.col("callee").isNotNull())
        solved = self.in_groups(level) if groups else None
        own = nodes.select(F.col("s").alias("summary_id"))
        for kind in ("effects", "origins"):
            rows = self.local[kind].join(own, "summary_id", "left_semi").select(*self.local[kind].columns)
            if kind == "effects":
                moved = self.step(kind, calls)
            else:
                asked = self.local[kind].where("kind = 'call_result'").select(F.col("summary_id").alias("caller"), "callsite_id").distinct()
                moved = self.step(kind, calls.join(asked, ["caller", "callsite_id"], "left_semi")) if self.results else None
            if moved is not None:
                rows = rows.unionAll(moved)
            if solved is not None:
                made = self.from_json(solved, kind, SCHEMAS[kind])
                rows = rows.unionAll(self.shaped(made.withColumn("id", F.when(~F.coalesce(F.col("is_local") == F.lit(False), F.lit(False)) | F.col("via_callsite_id").isNull(), F.col("id"))), kind))
            rows = staged(rows, f"solver-{kind}")
            if kind == "effects":
                size = rows.join(own, "summary_id", "left_semi").groupBy(F.col("summary_id").alias("s")).agg(F.count("*").alias("n"), F.max(F.col("id").isNull()).alias("more"))
                size = staged(size, "solver-size")
                over = size.where(self.over())
                if self.limits is not None and not over.isEmpty():
                    ranked = self.named(rows.join(over.select(F.col("s").alias("summary_id")), "summary_id", "left_semi"), kind).withColumn("n", F.row_number().over(Window.partitionBy("summary_id").orderBy("id")))
                    cut = ranked.where(F.col("n") <= self.limits.effects).select(*rows.columns)
                    rest = rows.join(over.select(F.col("s").alias("summary_id")), "summary_id", "left_anti").select(*rows.columns)
                    rows, old = staged(rest.unionAll(cut), "solver-effects"), rows
                    drop_staged(old)
            else:
                origins = rows.where("id IS NULL").select(F.col("summary_id").alias("s")).distinct().withColumn("result", F.lit(True))
            self.parts[kind].append(rows)
        self.parts["reasons"].append(staged(self.reasons(nodes, calls, static, size, origins, solved), "solver-reasons"))
        drop_staged(size, *([solved] if solved is not None else []))

    def over(self) -> Column:
        """Whether a function's `n` effects are more than the limit, if there is one."""
        return F.lit(False) if self.limits is None else F.col("n") > self.limits.effects

    def reasons(self, nodes: DataFrame, calls: DataFrame, static: DataFrame, size: DataFrame, origins: DataFrame, solved: DataFrame | None) -> DataFrame:
        """(s, incomplete_reasons, recursive, iteration_count) of the functions of a level."""
        bad = None
        if self.parts["reasons"]:
            bad = calls.where("NOT inner").join(self.solved("reasons").where(F.size("incomplete_reasons") > 0).select(F.col("s").alias("callee")), "callee", "left_semi").select("caller")
        if self.inner:
            near = calls.where("inner").join(static.where(F.size("own") > 0).select(F.col("s").alias("callee")), "callee", "left_semi").select("caller")
            bad = near if bad is None else bad.unionAll(near)
        r = nodes.join(static, "s").join(size, "s", "left").join(origins, "s", "left")
        if bad is not None:
            r = r.join(bad.select(F.col("caller").alias("s")).distinct().withColumn("bad", F.lit(True)), "s", "left")
        large = F.col("way") == "large"
        more = [F.when(large, F.lit("scc_size_cap_exceeded")), F.when(self.over(), F.lit("summary_effect_cap_exceeded"))]
        if bad is not None:
            more.append(F.when(F.col("bad"), F.lit("callee_summary_incomplete")))
        r = r.withColumn("reasons", F.array_union("reasons", F.filter(F.array(*more), lambda x: x.isNotNull())))
        changed = F.coalesce("more", F.lit(False)) | F.coalesce("result", F.lit(False)) | (F.size("reasons") > F.size("own")) | F.coalesce(self.over(), F.lit(False))
        rounds = 2 if self.limits is None else min(2, self.limits.rounds)
        if rounds == 1:
            r = r.withColumn("reasons", F.when(changed & ~large, F.array_union("reasons", F.array(F.lit("scc_iteration_cap_exceeded")))).otherwise(F.col("reasons")))
        n = F.when(large | ~changed, 1).otherwise(rounds)
        out = r.select("s", F.array_sort("reasons").alias("incomplete_reasons"), "recursive", n.cast("int").alias("iteration_count"))
        if solved is not None:
            # all groups of a component say the same but for the rounds that their effects took
            made = self.from_json(solved, "summaries", SCHEMAS["summaries"]).groupBy(F.col("id").alias("s"))
            out = out.unionAll(made.agg(F.max_by("incomplete_reasons", "iteration_count"), F.bool_or("recursive"), F.max("iteration_count")))
        return out

    @staticmethod
    def from_json(solved: DataFrame, kind: str, schema: str) -> DataFrame:
        return solved.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*")

    def in_groups(self, level: int) -> DataFrame:
        """(kind, row) of the level's recursive functions, each component solved over its callees' solved rows.

        A component's effects are dealt to groups by the access they come from, so that a group has about
        ROWS of them at most, or those of one access; each group knows all calls, and the first the origins.
        """
        mine = staged(self.nodes.where((F.col("level") == level) & (F.col("way") == "group")).select("s", "component"), "solver-open")
        calls = self.calls.where((F.col("level") == level) & (F.col("way") == "group"))
        done = staged(calls.where("NOT inner AND callee IS NOT NULL").select(F.col("callee").alias("s"), "component").distinct(), "solver-done")
        rows = lambda df, kind: df.select("component", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c not in ("component", "s_")]), {"ignoreNullFields": "false"}).alias("row"))
        through = lambda df, column, who: df.join(who.withColumnRenamed("s", "s_"), df[column] == F.col("s_"))
        at = calls.select("component", F.col("callsite_id").alias("s")).distinct()
        every = [rows(through(self.s.drop("f"), "id", mine), "summaries"), rows(through(self.tables["targets"], "callsite_id", at), "targets")]
        # a site counts for owners within the group, as they are found by symbol and place
        every.append(rows(through(self.tables["sites"], "id", at), "sites"))
        every += [rows(through(self.local[k], "summary_id", mine), k) for k in ("effects", "origins")]
        every += [rows(through(self.tables[k], "caller_summary_id", mine), k) for k in ("bindings", "results")]
        if self.parts["reasons"]:
            r = self.solved("reasons").select(F.col("s").alias("s_id"), F.col("incomplete_reasons"))
            s = through(self.s.drop("f"), "id", done)
            s = s.join(r, s["id"] == r["s_id"]).withColumn("local_incomplete_reasons", F.col("incomplete_reasons")).drop("s_id", "incomplete_reasons")
            every.append(rows(s, "summaries"))
            every += [rows(through(self.named(self.solved(k), k), "summary_id", done), k) for k in ("effects", "origins")]
            every.append(done.select("component", F.lit("solved").alias("kind"), F.to_json(F.struct("s")).alias("row")))
        table = every[0]
        for df in every[1:]:
            table = table.unionAll(df)
        width = self.groups(calls, mine, done)
        share = F.when(F.col("kind") == "effects", F.pmod(F.xxhash64(F.get_json_object("row", "$.source_access_id")), "groups"))
        shares = F.when(F.col("kind").isin("effects", "origins"), F.array(F.coalesce(share, F.lit(0).cast("bigint")))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))
        table = table.join(width, "component").withColumn("share", F.explode(shares)).select("component", "share", "kind", "row")
        limits = self.limits

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            given: dict[str, list] = {k: [] for k in (*INPUTS, "solved")}
            for kind, row in sorted(zip(pdf["kind"], pdf["row"])):
                given[kind].append(json.loads(row))
            given["solved"] = [x["s"] for x in given["solved"]]
            out = Part(given, limits).solve(flows=False)
            return pd.DataFrame([(k, json.dumps(r)) for k in ("summaries", "effects", "origins") for r in out[k]], columns=["kind", "row"])

        out = staged(table.groupBy("component", "share").applyInPandas(run, "kind string, row string"), "solver-groups")
        drop_staged(mine, done)
        return out

    def groups(self, calls: DataFrame, mine: DataFrame, done: DataFrame) -> DataFrame:
        """(component, groups) of a level's recursive components; with limits, which count all effects of a function, one group."""
        if self.limits is not None:
            return mine.select("component", F.lit(1).cast("bigint").alias("groups")).distinct()
        met = self.local["effects"].select(F.col("summary_id").alias("s"), "source_access_id").join(mine, "s")
        if self.parts["effects"]:
            met = met.unionByName(self.solved("effects").select(F.col("summary_id").alias("s"), "source_access_id").join(done, "s"))
        accesses = met.groupBy("component").agg(F.count_distinct(F.coalesce("source_access_id", F.lit(""))).alias("accesses"))
        size = calls.groupBy("component").agg(F.count("*").alias("calls")).join(accesses, "component", "left")
        n = F.least(F.ceil(F.col("calls") * F.col("accesses") / ROWS), F.col("accesses"))
        return size.select("component", F.coalesce(F.greatest(n, F.lit(1)), F.lit(1)).cast("bigint").alias("groups"))

    def flows(self) -> DataFrame:
        """Cross-call flows over solved effects and origins."""
        calls = self.calls.where("callee IS NOT NULL")
        sure = ~F.col("unsure")
        none = F.lit(None).cast("string")
        base = ["caller", "callee", "callsite_id", "target_symbol_id", "target_certainty", "build_variant", "pos"]

        def flow(df: DataFrame, kind: str, sure: Column, index: Column, own: Column, other: Column, access: Column, order: Column) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), *base, F.coalesce(sure, F.lit(False)).alias("sure"), index.cast("int").alias("argument_index"), own.alias("own"), other.alias("other"), access.alias("access"), order.alias("o"))

        passed = calls.select("*", F.posexplode("parameter_location_ids").alias("k", "location")).withColumn("b", F.try_element_at("bound", F.col("k"))).where("b IS NOT NULL")
        every = flow(passed, "argument_to_parameter", F.coalesce(F.col("b.complete"), F.lit(False)) & sure, F.col("k"), F.col("b.location_id"), F.col("location"), none, none)
        # an effect counts by parameter and place: of equal ones the last by id
        e = self.named(self.solved("effects").where("kind = 'write' AND parameter_index IS NOT NULL"), "effects").groupBy(F.col("summary_id").alias("callee"), F.col("parameter_index").alias("k"), "location_id").agg(F.max(F.struct("id", "certainty")).alias("e"))
        back = calls.join(e, "callee").withColumn("b", F.try_element_at("bound", F.col("k")))
        back = back.where(F.get("parameter_modes", F.col("k")).isin(*WRITTEN_THROUGH) & F.col("b.writeback_candidate"))
        every = every.unionAll(flow(back, "writeback", (F.col("e.certainty") == "certain") & F.coalesce(F.col("b.complete"), F.lit(False)) & sure, F.col("k"), F.col("b.location_id"), F.col("location_id"), none, F.col("e.id")))
        r = self.tables["results"]
        r = r.groupBy(F.col("caller_summary_id").alias("caller"), "callsite_id").agg(F.max_by(F.struct("location_id", "definition_access_id"), F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"})).alias("r"))
        o = self.named(self.solved("origins"), "origins").groupBy(F.col("summary_id").alias("callee"), "location_id").agg(F.max(F.struct("id", "certainty")).alias("e"))
        got = calls.join(r, ["caller", "callsite_id"]).join(o, "callee")
        every = every.unionAll(flow(got, "return_to_caller", (F.col("e.certainty") == "certain") & sure, F.lit(None), F.col("r.location_id"), F.col("location_id"), F.col("r.definition_access_id"), F.col("e.id")))
        key = ["kind", "caller", "callee", "callsite_id", "target_symbol_id", "argument_index", "own", "other", "access"]
        last = every.groupBy(*key).agg(F.max_by(F.struct("target_certainty", "sure", "build_variant"), F.struct("pos", F.coalesce("o", F.lit("")))).alias("v")).select(*key, "v.*")
        certain = F.coalesce(F.col("target_certainty") == "certain", F.lit(False)) & F.col("sure")
        out = last.withColumns({"id": stable_id("interprocedural_flow", *[text(F.col(c)) for c in key]), "certainty": F.when(certain, "certain").otherwise("possible")})
        names = {"caller": "caller_summary_id", "callee": "callee_summary_id", "own": "caller_location_id", "other": "callee_location_id", "access": "caller_access_id"}
        return self.shaped(out.withColumnsRenamed(names), "flows")
