import random

import pytest

from codeprism.operators import flow, graph, solver
from codeprism.plans import services

EDGES = "id string, source_id string, target_id string, relation string, build_variant string"
TRIANGLE = [("e1", "alpha", "beta", "calls", "b"), ("e2", "beta", "gamma", "calls", "b"), ("e3", "gamma", "alpha", "references", "b")]


def test_neighbors_of_a_triangle(spark):
    edges = spark.createDataFrame(TRIANGLE, EDGES)
    names = lambda **k: [e["id"] for e in graph.neighbors(edges, "alpha", **k)]
    assert names(direction="outgoing") == ["e1"] and names(direction="incoming") == ["e3"] and names() == ["e1", "e3"]
    assert names(direction="outgoing", depth=2) == ["e1", "e2"] and names(depth=3, max_edges=1) == ["e1"]
    assert names(relations={"references"}) == ["e3"] and names(per_node=1) == ["e1"] and names(scope=("other",)) == []
    for bad in ({"depth": 0}, {"max_edges": 0}, {"per_node": 0}, {"direction": "up"}):
        with pytest.raises(ValueError):
            names(**bad)


def plain_strong(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a in nodes:
            reach[a] |= {b for m in list(reach[a]) for x, b in pairs if x == m}
    return {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}


@pytest.mark.parametrize("one_task", [1000, 0])
def test_strong_components_in_one_task_and_distributed(spark, one_task):
    r = random.Random(4)
    pairs = sorted({(r.randint(0, 14), r.randint(0, 14)) for _ in range(22)})
    got = graph.strong_components(spark.createDataFrame(pairs, "a long, b long"), one_task)
    assert {x["id"]: x["component"] for x in got.collect()} == plain_strong(pairs)


def test_closures_stop_on_cycles(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5)], "a long, b long")
    seed = spark.createDataFrame([(2,)], "id long")
    assert {r[0] for r in graph.forward_callees(calls, seed).collect()} == {1, 2, 3, 5}
    assert {r[0] for r in graph.reverse_callers(calls, seed).collect()} == {1, 3, 4}


def test_override_candidates(spark):
    sites = spark.createDataFrame([("c1", "virtual", "root", "b"), ("c2", "direct", "root", "b")], "id string, dispatch_kind string, static_target_symbol_id string, build_variant string")
    targets = spark.createDataFrame([("c1", "root", "possible", "static"), ("c1", "d1", "possible", "static"), ("c1", "old", "possible", "indexed_override_candidate")], "callsite_id string, target_symbol_id string, certainty string, derivation string")
    overrides = spark.createDataFrame([("d1", "root", "b"), ("d2", "root", "b"), ("d3", "d2", "b"), ("root", "d3", "other")], "source_id string, target_id string, build_variant string")
    got = graph.override_targets(sites, targets, overrides).collect()
    assert {(r["callsite_id"], r["target_symbol_id"], r["confidence"]) for r in got} == {("c1", "d2", 0.5), ("c1", "d3", 0.5)}


def test_evidence_overrides_edges_and_limits_fan_out(spark):
    edges = spark.createDataFrame([("e1", "f", "g", "calls", "b"), ("e2", "f", "h", "calls", "b")], EDGES)
    evidence = spark.createDataFrame([("f", "h", "t1", "certain", "b"), ("f", "k", "t2", "possible", "b")], "owner_symbol_id string, target_symbol_id string, target_id string, certainty string, build_variant string")
    merged = graph.merged_edges(edges, evidence)
    assert {(r["id"], r["certain"]) for r in merged.collect()} == {("e1", False), ("e2", True), ("t2", False)}
    few = graph.fan_out(merged, "f", 1).collect()
    assert [r["id"] for r in few] == ["e2"] and few[0]["truncated"]


def solve(blocks, edges, accesses):
    before = {}
    for s, t in edges:
        before.setdefault(t, []).append(s)
    return flow.solve_graph(blocks, before, accesses)


def test_reaching_definitions_join_and_loop():
    accesses = {0: [("d0", "x", True)], 1: [("d1", "x", True)], 2: [], 3: [("u", "x", False)]}
    found, rounds, converged = solve([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)], accesses)
    assert set(found) == {("overwrites", "d0", "d1", True), ("reaching_definition", "d0", "u", False), ("reaching_definition", "d1", "u", False)}
    assert converged and rounds == 2
    found, rounds, _ = solve([0, 1], [(0, 1), (1, 1)], {0: [("d", "x", True)], 1: [("u", "x", False)]})
    # the first round sees one of two predecessors, and what is incomplete then stays so in a loop
    assert found == [("reaching_definition", "d", "u", False)] and rounds == 2
    assert not flow.solve_graph([0, 1], {1: [0, 1]}, {0: [("d", "x", True)], 1: [("u", "x", False)]}, rounds=1)[2]


def test_undefined_path_is_incomplete():
    found, _, _ = solve([0, 1, 2], [(0, 1), (0, 2), (1, 2)], {1: [("d", "x", True)], 2: [("u", "x", False)]})
    assert found == [("reaching_definition", "d", "u", False)]


PROV = {"translation_unit_id": "tu", "build_configuration_id": "cfg", "build_variant": "b"}


def summary(i, function, n=1, reasons=(), **prov):
    return {"id": i, "function_symbol_id": function, "parameter_modes": ["reference"] * n, "parameter_location_ids": [f"{i}p{k}" for k in range(n)], "local_incomplete_reasons": list(reasons)} | PROV | prov


def site(i, owner, complete=True, **prov):
    return {"id": i, "owner_symbol_id": owner, "target_set_complete": complete} | PROV | prov


def target(site, to, certainty="certain"):
    return {"callsite_id": site, "target_symbol_id": to, "certainty": certainty}


def effect(i, s, kind="write", where="parameter", index=0, location="l"):
    return {"id": i, "summary_id": s, "kind": kind, "location_kind": where, "certainty": "certain", "parameter_index": index, "access_path": ["f"], "location_id": location, "source_access_id": f"a{i}", "is_local": True}


def binding(caller, site, index=0, complete=True, kind="parameter", to=0):
    return {"caller_summary_id": caller, "callsite_id": site, "argument_index": index, "location_id": f"{caller}p0", "location_kind": kind, "parameter_index": to, "access_path": ["g"], "writeback_candidate": True, "complete": complete}


def run(limits=solver.Limits(), **tables):
    return solver.Part({k: list(tables.get(k, ())) for k in solver.INPUTS}, limits).solve()


def reasons(solved):
    return {s["id"]: s["incomplete_reasons"] for s in solved["summaries"]}


def test_effects_move_two_calls_up():
    solved = run(
        summaries=[summary("s1", "f1"), summary("s2", "f2"), summary("s3", "f3")],
        sites=[site("c1", "f1"), site("c2", "f2")],
        targets=[target("c1", "f2"), target("c2", "f3", "possible")],
        effects=[effect("e", "s3")],
        bindings=[binding("s1", "c1"), binding("s2", "c2")],
    )
    top = [e for e in solved["effects"] if e["summary_id"] == "s1"]
    assert len(top) == 1 and top[0]["access_path"] == ["g", "g", "f"] and top[0]["certainty"] == "possible" and not top[0]["is_local"]
    assert reasons(solved) == {"s1": [], "s2": [], "s3": []} and {s["id"]: s["iteration_count"] for s in solved["summaries"]} == {"s1": 2, "s2": 2, "s3": 1}
    assert {f["kind"] for f in solved["flows"]} == {"argument_to_parameter", "writeback"}


def test_recursion_adds_no_rows_and_is_flagged():
    solved = run(summaries=[summary("s1", "f1")], sites=[site("c1", "f1")], targets=[target("c1", "f1")], effects=[effect("e", "s1", where="global", index=None)], bindings=[binding("s1", "c1")])
    assert solved["summaries"][0]["recursive"] and len(solved["effects"]) == 2


def test_missing_and_incomplete_facts_are_reasons():
    base = {"summaries": [summary("s1", "f1"), summary("s2", "f2")], "sites": [site("c1", "f1")], "targets": [target("c1", "f2")]}
    assert reasons(run(**base))["s1"] == ["missing_call_argument_binding"]
    assert reasons(run(**base, bindings=[binding("s1", "c1", complete=False)]))["s1"] == ["incomplete_call_argument_binding"]
    assert reasons(run(**base | {"targets": [target("c1", "out")]}))["s1"] == ["external_or_unindexed_callee_body", "unknown_or_external_call_target"]
    assert reasons(run(**base | {"sites": [site("c1", "f1", False)]}, bindings=[binding("s1", "c1")]))["s1"] == ["unknown_or_external_call_target"]
    assert reasons(run(**base | {"summaries": [summary("s1", "f1"), summary("s2", "f2", reasons=["volatile_access"])]}, bindings=[binding("s1", "c1")]))["s1"] == ["callee_summary_incomplete"]


def test_bodies_of_the_same_unit_win_and_others_are_ambiguous():
    bodies = [summary("s2", "f2"), summary("s3", "f2", translation_unit_id="other")]
    same = run(summaries=[summary("s1", "f1"), *bodies], sites=[site("c1", "f1")], targets=[target("c1", "f2")], effects=[effect("e2", "s2"), effect("e3", "s3")], bindings=[binding("s1", "c1")])
    assert {e["source_access_id"] for e in same["effects"] if e["summary_id"] == "s1"} == {"ae2"} and reasons(same)["s1"] == []
    far = run(summaries=[summary("s1", "f1", translation_unit_id="third"), *bodies], sites=[site("c1", "f1", translation_unit_id="third")], targets=[target("c1", "f2")], effects=[effect("e2", "s2"), effect("e3", "s3")], bindings=[binding("s1", "c1")])
    assert reasons(far)["s1"] == ["multiple_callee_body_variants"] and {e["certainty"] for e in far["effects"] if e["summary_id"] == "s1"} == {"possible"}


def test_caps():
    base = {"summaries": [summary("s1", "f1", 0), summary("s2", "f2", 0)], "sites": [site("c1", "f1")], "targets": [target("c1", "f2")], "effects": [effect(f"e{i}", "s2", where="global", index=None) for i in range(5)]}
    assert reasons(run(solver.Limits(rounds=1), **base))["s1"] == ["scc_iteration_cap_exceeded"]
    capped = run(solver.Limits(effects=3), **base)
    assert reasons(capped) == {"s1": ["callee_summary_incomplete"], "s2": ["summary_effect_cap_exceeded"]} and sum(e["summary_id"] == "s1" for e in capped["effects"]) == 3
    loop = base | {"sites": [site("c1", "f1"), site("c2", "f2")], "targets": [target("c1", "f2"), target("c2", "f1")]}
    assert all("scc_size_cap_exceeded" in r for r in reasons(run(solver.Limits(component=1), **loop)).values())
    with pytest.raises(ValueError):
        solver.Limits(rounds=0)


def test_return_origins_of_a_call_result():
    origin = {"id": "o1", "summary_id": "s1", "kind": "call_result", "location_kind": None, "certainty": "certain", "parameter_index": None, "access_path": [], "location_id": None, "callsite_id": "c1", "is_local": True}
    inner = origin | {"id": "o2", "summary_id": "s2", "kind": "location", "location_kind": "parameter", "parameter_index": 0, "callsite_id": None}
    base = {"summaries": [summary("s1", "f1"), summary("s2", "f2")], "sites": [site("c1", "f1")], "targets": [target("c1", "f2")], "origins": [origin, inner]}
    moved = [o for o in run(**base, bindings=[binding("s1", "c1")])["origins"] if o["summary_id"] == "s1" and not o["is_local"]]
    assert [(o["kind"], o["location_id"]) for o in moved] == [("location", "s1p0")]
    unbound = [o for o in run(**base)["origins"] if o["summary_id"] == "s1" and not o["is_local"]]
    assert [(o["kind"], o["location_kind"]) for o in unbound] == [("location", "unknown")]


def test_service_guards():
    assert services.resolve_scope(None, ("a", "b")) == ("a", "b") and services.resolve_scope(("b",), ("a", "b")) == ("b",)
    with pytest.raises(ValueError, match="not available"):
        services.resolve_scope(("c",), ("a",))
    with pytest.raises(ValueError):
        services.within("graphs", 21)
    with pytest.raises(ValueError):
        services.calls(None, None, "x", "both", None, ("a",))


def test_budgets_are_shared_and_an_exact_fit_is_not_truncated(spark):
    rows = spark.createDataFrame([(g, f"g{g}", f"{g}{i}") for g in (1, 2, 3) for i in range(3)], "gn int, graph_id string, id string")
    exact = services.covered({"x": (rows, ["id"], 9)}).collect()
    assert len(exact) == 9 and not exact[0]["truncated"]
    two = services.covered({"x": (rows, ["id"], 4), "y": (rows, ["id"], 9)}).collect()
    assert sorted(r["id"] for r in two if r["part"] == "x") == ["10", "11", "12", "20"] and {r["gn"] for r in two} == {1, 2} and two[0]["truncated"]


@pytest.mark.parametrize("few", [0, 200_000])
def test_weak_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    pairs = [("a", "b"), ("b", "c"), ("e", "e"), (None, "d"), ("z", "y"), ("c", "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "z": "y", "y": "y"} | {f"n{i:03}": "n000" for i in range(61)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("one_task", [None, 0])
def test_closures_of_deep_graphs(spark, monkeypatch, one_task):
    """In one task a level costs no job; level by level the result is the same."""
    n, tables, plain = 40, [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, tag: tables.append(tag) or plain(df, tag))
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, 3), (None, 1), (2, None)], "a long, b long")
    seed = spark.createDataFrame([(2,), (77,)], "id int")
    got = {tuple(r) for r in graph.closure(chain, seed, one_task=one_task).collect() if r["id"] is not None}
    assert got == {(i, i - 2) for i in range(2, n + 1)} | {(77, 0)}
    assert len(tables) == 1 or one_task == 0
    assert graph.closure(chain.where("a > 1000"), seed).count() == 2 and graph.closure(chain, seed.where("id > 1000")).count() == 0


def test_strong_components_of_more_than_a_million_calls(spark):
    n = 1_100_000
    ring = spark.range(n).selectExpr("id AS a", f"(id + 1) % {n} AS b")
    assert [tuple(r) for r in graph.strong_components(ring).groupBy("component").count().collect()] == [(0, n)]


def test_call_order_in_one_task_and_distributed(spark):
    r = random.Random(5)
    pairs = sorted({(f"n{r.randint(0, 30):02}", f"n{r.randint(0, 30):02}") for _ in range(38)})
    links = spark.createDataFrame(pairs, "a string, b string")
    one, far = ({tuple(x) for x in graph.call_order(links, t).collect()} for t in (1000, 0))
    level = {x: k for x, _, _, k in one}
    of = {x: c for x, c, _, _ in one}
    assert one == far and of == plain_strong(pairs) and max(level.values()) > 2
    assert all(level[x] == max([level[b] + 1 for a, b in pairs if of[a] == of[x] != of[b]], default=0) for x in level)


def random_program(seed, functions=26):
    """Tables with several bodies of a function, recursion, unknown targets, odd bindings, results and two builds."""
    r = random.Random(seed)
    t = {k: [] for k in solver.INPUTS}
    for b in ("x", "y"):
        for i in range(functions):
            for unit in ["tu"] + ["other"] * (r.random() < 0.2):
                prov = {"translation_unit_id": unit, "build_configuration_id": "cfg", "build_variant": b}
                n, s = r.randint(0, 2), f"s{b}{unit}{i}"
                t["summaries"].append(summary(s, f"f{i}", n, ["volatile_access"] if r.random() < 0.05 else [], **prov) | {"parameter_modes": [r.choice(["reference", "value", "pointer"]) for _ in range(n)]})
                for k in range(r.randint(0, 2)):
                    t["effects"].append(effect(f"e{s}{k}", s, r.choice(["read", "write"]), *r.choice([("parameter", r.randint(0, 1)), ("global", None), ("field", None), ("local", None)]), location=f"l{k}") | {"access_path": r.choice([[], ["it's"], ["a", 'b"']])})
                t["origins"].append({"id": f"o{s}", "summary_id": s, "kind": "location", "location_kind": r.choice(["parameter", "global"]), "certainty": r.choice(["certain", "possible"]), "parameter_index": r.choice([0, None]), "access_path": ["r"], "location_id": f"{s}p0", "callsite_id": None, "is_local": True})
                for k in range(r.randint(0, 2)):
                    c = f"c{s}{k}"
                    t["sites"].append(site(c, f"f{i}", r.random() < 0.9, **prov))
                    for _ in range(r.choice([0, 1, 1, 1, 2])):
                        to = r.choice([i, r.randint(0, functions + 1), *[r.randint(i, functions)] * 6])
                        t["targets"].append(target(c, f"f{to}", r.choice(["certain", "possible"])) | {"id": f"t{c}{to}"})
                    for a in (0, 1):
                        if r.random() < 0.85:
                            t["bindings"].append(binding(s, c, a, r.random() < 0.9, r.choice(["parameter", "global"]), r.choice([0, 1, None])) | {"access_path": ["g"] * r.randint(0, 3)})
                    if r.random() < 0.5:
                        t["results"].append({"caller_summary_id": s, "callsite_id": c, "location_id": f"r{c}", "definition_access_id": f"d{c}"})
                        t["origins"].append(t["origins"][-1] | {"id": f"q{c}", "summary_id": s, "kind": "call_result", "location_kind": None, "parameter_index": None, "access_path": [], "location_id": None, "callsite_id": c})
    return t


TYPES = {
    "summaries": "id string, function_symbol_id string, parameter_modes array<string>, parameter_location_ids array<string>, local_incomplete_reasons array<string>, translation_unit_id string, build_configuration_id string, build_variant string",
    "effects": "id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path array<string>, location_id string, source_access_id string, is_local boolean",
    "origins": "id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path array<string>, location_id string, callsite_id string, is_local boolean",
    "bindings": "caller_summary_id string, callsite_id string, argument_index int, location_id string, location_kind string, parameter_index int, access_path array<string>, writeback_candidate boolean, complete boolean",
    "results": "caller_summary_id string, callsite_id string, location_id string, definition_access_id string",
    "sites": "id string, owner_symbol_id string, target_set_complete boolean, translation_unit_id string, build_configuration_id string, build_variant string",
    "targets": "id string, callsite_id string, target_symbol_id string, certainty string",
}


@pytest.mark.parametrize("seed, limits", [(1, solver.Limits()), (2, solver.Limits(component=2)), (3, solver.Limits(rounds=1, effects=3))])
def test_levels_solve_as_one_group_does(spark, monkeypatch, seed, limits):
    rows = random_program(seed)
    tables = {k: spark.createDataFrame([{c.split()[0]: x.get(c.split()[0]) for c in TYPES[k].split(", ")} for x in rows[k]], TYPES[k]) for k in solver.INPUTS}
    plain = {k: sorted(map(str, df.collect())) for k, df in solver.solve(tables, limits).items()}
    monkeypatch.setattr(solver, "ONE_GROUP", 0)
    monkeypatch.setattr(solver, "components", None)  # no connected part is made
    levels = solver.solve(tables, limits)
    assert all(plain.values())
    for k in ("effects", "origins", "flows", "summaries"):
        df = levels[k]
        got = sorted(map(str, df.select(*[c.split()[0] for c in solver.SCHEMAS[k].split(", ")]).collect()))
        assert got == plain[k], (k, [x for x in got if x not in plain[k]][:1], [x for x in plain[k] if x not in got][:1])


def as_tables(spark, rows):
    return {k: spark.createDataFrame([{c.split()[0]: x.get(c.split()[0]) for c in TYPES[k].split(", ")} for x in rows[k]], TYPES[k]) for k in solver.INPUTS}


def test_without_limits_nothing_is_cut(spark, monkeypatch):
    """A ring of more than 128 functions that takes more than 32 rounds, and a function with more than 1024 effects."""
    n, many = 150, 1100
    rows = {k: [] for k in solver.INPUTS}
    rows["summaries"] = [summary(f"s{i}", f"f{i}", 0) for i in range(n)] + [summary("t", "top", 0), summary("w", "wide", 0)]
    rows["sites"] = [site(f"c{i}", f"f{i}") for i in range(n)] + [site("ct", "top")]
    rows["targets"] = [target(f"c{i}", f"f{(i + 1) % n}") | {"id": f"t{i}"} for i in range(n)] + [target("ct", "wide") | {"id": "tt"}]
    rows["effects"] = [effect(f"e{i}", f"s{i}", where="global", index=None) for i in (0, 70)] + [effect(f"w{i}", "w", where="global", index=None) for i in range(many)]
    want = {(f"s{i}", a) for i in range(n) for a in ("ae0", "ae70")} | {(s, f"aw{i}") for s in "tw" for i in range(many)}
    for one_group in (20_000, 0):
        monkeypatch.setattr(solver, "ONE_GROUP", one_group)
        got = solver.solve(as_tables(spark, rows))
        assert {(r["summary_id"], r["source_access_id"]) for r in got["effects"].collect()} == want
        assert all(r["complete"] for r in got["summaries"].collect())


def test_the_fixpoint_is_that_of_plain_rounds(spark, monkeypatch):
    """As rounds over all members without any cut; by levels too, with components dealt to many groups."""
    tables = as_tables(spark, random_program(4))
    plain = {k: sorted(map(str, df.collect())) for k, df in solver.solve(tables, solver.Limits(1000, 1000, 10**6)).items()}
    assert all(plain.values()) and not any("cap_exceeded" in x for x in plain["summaries"])
    for few in (10**6, 40):  # one group; too many effects for it
        monkeypatch.setattr(solver, "ROWS", few)
        for k, df in solver.solve(tables).items():
            assert sorted(map(str, df.select(*[c.split()[0] for c in solver.SCHEMAS[k].split(", ")]).collect())) == plain[k], (k, few)


def test_values_that_go_round_in_a_loop_end():
    """Rounds over all members never end here: equal rows hand a certainty round in a loop of calls."""
    rows = random_program(158, 6 + 158 % 24)
    capped, whole = (run(limits, **rows) for limits in (solver.Limits(40, 1000, 10**6), None))
    assert any("scc_iteration_cap_exceeded" in r for r in reasons(capped).values()) and not any("scc_iteration_cap_exceeded" in r for r in reasons(whole).values())
    assert {e["id"] for e in whole["effects"]} == {e["id"] for e in capped["effects"]}
