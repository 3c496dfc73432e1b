"""Queries over whole tables, held against plain Python: no id subset is left out."""

import pandas as pd

from codeprism import catalog


def reached(adjacent, start):
    seen, todo = {start}, [start]
    while todo:
        for b in adjacent.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_components_of_all_calls(spark, tmp_path):
    n = 700
    pd.DataFrame({"p_partkey": range(n)}).to_parquet(tmp_path / "part.parquet")
    pairs = {(a, b) for a in range(n) for b in ((a * 7 + 3) % n, (a * a + 1) % n)}
    adjacent, both = {}, {}
    for a, b in pairs:
        adjacent.setdefault(a, set()).add(b)
        if a != b:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    reach = {a: reached(adjacent, a) for a in range(n)}
    got = catalog.QUERIES["strong_components"](spark, str(tmp_path)).collect()
    assert len(got) == n and {r["id"]: r["component"] for r in got} == {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}
    got = catalog.QUERIES["weak_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(both) and {r["id"]: r["component"] for r in got} == {a: min(reached(both, a)) for a in both}


SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_override_targets_of_all_sites(spark):
    parents, want, rows = {}, [], table("lineitem")  # a site that is listed twice is answered twice
    for p in table("part")["p_partkey"].tolist():
        if p > 0:
            parents.setdefault(p // 3, []).append(p)
    for order, line, part, flag, status in rows[["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"]].itertuples(index=False):
        if flag == "A":
            want += [(f"site_{order}_{line}", f"m{p}", status) for p in reached(parents, part) - {part}]
    got = catalog.QUERIES["override_targets"](spark, SF).select("callsite_id", "target_symbol_id", "build_variant").collect()
    assert len(want) > 1000 and sorted(tuple(r) for r in got) == sorted(want)


def test_changed_units_see_the_dependencies_of_all(spark):
    now, deps = {}, {(f"tu_{o}", p, str(s)) for o, p, s in table("lineitem")[["l_orderkey", "l_partkey", "l_suppkey"]].itertuples(index=False)}
    for _, path, content in deps:
        now[path] = max(now.get(path, ""), content)
    stale = {unit for unit, path, content in deps if content != now[path]}
    orders = table("orders")[["o_orderkey", "o_orderstatus"]].itertuples(index=False)
    want = {f"tu_{k}" for k, status in orders if k % 13 and (not k % 9 or not k % 10 or not k % 17 or status != "F" or f"tu_{k}" in stale)}
    got = catalog.QUERIES["changed_units"](spark, SF).collect()
    assert len(got) == len(want) and {r["id"] for r in got} == want


def test_the_solver_takes_all_customers(spark):
    n = len(table("customer"))
    calls = {a: {(a * 3 + 1) % n, (a * 5 + 2) % n} for a in range(n) if a % 4}
    reach = {a: reached(calls, a) for a in range(n)}
    assert max(sum(b in reach[a] and a in reach[b] for b in range(n)) for a in range(n)) <= 128  # else the solver's own limit shows
    got = catalog.QUERIES["summary_effects_solved"](spark, SF).collect()
    want = {(f"s{a}", f"a{b}") for a in range(n) for b in reach[a] if b % 3 == 0}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = catalog.QUERIES["summary_completeness"](spark, SF).collect()
    assert len(got) == n and {tuple(r) for r in got} == {(f"s{a}", not any(b % 7 == 3 for b in reach[a])) for a in range(n)}
    got = catalog.QUERIES["summary_flows"](spark, SF).collect()
    assert sum(r["flows"] for r in got if r["kind"] == "argument_to_parameter") == sum(map(len, calls.values()))


def test_the_solver_takes_large_components(spark, tmp_path):
    """397 customers of whom a component holds more than 128."""
    n = 397
    pd.DataFrame({"c_custkey": range(n)}).to_parquet(tmp_path / "customer.parquet")
    calls = {a: {(a * 3 + 1) % n, (a * 5 + 2) % n} for a in range(n) if a % 4}
    reach = {a: reached(calls, a) for a in range(n)}
    assert max(sum(b in reach[a] and a in reach[b] for b in range(n)) for a in range(n)) > 128
    got = catalog.QUERIES["summary_effects_solved"](spark, str(tmp_path)).collect()
    want = {(f"s{a}", f"a{b}") for a in range(n) for b in reach[a] if b % 3 == 0}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = catalog.QUERIES["summary_completeness"](spark, str(tmp_path)).collect()
    assert len(got) == n and {tuple(r) for r in got} == {(f"s{a}", not any(b % 7 == 3 for b in reach[a])) for a in range(n)}
