import gzip
import json

import pytest
from pyspark.sql import functions as F

from codeprism import __main__ as cli
from codeprism.operators import solver
from codeprism.plans import incremental, retrieval
from codeprism.sources import compilation, connectors, facts, files, schemas, workload
from codeprism.streaming import drops


def database(tmp_path, entries):
    path = tmp_path / "compile_commands.json"
    path.write_text(json.dumps(entries) if not isinstance(entries, str) else entries)
    return f"file://{path}"


def test_compilation_database(spark, tmp_path):
    entries = [
        {"directory": "/w", "file": "a.cpp", "command": "c++ -c -Iinc '-DX=a b' -isystem ../s -o a.o a.cpp"},
        {"directory": "/w", "file": "a.cpp", "command": "c++ -c -Iinc '-DX=a b' -isystem ../s -o a.o a.cpp"},
        {"directory": "/w", "file": "/w/b.cpp", "arguments": ["c++", "-MD", "-MF", "d", "--sysroot=root", "/w/b.cpp"], "output": "b.o"},
    ]
    got = {r["source_path"]: r for r in compilation.load(spark, database(tmp_path, entries), "alpha").collect()}
    assert set(got) == {"/w/a.cpp", "/w/b.cpp"} and got["/w/a.cpp"]["position"] == 0
    assert got["/w/a.cpp"]["clang_arguments"] == ["-I/w/inc", "-DX=a b", "-isystem", "/s"]
    assert got["/w/b.cpp"]["clang_arguments"] == ["--sysroot=/w/root"]


@pytest.mark.parametrize("entries", [[], [{"directory": "/w", "file": "a"}], [{"directory": "/w", "file": "a", "command": "c", "arguments": ["c"]}], [{"file": "a", "command": "c"}]])
def test_bad_compilation_databases(spark, tmp_path, entries):
    with pytest.raises(ValueError):
        compilation.load(spark, database(tmp_path, entries), "alpha")


def stream(*records):
    return "\n".join(json.dumps(r) for r in records) + "\n"


HELLO = {"type": "hello", "protocol": 5, "clang_major": 18, "capabilities": ["cfg", "calls"]}


def fact(request, kind, **columns):
    return {"type": "fact", "request_id": request, "fact": kind} | columns


def test_fact_stream_admits_whole_requests_only(spark, tmp_path):
    one = [{"type": "begin", "request_id": "r1"}, fact("r1", "cfg_graph_v1", id="g", function_symbol_id="f"), fact("r1", "cfg_block_v1", id="b", graph_id="g", block_index=0), {"type": "complete", "request_id": "r1", "success": True}]
    cut = [{"type": "begin", "request_id": "r2"}, fact("r2", "cfg_graph_v1", id="g2")]
    failed = [{"type": "begin", "request_id": "r3"}, fact("r3", "cfg_graph_v1", id="g3"), {"type": "complete", "request_id": "r3", "success": False}]
    (tmp_path / "a.jsonl").write_text(stream(HELLO, *one, *cut))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(stream(*failed).encode()))
    records = facts.read(spark, f"file://{tmp_path}")
    facts.check_handshake(records, {"cfg"})
    with pytest.raises(ValueError, match="missing"):
        facts.check_handshake(records, {"other"})
    whole = facts.admitted(records)
    assert {r["request_id"] for r in whole.collect()} == {"r1"}
    tables = facts.tables(whole)
    assert tables["cfg_blocks"].first()["graph_id"] == "g" and tables["cfg_graphs"].count() == 1
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "c.jsonl").write_text(stream({"type": "begin", "request_id": "r"}, fact("r", "cfg_block_v1", id="b", graph_id="nowhere"), {"type": "complete", "request_id": "r", "success": True}))
    with pytest.raises(ValueError, match="nowhere"):
        facts.tables(facts.admitted(facts.read(spark, f"file://{bad}")))


def test_schemas_and_invariants(spark):
    for name in schemas.SCHEMAS:
        assert spark.createDataFrame([], schemas.SCHEMAS[name]).columns
    rows = spark.createDataFrame([("e1", "calls"), ("e2", "likes"), ("e3", None)], "id string, relation string")
    assert {r["id"] for r in schemas.violations("edges", rows).collect()} == {"e2", "e3"}
    assert schemas.conform("edges", rows).columns == ["id", "source_id", "target_id", "relation", "translation_unit_id", "build_configuration_id", "build_variant"]
    spans = spark.createDataFrame([("a", "declaration", 3, 2), ("b", "call", 1, 1)], "id string, kind string, start_line int, end_line int")
    assert [r["id"] for r in schemas.violations("occurrences", spans).collect()] == ["a"]


def test_source_reader_stays_below_its_root(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.cpp").write_bytes(b"one\ntwo\n\xffthree\nfour")
    rows = [("1", "src/a.cpp", 2, 3), ("2", "src/a.cpp", 9, 9), ("3", "../x", 1, 1), ("4", "src/none", 1, 1), ("5", "/etc/passwd", 1, 1)]
    got = {r["id"]: r for r in files.read_symbols(spark, f"file://{tmp_path}", spark.createDataFrame(rows, "id string, path string, start_line int, end_line int")).collect()}
    assert got["1"]["text"] == "two\n�three" and got["1"]["error"] is None
    assert all(got[i]["text"] is None and got[i]["error"] for i in "2345")


def test_workload_is_deterministic(spark):
    a, b = (workload.generate(spark, workload.Workload(2, 2, 3)) for _ in range(2))
    assert a["symbol_variants"].count() == 12 and a["call_targets"].collect() == b["call_targets"].collect()
    assert a["symbol_variants"].select("id").distinct().count() == 12 and a["symbol_variants"].select("symbol_id").distinct().count() == 6
    with pytest.raises(ValueError):
        workload.Workload(0, 1, 1)


def test_connectors(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "id long, text string").coalesce(1)
    good = connectors.hosted_embeddings(df, "text", lambda ts: {"data": [{"index": i, "embedding": [len(t), i]} for i, t in reversed(list(enumerate(ts)))]})
    assert [r["vector"] for r in good.orderBy("id").collect()] == [[2.0, 0.0], [2.0, 1.0], [2.0, 2.0]]
    with pytest.raises(connectors.ConnectorError):
        connectors.vectors_of({"data": [{"index": 1, "embedding": [1]}]}, 1)
    with pytest.raises(connectors.ConnectorError):
        connectors.post("http://127.0.0.1:9/x", {}, timeout=1)
    say = connectors.scripted("a", "b")
    assert [say(""), say(""), say("")] == ["a", "b", "b"]
    connectors.write_report(f"{tmp_path}/r.json", {"x": [1, "rel/path"]})
    assert json.load(open(f"{tmp_path}/r.json")) == {"x": [1, "rel/path"]}
    with pytest.raises(ValueError):
        connectors.write_report(f"{tmp_path}/r.json", {"x": ["/abs"]})


V = "id string, symbol_id string, qualified_name string, signature string, documentation string, source_text string, path string, start_line int, end_line int, is_definition boolean, translation_unit_id string, build_variant string"


def variants(spark, names, build="b"):
    return spark.createDataFrame([(f"{build}:{n}", n, n, "", "", t, "a.cpp", 1, 2, True, u, build) for n, t, u in names], V)


def test_snapshots_replace_units_atomically(spark, tmp_path):
    store = incremental.Store(spark, f"file://{tmp_path}/store")
    unit = lambda *i: spark.createDataFrame([(x,) for x in i], "id string") if i else spark.createDataFrame([], "id string")
    assert store.apply(unit("u1", "u2"), unit(), {"symbol_variants": variants(spark, [("f", "1", "u1"), ("g", "2", "u2")])}) == 1
    before = store.read("symbol_variants")
    assert store.apply(unit("u1"), unit("u2"), {"symbol_variants": variants(spark, [("f", "changed", "u1")])}) == 2
    assert [(r["id"], r["source_text"]) for r in store.read("symbol_variants").collect()] == [("b:f", "changed")]
    assert before.count() == 2  # a reader of the old snapshot still has it
    vectors = spark.createDataFrame([("b:f", "m", [3.0, 4.0], "b")], "variant_id string, model string, vector array<double>, build_variant string")
    store.put_embeddings(vectors)
    assert store.read("embeddings").first()["magnitude"] == 5.0
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(ValueError):
            store.put_embeddings(spark.createDataFrame([("b:g", "m", bad, "b")], vectors.schema))
    assert store.remove_build("b") and not store.remove_build("b") and store.read("symbol_variants").count() == 0


def test_change_detection(spark):
    current = spark.createDataFrame([(i, f"{i}.cpp", "c", "native") for i in ("same", "new", "command", "source", "header", "legacy", "gone")], "id string, source_path string, command_hash string, analysis_backend string")
    state = spark.createDataFrame([("same", "c", "h", "native", True), ("command", "d", "h", "native", True), ("source", "c", "old", "native", True), ("header", "c", "h", "native", True), ("legacy", "c", "h", "native", False), ("gone", "c", "h", "native", True), ("removed", "c", "h", "native", True)], "id string, command_hash string, content_hash string, analysis_backend string, advanced_facts_complete boolean")
    hashes = spark.createDataFrame([(f"{i}.cpp", "h") for i in ("same", "new", "command", "source", "header", "legacy")] + [("x.h", "2"), ("y.h", "1")], "path string, content_hash string")
    deps = spark.createDataFrame([("header", "x.h", "1"), ("same", "y.h", "1")], "translation_unit_id string, path string, content_hash string")
    assert {r[0] for r in incremental.changed_units(current, state, hashes, deps).collect()} == {"new", "command", "source", "header", "legacy", "gone"}
    assert [r[0] for r in incremental.removed_units(current, state).collect()] == ["removed"]
    assert incremental.migrate(state, 9).where("advanced_facts_complete").count() == 0
    with pytest.raises(ValueError):
        incremental.migrate(state, 11)


def test_summary_refresh_writes_impacted_functions_only(spark):
    from codeprism.plans.flow_queries import solver_tables

    sf = "/root/testdata/sf0.001"
    tables = solver_tables(spark, sf)
    full = solver.solve(tables)
    calls = tables["targets"].join(tables["sites"].select(F.col("id").alias("callsite_id"), "owner_symbol_id"), "callsite_id").select(F.col("owner_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
    changed = spark.createDataFrame([("f7",)], "id string")
    part = incremental.refresh_summaries(tables, calls, changed)
    want = {r["id"]: (r["complete"], r["solution_hash"]) for r in full["summaries"].collect()}
    got = {r["id"]: (r["complete"], r["solution_hash"]) for r in part["summaries"].collect()}
    assert "s7" in got and len(got) < len(want) and got == {i: want[i] for i in got}


def engine(spark, edges, names, **more):
    e = spark.createDataFrame([(a, b, "calls", "b") for a, b in edges], "source_id string, target_id string, relation string, build_variant string")
    return retrieval.Engine(variants(spark, names), e, **more)


def test_retrieval_follows_the_graph(spark):
    found = retrieval.retrieve(engine(spark, [("parser", "validate"), ("validate", "decode")], [("parser", "text", "u"), ("validate", "x", "u"), ("decode", "y", "u")]), "parser")
    assert [i["id"] for i in found["items"]] == ["b:parser", "b:validate", "b:decode"]
    assert [i["hops"] for i in found["items"]] == [0, 1, 2] and not found["truncated"]


def test_retrieval_budgets_hubs_and_order(spark):
    names = [("root", "root", "u")] + [(f"n{i:02}", "x", "u") for i in range(25)]
    found = retrieval.retrieve(engine(spark, [("root", f"n{i:02}") for i in range(25)], names), "root", max_results=100)
    assert {i["id"] for i in found["items"]} == {"b:root"} | {f"b:n{i:02}" for i in range(retrieval.PER_NODE)}
    assert found["items"][1]["id"] == "b:n19"  # ties of score are ordered by name, the last first
    assert "hub degree 21" in found["items"][1]["reason"] and "graph expansion stopped at configured budget" in found["diagnostics"]


def test_packing_cuts_the_last_source(spark):
    found = retrieval.retrieve(engine(spark, [], [("big", "z" * 2000, "u")]), "big", max_tokens=100)
    assert len(found["rendered"]) <= 400 and retrieval.CUT_MARK in found["rendered"] and found["truncated"]
    assert found["estimated_tokens"] == -(-len(found["rendered"]) // 4)


def test_retrieval_survives_a_failing_backend_and_guards_requests(spark):
    broken = engine(spark, [], [("one", "x", "u")], embeddings=spark.createDataFrame([("b:one", "local", [1.0], "b")], "variant_id string, model string, vector array<double>, build_variant string"), embed=lambda t: [1.0, 2.0])
    found = retrieval.retrieve(broken, "one")
    assert found["items"] and any("vector search failed" in d for d in found["diagnostics"])
    for bad in ({"query": " "}, {"query": "x" * 2049}, {"query": "x", "max_tokens": 64_001}, {"query": "x", "max_results": 0}):
        with pytest.raises(ValueError):
            retrieval.retrieve(broken, **bad)


def test_answers_cite_only_what_was_read():
    page = {"items": [{"id": "a"}], "rendered": "text"}
    script = connectors.scripted('{"action": "search", "query": "more"}', '{"action": "answer", "answer": "yes", "citations": ["a", "z"]}')
    assert retrieval.answer(lambda q: page, script, "?") == {"answer": "yes", "citations": ["a"], "complete": True}
    assert not retrieval.answer(lambda q: page, connectors.scripted("no json"), "?")["complete"]


def test_stream_of_dropped_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(stream({"type": "begin", "request_id": "r"}, fact("r", "edge", id="e"), fact("r", "edge", id="f")))
    query = drops.fact_rates(drops.facts(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["fact"], r["facts"]) for r in spark.table("rates").collect()] == [("edge", 2)]


def test_command_line(spark, capsys):
    assert cli.main(["list"]) == 0 and "bm25_top_k" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/root/testdata/sf0.001"], spark) == 2
    assert cli.main(["calls", "/root/testdata/sf0.001", "fn_7"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main([])


def test_entry_imports_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['codeprism.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and not any(n.startswith('op1_') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd="/root/repo" if __import__("os").path.exists("/root/repo") else ".").returncode == 0


def facts(spark, bodies, build="b"):
    """Units, variants, call sites, targets, edges and summaries of functions: {name: (unit, callees, virtual callee, overridden)}."""
    bodies = {n: (f"{build}.{u}", *more) for n, (u, *more) in bodies.items()}  # a unit is one of one build
    prov = lambda u: (u, f"cfg_{u}", build)
    p = "translation_unit_id string, build_configuration_id string, build_variant string"
    units = sorted({u for u, *_ in bodies.values()})
    make = lambda rows, schema: spark.createDataFrame(rows, f"{schema}, {p}")
    sites = [(f"{build}:{n}>{c}", n, "virtual" if c == virtual else "direct", c, True, *prov(u)) for n, (u, callees, virtual, _) in bodies.items() for c in callees]
    a = "array<string>"
    return {
        "translation_units": spark.createDataFrame([(u, f"cfg_{u}", f"{u}.cpp", build) for u in units], "id string, build_configuration_id string, source_path string, build_variant string"),
        "build_configurations": spark.createDataFrame([(f"cfg_{u}", f"{u}.cpp", build) for u in units], "id string, source_path string, build_variant string"),
        "symbol_variants": make([(f"{build}:{n}", n, f"ns::{n}", str(c), "", "x", True, *prov(u)) for n, (u, c, *_) in bodies.items()], "id string, symbol_id string, qualified_name string, signature string, documentation string, source_text string, is_definition boolean"),
        "edges": make([(f"{build}:{n}^{o}", n, o, "overrides", *prov(u)) for n, (u, _, _, o) in bodies.items() if o], "id string, source_id string, target_id string, relation string"),
        "callsites": make(sites, "id string, owner_symbol_id string, dispatch_kind string, static_target_symbol_id string, target_set_complete boolean"),
        "call_targets": make([(f"t{s[0]}", s[0], s[3], "certain", 1.0, "direct", *s[5:]) for s in sites], "id string, callsite_id string, target_symbol_id string, certainty string, confidence double, derivation string"),
        "function_summaries": make([(f"{build}:s{n}", n, ["reference"], [f"p{n}"], ["volatile_access"] if n.startswith("v") else [], *prov(u)) for n, (u, *_) in bodies.items()], f"id string, function_symbol_id string, parameter_modes {a}, parameter_location_ids {a}, local_incomplete_reasons {a}"),
        "summary_effects": make([], f"id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path {a}, location_id string, source_access_id string"),
        "summary_return_origins": make([], f"id string, summary_id string, kind string, location_kind string, certainty string, parameter_index int, access_path {a}, location_id string, callsite_id string"),
        "call_argument_bindings": make([], f"id string, caller_summary_id string, callsite_id string, argument_index int, location_id string, location_kind string, parameter_index int, access_path {a}, writeback_candidate boolean, complete boolean"),
        "call_result_bindings": make([], "id string, caller_summary_id string, callsite_id string, location_id string, definition_access_id string"),
    }


FIRST = {"main": ("u1", ["base", "leaf"], "base", None), "base": ("u2", [], None, None), "child": ("u2", ["leaf"], None, "base"), "leaf": ("u3", [], None, None), "alone": ("u4", [], None, None)}


def test_ingestion_equals_a_store_made_from_the_final_facts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "PARTS", 8)
    names = ("symbol_variants", "call_targets", "solved_summaries", "symbols", "build_configurations", "translation_units", "embeddings")
    content = lambda store: {t: sorted(map(str, store.read(t).collect())) for t in names if t in store.manifest()["tables"]}
    store = incremental.Store(spark, f"file://{tmp_path}/a")
    assert store.ingest("b", facts(spark, FIRST)) == 5
    assert {(r["callsite_id"], r["target_symbol_id"]) for r in store.read("call_targets").where("derivation = 'indexed_override_candidate'").collect()} == {("b:main>base", "child")}
    store.put_embeddings(spark.createDataFrame([(f"b:{n}", "m", [1.0, 2.0], "b") for n in ("leaf", "main", "alone")], "variant_id string, model string, vector array<double>, build_variant string"))
    files = store.manifest()["tables"]["symbol_variants"]
    # the leaf gets incomplete, unit u4 goes, and u2 now has another override
    second = {"main": FIRST["main"], "base": FIRST["base"], "other": ("u2", [], None, "base"), "leaf": ("u3", ["vleaf"], None, None), "vleaf": ("u3", [], None, None)}
    changed = facts(spark, {n: f for n, f in second.items() if f[0] in ("u2", "u3")})
    old = store.read("symbols")
    solved = store.ingest("b", changed, spark.createDataFrame([("b.u1",), ("b.u2",), ("b.u3",)], "id string"))
    assert solved == 5 and old.count() == 5  # callers of what changed, too; and an old reader still has the old rows
    fresh = incremental.Store(spark, f"file://{tmp_path}/b")
    fresh.ingest("b", facts(spark, second))
    got, want = content(store), content(fresh)
    vectors = got.pop("embeddings")
    assert got == want and len(vectors) == 1 and "b:main" in vectors[0]
    assert not store.read("solved_summaries").where("id = 'b:smain'").first()["complete"]
    now = store.manifest()["tables"]["symbol_variants"]
    assert any(now.get(p) == at for p, at in files.items()) and any(now.get(p) != at for p, at in files.items())
    assert [r["reindex_required"] for r in store.read("build_variants").collect()] == [False]
    # a second build with the same symbols, which then goes again
    store.ingest("c", {t: df for t, df in facts(spark, FIRST, "c").items() if t in ("symbol_variants", "translation_units", "build_configurations")})
    assert store.read("symbols").count() == 7 and store.read("symbol_variants", ("c",)).count() == 5
    assert store.remove_build("c") and not store.remove_build("c")
    assert {t: x for t, x in content(store).items() if t != "embeddings"} == want


def test_a_reader_between_write_and_switch_sees_the_old_state(spark, tmp_path, monkeypatch):
    store = incremental.Store(spark, f"file://{tmp_path}/a")
    rows = variants(spark, [("f", "1", "u1"), ("g", "2", "u2")])
    store.commit({"symbol_variants": rows})
    seen = []

    def crash(number, content):
        seen.append(sorted(r["source_text"] for r in incremental.Store(spark, f"file://{tmp_path}/a").read("symbol_variants").collect()))
        raise OSError("lost")

    monkeypatch.setattr(store.manifests, "commit", crash)
    with pytest.raises(OSError):
        store.commit({"symbol_variants": rows.withColumn("source_text", F.lit("new"))})
    assert seen == [["1", "2"]]
    again = incremental.Store(spark, f"file://{tmp_path}/a")
    assert again.commit({"symbol_variants": rows.withColumn("source_text", F.lit("new"))}) == 2
    assert [r["source_text"] for r in again.read("symbol_variants").collect()] == ["new", "new"]


def test_units_of_a_backend_that_never_completes_are_not_analysed_for_ever(spark):
    current = spark.createDataFrame([("u", "u.cpp", "c", "light", False)], "id string, source_path string, command_hash string, analysis_backend string, advanced_facts_complete boolean")
    state = spark.createDataFrame([("u", "c", "h", "light", False)], "id string, command_hash string, content_hash string, analysis_backend string, advanced_facts_complete boolean")
    hashes = spark.createDataFrame([("u.cpp", "h")], "path string, content_hash string")
    deps = spark.createDataFrame([], "translation_unit_id string, path string, content_hash string")
    assert incremental.changed_units(current, state, hashes, deps).count() == 0
    assert incremental.changed_units(current.drop("advanced_facts_complete"), state, hashes, deps).count() == 1
