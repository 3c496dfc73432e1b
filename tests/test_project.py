"""A project from compilation database and fact streams to answers, over all surfaces."""

import io
import json

import pytest

from codeprism import __main__ as cli
from codeprism.plans import runtime, surface
from codeprism.sources import connectors, facts


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    """Two units: a.cpp with main and helper, b.cpp with other; and their fact stream."""
    root = tmp_path_factory.mktemp("project")
    (root / "a.cpp").write_text("int main() {\n return helper();\n}\nint helper() { return 1; }\n")
    (root / "b.cpp").write_text("void other() {}\n")
    entries = [{"directory": str(root), "file": n, "arguments": ["c++", "-c", n, "-o", f"{n}.o"]} for n in ("a.cpp", "b.cpp")]
    (root / "compile_commands.json").write_text(json.dumps(entries))
    config = runtime.Config.from_environment({}, store=f"file://{root}/store", root=f"file://{root}", dimensions=16)
    p = runtime.Project(spark, config)
    ids = {r["source_path"].rsplit("/", 1)[1]: r["id"] for r in runtime.compilation.load(spark, f"file://{root}/compile_commands.json", "main").collect()}

    def stream(**names):
        lines = [{"type": "hello", "protocol": facts.PROTOCOL, "clang_major": facts.COMPILER, "capabilities": sorted(facts.CAPABILITIES)}]
        for file, symbols in names.items():
            file = f"{file}.cpp"
            lines.append({"type": "begin", "request_id": file})
            prov = {"translation_unit_id": f"tu-{file}", "build_configuration_id": ids[file], "build_variant": "main"}
            for i, s in enumerate(symbols):
                lines.append({"type": "fact", "request_id": file, "fact": "symbol", "id": f"v-{s}", "symbol_id": s, "qualified_name": s, "kind": "function", "path": file, "start_line": 1 + 3 * i, "end_line": 3 + i, "signature": f"int {s}()", "documentation": "", "source_text": f"{s} body", "is_definition": True, **prov})
            lines.append({"type": "complete", "request_id": file, "success": True})
        (root / "facts").mkdir(exist_ok=True)
        (root / "facts" / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))

    return p, root, stream


def test_index_search_and_remove(spark, project):
    p, root, stream = project
    analyse = runtime.stream_analyser(spark, f"file://{root}/facts")
    database = f"file://{root}/compile_commands.json"
    stream(a=["main", "helper"], b=["other"])
    first = p.index_build("main", database, analyse)
    assert (first["indexed"], first["skipped"], first["removed"], first["symbol_variants"], first["embedded"]) == (2, 0, 0, 3, 3)
    again = p.index_build("main", database, analyse)
    assert (again["indexed"], again["skipped"], again["removed"], again["embedded"]) == (0, 2, 0, 0)
    (root / "b.cpp").write_text("void renamed() {}\n")
    stream(a=["main", "helper"], b=["renamed"])
    third = p.index_build("main", database, analyse)
    assert (third["indexed"], third["skipped"], third["symbol_variants"], third["embedded"]) == (1, 1, 1, 1)
    tools = p.tools()
    assert [i["id"] for i in tools.call("search_code", {"query": "renamed"})["items"]][0] == "v-renamed"
    assert not any(i["id"] == "v-other" for i in tools.call("search_code", {"query": "other"})["items"])
    assert tools.call("read_symbol", {"symbol": "main"})["text"].startswith("int main()")
    assert p.store.read("embeddings").count() == 3
    report = p.doctor()
    assert report["builds"] == ["main"] and report["search_index"] and str(root) not in json.dumps(report)

    answers = io.StringIO()
    calls = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_builds"}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "ask_code", "arguments": {"question": "x"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "nothing"},
    ]
    surface.serve_mcp(tools, io.StringIO("\n".join(map(json.dumps, calls)) + "\n{broken\n[]\n"), answers)
    got = [json.loads(x) for x in answers.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, None, None]
    assert got[0]["result"]["serverInfo"]["name"] == "codeprism" and len(got[1]["result"]["tools"]) == 10
    near = next(t for t in got[1]["result"]["tools"] if t["name"] == "neighbors")["inputSchema"]
    assert near["required"] == ["symbol"] and near["properties"]["depth"] == {"type": "integer"}
    assert json.loads(got[2]["result"]["content"][0]["text"])["builds"] == ["main"]
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700

    assert p.remove_build("main") and not p.remove_build("main") and p.builds() == ()


def test_project_commands(spark, project, capsys, monkeypatch):
    p, root, stream = project
    monkeypatch.delenv("CODEPRISM_STORE", raising=False)
    assert cli.main(["project", "doctor"], spark) == 3
    monkeypatch.setenv("CODEPRISM_STORE", f"file://{root}/store2")
    monkeypatch.setenv("CODEPRISM_EMBEDDINGS", "none")
    stream(a=["main", "helper"], b=["other"])
    assert cli.main(["project", "index"], spark) == 2
    assert cli.main(["project", "index", "--build", f"main=file://{root}/compile_commands.json", "--facts", f"file://{root}/facts"], spark) == 0
    assert cli.main(["project", "search", "helper", "--root", str(root)], spark) == 0
    out = capsys.readouterr().out
    assert "v-helper" in out and str(root) not in out
    assert cli.main(["project", "cfg", "main", "--build", "nothing"], spark) == 2
    assert cli.main(["project", "ask", "why"], spark) == 3
    assert cli.main(["project", "remove-build", "main"], spark) == 0 and cli.main(["project", "builds"], spark) == 0


def test_configuration():
    c = runtime.Config.from_environment({"CODEPRISM_PORT": "9", "CODEPRISM_BUILDS": "a, b,", "CODEPRISM_FACTS_COMPLETE": "no", "CODEPRISM_LLM_KEY": "secret", "CODEPRISM_TIMEOUT": "2.5"}, port=None, store="s")
    assert (c.port, c.builds, c.facts_complete, c.timeout, c.store) == (9, ("a", "b"), False, 2.5, "s") and "secret" not in repr(c)
    for bad in ({"CODEPRISM_PORT": "x"}, {"CODEPRISM_PORT": "0"}, {"CODEPRISM_EMBEDDINGS": "other"}, {"CODEPRISM_EMBEDDINGS": "http"}, {"CODEPRISM_LLM_URL": "u"}, {"CODEPRISM_FACTS_COMPLETE": "maybe"}):
        with pytest.raises(ValueError):
            runtime.Config.from_environment(bad)


def test_redaction():
    assert surface.redacted({"a": ["/w/x/f.cpp", "see /w/x now"], "n": 1}, "file:///w/x/") == {"a": ["f.cpp", "see . now"], "n": 1}
    assert surface.redacted("/w/x/f", None) == "/w/x/f"


@pytest.mark.parametrize("rows", [[{"index": 0, "embedding": [1.0, "x"]}, {"index": 1, "embedding": [1.0]}], [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}], [{"index": 0, "embedding": [float("inf")]}, {"index": 1, "embedding": [1.0]}], [{"index": 0}, {"index": 1, "embedding": [1.0]}], "x"])
def test_providers_must_give_good_vectors(rows):
    with pytest.raises(connectors.ConnectorError):
        connectors.vectors_of({"data": rows}, 2)
