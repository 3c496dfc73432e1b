import json
import threading
import urllib.request

import pytest

from codeprism.plans import surface
from codeprism.sources import connectors
from codeprism.views import view

SF = "/root/testdata/sf0.001"
TABLES = ("cfg_graphs", "cfg_blocks", "cfg_elements", "cfg_edges", "data_flow_analyses", "memory_locations", "data_accesses", "data_flow_evidence", "edges", "callsites", "call_targets")


@pytest.fixture(scope="module")
def tools(spark):
    tables = {t: view(spark, SF, t) for t in TABLES}
    variants = [("b:one", "one", "one", "", "", "text of one", "a.cpp", 1, 2, True, "u", "alpha"), ("b:two", "two", "two", "", "", "other", "a.cpp", 3, 3, True, "u", "alpha")]
    tables["symbol_variants"] = spark.createDataFrame(variants, "id string, symbol_id string, qualified_name string, signature string, documentation string, source_text string, path string, start_line int, end_line int, is_definition boolean, translation_unit_id string, build_variant string")
    return surface.Tools(tables, ("alpha", "beta", "F", "O"))


def test_tools(tools, tmp_path):
    assert tools.call("list_builds", {})["builds"] == ["alpha", "beta", "F", "O"]
    flow = tools.call("control_flow", {"function": "fn_7", "max_blocks": 2})
    assert flow["truncated"] and {r["part"] for r in flow["rows"]} <= {"block", "element", "edge"}
    assert tools.call("data_flow", {"function": "fn_7", "builds": ["beta"]})["builds"] == ["beta"]
    assert [i["id"] for i in tools.call("search_code", {"query": "one"})["items"]] == ["b:one"]
    near = tools.call("neighbors", {"symbol": "p7", "fan_out": 3})
    assert len(near["edges"]) == 3 and near["truncated"]
    assert tools.call("callees", {"symbol": "fn_7", "fan_out": 2})["rows"]
    tools.root = f"file://{tmp_path}"
    (tmp_path / "a.cpp").write_text("l1\nl2\nl3")
    assert tools.call("read_symbol", {"symbol": "one"})["text"] == "l1\nl2"
    tools.provider = connectors.scripted('{"action": "answer", "answer": "it", "citations": ["b:one", "none"]}')
    assert tools.call("ask_code", {"question": "one"}) == {"answer": "it", "citations": ["b:one"], "complete": True}
    tools.provider = tools.root = None


@pytest.mark.parametrize(
    "name, arguments",
    [("nothing", {}), ("list_builds", {"x": 1}), ("search_code", {}), ("search_code", {"query": "one", "tokens": 1}), ("search_code", {"query": "one", "builds": ["gamma"]}), ("neighbors", {"symbol": "p7", "depth": 4}), ("neighbors", {"symbol": "p7", "relations": ["likes"]}), ("control_flow", {"function": "f", "max_graphs": 21}), ("read_symbol", {"symbol": "zzz"})],
)
def test_bad_calls(tools, name, arguments):
    with pytest.raises(ValueError):
        tools.call(name, arguments)


def test_http(tools):
    server = surface.serve(tools, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
    post = urllib.request.Request(f"{base}/v1/context", json.dumps({"query": "two"}).encode())
    assert [i["id"] for i in json.load(urllib.request.urlopen(post))["items"]] == ["b:two"]
    server.shutdown()
    assert surface.respond(tools, "POST", "/v1/context", b"[]")[0] == 422
    assert surface.respond(tools, "POST", "/v1/answer", b'{"question": "x"}')[0] == 503
    assert surface.respond(tools, "POST", "/v1/calls", b'{"symbol": "fn_7", "direction": "up"}')[0] == 422
    assert surface.respond(tools, "POST", "/v1/calls", b'{"symbol": "fn_7", "direction": "outgoing"}')[0] == 200
    assert surface.respond(tools, "GET", "/none")[0] == 404

    def failing(prompt):
        raise connectors.ConnectorError("the provider failed")

    tools.provider = failing
    assert surface.respond(tools, "POST", "/v1/answer", b'{"question": "one"}')[0] == 502
    tools.provider = None
