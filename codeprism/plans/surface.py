"""Tools and HTTP routes over the services: JSON in, JSON out, with hard maxima.

Failures are reported by kind: 422 for bad requests, 503 for what is not configured, 502 for a
failing provider. The source root does not appear in answers: paths below it become relative.
"""

from __future__ import annotations

import inspect
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lookups
from ..sources import files
from ..sources.connectors import ConnectorError
from . import retrieval, services

#: The most that one tool call may ask for.
MAXIMA = {"results": 20, "depth": 3, "fan_out": 25, "graph_results": 100, "tokens": 32_000, "steps": 6}
LEAST_TOKENS = 256
RELATIONS = "contains references calls inherits overrides uses_type includes instantiates specializes generated_by_macro".split()


class NotConfigured(RuntimeError):
    pass


@dataclass
class Tools:
    """The tools over one index. tables are the fact tables by name; root is where sources lie."""

    tables: dict[str, DataFrame]
    builds: tuple[str, ...]
    root: str | None = None
    provider: object = None
    evidence: DataFrame | None = None
    indexer: object = None
    index: object = None
    embed: object = None
    model: str = "local"
    names: tuple[str, ...] = field(default=("list_builds", "control_flow", "data_flow", "index_project", "search_code", "read_symbol", "neighbors", "callers", "callees", "ask_code"), init=False)

    def call(self, name: str, arguments: dict) -> dict:
        """A tool by name; unknown tools and arguments are bad requests."""
        if name not in self.names:
            raise ValueError(f"no tool is called {name}")
        method = getattr(self, name)
        known = method.__code__.co_varnames[1 : method.__code__.co_argcount]
        if extra := set(arguments) - set(known):
            raise ValueError(f"unknown arguments: {', '.join(sorted(extra))}")
        try:
            return redacted(method(**arguments), self.root)
        except TypeError as error:
            raise ValueError(str(error).split("()")[-1].strip()) from None

    def scope(self, builds) -> tuple[str, ...]:
        return services.resolve_scope(tuple(builds) if builds else None, self.builds)

    @staticmethod
    def within(name: str, value: int, least: int = 1) -> int:
        if not isinstance(value, int) or not least <= value <= MAXIMA[name]:
            raise ValueError(f"{name} must be from {least} to {MAXIMA[name]}")
        return value

    def symbol(self, name: str, scope: tuple[str, ...]) -> dict:
        row = lookups.get_symbol(self.tables["symbol_variants"], name, scope).first()
        if row is None:
            raise ValueError(f"no symbol is called {name}")
        return row.asDict()

    def list_builds(self) -> dict:
        return {"builds": list(self.builds[:16]), "truncated": len(self.builds) > 16}

    def control_flow(self, function: str, builds=None, max_graphs: int = 20, max_blocks: int = 500, max_elements: int = 2000, max_edges: int = 2000) -> dict:
        scope = self.scope(builds)
        return rows(services.control_flow(self.tables, function, scope, max_graphs, max_blocks, max_elements, max_edges), scope)

    def data_flow(self, function: str, builds=None, max_graphs: int = 20, max_locations: int = 1000, max_accesses: int = 2000, max_evidence: int = 2000) -> dict:
        scope = self.scope(builds)
        return rows(services.data_flow(self.tables, function, scope, max_graphs, max_locations, max_accesses, max_evidence), scope)

    def index_project(self, build: str, database: str) -> dict:
        if self.indexer is None:
            raise NotConfigured("no indexer is configured")
        return self.indexer(build, database)

    def engine(self, scope: tuple[str, ...]) -> retrieval.Engine:
        vectors = self.tables.get("embeddings") if self.embed is not None else None
        return retrieval.Engine(self.tables["symbol_variants"], self.tables["edges"], self.evidence, vectors, self.model, self.embed, scope, self.index)

    def search_code(self, query: str, builds=None, tokens: int = 4000, results: int = 20) -> dict:
        scope = self.scope(builds)
        found = retrieval.retrieve(self.engine(scope), query, self.within("tokens", tokens, LEAST_TOKENS), self.within("results", results))
        return {k: found[k] for k in ("query", "items", "estimated_tokens", "diagnostics", "truncated")} | {"builds": list(scope)}

    def read_symbol(self, symbol: str, builds=None) -> dict:
        row = self.symbol(symbol, self.scope(builds))
        if self.root is None:
            raise NotConfigured("no source root is configured")
        one = self.tables["symbol_variants"].where(F.col("id") == row["id"]).select("id", "path", "start_line", "end_line")
        text = files.read_symbols(one.sparkSession, self.root, one).first()
        if text["error"]:
            raise ValueError(text["error"])
        return {"id": row["id"], "qualified_name": row["qualified_name"], "path": row["path"], "text": text["text"]}

    def neighbors(self, symbol: str, builds=None, relations=None, depth: int = 1, direction: str = "both", fan_out: int = 25) -> dict:
        scope = self.scope(builds)
        if unknown := set(relations or ()) - set(RELATIONS):
            raise ValueError(f"unknown relations: {', '.join(sorted(unknown))}")
        limit, most = self.within("fan_out", fan_out), MAXIMA["graph_results"]
        every = self.within("depth", depth)
        kept = graph.neighbors(self.tables["edges"], symbol, relations, every, direction, most, limit, scope)
        # a node that shows as many edges as asked for may hide others: only those are looked at again
        ends = Counter(x for e in kept for x in {e["source_id"], e["target_id"]})
        cut = len(kept) >= most or any(n >= limit for n in ends.values())
        if cut and len(kept) < most:
            cut = len(graph.neighbors(self.tables["edges"], symbol, relations, every, direction, most + 1, limit + 1, scope)) > len(kept)
        return {"edges": kept, "truncated": cut, "builds": list(scope)}

    def _calls(self, symbol: str, builds, incoming: bool, fan_out: int) -> dict:
        scope = self.scope(builds)
        found = graph.callers_or_callees(self.tables["edges"], self.tables["callsites"], self.tables["call_targets"], symbol, incoming, scope, self.within("fan_out", fan_out))
        return rows(found, scope)

    def callers(self, symbol: str, builds=None, fan_out: int = 25) -> dict:
        return self._calls(symbol, builds, True, fan_out)

    def callees(self, symbol: str, builds=None, fan_out: int = 25) -> dict:
        return self._calls(symbol, builds, False, fan_out)

    def ask_code(self, question: str, builds=None, tokens: int = 4000, steps: int = 6) -> dict:
        if self.provider is None:
            raise NotConfigured("no language model is configured")
        engine = self.engine(self.scope(builds))
        size = self.within("tokens", tokens, LEAST_TOKENS)
        return retrieval.answer(lambda q: retrieval.retrieve(engine, q, size), self.provider, question, self.within("steps", steps))


def redacted(value, root: str | None):
    """JSON whose texts do not name the source root."""
    if isinstance(value, dict):
        return {k: redacted(v, root) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v, root) for v in value]
    if isinstance(value, str) and root:
        plain = re.sub(r"^[a-z0-9]+:(//)?", "", root.rstrip("/"))
        for form in (root.rstrip("/"), plain):
            if len(form) > 1:
                value = value.replace(f"{form}/", "").replace(form, ".")
    return value


def rows(df: DataFrame, scope: tuple[str, ...]) -> dict:
    """A bounded page as JSON; `truncated` is taken out of the rows."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return {"rows": [{k: v for k, v in r.items() if k != "truncated"} for r in found], "truncated": any(r.get("truncated") for r in found), "builds": list(scope)}


#: HTTP routes and the tools behind them.
ROUTES = {
    ("GET", "/v1/builds"): "list_builds",
    ("POST", "/v1/context"): "search_code",
    ("POST", "/v1/answer"): "ask_code",
    ("POST", "/v1/cfg"): "control_flow",
    ("POST", "/v1/flow"): "data_flow",
    ("POST", "/v1/calls"): "calls",
}


def respond(tools: Tools, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON of a request."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    name = ROUTES.get((method, path))
    if name is None:
        return 404, {"error": "there is no such route"}
    try:
        arguments = json.loads(body) if body else {}
        if not isinstance(arguments, dict):
            raise ValueError("a request is a JSON object")
        if name == "calls":
            direction = arguments.pop("direction", "incoming")
            if direction not in ("incoming", "outgoing"):
                raise ValueError("a direction is incoming or outgoing")
            name = "callers" if direction == "incoming" else "callees"
        return 200, tools.call(name, arguments)
    except ValueError as error:
        return 422, {"error": str(error)}
    except NotConfigured as error:
        return 503, {"error": str(error)}
    except ConnectorError as error:
        return 502, {"error": str(error)}


def serve(tools: Tools, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that answers ROUTES; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, value = respond(tools, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


#: The JSON types of tool arguments by their Python ones.
JSON_TYPES = {"int": "integer", "str": "string"}
MCP_VERSION = "2024-11-05"


def tool_schemas(tools: Tools) -> list[dict]:
    """Name, purpose and input schema of each tool, from its signature; lists are given without a type of their own."""
    out = []
    for name in tools.names:
        signature = inspect.signature(getattr(type(tools), name))
        given = list(signature.parameters.values())[1:]
        properties = {p.name: {"type": "array", "items": {"type": "string"}} if p.annotation is p.empty else {"type": JSON_TYPES[p.annotation]} for p in given}
        needed = [p.name for p in given if p.default is p.empty]
        out.append({"name": name, "description": name.replace("_", " "), "inputSchema": {"type": "object", "properties": properties, "required": needed, "additionalProperties": False}})
    return out


def mcp_answer(tools: Tools, message: dict) -> dict | None:
    """The JSON-RPC answer to one message of the Model Context Protocol; None for notifications."""
    number, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion") or MCP_VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeprism", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tool_schemas(tools)}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": "there is no such method"}}
    try:
        found, failed = json.dumps(tools.call(params.get("name"), params.get("arguments") or {}), default=str), False
    except (ValueError, NotConfigured, ConnectorError) as error:
        found, failed = str(redacted(str(error), tools.root)), True
    except Exception as error:  # what goes wrong inside is not shown
        found, failed = f"the tool failed: {type(error).__name__}", True
    return reply | {"result": {"content": [{"type": "text", "text": found}], "isError": failed}}


def serve_mcp(tools: Tools, source, sink) -> None:
    """Answer messages, one JSON object a line, until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            answer = mcp_answer(tools, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object"}}
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            sink.write(json.dumps(answer) + "\n")
            sink.flush()
