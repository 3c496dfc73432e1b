"""Command line.

Over driver tables: python -m codeprism list | run NAME SF_DIR | search SF_DIR QUERY | cfg, flow or calls SF_DIR FUNCTION.
Over a project's store: python -m codeprism project doctor | index | remove-build | builds | cfg | flow | search | ask | serve | mcp.
Settings come from the environment (see plans/runtime.py) and from options, which count more.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import catalog
from .plans import retrieval, retrieval_queries, runtime, services, surface
from .sources.connectors import ConnectorError
from .views import view


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeprism")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("list")
    run = c.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    search = c.add_parser("search")
    search.add_argument("sf_dir")
    search.add_argument("query")
    search.add_argument("--tokens", type=int, default=4000)
    search.add_argument("--results", type=int, default=20)
    for name in ("cfg", "flow", "calls", "builds"):
        q = c.add_parser(name)
        q.add_argument("sf_dir")
        if name != "builds":
            q.add_argument("function")
        if name == "calls":
            q.add_argument("--direction", default="incoming")
    project = c.add_parser("project").add_subparsers(dest="action", required=True)
    for name in ("doctor", "index", "remove-build", "builds", "cfg", "flow", "search", "ask", "serve", "mcp"):
        q = project.add_parser(name)
        for option in ("--store", "--root"):
            q.add_argument(option)
        q.add_argument("--build", action="append", metavar="NAME=DATABASE" if name == "index" else "NAME")
        if name == "index":
            q.add_argument("--facts")
        if name == "remove-build":
            q.add_argument("name")
        if name in ("cfg", "flow"):
            q.add_argument("function")
        if name in ("search", "ask"):
            q.add_argument("query")
            q.add_argument("--tokens", type=int)
        if name == "ask":
            q.add_argument("--steps", type=int, default=6)
        if name == "serve":
            q.add_argument("--host")
            q.add_argument("--port", type=int)
    return p


def run_project(a: argparse.Namespace, spark: SparkSession) -> int:
    """The commands of a project: JSON to standard output; 2 for bad requests, 3 for what is not configured, 4 for a failing provider."""
    builds = a.build or []
    scope = None if a.action == "index" else tuple(builds) or None
    try:
        given = {k: getattr(a, k, None) for k in ("store", "root", "facts", "host", "port", "tokens")}
        project = runtime.Project(spark, runtime.Config.from_environment(builds=scope, **given))
        if a.action == "doctor":
            out = project.doctor()
        elif a.action == "index":
            if not builds or not all("=" in b for b in builds):
                raise ValueError("name builds as NAME=DATABASE")
            if not project.config.facts:
                raise surface.NotConfigured("no fact streams are configured")
            analyse = runtime.stream_analyser(spark, project.config.facts)
            out = {name: project.index_build(name, database, analyse) for name, _, database in (b.partition("=") for b in builds)}
        elif a.action == "remove-build":
            out = {"removed": project.remove_build(a.name)}
        elif a.action == "builds":
            out = project.tools().call("list_builds", {})
        elif a.action in ("cfg", "flow"):
            out = project.tools().call("control_flow" if a.action == "cfg" else "data_flow", {"function": a.function})
        elif a.action == "search":
            out = project.tools().call("search_code", {"query": a.query} | ({"tokens": a.tokens} if a.tokens else {}))
        elif a.action == "ask":
            out = project.tools().call("ask_code", {"question": a.query, "steps": a.steps} | ({"tokens": a.tokens} if a.tokens else {}))
        elif a.action == "serve":
            surface.serve(project.tools(), project.config.host, project.config.port).serve_forever()
            return 0
        else:
            surface.serve_mcp(project.tools(), sys.stdin, sys.stdout)
            return 0
    except (ValueError, surface.NotConfigured, ConnectorError) as error:
        print(error, file=sys.stderr)
        return 2 if isinstance(error, ValueError) else 3 if isinstance(error, surface.NotConfigured) else 4
    print(json.dumps(out, default=str, indent=1))
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = lambda *names: {n: view(spark, a.sf_dir, n) for n in names}
    if a.command == "project":
        return run_project(a, spark)
    if a.command == "run":
        if a.name not in catalog.QUERIES:
            print(f"no query is called {a.name}", file=sys.stderr)
            return 2
        catalog.QUERIES[a.name](spark, a.sf_dir).show(50, truncate=80)
    elif a.command == "search":
        found = retrieval.retrieve(retrieval_queries.engine(spark, a.sf_dir), a.query, a.tokens, a.results)
        print(found["rendered"], *found["diagnostics"], sep="\n")
    elif a.command == "cfg":
        services.control_flow(tables("cfg_graphs", "cfg_blocks", "cfg_elements", "cfg_edges"), a.function).show(100, truncate=60)
    elif a.command == "flow":
        names = ("cfg_graphs", "data_flow_analyses", "memory_locations", "data_accesses", "cfg_blocks", "data_flow_evidence", "function_summaries", "summary_effects", "summary_return_origins", "interprocedural_flows")
        services.data_flow(tables(*names), a.function).show(100, truncate=60)
    elif a.command == "calls":
        services.calls(*tables("callsites", "call_targets").values(), a.function, a.direction, None, ("F", "O")).show(100, truncate=60)
    else:
        catalog.QUERIES["list_builds"](spark, a.sf_dir).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
