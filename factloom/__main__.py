"""Command line: build a knowledge base and ask it. Exit codes: 0 answered, 2 error,
3 the question needs clarification."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from factloom.plans import build, knowledge
from factloom.render import rendered
from factloom.sources import formxml, scan, store, symbols
from factloom.tools import Tools, serve
from factloom.web import server


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("--kb")
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("sources")
    b.add_argument("metadata")
    b.add_argument("--symbols")
    for name in ("trace", "operation", "callers", "bill", "search", "whois"):
        one = sub.add_parser(name)
        one.add_argument("key")
        one.add_argument("--cursor")
    sub.add_parser("resolve").add_argument("keys", nargs="+")
    for name in ("coverage", "scan-compare", "dynwrites", "overview", "map", "forms"):
        sub.add_parser(name)
    sub.add_parser("tools")
    sub.add_parser("web").add_argument("--port", type=int, default=8765)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    folder = store.find_kb(args.kb, getattr(args, "sources", None))
    if args.command == "build":
        log = symbols.read_events(spark, args.symbols) if args.symbols else None
        kb = build.build(
            spark, folder, scan.scan(spark, args.sources), formxml.read_models(spark, args.metadata), symbols.sites(log) if log is not None else None,
            symbols.status(log).first().asDict() if log is not None else None,
        )
        print(json.dumps(kb.meta(), indent=2))
        return 0
    kb = store.open_kb(spark, folder)
    if kb is None:
        print(f"no knowledge base of this version in {folder}", file=sys.stderr)
        return 2
    if args.command == "web":
        server(kb, args.port).serve_forever()
    if args.command == "tools":
        serve(Tools(kb), sys.stdin, sys.stdout)
        return 0
    ask = {
        "trace": lambda: knowledge.trace_field(kb, args.key, cursor=args.cursor), "operation": lambda: knowledge.trace_operation(kb, args.key),
        "callers": lambda: knowledge.callers(kb, args.key, args.cursor), "bill": lambda: knowledge.bill(kb, args.key), "search": lambda: knowledge.search(kb, args.key),
        "whois": lambda: knowledge.whois(kb, args.key), "resolve": lambda: knowledge.resolve_keys(kb, args.keys), "coverage": lambda: knowledge.coverage(kb),
        "scan-compare": lambda: knowledge.scan_compare(kb), "dynwrites": lambda: knowledge.dynamic_writes(kb), "overview": lambda: knowledge.overview(kb),
        "map": lambda: knowledge.project_map(kb), "forms": lambda: knowledge.forms(kb),
    }
    try:
        answer = ask[args.command]()
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    print(json.dumps(answer, indent=2, default=str) if args.json else rendered(args.command, answer))
    if isinstance(answer, dict):
        return 3 if answer.get("need_clarification") else 2 if answer.get("error") else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
