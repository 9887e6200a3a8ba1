"""Command line: analyze, diff, entrypoints, augment, diagram, binary, version."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys

VERSION = "0.1.0"
DIAGRAMS = ("call-graph", "class-hierarchy", "module-deps", "containment", "complexity", "data-flow")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein", description="Graph analytics over source code.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=text)
        for p in paths:
            own.add_argument(p)
        if paths:
            own.add_argument("--language", default=None)
            own.add_argument("--strict", action="store_true")
            own.add_argument("--allow-empty", action="store_true")
        return own

    analyze = command("analyze", "print the summary, the graph or hotspots", "path")
    what = analyze.add_mutually_exclusive_group()
    what.add_argument("--json", action="store_true")
    what.add_argument("--summary", action="store_true")
    what.add_argument("--complexity", type=int)
    command("diff", "compare two trees", "before", "after").add_argument("--json", action="store_true")
    entry = command("entrypoints", "list entrypoints", "path")
    entry.add_argument("--candidates", action="store_true")
    entry.add_argument("--evidence", action="store_true")
    augment = command("augment", "add findings of other tools", "path")
    for kind in ("sarif", "weaudit", "binary"):
        augment.add_argument(f"--{kind}", action="append", default=[])
    diagram = command("diagram", "print a Mermaid diagram", "path")
    diagram.add_argument("--type", choices=DIAGRAMS, required=True, dest="kind")
    diagram.add_argument("--focus")
    diagram.add_argument("--depth", type=int, default=2)
    diagram.add_argument("--threshold", type=int, default=10)
    diagram.add_argument("--direction", choices=("TD", "LR", "TB", "BT", "RL"), default="TD")
    binary = commands.add_parser("binary", help="import a native image")
    binary.add_argument("artifact")
    commands.add_parser("version", help="print the version")
    return top


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 2: error; 3: done, but some files could not be read whole."""
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from .bundle import GraphBundle
    from .engine import QueryEngine
    from .operators import diffing
    from .sources import snapshots

    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    build = lambda path: QueryEngine.from_directory(spark, path, args.language, strict=args.strict, allow_empty=args.allow_empty)
    try:
        if args.command == "binary":
            engine = QueryEngine(GraphBundle(spark))
            engine.augment_binary_file(args.artifact)
            print(engine.to_json())
            return 0
        if args.command == "diff":
            with contextlib.ExitStack() as stack:
                # What is no folder is a git reference of the repository that holds the second tree.
                before = args.before if os.path.isdir(args.before) else stack.enter_context(snapshots.at_reference(args.after, args.before))
                a, b = build(before), build(args.after)
                a.graph, b.graph = a.graph.materialised(), b.graph.materialised()
            print(json.dumps({k: _rows(v) for k, v in b.diff_against(a).items()}, indent=2) if args.json else diffing.report(a.graph, b.graph), end="")
            return 0
        engine = build(args.path)
        if args.command == "analyze":
            if args.complexity is not None:
                print(json.dumps(_rows(engine.complexity_hotspots(args.complexity).select("id", "cc")), indent=2))
            else:
                print(engine.to_json() if args.json else json.dumps(_rows(engine.summary())[0], indent=2))
        elif args.command == "entrypoints":
            print(json.dumps(_rows(engine.entrypoint_candidates() if args.candidates else engine.entrypoint_evidence() if args.evidence else engine.attack_surface()), indent=2))
        elif args.command == "augment":
            counts = {}
            for kind in ("sarif", "weaudit", "binary"):
                for path in getattr(args, kind):
                    with open(path, encoding="utf-8") as f:
                        counts[path] = getattr(engine, f"augment_{kind}")(f.read())
            print(json.dumps({"imports": counts, "findings": _rows(engine.findings())}, indent=2))
        else:
            print(engine.diagram(args.kind, args.focus, args.depth, args.threshold, args.direction))
        return 0 if engine.parse_diagnostics().isEmpty() else 3
    except (ValueError, RuntimeError, OSError) as e:
        print(f"skein: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
