"""Commands: scan, doctor, find-files, find-symbol, list-symbols, callers, dependents, trace, impact, context, export, reduce-output."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from graphloom.operators.text import reduced_output


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--index", help="folder of the published generations, on any file system that Spark knows")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "doctor"):
        sub.add_parser(name).add_argument("root")
    files = sub.add_parser("find-files")
    files.add_argument("name", nargs="?")
    files.add_argument("--kind")
    for name in ("find-symbol", "list-symbols"):
        sub.add_parser(name).add_argument("name")
    for name in ("callers", "dependents"):
        q = sub.add_parser(name)
        q.add_argument("name")
        q.add_argument("--depth", type=int, default=1)
        q.add_argument("--file")
        q.add_argument("--candidates", action="store_true")
    trace = sub.add_parser("trace")
    trace.add_argument("source")
    trace.add_argument("target")
    impact = sub.add_parser("impact")
    impact.add_argument("names", nargs="+")
    impact.add_argument("--depth", type=int, default=2)
    context = sub.add_parser("context")
    context.add_argument("task")
    context.add_argument("--target", action="append", default=[])
    context.add_argument("--tokens", type=int)
    export = sub.add_parser("export")
    export.add_argument("path")
    export.add_argument("--repo", default="")
    export.add_argument("--sha", default="")
    reduce = sub.add_parser("reduce-output")
    reduce.add_argument("kind")
    reduce.add_argument("exit_code", type=int)
    return p


def run(a: argparse.Namespace, engine) -> object:
    match a.command:
        case "scan" | "doctor":
            return getattr(engine, a.command)(a.root)
        case "find-files":
            return engine.find_files(a.kind, a.name)
        case "find-symbol" | "list-symbols":
            return getattr(engine, a.command.replace("-", "_"))(a.name)
        case "callers" | "dependents":
            return getattr(engine, a.command)(a.name, a.depth, a.file, a.candidates)
        case "trace":
            return engine.trace_path(a.source, a.target)
        case "impact":
            return engine.impact(a.names, a.depth)
        case "context":
            return engine.context(a.task, a.target, a.tokens)
        case "export":
            return engine.export(a.path, a.repo, a.sha)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "reduce-output":
        print(reduced_output(sys.stdin.read(), a.kind, a.exit_code))
        return 0
    from pyspark.sql import SparkSession

    from graphloom.api import Engine
    from graphloom.plans.ship import ship

    spark = SparkSession.builder.master(a.master).appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    out = run(a, Engine(spark, a.index))
    print(json.dumps(dataclasses.asdict(out) if dataclasses.is_dataclass(out) else out, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
