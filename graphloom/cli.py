"""Command line: index, query, causal-query, trace and status."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine, Query, SymbolNotFoundError
from .operators import traces
from .plans.tag_filter import QueryValidationError
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "status"):
        c = sub.add_parser(name)
        c.add_argument("repo")
        c.add_argument("--snapshot")
    for name in ("query", "causal-query"):
        c = sub.add_parser(name)
        c.add_argument("repo")
        c.add_argument("seed")
        c.add_argument("--budget", type=int, default=4000)
        c.add_argument("--d-max", type=float, default=5.0)
        c.add_argument("--task-type", default="implement")
        c.add_argument("--format", choices=("xml", "markdown", "json"), default="xml" if name == "causal-query" else "markdown")
        c.add_argument("--snapshot")
    c = sub.add_parser("trace")
    c.add_argument("repo")
    c.add_argument("otel")
    c.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if args.command == "trace":
            events = traces.spans_to_events(files.read_spans(spark, args.otel))
            engine = Engine.from_repo(spark, args.repo)
            traces.route_events(events, engine.symbols, engine.edges).write.mode("append").json(args.out)
            return 0
        engine = Engine.from_repo(spark, args.repo, args.snapshot)
        if args.command in ("index", "status"):
            print(engine.status().toJSON().first())
            return 0
        asked = Query(seed=args.seed, budget=args.budget, task_type=args.task_type, d_max=args.d_max)
        result = engine.retrieve(asked)
        if args.format == "json":
            for line in result.orderBy("ord").toJSON().toLocalIterator():
                print(line)
        else:
            print(engine.render(result, [asked], args.format).first()[1])
        return 0
    except (QueryValidationError, SymbolNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
