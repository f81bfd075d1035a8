"""Command line: query, ingest and compact a store."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence

from pyspark.sql import Row, SparkSession

from chronofold.plans.query import Query
from chronofold.plans.rows import cell, to_json
from chronofold.plans.sexpr import parse_filter, parse_metrics, parse_order
from chronofold.sources.ndjson import ingest_files, ingest_lines, parse_time
from chronofold.sources.store import Store

DEFAULT_DAYS = 30


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronofold")
    commands = top.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run a grouped query")
    q.add_argument("--dimensions", default="")
    q.add_argument("--metrics", default="count")
    q.add_argument("--order-by", default="")
    q.add_argument("--start")
    q.add_argument("--end")
    q.add_argument("--granularity", default="day")
    q.add_argument("--timezone", default="UTC")
    q.add_argument("--where", default="")
    q.add_argument("--output", choices=("table", "json", "none"), default="table")
    i = commands.add_parser("ingest", help="append newline-delimited JSON from a file or the standard input")
    i.add_argument("--file", default="-")
    i.add_argument("--batch-size", type=int, default=1000)
    i.add_argument("--parallel", action="store_true", help="parse files of any size, a folder or a pattern on the executors, as one batch")
    c = commands.add_parser("compact", help="keep the last row of every key")
    c.add_argument("--key", required=True)
    c.add_argument("--include-active", action="store_true")
    for p in (q, i, c):
        p.add_argument("--store", required=True)
        p.add_argument("--dataset", default="")
        p.add_argument("--partition-format", default="")
        p.add_argument("-v", "--verbose", action="store_true")
    return top


def build_query(args: argparse.Namespace, now: float | None = None) -> Query:
    """The query of parsed arguments; without a range, the last thirty days."""
    at = time.time() if now is None else now
    return Query(
        dataset=args.dataset,
        start=parse_time(args.start) if args.start else at - DEFAULT_DAYS * 86400,
        end=parse_time(args.end) if args.end else at,
        dimensions=[d.strip() for d in args.dimensions.split(",") if d.strip()],
        metrics=parse_metrics(args.metrics),
        filter=parse_filter(args.where),
        order_by=parse_order(args.order_by),
        granularity=args.granularity,
        timezone=args.timezone,
    )


def render(rows: Sequence[Row], columns: Sequence[str]) -> str:
    """An aligned text table."""
    lines = [list(columns), *[[cell(r[c]) for c in columns] for r in rows]]
    widths = [max(len(line[k]) for line in lines) for k in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("chronofold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store, args.partition_format)
    began = time.time()
    if args.command == "ingest":
        if args.parallel:
            ingest_files(spark, store, args.dataset, args.file)
            return 0
        if args.file == "-":
            n = ingest_lines(store, args.dataset, sys.stdin, args.batch_size)
        else:
            with open(args.file, encoding="utf-8") as lines:
                n = ingest_lines(store, args.dataset, lines, args.batch_size)
        print(f"{n} rows")
    elif args.command == "compact":
        store.compact_dataset(args.dataset, args.key, args.include_active)
    else:
        query = build_query(args)
        if args.verbose:
            profile = store.profile(query)
            rows, columns = profile.rows, query.all_dimensions() + [m.name for m in query.all_metrics()]
        else:
            result = store.query(query)
            rows, columns = result.collect(), result.columns
        if args.output == "json":
            print("\n".join(json.dumps(to_json(r), ensure_ascii=False) for r in rows))
        elif args.output == "table":
            print(render(rows, columns))
        if args.verbose:
            scanned = profile.partitions - profile.pruned - profile.unmatched
            print(f"{scanned} of {profile.partitions} partitions, {profile.rows_in_range} rows in range, {profile.rows_matched} matched", file=sys.stderr)
        if args.verbose or args.output == "none":
            print(f"{len(rows)} rows in {time.time() - began:.2f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
