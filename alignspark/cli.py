"""Command line: load, test, run, watch."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .batch import run_jobs
from .harness import run_file
from .pipeline import MODES, load
from .sources.store import TableStore
from .streaming.watch import scan_folder

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alignspark", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--store", default=os.environ.get("ALIGNSPARK_STORE"), help="folder of the tables (or ALIGNSPARK_STORE)")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("load", help="load a file into a table")
    one.add_argument("source")
    one.add_argument("table")
    one.add_argument("--ops", choices=MODES, default="insert")
    one.add_argument("--pk", nargs="*")
    one.add_argument("--where", nargs="*", help='conditions such as "id = ?"')
    one.add_argument("--outlier", type=float)
    test = sub.add_parser("test", help="run the insert, upsert, update cycle on a file")
    test.add_argument("source")
    test.add_argument("table")
    test.add_argument("--pk", nargs="*")
    test.add_argument("--report")
    jobs = sub.add_parser("run", help="run the jobs of a configuration file")
    jobs.add_argument("config")
    watch = sub.add_parser("watch", help="load new and changed files of a folder once")
    watch.add_argument("folder")
    watch.add_argument("--manifest", default="manifest.json")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("alignspark").getOrCreate()
    store = TableStore(spark, args.store) if args.store else None
    if store is None and args.command != "run":
        print("no store: give --store or set ALIGNSPARK_STORE", file=sys.stderr)
        return 2
    if args.command == "load":
        extra = {"where": args.where} if args.where else {}
        print(load(spark, store, args.source, args.table, args.ops, args.pk, outlier_factor=args.outlier, **extra))
        return 0
    if args.command == "test":
        report = run_file(spark, store, args.source, args.table, args.pk, report_path=args.report)
        print(report)
        return int(not report.all_passed)
    if args.command == "run":
        found = run_jobs(spark, args.config, store)
        print(*found, sep="\n")
        return int(any(f["status"] == "failed" for f in found))
    print(scan_folder(spark, store, args.folder, args.manifest))
    return 0


if __name__ == "__main__":
    sys.exit(main())
