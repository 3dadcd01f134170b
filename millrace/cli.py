"""``python -m millrace.cli audit|digest|verify|subset|extract|sums``: small commands over the operators."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from millrace.operators.audit import quality_gates
from millrace.operators.subsets import select_subset, selection_report, spec_of
from millrace.sources.archives import extract, extraction_plan, read_archives
from millrace.sources.readers import read_metadata
from millrace.sources.sums import sum_problems, write_sums
from millrace.sources.writers import content_digest, verify_artifact, write_artifact


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command, print JSON; 2 means that a gate or check failed."""
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit")
    audit.add_argument("path")
    for name in ("id", "label", "exact", "near"):
        audit.add_argument(f"--{name}", required=True)
    audit.add_argument("--group", action="append", default=[])
    commands.add_parser("digest").add_argument("path")
    commands.add_parser("verify").add_argument("path")
    subset = commands.add_parser("subset", help="select rows of a catalog by a JSON specification and write them as an artifact")
    for name in ("path", "spec", "folder"):
        subset.add_argument(name)
    extraction = commands.add_parser("extract", help="extract the files of an artifact's rows from archives")
    for name in ("path", "archives", "root"):
        extraction.add_argument(name)
    extraction.add_argument("--dry-run", action="store_true")
    sums = commands.add_parser("sums", help="write the list of a folder's digests, or name what differs from it")
    sums.add_argument("path")
    sums.add_argument("--verify", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "verify":
        good, errors = verify_artifact(spark, args.path)
        print(json.dumps({"ok": good, "errors": errors}, sort_keys=True))
        return 0 if good else 2
    if args.command == "sums":
        problems = [r.asDict() for r in sum_problems(spark, args.path).orderBy("name").limit(100).collect()] if args.verify else []
        print(json.dumps({"problems": problems} if args.verify else {"files": write_sums(spark, args.path)}, sort_keys=True))
        return 2 if problems else 0
    if args.command == "extract":
        good, errors = verify_artifact(spark, args.path)
        if not good:
            print(json.dumps({"ok": False, "errors": errors}, sort_keys=True))
            return 2
        plan = extraction_plan(spark.read.parquet(f"{args.path}/rows"), read_archives(spark, args.archives))
        print(json.dumps({"archives": [r.asDict() for r in extract(plan, args.root, args.dry_run).orderBy("archive").collect()]}, sort_keys=True))
        return 0
    rows = read_metadata(spark, args.path)
    if args.command == "subset":
        with open(args.spec, encoding="utf-8") as f:
            spec = spec_of(json.load(f))
        chosen, short = select_subset(rows, spec)
        told = selection_report(chosen, short, spec)
        name, path = write_artifact(chosen, args.folder, spec, told, sums=True)
        print(json.dumps({"id": name, "path": path, "quota_shortfalls": told["quota_shortfalls"]}, sort_keys=True))
        return 0
    if args.command == "digest":
        print(json.dumps(content_digest(rows).first().asDict(), sort_keys=True))
        return 0
    gates = [r.asDict() for r in quality_gates(rows, args.id, args.label, args.exact, args.near, args.group).orderBy("gate").collect()]
    print(json.dumps({"gates": gates}, sort_keys=True))
    return 2 if any(g["verdict"] == "fail" for g in gates) else 0


if __name__ == "__main__":
    sys.exit(main())
