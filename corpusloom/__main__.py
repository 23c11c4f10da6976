"""Commands: python -m corpusloom list | run NAME TABLES OUT | clean ... | pool ... | usage ...

Every command is a plan of the library with its settings as options; --set NAME=VALUE changes one, --settings FILE reads a
JSON document of them. What a command writes it does not replace unless told to, and its settings lie beside it.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    clean = commands.add_parser("clean", help="staged cleaning of extracted pairs")
    clean.add_argument("table")
    clean.add_argument("--record", default="canonical_excavation_number")
    clean.add_argument("--translation", default="translation")
    clean.add_argument("--transliteration", default="transliteration")
    clean.add_argument("--volume", default=None)
    clean.add_argument("--pipeline", action="store_true", help="the pipeline's cleaners, not the document-level ones")
    pool = commands.add_parser("pool", help="a pool of examples")
    pool.add_argument("table")
    pool.add_argument("--order", default="id")
    pool.add_argument("--columns", default="translation")
    usage = commands.add_parser("usage", help="sums of a usage log")
    usage.add_argument("log")
    for c in (run, clean, pool):
        c.add_argument("out")
        c.add_argument("--overwrite", action="store_true")
    pool.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    pool.add_argument("--settings", default=None)
    return out


def _settings(name: str, args: argparse.Namespace):
    from corpusloom import config

    given = {}
    if args.settings:
        with open(args.settings, encoding="utf-8") as f:
            given |= json.load(f)
    given |= dict(pair.split("=", 1) for pair in args.set)
    return config.settings(name, given)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    from corpusloom import catalog
    from corpusloom.sources import artifacts

    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args.command == "run" and args.name not in catalog.QUERIES:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    if args.command == "usage":
        artifacts.usage_summary(spark, args.log).orderBy("run").show(1000, truncate=False)
        return 0
    mode = "overwrite" if args.overwrite else "errorifexists"
    note: dict = {"command": args.command, **{k: v for k, v in vars(args).items() if k not in ("command", "settings", "set")}}
    if args.command == "run":
        catalog.QUERIES[args.name](spark, args.tables).write.mode(mode).parquet(args.out)
    elif args.command == "clean":
        from corpusloom.plans import extraction

        done = extraction.cleaned_extracts(spark.read.parquet(args.table), args.record, args.translation, args.transliteration, args.volume, document=not args.pipeline)
        done.kept.write.mode(mode).parquet(f"{args.out}/kept")
        done.rejected.write.mode(mode).parquet(f"{args.out}/rejected")
        note["counts"] = done.counts.first().asDict()
    else:
        from corpusloom.plans import corpus

        record = _settings("pool", args)
        rows = spark.read.parquet(args.table)
        rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(None).cast("int"))
        corpus.example_pool(rows, args.columns.split(","), args.order, record.most, record.least, record.skip_fold, record.unique).write.mode(mode).parquet(args.out)
        note["settings"] = record.__dict__
    artifacts.write_artifact(spark, f"{args.out.rstrip('/')}.run.json", note, overwrite=args.overwrite)
    return 0


if __name__ == "__main__":
    sys.exit(main())
