"""What a run leaves beside its results: settings, averages, a log of usage; and where files that belong together lie."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def write_artifact(spark: SparkSession, path: str, content: dict[str, Any], overwrite: bool = False) -> None:
    """A small JSON document at a path of any file system the engine knows; an existing one stays unless told otherwise."""
    fs, where = _file(spark, path)
    if fs.exists(where) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(content, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    finally:
        out.close()


def read_artifact(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def log_usage(usage: DataFrame, path: str, run: str) -> None:
    """Adds usage rows (model, prompt_tokens, completion_tokens, cost) of a run to a log of JSON lines."""
    rows = usage.select("model", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens"), F.col("cost").cast("double").alias("cost"))
    rows.withColumn("run", F.lit(run)).write.mode("append").json(path)


def usage_summary(spark: SparkSession, path: str, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Requests, tokens and cost of the log's rows; what is missing in a row counts as nothing."""
    log = spark.read.schema("model string, prompt_tokens long, completion_tokens long, cost double, run string").json(path)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), total("prompt_tokens"), total("completion_tokens"), total("cost"))


def companion_path(spark: SparkSession, given: str, table: str, folder: str, name: str = "pairs.csv") -> str | None:
    """The path given, which must exist; else the file of that name in the folder named after the table, if there is one."""
    if given.strip():
        if not exists(spark, given.strip()):
            raise FileNotFoundError(given)
        return given.strip()
    stem = table.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    path = f"{folder.rstrip('/')}/{stem}/{name}"
    return path if exists(spark, path) else None
