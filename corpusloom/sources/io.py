"""Readers and writers. Schemas are explicit; quotes are doubled; line breaks may stand in fields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import normalize_ws
from corpusloom.session import materialize

CSV = {"header": True, "multiLine": True, "escape": '"', "nullValue": ""}


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, tolerant: bool = False, corrupt: str | None = None) -> DataFrame:
    """A CSV with a schema; an empty field is null. tolerant: cells that don't parse are null; corrupt: their raw lines."""
    options = CSV | {"mode": "PERMISSIVE" if tolerant else "FAILFAST"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    return spark.read.options(**options).schema(schema).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types from all rows; reads the file twice."""
    return spark.read.options(**CSV, inferSchema=True, samplingRatio=1.0).csv(path)


def read_text_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, missing values as "", "NA" as itself; only the columns asked for are parsed."""
    df = spark.read.options(**CSV | {"emptyValue": ""}).csv(path)
    df = df.select(*columns) if columns else df
    return df.fillna("")


def read_many(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Several text CSVs one after another with their path; columns some lack are ""."""
    tables = [read_text_csv(spark, p, columns).withColumn("source_path", F.lit(p)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).fillna("")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no from 0, line: lines in the order of the files' paths and of their places in them.

    The engine numbers rows by partition and place in it, which is the order of a file's splits; splits are put in the order
    of path and offset by what they hold, one row for each, and a prefix sum over these gives each its first number.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    rows = materialize(rows, "lines")
    splits = rows.groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("__start", before).drop("__n")
    return rows.join(starts, ["__path", "__block"]).select((F.col("__start") + F.col("__at") - F.col("__first")).alias("line_no"), "line")


def read_line_pairs(spark: SparkSession, source: str, target: str) -> DataFrame:
    """line_no, source, target of two files aligned by line; fails if one is longer."""
    a = numbered_lines(spark, source).withColumnRenamed("line", "source")
    b = numbered_lines(spark, target).withColumnRenamed("line", "target")
    uneven = F.raise_error(F.lit("files differ in their number of lines")).cast("string")
    both = a.join(b, "line_no", "full")
    return both.select("line_no", F.coalesce("source", uneven).alias("source"), F.coalesce("target", uneven).alias("target"))


def read_responses(spark: SparkSession, path: str, schema: T.StructType | str, version: int, requests: DataFrame | None = None, request: Sequence[str] = (), whole_files: bool = False) -> DataFrame:
    """Cached responses of a version, JSON lines or one document a file; what doesn't parse is a miss.

    requests, request: only responses whose request columns (the key, the input's text or its digest) equal those of a request
    count; one of another request is a miss too. Nulls equal nulls.
    """
    found = spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=whole_files).where(F.col("version") == version)
    if requests is None:
        return found
    asked = requests.select(*[F.col(c).alias(f"__{c}") for c in request]).distinct()
    same = F.lit(True)
    for c in request:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return found.join(asked, same, "left_semi")


def file_index(spark: SparkSession, glob: str, key_pattern: str, preferred: dict[str, str] | None = None) -> DataFrame:
    """key, path of the files, the key from their path; two files of one key fail, but where the key has a preferred file name."""
    files = spark.read.format("binaryFile").load(glob).select("path").withColumn("key", F.upper(F.regexp_extract("path", key_pattern, 1)))
    if preferred:
        wanted = F.create_map(*[F.lit(x) for pair in preferred.items() for x in (pair[0].upper(), pair[1])])
        name = F.element_at(F.split("path", "/"), -1)
        files = files.withColumn("__liked", F.coalesce(name == F.element_at(wanted, F.col("key")), F.lit(False)))
    else:
        files = files.withColumn("__liked", F.lit(False))
    twice = F.raise_error(F.concat(F.lit("two files for "), F.col("key"))).cast("string")
    by = files.groupBy("key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__liked"), F.col("path"))).alias("liked"))
    return by.select("key", F.when(F.col("liked").isNotNull(), F.col("liked")).when(F.col("n") > 1, twice).otherwise(F.col("path")).alias("path"))


def page_ranges(volumes: DataFrame, known: DataFrame, first: int = 1, last: int = 10_000) -> DataFrame:
    """volumes with the known first and last page of their key, else the fallback."""
    return volumes.join(known.select("key", F.col("first_page").alias("__a"), F.col("last_page").alias("__b")), "key", "left").select(
        *volumes.columns, F.coalesce("__a", F.lit(first)).alias("first_page"), F.coalesce("__b", F.lit(last)).alias("last_page")
    )


def write_csv(df: DataFrame, path: str, overwrite: bool = False, one_file: bool = False) -> None:
    """Refuses to replace an output unless told to. one_file: for results as small as a file."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite" if overwrite else "errorifexists").options(header=True, escape='"').csv(path)


def write_by(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False, fmt: str = "parquet") -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """One JSON object per line, in order over the files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str, columns: Sequence[str], rows_at_once: int = 10_000) -> None:
    """Adds rows to a folder of CSV files, each with its header, of at most so many rows; the columns in the given order.

    A folder that exists is added to, never read. Files appear whole or not at all, so what a lost job had written stays sound.
    """
    df.select(*columns).write.mode("append").options(header=True, escape='"', maxRecordsPerFile=rows_at_once).csv(path)


def resume_state(existing: DataFrame, columns: Sequence[str], id_col: str) -> tuple[int, int]:
    """Rows there are and the next id; fails if the columns are not those or an id is missing."""
    if set(existing.columns) != set(columns):
        raise ValueError(f"existing output has columns {sorted(existing.columns)}, not {sorted(columns)}")
    row = existing.agg(F.count(F.lit(1)).alias("n"), F.max(F.col(id_col).cast("long")).alias("last"), F.count_if(F.col(id_col).cast("long").isNull()).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows of the existing output lack {id_col}")
    return row["n"], (row["last"] if row["last"] is not None else -1) + 1


def resumed(rows: DataFrame, existing: DataFrame, columns: Sequence[str], id_col: str, text: str, wanted: int) -> DataFrame | None:
    """The rows still to be made: none (None) if the output has as many as wanted, else those whose text it does not hold.

    Texts are equal but for case and white space.
    """
    count, _ = resume_state(existing, columns, id_col)
    if count >= wanted:
        return None
    key = lambda c: F.lower(F.replace(normalize_ws(c), F.lit("ß"), F.lit("ss")))
    return rows.join(existing.select(key(text).alias("__known")).distinct(), key(text) == F.col("__known"), "left_anti")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
