"""Unions, extensions and differences of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.filters import first_non_blank, false_like


def concat(*tables: DataFrame) -> DataFrame:
    """Rows of all, duplicates kept; the same columns."""
    return reduce(DataFrame.unionByName, tables)


def concat_diagonal(*tables: DataFrame) -> DataFrame:
    """Columns of all, null where a table lacks one; types are widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def concat_filled(*tables: DataFrame, fill: str = "") -> DataFrame:
    """Text columns of all in the order in which they first occur; missing or null values hold the fill."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    text = [t.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) if c in t.columns else F.lit(fill).alias(c) for c in names]) for t in tables]
    return reduce(DataFrame.unionByName, text)


def tagged(df: DataFrame, tag: str, layout: dict[str, str | None], needed: Sequence[str]) -> DataFrame:
    """df in a fixed layout (name: its column, or null) with source_dataset; rows that lack a needed value are dropped."""
    out = df.select(*[(F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(n) for n, c in layout.items()], F.lit(tag).alias("source_dataset"))
    for n in needed:
        out = out.where(first_non_blank(n).isNotNull())
    return out


def extend_pool(base: DataFrame, extras: DataFrame, id_col: str, marker: str | None = None) -> DataFrame:
    """Base rows as they are, and extras with fold -1: those marked false, or without a marker column those with new ids."""
    if marker and marker in extras.columns:
        added = extras.where(false_like(marker))
    else:
        added = extras.join(base.select(id_col), id_col, "left_anti")
    return base.unionByName(added.withColumn("fold", F.lit(-1)).select(*base.columns))


def minus(df: DataFrame, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of the columns that the other table lacks."""
    return df.select(*cols).distinct().join(other.select(*cols), list(cols), "left_anti")
