"""Aggregations: firsts, distinct lists, counts, character audits, usage, element-wise means, votes."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_first(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str) -> DataFrame:
    """For each group the values of its first row."""
    return df.groupBy(*keys).agg(*[F.min_by(F.struct(c), order)[c].alias(c) for c in cols])


def distinct_lists(df: DataFrame, keys: Sequence[str], cols: Sequence[str], count: str | None = None) -> DataFrame:
    """Sorted distinct values of the columns (nulls dropped) and the number of distinct values of one of them."""
    aggs = [F.sort_array(F.collect_set(c)).alias(c) for c in cols]
    if count:
        aggs.append(F.count_distinct(count).alias(f"n_{count}"))
    return df.groupBy(*keys).agg(*aggs)


def shown(values: Column) -> Column:
    """A list as text; sorted before numbers become text."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ", ")


def cut_counts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows, rows with a, rows with b, rows with either; a null condition does not hold."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a | b).alias("n_any"))


@F.pandas_udf(T.StringType())
def unicode_name(chars: pd.Series) -> pd.Series:
    return chars.map(lambda c: unicodedata.name(c, "UNKNOWN") if c else None)


def char_audit(df: DataFrame, col: str, allowed: str, names: bool = False) -> DataFrame:
    """char, n, codepoint (and unicode_name) of the characters that are not allowed; the space is never counted.

    The allowed ones are removed in the row, before anything is exploded; counts are pre-aggregated.
    """
    # translate() deletes characters without a counterpart.
    odd = F.translate(F.coalesce(F.col(col), F.lit("")), allowed + " ", "")
    counts = df.select(F.explode(F.split(odd, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("codepoint", F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("ascii(char)")), 4, "0")))
    return out.withColumn("unicode_name", unicode_name("char")) if names else out


def usage_totals(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("requests"))


def vector_mean(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean of equally long vectors of a group; groups whose vectors differ in length fail.

    Elements are averaged one by one, so a group with a third of all rows is pre-aggregated in each task.
    """
    each = df.select(*keys, F.size(vector).alias("__n"), F.posexplode(vector).alias("__pos", "__x"))
    means = each.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.min("__n").alias("__low"), F.max("__n").alias("__high"))
    whole = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__pos", "__m"))).alias("__v"), F.min("__low").alias("__low"), F.max("__high").alias("__high"))
    checked = whole.withColumn("__v", F.when(F.col("__low") == F.col("__high"), F.col("__v")).otherwise(F.raise_error(F.lit("vectors of a group differ in length")).cast("array<struct<__pos:int,__m:double>>")))
    return checked.select(*keys, F.transform("__v", lambda x: x["__m"]).alias(vector))


def majority_vote(df: DataFrame, group: Sequence[str], sample: str, key: str, order: str, share: float = 0.5) -> DataFrame:
    """Keys with votes from at least share of the samples (one at least), a sample voting once for a key.

    Columns: group, key, votes, first (the order of its first sight).
    """
    samples = df.groupBy(*group).agg(F.count_distinct(sample).alias("__n"))
    votes = df.groupBy(*group, key).agg(F.count_distinct(sample).alias("votes"), F.min(order).alias("first"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("__n") * share))
    return votes.join(samples, list(group)).where(F.col("votes") >= needed).drop("__n")


def distinct_keys(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.trim(col) != "").select(col).distinct()
