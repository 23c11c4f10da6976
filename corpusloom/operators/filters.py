"""Filters, projections and column contracts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# Notes that stand in for a text.
PLACEHOLDERS = ("not worthwhile", "is omitted", "not translated", "no translation")
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def fold_split(df: DataFrame, fold: int, col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Rows outside the fold and rows in it; rows without a fold are in neither."""
    return df.where(F.col(col) != fold), df.where(F.col(col) == fold)


def among(df: DataFrame, col: str, values: Iterable, keep: bool = True) -> DataFrame:
    """Rows whose value is in a literal list, or those whose value is not (null in neither)."""
    inside = F.col(col).isin(list(values))
    return df.where(inside if keep else ~inside)


def non_blank(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & (strip(F.col(c)) != ""))
    return df


def without_placeholders(df: DataFrame, col: str, phrases: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    return df.where(~F.lower(F.col(col)).rlike("|".join(phrases)))


def length_ratio(a: Column, b: Column) -> Column:
    """Characters of b for each of a; an empty a counts as one character."""
    return F.length(b) / F.greatest(F.length(a), F.lit(1))


def ratio_between(df: DataFrame, a: str, b: str, low: float = 0.3, high: float = 4.0) -> DataFrame:
    return df.where(length_ratio(F.col(a), F.col(b)).between(low, high))


def swap_where(df: DataFrame, col: str, other: str, condition: Column) -> DataFrame:
    """col takes the value of other where the condition holds and other has one."""
    return df.withColumn(col, F.when(condition & F.col(other).isNotNull(), F.col(other)).otherwise(F.col(col)))


def first_non_blank(*cols: str | Column) -> Column:
    """The first of the values that is not blank, as it stands; null if there is none."""
    values = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.when(strip(v) != "", v) for v in values])


def false_like(col: str | Column) -> Column:
    """Only the word false counts; null does not."""
    value = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(strip(value.cast("string"))) == "false", F.lit(False))


def parse_bool(col: str | Column) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def safe_int(col: str | Column, default: int = 10**9) -> Column:
    """The whole number in a text, or the default, which sorts last."""
    value = F.col(col) if isinstance(col, str) else col
    text = strip(value.cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")), F.lit(default).cast("long"))


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def first_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """The first column of the list that df has, blank and null as "", else ""."""
    for name in names:
        if name in df.columns:
            return F.coalesce(strip(F.col(name).cast("string")), F.lit(""))
    return F.lit("")


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, in order; null if none does."""
    out = None
    for name, condition in reasons:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def route(df: DataFrame, reasons: Sequence[tuple[str, Column]], col: str = "skip_reason") -> tuple[DataFrame, DataFrame]:
    """The rows no condition rejects, and the others with the first reason that does."""
    marked = df.withColumn(col, first_reason(reasons))
    return marked.where(F.col(col).isNull()).drop(col), marked.where(F.col(col).isNotNull())


def stage_counts(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row: n_total, n_kept and for each reason n_<reason>; every row counts in exactly one of the latter."""
    reason = first_reason(reasons)
    counts = [F.count_if(F.coalesce(reason == name, F.lit(False))).alias(f"n_{name}") for name, _ in reasons]
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(reason.isNull()).alias("n_kept"), *counts)


def to_layout(df: DataFrame, names: Sequence[str], fill: str = "") -> DataFrame:
    """The named columns in that order; absent ones hold the fill."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(fill).alias(n) for n in names])


def directed(df: DataFrame, source: str, target: str, reverse: bool = False) -> DataFrame:
    """Columns input and target, swapped for the other direction."""
    a, b = (target, source) if reverse else (source, target)
    return df.withColumns({"input": F.col(a), "target": F.col(b)})


def submission(df: DataFrame, id_col: str, prediction: str, out_name: str, source: str | None = None, confidence: str | None = None) -> DataFrame:
    """id, prediction and, where asked for, the source text and the confidence."""
    cols = [F.col(id_col), F.col(prediction).alias(out_name)]
    cols += [F.col(source)] if source else []
    cols += [F.col(confidence).alias("confidence")] if confidence else []
    return df.select(*cols)
