"""Deduplication: first, longest and shortest wins. All pre-aggregate before their exchange, so a hot key stays small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(df: DataFrame, keys: Sequence[str | Column], order: Column) -> DataFrame:
    names = [f"__k{n}" for n in range(len(keys))]
    keyed = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*df.columns).alias("__row"), order.alias("__order"))
    return keyed.groupBy(*names).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key in that order; null keys are keys."""
    return _best(df, keys, F.struct(*order))


def longest_wins(df: DataFrame, keys: Sequence[str | Column], text: str, order: str) -> DataFrame:
    """The row with the longest text of each key; the first of equals."""
    return _best(df, keys, F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(order)))


def shortest_text(df: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """The first row of each key, with the shortest non-empty text of the key (the first of equals)."""
    rest = [c for c in df.columns if c not in keys and c != text]
    filled = F.when(F.length(text) > 0, F.struct(F.length(text), F.col(order)))
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest, text), order).alias("__row"), F.min_by(text, filled).alias("__text"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest], F.coalesce("__text", F.col(f"__row.{text}")).alias(text))


def across_splits(df: DataFrame, pair: Sequence[str], split: Column, order: str) -> DataFrame:
    """Each pair once: of the split that comes first, then the first row."""
    return _best(df, list(pair), F.struct(split, F.col(order)))
