"""Row numbers, document context, bins, folds, shards, samples."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

TAG_BYTES, SEPARATOR_BYTES = 22, 7


def grouped_index(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "row_index", offset: int = 0, total: str | None = None) -> DataFrame:
    """A gapless index inside each group in that (ascending) order, without gathering a group in one task. total: a column for the group's rows.

    A range exchange spreads the rows over the whole order, so a group with a third of all rows is split; the rows of each
    group in each partition, counted, give every partition its start in the group.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = {f"__o{n}": c for n, c in enumerate(cols)}
    ranged = df.withColumns(keys).repartitionByRange(*groups, *keys).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "grouped-index")
    totals = ranged.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{n}") for n, g in enumerate(groups)], F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"), F.sum("__rows").over(Window.partitionBy(*groups)).alias("__all"))
    inside = F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*keys))
    same = F.col("__part") == F.col("__p")
    for n, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{n}"))
    indexed = ranged.withColumn("__in", inside).join(starts, same)
    return indexed.select(*df.columns, (F.col("__start") + F.col("__in") - 1 + offset).alias(name), *([F.col("__all").alias(total)] if total else []))


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index", offset: int = 0, total: str | None = None) -> DataFrame:
    """A gapless global index in that order, without a single-task sort: one group."""
    return grouped_index(df, [], order, name, offset, total)


def context_prefix(df: DataFrame, group: str, order: Sequence[str], text: str, previous: int, max_bytes: int = 0, name: str = "context") -> DataFrame:
    """Up to `previous` texts before a row in its group, oldest first, between tags; the oldest are dropped until it fits."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(-previous, -1)
    parts = F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(window)
    df = df.withColumn("__parts", parts)
    if max_bytes > 0:
        # The longest run of newest texts that fits; from n texts down to none.
        sizes = F.transform("__parts", lambda p: F.octet_length(p))
        fits = F.filter(
            F.sequence(F.lit(0), F.size("__parts")),
            lambda n: (n == 0) | (TAG_BYTES + F.aggregate(F.slice(sizes, F.size("__parts") - n + 1, F.greatest(n, F.lit(1))), F.lit(0), lambda a, x: a + x) + SEPARATOR_BYTES * (n - 1) <= max_bytes),
        )
        most = F.array_max(fits)
        df = df.withColumn("__parts", F.when(most > 0, F.slice("__parts", F.size("__parts") - most + 1, most)).otherwise(F.array().cast("array<string>")))
    body = F.concat(F.lit("[context] "), F.array_join("__parts", " [sep] "), F.lit(" [/context] "))
    return df.withColumn(name, F.when(F.size("__parts") > 0, body).otherwise("")).drop("__parts")


def join_next(df: DataFrame, group: str, order: Sequence[str], cols: Sequence[str], share: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows with the next row of their group appended to the columns (by a space); a share of them, chosen by a hash."""
    window = Window.partitionBy(group).orderBy(*order)
    following = {f"__n_{c}": F.lead(c).over(window) for c in cols}
    both = df.withColumns(following | {"__has": F.lead(F.lit(1)).over(window)}).where("__has = 1")
    if share < 1.0:
        both = both.where(F.pmod(F.xxhash64(group, *order, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    return both.withColumns({c: F.concat_ws(" ", c, f"__n_{c}") for c in cols}).drop("__has", *following)


def quantile_bin(df: DataFrame, value: str, order: Sequence[str], bins: int, name: str = "bin") -> DataFrame:
    """floor(rank * bins / rows) by the value; rows without a finite value have no bin. Equal values go by the order."""
    finite = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf"))
    good = row_index(df.where(finite), [value, *order], "__rank", total="__n")
    binned = good.withColumn(name, F.floor(F.col("__rank") * bins / F.col("__n")).cast("int")).drop("__rank", "__n")
    return binned.unionByName(df.where(~finite).withColumn(name, F.lit(None).cast("int")))


def spread_folds(df: DataFrame, bin_col: str, id_col: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Rows of a bin dealt round robin to the folds in the order of a hash: sizes in a bin differ by one at most."""
    dealt = grouped_index(df, [bin_col], [seeded_order(id_col, seed), id_col], "__i")
    return dealt.withColumn(name, (F.col("__i") % folds).cast("int")).drop("__i")


def _greedy(folds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, out = [0] * folds, []
        for n in pdf.sort_values(["__order", "__group"])["__n"]:
            best = sizes.index(min(sizes))
            out.append(best)
            sizes[best] += n
        return pdf.sort_values(["__order", "__group"]).assign(fold=out)[["__group", "fold"]]

    return run


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """Whole groups in folds: shuffled by a hash, each to the fold with the fewest rows. One row per group is sequential."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).select(F.col(group).cast("string").alias("__group"), "__n")
    ordered = counts.withColumn("__order", F.md5(F.concat_ws(":", "__group", F.lit(str(seed))))).withColumn("__one", F.lit(0))
    placed = ordered.groupBy("__one").applyInPandas(_greedy(folds), "__group string, fold int")
    return df.join(placed, F.col(group).cast("string").eqNullSafe(F.col("__group")), "left").drop("__group")


def byte_chunks(df: DataFrame, text: str, order: Sequence[str], block: int) -> DataFrame:
    """chunk, n_bytes over all texts laid end to end with an end mark of one byte; the last, partial block is dropped.

    start: the offset of each text, by prefix sums over a range exchange.
    """
    sized = df.select(*order, (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("__b"))
    ranged = materialize(sized.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "byte-chunks")
    totals = ranged.groupBy("__part").agg(F.sum("__b").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("__part").alias("__p"), before.alias("__s"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    inside = F.sum("__b").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.join(starts, F.col("__part") == F.col("__p")).withColumn("start", F.col("__s") + F.coalesce(inside, F.lit(0)))
    pieces = placed.select("__all", "start", (F.col("start") + F.col("__b")).alias("end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + __b - 1) div {block}"))).alias("chunk"))
    held = F.least("end", (F.col("chunk") + 1) * block) - F.greatest("start", F.col("chunk") * block)
    return pieces.where((F.col("chunk") + 1) * block <= F.col("__all")).groupBy("chunk").agg(F.sum(held).alias("n_bytes"), F.count(F.lit(1)).alias("n_texts"))


def contiguous_shard(df: DataFrame, order: Sequence[str], shards: int, name: str = "shard") -> DataFrame:
    """Runs of rows in that order, as many in each but for the first ones, which may have one more."""
    indexed = row_index(df, order, "__i", total="__n")
    sized = indexed.withColumns({"__small": F.expr(f"__n div {shards}"), "__extra": F.expr(f"__n % {shards}")})
    cut = F.col("__extra") * (F.col("__small") + 1)
    shard = F.when(F.col("__i") < cut, F.expr("__i div (__small + 1)")).otherwise(F.col("__extra") + F.floor((F.col("__i") - cut) / F.greatest(F.col("__small"), F.lit(1))))
    return sized.withColumn(name, shard.cast("int")).drop("__i", "__n", "__small", "__extra")


def seeded_order(id_col: str, seed: int) -> Column:
    """A key that shuffles rows the same way in every engine."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("__o", seeded_order(id_col, seed)).orderBy("__o", id_col).limit(k).drop("__o")


def samples_for(rows: DataFrame, row_id: str, pool: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """row_id, rank, and id_col of k rows of the pool for each row, drawn by the seed and the row's number.

    Every row starts at its own place of the shuffled pool and takes the k rows from there, around its end: a draw without
    replacement that joins by places and never pairs all rows with all of the pool.
    """
    shuffled = materialize(row_index(pool.select(id_col, seeded_order(id_col, seed).alias("__o")), ["__o", id_col], "__at").select(id_col, "__at"), "shuffled-pool")
    n = shuffled.count()
    if not n:
        return rows.select(row_id).limit(0).withColumn("rank", F.lit(0)).join(pool.select(id_col).limit(0))
    start = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(n))
    wanted = rows.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(min(k, n) - 1))).alias("rank"), start.alias("__s"))
    return wanted.withColumn("__at", F.pmod(F.col("__s") + F.col("rank"), F.lit(n))).join(shuffled, "__at").select(row_id, "rank", id_col)


def ordered_by(df: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Rows by several keys, ascending, nulls first; limit: only so many from the start."""
    out = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    return out if limit is None else out.limit(limit)


def longest_first(df: DataFrame, text: str, *ties: str) -> DataFrame:
    """Rows by the length of a text in bytes, the longest first, so that batches hold texts of like length; null counts as empty."""
    return df.orderBy(F.octet_length(F.coalesce(F.col(text), F.lit(""))).desc(), *ties)


def leading_int(col: str | Column, default: int = 0) -> Column:
    """The number a text begins with."""
    return F.coalesce(F.regexp_extract(col, r"^([0-9]+)", 1).try_cast("long"), F.lit(default).cast("long"))


def line_key(col: str, default: int = 999_999) -> Column:
    """(start, end) of "3" or "1-3"; the default for both if it is neither."""
    ends = F.regexp_extract(col, r"^\s*([0-9]+)(?:\s*-\s*([0-9]+))?\s*$", 1).try_cast("long"), F.regexp_extract(col, r"^\s*([0-9]+)(?:\s*-\s*([0-9]+))?\s*$", 2).try_cast("long")
    return F.struct(F.coalesce(ends[0], F.lit(default).cast("long")).alias("start"), F.coalesce(ends[1], ends[0], F.lit(default).cast("long")).alias("end"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each key; the engine prunes each task's rows to k before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def anchor_profile(text: str) -> tuple[Column, Column]:
    """Length aimed at (40 to 2400 characters) and whether the anchor has a gap."""
    return F.greatest(F.lit(40), F.least(F.lit(2400), F.length(text))), F.col(text).contains("<gap>")
