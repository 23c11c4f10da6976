"""Joins: attach, exclude, flag, alternate keys, priority lookup, caches, intervals, similar rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.dedup import first_wins
from corpusloom.session import materialize, maybe_broadcast


def attach_unique(df: DataFrame, other: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join with the first row of each key of other (in that order), so rows do not multiply."""
    return df.join(first_wins(other, [key], order).select(key, *[c for c in other.columns if c != key and c not in order]), key, "left")


def exclude_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table; null keys stay."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def flag_known(df: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """A boolean column: the key occurs in the other table; blank and null keys never match."""
    keys = known.where(strip(F.col(key).cast("string")) != "").select(F.col(key).alias("__key")).distinct()
    return df.join(keys, F.col(key) == F.col("__key"), "left").withColumn(name, F.col("__key").isNotNull()).drop("__key")


def by_alternate_keys(left: DataFrame, right: DataFrame, left_keys: Column, right_keys: Column, on: Sequence[str] = ()) -> DataFrame:
    """Left join over the alternate keys of both sides (arrays), equal in `on` as well; then distinct rows.

    Every key is joined as an equality, not as a disjunction. A left row with a hit on one key and none on another
    keeps both the hit and a row without.
    """
    a = left.withColumn("__k", F.explode(left_keys))
    b = right.withColumn("__k", F.explode(right_keys))
    return a.join(b, ["__k", *on], "left").drop("__k").dropDuplicates()


def with_summary(targets: DataFrame, summary: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with a summary of one row per key; its nulls take the defaults; found says whether there was one."""
    marked = summary.withColumn("found", F.lit(True))
    return targets.join(marked, key, "left").fillna(defaults | {"found": False})


def missing_targets(targets: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    return targets.join(summary.select(key), key, "left_anti")


def priority_lookup(df: DataFrame, id_col: str, keys: Column, table: DataFrame, key: str, value: str) -> DataFrame:
    """df with value: of the first of the row's keys, in order, that the table has. table: one row per key."""
    tried = df.select(id_col, F.posexplode(keys).alias("__pos", "__k"))
    hits = tried.join(table.select(F.col(key).alias("__k"), F.col(value).alias("__v")), "__k")
    best = hits.groupBy(id_col).agg(F.min_by("__v", "__pos").alias(value))
    return df.join(best, id_col, "left")


def link_table(published: DataFrame, key: str, text: str, id_col: str, order: str) -> DataFrame:
    """One row per lower-cased key: its longest text (the first of equals) and its first id."""
    rows = published.withColumn("__key", F.lower(F.col(key)))
    return rows.groupBy("__key").agg(
        F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("longest_text"), F.min_by(id_col, order).alias("first_id")
    ).withColumnRenamed("__key", key)


def cache_split(requests: DataFrame, cache: DataFrame, keys: Sequence[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached payload if all keys agree, and the requests without one."""
    return requests.join(cache.select(*keys, payload), list(keys)), requests.join(cache.select(*keys), list(keys), "left_anti")


def fill_from(df: DataFrame, id_col: str, col: str, keys: Column, table: DataFrame, key: str, value: str, missing: str = "(unavailable)") -> DataFrame:
    """col where it is not blank, else the value of the first of the row's keys that the table has, else a mark."""
    found = priority_lookup(df.select(id_col, keys.alias("__keys")), id_col, F.col("__keys"), table.select(key, F.col(value).alias("__found")), key, "__found").select(id_col, "__found")
    return df.join(found, id_col, "left").withColumn(col, F.coalesce(F.when(strip(F.col(col)) != "", F.col(col)), F.col("__found"), F.lit(missing))).drop("__found")


def override(df: DataFrame, table: DataFrame, key: str, col: str) -> DataFrame:
    """col replaced where a small table of exceptions has the key."""
    small = maybe_broadcast(table.select(key, F.col(col).alias("__o")))
    return df.join(small, key, "left").withColumn(col, F.coalesce("__o", col)).drop("__o")


def rows_back(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results joined to the rows they came from by the generated key."""
    return df.join(results, key, "left")


def force_rows(found: DataFrame, forced: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Literal exception rows added for selected targets, where found has no row of that key."""
    wanted = forced.join(targets.select(*key).distinct(), list(key), "left_semi")
    return found.unionByName(wanted.join(found.select(*key), list(key), "left_anti"))


def collect_ranges(ranges: DataFrame, lines: DataFrame, on: Sequence[str], low: str, high: str, line: str, text: str) -> DataFrame:
    """Each range with the texts of the lines inside it, in order, joined by a space.

    Only lines of the same record meet a range: the interval is a condition beside an equality.
    """
    a, b = ranges.alias("a"), lines.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    inside = F.col(f"b.{line}").between(F.col(f"a.{low}"), F.col(f"a.{high}"))
    condition = inside
    for s in same:
        condition = condition & s
    joined = a.join(b, condition).select(*[F.col(f"a.{c}") for c in on], F.col(f"a.{low}").alias(low), F.col(f"a.{high}").alias(high), F.col(f"b.{line}").alias("__l"), F.col(f"b.{text}").alias("__t"))
    grouped = joined.groupBy(*on, low, high).agg(F.sort_array(F.collect_list(F.struct("__l", "__t"))).alias("__p"))
    return grouped.withColumn(text, F.array_join(F.transform("__p", lambda x: x["__t"]), " ")).drop("__p")


def token_masks(tokens: Sequence[str]) -> dict[str, int]:
    """For each token the set of its places, as the bits of a number."""
    masks: dict[str, int] = {}
    for k, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | 1 << k
    return masks


def token_distance(a: Sequence[str], b: Sequence[str], masks: dict[str, int] | None = None) -> int:
    """Edit distance of two token lists, all of a row of the table at once as the bits of a number. masks: those of a."""
    if not a:
        return len(b)
    masks = token_masks(a) if masks is None else masks
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    # Bits: whether the table grows or falls by one from a place of a to the next.
    up, down, distance = full, 0, len(a)
    for token in b:
        same = masks.get(token, 0)
        either = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & full, up & across
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(either | more) & full, more & either
    return distance


def normalized_distance(a: Sequence[str], b: Sequence[str]) -> float:
    """Edit distance by the longer list's length; 0 for two empty lists."""
    return token_distance(a, b) / max(len(a), len(b), 1)


#: Queries that meet the pool at a time.
QUERY_BLOCK = 5_000


def _best_of(asked: list[tuple[int, list[str]]], k: int, id_col: str, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        masks = [token_masks(tokens) for _, tokens in asked]
        counts = [Counter(tokens) for _, tokens in asked]
        for pdf in batches:
            for pool_id, text in zip(pdf[id_col], pdf[text_col], strict=True):
                tokens = (text or "").split()
                count = Counter(tokens)
                for n, (_, query) in enumerate(asked):
                    top = best[n]
                    longer = max(len(tokens), len(query))
                    if len(top) >= k:
                        # No fewer edits than the longer list's tokens that the other one lacks.
                        if abs(len(tokens) - len(query)) > top[-1][0]:
                            continue
                        small, large = (count, counts[n]) if len(count) < len(counts[n]) else (counts[n], count)
                        if longer - sum(min(x, large[t]) for t, x in small.items() if t in large) > top[-1][0]:
                            continue
                    if tokens == query:
                        continue
                    found = (token_distance(query, tokens, masks[n]), pool_id)
                    if len(top) < k or found < top[-1]:
                        top.append(found)
                        top.sort()
                        del top[k:]
        yield pd.DataFrame([(asked[n][0], pool_id, d) for n, top in enumerate(best) for d, pool_id in top], columns=["query_id", "pool_id", "distance"])

    return run


def most_similar(queries: DataFrame, pool: DataFrame, k: int, id_col: str = "id", text_col: str = "text", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, pool_id, distance: the k rows of the pool with the fewest token edits to each query, the same text left out.

    Queries come in blocks, as many as there are; a block is sent to all tasks, which keep its k best each, so an exchange holds
    at most k rows for each query and task. The driver holds one block at a time.
    """
    found, asked = None, []

    def meet() -> DataFrame:
        new = materialize(pool.select(id_col, text_col).mapInPandas(_best_of(list(asked), k, id_col, text_col), "query_id long, pool_id long, distance long"), "similar")
        return new if found is None else found.unionByName(new)

    for row in queries.select(id_col, text_col).toLocalIterator():
        asked.append((row[id_col], (row[text_col] or "").split()))
        if len(asked) == block:
            found = meet()
            asked.clear()
    if asked or found is None:
        found = meet()
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "pool_id"))), 1, k).alias("__b"))
    return ranked.select("query_id", F.explode("__b").alias("b")).select("query_id", "b.pool_id", "b.distance")
