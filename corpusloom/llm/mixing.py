"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words (water filling under a cap per source); each of its documents should then be
taken target / size-of-source times. The integral part is taken outright, the fractional parts are rounded together, two
documents at a time: the one passes words to the other, in a direction drawn so that neither's expected share changes,
until one of the two is taken wholly or not at all. The other, whose share is still fractional, meets the next document,
the largest first, so that the two are of like size; one more than LIKE times as large as the next meets as many partners as
make it integral, one after another under one draw, so that no long document is left over where short ones can take its
words. The words of partners stay the same and every document keeps its probability, whatever the others' are. Chunks of CHUNK documents are rounded in parallel; the one fractional document each
leaves goes up a reduction tree of fan-in FAN_IN, where residuals are paired in the same way, until each source has one,
which is rounded by itself. So a source misses its target by less than one document.

Rows of one id, source, text and size are one item with their number: so many of them as are sure are taken, and the rest
is one share to round; a group of them with a third of all rows is one row. Chunks depend on a hash of the item, pairs
on sizes and that hash, draws on a seed for each chunk: reruns agree, however the table is split. Ids stay in Arrow, so
nulls and large ids pass unchanged.

Cases: a null source is a source of its own, last in order; a null id is an id like any other; a null or empty text has size 0
and is taken 0 words; sources without words have target 0; repeated rows are separate documents; other columns are not read
by mix() and carried by mix_documents(); empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_PATTERN, join_small, materialize, read

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
CHUNK = 4096
FAN_IN = 64
#: Two documents are of like size if the larger one is at most that many times as large.
LIKE = 2
SEED = 11


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """sizes: source, size, rows (of that size). One row per source: source, source_size, n_docs, target, a table as long as there are sources.

    Weights go round the sources in code-point order, null last. The level of the water is found in closed form: with
    the sources in the order in which they reach their caps, the first prefix of capped ones for which the others stay
    below theirs.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by.select("*", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    done, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("w").over(rest)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    found = levels.withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(Window.partitionBy())["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap")))
    return found.select("source", "source_size", "n_docs", target.alias("target"))


def _snap(share: float) -> float:
    """What is left below one part in 10^9 of a document is rounding error of the arithmetic."""
    return float(round(share)) if min(share, 1.0 - share) < 1e-9 else share


def _one_draw(out: list[float], size: list[int], big: int, start: int, draw: float) -> bool:
    """The document `big` becomes integral by one draw, with words of as many documents from `start` on as it takes.

    With share a it wins with probability a and takes (1 - a) * c words of a partner, else it gives it a * c words, so that
    the partner's expected share stays. False, and nothing done, if the partners' words don't suffice.
    """
    a, need = out[big], float(size[big])
    parts = []
    for k in range(start, len(out)):
        if 0.0 < out[k] < 1.0:
            c = min(out[k] * size[k] / (1.0 - a), (1.0 - out[k]) * size[k] / a, need)
            parts.append((k, c))
            need -= c
            if need <= 1e-9:
                break
    else:
        return False
    won = draw < a
    for k, c in parts:
        out[k] = _snap(min(1.0, max(0.0, out[k] - (1.0 - a) * c / size[k] if won else out[k] + a * c / size[k])))
    out[big] = float(won)
    return True


def pivotal_pairs(p: list[float], size: list[int], draws: list[float]) -> list[float]:
    """Shares after pairs were rounded one after another, sizes falling: at most one is not 0.0 or 1.0."""
    out = list(p)
    carry, stuck = -1, False  # the one document so far that is neither taken nor left; whether all partners are too small
    for k in range(len(out)):
        if not 0.0 < out[k] < 1.0:
            continue
        if carry >= 0 and not stuck and size[carry] > LIKE * size[k]:
            if _one_draw(out, size, carry, k, draws[carry]):
                carry = -1
                if not 0.0 < out[k] < 1.0:
                    continue
            else:
                stuck = True
        if carry < 0:
            carry, stuck = k, False
            continue
        a, b, s, t = out[carry], out[k], size[carry], size[k]
        # Words that may pass from the new one to the carried one, and back.
        gain, loss = min((1.0 - a) * s, b * t), min(a * s, (1.0 - b) * t)
        if draws[k] * (gain + loss) < loss:
            a, b = (1.0, b - gain / t) if (1.0 - a) * s <= b * t else (a + gain / s, 0.0)
        else:
            a, b = (0.0, b + loss / t) if a * s <= (1.0 - b) * t else (a - loss / s, 1.0)
        out[carry], out[k] = _snap(a), _snap(b)
        if not 0.0 < out[carry] < 1.0:
            carry, stuck = (k if 0.0 < out[k] < 1.0 else -1), False
    return out


def _pivot(seed: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Rounds a chunk, the largest document first; all rows but one at most become integral."""
        size, hashed, p = (table.column(c).to_numpy() for c in ("size", "item", "p"))
        order = np.lexsort((p, hashed, -size))
        name = f"{seed}|{level}|{table.column('source')[0].as_py()!r}|{table.column('chunk')[0].as_py()}"
        draws = np.random.default_rng(zlib.crc32(name.encode())).random(len(order))
        rounded = np.empty(len(order))
        rounded[order] = pivotal_pairs(p[order].tolist(), size[order].tolist(), draws.tolist())
        at = table.schema.get_field_index("p")
        return table.set_column(at, "p", pa.array(rounded))

    return run


def pivotal_round(items: DataFrame, seed: int = SEED, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """items: item (long, not null), source, size, n_docs (items of the source), p in [0, 1], and any others. The same with p 0.0 or 1.0."""
    names = items.columns
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / chunk))
    left = items.withColumn("chunk", F.pmod(F.xxhash64("item", F.lit(seed)), chunks))
    most = items.agg(F.max(chunks)).first()[0] or 1
    done, level = [], 0
    while True:
        rounded = materialize(left.groupBy("source", "chunk").applyInArrow(_pivot(seed, level), left.schema), f"mix-level{level}")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.where(~fraction))
        left = rounded.where(fraction)
        if most <= 1:
            break
        most, level = -(-most // fan_in), level + 1
        left = left.withColumn("chunk", F.expr(f"chunk div {fan_in}"))
    lone = F.pmod(F.xxhash64("item", F.lit(seed), F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("p", (lone < F.col("p")).cast("double")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*names)


def _key(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.octet_length(text_col))


def mixed_items(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per item (rows of one id, source, text): id, source, size, item (its hash), rows, source_size, target, times (whole copies of each row), extra (rows of it with one copy more)."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    meta = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _key(id_col, source_col, text_col).alias("item"))
    items = materialize(meta.groupBy("id", "source", "size", "item").agg(F.count(F.lit(1)).alias("rows")), "mix-items")
    targets = materialize(source_targets(items, weights, budget, most), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    # Documents without words carry no mass; any number of copies of them is the same.
    mass = F.when(F.col("size") > 0, F.round((F.col("share") - F.floor("share")) * F.col("rows"), 9)).otherwise(F.lit(0.0))
    joined = join_small(items, targets, "source").withColumn("share", times).withColumn("mass", mass)
    split = joined.withColumn("sure", F.floor("mass")).withColumn("p", F.col("mass") - F.col("sure")).withColumn("times", F.floor("share")).drop("share", "mass")
    rounded = pivotal_round(split, seed)
    return rounded.select("id", "source", "size", "item", "rows", "source_size", "target", "times", (F.col("sure") + F.col("p")).cast("long").alias("extra"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), copies (int)."""
    items = mixed_items(docs, weights, budget, most, seed, id_col, text_col, source_col)
    each = items.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    copies = F.col("times") + (F.col("row") <= F.col("extra")).cast("long")
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns; documents without words are kept once.

    Of rows with one id, source and text the columns of one stand for all; they are repeated as often as all are taken.
    """
    items = mixed_items(docs)
    total = F.when(F.col("size") == 0, F.col("rows")).otherwise(F.col("times") * F.col("rows") + F.col("extra"))
    taken = materialize(items.select(F.col("item").alias("__cl_item"), F.col("id").alias("__cl_id"), F.col("rows").alias("__cl_rows"), total.alias("__cl_copies")), "mix-copies")
    keyed = docs.withColumn("__cl_key", _key("doc_id", "source", "text"))
    joined = keyed.join(taken, (F.col("__cl_key") == F.col("__cl_item")) & keyed["doc_id"].eqNullSafe(F.col("__cl_id")))
    if not taken.where("__cl_rows > 1").isEmpty():
        first = joined.where("__cl_rows > 1").groupBy("__cl_key", "__cl_id", "__cl_copies").agg(*[F.first(docs[c]).alias(f"__cl_{k}") for k, c in enumerate(docs.columns)])
        first = first.select(*[F.col(f"__cl_{k}").alias(c) for k, c in enumerate(docs.columns)], "__cl_copies")
        joined = joined.where("__cl_rows = 1").select(*docs.columns, "__cl_copies").unionByName(first)
    each = F.explode(F.array_repeat(F.lit(0), F.col("__cl_copies").cast("int"))).alias("__cl_each")
    return joined.select(*docs.columns, each).drop("__cl_each")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
