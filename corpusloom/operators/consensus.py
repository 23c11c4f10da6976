"""Choice among candidates by agreement, corpus scores, near-duplicate tests."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import metrics, pair_scores
from corpusloom.functions.text import normalize_ws
from corpusloom.session import materialize, maybe_broadcast


#: Records of more candidates or characters are split into blocks, whose pairs go to different tasks.
BLOCK_ROWS, BLOCK_CHARS = 256, 1_000_000
#: Candidates and characters of records that are scored together; answers kept for records of the same texts.
BATCH_ROWS, BATCH_CHARS, KEPT, KEPT_CHARS = 1_000, 100_000, 20_000, 500
PICKED = "record long, best_idx long, best_text string, best_score double"


def _means(scores: list[np.ndarray], copies: np.ndarray, own: bool) -> list[np.ndarray]:
    """scores: texts by texts. The mean of each text over all candidates, or all but one that it is."""
    most = int(copies.sum()) - (not own)
    means = []
    for s in scores if most else [np.zeros((len(copies), len(copies)))]:
        high, low = ((x * copies).sum(1) - (0 if own else x.diagonal()) for x in pair_scores.whole(s))
        means.append((high / pair_scores.HIGH + low / (pair_scores.HIGH * pair_scores.LOW)) / max(most, 1))
    return means


def _best(texts: list[str], scores: list[np.ndarray], copies: np.ndarray, own: bool) -> tuple[int, float]:
    """Of different texts in the order of their first places, the chosen one and its score."""
    means = [m.tolist() for m in _means(scores, copies, own)]
    ranks = []
    for i, (text, *m) in enumerate(zip(texts, *means, strict=True)):
        total = math.sqrt(m[0] * m[1]) if len(m) == 2 else m[0]
        # Text before no text, then agreement (its parts in order), then length, then place.
        ranks.append((bool(text.strip()) if not own else True, total, *m, 0 if own else len(text), -i))
    best = max(range(len(texts)), key=ranks.__getitem__)
    return best, ranks[best][1]


def _choose(geo: bool, own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records, one after another, each in order of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], tuple[int, float]] = {}
        waiting: dict[tuple[str, ...], list[tuple[int | None, list[int | None]]]] = {}
        held = [0, 0, 0]
        out: tuple[list, ...] = ([], [], [], [])

        def put(record, places, texts, best, score):
            for column, x in zip(out, (record, places[best], texts[best], score), strict=True):
                column.append(x)

        def flush() -> Iterator[pa.RecordBatch]:
            different = [list(dict.fromkeys(t)) for t in waiting]
            wide = [len(t) for t in different]
            alone = [k for k, n in enumerate(wide) if n > pair_scores.FEW]
            few = [k for k, n in enumerate(wide) if n <= pair_scores.FEW]
            scored = {}
            for group in ([few] if few else []) + [[k] for k in alone]:
                flat = pair_scores.scores_within([t for k in group for t in different[k]], [wide[k] for k in group], geo)
                at = 0
                for k in group:
                    scored[k] = [f[at : at + wide[k] ** 2].reshape(wide[k], wide[k]) for f in flat]
                    at += wide[k] ** 2
            if len(known) + len(waiting) > KEPT:
                known.clear()
            for k, (texts, records) in enumerate(waiting.items()):
                counts = Counter(texts)
                best, score = _best(different[k], scored[k], np.array([counts[t] for t in different[k]]), own)
                best = texts.index(different[k][best])
                if sum(map(len, texts)) <= KEPT_CHARS:
                    known[texts] = best, score
                for record, places in records:
                    put(record, places, texts, best, score)
            waiting.clear()
            held[:] = 0, 0, 0
            yield from given()

        def given() -> Iterator[pa.RecordBatch]:
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["record", "best_idx", "best_text", "best_score"])
            for column in out:
                column.clear()

        def add(record, rows) -> Iterator[pa.RecordBatch]:
            rows = [r for r in rows if r[2]] or rows
            places, texts = [r[0] for r in rows], tuple(r[1] for r in rows)
            if texts in known:
                put(record, places, texts, *known[texts])
                if len(out[0]) >= 10_000:
                    yield from given()
                return
            if texts not in waiting:
                held[0] += len(texts)
                held[1] += sum(map(len, texts))
            waiting.setdefault(texts, []).append((record, places))
            held[2] += len(places)
            if held[0] >= BATCH_ROWS or held[1] >= BATCH_CHARS or held[2] >= 10_000:
                yield from flush()

        current, rows = None, []
        for batch in batches:
            for record, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and record != current:
                    yield from add(current, rows)
                    rows = []
                current = record
                rows.append(row)
        if rows:
            yield from add(current, rows)
        yield from flush()

    return run


def _meet(geo: bool, own: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Two blocks of a large record, or one with itself: what each text's scores with the others add up to."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        sides = [{k: part.column(k).to_pylist() for k in ("uid", "text", "copies")} for part in (rows.filter(pc.equal(rows["block"], b)) for b in dict.fromkeys((first, second)))]
        texts = [x["text"] for x in sides]
        if len(sides) == 1:
            both = [[f.reshape(len(texts[0]), -1) for f in pair_scores.scores_within(texts[0], [len(texts[0])], geo)]]
        else:
            both = pair_scores.scores_between(*texts, geo) if all(texts) else ()
        parts = []
        for scores, me, other in zip(both, sides, sides[::-1], strict=False):
            sums = []
            for s in scores:
                sums += [(x * np.array(other["copies"])).sum(1) - (x.diagonal() if len(sides) == 1 and not own else 0) for x in pair_scores.whole(s)]
            sums += [np.zeros(len(me["uid"]), np.int64)] * (4 - len(sums))
            parts.append(pa.table([pa.array(me["uid"], pa.int64()), *(pa.array(x, pa.int64()) for x in sums), pa.array([bool(t.strip()) for t in me["text"]], pa.bool_())], ["uid", "c_high", "c_low", "b_high", "b_low", "filled"]))
        return pa.concat_tables(parts) if parts else pa.schema([*((k, pa.int64()) for k in ("uid", "c_high", "c_low", "b_high", "b_low")), ("filled", pa.bool_())]).empty_table()

    return run


def _pick_large(rows: DataFrame, large: DataFrame, geo: bool, own: bool, tasks: int) -> DataFrame:
    kept = rows.join(maybe_broadcast(large), F.col("record").eqNullSafe(F.col("__record"))).where(~F.col("__chosen") | F.col("preferred"))
    texts = kept.groupBy("record", "text").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("copies"), F.first("__blocks").alias("blocks"))
    texts = materialize(texts.withColumn("uid", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("text"), "blocks")), "large-records-texts")
    dealt = texts.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("record", F.least("block", "__other").alias("__a"), F.greatest("block", "__other").alias("__b"), "uid", "text", "copies", "block")
    keys = ("record", "__a", "__b")
    parts = dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_meet(geo, own), "uid long, c_high long, c_low long, b_high long, b_low long, filled boolean")
    sums = parts.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("c_high", "c_low", "b_high", "b_low")], F.max("filled").alias("filled"))
    sizes = texts.groupBy(F.col("record").alias("__record")).agg(F.sum("copies").alias("__n"))
    peers = F.col("__n") - (0 if own else 1)
    mean = lambda k: F.when(peers == 0, 0.0).otherwise((F.col(f"{k}_high") / F.lit(pair_scores.HIGH) + F.col(f"{k}_low") / F.lit(pair_scores.HIGH * pair_scores.LOW)) / peers)
    scored = texts.join(sums, "uid").join(maybe_broadcast(sizes), F.col("record").eqNullSafe(F.col("__record"))).withColumns({"__c": mean("c"), "__b": mean("b")})
    scored = scored.withColumn("__total", F.sqrt(F.col("__c") * F.col("__b")) if geo else F.col("__c"))
    rank = F.struct(*[(-x).alias(f"r{k}") for k, x in enumerate(([] if own else [F.col("filled").cast("int")]) + [F.col("__total"), F.col("__c"), F.col("__b"), *([] if own else [F.length("text")])])], F.isnull("idx").alias("none"), "idx", "text")
    best = scored.groupBy("record").agg(F.min_by(F.struct("idx", "text", "__total"), rank).alias("__best"))
    return best.select("record", F.col("__best.idx").alias("best_idx"), F.col("__best.text").alias("best_text"), F.col("__best.__total").alias("best_score"))


def pick_by_peers(candidates: DataFrame, metric: str = "chrf", own: bool = False, prefer: str | None = None) -> DataFrame:
    """candidates: record, idx, text. For each record the candidate the others agree with most.

    metric: chrf, or geo for the geometric mean of chrF++ and BLEU. own: averages over all candidates, itself included, and
    takes the first best one (n-best reranking). prefer: a boolean column; where a record has candidates that are true there,
    only these are considered. Records of more than BLOCK_ROWS candidates or BLOCK_CHARS characters are met block by block in
    many tasks; all others are scored whole. Means are sums without rounding, so equal texts have equal scores.
    """
    geo, spark = {"chrf": False, "geo": True}[metric], candidates.sparkSession
    preferred = F.coalesce(F.col(prefer).cast("boolean"), F.lit(False)) if prefer else F.lit(False)
    rows = candidates.select(F.col("record").cast("long").alias("record"), F.col("idx").cast("long").alias("idx"), F.coalesce("text", F.lit("")).alias("text"), preferred.alias("preferred"))
    # Spark deals by bytes, of which there are few beside the work.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    n, chars = F.count(F.lit(1)), F.sum(F.length("text"))
    blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(chars / BLOCK_CHARS))
    large = materialize(rows.groupBy(F.col("record").alias("__record")).agg(blocks.alias("__blocks"), F.max("preferred").alias("__chosen")).where("__blocks > 1"), "large-records")
    none = large.isEmpty()
    small = rows if none else rows.join(maybe_broadcast(large), F.col("record").eqNullSafe(F.col("__record")), "left_anti")
    picked = small.repartition(tasks, "record").sortWithinPartitions("record", F.col("idx").asc_nulls_last(), "text").select("record", "idx", "text", "preferred").mapInArrow(_choose(geo, own), PICKED)
    return picked if none else picked.unionByName(_pick_large(rows, large, geo, own, tasks))


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(metrics.chrf(a, b), metrics.bleu(a, b)) for a, b in zip(pdf["prediction"], pdf["reference"], strict=True)]
        out = pd.DataFrame(rows, columns=["chrf", "bleu"], index=pdf.index)
        yield pd.concat([pdf[["id"]], out, ((out["chrf"] * out["bleu"]) ** 0.5).rename("geo")], axis=1)


def row_scores(pairs: DataFrame) -> DataFrame:
    """pairs: id, prediction, reference. id, chrf, bleu, geo."""
    return pairs.select("id", "prediction", "reference").mapInPandas(_scores, "id long, chrf double, bleu double, geo double")


def corpus_scores(pairs: DataFrame) -> DataFrame:
    """One row: chrf, bleu, geo of all pairs. Counts are summed over texts, in each task first."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(metrics.chrf_counts(a or "", b or ""), metrics.bleu_counts(a or "", b or "")) for a, b in zip(pdf["prediction"], pdf["reference"], strict=True)]
            chrf = [sum(x) for x in zip(*[r[0] for r in rows], strict=True)]
            bleu = [sum(x) for x in zip(*[r[1] for r in rows], strict=True)]
            if rows:
                yield pd.DataFrame({"pos": range(len(chrf) + len(bleu)), "n": chrf + bleu})

    summed = pairs.select("prediction", "reference").mapInPandas(counts, "pos int, n long").groupBy("pos").agg(F.sum("n").alias("n"))
    width = 3 * (metrics.CHAR_ORDER + metrics.WORD_ORDER)

    @F.pandas_udf("chrf double, bleu double")
    def score(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(metrics.chrf_score(x[:width]), metrics.bleu_score(x[width:])) if len(x) else (0.0, 0.0) for x in lists], columns=["chrf", "bleu"])

    whole = summed.agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("l")).select(F.transform("l", lambda x: x["n"]).alias("l"))
    return whole.select(score("l").alias("s")).select("s.chrf", "s.bleu", F.sqrt(F.col("s.chrf") * F.col("s.bleu")).alias("geo"))


def near_duplicate_flag(rows: DataFrame, known: DataFrame, text: str, prompts: Sequence[str] = (), limit: float = 0.96) -> DataFrame:
    """rows with is_duplicate: blank, equal to a known text but for case and white space, or nearly equal to a prompt example."""
    key = F.lower(F.replace(normalize_ws(text), F.lit("ß"), F.lit("ss")))
    keys = known.select(F.lower(F.replace(normalize_ws(text), F.lit("ß"), F.lit("ss"))).alias("__k")).distinct()
    examples = list(prompts)

    @F.pandas_udf("boolean")
    def close(texts: pd.Series) -> pd.Series:
        # Twice the shorter length by both lengths bounds the ratio.
        may = lambda t, e: 2 * min(len(t), len(e)) >= limit * (len(t) + len(e))
        return texts.map(lambda t: any(may(t, e) and metrics.sequence_ratio(t, e) >= limit for e in examples))

    joined = rows.withColumn("__key", key).join(keys, F.col("__key") == F.col("__k"), "left")
    near = close(F.col("__key")) if examples else F.lit(False)
    return joined.withColumn("is_duplicate", (F.col("__key") == "") | F.col("__k").isNotNull() | near).drop("__key", "__k")
