from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """By rounds: shares by weight, what exceeds a cap is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ones = budget * sum(sizes.values()), {s: 0.0 for s in order}, set(order)
    while left > 1e-9 and open_ones:
        total = sum(weight[s] for s in open_ones)
        share = {s: left * weight[s] / total for s in open_ones}
        left = 0.0
        for s in list(open_ones):
            out[s] += share[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_ones.discard(s)
    return out


def check(docs):
    rows = mixing.mix(docs).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == texts
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    aims = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= largest[s]
    return rows


def test_mix(spark, table, messy):
    check(table("documents"))
    check(messy)
    assert mixing.mix(messy.limit(0)).count() == 0


def test_reruns_agree_and_hot_source(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id * 7 % 23)) AS text", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    first, again = ({(r["doc_id"], r["copies"]) for r in check(df.repartition(n))} for n in (3, 8))
    assert first == again


P = [0.9, 0.1, 0.5, 0.3, 0.7, 0.35, 0.02, 0.6, 0.81, 0.45, 0.2, 0.5]
SIZES = [10, 9, 8, 7, 6, 400, 300, 5, 5, 4, 60, 3]


def test_every_document_keeps_its_probability():
    """Unequal shares and sizes; in chunks whose residuals meet again, over two levels."""
    rng = np.random.default_rng(0)
    order = sorted(range(len(P)), key=lambda k: -SIZES[k])
    chunks = [order[k::3] for k in range(3)]
    taken = np.zeros((3, len(P)))
    seeds = 20_000
    for _ in range(seeds):
        share = np.array(P)
        for level, groups in enumerate((chunks, [order])):
            for some in groups:
                some = [k for k in some if 0 < share[k] < 1]
                before = sum(share[k] * SIZES[k] for k in some)
                share[some] = mixing.pivotal_pairs(share[some].tolist(), [SIZES[k] for k in some], rng.random(len(some)).tolist())
                assert sum(0 < share[k] < 1 for k in some) <= 1
                assert sum(share[k] * SIZES[k] for k in some) == pytest.approx(before, abs=1e-6)
            taken[level] += share
        taken[2] += rng.random(len(P)) < share
    assert np.abs(taken / seeds - np.array(P)).max() < 0.012


def test_rounding_tree(spark):
    items = spark.range(40).select(F.col("id").alias("item"), F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("size"), F.lit(40).cast("long").alias("n_docs"), F.lit(0.3).alias("p"))
    rounded = mixing.pivotal_round(items, chunk=8, fan_in=2).collect()
    assert {r["p"] for r in rounded} <= {0.0, 1.0} and len(rounded) == 40
    words = sum(r["size"] for r in rounded if r["p"])
    assert abs(words - 0.3 * sum(r["size"] for r in rounded)) <= 7


def test_stage_repeats_documents(spark, messy):
    out = mixing.mix_documents(messy)
    assert out.columns == messy.columns
    expected = Counter()
    for r in mixing.mixed_items(messy).collect():
        expected[r["id"], r["size"]] += r["rows"] if not r["size"] else r["times"] * r["rows"] + r["extra"]
    got = Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in out.collect())
    assert got == +expected
    assert {k for k in got if not k[1]} == {(1, 0), (2, 0), (3, 0), (None, 0)}  # no words: kept once


def test_one_row_many_times(spark):
    """A repeated row is one item: its copies come as near to its share as those of different rows."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a b c' ELSE repeat('w ', int(1 + id % 11)) END AS text", "concat('s', id % 2) AS source")
    rows = check(df)
    assert len(rows) == 3000 and sum(r["doc_id"] == 7 for r in rows) == 1001


def test_sources_meet_their_targets_closely(spark):
    """What is left over is a small document, even beside very long ones."""
    df = spark.range(9000).selectExpr("id AS doc_id", "repeat('w ', int(IF(id % 1000 < 3, 20000, 5 + id % 90))) AS text", "concat('s', id % 3) AS source")
    taken, aims = {}, {}
    for r in mixing.mix(df).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        aims[r["source"]] = r["target"]
    assert all(abs(taken[s] - aims[s]) <= 100 for s in aims)
