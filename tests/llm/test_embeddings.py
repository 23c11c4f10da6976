import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, embeddings


def brute(rows, threshold=0.93):
    """Links and components by all pairs; rows: id, vector, label."""
    sound = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {i: 0 for i, _, _ in rows}
    for a in range(len(sound)):
        for b in range(a):
            (i, x, k), (j, y, m) = sound[a], sound[b]
            if k == m and len(x) == len(y) and float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: (links[i], find(i)) for i in root}


def result(df, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df, **options).collect()}


def test_planted_groups(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for size, noise in [(1, 0)] * 60 + [(2, 0.05), (3, 0.2), (40, 0.06), (2, 0.0), (700, 0.07)]:
        base = rng.standard_normal(24)
        for _ in range(size):
            rows.append((n, (base + noise * rng.standard_normal(24)).astype("float32").tolist(), n % 2 if size == 1 else 1))
            n += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert result(df) == brute(rows)


def test_chain_longer_than_the_core(spark):
    """A component far wider than the threshold, beyond the size that one task counts."""
    angles = [k * 0.004 for k in range(600)]
    rows = [(k, [math.cos(a), math.sin(a)], 0) for k, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = result(df)
    assert {c for _, c in got.values()} == {0}
    cosines = np.cos(np.subtract.outer(angles, angles))
    assert [got[k][0] for k in range(600)] == ((cosines >= 0.93).sum(1) - 1).tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("grp", F.lit(1))
    got = result(df)
    assert got == brute(rows)
    assert got[8] == (1, 8) and got[9] == (1, 8)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(3, [1.0, 0.5], 1)] * 4 + [(4, [1.0, 0.5], 1)], "vec_id long, embedding array<double>, label int")
    out = embeddings.near_duplicate_vectors(df).collect()
    assert len(out) == 5 and {(r["n_links"], r["component_id"]) for r in out} == {(4, 3)}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_pairs_in_a_shared_direction(spark):
    """Vectors with a mutual cosine of about 0.85 crowd the windows; every planted pair is found all the same."""
    rng = np.random.default_rng(5)
    n, dim, pairs = 6000, 64, 400

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    common = unit(rng.standard_normal(dim))
    x = unit(math.sqrt(0.85) * common + math.sqrt(0.15) * unit(rng.standard_normal((n, dim))))
    aside = rng.standard_normal((pairs, dim))
    aside = unit(aside - (aside * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.935 * x[:pairs] + math.sqrt(1 - 0.935**2) * aside])
    near = x @ x.T >= 0.93
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 0}), "vec_id long, embedding array<double>, label int")
    got = result(df)
    links = near.sum(1) - 1
    assert [got[k][0] for k in range(len(x))] == links.tolist()
    assert all(got[k][1] == got[n + k][1] for k in range(pairs))


def test_passes_settle_without_comparing_all(spark, monkeypatch):
    """Where blocks cost more than passes, the passes go on until next to nothing is left to compare."""
    left = []
    real = embeddings.exact_links
    monkeypatch.setattr(embeddings, "WINDOW_COST", 0.01)
    monkeypatch.setattr(embeddings, "exact_links", lambda v, *a: left.append(v.count()) or real(v, *a))
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 32))
    x[750:] = x[:750] + 0.2 * rng.standard_normal((750, 32))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[k][0] for k in range(1500)] == ((y @ y.T >= 0.93).sum(1) - 1).tolist()
    assert sum(left) < 300


def test_more_passes_for_more_vectors():
    assert embeddings.passes_for(0) <= 2
    assert embeddings.passes_for(100) < embeddings.passes_for(10**6) < 300


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 200)] + [(500, 501), (501, 900), (2, 500)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: find(x) for x in root if find(x) != x}
