from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import minhash


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute(rows, limit=0.8):
    """Class of every document by all pairs."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            shared = sum((a & b).values())
            if shared and shared >= limit * (sum(a.values()) + sum(b.values()) - shared) - 1e-9:
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: find(i) for i in root}


def classes(df):
    return {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    error = []
    for _ in range(40):
        base = np.repeat(rng.integers(0, 2**63, 60, dtype=np.uint64), rng.integers(1, 9, 60))
        a, b = (np.sort(base[rng.random(len(base)) < 0.85]) for _ in range(2))
        signs = minhash.bag_min_hash([a, b], 300)
        truth = minhash.weighted_jaccard(a, b)
        x, y = Counter(a.tolist()), Counter(b.tolist())
        assert truth == pytest.approx(sum((x & y).values()) / sum((x | y).values()))
        shared = minhash.shared_counts([a, b])
        assert shared[0, 1] == sum((x & y).values())
        error.append((signs[0] == signs[1]).mean() - truth)
    assert abs(np.mean(error)) < 0.012
    assert np.isinf(minhash.bag_min_hash([np.zeros(0, np.uint64)], 8)).all()


def test_fixture_by_brute_force(spark, table, sf):
    docs = table("documents")
    assert classes(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"w{rng.integers(10**9)}"
    return " ".join(out)


def test_planted_copies(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for size, edits in [(1, 0)] * 30 + [(2, 0), (5, 2), (4, 6), (3, 12), (260, 3), (260, 9)]:
        words = [f"v{x}" for x in rng.integers(0, 5000, 150)]
        for _ in range(size):
            rows.append((n, edited(rng, words, edits)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert classes(df) == brute(rows)


def test_repeats_count(spark):
    """Sets of shingles agree, bags do not."""
    a = "a b c d e f g h i j"
    rows = [(1, a), (2, " ".join([a] * 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(df) == {1: 1, 2: 2}


def test_messy(spark, messy):
    got = minhash.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got if r["doc_id"] not in (5, None)}
    assert by[1] == (1, True) and by[2] == (2, True) and by[3] == (3, True)
    assert by[6] == (5, False) and by[7] == (5, False) and by[2**60 + 1] == (5, False)
    assert by[2**60 + 3] == (2**60 + 3, True) and by[2**60 + 5] == (2**60 + 5, True)
    assert Counter((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None) == {(5, False): 2, (None, True): 2}
    kept = minhash.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter([1, 2, 3, 4, 5, 5, 8, 9, 10, 2**60 + 3, 2**60 + 5, None, None])
    assert minhash.near_duplicates(messy.limit(0)).count() == 0


def exact_classes(rows, limit=0.8):
    """Class of every document by an exact join: texts that may be near share one of their rarest shingles.

    Of a bag of n (shingle, number) features a near bag holds ceil(limit * n) at least, so in an order of all features it
    holds one of the first n - ceil(limit * n) + 1. Pairs that share such a feature are compared in full.
    """
    import pandas as pd

    ids, own = [], []
    for i, t in rows:
        shingles = minhash.shingles(t)
        if len(shingles):
            new = np.concatenate([[True], shingles[1:] != shingles[:-1]])
            nth = np.arange(len(shingles)) - np.maximum.accumulate(np.where(new, np.arange(len(shingles)), 0))
            own.append(np.unique(shingles * np.uint64(31) + nth.astype(np.uint64)))
            ids.append(i)
    text = np.repeat(np.arange(len(own)), [len(x) for x in own])
    _, feature, uses = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    order = np.lexsort((feature, uses[feature], text))
    text, feature = text[order], feature[order]
    size = np.bincount(text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    early = (place < (size - np.ceil(limit * size - 1e-9) + 1)[text]) & (uses[feature] > 1)
    index = pd.DataFrame({"f": feature[early], "t": text[early]})
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # Equal bags first, so that a group of copies is met once.
    alike = {}
    for k, x in enumerate(own):
        root[k] = alike.setdefault(x.tobytes(), k)
    met = set()
    for _, group in index[index["t"].isin(set(alike.values()))].groupby("f")["t"]:
        members = group.to_numpy()
        for n, x in enumerate(members):
            for y in members[:n]:
                if (y, x) not in met and min(size[x], size[y]) >= limit * max(size[x], size[y]) - 1e-9 and find(x) != find(y):
                    met.add((y, x))
                    shared = len(np.intersect1d(own[x], own[y], assume_unique=True))
                    if shared >= limit * (size[x] + size[y] - shared) - 1e-9:
                        root[find(x)] = find(y)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: i for i, _ in rows} | {i: least[find(k)] for k, i in enumerate(ids)}


def test_classes_equal_an_exact_join_on_ten_thousand_documents(spark, table):
    docs = table("documents", "/root/testdata/sf0.1")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got, exact = classes(docs), exact_classes(rows)
    assert sum(a != exact[i] for i, a in got.items()) == 0
    assert len(set(exact.values())) < len(rows)


def test_the_exact_join_by_all_pairs(table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").select("doc_id", "text").collect()]
    assert exact_classes(rows) == brute(rows)
