import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import toxicity


def made(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "si", "te", "vu"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.integers(30, 300))]
        toxic = int(k % 4 == 0)
        for _ in range(rng.integers(1, 4) if toxic else 0):
            words[rng.integers(len(words))] = rng.choice(["grubflik", "zornhaxe", "pfuiqual"])
        rows.append((k, " ".join(words), toxic))
    return rows


def test_held_out_accuracy():
    rows = made(900, 0)
    train, test = rows[:600], rows[600:]
    model = toxicity.fit([r[1] for r in train], [r[2] for r in train])
    score = lambda t: model.probability(model.logit(model.word_shares(toxicity.words_of(t)), np.array(toxicity.counted_once(toxicity.words_of(t)), bool)))
    right = np.mean([(score(t) >= 0.7) == bool(y) for _, t, y in test])
    assert right >= 0.95
    clean = test[1][1]
    assert score(clean + " grubflikk") > 0.7 > score(clean)  # an unseen misspelling
    assert score(" ".join([clean] * 40) + " zornhaxe") > 0.7  # one word in a long text


def test_passages_are_means():
    """The score of a passage does not change when its words are repeated within it, nor grow with its length."""
    model = toxicity.Model(np.array([1.0]), 0.5, 1.0, 0.0)
    ones = lambda n: np.ones(n)
    assert model.logit(ones(24), ones(24).astype(bool)) == model.logit(ones(500), ones(500).astype(bool)) == 1.5
    half = np.arange(24) < 12
    assert model.logit(ones(24), half) == 1.5  # twelve distinct words, each twice
    assert model.logit(ones(3), ones(3).astype(bool)) == 0.5 + 3 / 12
    assert model.logit(ones(0), ones(0).astype(bool)) == 0.5


def test_long_documents_train_whole():
    """What marks a toxic document stands far behind its beginning, in every passage but one of none."""
    rows = made(160, 3)
    clean = [t for _, t, y in rows if not y]
    texts, labels = [], []
    for k, text in enumerate(clean):
        long = " ".join(clean[(k + j) % len(clean)] for j in range(8)).split()
        if k % 2:
            long[-30] = "zornhaxe"
        texts.append(" ".join(long))
        labels.append(k % 2)
    model = toxicity.fit(texts, labels)
    shares = model.word_shares(["zornhaxe", *toxicity.words_of(clean[0])])
    assert shares[0] > 5 * np.abs(shares[1:]).max()


def test_repeats_count_once_in_a_window():
    flags = toxicity.counted_once(["a"] * 50 + ["b"], window=24)
    assert [k for k, f in enumerate(flags) if f] == [0, 24, 48, 50]


def test_only_learnable_rows_train(spark, messy):
    docs = spark.createDataFrame(made(300, 1), "doc_id long, text string, toxic int")
    rows = toxicity.training_rows(docs, docs, most=40).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows)
    assert {t: sum(r["toxic"] == t for r in rows) for t in (0, 1)} == {0: 40, 1: 40}


def test_rows_that_train_are_bounded(spark):
    """Repeated documents and labels: a row for each id, toxic if a label says so."""
    docs = spark.range(600).selectExpr("id % 30 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(600).selectExpr("id % 50 AS doc_id", "int(id % 50 < 10 AND id < 300) AS toxic")
    rows = toxicity.training_rows(docs, labels, most=8).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) <= 16
    assert all(r["toxic"] == int(r["doc_id"] < 10) for r in rows)
    assert sum(r["toxic"] for r in rows) == min(8, sum(zlib.crc32(b"%d" % k) % 3 != 1 for k in range(10)))


def test_held_out_rows_of_the_fixtures(spark):
    """Toxic documents are found among rows whose labels nothing has read; clean ones are left alone."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select(F.col("doc_id").alias("i"), "toxic")
    rows = toxicity.op10_toxicity(spark, sf).join(labels, F.col("doc_id") == F.col("i")).where("held_out").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == v] for v in (1, 0))
    caught = sum(r["predicted"] for r in toxic) / len(toxic)
    wrong = sum(r["predicted"] for r in clean)
    # Some labels of these tables, of both kinds, contradict the words of their texts.
    assert caught >= 0.75 and wrong <= 0.02 * len(clean)


def test_scores_ignore_other_columns_and_repeat(spark, messy):
    docs = spark.createDataFrame(made(200, 2), "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs)
    out = messy.select("doc_id", toxicity.toxicity(model, "text").alias("s")).collect()
    assert all(0.0 <= r["s"] <= 1.0 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["s"])
    assert all(len(v) == 1 for k, v in by.items() if k not in (5, None)) and by[1] == by[2] == by[3]


def test_degenerate_labels(spark, messy):
    labels = spark.createDataFrame([(None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    assert toxicity.train(messy, labels) is None
    kept = toxicity.drop_toxic(messy, labels)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert toxicity.drop_toxic(messy.limit(0), labels).count() == 0


def test_null_ids_are_not_held_out(spark, messy, tmp_path):
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == messy.count() and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_query(spark, sf):
    rows = toxicity.op10_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
