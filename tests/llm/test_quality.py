import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality


def features(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    base = (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
    return (*base, n < 50 or 100 * len(inside) > 50 * n)


def test_features_by_brute_force(spark, table, messy):
    for docs in (table("documents"), messy):
        texts = {(r["doc_id"], features(r["text"])) for r in docs.select("doc_id", "text").collect()}
        out = quality.quality_verdicts(docs, table("labels").limit(0)).collect()
        assert len(out) == docs.count()
        assert {(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in out} == texts
        assert all(r["kept"] is (not r["base_failed"]) for r in out)  # without labels there are no cutoffs


@pytest.mark.parametrize("n, share", [(400, 0.05), (900, 0.02), (3000, 0.01)])
def test_cutoffs_hold_the_exact_bound(spark, n, share):
    """Good documents whose symbol ratio exceeds the strict cutoffs in a known share."""
    bad_over = int(n * share * 0.3)
    rows = [("en", 1, 0.5 if k < bad_over else 0.0) for k in range(n)] + [("en", 0, 0.7)] * 100 + [("de", 1, 0.0)] * 20 + [("de", 0, 3.0)] * 20
    df = spark.createDataFrame(rows, "stratum string, quality int, v double")
    zero = {k: F.lit(0.0).alias(k) for k in quality.GRIDS}
    holdout = df.select("stratum", "quality", F.struct(*[F.col("v").alias("symbols") if k == "symbols" else zero[k] for k in quality.GRIDS]).alias("signals"))
    got = {r["stratum"]: r["cutoffs"]["symbols"] for r in quality.certified_cutoffs(holdout, risk=share * len(quality.GRIDS)).collect()}
    level = quality.DELTA / (2 * len(quality.GRIDS))
    tail = lambda k: sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
    sure, best = True, None
    for c in quality.GRIDS["symbols"]:
        k = sum(r[1] == 1 and r[0] == "en" and r[2] > c for r in rows)
        sure = sure and k < n * share and tail(k) <= level
        gain = 100 * (0.7 > c) - quality.FALSE_COST * k
        if sure and gain > 0 and (best is None or gain > best[0]):
            best = (gain, c)
    assert got.get("en") == (best[1] if best else None)
    assert "de" not in got  # too few labels for any certificate


def test_stage_keeps_columns(spark, messy, table):
    kept = quality.drop_low_quality(messy, table("labels"))
    assert kept.columns == messy.columns
    # The long text repeats its words.
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter([5, 5, 6, 7, None, None, 2**60 + 1, 2**60 + 3])
    assert quality.drop_low_quality(messy.limit(0), table("labels").limit(0)).count() == 0


def test_no_python_on_the_main_path(spark, sf):
    plan = quality.op3_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_labels(spark, messy):
    labels = spark.createDataFrame([(5, None), (None, 1), (6, 0), (6, 1)], "doc_id long, quality int")
    assert quality.quality_verdicts(messy, labels).count() == messy.count()


def test_certified_cutoffs_as_in_sql(spark, tmp_path, oracle, rows_of):
    """Enough labels for cutoffs in one stratum and a half: query, SQL and stage agree, and the rules reject."""
    words = "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', k, 'x', id)))"
    bad = "(id % 5 = 0)"
    docs = spark.range(6000).selectExpr("id AS doc_id", f"IF({bad}, concat({words}, repeat(' ###', 20 + int(id % 7)), IF(id % 2 = 0, repeat(' Loud!', 40), '')), {words}) AS text", "IF(id % 3 = 0, 'de', IF(id % 50 = 1, NULL, 'en')) AS lang", "'s' AS source", "1L AS n_chars")
    labels = spark.range(6000).where("id % 7 < 6").selectExpr("id AS doc_id", f"int(NOT {bad} OR id % 365 = 0) AS quality", "0 AS toxic")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op3_quality(spark, str(tmp_path)).toPandas()
    rejected = got[~got.kept & ~got.base_failed]
    assert len(rejected) > 300
    assert rows_of(got) == rows_of(oracle(quality.QUALITY_SQL, str(tmp_path)))
    stage = quality.drop_low_quality(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    assert sorted(r["doc_id"] for r in stage.select("doc_id").collect()) == sorted(got[got.kept].doc_id)
