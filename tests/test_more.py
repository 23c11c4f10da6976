"""Sources, samples, similar rows and rules of single functions, over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metrics, numbers
from corpusloom.operators import consensus, joins, windows
from corpusloom.session import shared_root
from corpusloom.sources import io, pages


def table_distance(a, b):
    """The textbook table of edits."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_token_distance_by_the_table():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert joins.token_distance(a, b) == table_distance(a, b)
        assert joins.normalized_distance(a, b) == table_distance(a, b) / max(len(a), len(b), 1)
    long = [str(k % 97) for k in range(1500)]
    assert joins.token_distance(long, long[3:] + ["x"]) == 4


def test_similar_rows_in_blocks(spark):
    """More queries than a block holds, ties, equal texts, empty and null texts."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(7))) for _ in range(60)] + [None, "", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["query_id"], r["pool_id"], r["distance"]) for r in joins.most_similar(df, df.repartition(4), 3, block=7).collect()}
    split = [(t or "").split() for t in texts]
    expected = set()
    for i, t in enumerate(split):
        near = sorted((table_distance(t, o), j) for j, o in enumerate(split) if o != t)[:3]
        expected |= {(i, j, d) for d, j in near}
    assert got == expected
    assert joins.most_similar(df.limit(0), df, 3).count() == 0 and joins.most_similar(df, df.limit(0), 3).count() == 0


def test_lines_of_many_files(spark, tmp_path):
    for k, n in enumerate((3, 0, 40, 1)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k}-{j}\n" for j in range(n)))
    got = [tuple(r) for r in io.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(n, t) for n, t in enumerate([f"{k}-{j}" for k, n in enumerate((3, 0, 40, 1)) for j in range(n)])]
    plan = io.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:  # a file in several splits
        assert [r["line"] for r in io.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [t for _, t in got]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_index(spark, tmp_path):
    for name in ("akt_05.pdf", "AKT_05 copy.pdf", "x_07.pdf"):
        (tmp_path / name).write_bytes(b"x")
    pattern = r"/[^/]*?([0-9]+)[^/]*[.]pdf$"
    got = {r["key"]: r["path"].rsplit("/", 1)[1] for r in io.file_index(spark, str(tmp_path / "*.pdf"), pattern, {"05": "akt_05.pdf"}).collect()}
    assert got == {"05": "akt_05.pdf", "07": "x_07.pdf"}
    with pytest.raises(Exception, match="two files for 05"):
        io.file_index(spark, str(tmp_path / "*.pdf"), pattern).collect()


def test_appended_files_and_resume(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "concat('a \"q\", ', id) AS text")
    for _ in range(2):
        io.append_csv(df.coalesce(1), str(tmp_path / "out"), ["text", "id"], rows_at_once=10)
    files = sorted((tmp_path / "out").glob("*.csv"))
    assert len(files) == 6 and all(f.read_text().startswith("text,id") for f in files)
    back = io.read_text_csv(spark, str(tmp_path / "out"))
    assert back.count() == 50 and back.distinct().count() == 25
    rows = spark.createDataFrame([("Straße  X",), ("new",), (None,)], "text string")
    done = spark.createDataFrame([(4, " STRASSE x ")], "id long, text string")
    assert sorted(r["text"] or "" for r in io.resumed(rows, done, ["id", "text"], "id", "text", 5).collect()) == ["", "new"]
    assert io.resumed(rows, done, ["id", "text"], "id", "text", 1) is None
    with pytest.raises(ValueError, match="lack"):
        io.resumed(rows, spark.createDataFrame([(None, "x")], "id long, text string"), ["id", "text"], "id", "text", 5)


def test_whole_cache_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "version": 2,\n "k": "a"}')
    (tmp_path / "b.json").write_text('{"version": 2, "k": ')
    (tmp_path / "c.json").write_text('{"version": 1, "k": "c"}')
    assert [r["k"] for r in io.read_responses(spark, str(tmp_path), "version int, k string", 2, whole_files=True).collect()] == ["a"]


def test_images_are_kept(spark):
    asked = []
    pages_df = spark.createDataFrame([("a", b"x", 1), ("a", b"x", 2)], "path string, content binary, page int")
    existing = spark.createDataFrame([("a", 1, b"old"), ("b", 9, b"other")], "path string, page int, image binary")
    out = pages.render_missing(pages_df, existing, lambda content, page, dpi: asked.append(page) or f"new{page}".encode())
    assert {(r["path"], r["page"], bytes(r["image"])) for r in out.collect()} == {("a", 1, b"old"), ("a", 2, b"new2")}


def test_samples_and_orders(spark):
    pool = spark.range(9).selectExpr("id AS k")
    rows = spark.range(400).selectExpr("id")
    drawn = windows.samples_for(rows, "id", pool, "k", 4).collect()
    by = {}
    for r in drawn:
        by.setdefault(r["id"], []).append((r["rank"], r["k"]))
    assert all(len({k for _, k in v}) == 4 and sorted(n for n, _ in v) == [0, 1, 2, 3] for v in by.values()) and len(by) == 400
    starts = [dict(v)[0] for v in by.values()]
    assert min(starts.count(k) for k in range(9)) > 20  # every row of the pool is drawn
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, windows.samples_for(rows.repartition(5), "id", pool.repartition(3), "k", 4).collect()))
    assert windows.samples_for(rows, "id", pool, "k", 20).count() == 400 * 9
    assert windows.samples_for(rows, "id", pool.limit(0), "k", 2).count() == 0
    df = spark.createDataFrame([(1, None), (None, "bb"), (1, "é"), (0, "a")], "n int, t string")
    assert [tuple(r) for r in windows.ordered_by(df, "n", "t").collect()] == [(None, "bb"), (0, "a"), (1, None), (1, "é")]
    assert [r["t"] for r in windows.longest_first(df, "t", "n").collect()] == ["bb", "é", "a", None] or [r["t"] for r in windows.longest_first(df, "t", "n").collect()] == ["é", "bb", "a", None]


def test_only_valid_candidates(spark):
    rows = [(1, 0, "the cat sat", False), (1, 1, "the cat sat", None), (1, 2, "dogs", True), (2, 0, "a b", False), (2, 1, "a b c", None)]
    df = spark.createDataFrame(rows, "record long, idx long, text string, valid boolean")
    assert {r["record"]: r["best_idx"] for r in consensus.pick_by_peers(df, "geo", prefer="valid").collect()} == {1: 2, 2: 1}


def test_masks_of_rows(spark):
    df = spark.createDataFrame([(1, 50), (2, 50), (3, 1), (4, None)], "id long, n int")
    got = {r["id"]: r["mask"] for r in numbers.span_masks(df, "n", 3).collect()}
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [50, 50, 1, 0]
    assert got[1] != got[2] and sum(got[1]) == sum(got[2]) == round(50 * 0.15)
    assert {r["id"]: r["mask"] for r in numbers.span_masks(df.repartition(3), "n", 3).collect()} == got


def grams(tokens, n):
    out = {}
    for k in range(len(tokens) - n + 1):
        out[tuple(tokens[k : k + n])] = out.get(tuple(tokens[k : k + n]), 0) + 1
    return out


def plain_bleu(hypothesis, reference):
    """Effective order: only orders the hypothesis has n-grams of; zero counts smoothed by halves."""
    import math

    a, b = hypothesis.split(), reference.split()
    logs, smooth, order = [], 1.0, 0
    for n in range(1, 5):
        mine, theirs = grams(a, n), grams(b, n)
        total = sum(mine.values())
        if not total:
            break
        right = sum(min(c, theirs.get(g, 0)) for g, c in mine.items())
        order += 1
        if right:
            logs.append(math.log(100.0 * right / total))
        else:
            smooth *= 2
            logs.append(math.log(100.0 / (smooth * total)))
    if not order or not b:
        return 0.0
    brevity = 1.0 if len(a) >= len(b) else math.exp(1 - len(b) / len(a))
    return brevity * math.exp(sum(logs) / order)


def test_bleu_by_the_definition():
    rng = random.Random(3)
    compared = 0
    for _ in range(400):
        a, b = (" ".join(rng.choice(["the", "cat", "sat", "on", "mat"]) for _ in range(rng.randint(1, 12))) for _ in range(2))
        shared = sum(min(c, grams(b.split(), 1).get(g, 0)) for g, c in grams(a.split(), 1).items())
        if shared:  # without a common word the score is 0, smoothing or not
            compared += 1
            assert metrics.bleu(a, b) == pytest.approx(plain_bleu(a, b), abs=1e-6)
    assert compared > 300


def test_chrf_by_the_definition():
    """Orders 1 to 6 of characters without spaces and 1 to 2 of words, F with beta 2 over the mean precision and recall."""
    rng = random.Random(4)
    for _ in range(300):
        a, b = (" ".join(rng.choice(["abc", "ab", "bcd", "xyz", "q"]) for _ in range(rng.randint(1, 8))) for _ in range(2))
        precisions, recalls = [], []
        for tokens_a, tokens_b, orders in ((list(a.replace(" ", "")), list(b.replace(" ", "")), 6), (a.split(), b.split(), 2)):
            for n in range(1, orders + 1):
                mine, theirs = grams(tokens_a, n), grams(tokens_b, n)
                if mine and theirs:
                    right = sum(min(c, theirs.get(g, 0)) for g, c in mine.items())
                    precisions.append(right / sum(mine.values()))
                    recalls.append(right / sum(theirs.values()))
        p, r = sum(precisions) / len(precisions), sum(recalls) / len(recalls)
        assert metrics.chrf(a, b) == pytest.approx(100 * 5 * p * r / (4 * p + r) if p + r else 0.0, abs=1e-6)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())


def test_near_duplicates_of_examples(spark):
    """The ratio half by difflib over all rows and examples; the equal half beside it."""
    import difflib

    rng = random.Random(5)
    examples = ["".join(rng.choice("abcd ") for _ in range(60)).strip() for _ in range(4)]
    texts = []
    for e in examples:
        for edits in (0, 1, 2, 3, 6):
            t = list(e)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "x"
            texts.append("".join(t))
    texts += ["", "Known  Text", "other", examples[0] * 2]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    known = spark.createDataFrame([("known text",)], "text string")
    got = {r["k"]: r["is_duplicate"] for r in consensus.near_duplicate_flag(rows, known, "text", examples).collect()}
    flat = lambda t: " ".join(t.split()).lower()
    expected = {k: flat(t) in ("", "known text") or any(difflib.SequenceMatcher(None, flat(t), e).ratio() >= 0.96 for e in examples) for k, t in enumerate(texts)}
    assert got == expected and 4 < sum(got.values()) < len(texts)
