"""Operators over small tables: sources, folds, rounds, votes, joins."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, consensus, dedup, filters, joins, unions, windows
from corpusloom.plans import corpus
from corpusloom.sources import io
from corpusloom.streaming import rounds


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc', None), ("2", "NA", "x,y")], "id string, t string, n string")
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv(spark, str(tmp_path / "out"), "id string, t string, n string")
    assert sorted(back.collect()) == sorted(df.collect())
    text = io.read_text_csv(spark, str(tmp_path / "out"), ["id", "n"])
    assert {tuple(r) for r in text.collect()} == {("1", ""), ("2", "x,y")}
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_csv(df, str(tmp_path / "out"))
    assert io.read_many(spark, [str(tmp_path / "out")] * 2).count() == 4


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n1,x\nbad,y\n")
    assert [r["n"] for r in io.read_csv(spark, str(tmp_path / "a.csv"), "n int, t string", tolerant=True).orderBy("t").collect()] == [1, None]


def test_line_pairs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("1\n2\n")
    (tmp_path / "c.txt").write_text("1\n")
    pairs = io.read_line_pairs(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert sorted(map(tuple, pairs.collect())) == [(0, "x", "1"), (1, "y", "2")]
    with pytest.raises(Exception, match="differ in their number of lines"):
        io.read_line_pairs(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt")).collect()


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, k string")
    io.write_by(df, str(tmp_path / "by"), ["k"])
    assert spark.read.parquet(str(tmp_path / "by")).where("k = 'a'").count() == 1
    io.write_jsonl(df, str(tmp_path / "json"), ["id"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    io.append(df, str(tmp_path / "more"))
    io.append(df, str(tmp_path / "more"))
    assert io.resume_state(spark.read.parquet(str(tmp_path / "more")), ["k", "id"], "id") == (4, 3)
    assert io.resume_state(io.empty(spark, "id long, k string"), ["k", "id"], "id") == (0, 0)
    with pytest.raises(ValueError, match="columns"):
        io.resume_state(df, ["id"], "id")
    (tmp_path / "AKT1.pdf").write_bytes(b"x")
    assert io.file_index(spark, str(tmp_path / "*.pdf"), r"/([^/]+)\.pdf$").first()["key"] == "AKT1"
    ranges = io.page_ranges(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", 3, 9)], "key string, first_page int, last_page int"))
    assert {tuple(r) for r in ranges.collect()} == {("a", 3, 9), ("b", 1, 10_000)}


def test_contracts(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(ValueError, match="lacks columns: c"):
        filters.require_columns(df, ["a", "c"])
    assert filters.to_layout(df, ["x", "a"]).first() == ("", 1)
    assert df.select(filters.first_existing(df, ["z", "b"])).first()[0] == ""


def test_index_bins_and_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 10).cast("double").alias("v"), F.when(F.col("id") % 17 == 0, float("nan")).otherwise(1.0).alias("w"))
    assert sorted(r["row_index"] for r in windows.row_index(df, ["v", "id"]).collect()) == list(range(103))
    sizes = [r["count"] for r in windows.quantile_bin(df, "v", ["id"], 20).groupBy("bin").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    binned = windows.quantile_bin(df.withColumn("x", F.col("v") * F.col("w")), "x", ["id"], 5)
    assert binned.where("bin is null").count() == 7
    folds = windows.spread_folds(binned, "bin", "id", 4).groupBy("bin", "fold").count().collect()
    for b in {r["bin"] for r in folds}:
        sizes = [r["count"] for r in folds if r["bin"] == b]
        assert max(sizes) - min(sizes) <= 1
    shards = [r["count"] for r in windows.contiguous_shard(spark.range(11), ["id"], 4).groupBy("shard").count().orderBy("shard").collect()]
    assert shards == [3, 3, 3, 2]
    groups = windows.group_folds(spark.range(100).withColumn("g", F.col("id") % 13), "g", 4)
    assert groups.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_same_result_for_any_partitioning(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("t"))
    results = {tuple(sorted(map(tuple, dedup.first_wins(df.repartition(n), ["k"], ["id"]).collect()))) for n in (1, 4, 16)}
    assert len(results) == 1
    results = {tuple(sorted(map(tuple, windows.spread_folds(df.repartition(n), "k", "id", 4).collect()))) for n in (1, 4, 16)}
    assert len(results) == 1


def test_context_budget(spark):
    df = spark.createDataFrame([("g", 1, "p"), ("g", 2, "q"), ("g", 3, "r")], "g string, n int, t string")
    whole = windows.context_prefix(df, "g", ["n"], "t", 2).orderBy("n").collect()
    assert [r["context"] for r in whole] == ["", "[context] p [/context] ", "[context] p [sep] q [/context] "]
    tight = windows.context_prefix(df, "g", ["n"], "t", 2, 23).orderBy("n").collect()
    assert [r["context"] for r in tight] == ["", "[context] p [/context] ", "[context] q [/context] "]
    none = windows.context_prefix(df, "g", ["n"], "t", 2, 5)
    assert {r["context"] for r in none.collect()} == {""}


def test_vote(spark):
    votes = spark.createDataFrame([(1, s, k, o) for o, (s, k) in enumerate([(1, "a"), (1, "b"), (2, "a"), (3, "c")])], "g int, s int, k string, o int")
    assert [r["k"] for r in aggregates.majority_vote(votes, ["g"], "s", "k", "o").collect()] == ["a"]


def test_consensus(spark):
    rows = [(1, 0, "the cat sat"), (1, 1, "the cat sat down"), (1, 2, "dogs run"), (2, 0, ""), (2, 1, "a")]
    best = {r["record"]: r["best_idx"] for r in consensus.pick_by_peers(spark.createDataFrame(rows, "record long, idx long, text string")).collect()}
    assert best[1] in (0, 1) and best[2] == 1
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id long, prediction string, reference string")
    assert consensus.corpus_scores(pairs).first()["chrf"] == pytest.approx(100)


def test_similar_rows_by_brute_force(spark):
    texts = ["a b c", "a b d", "x y", "a b c d", "x y z", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["query_id"], r["pool_id"], r["distance"]) for r in joins.most_similar(df, df.repartition(3), 2).collect()}
    expected = set()
    for i, t in enumerate(texts):
        near = sorted((joins.token_distance(t.split(), o.split()), j) for j, o in enumerate(texts) if o != t)[:2]
        expected |= {(i, j, d) for d, j in near}
    assert got == expected


def test_vector_mean_fails_on_uneven(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        aggregates.vector_mean(df, ["k"], "v").collect()


def test_rounds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bbbb")], "id long, text string")
    out = rounds.until_accepted(df, lambda ts, turn: [t * (turn + 1) for t in ts], "text", "id", F.length("answer") >= 3, 4)
    assert {tuple(r) for r in out.collect()} == {(1, "aaa", 3, True), (2, "bbbb", 1, True)}
    rows = spark.createDataFrame([(1, "t", ""), (2, "t", "ok")], "id long, text string, answer string")
    fixed = rounds.revise_flagged(rows, lambda ts, turn: ["new"] * len(ts), "text", "id", F.when(F.col("answer") == "", "empty").otherwise(""), 2)
    assert {tuple(r) for r in fixed.select("id", "answer").collect()} == {(1, "new"), (2, "ok")}
    targets = spark.createDataFrame([("v", 1), ("v", 2), ("w", 3)], "vol string, k int")
    scan = lambda v, turn: v.join(targets.where(F.col("k") <= turn + 1), "vol")
    assert rounds.until_found(targets.select("vol").distinct(), targets, scan, "vol", "k", 5).count() == 3


def test_append_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = rounds.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.where("id > 1"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_plans(spark):
    detections = spark.createDataFrame([("v", "a", "p1", 1), ("v", "a", "p2", 1), ("v", "z", "p1", 2)], "volume string, key string, pdf string, page int")
    targets = spark.createDataFrame([("v", "a"), ("v", "b")], "volume string, key string")
    tables = corpus.location_tables(targets, detections)
    assert {(r["key"], r["match_count"], r["found"]) for r in tables["summary"].collect()} == {("a", 1, True), ("b", 0, False)}
    assert [r["key"] for r in tables["missing"].collect()] == ["b"]
    assert [r["key"] for r in tables["scan_summary"].collect()] == ["z"]
    assert corpus.plan_jobs(targets, targets.where("key = 'b'")).first()["keys"] == ["a"]
    pseudo = spark.createDataFrame([("1", "t", "s"), ("2", " ", "s")], "oare_id string, translation string, transliteration string")
    merged = corpus.merged_sources(pseudo, pseudo.withColumnRenamed("oare_id", "synthetic_id"))
    assert merged.count() == 2 and {r["fold"] for r in merged.collect()} == {"1"}
    pairs = spark.createDataFrame([("a-na (d) x", "to the god"), ("a", "not worthwhile"), ("", "b")], "s string, t string")
    assert corpus.post_processed(pairs, "s", "t").count() == 1


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, m string"), spark.createDataFrame([(1, "false"), (2, "true")], "id long, m string")
    assert unions.extend_pool(a.withColumn("fold", F.lit(0)), b, "id", "m").count() == 2
    assert unions.extend_pool(a.withColumn("fold", F.lit(0)), b, "id").count() == 2
    assert unions.concat_filled(a, b.drop("m")).where("m = ''").count() == 2


def test_text_layer_and_strips(spark):
    import numpy as np

    from corpusloom.sources import pages

    rects = [("p", 1, "b", 30.0, 10.0, 40.0, 12.0), ("p", 1, "a", 0.0, 11.0, 10.0, 13.0), ("p", 1, "c", 41.0, 10.0, 50.0, 12.0), ("p", 1, "low", 0.0, 2.0, 9.0, 4.0), ("p", 1, None, 0.0, 0.0, 1.0, 1.0)]
    out = pages.text_lines(spark.createDataFrame(rects, "path string, page int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [r["text"] for r in out.orderBy("line_no").collect()] == ["a bc", "low"]
    files = spark.createDataFrame([("f", bytearray(b"xy"), 2, 3)], "path string, content binary, first_page int, last_page int")
    images = pages.render_pages(pages.page_rows(files), lambda content, page, dpi: content * page)
    assert {(r["page"], bytes(r["image"])) for r in images.collect()} == {(2, b"xyxy"), (3, b"xyxyxy")}
    image = np.full((100, 8), 255, np.uint8)
    image[50] = 0
    assert pages.crop_rows(image).shape == (21, 8) and pages.stitch([image, image[:, :4]]).shape == (62, 8)


def test_every_function_takes_nulls(spark):
    from corpusloom.functions import cleaners

    df = spark.createDataFrame([(None,), ("",)], "t string")
    for f in (cleaners.drop_line_markers, cleaners.cleaned_translation, cleaners.drop_leading_summary, cleaners.sup_sub_to_unicode):
        assert {r["v"] for r in df.select(f("t").alias("v")).collect()} <= {None, ""}


def test_index_inside_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))
    out = windows.grouped_index(df, ["g"], [-F.col("id")], "n").collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append((r["n"], r["id"]))
    for rows in by.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted((i for _, i in rows), reverse=True)


def test_splits_do_not_share_pairs(spark):
    df = spark.createDataFrame([(k, f"a{k % 7}", f"b{k % 5}", "valid" if k % 3 else "train") for k in range(100)], "id long, a string, b string, split string")
    out = dedup.across_splits(df, ["a", "b"], F.when(F.col("split") == "train", 0).otherwise(1), "id")
    pairs = {s: {(r["a"], r["b"]) for r in out.where(F.col("split") == s).collect()} for s in ("train", "valid")}
    assert not pairs["train"] & pairs["valid"] and len(pairs["train"] | pairs["valid"]) == 35


def test_samples_are_seeded(spark):
    df = spark.range(300)
    a, b = ([r["id"] for r in windows.seeded_sample(df.repartition(n), "id", 20, seed=3).collect()] for n in (1, 7))
    assert sorted(a) == sorted(b) and len(a) == 20
    assert sorted(a) != sorted(r["id"] for r in windows.seeded_sample(df, "id", 20, seed=4).collect())


def test_ranges_collect_lines_in_order(spark):
    lines = spark.createDataFrame([("r", n, f"l{n}") for n in (3, 1, 2, 10)], "k string, line int, t string")
    ranges = spark.createDataFrame([("r", 1, 2), ("r", 3, 10), ("q", 1, 2)], "k string, low int, high int")
    out = {(r["low"], r["t"]) for r in joins.collect_ranges(ranges, lines, ["k"], "low", "high", "line", "t").collect()}
    assert out == {(1, "l1 l2"), (3, "l3 l10")}


def test_fill_and_overrides(spark):
    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "id long, t string")
    table = spark.createDataFrame([(2, "two"), (9, "nine")], "k long, v string")
    out = joins.fill_from(df, "id", "t", F.array("id", F.col("id") * 3), table, "k", "v")
    assert {tuple(r) for r in out.select("id", "t").collect()} == {(1, "x"), (2, "two"), (3, "nine")}
    missing = joins.fill_from(df, "id", "t", F.array("id"), table, "k", "v").where("id = 3").first()["t"]
    assert missing == "(unavailable)"
    assert joins.override(df, spark.createDataFrame([(1, "o")], "id long, t string"), "id", "t").where("id = 1").first()["t"] == "o"


def test_found_targets_keep_their_first_pass(spark):
    """Whatever order the rows come in: each pass sees again what earlier ones found; nulls count as values."""
    rows = [(v, k) for v in ("a", "b", None) for k in range(40)]
    targets = spark.createDataFrame(rows, "vol string, k int")

    def scan(volumes, turn):
        wanted = volumes.select(F.col("vol").alias("wanted"))
        return targets.join(wanted, F.col("vol").eqNullSafe(F.col("wanted")), "left_semi").where(F.col("k") % 4 <= turn).withColumn("turn", F.lit(turn))

    found = rounds.until_found(targets.select("vol").distinct(), targets, scan, "vol", "k", 3).collect()
    assert sorted(((r["vol"], r["k"], r["turn"]) for r in found), key=str) == sorted(((v, k, k % 4) for v, k in rows if k % 4 < 3), key=str)


def test_missing_rounds_as_its_sql_on_odd_events(spark, oracle, rows_of, tmp_path):
    """Event types that are null, user ids below 0 and null."""
    from corpusloom import catalog

    rows = [(None, k) for k in range(3)] + [("a", k) for k in (-6, -3, 4, None)]
    spark.createDataFrame(rows, "event_type string, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["missing_rounds"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(oracle(catalog.ORACLES["missing_rounds"], str(tmp_path)))
