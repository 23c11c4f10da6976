"""Targets, staged cleaning, records, and the document pipeline end to end with stand-ins for models."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as cli
from corpusloom import config
from corpusloom.functions import cleaners, ids, prompts, text
from corpusloom.operators import candidates
from corpusloom.plans import extraction
from corpusloom.sources import artifacts
from corpusloom.streaming import rounds


@pytest.fixture
def value(spark):
    def run(column, **cells):
        return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column.alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "volume, given_text, expected",
    [
        ("AKT 1", "12 A", "12 a"), ("AKT 1", "No. 7.", "7"), ("AKT 1", "Kt. n/k 12", "Kt. n/k 12"), ("LARSEN 2002", "05. NBC  3787 ,x", "5. NBC 3787, x"), ("LARSEN 2002", "7. I 427", "7. I427"), ("LARSEN 2002", "plain", "plain"),
        ("X ICK 4 1998", "(I 427)", "I 427"), ("X ICK 4 1998", "i 427b", "I 427b"), ("X ICK 4 1998", "nothing", ""), ("AKT 5", "kt n / k 12A", "Kt. n/k 12a"), ("AKT 5", "12", ""), (None, None, ""),
    ],
)
def test_identifiers_of_volumes(value, volume, given_text, expected):
    assert value(ids.canonical_for_volume("v", "t"), v=volume, t=given_text) == expected


def test_overrides_and_markers(value):
    override = ids.with_overrides("a", ["a", "b"], {"TPAK 1, 5": "Kt. x/k 5", "zzz": "no"})
    assert value(override, a="  7 ", b="see tpak 1, 5 there") == "Kt. x/k 5"
    assert value(override, a="  7 ", b=None) == "7"
    cut = text.from_markers("k", "t", {"r": ("isn't", "zz"), "s": ("q",)})
    assert value(cut, k="r", t="so it isn’t here zz ") == "isn’t here zz"
    assert value(cut, k="r", t="isn't first") == "isn't first"
    assert value(cut, k="r", t="a zz b") == "zz b"
    assert value(cut, k="s", t="a zz b") == "a zz b" and value(cut, k="x", t=None) == ""


def test_section_signs(value):
    drop = text.drop_section_signs("t", cleaners.SECTION_SIGNS)
    assert value(drop, t="öy. 12 a-na ay um\n ak. 3\nokay") == "a-na um\nokay"
    assert value(drop, t=None) == ""


def test_both_compositions(value):
    given = "1-3) „the [man]” <sup>x</sup> 1/2 mina Spuren (Rest)"
    assert value(cleaners.pipeline_translation("t"), t=given) == "„the man\" ˣ ½ mina Rest"
    assert "Rest" in value(cleaners.cleaned_translation("t"), t="the man (Rest) here")
    assert value(cleaners.cleaned_translation("t", F.lit(cleaners.REST_VOLUME.lower())), t="the man (Rest) here") == "the man here"
    assert value(cleaners.cleaned_transliteration("t", F.lit(cleaners.REST_VOLUME)), t="[a]ᵏⁱ ...") == "a{ki} <gap>"


def test_targets_and_jobs(spark):
    rows = [("akt_05.pdf", "Kt. n/k 1", 1), ("AKT 5", "kt n/k 1", 2), ("AKT 5", "unreadable", 3), ("AKT 6A", "Kt. n/k 9", 4), ("AKT 7", "Kt. n/k 7", 5), ("AKT 5", "Kt. n/k 66", 6)]
    df = spark.createDataFrame(rows, "volume string, number string, rid int")
    wanted, unique = extraction.targets(df, "volume", "number", ["rid"], exclude=["akt 7"], nonexistent=["Kt. n/k 66"])
    assert sorted(r["row_index"] for r in wanted.collect()) == [0, 1, 2, 3, 5]
    assert {tuple(r) for r in unique.collect()} == {("akt_05.pdf", "AKT 5", "Kt. n/k 1", "Kt. n/k 1"), ("AKT 6A", "AKT 6A", "Kt. n/k 9", "Kt. n/k 9")}
    only, _ = extraction.targets(df, "volume", "number", ["rid"], include=["AKT 6a"])
    assert only.count() == 1
    files = spark.createDataFrame([("AKT 5", "/five.pdf"), ("AKT 9", "/nine.pdf")], "key string, path string")
    got = {r["volume_key"]: (r["display"], r["keys"], r["path"]) for r in extraction.jobs(wanted, unique, files, "volume", only_files=["akt 9"]).collect()}
    assert got == {"AKT 5": ("AKT 5", ["Kt. n/k 1"], "/five.pdf"), "AKT 6A": ("AKT 6A", ["Kt. n/k 9"], None), "AKT 9": ("AKT 9", [], "/nine.pdf")}


def test_staged_cleaning(spark):
    rows = [
        ("Kt. 86/k 226", "1-3) good", "a-na", "AKT 5"), ("r1", "1-3)", "a-na", "AKT 5"), ("r2", None, "a-na", "AKT 5"), ("r3", "Fragmentary envelope of X", "a-na", "AKT 5"), ("r4", "good", " Unavailable ", "AKT 5"),
        ("r5", "good", "there is No Text", "AKT 5"), ("r6", "good", "x x", "AKT 12"), ("r7", "4-5) a PN here", "a-na ša", "AKT 5"), ("r8", "plain", "a-na", "AKT 5"), ("r2", "", "unavailable", "AKT 5"),
    ]
    df = spark.createDataFrame(rows, "record string, translation string, transliteration string, volume string").withColumn("extra", F.lit(1))
    done = extraction.cleaned_extracts(df, "record", "translation", "transliteration", "volume")
    assert {(r["record"], r["translation"], r["translation_orig"]) for r in done.kept.collect()} == {("r7", "a <gap> here", "4-5) a PN here"), ("r8", "plain", "plain")}
    assert sorted((r["record"], r["skip_reason"]) for r in done.rejected.collect()) == sorted([("Kt. 86/k 226", "listed"), ("r1", "empty"), ("r2", "empty"), ("r2", "empty"), ("r3", "description"), ("r4", "unavailable"), ("r5", "no_text"), ("r6", "gap_only")])
    assert done.counts.first().asDict() == {"n_total": 10, "n_kept": 2, "n_listed": 1, "n_empty": 3, "n_description": 1, "n_unavailable": 1, "n_no_text": 1, "n_gap_only": 1, "n_line_ranges": 2, "n_changed": 1}
    empty = extraction.cleaned_extracts(df.limit(0), "record", "translation", "transliteration", document=False)
    assert empty.kept.count() == 0 and empty.counts.first()["n_total"] == 0


def test_records(spark):
    work = spark.createDataFrame([(1, [3, 4], [3], ["/a.png"]), (2, [], None, [])], "k int, page_candidates array<int>, context_pages array<int>, images array<string>")
    chosen = spark.createDataFrame([(1, "text", 5, 2, 0.5, True)], "k int, text string, n_candidates int, best_idx int, best_score double, cached boolean")
    rows = {r["k"]: r.asDict() for r in extraction.result_records(work, chosen, "k").collect()}
    assert rows[1] == {"k": 1, "page_candidates": "3,4", "context_pages": "3", "image_path": "/a.png", "text": "text", "n_candidates": 5, "best_idx": 2, "best_score": 0.5, "cached": True, "error": "", "found": True}
    assert rows[2] == {"k": 2, "page_candidates": "", "context_pages": "", "image_path": "", "text": "", "n_candidates": 0, "best_idx": -1, "best_score": 0.0, "cached": False, "error": "", "found": False}


def test_candidate_rows(spark):
    answers = ['<think>{"t": "no"}</think> {"t": " a  b "}', "plain  text", '{"t": {"2": "c", "1": "b"}}', '{"u": 1}', "", None]
    df = spark.createDataFrame([(7, answers), (8, [])], "r long, responses array<string>")
    rows = candidates.candidate_rows(df, "r", "responses", "t", "none").orderBy("idx").collect()
    assert [(r["idx"], r["valid"], r["text"]) for r in rows] == [(0, True, "a b"), (1, False, "plain text"), (2, False, "b c"), (3, False, '{"u": 1}'), (4, False, "none"), (5, False, "none")]
    assert {r["record"] for r in rows} == {7}


def test_detection_rows(spark):
    rows = [("AKT 5", 1, '{"numbers": ["Kt n/k 12A", "kt. n/k 12a", "x", "Kt. a/k 5a, b"]}'), ("AKT 5", 2, "none"), ("AKT 1", 1, '{"numbers": ["7 ", " "]}')]
    df = spark.createDataFrame(rows, "volume string, page int, response string")
    got = [tuple(r) for r in candidates.detection_rows(df, "response", "numbers", "volume").collect()]
    assert sorted(got) == [("AKT 1", 1, "7", "7"), ("AKT 5", 1, "Kt n/k 12A", "Kt. n/k 12a"), ("AKT 5", 1, "Kt. a/k 5a", "Kt. a/k 5a"), ("AKT 5", 1, "Kt. a/k 5b", "Kt. a/k 5b")]


def test_prompts(spark, value):
    examples = F.array(F.struct(F.lit("a {text}").alias("source"), F.lit("b").alias("target")), F.struct(F.lit("c").alias("source"), F.lit("d").alias("target")))
    made = prompts.prompt("{examples}\nFrom {language} {other}: {text}", "t", language=F.lit("German"), examples=examples, instruction=F.lit("Mind gaps."), tries=F.lit(1), retry=" Again.")
    assert value(made, t=" x  {language} ") == "Example 1:\na {text}\n=> b\n\nExample 2:\nc\n=> d\nFrom German {other}: x {language}\nMind gaps. Again."
    assert value(prompts.prompt("{examples}{text}", "t", tries=F.lit(0), retry="no"), t=None) == ""
    routes = spark.createDataFrame([("p1", "X"), ("v1", "Y"), ("v2", None)], "key string, language string")
    df = spark.createDataFrame([("p1", "v1"), ("p9", "v1"), (None, "v2"), ("p9", "v9")], "pdf string, volume string")
    assert [r["language"] for r in prompts.routed(df, ["pdf", "volume"], routes, "key", "language", "Z").collect()] == ["X", "Y", "Z", "Z"]
    assert prompts.routed(df, ["volume"], routes, "key", "language", skip=True).count() == 2


def test_sampled_predictions(spark):
    """Order and number of answers, waits of a busy predictor, nulls and ids of any size."""
    df = spark.createDataFrame([(2**60 + k, None if k == 3 else f"t{k}") for k in range(10)], "id long, t string")
    got = {r["id"]: r["responses"] for r in rounds.sampled(df, lambda texts, n, turn: [[f"{t}/{k}/{turn}" for k in range(n)] for t in texts], "t", "id", 3, 1, batch=4).collect()}
    assert got == {2**60 + k: [f"{'' if k == 3 else f't{k}'}/{j}/1" for j in range(3)] for k in range(10)}

    def busy_until(state, tries):
        def predictor(texts, n, turn):
            state.append(1)
            if len(state) % tries:
                raise rounds.Busy
            return [["ok"] * n for _ in texts]

        return predictor

    ok = rounds.sampled(df.coalesce(1), busy_until([], 3), "t", "id", 2, sleep=lambda s: None)
    assert {tuple(r["responses"]) for r in ok.collect()} == {("ok", "ok")}
    for bad in (busy_until([], 4), lambda texts, n, turn: [["one"] for _ in texts]):
        with pytest.raises(Exception, match="Busy|answers"):
            rounds.sampled(df.coalesce(1), bad, "t", "id", 2, sleep=lambda s: None).collect()


def test_document_pipeline(spark):
    """Two volumes, a number that one sample imagines, a record that is asked again, a volume without a language."""
    pages = spark.createDataFrame([("AKT 5", 1, "Kt. n/k 1 lines 1 2 3"), ("AKT 5", 2, "goes on"), ("AKT 9", 4, "Kt. n/k 2 lines 1")], "volume string, page int, text string")
    published = spark.createDataFrame([("kt. N/K 1", "a-na ša-ru", "o1", 1), ("Kt. n/k 1", "a-na", "o2", 0)], "excavation_no string, transliteration string, oare_id string, rid int")

    def detect(texts, n, turn):
        numbers = lambda t: re.findall(r"Kt\. n/k \d+", t)
        return [[json.dumps({"numbers": numbers(t) + (["Kt. z/k 9"] if k == 0 else [])}) for k in range(n)] for t in texts]

    def extract(texts, n, turn):
        out = []
        for t in texts:
            lines = {str(k): f"a-na {k}" for k in (1, 2, 3)} if "k 1" in t else {"1": "šu-ma"}
            ranges = {"1-2": "to the man"} if "k 1" in t and turn == 0 else {"1-2": "to the man", "3": "and he"} if "k 1" in t else {"1": "wenn er"}
            out.append([json.dumps({"lines": lines, "ranges": ranges})] * n)
        return out

    def translate(texts, n, turn):
        return [[json.dumps({"translation": "english " + ("with example" if "=> given" in t else "without")}) if k else "noise" for k in range(n)] for t in texts]

    pool = spark.createDataFrame([(1, "wenn sie", "given")], "id long, text string, translation string")
    routes = spark.createDataFrame([("AKT 9", "German")], "volume_key string, language string")
    models = extraction.Models(detect, extract, translate)
    tables = extraction.document_pipeline(pages, published, pool, routes, models, config.settings("extraction", {"samples": 3, "examples": 2, "retries": 2}))
    assert {tuple(r) for r in tables["detections"].collect()} == {("AKT 5", "Kt. n/k 1", 1), ("AKT 9", "Kt. n/k 2", 4)}
    assert {(r["canonical"], r["source_text"], r["oare_id"]) for r in tables["linked"].collect()} == {("Kt. n/k 1", "a-na ša-ru", "o2"), ("Kt. n/k 2", None, None)}
    assert {(r["canonical"], r["flags"]) for r in tables["extracted"].collect()} == {("Kt. n/k 1", ""), ("Kt. n/k 2", "")}
    assert {tuple(r) for r in tables["pairs"].collect()} == {
        ("Kt. n/k 1", 1, "1-2", "a-na 1 a-na 2", "to the man", -1), ("Kt. n/k 1", 1, "3", "a-na 3", "and he", -1), ("Kt. n/k 2", 4, "1", "šu-ma", "english with example", -1),
    }
    left_out = extraction.document_pipeline(pages, published, pool, routes, models, config.settings("extraction", {"samples": 3, "volumes": "AKT 5", "excluded": "Kt. n/k 1"}))
    assert left_out["pairs"].count() == 0


def test_settings():
    made = config.settings("extraction", {"volumes": "a, b", "samples": "7", "prompt": {"retry": "x"}})
    assert (made.volumes, made.samples, made.prompt.retry, made.votes) == (("a", "b"), 7, "x", 2)
    assert config.from_json("extraction", config.to_json(made)) == made
    assert config.settings("pool", {"skip_fold": "none", "unique": "false"}) == config.PoolSettings(skip_fold=None, unique=False)
    with pytest.raises(ValueError, match="no settings"):
        config.settings("pool", {"other": 1})
    with pytest.raises(ValueError, match="neither"):
        config.settings("pool", {"unique": "maybe"})


def test_artifacts_and_usage(spark, tmp_path):
    path = str(tmp_path / "run.json")
    artifacts.write_artifact(spark, path, {"a": [1, "ü"]})
    assert artifacts.read_artifact(spark, path) == {"a": [1, "ü"]}
    with pytest.raises(FileExistsError):
        artifacts.write_artifact(spark, path, {})
    artifacts.write_artifact(spark, path, {}, overwrite=True)
    log = str(tmp_path / "usage")
    rows = spark.createDataFrame([("m", 5, 2, 0.5), ("m", None, 1, None)], "model string, prompt_tokens int, completion_tokens int, cost double")
    artifacts.log_usage(rows, log, "one")
    artifacts.log_usage(rows, log, "two")
    assert {tuple(r) for r in artifacts.usage_summary(spark, log).collect()} == {("one", 2, 5, 3, 0.5), ("two", 2, 5, 3, 0.5)}
    (tmp_path / "pairs" / "table").mkdir(parents=True)
    (tmp_path / "pairs" / "table" / "pairs.csv").write_text("x")
    assert artifacts.companion_path(spark, "", "/data/table.csv", str(tmp_path / "pairs")).endswith("/table/pairs.csv")
    assert artifacts.companion_path(spark, "", "/data/other.csv", str(tmp_path / "pairs")) is None
    with pytest.raises(FileNotFoundError):
        artifacts.companion_path(spark, "/none.csv", "", "")


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "norm_ws" in capsys.readouterr().out
    assert cli.main(["run", "no_such", "x", "y"]) == 2
    out = str(tmp_path / "out")
    assert cli.main(["run", "norm_ws", "/root/testdata/sf0.001", out], spark) == 0
    assert spark.read.parquet(out).count() == 200 and artifacts.read_artifact(spark, out + ".run.json")["name"] == "norm_ws"
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["run", "norm_ws", "/root/testdata/sf0.001", out], spark)
    rows = spark.createDataFrame([("r1", "1-3) a man is here", "a-na"), ("r2", "", "a")], "canonical_excavation_number string, translation string, transliteration string")
    rows.withColumn("id", F.col("canonical_excavation_number")).write.parquet(str(tmp_path / "in"))
    assert cli.main(["clean", str(tmp_path / "in"), str(tmp_path / "clean")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "clean/kept")).first()["translation"] == "a man is here"
    assert artifacts.read_artifact(spark, str(tmp_path / "clean.run.json"))["counts"]["n_empty"] == 1
    assert cli.main(["pool", str(tmp_path / "in"), str(tmp_path / "pool"), "--set", "least=3", "--set", "most=8"], spark) == 0
    assert [r["example"] for r in spark.read.parquet(str(tmp_path / "pool")).collect()] == ["1-3) a…"]
