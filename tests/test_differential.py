"""Every registered query of the core against its SQL, and plans without row-at-a-time Python."""

import pytest

from corpusloom import catalog
from corpusloom.functions import profiles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, oracle, rows_of, name):
    got, expected = catalog.QUERIES[name](spark, SF).toPandas(), oracle(catalog.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"corpus_scores", "edit_topk"}))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["norm_ws", "dedup_words", "profile_main", "profile_corpus", "keep_first", "prev_context", "top_k"])
def test_native_plans(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_columns_are_pruned(spark):
    plan = catalog.QUERIES["group_first"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """Texts with all that the operators change both before and after any cut."""
    body = " ".join(f"wa{chr(97 + k % 26)} 1.5 PN “q{chr(97 + k % 23)}” [c] ā 1 / 2 <gap> (7) II ṣ! 50%" for k in range(40))
    rows = [(k, f"{body} end{k}", "en", "s", 0) for k in range(6)] + [(6, "short", "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("name", ["main", "pipeline", "corpus"])
def test_profiles_read_whole_texts(spark, long_documents, name):
    folder, texts = long_documents
    got = {r["doc_id"]: r for r in catalog.QUERIES[f"profile_{name}"](spark, folder).collect()}
    for side, column in (("transliteration", "source_text"), ("translation", "target_text")):
        marked = spark.createDataFrame([(k, f"ki (d) a x b, 1.5 PN {t} II 1 / 2 <gap> ā") for k, t in texts.items()], "k long, t string")
        assert {k: r[column] for k, r in got.items()} == {r["k"]: r["t"] for r in marked.select("k", profiles.normalize("t", name, side).alias("t")).collect()}
        assert all(f"end{k}" in got[k][column] for k in range(6))


@pytest.mark.parametrize("name, column", [("gap_tokens", "gaps"), ("gap_tokens", "angles"), ("extracted_texts", "target_text"), ("extracted_texts", "source_text"), ("extracted_texts", "body"), ("train_table", "target_text"), ("line_markers_whole", "t"), ("quote_folds_whole", "t")])
def test_text_queries_read_whole_texts(spark, long_documents, name, column):
    folder, texts = long_documents
    rows = catalog.QUERIES[name](spark, folder).collect()
    assert len(rows) >= 5
    for r in rows:
        k = int(r["id"] if name == "train_table" else r["doc_id"])
        assert k == 6 or f"end{k}" in r[column] and len(r[column]) > len(texts[k]) / 2


def test_quotes_fold_in_whole_texts_by_brute_force(spark, long_documents):
    folder, texts = long_documents
    table = str.maketrans("“”„‟«»″‚‛‘’ʼʹʻ′`´", '"' * 7 + "'" * 10, "[]")
    got = {r["doc_id"]: r["t"] for r in catalog.QUERIES["quote_folds_whole"](spark, folder).collect()}
    assert got == {k: ("“a” ‘b’ [c] " + t).translate(table) for k, t in texts.items()}
