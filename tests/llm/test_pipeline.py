"""Stages one by one against plain Python over the same rows, and the whole run."""

import math
import os
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpusloom.llm import common, minhash, mixing, packing, quality, toxicity
from test_minhash import brute as duplicate_classes
from test_mixing import targets
from test_packing import check_sequences, expected as expected_pieces
from test_quality import features


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.select("doc_id", "text", "lang", "source").collect())


def signals(text):
    n, chars, symbols, dups, repeats, failed = features(text)
    lines = sum(bool(x.encode().split()) for x in (text or "").split("\n"))
    upper = sum("A" <= c <= "Z" for c in text or "")
    return {
        "symbols": symbols / max(n, 1), "dup_lines": dups / max(lines, 1), "repeats": repeats / max(n, 1), "word_length": chars / max(n, 1), "capitals": upper / max(chars, 1), "shouts": (text or "").count("!") / max(n, 1),
    }, failed


def quality_brute(docs, labels):
    marks = {}
    for r in labels:
        if r["quality"] is not None and r["doc_id"] is not None:
            marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    seen = {text: signals(text) for _, text, _, _ in docs}
    holdout = defaultdict(list)
    for (i, text, lang, _), n in docs.items():
        if i in marks and not seen[text][1]:
            holdout[lang] += [(marks[i], seen[text][0])] * n
    share, cut = quality.RISK / len(quality.GRIDS), {}
    for lang, rows in holdout.items():
        good = [s for q, s in rows if q == 1]
        for rule, grid in quality.GRIDS.items():
            best = None
            for c in grid:
                k = sum(s[rule] > c for s in good)
                tail = sum(math.comb(len(good), j) * share**j * (1 - share) ** (len(good) - j) for j in range(k + 1))
                if not good or k >= len(good) * share or tail > quality.DELTA / (len(holdout) * len(quality.GRIDS)):
                    break
                gain = sum(q == 0 and s[rule] > c for q, s in rows) - quality.FALSE_COST * k
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, c)
            if best:
                cut[lang, rule] = best[1]
    return Counter({row: n for row, n in docs.items() if not seen[row[1]][1] and not any((row[2], rule) in cut and value > cut[row[2], rule] for rule, value in seen[row[1]][0].items())})


def near_duplicates_brute(docs):
    """The smallest id of each class, a null id last; one of its rows."""
    worded = sorted((row for row in docs if (row[1] or "").encode().split()), key=lambda r: (r[0] is None, r[0] or 0))
    classes = duplicate_classes([(k, row[1]) for k, row in enumerate(worded)])
    kept = Counter({row: n for row, n in docs.items() if not (row[1] or "").encode().split()})
    return kept + Counter({worded[k]: 1 for k, root in classes.items() if k == root})


def mixing_checks(before, after):
    size = lambda text: len((text or "").encode().split())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for (_, text, _, source), n in before.items():
        sizes[source] += n * size(text)
        largest[source] = max(largest[source], size(text))
    for row, n in after.items():
        assert row in before and n <= 2 * before[row]
        taken[row[3]] += n * size(row[1])
    assert all(after[row] == n for row, n in before.items() if not size(row[1]))
    aims = targets(sizes)
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in sizes)


@pytest.fixture(scope="module")
def tables(spark, table, messy, tmp_path_factory):
    """Two folders: the fixture's tables, and odd documents with few labels."""
    odd = tmp_path_factory.mktemp("odd")
    messy.write.parquet(str(odd / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(odd / "labels.parquet"))
    return ["/root/testdata/sf0.001", str(odd)]


@pytest.mark.parametrize("which", [0, 1])
def test_stages_by_brute_force(spark, tables, which):
    from tokenizers import Tokenizer

    sf_dir = tables[which]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, columns = common.read(spark, sf_dir, "labels"), out.columns
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, sf_dir)
        if name != "packing":
            assert out.columns == columns
            out = common.materialize(out, "tested")
        was, now = rows_of(before), rows_of(out) if name != "packing" else None
        if name == "quality":
            assert now == quality_brute(was, labels.collect())
        elif name == "toxicity":
            model = toxicity.train(before, labels)
            if model is None:
                assert now == was
            else:
                score = lambda t: model.probability(model.logit(model.word_shares(toxicity.words_of(t)), toxicity.np.array(toxicity.counted_once(toxicity.words_of(t)), bool)))
                assert now == Counter({row: n for row, n in was.items() if score(row[1]) < 0.7})
        elif name == "near_duplicates":
            got = near_duplicates_brute(was)
            # Rows of one id and text may differ in other columns; which of them stays is free.
            assert Counter((i, t) for i, t, _, _ in now.elements()) == Counter((i, t) for i, t, _, _ in got.elements())
        elif name == "mixing":
            mixing_checks(was, now)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = out.collect()
    pieces = Counter()
    for (i, text, _, _), n in was.items():
        for piece in expected_pieces(tokenizer, text):
            pieces[(i, *piece)] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    assert check_sequences(rows) == {r["n_sequences"] for r in rows}.pop()


def test_run_sweeps_what_its_stages_wrote(spark, sf):
    from urllib.parse import urlparse

    before = set(common._written)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    left = [p for p in common._written if p not in before]
    assert not any("quality" in p or "signatures" in p for p in left) and sum("stage-" in p for p in left) == 1
    assert all(os.path.exists(urlparse(p).path) for p in left)


def test_empty(spark, messy, tmp_path):
    messy.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = common.read(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert minhash.keep_one_of_each(docs).count() == mixing.mix_documents(docs).count() == 0
