import random
import time

import pyarrow as pa
import pytest

from corpusloom import catalog
from corpusloom.functions import metrics, pair_scores
from corpusloom.operators import consensus

WORDS = ["the", "cat", "sat,", "1.5", "-x", "é", "on-a", "“q”", "漢字", "😀", "don't", "", "a.", "a"]
SCHEMA = "record long, idx long, text string, valid boolean"


def texts_of(rng, n, most=9):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_scores_of_pairs_equal_those_one_by_one():
    """To the last bit: in batches of small records, by matrices, with n-grams ranked anew for many letters, across blocks."""
    rng = random.Random(1)
    many_letters = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(450)) for _ in range(3)]
    records = [texts_of(rng, rng.randint(1, 9)) for _ in range(60)] + [["", " ", "a"], [many_letters[0], many_letters[1], many_letters[0][:300] + many_letters[2]]]
    for group in (records, [texts_of(rng, 40, 60)]):
        got = pair_scores.scores_within([t for r in group for t in r], [len(r) for r in group], True)
        for flat, score in zip(got, (metrics.chrf, metrics.bleu), strict=True):
            assert flat.tolist() == [score(a, b) for r in group for a in r for b in r]
    left, right = texts_of(rng, 7, 40), texts_of(rng, 11, 40)
    there, back = pair_scores.scores_between(left, right, True)
    for k, score in enumerate((metrics.chrf, metrics.bleu)):
        assert there[k].tolist() == [[score(a, b) for b in right] for a in left]
        assert back[k].tolist() == [[score(b, a) for a in left] for b in right]


def plainly(rows, geo, own, prefer):
    """The choice by its definition, a pair of candidates at a time."""
    out = {}
    for record in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in rows if r[0] == record], key=lambda r: r[0])
        if prefer and any(r[2] for r in mine):
            mine = [r for r in mine if r[2]]
        ranks = []
        for i, (_, text, _) in enumerate(mine):
            others = [o[1] or "" for j, o in enumerate(mine) if own or j != i]
            means = [sum(f(text or "", o) for o in others) / max(len(others), 1) for f in (metrics.chrf, metrics.bleu)[: 1 + geo]]
            total = (means[0] * means[1]) ** 0.5 if geo else means[0]
            ranks.append(((0, total) if own else (bool((text or "").strip()), total, *means, len(text or "")), -i))
        at = max(range(len(mine)), key=ranks.__getitem__)
        out[record] = (mine[at][0], mine[at][1] or "", pytest.approx(ranks[at][0][1], abs=1e-9))
    return out


def some_records():
    rng = random.Random(2)
    rows = []
    for record in (None, *range(1, 25)):
        base = texts_of(rng, 3)
        for i in range(rng.choice((1, 2, 3, 5, 30))):
            rows.append((record, i, rng.choice([rng.choice(base), *texts_of(rng, 1), None, " "]), rng.choice((True, False, None))))
    return rows


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("prefer", [None, "valid"])
def test_geo_choice_whole_and_by_blocks(spark, monkeypatch, block, prefer):
    monkeypatch.setattr(consensus, "BLOCK_ROWS", block)
    rows = some_records()
    got = consensus.pick_by_peers(spark.createDataFrame(rows, SCHEMA), "geo", prefer=prefer).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plainly(rows, True, False, prefer)


def test_a_large_record_takes_seconds(spark):
    """One by one, in one task, the 89,700 ordered pairs took 69 s at the rate of 400 of them."""
    rng = random.Random(3)
    rows = [(1, i, " ".join(rng.choice(("tion", "er", "the", "ea", "wh", "on")) + rng.choice(("sh", "ing", "le")) for _ in range(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "record long, idx long, text string")
    began = time.time()
    assert consensus.pick_by_peers(df, "geo").count() == 1
    assert time.time() - began < 25


@pytest.mark.parametrize("block", [256, 4])
def test_reranking_counts_the_candidate_itself(spark, monkeypatch, block):
    monkeypatch.setattr(consensus, "BLOCK_ROWS", block)
    rows = some_records()
    got = consensus.pick_by_peers(spark.createDataFrame(rows, SCHEMA), own=True).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plainly(rows, False, True, None)


def test_a_large_record_goes_to_many_tasks(spark, monkeypatch):
    """A record of 40 texts in blocks of about 8: no task holds more than two of them; copies are met once, whatever their number."""
    monkeypatch.setattr(consensus, "BLOCK_ROWS", 8)
    met, meet = spark.sparkContext.accumulator(0), consensus._meet
    most = 30

    def watched(geo, own):
        run = meet(geo, own)

        def counted(key, rows):
            assert rows.num_rows <= most
            met.add(1)
            return run(key, rows)

        return counted

    monkeypatch.setattr(consensus, "_meet", watched)
    rows = [(1, i, f"the cat {i % 40} sat on mat {i % 7}", None) for i in range(80)]
    got = consensus.pick_by_peers(spark.createDataFrame(rows, SCHEMA), own=True).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plainly(rows, False, True, None)
    assert met.value > 20


@pytest.mark.parametrize("own", [False, True])
def test_records_of_the_same_texts_are_scored_once(monkeypatch, own):
    """However many there are, and wherever a batch of rows ends; other records between them are still scored."""
    scored, within = [], pair_scores.scores_within
    monkeypatch.setattr(pair_scores, "scores_within", lambda texts, sizes, geo: scored.extend(sizes) or within(texts, sizes, geo))
    texts = ["the cat sat on the mat", "nothing of the kind, web", "the cat sat on the mat"]
    rows = [(r, 10 + i, f"{t} {r}" if r % 1000 == 7 else t, False) for r in range(15_000) for i, t in enumerate(texts)]
    columns = list(zip(*rows, strict=True))
    types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    table = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["record", "idx", "text", "preferred"])
    got = [r for batch in consensus._choose(False, own)(iter(table.to_batches(max_chunksize=1000))) for r in batch.to_pylist()]
    assert sorted(r["record"] for r in got) == list(range(15_000)) and {r["best_idx"] for r in got} == {10}
    assert all(r["best_text"] == (f"{texts[0]} {r['record']}" if r["record"] % 1000 == 7 else texts[0]) for r in got)
    assert sum(scored) <= 2 * (15 + 2)


def test_peer_choice_keeps_a_row_without_an_id(spark, oracle, rows_of, tmp_path):
    rows = [(None, "a", "en", "web", 1), (1, "b", "en", "web", 1), (2, "c", "en", "news", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["peer_choice"](spark, str(tmp_path))
    assert got.columns == ["record", "plain", "own", "geo"]
    assert rows_of(got.toPandas()) == rows_of(oracle(catalog.ORACLES["peer_choice"], str(tmp_path)))
