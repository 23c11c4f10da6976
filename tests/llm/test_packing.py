import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]


def check_sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_pieces_and_sequences(spark, table, messy, tokenizer):
    for docs in (table("documents"), messy):
        rows = packing.pack_documents(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter((t["doc_id"], *p) for t in texts for p in expected(tokenizer, t["text"]))
        bins = check_sequences(rows)
        assert {(r["n_sequences"], r["lower_bound"]) for r in rows} == {(bins, packing.lower_bound(np.array([r["length"] for r in rows]), 4096))}
        assert bins <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_empty_table(spark, messy):
    assert packing.pack_documents(messy.limit(0)).count() == 0


def packed(spark, sizes, pack, capacity=4096):
    pieces = spark.createDataFrame([(None if k % 50 == 0 else 7 if k % 3 == 0 else 2**60 + k, k, 0, int(n), k, k) for k, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    out = packing.pack_pieces(pieces, capacity, pack=pack).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in out) == Counter((r["doc_id"], r["piece"], r["length"]) for r in pieces.collect())
    bins = check_sequences(out)
    bound = packing.lower_bound(np.array(sizes), capacity)
    assert {(r["n_sequences"], r["lower_bound"]) for r in out} == {(bins, bound)}
    # The certificates of the groups say how many sequences their pieces have and that fewer than the bound are none.
    groups = defaultdict(list)
    for r in out:
        groups[r["pack_bins"], r["pack_bound"], r["sequence_id"] >> 21].append(r)
    assert all(len({r["sequence_id"] for r in rows}) <= key[0] and key[1] <= key[0] for key, rows in groups.items())
    return bins, bound


def test_exchange_goes_on_while_it_gains(spark):
    """Small packs lose what one pack of all would not; exchange wins much of it back."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 4097, 6000)
    whole = packing.best_fit_decreasing(sizes.tolist(), 4096)[2]
    alone = sum(packing.best_fit_decreasing(sizes[k::6].tolist(), 4096)[2] for k in range(6))
    bins, bound = packed(spark, sizes, 1000)
    assert bound <= whole <= bins < alone
    assert bins - whole < 0.6 * (alone - whole)


def test_exchange_between_packs(spark):
    sizes = np.random.default_rng(0).integers(1, 4097, 3000)
    bins, bound = packed(spark, sizes, 300)
    assert bins <= bound * 1.02 + 2


def test_small_documents_meet_the_bound(spark):
    bins, bound = packed(spark, np.random.default_rng(1).integers(1, 600, 5000), 500)
    assert bins == bound


def test_words_are_encoded_as_in_the_whole_text(tokenizer):
    from pathlib import Path

    words = packing.WordTokens(Path(packing.default_tokenizer()).read_text(), limit=3)
    odd = ["It's Ä b̈ <|endoftext|> a", "ǅ ﬁne ª x², 1.5, a.b. é. 中文,", "İstanbul ΣΑΣ. ...", None, "", "\x1c a\x85b c　d", "a, b. C.D, e.,\nf,"]
    for _ in range(2):
        for text, data in zip(odd, words.encode(odd), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def fewest(sizes, capacity):
    """Fewest bins by search."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for n in range(len(bins)):
            if bins[n] + sizes[k] <= capacity and bins[n] not in bins[:n]:
                bins[n] += sizes[k]
                go(k + 1, bins)
                bins[n] -= sizes[k]
        go(k + 1, bins + [sizes[k]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold(sizes):
    exact = fewest(sizes, 20)
    at, offset, bins = packing.best_fit_decreasing(sizes, 20)
    assert packing.lower_bound(np.array(sizes), 20) <= exact <= bins
    for b in range(bins):
        inside = sorted((offset[k], sizes[k]) for k in range(len(sizes)) if at[k] == b)
        assert [o for o, _ in inside] == [sum(s for _, s in inside[:n]) for n in range(len(inside))]
        assert sum(s for _, s in inside) <= 20
