"""Literal cases of the text functions, and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrays, cleaners, gaps, ids, metrics, numbers, profiles, text


@pytest.fixture
def value(spark):
    def run(column, **cells):
        schema = ", ".join(f"{k} string" for k in cells)
        return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "function, given_text, expected",
    [
        (text.drop_repeated_words, "a a b a a", "a b a"),
        (text.drop_repeated_words, "  ", "  "),
        (text.normalize_ws, " a \tb ", "a b"),
        (text.collapse_repeats, "Šarru Šarru a", "Šarru a"),
        (lambda c: text.cut_words(c, 7), "aaa bb cccc d", "aaa bb"),
        (lambda c: text.cut_words(c, 2), "aaaa b", "aaaa"),
        (lambda c: text.cut_words(c, 0), "aaaa b", ""),
        (lambda c: text.ellipsis_cut(c, 5), "abcd efgh", "abcd…"),
        (text.drop_line_numbers, "a 5. b 7. c 10. 0. d 105.", "a b 7. c 0. d"),
        (text.space_slashes, "a/b , c", "a / b, c"),
        (text.space_fractions, "1½a", "1 ½ a"),
        (text.pick_alternative, "one / two 3 / 12", "one 3 / 12"),
        (lambda c: text.from_marker(c, "it's"), "so it’s here", "it’s here"),
        (text.final_answer, "x</think> ```json\n{}\n```", "{}"),
        (numbers.decimal_fractions, "1.5 0.25 0.625 2.66 0.35", "1 ½ ¼ ⅔ 2.66 ⅓"),
        (numbers.spaced_fractions, "1 / 2", "½"),
        (numbers.spaced_fractions, "1/2", "1/2"),
        (numbers.spaced_fractions, "month 2 / 3", "month 2 / 3"),
        (numbers.glued_fractions, "11/2", "1 ½"),
        (numbers.compact_fractions, "1 1/3 and 2/3", "1 ⅓ and ⅔"),
        (numbers.leading_zeros, "007 100 000", "7 100 0"),
        (numbers.roman_numerals, "III IVth I", "3 4 I"),
        (numbers.shekel_fractions, "7 / 12 shekels", "½ shekel 15 grains"),
        (gaps.collapse_gaps, "a <gap> - <gap><gap> b", "a <gap> b"),
        (gaps.fold_angles, "<x> <GAP>", "(x) <gap>"),
        (ids.excavation_number, "see KT N/K 12a + 13", "Kt. n/k 12a+13"),
        (ids.excavation_number, "nothing", ""),
        (ids.volume_key, "data/akt_06a.pdf", "AKT 6A"),
        (lambda c: F.concat_ws("|", ids.expand_shorthand(c)), "12a, b", "12a|12b"),
        (lambda c: F.concat_ws(",", arrays.page_list(c).cast("array<string>")), "1-3;2|9-7", "1,2,3,7,8,9"),
        (lambda c: F.concat_ws(",", arrays.page_list(c).cast("array<string>")), "1,x", ""),
        (arrays.first_json_object, 'so {bad {"a": 1} x', '{"a": 1}'),
        (arrays.first_json_object, "none", "{}"),
        (arrays.flat_entries, '{"3": "c", "1-2": " a  b "}', "a b c"),
        (lambda c: profiles.normalize(c, "main", "transliteration"), "a x b", "a<gap>b"),
        (lambda c: profiles.normalize(c, "main", "transliteration"), "(d) ša-ru ₓ f ß!", "{d} ša-ru ss"),
        (lambda c: profiles.normalize(c, "main", "translation"), "the III (pl.) Šalim-aḫum PN1 , x", "the 3 Šalim-ahum <gap>, x"),
        (lambda c: profiles.normalize(c, "pipeline", "translation"), "-gold … x one one / two", "pašallum gold <gap> one"),
        (lambda c: profiles.normalize(c, "corpus", "transliteration"), "a2 u₃ (d) 1 1/2 ... b b", "á ù {d} 1 ½ <gap> b"),
        (lambda c: profiles.normalize(c, "corpus", "translation"), "5 + x minas PN XX (?) (3) {a}", "5+<gap> minas <gap> 20 a"),
    ],
)
def test_literal(value, function, given_text, expected):
    assert value(function(F.col("t")), t=given_text) == expected


def test_repair_gaps(value):
    assert value(gaps.repair_gaps("s", "t"), s="<gap> <gap>", t="a <gap> b <gap> c <gap> d") == "a <gap> b <gap> c  d"
    assert value(gaps.repair_gaps("s", "t"), s="", t="a <gap>") == "a <gap>"


def test_cut_to_ratio_keeps_the_raw_text(value):
    assert value(text.cut_to_ratio("t", "r", 2.0), t="a  b", r="abc") == "a  b"
    assert value(text.cut_to_ratio("t", "r", 1.0), t="aaa bbb ccc", r="aaaa") == "aaa"


def test_coverage(spark):
    df = spark.createDataFrame([([[1, 5], [7, 7], [8, 8]], [[1, 3]])], "l array<array<int>>, r array<array<int>>")
    assert df.select(arrays.coverage_flags("l", "r")).first()[0] == "missing_translation_range:4,5,7,8"


def test_nulls_stay_null(value):
    for side in ("transliteration", "translation"):
        for name in ("main", "pipeline", "corpus"):
            assert value(profiles.normalize("t", name, side), t=None) is None


def test_metrics():
    assert metrics.chrf("the same", "the same") == pytest.approx(100)
    assert metrics.chrf("", "a") == 0 and metrics.bleu("a", " ") == 0
    assert metrics.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(100)
    assert 0 < metrics.bleu("the cat sat on a mat", "the cat sat on the mat") < 100
    assert metrics.sequence_ratio("abcd", "bcde") == pytest.approx(0.75)
    assert numbers.span_lengths(512)[0] >= 512


WORDS = st.lists(st.sampled_from(["a", "bb", "<gap>", "-", "1.5", "x", "Šu", "  "]), max_size=12).map(" ".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=30))
def test_properties(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select("t", text.normalize_ws("t").alias("w"), text.drop_repeated_words("t").alias("d"), gaps.collapse_gaps("t").alias("g"), text.cut_words("t", 9).alias("c"))
    for r in once.select("*", text.normalize_ws("w").alias("w2"), text.drop_repeated_words("d").alias("d2"), gaps.collapse_gaps("g").alias("g2")).collect():
        assert r["w"] == r["w2"] and r["d"] == r["d2"] and r["g"] == r["g2"]
        assert len(r["c"]) <= 9 or " " not in r["c"]
        assert r["g"].count("<gap>") <= r["t"].count("<gap>")


@pytest.mark.parametrize(
    "function, given_text, expected",
    [
        (cleaners.drop_line_markers, "1-3) the 4'-5' man , 12 (6) ¹⁻⁴Foo 1-2, 13-17", "the man, 12 Foo"),
        (cleaners.drop_translation_notes, "a (Rest Vs. abgebr.) b Uebersetzung lohnt nicht. c 3-4 Zz. d", "a b c d"),
        (cleaners.drop_transliteration_notes, "a-na obv. šu seal impression kà l.e. ma", "a-na šu kà ma"),
        (cleaners.drop_terminal_notes, "the end , weitgehend. ", "the end,"),
        (cleaners.sup_sub_to_unicode, "a<sup>k<sub>2</sub>i</sup> <sup>", "aᵏ₂ⁱ "),
        (cleaners.drop_superscripts, "ᵈUTU aᵏⁱ bˡ", "{d}UTU a{ki} b"),
        (cleaners.drop_leading_summary, "X tarafından yazdığı\n1-3) um a", "1-3) um a"),
        (cleaners.drop_leading_summary, "mektuptur um-ma A", "um-ma A"),
        (cleaners.drop_leading_summary, "no cue\n1-3) um", "no cue 1-3) um"),
        (cleaners.cleaned_translation, "1-3) „the [man]” x … 1/2 mina Spuren", '"the man" <gap> ½ mina'),
        (lambda c: cleaners.cleaned_transliteration(c, F.lit("akt 7B")), "⸢a-na⸣ [x] 1/2 aᵏⁱ ...", "a-na <gap> ½ a{ki} <gap>"),
        (lambda c: cleaners.cleaned_transliteration(c, F.lit("AKT 1")), "⸢a-na⸣ [x] Rs.", "a-na [x]"),
        (gaps.normalize_gaps, "a x - [gap] b … ...c", "a <gap> b <gap> c"),
    ],
)
def test_cleaners(value, function, given_text, expected):
    assert value(function(F.col("t")), t=given_text) == expected


def test_span_masks():
    for n in (1, 2, 10, 300):
        mask = numbers.span_mask(n, n)
        assert len(mask) == n and (n == 1 or sum(mask) == min(max(round(n * 0.15), 1), n - 1))
    assert numbers.span_mask(50, 1) == numbers.span_mask(50, 1)


def test_long_texts_count_alike():
    import random

    rng = random.Random(0)
    a, b = ("".join(rng.choice("abc é") for _ in range(900)) for _ in range(2))
    plain = metrics.chrf_counts(a[:300], b[:300])
    metrics.LONG, kept = 1, metrics.LONG
    assert metrics.chrf_counts(a[:300], b[:300]) == plain
    metrics.LONG = kept
    long = metrics.chrf_counts(a, b)
    metrics.LONG = 10**9
    assert metrics.chrf_counts(a, b) == long
    metrics.LONG = kept
