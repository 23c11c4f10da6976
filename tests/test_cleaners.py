"""Cleaners of extracted texts: every phrase of the tables, the parser of line markers, edges of both."""

import pytest

from corpusloom.functions import cleaners


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
        got = {r["k"]: r["v"] for r in df.select("k", function("t").alias("v")).collect()}
        return [got[k] for k in range(len(texts))]

    return run


PHRASES = [(cleaners.drop_translation_notes, cleaners.TRANSLATION_NOTES), (cleaners.drop_transliteration_notes, cleaners.TRANSLITERATION_NOTES), (cleaners.drop_transliteration_notes, cleaners.DOCUMENT_NOTES)]


@pytest.mark.parametrize("function, phrases", PHRASES)
def test_every_phrase(apply, function, phrases):
    """Alone, in parentheses, in capitals, with more white space, with umlauts written out."""
    assert apply(function, [f"xyw {p} xyz" for p in phrases]) == ["xyw xyz"] * len(phrases)
    assert apply(function, [f"xyw ({p}) xyz" for p in phrases]) == ["xyw xyz"] * len(phrases)
    assert apply(function, [f"xyw {p.upper()} xyz" for p in phrases if p.upper().lower() == p]) == ["xyw xyz"] * sum(p.upper().lower() == p for p in phrases)
    assert apply(function, [f"xyw {p.replace(' ', '   ')} xyz" for p in phrases]) == ["xyw xyz"] * len(phrases)
    written = [p.replace("ü", "ue").replace("ö", "oe").replace("ä", "ae").replace("ß", "ss") for p in phrases]
    assert apply(function, [f"xyw {p} xyz" for p in written]) == ["xyw xyz"] * len(phrases)


def test_words_that_begin_with_a_note_stay(apply):
    texts = ["anfangs", "sealed", "hunter", "casement", "tablets"]
    assert apply(cleaners.drop_translation_notes, texts[:1]) == texts[:1]
    assert apply(cleaners.drop_transliteration_notes, texts[1:]) == texts[1:]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a 3 Zz. b", "a b"), ("a ca. 3 Zz. b", "a b"), ("a 3-4 Z. b", "a b"), ("a (ca 3 – 4 zz) b", "a b"), ("a 3-4 nur geringe Reste b", "a b"), ('a 3" - 4 nur  geringe Reste. b', "a b"), ("a 3 nur geringe Reste b", "a 3 nur geringe Reste b"),
        ("a Öy. b", "a b"), ("a Ö. y. b", "a b"), ("a Ay: b", "a b"), ("a (Ay) b", "a (Ay) b"), ("a K. 10. b", "a b"), ("a öy. b", "a öy. b"),
    ],
)
def test_counts_and_sides(apply, text, expected):
    assert apply(cleaners.drop_translation_notes, [text]) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a obv. b", "a b"), ("a ᵒbv b", "a b"), ("a u. e. b", "a b"), ("a le.e. b", "a b"), ("a ri . e b", "a b"), ("a rev b", "a b"), ("a rᵉv. b", "a b"), ("a l.e-b", "a l.e-b"), ("a xobv b", "a xobv b"), ("a ]rev b", "a ]rev b"), ("review", "review"),
    ],
)
def test_edges(apply, text, expected):
    assert apply(lambda c: cleaners.drop_transliteration_notes(c, False), [text]) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("the end weitgehend.", "the end"), ("the end 3 Zz. Spuren, dann ganz", "the end"), ("the end Spuren dann", "the end"), ("the end Rs. mit geringen Resten.", "the end"), ("the end l. s. ohne zusammenhaengenden Kontext", "the end"),
        ("the end l. s. ohne zusammenhängenden Kontext", "the end"), ("the end 3-4 nur geringe Reste.", "the end"), ("the end bis auf Spuren der l. s.", "the end"), ("the end Reste von und l. s.", "the end"), ("the end und l. s.", "the end"),
        ("Spuren at the start", "Spuren at the start"), ("Spuren", "Spuren"), ("a Spuren Spuren", "a Spuren"), ("a Spuren weitgehend", "a"), ("a weitgehend Spuren", "a weitgehend"),
    ],
)
def test_terminal_notes(apply, text, expected):
    assert apply(cleaners.drop_terminal_notes, [text]) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1-3 a", "a"), ("(1-3) a", "a"), ("( 1 – 3 ) a", "a"), ("1-3) a", "a"), ("(1-3 a", "a"), ("1-3, 5-7 a", "a"), ("1-3、5-7，8-9 a", "a"), ("1-3, 5 a", ", 5 a"), ("5) a", "a"), ("(5) a", "a"), ("5 a", "5 a"), ("5, 6) a", "5, a"),
        ("4'-5' a", "a"), ("4 ’ - 5′ a", "a"), ("¹⁻⁴Foo", "Foo"), ("a12-13b", "a b"), ("1-2-3 a", "-3 a"), ("1-2)3 a", ")3 a"), ("5)3 a", "3 a"), ("7(1-2) a", "7( a"), ("7(8) a", "7( a"), ("12 1-3) )", ""), ("", ""), ("no digits (a)", "no digits (a)"), ("4'5-6", "4'"),
    ],
)
def test_line_markers(apply, text, expected):
    assert apply(cleaners.drop_line_markers, [text]) == [expected]


def test_long_texts_of_markers_stay_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert cleaners.without_line_markers("1-3) word 5 " * n).count("word") == n
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 10 * seconds(10_000)


@pytest.mark.parametrize(
    "text, summary",
    [
        ("bu bir mektuptur", True), ("X tarafından Y", True), ("Maktubun  sahibi", True), ("An unopened thing", True), ("unopened envelope of", True), ("a damaged tablet", True), ("the damaged tablet", False), ("unopened letter", False), ("tarafındandı", False), ("", False),
    ],
)
def test_summaries(apply, text, summary):
    assert apply(cleaners.has_summary, [text]) == [summary]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("mektuptur um-ma A", "um-ma A"), ("mektuptur Şöyle (söyler) : A", "Şöyle (söyler) : A"), ("mektuptur Buzutaya’ya söyle! A", "Buzutaya’ya söyle! A"), ("mektuptur\n\nA b", "A b"), ("A b\n\nC", "A b C"), ("öy. 12\n1-3) A", "1-3) A"), ("mektuptur A", "mektuptur A"),
    ],
)
def test_leading_summaries(apply, text, expected):
    assert apply(cleaners.drop_leading_summary, [text]) == [expected]
