"""Text primitives. Patterns are Java's; (?U) makes \\s, \\w and \\b follow Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
#: What makes a word: letters and numbers of any script (fractions and raised digits too) and the low line; a word's edges.
WORD = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any script at its ends; null stays null."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_ws(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends; null as "" ."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACES, " "))


def squeeze(c: str | Column) -> Column:
    """Runs of two or more white space characters as one space, none at the ends."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s{2,}", " "))


def words(c: str | Column) -> Column:
    return F.filter(F.split(normalize_ws(c), " "), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often and inside whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_each(c: str | Column, pattern: str, change, gate: str | None = None) -> Column:
    """The text with change(match) for each match; null stays null. gate: a literal that every match contains.

    A text is cut at its matches, each is changed, and the parts are put together again: one pass, whatever the number of
    different replacements.
    """

    def whole_text(t: Column) -> Column:
        may = t.rlike(pattern) if gate is None else F.contains(t, F.lit(gate)) & t.rlike(pattern)
        changed = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        rest = lambda p: F.zip_with(changed, F.slice(p, 2, 1 << 30), lambda token, part: F.concat(token, part))
        return F.when(may, bind(F.split(t, pattern, -1), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(rest(p), "")))).otherwise(t)

    return bind(_col(c), whole_text)


def look_up(table: dict[str, str], key: Column) -> Column:
    """The table's value for the key, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def drop_repeated_words(c: str | Column) -> Column:
    """Words without those equal to the word before; a blank text stays as it is."""

    def kept(t: Column) -> Column:
        return bind(words(t), lambda w: F.when(F.size(w) == 0, t).otherwise(F.array_join(F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1))), " ")))

    return bind(_col(c), kept)


def collapse_repeats(c: str | Column) -> Column:
    """A word and its repeats after white space as the word, by a back-reference."""
    return F.regexp_replace(_col(c), r"(?U)\b(\w+)(?:\s+\1\b)+", "$1")


def ellipsis_cut(c: str | Column, most: int) -> Column:
    """At most that many characters, the last one an ellipsis where it was cut; 0 or less: no limit."""
    c = _col(c)
    if most <= 0:
        return c
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)\s+$", ""), F.lit("…")))


def cut_words(c: str | Column, most: Column | int) -> Column:
    """Whole words up to that many characters; the first word in any case, unless the limit is 0 or less."""
    limit = F.lit(most) if isinstance(most, int) else most
    flat = normalize_ws(c)
    state = F.aggregate(
        words(c),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("done")),
        lambda s, w: F.when(s["done"], s)
        .when((s["text"] != "") & (F.length(s["text"]) + 1 + F.length(w) > limit), F.struct(s["text"].alias("text"), F.lit(True).alias("done")))
        .otherwise(F.struct(F.when(s["text"] == "", w).otherwise(F.concat(s["text"], F.lit(" "), w)).alias("text"), F.lit(False).alias("done"))),
    )
    return F.when(limit <= 0, "").when(F.length(flat) <= limit, flat).otherwise(state["text"])


def cut_to_ratio(c: str | Column, reference: str | Column, ratio: float = 1.8, fallback: int = 16) -> Column:
    """As it stands if at most ratio times as long as the reference, else cut at a word; a blank reference allows 16 characters."""
    c, flat, other = _col(c), normalize_ws(c), normalize_ws(reference)
    limit = F.greatest(F.floor(F.length(other) * F.lit(ratio)).cast("int"), F.lit(1))
    return F.when(flat == "", c).when(other == "", cut_words(c, fallback)).when(F.length(flat) <= F.length(other) * F.lit(ratio), c).otherwise(cut_words(c, limit))


def was_cut(original: str | Column, cut: str | Column) -> Column:
    return F.length(normalize_ws(cut)) < F.length(normalize_ws(original))


def too_short(source: str | Column, output: str | Column, long_source: int = 80, short_output: int = 20, ratio: float = 0.25) -> Column:
    """A long source with a short or far shorter output; an empty output is not short."""
    a, b = F.length(normalize_ws(source)), F.length(normalize_ws(output))
    return (b > 0) & (a >= long_source) & ((b < short_output) | (b / a < ratio))


def char_length(c: str | Column) -> Column:
    return F.length(_col(c))


def char_ratio(a: str | Column, b: str | Column) -> Column:
    """Length of a by length of b; null if b is empty."""
    return F.length(_col(a)) / F.nullif(F.length(_col(b)), F.lit(0))


def byte_tokens(c: str | Column, end_mark: bool = False) -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes, and the end mark if asked for."""
    return F.octet_length(_col(c)) + (1 if end_mark else 0)


# Characters folded to an ASCII apostrophe, and to a double quote.
APOSTROPHES = "‘’ʼʹʻ′`´"
DOUBLE_QUOTES = "“”„‟«»″‚‛"


def fold_apostrophes(c: str | Column, chars: str = APOSTROPHES) -> Column:
    return F.translate(_col(c), chars, "'" * len(chars))


def fold_double_quotes(c: str | Column, chars: str = DOUBLE_QUOTES) -> Column:
    return F.translate(_col(c), chars, '"' * len(chars))


def drop_square_brackets(c: str | Column) -> Column:
    return F.translate(_col(c), "[]", "")


def space_slashes(c: str | Column) -> Column:
    """One space on both sides of a slash, none before punctuation."""
    spaced = F.regexp_replace(_col(c), r"(?U)\s*/\s*", " / ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"(?U)\s+([,.;:!?])", "$1"), SPACES, " "))


# Fraction characters.
FRACTION_GLYPHS = "¼½⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞¾⅒"


def space_fractions(c: str | Column) -> Column:
    return squeeze(F.regexp_replace(_col(c), f"([{FRACTION_GLYPHS}])", " $1 "))


def is_unavailable(c: str | Column) -> Column:
    return F.lower(normalize_ws(c)) == "unavailable"


def is_empty(c: str | Column) -> Column:
    return normalize_ws(c) == ""


def says_no_text(c: str | Column) -> Column:
    return F.contains(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("no text"))


def starts_with_any(c: str | Column, prefixes: tuple[str, ...]) -> Column:
    flat = F.lower(normalize_ws(c))
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(flat, F.lit(p.lower()))
    return out


def is_gap_only(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(r"(?U)^\s*(?:<gap>\s*)+$")


def from_marker(c: str | Column, marker: str) -> Column:
    """The text from the first place of the marker on, with a straight or a curly apostrophe; else the whole."""
    c = _col(c)
    variants = list(dict.fromkeys([marker, marker.replace("'", "’"), marker.replace("’", "'")]))
    out = None
    for v in variants:
        at = F.locate(v, c)
        hit = F.when(at > 0, F.substr(c, at))
        out = hit if out is None else F.coalesce(out, hit)
    return F.coalesce(out, c)


def pick_alternative(c: str | Column, second: bool = False) -> Column:
    """One side of "left / right"; a number over 12 stays."""
    return F.regexp_replace(_col(c), r"(?![0-9]+\s*/\s*12(?![^\s/]))([^\s/]+)\s*/\s*([^\s/]+)", "$2" if second else "$1")


def drop_line_numbers(c: str | Column) -> Column:
    """Without standalone line numbers: multiples of five from 5 on, with a point."""
    return normalize_ws(F.regexp_replace(_col(c), r"(?<!\S)(?!0+\.)[0-9]{0,2}[05]\.(?=\s|$)", ""))


def drop_section_signs(c: str | Column, signs: tuple[str, ...]) -> Column:
    """Without signs of a tablet's sections that stand alone, with a point and the number of a line or without; line breaks stay."""
    names = "|".join(signs)
    out = F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"(?iU)(?<!\S)(?:{names})\.?(?:\s*[0-9]{{1,3}})?(?=\s|$)", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"(?U)\s*\n\s*", "\n"))


def from_markers(key: str | Column, c: str | Column, markers: dict[str, tuple[str, ...]]) -> Column:
    """The text from the first of its record's markers on, in their order; records without markers, and texts without one, as they are."""
    c = F.coalesce(_col(c), F.lit(""))
    out = None
    for record, own in markers.items():
        cut = None
        for m in own:
            found = F.nullif(from_marker(c, m), c)
            found = F.when(F.startswith(c, F.lit(m)), c).otherwise(found)
            cut = found if cut is None else F.coalesce(cut, found)
        hit = strip(F.coalesce(cut, c))
        out = F.when(_col(key) == record, hit) if out is None else out.when(_col(key) == record, hit)
    return c if out is None else out.otherwise(c)


def final_answer(c: str | Column) -> Column:
    """What follows the first closing thought tag, without code fences."""
    c = F.coalesce(_col(c), F.lit(""))
    after = F.when(F.contains(c, F.lit("</think>")), F.substr(c, F.locate("</think>", c) + 8)).otherwise(c)
    return strip(F.regexp_replace(strip(after), r"^```[A-Za-z0-9_-]*\s*|\s*```$", ""))
