"""Cleaners of extracted texts: line markers, editorial notes, tags, superscripts, leading summaries, volume rules.

Line markers (1-3, 4'-5', 6) are read by a small parser. Notes are tables of plain phrases; `phrase` says which spellings of
one a pattern allows, and the cleaners differ only in their tables and in where a note may stand.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import gaps, numbers, profiles
from corpusloom.functions.text import SPACES, _col, bind, drop_square_brackets, normalize_ws, space_fractions, strip

# Superscript and subscript digits, minus signs, prime marks, commas.
SUPERSCRIPT_DIGITS, SUBSCRIPT_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
MINUS, PRIMES, COMMAS = "-‐‑‒–—⁻", "'’′", ",、，"

# Editorial notes in translations.
TRANSLATION_NOTES = (
    "rest vs. - anfang rs. abgebr.", "rest vs. abgebr.", "rest rs. abgebr.", "vs. anfang abgebr.", "vs.", "ras.", "anfang", "abgebr.",
    "rest für eine übersetzung zu fragmentarisch", "rest bis auf geringe spuren", "übersetzung unmöglich", "unklares textfragment; übersetzung lohnt nicht",
    "unklares fragment; übersetzung nicht lohnend", "kleinstfragment; übersetzung lohnt nicht", "brieffragment; übersetzung lohnt nicht", "übersetzung lohnt nicht",
    "übersetzung nicht lohnend", "fast völlig", "bis auf geringe spuren der l. s.", "bis auf geringe spuren", "bis auf spuren", "spuren der l. s.", "spuren", "reste von und l. s.", "reste von",
    "l. s. ohne zusammenhängenden kontext", "radiert oder", "radiert", "eine übersetzung erübrigt sich", "rs. und o. k.", "rs. fast völlig", "mehrere zz.", "fortsetzungstafel nötig",
)
# Notes with a count before them: the note, whether "ca." may stand first, whether a range must.
COUNTED_NOTES = (("nur geringe reste", False, True), ("zz.", True, False), ("z.", True, False))
# Signs of the sides of a tablet, in this case only, points and spaces between their letters; one without a point; a line.
SIDE_SIGNS, BARE_SIDE, LINE_SIGN = ("Öy.", "Ay."), "Ay", "K. 10."
# Editorial notes in transliterations.
TRANSLITERATION_NOTES = (
    "a envelope", "upside down blank space", "upside down", "rest invisible", "invisible", "rest vs. - anfang rs. abgebr.", "rest vs. abgebr.", "rest rs. abgebr.", "vs. anfang abgebr.", "rest", "rs.", "u. k.",
    "ganze z. radiert", "ganze z.", "radiert oder", "radiert", "bis auf spuren", "geringe spuren", "nur minimale spuren", "spuren", "einer", "zeilen", "zeile", "vs.", "ras.", "anfang", "abgebr.", "fortsetzungstafel nötig", "unbeschr.",
    "silindir mühür baskısı", "silindir mühür tamamı kirik", "silindir mühür", "seal impression", "seal a", "seal b", "seal c",
)
DOCUMENT_NOTES = (
    "remainder missing", "no photo", "not identified", "uninscribed", "blank space", "lacuna of a few lines", "lower part", "upper part", "broken line or", "broken line", "lower left edge broken off", "left edge broken off",
    "end of not inscribed", "part of the inscription is visible", "großenteils", "beschädigt", "eine ganz", "a possible candidate is", "but none of the witnesses bear this name",
    "on the left edge", "on the lower edge", "on the upper edge", "on left edge", "on lower edge", "on upper edge", "seals", "seal", "stamp seal", "impressions of a ring", "impression of a ring", "anatolian", "awl.", "b tablet", "c tablet",
    "tablet", "case", "procession of deities", "hunt", "arka yüz kırık", "alt kenar kırık", "alt kenarı kırık", "alt kenara kadar kırık", "üst kenar kırık", "üst kenarı kırık", "üst kenara kadar kırık", "damga mühür", "silik", "işaretler dökülmüş", "destroyed",
)
# Beginnings of translations that are descriptions, and volumes whose transliterations are cleaned in full.
EXCLUDED_PREFIXES = (
    "Fragmentary envelope", "Error", "Envelope with seal", "Fragment of envelope", "Unklares Fragment", "Kleinstfragment", "Brieffragment", "hellbraunes Tafelbruchstück", "Übersetzung lohnt nicht", "Übersetzung nicht lohnend",
)
FULL_VOLUMES = ("7B", "11B", "12")
# The volume whose translations say "Rest" for a remainder, and that word.
REST_VOLUME = "HECKER KRYSZAT MATOUS - KAPPADOKISCHE KEILSCHRIFTTAFELN AUS DEN SAMMLUNGEN DER KARLSUNIVERSITAT PRAG. ICK 4 1998"
REST_NOTE = "rest"
# Marks without meaning in transliterations; characters folded to an apostrophe and to a double quote.
SOURCE_MARKS = "\"“”`«»「」⸢⸣⌜⌝˚ˈ˳˒ʻˀˁ˫˪˺˹^ˆᵢ⁠ʿ"
APOSTROPHES, DOUBLE_QUOTES = "‘’ʿʻˁ", "‚‛„“”«»‹›"
# The edges of a tablet, a point between the parts of a name; any letter may be raised.
EDGES = ("obv", "u e", "l e", "le e", "ri e", "rev")
# Notes that count at the end of a translation only, in the order in which they go; {n} is a count of lines or nothing, {span} a range.
TERMINAL_NOTES = (
    ("weitgehend",), ("{n} spuren, dann ganz", "{n} spuren, dann"), ("rs. mit geringen resten",), ("l. s. ohne zusammenhängenden kontext",), ("{span} nur geringe reste",),
    ("bis auf geringe spuren der l. s.", "bis auf spuren der l. s.", "bis auf geringe spuren", "bis auf spuren"), ("reste von und l. s.", "reste von"), ("spuren der l. s.", "spuren"), ("und l. s.", "l. s."),
)
# Words of a summary, beginnings of a description, signs that a text proper begins, sections of a tablet.
SUMMARY_WORDS = ("mektuptur", "yazdığı", "tarafından", "maktubun sahibi", "yayınlanmış", "belgesidir")
DESCRIPTION_WORDS = ("unopened", "damaged", "fragmentary")
START_PHRASES = ("şöyle (söyler):", "buzutaya'ya söyle", "um-ma")
SECTION_SIGNS = ("öy", "oy", "ak", "ay")

#: Other spellings of a character of a phrase.
_SPELLINGS = {"ü": "(?:ü|ue|u)", "ö": "(?:ö|oe|o)", "ä": "(?:ä|ae|a)", "ß": "(?:ß|ss)", "ı": "[ıi]", "ş": "[şs]", ".": r"\.?", ",": ",?"}
_DASH = "[–—-]"


def phrase(text: str) -> str:
    """A pattern for a phrase: any white space between words, points and commas or none, umlauts written out or dropped; a lone dash or none."""
    out, words = "", text.split()
    for before, word in zip([None, *words], words, strict=False):
        if word == "-":
            out += rf"\s*{_DASH}?"
        else:
            gap = "" if before is None else r"\s*" if before == "-" else r"\s+"
            out += gap + "".join(_SPELLINGS.get(ch, re.escape(ch)) for ch in word)
    return out


def counted(note: str, about: bool, span: bool) -> str:
    """A pattern for a phrase after a number or a range of numbers, "ca." before it if about; span: only after a range."""
    number = "" if not about else rf"(?:{phrase('ca.')}\s*)?"
    first, rest = r"[0-9]+" + ("" if about else r"""\s*["”]?"""), rf"\s*{_DASH}\s*[0-9]+"
    return number + first + (rest if span else f"(?:{rest})?") + r"\s*" + phrase(note)


def note_pattern(phrases: Iterable[str], first: Iterable[str] = ()) -> str:
    """Any of the phrases, the longest first, with a pair of parentheses or one of them; patterns of `first` before all.

    Phrases are grouped by their first letter, so that at most places of a text one comparison tells that none begins there.
    """
    groups: dict[str, list[str]] = {}
    for p in sorted(phrases, key=len, reverse=True):
        edge = r"\b" if p[-1].isalpha() and " " not in p else r"\.?"
        head = _SPELLINGS.get(p[0], re.escape(p[0]))
        groups.setdefault(head, []).append(phrase(p)[len(head) :] + edge)
    any_of = "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in groups.items())
    letters = "".join(sorted({x for p in phrases for x in (p[0], p[0].upper(), *("uU" if p[0] == "ü" else ""))}))
    return "(?iu)(?:" + "|".join([*first, rf"\(?\s*(?=[{letters}])(?:{any_of})\s*\)?"]) + ")"


def _sides() -> list[str]:
    letters = [rf"{sign[0]}\s*\.?\s*{sign[1:].replace('.', '[.]')}" for sign in SIDE_SIGNS]
    return [f"(?-i:{x})" for x in letters] + [rf"(?-i:(?<![(])\b{BARE_SIDE}\b(?![)])\s*:?)", r"\b" + r"\s*".join(re.escape(x) for x in LINE_SIGN.split())]


def _edges() -> str:
    """Names of edges where no letter, digit or sign of a word joins them."""
    raised = _script_table("sup")
    part = lambda word: "".join(f"[{ch}{raised.get(ch, '')}]" for ch in word)
    names = "|".join(r"\s*\.\s*".join(part(word) for word in name.split()) for name in EDGES)
    return rf"(?<![A-Za-z0-9\]])(?:{names})\s*\.?(?![A-Za-z0-9-])"


def _tidy(c: Column) -> Column:
    return normalize_ws(F.regexp_replace(c, r"(?U)\s+([,.;:!?])", "$1"))


_DIGITS = frozenset("0123456789" + SUPERSCRIPT_DIGITS)
_MAY_BEGIN = re.compile(f"[(0-9{SUPERSCRIPT_DIGITS}]")


def _after(text: str, at: int, among: Iterable[str] | None = None) -> int:
    """The first place from `at` on that is no white space, or none of the characters."""
    while at < len(text) and (text[at].isspace() if among is None else text[at] in among):
        at += 1
    return at


def _number(text: str, at: int) -> int:
    """The end of a number at this place, with primes unless a digit follows them; the place itself if there is none."""
    end = _after(text, at, _DIGITS)
    if end == at:
        return at
    primes = _after(text, end)
    last = _after(text, primes, PRIMES)
    return last if last > primes and text[last : last + 1] not in _DIGITS else end


def _range(text: str, at: int) -> int:
    """The end of two numbers with a dash between, or the place itself."""
    dash = _after(text, _number(text, at))
    if _number(text, at) == at or text[dash : dash + 1] not in tuple(MINUS):
        return at
    second = _after(text, dash + 1)
    end = _number(text, second)
    return end if end > second else at


def _list_of_ranges(text: str, at: int) -> int:
    """The end of two ranges or more with commas between, or the place itself."""
    end, many = _range(text, at), False
    while end > at:
        comma = _after(text, end)
        more = _after(text, comma + 1)
        if text[comma : comma + 1] not in tuple(COMMAS) or _range(text, more) == more:
            break
        end, many = _range(text, more), True
    return end if many else at


def _each(text: str, end_of: Callable[[str, int], int], closed: bool) -> str:
    """The text with a space for each marker and the parentheses around it; closed: only for those before a closing one."""
    out, kept, at = [], 0, 0
    while found := _MAY_BEGIN.search(text, at):
        at = found.start()
        # An opening parenthesis right after a digit belongs to what stands before.
        first = _after(text, at + 1) if text[at] == "(" and text[at - 1 : at] not in _DIGITS else at
        end = end_of(text, first)
        close = _after(text, end)
        if end > first and text[close : close + 1] == ")" and (closed or text[close + 1 : close + 2] not in _DIGITS):
            end = close + 1
        elif closed:
            end = first
        if end > first:
            out += [text[kept:at], " "]
            kept = at = end
        else:
            at = max(_after(text, at, _DIGITS), at + 1)
    return "".join([*out, text[kept:]])


def without_line_markers(text: str) -> str:
    """Lists of ranges, then ranges, then numbers before a closing parenthesis, each as a space."""
    for end_of, closed in ((_list_of_ranges, False), (_range, False), (lambda t, k: max(_range(t, k), _number(t, k)), True)):
        text = _each(text, end_of, closed)
    return text


def drop_line_markers(c: str | Column) -> Column:
    """Without range lists, ranges, numbers with a parenthesis and superscript ranges. Texts without a digit stay in the JVM."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: without_line_markers(t) if t else t)

    c = F.coalesce(_col(c), F.lit(""))
    numbered = c.rlike(f"[0-9{SUPERSCRIPT_DIGITS}]")
    return _tidy(F.when(numbered, run(F.when(numbered, c))).otherwise(c))


def drop_translation_notes(c: str | Column) -> Column:
    return _tidy(F.regexp_replace(_col(c), note_pattern(TRANSLATION_NOTES, _sides() + [rf"\(?\s*{counted(*n)}{'' if n[0].endswith('.') else '[.]?'}\s*\)?" for n in COUNTED_NOTES]), " "))


def drop_transliteration_notes(c: str | Column, document: bool = True) -> Column:
    """document: the longer list of the document-level profile as well."""
    out = F.regexp_replace(_col(c), note_pattern(TRANSLITERATION_NOTES, [_edges()]), " ")
    if document:
        out = F.regexp_replace(out, note_pattern(DOCUMENT_NOTES), " ")
    return _tidy(out)


def drop_terminal_notes(c: str | Column) -> Column:
    """Notes at the end of a translation, each after white space; one of a kind, the kinds in order."""
    lines = f"(?:(?:{counted('zz.', True, False)}|{counted('z.', True, False)})\\s*)?"
    out = F.coalesce(_col(c), F.lit(""))
    for kind in TERMINAL_NOTES:
        notes = [lines + phrase(n[4:]) if n.startswith("{n} ") else counted(n[7:], False, True) if n.startswith("{span} ") else phrase(n) for n in kind]
        out = F.regexp_replace(out, rf"(?iu)\s+(?:{'|'.join(notes)})[.]?\s*$", "")
    return _tidy(out)


def _script_table(kind: str) -> dict[str, str]:
    """Characters and their superscript or subscript forms, by the names of the forms."""
    out: dict[str, str] = {}
    names = {"sup": ("SUPERSCRIPT ", "MODIFIER LETTER SMALL "), "sub": ("SUBSCRIPT ", "LATIN SUBSCRIPT SMALL LETTER ")}[kind]
    digits = dict(zip(("ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "PLUS SIGN", "MINUS", "EQUALS SIGN", "LEFT PARENTHESIS", "RIGHT PARENTHESIS"), "0123456789+-=()", strict=True))
    for code in [*range(0xB2, 0xBA), *range(0x1D00, 0x1DC0), *range(0x2070, 0x20A0), *range(0x2B0, 0x300)]:
        name = unicodedata.name(chr(code), "")
        for prefix in names:
            if name.startswith(prefix):
                rest = name[len(prefix) :].removeprefix("LATIN SMALL LETTER ")
                base = digits.get(rest) or (rest.lower() if len(rest) == 1 else None)
                if base:
                    out.setdefault(base, chr(code))
    return out


def _scripts(text: str, tables: dict[str, dict[str, str]]) -> str:
    tag = re.compile(r"<\s*(sup|sub)\s*>((?:(?!<\s*(?:sup|sub)\s*>).)*?)<\s*/\s*\1\s*>", re.IGNORECASE | re.DOTALL)
    change = lambda m: "".join(tables[m[1].lower()].get(ch, tables[m[1].lower()].get(ch.lower(), ch)) for ch in m[2])
    before = None
    while before != text:  # inner tags first
        before, text = text, tag.sub(change, text)
    return re.sub(r"<\s*/?\s*(?:sup|sub)\s*>", "", text, flags=re.IGNORECASE)


def sup_sub_to_unicode(c: str | Column) -> Column:
    """<sup> and <sub> as superscript and subscript characters; others stay, lone tags go. Texts without tags stay in the JVM."""
    from pyspark.sql import types as T

    tables = {kind: _script_table(kind) for kind in ("sup", "sub")}

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _scripts(t, tables) if t else t)

    c = _col(c)
    tagged = c.rlike(r"(?i)<\s*/?\s*su[pb]")
    return F.when(tagged, run(F.when(tagged, c))).otherwise(c)


def superscript_letters() -> str:
    """Characters that are superscripts by their Unicode names."""
    found = (chr(code) for code in range(0xA0, min(sys.maxunicode, 0x20000)))
    return "".join(ch for ch in found if "SUPERSCRIPT" in (name := unicodedata.name(ch, "")) or name.startswith(("MODIFIER LETTER SMALL", "MODIFIER LETTER CAPITAL")))


def drop_superscripts(c: str | Column) -> Column:
    """Determinatives in braces, then no superscripts."""
    marked = F.regexp_replace(F.replace(_col(c), F.lit("ᵈ"), F.lit("{d}")), "ᵏ[ⁱᶦ]", "{ki}")
    return F.translate(marked, superscript_letters(), "")


def _one_pass(name: str, c: Column, flag: Column) -> Column:
    """A function of one_pass over whole texts. No iterators: all of one projection then share a worker and one copy of the texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, flags: pd.Series) -> pd.Series:
        from corpusloom.functions import one_pass

        clean = getattr(one_pass, name)
        return pd.Series([clean(t, f) for t, f in zip(texts, flags, strict=True)], dtype=object)

    return run(c, flag)


def cleaned_transliteration(c: str | Column, volume: str | Column) -> Column:
    """Marks and notes go; for listed volumes also tags, fractions, superscripts and brackets, and gaps are marked.

    In one pass of Python where the text is of Latin letters, in columns else.
    """
    c, key = F.coalesce(_col(c), F.lit("")), F.regexp_replace(F.upper(normalize_ws(volume)), r"^AKT ", "")
    full = key.isin(*FULL_VOLUMES, REST_VOLUME) | key.startswith("LARSEN")
    done = _one_pass("transliteration", c, full)
    return F.coalesce(done, transliteration_columns(F.when(done.isNull(), c), full))


def transliteration_columns(c: Column, listed: Column) -> Column:
    out = F.translate(F.coalesce(c, F.lit("")), APOSTROPHES[:2] + "‚‛" + "ʀ" + SOURCE_MARKS, "''" + "\0\0" + "r")
    light = drop_transliteration_notes(F.replace(out, F.lit("\0"), F.lit("")))
    full = numbers.glued_fractions(sup_sub_to_unicode(light))
    full = gaps.normalize_gaps(F.translate(drop_superscripts(full), "[]<>?/⁄*'", ""), dots=2)
    return F.when(listed, full).otherwise(light)


def drop_volume_notes(c: str | Column, volume: str | Column) -> Column:
    """Without the notes that only one volume's translations have."""
    note = rf"(?i)\(?\s*{REST_NOTE}\b\s*\)?"
    return _tidy(F.when(F.upper(normalize_ws(volume)) == REST_VOLUME, F.regexp_replace(_col(c), note, " ")).otherwise(_col(c)))


def pipeline_translation(c: str | Column) -> Column:
    """The pipeline's cleaner: line markers, notes, tags, brackets, fractions, the pipeline profile, notes again."""
    out = sup_sub_to_unicode(drop_translation_notes(drop_line_markers(c)))
    out = numbers.compact_fractions(drop_square_brackets(out))
    return drop_translation_notes(profiles.normalize(out, "pipeline", "translation"))


def cleaned_translation(c: str | Column, volume: str | Column | None = None) -> Column:
    """The document-level cleaner: quotes, line markers, notes, tags, brackets, gaps, fractions, the main profile, notes again.

    In one pass of Python where the text is of Latin letters and the volume has no notes of its own, in columns else.
    """
    c, own = F.coalesce(_col(c), F.lit("")), F.lit(False) if volume is None else F.upper(normalize_ws(volume)) == REST_VOLUME
    done = _one_pass("translation", c, own)
    return F.coalesce(done, translation_columns(_tidy(F.coalesce(_one_pass("unmarked", c, own), F.lit(""))), volume))


def fold_quotes(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), APOSTROPHES + DOUBLE_QUOTES + "˺˹˫˪", "'" * len(APOSTROPHES) + '"' * len(DOUBLE_QUOTES))


def translation_columns(out: Column, volume: str | Column | None = None) -> Column:
    """What follows quotes and line markers."""
    own_notes = lambda x: x if volume is None else drop_volume_notes(x, volume)
    out = sup_sub_to_unicode(own_notes(drop_translation_notes(out)))
    out = F.translate(drop_square_brackets(out), "ᵖˡʳᵘʼ", "")
    out = F.regexp_replace(out, r"(?<![A-Za-z])x+(?![A-Za-z])", gaps.GAP)
    out = numbers.glued_fractions(F.translate(out, SUPERSCRIPT_DIGITS + SUBSCRIPT_DIGITS, "0123456789" * 2))
    out = own_notes(drop_translation_notes(profiles.normalize(out, "main", "translation")))
    out = drop_terminal_notes(space_fractions(gaps.collapse_gaps(F.regexp_replace(out, r"\.{2,}|…+", " <gap> "))))
    out = F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("*"), F.lit("")), r"(?U)\s*[/⁄]\s*", " / "), SPACES, " ")
    return F.regexp_replace(F.trim(out), r"\s+([,.;:!?])", "$1")


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(r"\s+".join(re.escape(x) for x in w.split()) for w in words) + ")"


def _ahead(words: Iterable[str]) -> str:
    """A look-ahead for the words' first letters: word boundaries of any script cost more and are then rarely tried."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])"


def has_summary(c: str | Column) -> Column:
    """A word of a summary anywhere, or a description of an object at the beginning."""
    kinds = _any(DESCRIPTION_WORDS)
    described = rf"(?iU)^(?:an?\s+{kinds}\s+|{DESCRIPTION_WORDS[0]}\s+envelope)"
    return _col(c).rlike(rf"(?iU){_ahead(SUMMARY_WORDS)}\b{_any(SUMMARY_WORDS)}\b") | _col(c).rlike(described)


def _starts() -> str:
    """Signs that a text proper begins: white space or none before an opening parenthesis and a colon, either apostrophe or none."""
    out = []
    for p in START_PHRASES:
        body = re.escape(p).replace(r"\ ", r"\s*" if "(" in p else r"\s+").replace("'", "['’]?").replace(":", r"\s*:")
        out.append(body)
    return rf"(?iU){_ahead(START_PHRASES)}\b(?:" + "|".join(out) + ")"


def summary_only(c: str | Column) -> Column:
    """A summary cue and no line marker."""
    flat = normalize_ws(c)
    return has_summary(flat) & ~flat.rlike(r"\b[0-9]{1,3}(?:\s*['′]?\s*[-).]|['′])")


def drop_leading_summary(c: str | Column) -> Column:
    """From the first line range, after the first blank line, or from a start cue on, if what stands before is a summary."""
    ranged = r"(?<=^|\n)[ \t]*[0-9]{1,3}\s*-\s*[0-9]{1,3}\s*\)"
    blank, start = r"\n\s*\n", _starts()
    sectioned = lambda head: head.rlike(rf"(?iU)\b{_any(SECTION_SIGNS)}\.\s*[0-9]{{1,3}}\b")

    def body(raw: Column) -> Column:
        before = lambda pattern: F.regexp_extract(raw, f"(?su)^(.*?)(?:{pattern})", 1)
        after = lambda head: normalize_ws(F.substr(raw, F.length(head) + 1))
        head, first, lead = before(ranged), before(blank), before(start)
        return (
            F.when(raw.rlike(ranged) & (has_summary(head) | sectioned(head)), after(head))
            .when(raw.rlike(blank) & has_summary(normalize_ws(first)), after(first))
            # What makes a summary stands anywhere in it, so a text without any has none before a start cue.
            .when(has_summary(raw) & raw.rlike(start) & has_summary(lead), after(lead))
            .otherwise(normalize_ws(raw))
        )

    return bind(strip(F.coalesce(_col(c), F.lit(""))), body)
