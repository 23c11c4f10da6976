"""Identifiers: keys, volumes, excavation numbers and their variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, normalize_ws


def filter_key(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(normalize_ws(c), r"\s+", ""))


def alnum_key(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^A-Za-z0-9]+", ""))


def volume_key(c: str | Column) -> Column:
    """AKT and ICK volumes in texts or paths, as "AKT 6A"; else the text with its white space normalised, in capitals."""
    flat = F.upper(F.regexp_replace(normalize_ws(c), r"^.*/|\.[A-Za-z]+$", ""))
    name = F.regexp_extract(flat, r"\b(AKT|ICK)[ _-]*([0-9]+)[ _-]*([A-E]?)(?![A-Z0-9])", 1)
    number = F.regexp_extract(flat, r"\b(AKT|ICK)[ _-]*([0-9]+)[ _-]*([A-E]?)(?![A-Z0-9])", 2)
    letter = F.regexp_extract(flat, r"\b(AKT|ICK)[ _-]*([0-9]+)[ _-]*([A-E]?)(?![A-Z0-9])", 3)
    return F.when(name != "", F.concat(name, F.lit(" "), F.regexp_replace(number, "^0+(?=[0-9])", ""), letter)).otherwise(flat)


_NUMBER = r"(?i)\bKt\.?\s*([a-z]{1,2})\s*/\s*([a-z]{1,2})\s*([0-9]+[a-z]?)"


def excavation_number(c: str | Column) -> Column:
    """ "Kt. n/k 1234" from free text; with a plus both parts, which must agree in prefix and series; "" if none."""
    flat = normalize_ws(c)
    part = lambda n: F.lower(F.regexp_extract(flat, _NUMBER, n))
    single = F.concat(F.lit("Kt. "), part(1), F.lit("/"), part(2), F.lit(" "), part(3))
    pair = _NUMBER + r"\s*\+\s*(?:Kt\.?\s*)?(?:([a-z]{1,2})\s*/\s*([a-z]{1,2})\s*)?([0-9]+[a-z]?)"
    more = lambda n: F.lower(F.regexp_extract(flat, pair, n))
    agrees = ((more(4) == "") | (more(4) == part(1))) & ((more(5) == "") | (more(5) == part(2)))
    return F.when(part(3) == "", "").when((more(6) != "") & agrees, F.concat(single, F.lit("+"), more(6))).otherwise(single)


#: A heading's number, with the letter it may have.
_HEADING = r"^(?:No\.?\s*)?([0-9]+\s*[A-Za-z]?)\.?$"
_NUMBERED = r"^([0-9]+)\s*[.)]\s*(.+)$"


def numbered_heading(c: str | Column) -> Column:
    """ "12 a" from a heading that is a number; "" else."""
    return F.lower(normalize_ws(F.regexp_extract(normalize_ws(c), _HEADING, 1)))


def labelled_heading(c: str | Column) -> Column:
    """ "5. NBC 3787" from a number with a label, spaces around commas put right and letters joined to their numbers; else the text."""
    flat = normalize_ws(c)
    label = F.regexp_replace(F.regexp_replace(F.regexp_extract(flat, _NUMBERED, 2), r"\s*,\s*", ", "), r"\b([A-Za-z])\s+(?=[0-9])", "$1")
    number = F.regexp_replace(F.regexp_extract(flat, _NUMBERED, 1), "^0+(?=[0-9])", "")
    return F.when(flat.rlike(_NUMBERED), F.concat(number, F.lit(". "), normalize_ws(label))).otherwise(flat)


def museum_heading(c: str | Column) -> Column:
    """ "I 427" from a heading that begins with the sign I and a number, in brackets or not; "" else."""
    flat = normalize_ws(c)
    number = F.regexp_extract(flat, r"^\(?\s*[Ii]\s*([0-9]+[a-z]?)\s*\)?", 1)
    return F.when(number != "", F.concat(F.lit("I "), number)).when(F.upper(flat).startswith("I "), flat).otherwise("")


def canonical_for_volume(volume: str | Column, c: str | Column) -> Column:
    """The form in which a volume names its texts; an excavation number where its own form does not fit."""
    key = F.upper(normalize_ws(volume))
    own = F.when(key == "AKT 1", numbered_heading(c)).when(key.startswith("LARSEN"), labelled_heading(c)).when(key.rlike(r"\bICK 4\b"), museum_heading(c))
    return F.coalesce(F.nullif(own, F.lit("")), excavation_number(c))


def with_overrides(value: str | Column, cols: list[str], overrides: dict[str, str]) -> Column:
    """The target of the first override whose text stands in one of the columns, whatever its case, else the value."""
    searched = F.lower(F.concat_ws(" | ", *[normalize_ws(x) for x in cols]))
    out = None
    for text, target in overrides.items():
        hit = F.contains(searched, F.lit(text.lower()))
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return normalize_ws(value) if out is None else out.otherwise(normalize_ws(value))


def first_match(pattern: str, *cols: str) -> Column:
    """The first match of a pattern over columns."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 0), F.lit("")) for c in cols])


def all_volumes(*cols: str, pattern: str = r"(?i)\bAKT\s*[0-9]+[A-E]?\b") -> Column:
    """Distinct volumes over columns, joined by a bar, in order of place."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(pattern), F.lit(0)) for c in cols])
    return F.array_join(F.array_distinct(F.transform(found, lambda x: F.upper(normalize_ws(x)))), "|")


def expand_shorthand(c: str | Column) -> Column:
    """ "12a, b" and "12a/b" as 12a and 12b; else the text alone."""
    flat = normalize_ws(c)
    short = r"^(.*?[0-9]+)([a-z])\s*[,/]\s*([a-z])$"
    stem = F.regexp_extract(flat, short, 1)
    return F.when(stem != "", F.array(F.concat(stem, F.regexp_extract(flat, short, 2)), F.concat(stem, F.regexp_extract(flat, short, 3)))).otherwise(F.array(flat))


def alternate_keys(c: str | Column, variants: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The key, its listed variants (either way) and its forms with and without the point after Kt."""
    key = normalize_ws(c)
    forms = [key, F.regexp_replace(key, r"^Kt\.? ", "Kt. "), F.regexp_replace(key, r"^Kt\.? ", "Kt ")]
    extra = F.array().cast("array<string>")
    groups = [sorted({k, *v}) for k, v in (variants or {}).items()]
    for g in groups:
        extra = F.when(key.isin(*g), F.concat(extra, F.array(*map(F.lit, g)))).otherwise(extra)
    return F.array_distinct(F.concat(F.array(*forms), extra))
