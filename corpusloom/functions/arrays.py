"""Arrays, maps and JSON: responses, page lists, coverage, neighbours."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import _col, normalize_ws, strip


def _first_object(text: str | None) -> str:
    decoder = json.JSONDecoder()
    text = text or ""
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return "{}"


@F.pandas_udf(T.StringType())
def _first_object_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_first_object)


def first_json_object(c: str | Column) -> Column:
    """The first JSON object in a text, as JSON; {} if there is none. Whole-text objects never leave the JVM."""
    c = _col(c)
    whole = F.when(strip(c).startswith("{") & F.from_json(c, "map<string,string>").isNotNull() & F.get_json_object(c, "$").isNotNull(), F.get_json_object(c, "$"))
    return F.when(whole.isNotNull(), whole).when(F.contains(F.coalesce(c, F.lit("")), F.lit("{")), _first_object_udf(c)).otherwise("{}")


def json_text(c: str | Column, field: str) -> Column:
    """A field of the JSON object if it is not blank, else the whole text."""
    c = _col(c)
    value = F.get_json_object(c, f"$.{field}")
    return F.when(strip(value) != "", value).otherwise(c)


def json_has_text(c: str | Column, field: str) -> Column:
    """Whether the field is there and is a string."""
    found = F.get_json_object(_col(c), f"$.{field}")
    quoted = F.get_json_object(_col(c), "$").rlike(rf'"{field}"\s*:\s*"')
    return F.coalesce(found.isNotNull() & quoted, F.lit(False))


def ordered_entries(c: str | Column) -> Column:
    """Entries (start, end, key, value) of a JSON object with line numbers or ranges as keys, in their order."""
    pattern = r"^\s*([0-9]+)(?:\s*-\s*([0-9]+))?\s*$"
    late = F.lit(999_999).cast("long")

    def entry(e: Column) -> Column:
        a, b = F.regexp_extract(e["key"], pattern, 1).try_cast("long"), F.regexp_extract(e["key"], pattern, 2).try_cast("long")
        return F.struct(F.coalesce(a, late).alias("start"), F.coalesce(b, a, late).alias("end"), e["key"].alias("key"), normalize_ws(e["value"]).alias("value"))

    return F.array_sort(F.transform(F.map_entries(F.coalesce(F.from_json(_col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))), entry))


def flat_entries(c: str | Column) -> Column:
    return F.array_join(F.filter(F.transform(ordered_entries(c), lambda e: e["value"]), lambda v: v != ""), " ")


def page_list(c: str | Column) -> Column:
    """Numbers and ranges, either way round, between ; , or |, once each in order of place; none if a token is bad."""
    tokens = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"[;,|]"), lambda t: F.trim(t)), lambda t: t != "")
    good = r"^[0-9]+(?:\s*-\s*[0-9]+)?$"

    def expand(t: Column) -> Column:
        a = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(t, r"-\s*([0-9]+)$", 1).try_cast("int"), a)
        return F.sequence(F.least(a, b), F.greatest(a, b))

    none = F.array().cast("array<int>")
    sound = F.filter(tokens, lambda t: t.rlike(good))
    return F.when(F.size(tokens) != F.size(sound), none).otherwise(F.array_distinct(F.flatten(F.transform(sound, expand))))


def coverage_flags(lines: str | Column, ranges: str | Column) -> Column:
    """Flags for lists of [start, end] pairs: a side missing, or lines that no range covers; joined by a bar."""
    lines, ranges = _col(lines), _col(ranges)
    whole = lambda a: F.flatten(F.transform(a, lambda r: F.sequence(F.get(r, F.lit(0)), F.get(r, F.lit(1)))))
    open_lines = F.array_sort(F.array_except(whole(lines), whole(ranges)))
    listed = F.concat(F.lit("missing_translation_range:"), F.array_join(F.transform(open_lines, lambda x: x.cast("string")), ","))
    return F.concat_ws(
        "|",
        F.when(F.size(lines) == 0, "missing_transliteration"),
        F.when(F.size(ranges) == 0, "missing_translation"),
        F.when((F.size(lines) > 0) & (F.size(ranges) > 0) & (F.size(open_lines) > 0), listed),
    )


def neighbour_pages(page: str | Column, pages: str | Column, after: int = 1) -> Column:
    """The page and the next ones that exist."""
    page, pages = _col(page), _col(pages)
    return F.filter(F.sequence(page, page + after), lambda x: F.array_contains(pages, x))
