"""Responses of a model into rows: candidates of a record, detections of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import first_json_object, flat_entries, json_has_text
from corpusloom.functions.ids import canonical_for_volume, expand_shorthand
from corpusloom.functions.text import final_answer, normalize_ws, strip


def candidate_rows(df: DataFrame, record: str, responses: str, field: str, fallback: str | Column = "") -> DataFrame:
    """record, idx, raw_text, parsed, valid, text: a row for each response (array), in order; none for an empty array.

    parsed: the first JSON object of what follows the thoughts. valid: it has the field as a string. text: the field, an
    object's values in the order of their line numbers, else the whole answer; blank gives the fallback.
    """
    rows = df.select(F.col(record).alias("record"), F.posexplode(responses).alias("idx", "raw_text"), (F.lit(fallback) if isinstance(fallback, str) else fallback).alias("__fallback"))
    answered = rows.withColumn("__answer", final_answer("raw_text")).withColumn("parsed", first_json_object("__answer"))
    valid = json_has_text("parsed", field)
    whole = F.get_json_object("parsed", f"$.{field}")
    value = F.when(valid, normalize_ws(whole)).when(whole.startswith("{"), flat_entries(whole)).otherwise(normalize_ws("__answer"))
    return answered.select("record", "idx", "raw_text", "parsed", valid.alias("valid"), F.coalesce(F.nullif(value, F.lit("")), F.col("__fallback")).alias("text"))


def detection_rows(pages: DataFrame, responses: str, field: str, volume: str, order: str = "page") -> DataFrame:
    """pages' columns but the responses, detected_text, canonical: the values of a JSON list, expanded, canonical, once a page.

    Values are taken in order; of those with one canonical form but for case the first stays; without a form they go.
    """
    values = F.from_json(F.get_json_object(first_json_object(final_answer(responses)), f"$.{field}"), "array<string>")
    kept = [c for c in pages.columns if c != responses]
    each = pages.select(*kept, F.posexplode(F.coalesce(values, F.array().cast("array<string>"))).alias("__at", "__value"))
    spelled = each.select(*kept, "__at", F.posexplode(expand_shorthand("__value")).alias("__part", "detected_text")).where(strip("detected_text") != "")
    named = spelled.withColumn("canonical", canonical_for_volume(volume, "detected_text")).where(F.col("canonical") != "")
    first = named.groupBy(*kept, F.lower("canonical").alias("__key")).agg(F.min_by(F.struct("detected_text", "canonical"), F.struct("__at", "__part")).alias("__d"), F.min(F.struct("__at", "__part")).alias("__place"))
    return first.select(*kept, F.col("__d.detected_text").alias("detected_text"), F.col("__d.canonical").alias("canonical"), "__place").orderBy(*[c for c in kept if c == order], "__place").drop("__place")


def by_votes(detections: DataFrame, keys: list[str], value: str, vote: str, least: int) -> DataFrame:
    """Keys and values that at least so many different votes (samples of a page) name."""
    return detections.groupBy(*keys, value).agg(F.count_distinct(vote).alias("votes")).where(F.col("votes") >= least)
