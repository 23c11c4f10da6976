"""Training table, example pool, location tables, aligned documents, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.profiles import normalize
from corpusloom.functions.text import drop_repeated_words, ellipsis_cut, normalize_ws
from corpusloom.operators.dedup import first_wins
from corpusloom.operators.filters import first_non_blank, non_blank
from corpusloom.operators.joins import attach_unique, exclude_known, missing_targets, with_summary
from corpusloom.operators.unions import concat, minus, tagged
from corpusloom.operators.windows import quantile_bin, spread_folds
from corpusloom.session import materialize


def clean_and_split(docs: DataFrame, excluded: DataFrame, folds: int = 4, bins: int = 20) -> DataFrame:
    """Normalise, decontaminate, deduplicate and split: doc_id, lang, n_chars, n_bytes, bin, fold."""
    clean = docs.select("doc_id", "lang", drop_repeated_words(normalize_ws("text")).alias("text"))
    known = excluded.select(drop_repeated_words(normalize_ws("text")).alias("text"))
    unique = first_wins(exclude_known(clean, known, "text"), ["text"], ["doc_id"])
    # Binning reads its input more than once; texts stay behind.
    sized = materialize(unique.select("doc_id", "lang", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes")), "clean-sizes")
    return spread_folds(quantile_bin(sized, "n_chars", ["doc_id"], bins), "bin", "doc_id", folds)


def training_table(train: DataFrame, old: DataFrame, published: DataFrame, excluded: Sequence[str], swapped: Sequence[str], profile: str = "main", folds: int = 4) -> DataFrame:
    """id, source_text, target_text, fold from the current and the old version and the published texts.

    train: id, source_text, target_text, rid; old: the same; published: id, source_text, rid. Listed ids are dropped, or
    take the old target; published source texts replace those of their ids.
    """
    previous = old.select("id", F.col("target_text").alias("old_target"), "rid")
    joined = attach_unique(train, previous, "id", ["rid"])
    joined = joined.withColumn("target_text", F.when(F.col("id").isin(*swapped) & F.col("old_target").isNotNull(), F.col("old_target")).otherwise(F.col("target_text")))
    joined = attach_unique(joined.drop("old_target"), published.select("id", F.col("source_text").alias("published_text"), "rid"), "id", ["rid"])
    kept = joined.where(~F.col("id").isin(*excluded)) if excluded else joined
    # Texts are projected once, then measured.
    texts = kept.select("id", normalize(first_non_blank("published_text", "source_text"), profile, "transliteration").alias("source_text"), normalize("target_text", profile, "translation").alias("target_text"))
    sized = materialize(texts.withColumn("ratio", F.length("target_text") / F.nullif(F.length("source_text"), F.lit(0))), "training-texts")
    split = spread_folds(quantile_bin(sized, "ratio", ["id"], 20), "bin", "id", folds)
    return split.select("id", "source_text", "target_text", F.col("fold").cast("byte").alias("fold"))


def unlisted_texts(published: DataFrame, known: DataFrame, text: str, profile: str = "main") -> DataFrame:
    """Published texts whose id is not known, normalised and then unique by text (first id)."""
    rest = non_blank(exclude_known(published, known, "id"), text)
    return first_wins(rest.select("id", normalize(text, profile, "transliteration").alias(text)), [text], ["id"])


def example_pool(rows: DataFrame, cols: Sequence[str], order: str, most: int = 400, least: int = 20, skip_fold: int | None = None, unique: bool = True) -> DataFrame:
    """order, example: the first non-blank column, cut, long enough, and unique but for case."""
    kept = rows.where(F.col("fold") != skip_fold) if skip_fold is not None else rows
    texts = kept.select(order, ellipsis_cut(normalize_ws(first_non_blank(*cols)), most).alias("example")).where(F.length("example") >= least)
    key = F.lower(F.replace("example", F.lit("ß"), F.lit("ss")))
    return first_wins(texts, [key], [order]) if unique else texts


def location_tables(targets: DataFrame, detections: DataFrame) -> dict[str, DataFrame]:
    """targets: volume, key; detections: volume, key, pdf, page. Five tables: locations, summary, missing, scan_only, scan_summary."""
    on = ["volume", "key"]
    summary = detections.groupBy(*on).agg(
        F.count_distinct("page").alias("match_count"), F.array_join(F.sort_array(F.collect_set("pdf")), ", ").alias("pdfs"), F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ", ").alias("pages")
    )
    keyed = targets.select(*on).distinct()
    only = detections.join(keyed, on, "left_anti")
    joined = with_summary(keyed.withColumn("__id", F.concat_ws("|", *on)), summary.select(F.concat_ws("|", *on).alias("__id"), "match_count", "pdfs", "pages"), "__id", {"match_count": 0, "pdfs": "", "pages": ""}).drop("__id")
    return {
        "locations": detections.join(keyed, on, "left_semi").select(*on, "pdf", "page").distinct(),
        "summary": joined,
        "missing": missing_targets(keyed.withColumn("__id", F.concat_ws("|", *on)), detections.select(F.concat_ws("|", *on).alias("__id")), "__id").drop("__id"),
        "scan_only": only.select(*on, "pdf", "page").distinct(),
        "scan_summary": summary.join(keyed, on, "left_anti"),
    }


def plan_jobs(targets: DataFrame, known_missing: DataFrame, volumes: Sequence[str] | None = None) -> DataFrame:
    """volume, keys: the targets to look for in each volume, listed volumes only, known missing ones left out."""
    kept = targets.where(F.col("volume").isin(*volumes)) if volumes else targets
    rest = minus(kept, known_missing, ["volume", "key"])
    return rest.groupBy("volume").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def merged_sources(pseudo: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Pseudo-labelled and synthetic pairs in one layout with their origin; rows without both texts are dropped."""
    layout = lambda df: {c: c if c in df.columns else None for c in ("oare_id", "synthetic_id", "translation", "transliteration", "fold")}
    needed = ("translation", "transliteration")
    both = concat(tagged(pseudo, "pseudo", layout(pseudo), needed), tagged(synthetic, "synthetic", layout(synthetic), needed))
    return both.withColumn("fold", F.coalesce("fold", F.lit("1")))


def assembled_records(rows: DataFrame, results: DataFrame, key: str, pages: str, cached: Column) -> DataFrame:
    """Source rows with their results, the pages as text and whether the result was cached."""
    joined = rows.join(results, key, "left")
    return joined.withColumn(pages, F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")).withColumn("cached", F.coalesce(cached, F.lit(False)))


def aligned_pairs(records: DataFrame, key: str, lines: str, translations: str) -> DataFrame:
    """One row per translated range of a record: key, line_range, source_text (lines inside it, in order), target_text.

    lines and translations: JSON objects from line numbers or ranges to texts. Lines and ranges are unnested and meet by
    interval inside their record.
    """
    from corpusloom.functions.arrays import ordered_entries
    from corpusloom.operators.joins import collect_ranges

    texts = records.select(key, F.explode(ordered_entries(lines)).alias("e")).select(key, F.col("e.start").alias("line"), F.col("e.value").alias("source_text"))
    spans = records.select(key, F.explode(ordered_entries(translations)).alias("e")).select(key, F.col("e.start").alias("low"), F.col("e.end").alias("high"), F.col("e.key").alias("line_range"), F.col("e.value").alias("target_text"))
    joined = collect_ranges(spans.select(key, "low", "high"), texts, [key], "low", "high", "line", "source_text")
    return spans.join(joined, [key, "low", "high"], "left").select(key, "line_range", F.coalesce("source_text", F.lit("")).alias("source_text"), "target_text")


def post_processed(pairs: DataFrame, source: str, target: str, low: float = 0.3, high: float = 4.0) -> DataFrame:
    """Normalised pairs with both sides, no placeholder, and a plausible ratio of lengths; fold -1."""
    from corpusloom.operators.filters import ratio_between, without_placeholders

    texts = pairs.withColumns({source: normalize(source, "pipeline", "transliteration"), target: normalize(target, "pipeline", "translation")})
    return ratio_between(without_placeholders(non_blank(texts, source, target), target), source, target, low, high).withColumn("fold", F.lit(-1))
