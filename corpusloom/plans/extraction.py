"""Extracted texts: targets and jobs, staged cleaning, records, and the document pipeline from pages to pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import ExtractionSettings
from corpusloom.functions import cleaners, profiles, prompts, text
from corpusloom.functions.arrays import coverage_flags, ordered_entries
from corpusloom.functions.ids import canonical_for_volume, volume_key
from corpusloom.operators import candidates, consensus, filters, joins, windows
from corpusloom.plans.corpus import aligned_pairs, post_processed
from corpusloom.session import materialize
from corpusloom.streaming import rounds

# Records that are left out, and where the translations of some records begin.
EXCLUDED_RECORDS = (
    "Kt. 86/k 226", "Kt. 86/k 194", "Kt. 86/k 53", "Kt. 86/k 46", "Kt. 86/k 42", "Kt. 86/k 41", "Kt. 86/k 36", "Kt. 86/k 35", "Kt. 94/k 1650", "Kt. 94/k 1280", "Kt. 94/k 608", "Kt. n/k 608",
    "Kt. 92/k 141", "Kt. 91/k 378", "Kt. 91/k 380", "Kt. 91/k 405",
)
START_MARKERS = {
    "Kt. n/k 610": ("Uşur-ša-Īstar, Šū-Laban ve",), "Kt. 88/k 223": ("Abba'nın mühürü,",), "Kt. 88/k 733": ("Nishatum-vergisi ilâve",), "Kt. 88/k 26": ("Aššur-danni’nin bana",),
    "Kt. 88/k 66": ("Sermayedar, Aššur-bni",), "Kt. 88/k 227": ("Puzur-Aššur’un mührü",), "Kt. c/k 1063": ("<gap> mina gümüşü",),
}


def targets(rows: DataFrame, volume: str, number: str, order: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), nonexistent: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows with row_index, volume_key and canonical, those of the wanted volumes; and the unique targets among them.

    Without include all volumes are wanted. A target is a volume and a canonical number that is not blank and not known to be
    nowhere; it has the first row's own spellings.
    """
    keyed = windows.row_index(rows, order, "row_index").withColumn("volume_key", volume_key(volume))
    keyed = keyed.withColumn("canonical", canonical_for_volume("volume_key", number))
    normal = lambda names: [F.lit(n) for n in names]
    wanted = keyed
    if include:
        wanted = wanted.where(F.array_contains(F.transform(F.array(*normal(include)), volume_key), F.col("volume_key")))
    if exclude:
        wanted = wanted.where(~F.array_contains(F.transform(F.array(*normal(exclude)), volume_key), F.col("volume_key")))
    wanted = materialize(wanted, "targets")
    named = wanted.where((F.col("canonical") != "") & ~F.col("canonical").isin(*nonexistent)) if nonexistent else wanted.where(F.col("canonical") != "")
    unique = named.groupBy("volume_key", "canonical").agg(*[F.min_by(c, "row_index").alias(c) for c in (volume, number)])
    return wanted, unique.select(volume, "volume_key", number, "canonical")


def jobs(wanted: DataFrame, unique: DataFrame, files: DataFrame, volume: str, only_files: Sequence[str] = (), include: Sequence[str] = ()) -> DataFrame:
    """volume_key, display, keys (to look for, sorted), path: a row for each volume to scan; files: key, path.

    Volumes are the included ones, else those of the rows and the ones that only have files.
    """
    shown = wanted.groupBy("volume_key").agg(F.min(volume).alias("display"))
    extra = list(include) or list(only_files)
    spark = wanted.sparkSession
    more = spark.createDataFrame([(n,) for n in extra], "name string").select(volume_key("name").alias("volume_key")).distinct()
    keys = more if include else shown.select("volume_key").unionByName(more).distinct()
    listed = unique.groupBy("volume_key").agg(F.sort_array(F.collect_set("canonical")).alias("keys"))
    out = keys.join(shown, "volume_key", "left").join(listed, "volume_key", "left").join(files.select(F.col("key").alias("volume_key"), "path"), "volume_key", "left")
    return out.select("volume_key", F.coalesce("display", "volume_key").alias("display"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "path")


@dataclass(frozen=True)
class Cleaning:
    """kept: the rows that stay, cleaned; rejected: the others, with the reason; counts: one row of counters."""

    kept: DataFrame
    rejected: DataFrame
    counts: DataFrame


def cleaned_extracts(rows: DataFrame, record: str, translation: str, transliteration: str, volume: str | None = None, excluded: Sequence[str] = EXCLUDED_RECORDS, markers: dict[str, tuple[str, ...]] | None = None, document: bool = True) -> Cleaning:
    """Extracted pairs cleaned, with the texts before it in <column>_orig, and left out in this order:

    a listed record; a translation that is empty, before or after; one that begins like a description; a transliteration that
    is unavailable, says it has no text, or is nothing but gaps. Every row counts in one of these at most. Line ranges are
    counted in all rows but listed ones, changes of translations in those that the translation does not leave out. document: the document-level cleaners, else the pipeline's.
    """
    volume_of = F.col(volume) if volume else F.lit("")
    raw, other = (F.coalesce(F.col(c), F.lit("")) for c in (translation, transliteration))
    begun = text.from_markers(record, raw, START_MARKERS if markers is None else markers)
    clean = cleaners.cleaned_translation(begun, volume_of) if document else cleaners.pipeline_translation(begun)
    light = cleaners.cleaned_transliteration(other, volume_of)
    # The cleaners are long: their results are written once and then looked at.
    done = rows.withColumns({"__t": clean, "__s": profiles.normalize(light, "main" if document else "pipeline", "transliteration"), "__ranged": cleaners.drop_line_markers(raw) != text.normalize_ws(raw)})
    done = materialize(done, "cleaned-extracts")
    either = lambda test, a: test(F.coalesce(F.col(a[0]), F.lit(""))) | test(a[1])
    reasons = [
        ("listed", F.col(record).isin(*excluded) if excluded else F.lit(False)),
        ("empty", either(text.is_empty, (translation, "__t"))),
        ("description", text.starts_with_any(F.coalesce(F.col(translation), F.lit("")), cleaners.EXCLUDED_PREFIXES)),
        ("unavailable", either(text.is_unavailable, (transliteration, "__s"))),
        ("no_text", either(text.says_no_text, (transliteration, "__s"))),
        ("gap_only", text.is_gap_only("__s") | text.is_gap_only("__t")),
    ]
    kept, rejected = filters.route(done, reasons)
    hidden = ("__t", "__s", "__ranged")
    named = kept.withColumns({f"{translation}_orig": F.col(translation), f"{transliteration}_orig": F.col(transliteration), translation: F.col("__t"), transliteration: F.col("__s")}).drop(*hidden)
    listed = F.coalesce(reasons[0][1], F.lit(False))
    stays = ~listed & ~reasons[1][1] & ~reasons[2][1]
    changed = F.count_if(stays & (F.col("__t") != F.coalesce(F.col(translation), F.lit("")))).alias("n_changed")
    extra = done.agg(F.count_if(~listed & F.col("__ranged")).alias("n_line_ranges"), changed)
    # Both sides have one row.
    counts = filters.stage_counts(done, reasons).withColumn("__one", F.lit(1)).join(extra.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return Cleaning(named, rejected.drop(*hidden), counts)


def result_records(work: DataFrame, chosen: DataFrame, key: str, answer: str = "text") -> DataFrame:
    """work's rows (with arrays page_candidates and context_pages, and an array of image paths) and what was chosen for them.

    chosen: key, the answer, and any of n_candidates, best_idx, best_score, cached, error. Pages become texts; what is missing
    takes 0, -1, 0.0, false and ""; found says whether there is an answer.
    """
    defaults = {"n_candidates": F.lit(0), "best_idx": F.lit(-1), "best_score": F.lit(0.0), "cached": F.lit(False), "error": F.lit("")}
    out = work.join(chosen, key, "left")
    pages = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda p: p.cast("string")), ",")
    out = out.withColumns({c: pages(c) for c in ("page_candidates", "context_pages") if c in work.columns})
    if "images" in work.columns:
        out = out.withColumn("image_path", F.coalesce(F.get("images", F.lit(0)), F.lit(""))).drop("images")
    out = out.withColumns({c: F.coalesce(F.col(c), d) if c in chosen.columns else d for c, d in defaults.items()})
    return out.withColumn(answer, F.coalesce(answer, F.lit(""))).withColumn("found", text.normalize_ws(answer) != "")


#: Texts, the number of answers and the round to a list of answers for each text.
Model = Callable[[list[str], int, int], list[list[str]]]


@dataclass(frozen=True)
class Models:
    """What finds numbers on a page, what reads a record's lines and ranges, and what translates."""

    detect: Model
    extract: Model
    translate: Model
    sleep: Callable[[float], None] = field(default=lambda seconds: None)


def detect(pages: DataFrame, models: Models, config: ExtractionSettings) -> DataFrame:
    """pages: volume, page, text. volume, canonical, page: numbers that enough samples of a page name, on their first page."""
    # A page's key is its own; volumes may share numbers of pages.
    keyed = pages.withColumn("__id", F.concat_ws("|", "volume", "page"))
    asked = materialize(rounds.sampled(keyed, models.detect, "text", "__id", config.samples, sleep=models.sleep), "detect")
    samples = keyed.select("__id", "volume", "page").join(asked, "__id").select("volume", "page", F.posexplode("responses").alias("sample", "response"))
    named = candidates.detection_rows(samples, "response", "numbers", "volume")
    voted = candidates.by_votes(named, ["volume", "page"], "canonical", "sample", min(config.votes, config.samples))
    return voted.groupBy("volume", "canonical").agg(F.min("page").alias("page"))


def link(found: DataFrame, published: DataFrame) -> DataFrame:
    """found with source_text and oare_id of the published text of that number, null without one. published: excavation_no, transliteration, oare_id, rid."""
    table = joins.link_table(published, "excavation_no", "transliteration", "oare_id", "rid")
    linked = table.select(F.col("excavation_no").alias("__key"), F.col("longest_text").alias("source_text"), F.col("first_id").alias("oare_id"))
    return found.join(linked, F.lower("canonical") == F.col("__key"), "left").drop("__key")


def extract(linked: DataFrame, pages: DataFrame, models: Models, config: ExtractionSettings) -> DataFrame:
    """record, volume, canonical, page, lines, ranges, flags: for each record the answer most like its peers, asked again while lines lack a range."""
    known = pages.groupBy("volume").agg(F.sort_array(F.collect_set("page")).alias("__pages"))
    records = linked.withColumn("record", F.xxhash64("volume", "canonical")).join(known, "volume")
    context = records.select("record", F.explode(F.filter("__pages", lambda p: (p >= F.col("page")) & (p <= F.col("page") + 1))).alias("page"), "volume")
    joined = context.join(pages, ["volume", "page"]).groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("context"))
    rows = records.drop("__pages").join(joined, "record").withColumn("prompt", F.concat("canonical", F.lit("\n"), "context"))
    pending, done = materialize(rows, "records"), None
    spans = lambda c: F.transform(ordered_entries(c), lambda e: F.array(e["start"].cast("int"), e["end"].cast("int")))
    for turn in range(config.retries + 1):
        asked = materialize(rounds.sampled(pending, models.extract, "prompt", "record", config.samples, turn, sleep=models.sleep), f"extract{turn}")
        parsed = candidates.candidate_rows(asked, "record", "responses", "lines")
        body = parsed.withColumn("idx", F.col("idx").cast("long")).withColumn("text", F.col("parsed"))
        best = consensus.pick_by_peers(body.select("record", "idx", "text"))
        texts = best.select("record", F.coalesce(F.get_json_object("best_text", "$.lines"), F.lit("{}")).alias("lines"), F.coalesce(F.get_json_object("best_text", "$.ranges"), F.lit("{}")).alias("ranges"))
        flagged = materialize(pending.join(texts, "record").withColumn("flags", coverage_flags(spans("lines"), spans("ranges"))), f"extracted{turn}")
        last = turn == config.retries
        over = flagged if last else flagged.where("flags = ''")
        done = over if done is None else done.unionByName(over)
        pending = flagged.where("flags <> ''").drop("lines", "ranges", "flags")
        if last or pending.isEmpty():
            break
    return done.select("record", "volume", "canonical", "page", "lines", "ranges", "flags")


def translate(pairs: DataFrame, pool: DataFrame, routes: DataFrame, models: Models, config: ExtractionSettings) -> DataFrame:
    """pairs (id, volume, source_text, target_text) with target_text in the target language; pairs of volumes without a language stay as they are.

    The nearest examples of the pool (id, text, translation) by token edits stand in the prompt. routes: volume, language.
    """
    routed = prompts.routed(pairs, ["volume"], routes, "volume_key", "language")
    todo, kept = routed.where(F.col("language").isNotNull()), routed.where(F.col("language").isNull())
    near = joins.most_similar(todo.select("id", F.col("target_text").alias("text")), pool.select("id", "text"), config.examples)
    shown = near.join(pool.select(F.col("id").alias("pool_id"), "text", "translation"), "pool_id")
    examples = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "pool_id", F.col("text").alias("source"), F.col("translation").alias("target")))).alias("examples"))
    asked = todo.join(examples, todo["id"] == F.col("query_id"), "left").drop("query_id")
    settings = config.prompt
    asked = asked.withColumn("prompt", prompts.prompt(settings.template, "target_text", language="language", examples="examples", instruction=F.lit(settings.instruction)))
    asked = materialize(asked, "translate-prompts")
    answers = materialize(rounds.sampled(asked, models.translate, "prompt", "id", config.samples, sleep=models.sleep), "translations")
    parsed = candidates.candidate_rows(answers, "id", "responses", "translation").withColumn("idx", F.col("idx").cast("long"))
    best = consensus.pick_by_peers(parsed, "geo", prefer="valid").select(F.col("record").alias("id"), F.col("best_text").alias("__new"))
    done = asked.select(*pairs.columns).join(best, "id", "left").withColumn("target_text", F.coalesce(F.nullif("__new", F.lit("")), F.col("target_text"))).select(*pairs.columns)
    return done.unionByName(kept.select(*pairs.columns))


def document_pipeline(pages: DataFrame, published: DataFrame, pool: DataFrame, routes: DataFrame, models: Models, config: ExtractionSettings | None = None) -> dict[str, DataFrame]:
    """The phases one after another, each written to the shared folder: detections, linked, extracted, raw_pairs, pairs.

    pages: volume, page, text. raw_pairs has a row for each translated range, pairs those that survive post-processing.
    """
    config = config or ExtractionSettings()
    if config.volumes:
        pages = pages.where(F.col("volume").isin(*config.volumes))
    found = materialize(detect(pages, models, config), "detections")
    linked = materialize(link(found.where(~F.col("canonical").isin(*config.excluded)) if config.excluded else found, published), "linked")
    extracted = materialize(extract(linked, pages, models, config), "extracted")
    lines = aligned_pairs(extracted, "record", "lines", "ranges").join(extracted.select("record", "volume", "canonical", "page", "flags"), "record")
    raw = materialize(lines.withColumn("id", F.xxhash64("record", "line_range")), "raw-pairs")
    named = materialize(translate(raw, pool, routes, models, config), "translated")
    cleaned = named.withColumn("target_text", cleaners.pipeline_translation("target_text"))
    final = post_processed(cleaned, "source_text", "target_text", config.low, config.high)
    return {"detections": found, "linked": linked, "extracted": extracted, "raw_pairs": raw, "pairs": final.select("canonical", "page", "line_range", "source_text", "target_text", "fold")}
