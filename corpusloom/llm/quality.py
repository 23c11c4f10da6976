"""Quality rules with risk-controlled cutoffs (DataFrame and SQL functions only).

A rule rejects a document whose signal lies above the cutoff of its stratum (the language). Cutoffs come from labelled
holdouts: documents that pass the base rules and have a quality label. Of n good ones in a stratum a cutoff rejects k; it
is certified if P(Binomial(n, RISK / number of rules) <= k) is at most DELTA / (number of strata * number of rules), the
exact binomial (Clopper-Pearson) bound with Bonferroni's correction over strata and rules. In a rule's grid cutoffs are
tried from the mildest on and the first that fails ends the row (fixed-sequence testing), which needs no correction. So
with confidence 1 - DELTA the rules together reject at most RISK of the good documents of every stratum. Of the
certified cutoffs the one is taken that rejects most bad documents net of FALSE_COST times the good ones; the mildest on a
tie, none if that is not positive. A stratum with too few labels gets no cutoff and loses nothing to the rules.

Cases: a null or empty text has no words and fails the base rules; a null language is a stratum of its own; labels that
are null are not used, several for one id count as the worst; repeated rows are judged one by one; empty tables give empty
results or no cutoffs; other columns are carried through drop_low_quality and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_PATTERN, WORD_PATTERN, join_small, materialize, read

MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
RISK = 0.05
DELTA = 0.05
FALSE_COST = 20
#: Signal, and its grid of cutoffs from the mildest to the strictest.
GRIDS = {
    "symbols": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3),
    "repeats": (0.49, 0.48, 0.46, 0.44, 0.42, 0.4, 0.35, 0.3),
    "word_length": (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "shouts": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3),
}


def with_features(df: DataFrame, text: str) -> DataFrame:
    """df with __q_n_words, __q_word_chars, __q_n_symbols, __q_n_dup_lines, __q_n_repeat_words, __q_base_failed, __q_signals.

    Repeated 3-word windows are found inside the row, by sorting hashes of the windows with their places.
    """
    kept = [F.col(c) for c in df.columns]
    numbers = [F.expr(e).alias(f"__q_{name}") for name, e in (
        ("n_words", "cast(size(__q_words) AS bigint)"),
        ("word_chars", "cast(length(array_join(__q_words, '')) AS bigint)"),
        ("n_symbols", f"cast(regexp_count(__q_text, r'{SYMBOLS}') AS bigint)"),
        ("n_capitals", "cast(regexp_count(__q_text, '[A-Z]') AS bigint)"),
        ("n_shouts", "cast(regexp_count(__q_text, '!') AS bigint)"),
        ("lines", rf"filter(split(__q_text, '\n', -1), x -> x RLIKE r'{WORD_PATTERN}')"),
        ("windows", "CASE WHEN size(__q_words) >= 3 THEN transform(sequence(0, size(__q_words) - 3), i -> xxhash64(__q_words[i], __q_words[i + 1], __q_words[i + 2])) ELSE array() END"),
    )]
    text_column = F.coalesce(F.col(text), F.lit("")).alias("__q_text")
    read_once = df.select(*kept, text_column).select("*", F.expr(f"regexp_extract_all(__q_text, r'{WORD_PATTERN}', 0)").alias("__q_words")).select(*df.columns, *numbers)
    # Only texts with a repeated window are sorted.
    placed = read_once.withColumn(
        "__q_sorted",
        F.expr("CASE WHEN size(array_distinct(__q_windows)) < size(__q_windows) THEN sort_array(transform(__q_windows, (h, i) -> named_struct('h', h, 'i', i))) ELSE array() END"),
    )
    same = "(k > 0 AND __q_sorted[k].h = __q_sorted[k - 1].h) OR (k < size(__q_sorted) - 1 AND __q_sorted[k].h = __q_sorted[k + 1].h)"
    found = placed.withColumn(
        "__q_places",
        F.expr(f"CASE WHEN size(__q_sorted) > 0 THEN sort_array(transform(filter(sequence(0, size(__q_sorted) - 1), k -> {same}), k -> __q_sorted[k].i)) ELSE array() END"),
    )
    steps = "aggregate(sequence(1, size(__q_places)), 0L, (n, k) -> n + CASE WHEN k = size(__q_places) THEN 3 ELSE least(3, __q_places[k] - __q_places[k - 1]) END)"
    counted = found.select(
        *df.columns, *[f"__q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts")],
        F.expr("cast(size(__q_lines) AS bigint)").alias("__q_n_lines"),
        F.expr("cast(size(__q_lines) - size(array_distinct(__q_lines)) AS bigint)").alias("__q_n_dup_lines"),
        F.expr(f"CASE WHEN size(__q_places) > 0 THEN {steps} ELSE 0L END").alias("__q_n_repeat_words"),
    )
    ratio = {
        "symbols": "__q_n_symbols / greatest(__q_n_words, 1)", "dup_lines": "__q_n_dup_lines / greatest(__q_n_lines, 1)", "repeats": "__q_n_repeat_words / greatest(__q_n_words, 1)",
        "word_length": "__q_word_chars / greatest(__q_n_words, 1)", "capitals": "__q_n_capitals / greatest(__q_word_chars, 1)", "shouts": "__q_n_shouts / greatest(__q_n_words, 1)",
    }
    signals = F.expr("named_struct(" + ", ".join(f"'{k}', double({ratio[k]})" for k in GRIDS) + ")").alias("__q_signals")
    # Not deterministic for the optimizer, so that no filter is pushed below and computes the features over and over.
    barrier = F.spark_partition_id() >= 0
    failed = (F.expr(f"__q_n_words < {MIN_WORDS} OR 100 * __q_n_repeat_words > 50 * __q_n_words") & barrier).alias("__q_base_failed")
    return counted.select("*", failed, signals)


def certified_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA, false_cost: int = FALSE_COST) -> DataFrame:
    """holdout: stratum, signals, quality (1 good, 0 bad), of documents that pass the base rules. stratum, cutoffs.

    cutoffs is a struct with a double (or null) for each rule. Everything after the first aggregate is as small as
    strata * rules * grid.
    """
    per_rule = [
        F.struct(F.lit(k).alias("rule"), sum((F.col(f"signals.{k}") > c).cast("int") for c in grid).alias("passed")) for k, grid in GRIDS.items()
    ]
    each = holdout.select("stratum", "quality", F.explode(F.array(*per_rule)).alias("r"))
    # Grids fall, so the cutoffs a signal exceeds are the last ones; their number says which.
    counts = each.groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.passed").alias("passed")).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")
    )
    spark = holdout.sparkSession
    grid = spark.createDataFrame([(k, n, float(c), len(g)) for k, g in GRIDS.items() for n, c in enumerate(g)], "rule string, step int, cutoff double, steps int")
    # Step n of a falling grid is exceeded by the signals that exceed at least steps - n cutoffs.
    cells = counts.join(F.broadcast(grid), "rule").groupBy("stratum", "rule", "step", "cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("passed") >= F.col("steps") - F.col("step"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("passed") >= F.col("steps") - F.col("step"), F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    strata = F.size(F.collect_set("stratum").over(Window.partitionBy())) + F.max(F.col("stratum").isNull().cast("int")).over(Window.partitionBy())
    share = risk / len(GRIDS)
    # Log of the binomial's lower tail: each term from the one before, added up in logs.
    tail = f"""aggregate(sequence(0, int(k)), named_struct('term', double(n * ln(1 - {share}D)), 'total', double('-Infinity')),
        (s, i) -> named_struct('term', s.term + ln((n - i) / (i + 1D)) + ln({share}D / (1 - {share}D)),
        'total', greatest(s.total, s.term) + ln(1 + exp(least(s.total, s.term) - greatest(s.total, s.term)))), s -> s.total)"""
    # From the mean on the tail is above one half, far from any level: no sum needed, and none of a term with n = i.
    tested = cells.withColumn("level", F.lit(delta) / (strata * len(GRIDS))).withColumn(
        "holds", F.when((F.col("n") > 0) & (F.col("k") < F.col("n") * share), F.expr(tail) <= F.log("level")).otherwise(False)
    )
    row = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sure = tested.withColumn("sure", F.min("holds").over(row)).withColumn("gain", F.col("k_bad") - false_cost * F.col("k"))
    useful = sure.where(F.col("sure") & (F.col("gain") > 0))
    best = useful.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    named = [F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(k) for k in GRIDS]
    return best.groupBy("stratum").agg(*named).select("stratum", F.struct(*GRIDS).alias("cutoffs"))


def holdout_of(featured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__q_id")).agg(F.min("quality").alias("__q_quality"))
    sound = featured.where(~F.col("__q_base_failed")).select(F.col(id_col).alias("__q_doc"), F.col(stratum_col).alias("stratum"), F.col("__q_signals").alias("signals"))
    return sound.join(marks, F.col("__q_doc") == F.col("__q_id")).select("stratum", "signals", F.col("__q_quality").alias("quality"))


def judged(featured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """featured with __q_kept: false if the base rules or a rule of the stratum reject."""
    named = cutoffs.select(F.col("stratum").alias(stratum_col), F.col("cutoffs").alias("__q_cutoffs"))
    over = [F.coalesce(F.col(f"__q_signals.{k}") > F.col(f"__q_cutoffs.{k}"), F.lit(False)) for k in GRIDS]
    rejected = over[0]
    for other in over[1:]:
        rejected = rejected | other
    return join_small(featured, named, stratum_col).withColumn("__q_kept", ~F.col("__q_base_failed") & ~rejected).drop("__q_cutoffs")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, features, base_failed, kept. The text is read once; features go through a table."""
    featured = materialize(with_features(docs.select("doc_id", "lang", "text"), "text").drop("text"), "quality-features")
    cutoffs = materialize(certified_cutoffs(holdout_of(featured, labels)), "quality-cutoffs")
    out = judged(featured, cutoffs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"__q_{n}").alias(n) for n in names])


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the rules keep, all their columns.

    The table is written once with its features beside it: no text is read twice by the rules, and none goes through an
    exchange. The cutoffs are read from the features alone.
    """
    featured = materialize(with_features(docs, "text"), "quality-documents")
    cutoffs = materialize(certified_cutoffs(holdout_of(featured, labels)), "quality-cutoffs")
    return judged(featured, cutoffs).where("__q_kept").select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_SHARE = RISK / len(GRIDS)
_SIGNALS = {
    "symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)", "shouts": "n_shouts / greatest(n_words, 1)",
}
QUALITY_SQL = f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c
  FROM (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words) WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM words) WHERE regexp_matches(x, '{WORD_PATTERN}') GROUP BY 1
), f AS (
  SELECT words.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    length(t) - length(replace(t, '!', '')) AS n_shouts, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), s AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CAST({v} AS DOUBLE) AS s_{k}" for k, v in _SIGNALS.items())} FROM f
), marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1
), h AS (SELECT s.*, quality FROM s JOIN marks USING (doc_id) WHERE NOT base_failed
), each AS (
  {" UNION ALL ".join(f"SELECT lang, quality, '{k}' AS rule, s_{k} AS v FROM h" for k in GRIDS)}
), grid(rule, step, cutoff) AS (VALUES {", ".join(f"('{k}', {n}, CAST({c} AS DOUBLE))" for k, g in GRIDS.items() for n, c in enumerate(g))}
), cells AS (
  SELECT lang, rule, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > cutoff) AS k, count(*) FILTER (quality = 0 AND v > cutoff) AS k_bad
  FROM each JOIN grid USING (rule) GROUP BY ALL
), tested AS (
  SELECT *, n > 0 AND k < n * {_SHARE} AND
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
    <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) * {len(GRIDS)}) AS holds
  FROM cells
), sure AS (
  SELECT *, min(holds::INT) OVER (PARTITION BY lang, rule ORDER BY step ROWS UNBOUNDED PRECEDING) AS sure, k_bad - {FALSE_COST} * k AS gain FROM tested
), best AS (
  SELECT lang, rule, first(cutoff ORDER BY gain DESC, step) AS cutoff FROM sure WHERE sure = 1 AND gain > 0 GROUP BY 1, 2
), rejected AS (
  SELECT DISTINCT doc_id FROM ({" UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS rule, s_{k} AS v FROM s" for k in GRIDS)}) x
  JOIN best ON x.rule = best.rule AND x.lang IS NOT DISTINCT FROM best.lang WHERE v > cutoff
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept
FROM s LEFT JOIN rejected r ON s.doc_id = r.doc_id
"""

QUERIES = {"op3_quality": op3_quality}
ORACLES = {"op3_quality": QUALITY_SQL}
