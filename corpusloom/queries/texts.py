"""Text, gap, number and identifier functions; consensus and metrics; composite plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays, cleaners, gaps, ids, numbers, profiles, text
from corpusloom.operators import consensus, joins
from corpusloom.plans import corpus
from corpusloom.queries.relational import T
from corpusloom.session import spread
from corpusloom.sources import pages
from corpusloom.streaming import rounds


def norm_ws(s, sf):
    return T(s, sf, "documents").select("doc_id", F.md5(text.normalize_ws("text")).alias("digest"))


def dedup_words(s, sf):
    return T(s, sf, "documents").select("doc_id", F.md5(text.drop_repeated_words("text")).alias("digest"))


def char_lengths(s, sf):
    return T(s, sf, "documents").select("doc_id", text.char_length("text").alias("n_chars"), text.byte_tokens("text", True).alias("n_tokens"), F.round(text.char_ratio("text", "source"), 6).alias("ratio"))


def ellipsis_cut(s, sf):
    return T(s, sf, "documents").select("doc_id", text.ellipsis_cut("text", 50).alias("cut"))


def word_cut(s, sf):
    cut = text.cut_words("text", 60)
    return T(s, sf, "documents").select("doc_id", cut.alias("cut"), text.was_cut("text", cut).alias("was_cut"))


def ratio_cut(s, sf):
    return T(s, sf, "conversations").select("conv_id", "turn", text.cut_to_ratio("text", F.substring("text", 1, 30), 1.8).alias("cut"))


def too_short(s, sf):
    return T(s, sf, "documents").select("doc_id", text.too_short("text", F.substring("text", 1, 25)).alias("short"))


def gap_repair(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("a <gap> b"), F.repeat(F.lit(" <gap> c"), (F.col("doc_id") % 4).cast("int"))).alias("t"), F.repeat(F.lit("<gap>"), (F.col("doc_id") % 3).cast("int")).alias("s"))
    return d.select("doc_id", gaps.repair_gaps("s", "t").alias("fixed"), gaps.count_gaps("t").alias("n_gaps"))


def gap_tokens(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat("text", F.lit(" ... <gap> - x [gap] <GAP> <q>")).alias("t"))
    return d.select("doc_id", gaps.normalize_gaps("t").alias("gaps"), gaps.fold_angles("t").alias("angles"))


def key_norm(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("akt_0"), F.col("doc_id").cast("string"), F.lit("a.pdf")).alias("v"), "source")
    return d.select("doc_id", ids.filter_key("source").alias("filter_key"), ids.alnum_key("v").alias("alnum"), ids.volume_key("v").alias("volume"))


def excavation_ids(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("see KT n/K "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " + 77b").otherwise("")).alias("t"))
    return d.select("doc_id", ids.excavation_number("t").alias("key"), F.size(ids.alternate_keys(ids.excavation_number("t"))).alias("n_keys"))


def profile_route(s, sf):
    routes = s.createDataFrame([("de", "German"), ("fr", "French"), ("en", None)], "lang string, language string")
    d = T(s, sf, "documents").select("doc_id", "lang").join(F.broadcast(routes), "lang", "left")
    return d.select("doc_id", F.coalesce("language", F.lit("default")).alias("language"))


def prompt_text(s, sf):
    return T(s, sf, "documents").select("doc_id", F.md5(F.format_string("Translate from %s:\n%s", "lang", text.normalize_ws("text"))).alias("prompt"))


def predicates(s, sf):
    c = T(s, sf, "conversations")
    return c.select("conv_id", "turn", text.is_empty("text").alias("empty"), text.says_no_text("text").alias("no_text"), text.starts_with_any("text", ("the ", "an")).alias("prefix"), text.is_gap_only(F.when(F.col("turn") % 2 == 0, " <gap> <gap>").when(F.col("turn") % 3 == 0, " ").otherwise("<gap> a")).alias("gap_only"))


def _quote_folds(s, sf, body):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("“a” ‘b’ [c] "), body).alias("t"))
    return d.select("doc_id", text.drop_square_brackets(text.fold_apostrophes(text.fold_double_quotes("t"))).alias("t"))


def decimals(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("a "), (F.col("doc_id") % 3).cast("string"), F.element_at(F.array(*map(F.lit, (".25", ".5", ".35", ".625", ".66", ".75", ".8333"))), (F.col("doc_id") % 7 + 1).cast("int")), F.lit(" b")).alias("t"))
    return d.select("doc_id", numbers.decimal_fractions("t").alias("t"))


def roman(s, sf):
    signs = F.array(*[F.lit(numbers._roman(n)) for n in range(1, 15)])
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("k "), F.element_at(signs, (F.col("doc_id") % 14 + 1).cast("int")), F.lit(" m")).alias("t"))
    return d.select("doc_id", numbers.roman_numerals("t").alias("t"))


def fractions(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "month ").otherwise("x "), (F.col("doc_id") % 4).cast("string"), F.lit(" / 4 y")).alias("t"))
    return d.select("doc_id", numbers.spaced_fractions("t").alias("spaced"), numbers.compact_fractions("t").alias("compact"))


def _profile(name):
    def run(s, sf):
        marked = F.concat(F.lit("ki (d) a x b, 1.5 PN "), F.col("text"), F.lit(" II 1 / 2 <gap> ā"))
        d = spread(T(s, sf, "documents")).select("doc_id", marked.alias("t"))
        return d.select("doc_id", profiles.normalize("t", name, "transliteration").alias("source_text"), profiles.normalize("t", name, "translation").alias("target_text"))

    return run


def json_first(s, sf):
    e = T(s, sf, "events").select("event_id", F.concat(F.lit("answer: "), "props").alias("t"))
    return e.select("event_id", F.get_json_object(arrays.first_json_object("t"), "$.page").alias("page"))


def mbr_pick(s, sf):
    c = T(s, sf, "conversations").select(F.col("conv_id").alias("record"), F.col("turn").alias("idx"), "text")
    return consensus.pick_by_peers(c)


def nbest_rerank(s, sf):
    c = T(s, sf, "conversations").select(F.col("conv_id").alias("record"), F.col("turn").alias("idx"), "text")
    return consensus.pick_by_peers(c, own=True)


def geo_pick(s, sf):
    c = T(s, sf, "conversations").select(F.col("conv_id").alias("record"), F.col("turn").alias("idx"), "text")
    return consensus.pick_by_peers(c, "geo")


def corpus_scores(s, sf):
    d = T(s, sf, "documents").select(F.col("text").alias("reference"), F.regexp_replace("text", "th", "t").alias("prediction"))
    return consensus.corpus_scores(d)


def row_scores(s, sf):
    return consensus.row_scores(T(s, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.regexp_replace("text", "th", "t").alias("prediction")))


def edit_topk(s, sf):
    b = T(s, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return joins.most_similar(b, b, 3)


def near_dup_flag(s, sf):
    d = T(s, sf, "documents").select("doc_id", "text")
    return consensus.near_duplicate_flag(d, T(s, sf, "benchmark"), "text").select("doc_id", "is_duplicate")


def clean_split(s, sf):
    return corpus.clean_and_split(T(s, sf, "documents"), T(s, sf, "benchmark")).groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"))


def example_pool(s, sf):
    d = T(s, sf, "documents").withColumn("fold", F.col("doc_id") % 4)
    return corpus.example_pool(d, ["text", "lang"], "doc_id", most=120, skip_fold=0)


def location_summary(s, sf):
    detections = T(s, sf, "events").select(F.col("event_type").alias("volume"), (F.col("user_id") % 40).alias("key"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("pdf"), (F.col("event_id") % 11).alias("page"))
    targets = T(s, sf, "events").select(F.col("event_type").alias("volume"), (F.col("user_id") % 60).alias("key"))
    tables = corpus.location_tables(targets, detections)
    return tables["summary"].select("volume", "key", "match_count", "pdfs", "pages", "found")


def train_table(s, sf):
    d = T(s, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("source_text"), F.col("text").alias("target_text"), F.col("doc_id").alias("rid"))
    out = corpus.training_table(d, d.where("rid % 2 = 0"), d.where("rid % 3 = 0"), ["1", "2"], ["4"])
    return out.select("id", F.col("fold").cast("int").alias("fold"), "target_text")


def aligned_pairs(s, sf):
    c = T(s, sf, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("turn") + 1).cast("string"), "text"))).alias("m"), F.max("turn").alias("n"))
    r = c.select("conv_id", F.to_json("m").alias("lines"), F.concat(F.lit('{"1-2": "head", "3-'), (F.col("n") + 1).cast("string"), F.lit('": "tail"}')).alias("spans"))
    return corpus.aligned_pairs(r, "conv_id", "lines", "spans")


def retry_rounds(s, sf):
    d = T(s, sf, "documents").select("doc_id", "text")
    # A stand-in for a model: the answer grows by round.
    answer = lambda texts, turn: [t[: 10 * (turn + 1)] for t in texts]
    return rounds.until_accepted(d, answer, "text", "doc_id", F.length("answer") >= F.least(F.lit(20), F.length("text")), 3)


def _line_markers(s, sf, body):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("1-3) "), body, F.lit(" 4'-5' and 12 (6) end")).alias("t"))
    return d.select("doc_id", cleaners.drop_line_markers("t").alias("t"))


def extracted_texts(s, sf):
    d = spread(T(s, sf, "documents")).select("doc_id", F.concat(F.lit("1-3) [Rest Vs. abgebr.] "), F.col("text"), F.lit(" a<sub>2</sub> x … 1/2 m Spuren")).alias("t"), F.when(F.col("doc_id") % 2 == 0, "AKT 7B").otherwise("AKT 1").alias("v"))
    return d.select("doc_id", cleaners.cleaned_translation("t").alias("target_text"), cleaners.cleaned_transliteration("t", "v").alias("source_text"), cleaners.drop_leading_summary("t").alias("body"))


def sup_sub_html(s, sf):
    p = T(s, sf, "pages").select("page_id", F.concat("url", F.lit(" a<sup>ki</sup> u<SUB>"), (F.col("page_id") % 10).cast("string"), F.lit("</sub> <sup>")).alias("t"))
    return p.select("page_id", cleaners.sup_sub_to_unicode("t").alias("t"))


def text_lines(s, sf):
    c = T(s, sf, "conversations")
    rects = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.lit(1).alias("page"), "text", (F.col("turn") % 3 * 50).cast("double").alias("x0"), (F.col("turn") * 1.5).alias("y0"), (F.col("turn") % 3 * 50 + 40).cast("double").alias("x1"), (F.col("turn") * 1.5 + 2).alias("y1"))
    return pages.text_lines(rects)


def fallback_fill(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    table = T(s, sf, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    return joins.fill_from(d, "doc_id", "lang", F.array("doc_id", F.col("doc_id") + 1), table, "k", "v")


_WS = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
_DEDUP = r"array_to_string(list_transform(list_filter(list_zip(w, list_prepend('', w)), lambda p: p[1] IS DISTINCT FROM p[2] AND p[1] IS NOT NULL), lambda p: p[1]), ' ')"
_CLEAN = f"SELECT *, CASE WHEN flat = '' THEN '' ELSE {_DEDUP} END AS clean FROM (SELECT *, {_WS} AS flat, string_split({_WS}, ' ') AS w FROM {{}})"

_QUOTES_SQL = f"""SELECT doc_id, translate('"a" ''b'' c ' || text, '{text.DOUBLE_QUOTES}{text.APOSTROPHES}[]', '{'"' * len(text.DOUBLE_QUOTES)}{"''" * len(text.APOSTROPHES)}') AS t FROM documents"""

TABLE = {
    "norm_ws": (norm_ws, f"SELECT doc_id, md5({_WS}) AS digest FROM documents"),
    "dedup_words": (dedup_words, f"SELECT doc_id, md5(CASE WHEN flat = '' THEN text ELSE clean END) AS digest FROM ({_CLEAN.format('documents')})"),
    "char_lengths": (char_lengths, "SELECT doc_id, length(text) AS n_chars, strlen(text) + 1 AS n_tokens, round(length(text) / nullif(length(source), 0), 6) AS ratio FROM documents"),
    "ellipsis_cut": (ellipsis_cut, r"SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE regexp_replace(text[1:49], '\s+$', '') || '…' END AS cut FROM documents"),
    "word_cut": (word_cut, f"WITH f AS (SELECT doc_id, {_WS} AS t FROM documents), c AS (SELECT doc_id, t, CASE WHEN length(t) <= 60 THEN t WHEN t[61] = ' ' THEN t[1:60] ELSE coalesce(nullif(regexp_extract(t[1:60], '^(.*) ', 1), ''), string_split(t, ' ')[1]) END AS cut FROM f) SELECT doc_id, cut, length(cut) < length(t) AS was_cut FROM c"),
    "ratio_cut": (ratio_cut, f"WITH f AS (SELECT conv_id, turn, text, {_WS} AS t, length(trim(regexp_replace(text[1:30], '\\s+', ' ', 'g'), ' ')) AS r FROM conversations), c AS (SELECT *, greatest(CAST(floor(r * 1.8) AS INT), 1) AS k FROM f) SELECT conv_id, turn, CASE WHEN t = '' OR length(t) <= r * 1.8 THEN text WHEN t[k + 1] = ' ' THEN t[1:k] ELSE coalesce(nullif(regexp_extract(t[1:k], '^(.*) ', 1), ''), string_split(t, ' ')[1]) END AS cut FROM c"),
    "too_short": (too_short, f"WITH f AS (SELECT doc_id, length({_WS}) AS a, length(trim(regexp_replace(text[1:25], '\\s+', ' ', 'g'), ' ')) AS b FROM documents) SELECT doc_id, b > 0 AND a >= 80 AND (b < 20 OR b / a < 0.25) AS short FROM f"),
    "gap_repair": (gap_repair, "WITH p AS (SELECT doc_id, doc_id % 3 AS n, 1 + doc_id % 4 AS g FROM documents) SELECT doc_id, CASE WHEN n = 0 OR g <= n THEN 'a <gap> b' || repeat(' <gap> c', CAST(g - 1 AS INT)) ELSE 'a <gap> b' || repeat(' <gap> c', CAST(n - 1 AS INT)) || repeat('  c', CAST(g - n AS INT)) END AS fixed, CAST(g AS INT) AS n_gaps FROM p"),
    "gap_tokens": (gap_tokens, None),
    "key_norm": (key_norm, "SELECT doc_id, upper(source) AS filter_key, 'akt0' || doc_id || 'apdf' AS alnum, 'AKT ' || CAST(doc_id AS VARCHAR) || 'A' AS volume FROM documents"),
    "excavation_ids": (excavation_ids, "SELECT doc_id, 'Kt. n/k ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '+77b' ELSE '' END AS key, 2 AS n_keys FROM documents"),
    "profile_route": (profile_route, "SELECT doc_id, CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'default' END AS language FROM documents"),
    "prompt_text": (prompt_text, f"SELECT doc_id, md5('Translate from ' || lang || ':' || chr(10) || {_WS}) AS prompt FROM documents"),
    "predicates": (predicates, f"SELECT conv_id, turn, {_WS} = '' AS empty, contains(lower(text), 'no text') AS no_text, starts_with(lower({_WS}), 'the ') OR starts_with(lower({_WS}), 'an') AS prefix, turn % 2 = 0 AS gap_only FROM conversations"),
    "quote_folds_whole": (lambda s, sf: _quote_folds(s, sf, F.col("text")), _QUOTES_SQL),
    "decimals": (decimals, "SELECT doc_id, 'a ' || CASE WHEN doc_id % 7 = 4 THEN (doc_id % 3) || '.66' WHEN doc_id % 7 = 2 AND doc_id % 3 > 0 THEN (doc_id % 3) || '.35' ELSE CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 3) || ' ' END || ['¼', '½', '⅓', '⅔', '', '¾', '⅚'][doc_id % 7 + 1] END || ' b' AS t FROM documents"),
    "roman": (roman, "SELECT doc_id, 'k ' || ['I', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', 'XIII', 'XIV'][doc_id % 14 + 1] || ' m' AS t FROM documents"),
    "fractions": (fractions, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'month ' ELSE 'x ' END || (doc_id % 4) || ' / 4 y' ELSE 'x ' || ['', '¼', '', '¾'][doc_id % 4 + 1] || ' y' END AS spaced, CASE WHEN doc_id % 2 = 0 THEN 'month ' || CASE WHEN doc_id % 4 = 2 THEN '2 / 4' ELSE '0 / 4' END || ' y' ELSE 'x ' || ['', '¼', '', '¾'][doc_id % 4 + 1] || ' y' END AS compact FROM documents"),
    "line_markers_whole": (lambda s, sf: _line_markers(s, sf, F.col("text")), None),
    "line_markers": (lambda s, sf: _line_markers(s, sf, F.regexp_replace("text", "[0-9]", "")), r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '', 'g') || ' and 12 end', '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM documents"),
    "extracted_texts": (extracted_texts, None),
    "sup_sub_html": (sup_sub_html, "SELECT page_id, url || ' aᵏⁱ u' || '₀₁₂₃₄₅₆₇₈₉'[page_id % 10 + 1] || ' ' AS t FROM pages"),
    "text_lines": (text_lines, None),
    "fallback_fill": (fallback_fill, "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN lang END, 'q' || a.quality, 'q' || b.quality, '(unavailable)') AS lang FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1"),
    "profile_main": (_profile("main"), None),
    "profile_pipeline": (_profile("pipeline"), None),
    "profile_corpus": (_profile("corpus"), None),
    "json_first": (json_first, "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events"),
    "mbr_pick": (mbr_pick, None),
    "nbest_rerank": (nbest_rerank, None),
    "geo_pick": (geo_pick, None),
    "corpus_scores": (corpus_scores, None),
    "row_scores": (row_scores, None),
    "edit_topk": (edit_topk, None),
    "near_dup_flag": (near_dup_flag, f"SELECT doc_id, {_WS} = '' OR lower(replace({_WS}, 'ß', 'ss')) IN (SELECT lower(replace({_WS}, 'ß', 'ss')) FROM benchmark) AS is_duplicate FROM documents"),
    "clean_split": (clean_split, f"WITH c AS (SELECT doc_id, lang, clean FROM ({_CLEAN.format('documents')})), b AS (SELECT clean FROM ({_CLEAN.format('benchmark')})), u AS (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, clean FROM c WHERE clean NOT IN (SELECT clean FROM b) GROUP BY clean), q AS (SELECT *, length(clean) AS nc, strlen(clean) AS nb, (row_number() OVER (ORDER BY length(clean), doc_id) - 1) * 20 // count(*) OVER () AS bin FROM u), f AS (SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), doc_id) - 1) % 4 AS INT) AS fold FROM q) SELECT lang, fold, count(*) AS n_docs, CAST(sum(nc) AS BIGINT) AS n_chars, CAST(sum(nb) AS BIGINT) AS n_bytes FROM f GROUP BY ALL"),
    "example_pool": (example_pool, f"WITH t AS (SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE rtrim(f[1:119]) || '…' END AS example FROM (SELECT doc_id, CASE WHEN {_WS} <> '' THEN {_WS} ELSE lang END AS f FROM documents WHERE doc_id % 4 <> 0)) SELECT min(doc_id) AS doc_id, arg_min(example, doc_id) AS example FROM t WHERE length(example) >= 20 GROUP BY lower(replace(example, 'ß', 'ss'))"),
    "location_summary": (location_summary, "WITH t AS (SELECT DISTINCT event_type AS volume, user_id % 60 AS key FROM events), d AS (SELECT event_type AS volume, user_id % 40 AS key, 'p' || (event_id % 3) AS pdf, event_id % 11 AS page FROM events), s AS (SELECT volume, key, count(DISTINCT page) AS match_count, string_agg(DISTINCT pdf, ', ' ORDER BY pdf) AS pdfs, array_to_string(list_sort(list_distinct(list(page))), ', ') AS pages FROM d GROUP BY ALL) SELECT volume, key, coalesce(match_count, 0) AS match_count, coalesce(pdfs, '') AS pdfs, coalesce(pages, '') AS pages, match_count IS NOT NULL AS found FROM t LEFT JOIN s USING (volume, key)"),
    "train_table": (train_table, None),
    "aligned_pairs": (aligned_pairs, None),
    "retry_rounds": (retry_rounds, "WITH d AS (SELECT doc_id, text[1:30] AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 10 THEN t ELSE t[1:20] END AS answer, CASE WHEN length(t) <= 10 THEN 1 ELSE 2 END AS tries, true AS accepted FROM d"),
}
