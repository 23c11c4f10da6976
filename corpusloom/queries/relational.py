"""Filters, joins, aggregations, windows, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text, vectors
from corpusloom.operators import aggregates, dedup, filters, joins, unions, windows


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold_filter(s, sf):
    rest, held = filters.fold_split(T(s, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") % 4).alias("fold")), 2)
    return rest.withColumn("side", F.lit("rest")).unionByName(held.withColumn("side", F.lit("held")))


def member_filter(s, sf):
    d = T(s, sf, "documents").select("doc_id", "lang")
    return filters.among(d, "lang", ["de", "fr"]).withColumn("inside", F.lit(1)).unionByName(filters.among(d, "lang", ["de", "fr"], keep=False).withColumn("inside", F.lit(0)))


def nonblank_filter(s, sf):
    return filters.non_blank(T(s, sf, "conversations"), "text", "role").select("conv_id", "turn")


def placeholder_filter(s, sf):
    return filters.without_placeholders(T(s, sf, "conversations"), "text", ("and", "ing")).select("conv_id", "turn")


def ratio_filter(s, sf):
    return filters.ratio_between(T(s, sf, "documents").withColumn("other", F.repeat(F.lit("é"), (F.col("doc_id") % 900).cast("int"))), "text", "other", 0.3, 4.0).select("doc_id")


def value_swap(s, sf):
    d = T(s, sf, "documents").select("doc_id", "lang", "source").join(T(s, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return filters.swap_where(d, "lang", "source", F.col("toxic") == 1).select("doc_id", "lang")


def blank_coalesce(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("a"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("b"))
    return d.select("doc_id", filters.first_non_blank("a", "b").alias("value"))


def bool_text(s, sf):
    e = T(s, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "FALSE ").when(F.col("event_id") % 4 == 1, " Yes").when(F.col("event_id") % 4 == 2, "no").alias("v"))
    return e.select("event_id", filters.false_like("v").alias("is_false"), filters.parse_bool("v").alias("is_true"))


def safe_int(s, sf):
    return T(s, sf, "documents").select("doc_id", filters.safe_int(F.substring("source", 4, 5)).alias("n"), filters.safe_int("lang").alias("bad"))


def _reasons():
    return [("short", F.length("text") < 60), ("foreign", F.col("lang") != "en"), ("symbols", F.col("text").contains("###"))]


def reject_routing(s, sf):
    kept, skipped = filters.route(T(s, sf, "documents"), _reasons())
    return kept.select("doc_id", F.lit("").alias("skip_reason")).unionByName(skipped.select("doc_id", "skip_reason"))


def staged_exclusion(s, sf):
    return filters.stage_counts(T(s, sf, "documents"), _reasons())


def column_contract(s, sf):
    d = filters.require_columns(T(s, sf, "documents"), ["doc_id", "text"], "documents")
    return filters.to_layout(d.select("doc_id", filters.first_existing(d, ["origin", "source"]).alias("origin")), ["origin", "note", "doc_id"])


def direction_switch(s, sf):
    d = filters.directed(T(s, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", reverse=True)
    return filters.submission(d, "doc_id", "input", "prediction", "target")


def left_unique(s, sf):
    return joins.attach_unique(T(s, sf, "customer").select("c_custkey"), T(s, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderkey"), "c_custkey", ["o_orderkey"])


def anti_known(s, sf):
    return joins.exclude_known(T(s, sf, "documents").select("doc_id", "lang"), T(s, sf, "labels"), "doc_id")


def semi_flag(s, sf):
    return joins.flag_known(T(s, sf, "documents").select("doc_id"), T(s, sf, "labels").where("toxic = 1"), "doc_id", "is_toxic")


def override_join(s, sf):
    table = T(s, sf, "nation").where("n_regionkey = 1").select("n_nationkey", F.lit("override").alias("n_name"))
    return joins.override(T(s, sf, "nation").select("n_nationkey", "n_name"), table, "n_nationkey", "n_name")


def alt_key_join(s, sf):
    left = T(s, sf, "supplier").select("s_suppkey", "s_nationkey")
    right = T(s, sf, "nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    return joins.by_alternate_keys(left, right, F.array("s_nationkey", F.col("s_nationkey") + 100), F.array("nk", F.col("nk") + 50))


def defaulted_summary(s, sf):
    summary = T(s, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.with_summary(T(s, sf, "customer").select("c_custkey"), summary, "c_custkey", {"n_orders": 0})


def missing_report(s, sf):
    return joins.missing_targets(T(s, sf, "customer").select("c_custkey"), T(s, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def priority_lookup(s, sf):
    table = T(s, sf, "labels").where("quality = 1").select("doc_id", "toxic")
    d = T(s, sf, "documents").select("doc_id")
    return joins.priority_lookup(d, "doc_id", F.array(F.col("doc_id") + 1, F.col("doc_id"), F.col("doc_id") - 1), table.withColumnRenamed("doc_id", "k"), "k", "toxic")


def link_table(s, sf):
    return joins.link_table(T(s, sf, "documents").select(F.col("source").alias("key"), "text", "doc_id"), "key", "text", "doc_id", "doc_id").select("key", F.length("longest_text").alias("n"), "first_id")


def cache_split(s, sf):
    d = T(s, sf, "documents").select("doc_id", "lang")
    hit, miss = joins.cache_split(d, T(s, sf, "labels").select("doc_id", F.lit("en").alias("lang"), "quality"), ["doc_id", "lang"], "quality")
    return hit.unionByName(miss.withColumn("quality", F.lit(None).cast("int")))


def forced_rows(s, sf):
    found = T(s, sf, "labels").select("doc_id", "quality")
    forced = s.createDataFrame([(1, 9), (3, 9), (5, 9), (10**9, 9)], "doc_id long, quality int")
    return joins.force_rows(found, forced, T(s, sf, "documents"), ["doc_id"])


def range_collect(s, sf):
    lines = T(s, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("t"))
    ranges = T(s, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.struct(F.lit(1).alias("low"), F.lit(2).alias("high")), F.struct(F.lit(3).alias("low"), F.lit(5).alias("high")))).alias("r")).select("l_orderkey", "r.low", "r.high")
    return joins.collect_ranges(ranges, lines, ["l_orderkey"], "low", "high", "line", "t")


def group_first(s, sf):
    return aggregates.group_first(T(s, sf, "documents"), ["source"], ["doc_id", "lang"], "doc_id")


def group_lists(s, sf):
    g = aggregates.distinct_lists(T(s, sf, "events"), ["user_id"], ["event_type"], "event_type")
    return g.select("user_id", aggregates.shown("event_type").alias("types"), "n_event_type")


def keep_first(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.lower(text.normalize_ws("text")).alias("t"), "lang")
    return dedup.first_wins(d, ["t"], ["doc_id"]).select("doc_id", "lang")


def keep_longest(s, sf):
    return dedup.longest_wins(T(s, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "text", "turn")


def keep_shortest(s, sf):
    return dedup.shortest_text(T(s, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "text", "turn")


def split_dedup(s, sf):
    c = T(s, sf, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 5 == 0, "valid").otherwise("train").alias("split"))
    return dedup.across_splits(c, ["text", "lang"], F.when(F.col("split") == "train", 0).otherwise(1), "doc_id").select("doc_id", "split")


def cut_stats(s, sf):
    return aggregates.cut_counts(T(s, sf, "documents"), F.length("text") > 2000, F.col("lang") != "en")


def char_audit(s, sf):
    return aggregates.char_audit(T(s, sf, "documents"), "text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,\n").select("char", "n")


def majority_vote(s, sf):
    e = T(s, sf, "events").select("user_id", (F.col("event_id") % 3).alias("sample"), "event_type", "event_id")
    return aggregates.majority_vote(e, ["user_id"], "sample", "event_type", "event_id")


def usage_totals(s, sf):
    return aggregates.usage_totals(T(s, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("tokens"), "l_orderkey"), ["l_returnflag"], ["tokens"])


def distinct_keys(s, sf):
    return aggregates.distinct_keys(T(s, sf, "documents"), "source")


def vec_mean(s, sf):
    m = aggregates.vector_mean(T(s, sf, "embeddings"), ["label"], "embedding")
    return m.select("label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(63)), 6).alias("last"), F.size("embedding").alias("n"))


def fake_int8(s, sf):
    q = T(s, sf, "embeddings").select("vec_id", vectors.fake_int8("embedding").alias("q"))
    return q.select("vec_id", (F.round(F.aggregate("q", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


def row_index(s, sf):
    return windows.row_index(T(s, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], offset=1)


def prev_context(s, sf):
    return windows.context_prefix(T(s, sf, "conversations"), "conv_id", ["turn"], "text", 3, 400).select("conv_id", "turn", "context")


def adjacent_concat(s, sf):
    return windows.join_next(T(s, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], ["text"])


def quantile_bins(s, sf):
    return windows.quantile_bin(T(s, sf, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 20).select("doc_id", "bin")


def spread_folds(s, sf):
    return windows.spread_folds(T(s, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 4)


def group_folds(s, sf):
    f = windows.group_folds(T(s, sf, "conversations").select("conv_id", "turn"), "conv_id", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("conv_id").alias("n_groups"))


def shard_split(s, sf):
    return windows.contiguous_shard(T(s, sf, "documents").select("doc_id"), ["doc_id"], 7)


def byte_chunks(s, sf):
    return windows.byte_chunks(T(s, sf, "documents"), "text", ["doc_id"], 4096)


def leading_int_sort(s, sf):
    c = T(s, sf, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit("-"), (F.col("turn") + 2).cast("string")).alias("r"))
    return c.select("conv_id", "turn", windows.leading_int("r").alias("lead"), windows.line_key("r")["end"].alias("last"), windows.leading_int(F.lit("x")).alias("none"))


def top_k(s, sf):
    d = T(s, sf, "documents").select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    return windows.top_k(d, ["source"], [F.col("n_bytes").desc(), F.col("doc_id")], 3)


def seeded_sample(s, sf):
    return windows.seeded_sample(T(s, sf, "documents").select("doc_id"), "doc_id", 25)


def anchor_profile(s, sf):
    length, gap = windows.anchor_profile("text")
    return T(s, sf, "documents").select("doc_id", length.alias("target_chars"), gap.alias("has_gap"))


def union_plain(s, sf):
    return unions.concat(T(s, sf, "documents").select(F.col("doc_id").alias("id"), "text"), T(s, sf, "benchmark").select(F.col("item_id").alias("id"), "text")).select("id", F.length("text").alias("n"))


def union_diagonal(s, sf):
    return unions.concat_diagonal(T(s, sf, "labels"), T(s, sf, "documents").select("doc_id", "lang"))


def union_filled(s, sf):
    return unions.concat_filled(T(s, sf, "labels"), T(s, sf, "documents").select("doc_id", "lang"))


def union_tagged(s, sf):
    a = unions.tagged(T(s, sf, "documents"), "documents", {"id": "doc_id", "text": "text", "role": None}, ["text"])
    b = unions.tagged(T(s, sf, "conversations"), "conversations", {"id": "conv_id", "text": "text", "role": "role"}, ["text"])
    return a.unionByName(b).groupBy("source_dataset", "role").agg(F.count(F.lit(1)).alias("n"))


def pool_extend(s, sf):
    base = T(s, sf, "labels").select("doc_id", F.col("toxic").alias("fold"))
    return unions.extend_pool(base, T(s, sf, "documents").select("doc_id"), "doc_id")


def set_minus(s, sf):
    return unions.minus(T(s, sf, "customer").select(F.col("c_custkey").alias("k")), T(s, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


def page_lists(s, sf):
    d = T(s, sf, "documents").select("doc_id", F.concat(F.lit("3-1;"), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 7 == 0, "|x").otherwise("|2, 8-9")).alias("p"))
    return d.select("doc_id", F.array_join(F.transform(arrays.page_list("p"), lambda x: x.cast("string")), ",").alias("pages"))


def coverage_flags(s, sf):
    o = T(s, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    lines, ranges = F.array(F.array(F.lit(1), F.col("n"))), F.when(F.col("n") > 1, F.array(F.array(F.lit(2), F.least("n", F.lit(4))))).otherwise(F.array().cast("array<array<int>>"))
    return o.select("l_orderkey", arrays.coverage_flags(lines, ranges).alias("flags"))


def neighbour_window(s, sf):
    o = T(s, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("pages"))
    return o.select("l_orderkey", F.size(arrays.neighbour_pages(F.lit(3), F.col("pages"), 2)).alias("n"))


def json_field(s, sf):
    return T(s, sf, "events").select("event_id", arrays.json_text("props", "page").alias("page"))


_SHUFFLE = "md5(concat_ws(':', CAST({} AS VARCHAR), '42'))"
#: Groups in the order of their hash, each to the fold with the fewest rows so far, the first of equals.
GROUP_FOLDS_SQL = f"""
WITH RECURSIVE g AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY {_SHUFFLE.format('conv_id')}, CAST(conv_id AS VARCHAR)) AS at FROM conversations GROUP BY conv_id
), f AS (
  SELECT CAST(0 AS BIGINT) AS at, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS sizes, CAST(-1 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS n
  UNION ALL
  SELECT g.at, list_transform(range(1, 6), lambda k: sizes[k] + CASE WHEN k = list_position(sizes, list_min(sizes)) THEN g.n ELSE 0 END), list_position(sizes, list_min(sizes)) - 1, g.n
  FROM f JOIN g ON g.at = f.at + 1
)
SELECT CAST(fold AS INT) AS fold, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups FROM f WHERE fold >= 0 GROUP BY fold
"""
_LANGS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ., "

TABLE = {
    "fold_filter": (fold_filter, "WITH f AS (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 4 END AS fold FROM labels) SELECT doc_id, fold, CASE WHEN fold = 2 THEN 'held' ELSE 'rest' END AS side FROM f WHERE fold IS NOT NULL"),
    "member_filter": (member_filter, "SELECT doc_id, lang, CAST(lang IN ('de', 'fr') AS INT) AS inside FROM documents WHERE lang IS NOT NULL"),
    "nonblank_filter": (nonblank_filter, r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\S') AND regexp_matches(role, '\S')"),
    "placeholder_filter": (placeholder_filter, "SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(lower(text), 'and|ing')"),
    "ratio_filter": (ratio_filter, "SELECT doc_id FROM documents WHERE (doc_id % 900) / greatest(length(text), 1) BETWEEN 0.3 AND 4.0"),
    "value_swap": (value_swap, "SELECT d.doc_id, CASE WHEN toxic = 1 AND source IS NOT NULL THEN source ELSE lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "blank_coalesce": (blank_coalesce, "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang WHEN doc_id % 2 = 0 THEN source END AS value FROM documents"),
    "bool_text": (bool_text, "SELECT event_id, event_id % 4 = 0 AS is_false, event_id % 4 = 1 AS is_true FROM events"),
    "safe_int": (safe_int, "SELECT doc_id, CAST(source[4:] AS BIGINT) AS n, CAST(1000000000 AS BIGINT) AS bad FROM documents"),
    "reject_routing": (reject_routing, "SELECT doc_id, CASE WHEN length(text) < 60 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN contains(text, '###') THEN 'symbols' ELSE '' END AS skip_reason FROM documents"),
    "staged_exclusion": (staged_exclusion, "WITH r AS (SELECT CASE WHEN length(text) < 60 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN contains(text, '###') THEN 'symbols' END AS r FROM documents) SELECT count(*) AS n_total, count(*) FILTER (r IS NULL) AS n_kept, count(*) FILTER (r = 'short') AS n_short, count(*) FILTER (r = 'foreign') AS n_foreign, count(*) FILTER (r = 'symbols') AS n_symbols FROM r"),
    "column_contract": (column_contract, "SELECT trim(source) AS origin, '' AS note, doc_id FROM documents"),
    "direction_switch": (direction_switch, "SELECT doc_id, source AS prediction, lang AS target FROM documents"),
    "left_unique": (left_unique, "SELECT c_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "anti_known": (anti_known, "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)"),
    "semi_flag": (semi_flag, "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_toxic FROM documents"),
    "override_join": (override_join, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'override' ELSE n_name END AS n_name FROM nation"),
    "alt_key_join": (alt_key_join, "WITH k AS (SELECT s_suppkey, s_nationkey, unnest([s_nationkey, s_nationkey + 100]) AS k FROM supplier), n AS (SELECT n_nationkey AS nk, n_name, unnest([n_nationkey, n_nationkey + 50]) AS k FROM nation) SELECT DISTINCT s_suppkey, s_nationkey, nk, n_name FROM k LEFT JOIN n USING (k)"),
    "defaulted_summary": (defaulted_summary, "SELECT c_custkey, count(o_orderkey) AS n_orders, count(o_orderkey) > 0 AS found FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1"),
    "missing_report": (missing_report, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"),
    "priority_lookup": (priority_lookup, "WITH l AS (SELECT doc_id, toxic FROM labels WHERE quality = 1) SELECT d.doc_id, coalesce(a.toxic, b.toxic, c.toxic) AS toxic FROM documents d LEFT JOIN l a ON a.doc_id = d.doc_id + 1 LEFT JOIN l b ON b.doc_id = d.doc_id LEFT JOIN l c ON c.doc_id = d.doc_id - 1"),
    "link_table": (link_table, "SELECT lower(source) AS key, max(length(text)) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"),
    "cache_split": (cache_split, "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'"),
    "forced_rows": (forced_rows, "SELECT doc_id, quality FROM labels UNION ALL SELECT v.k, 9 FROM (VALUES (1), (3), (5), (1000000000)) v(k) WHERE k IN (SELECT doc_id FROM documents) AND k NOT IN (SELECT doc_id FROM labels)"),
    "range_collect": (range_collect, "WITH r(low, high) AS (VALUES (1, 2), (3, 5)) SELECT l_orderkey, low, high, string_agg('p' || l_partkey, ' ' ORDER BY l_linenumber, 'p' || l_partkey) AS t FROM lineitem JOIN r ON l_linenumber BETWEEN low AND high WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL"),
    "group_first": (group_first, "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1"),
    "group_lists": (group_lists, "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types, count(DISTINCT event_type) AS n_event_type FROM events GROUP BY 1"),
    "keep_first": (keep_first, r"SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"),
    "keep_longest": (keep_longest, "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1"),
    "keep_shortest": (keep_shortest, "SELECT conv_id, min(turn) AS turn, first(text ORDER BY length(text), turn) AS text FROM conversations GROUP BY 1"),
    "split_dedup": (split_dedup, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY CAST(doc_id % 5 = 0 AS INT), doc_id) = 1"),
    "cut_stats": (cut_stats, "SELECT count(*) AS n_rows, count(*) FILTER (length(text) > 2000) AS n_a, count(*) FILTER (lang <> 'en') AS n_b, count(*) FILTER (length(text) > 2000 OR lang <> 'en') AS n_any FROM documents"),
    "char_audit": (char_audit, f"SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND NOT contains('{_LANGS}' || chr(10), c) GROUP BY 1"),
    "majority_vote": (majority_vote, "WITH n AS (SELECT user_id, count(DISTINCT event_id % 3) AS n FROM events GROUP BY 1), v AS (SELECT user_id, event_type, count(DISTINCT event_id % 3) AS votes, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT v.* FROM v JOIN n USING (user_id) WHERE votes >= greatest(1, ceil(n * 0.5))"),
    "usage_totals": (usage_totals, "SELECT l_returnflag, CAST(sum(trunc(l_quantity)) AS BIGINT) AS tokens, count(*) AS requests FROM lineitem GROUP BY 1"),
    "distinct_keys": (distinct_keys, "SELECT DISTINCT source FROM documents WHERE trim(source) <> ''"),
    "vec_mean": (vec_mean, "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last, 64 AS n FROM embeddings GROUP BY 1"),
    "fake_int8": (fake_int8, "WITH s AS (SELECT vec_id, embedding AS e, 127.0::DOUBLE / greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-10) AS k FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: greatest(-128.0, least(127.0, round_even(x::DOUBLE * k, 0))) / k)), 5) + 0.0 AS total FROM s"),
    "row_index": (row_index, "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS row_index FROM documents"),
    "prev_context": (prev_context, "WITH w AS (SELECT conv_id, turn, list(text) OVER p AS l FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), f AS (SELECT conv_id, turn, l, CASE WHEN len(l) >= 3 AND 22 + strlen(l[-1]) + strlen(l[-2]) + strlen(l[-3]) + 14 <= 400 THEN 3 WHEN len(l) >= 2 AND 22 + strlen(l[-1]) + strlen(l[-2]) + 7 <= 400 THEN 2 WHEN len(l) >= 1 AND 22 + strlen(l[-1]) <= 400 THEN 1 ELSE 0 END AS n FROM w) SELECT conv_id, turn, CASE WHEN n = 0 THEN '' ELSE '[context] ' || array_to_string(l[len(l) - n + 1:], ' [sep] ') || ' [/context] ' END AS context FROM f"),
    "adjacent_concat": (adjacent_concat, "SELECT conv_id, turn, text || ' ' || next AS text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL"),
    "quantile_bins": (quantile_bins, "SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 20 // count(*) OVER () AS INT) AS bin FROM documents"),
    "spread_folds": (spread_folds, f"SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {_SHUFFLE.format('doc_id')}, doc_id) - 1) % 4 AS INT) AS fold FROM documents"),
    "group_folds": (group_folds, GROUP_FOLDS_SQL),
    "shard_split": (shard_split, "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents"),
    "byte_chunks": (byte_chunks, "WITH s AS (SELECT sum(strlen(text) + 1) OVER (ORDER BY doc_id) AS e, strlen(text) + 1 AS b, sum(strlen(text) + 1) OVER () AS t FROM documents), p AS (SELECT CAST(e - b AS BIGINT) AS a, CAST(e AS BIGINT) AS e, t, unnest(range(CAST(e - b AS BIGINT) // 4096, (CAST(e AS BIGINT) - 1) // 4096 + 1)) AS chunk FROM s) SELECT chunk, CAST(sum(least(e, (chunk + 1) * 4096) - greatest(a, chunk * 4096)) AS BIGINT) AS n_bytes, count(*) AS n_texts FROM p WHERE (chunk + 1) * 4096 <= t GROUP BY 1"),
    "leading_int_sort": (leading_int_sort, 'SELECT conv_id, turn, turn AS "lead", turn + 2 AS "last", CAST(0 AS BIGINT) AS "none" FROM conversations'),
    "top_k": (top_k, "SELECT * FROM (SELECT doc_id, source, strlen(text) AS n_bytes, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"),
    "seeded_sample": (seeded_sample, f"SELECT doc_id FROM documents ORDER BY {_SHUFFLE.format('doc_id')}, doc_id LIMIT 25"),
    "anchor_profile": (anchor_profile, "SELECT doc_id, greatest(40, least(2400, length(text))) AS target_chars, contains(text, '<gap>') AS has_gap FROM documents"),
    "union_plain": (union_plain, "SELECT doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT item_id, length(text) FROM benchmark"),
    "union_diagonal": (union_diagonal, "SELECT doc_id, quality, toxic, NULL AS lang FROM labels UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents"),
    "union_filled": (union_filled, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, '' AS lang FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), '', '', lang FROM documents"),
    "union_tagged": (union_tagged, r"SELECT 'documents' AS source_dataset, NULL AS role, count(*) AS n FROM documents WHERE regexp_matches(text, '\S') UNION ALL SELECT 'conversations', role, count(*) FROM conversations WHERE regexp_matches(text, '\S') GROUP BY role"),
    "pool_extend": (pool_extend, "SELECT doc_id, toxic AS fold FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "set_minus": (set_minus, "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"),
    "page_lists": (page_lists, "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 9 IN (1, 2, 3) THEN '1,2,3,8,9' WHEN doc_id % 9 = 8 THEN '1,2,3,8,9' ELSE '1,2,3,' || (doc_id % 9) || ',8,9' END AS pages FROM documents"),
    "coverage_flags": (coverage_flags, "WITH o AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n = 1 THEN 'missing_translation' ELSE 'missing_translation_range:1' || array_to_string(list_transform(range(5, n + 1), lambda x: ',' || x), '') END AS flags FROM o"),
    "neighbour_window": (neighbour_window, "SELECT l_orderkey, CAST(count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 3 AND 5) AS INT) AS n FROM lineitem GROUP BY 1"),
    "json_field": (json_field, "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.page')), ''), props) AS page FROM events"),
}
