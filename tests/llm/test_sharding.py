import zlib
from collections import Counter, defaultdict

from corpusloom.llm import sharding


def check(docs, shards=40):
    rows = sharding.shard_by_bytes(docs, shards).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= largest
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
    return rows


def test_shards(spark, table, messy):
    check(table("documents"))
    check(messy, 3)
    assert sharding.shard_by_bytes(messy.limit(0)).count() == 0


def test_shard_and_slot_by_brute_force(spark, table):
    """Rows in order of the text's hash and the id; the middle of a row's bytes says its shard."""
    import xxhash

    def signed(text):
        h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
        return h - 2**64 if h >= 2**63 else h

    rows = [(signed(r["text"]), r["doc_id"], len((r["text"] or "").encode()) + 16) for r in table("documents").select("doc_id", "text").collect()]
    total, at, slots, expected = sum(r[2] for r in rows), 0, defaultdict(int), {}
    for _, i, size in sorted(rows):
        shard = (2 * at + size) * 40 // (2 * total)
        expected[i] = (shard, slots[shard])
        slots[shard] += 1
        at += size
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_by_bytes(table("documents")).collect()} == expected


def test_copies_stand_together(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text")
    rows = check(df, 40)
    hot = sorted({r["shard"] for r in rows if r["doc_id"] % 3 == 0})
    assert hot == list(range(hot[0], hot[-1] + 1)) and len(hot) < 20


def test_same_for_any_partitioning(spark, table):
    results = {tuple(sorted(map(tuple, sharding.shard_by_bytes(table("documents").repartition(n)).collect()))) for n in (1, 5)}
    assert len(results) == 1


def test_no_python_on_the_main_path(spark, sf):
    plan = sharding.op6_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
