import gzip

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc


def http(status, headers, body=b""):
    return f"HTTP/1.1 {status} X\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body


def test_round_trip(spark, tmp_path):
    records = [("response", "<a>", "http://h/x", "2024-01-01T00:00:00Z", http(200, {"ETag": '"1"', "Content-Type": "text/html"}, b"one\r\n\r\ntwo"), None), ("revisit", "<b>", "http://h/x", "2024-02-01T00:00:00Z", http(304, {"ETag": '"1"'}), "<a>")]
    data = [warc.write_warc_record(*r) for r in records]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    rows = warc.read_warc(spark, str(tmp_path / "*")).orderBy("path", "offset").collect()
    assert len(rows) == 4
    for a, b in (rows[:2], rows[2:]):
        assert (a["warc_type"], a["status"], bytes(a["body"]), a["headers"]["etag"]) == ("response", 200, b"one\r\n\r\ntwo", '"1"')
        assert (b["warc_type"], b["status"], b["refers_to"], b["url"]) == ("revisit", 304, "<a>", "http://h/x")


@pytest.mark.parametrize("packed", [bytes, gzip.compress, None])
def test_large_and_cut_off_files(packed):
    """Records longer than a chunk, one member for all or one for each, and a file that ends inside a record."""
    records = [warc.write_warc_record("response", f"<{k}>", "http://h/", "2024-01-01T00:00:00Z", http(200, {}, bytes([65 + k]) * (700_000 * k))) for k in range(6)]
    data = b"".join(map(gzip.compress, records)) if packed is None else packed(b"".join(records))
    got = list(warc.parse_warc(data))
    assert [(r["record_id"], len(r["body"])) for r in got] == [(f"<{k}>", 700_000 * k) for k in range(6)]
    assert [r["offset"] for r in got] == [sum(map(len, records[:k])) for k in range(6)]
    assert [r["record_id"] for r in warc.parse_warc(b"".join(records)[:-1000])] == [f"<{k}>" for k in range(5)]
    assert list(warc.parse_warc(b"")) == list(warc.parse_warc(b"WARC")) == []


def test_records_of_a_file_are_resolved(spark, tmp_path):
    """From the bytes of a file to merged headers: a response, its revisit, one that an older response can't resolve, a copy elsewhere."""
    at = "2024-0{}-01T00:00:00Z"
    records = [
        ("response", "<a>", "http://h/x", at.format(1), http(200, {"ETag": '"1"', "Content-Type": "text/html", "Link": "<old>", "Content-Language": "en"}, b"one"), None),
        ("revisit", "<b>", "https://www.h/x/", at.format(2), http(304, {"ETag": 'W/"1"', "Link": "<new>", "Content-Type": "x/y", "Connection": "Keep-Me-Out", "Keep-Me-Out": "1"}), "<a>"),
        ("response", "<c>", "http://h/x", at.format(3), http(200, {"ETag": '"2"'}, b"two"), None),
        ("revisit", "<d>", "http://h/x", at.format(4), http(304, {"ETag": '"1"'}), "<a>"),
        ("revisit", "<e>", "http://h/x", at.format(5), http(200, {"ETag": '"2"'}), "<c>"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(warc.write_warc_record(*r) for r in records)))
    out = warc.resolve_revisits(warc.captures_of_records(warc.read_warc(spark, str(tmp_path / "*.gz"))))
    got = {r["id"]: (r["resolution"], r["matched_id"], r["headers"]) for r in out.collect()}
    assert got == {"<b>": ("etag", "<a>", {"etag": 'W/"1"', "content-type": "text/html", "link": "<new>", "content-language": "en"}), "<d>": ("mismatch", "<c>", None)}


def test_query_meets_every_case(spark, sf):
    counts = {(r["resolution"], r["capture"]): r["count"] for r in warc.op2_warc(spark, sf).groupBy("resolution", "capture").count().collect()}
    assert {how for how, _ in counts} == {"etag", "last-modified", "mismatch", "none"}


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://Example.com/a/", "example.com/a"), ("https://www.example.com:443/a#top", "example.com/a"), ("http://u:p@example.com/a/index.html", "example.com/a"),
        ("http://example.com/a?utm_source=x&b=1&ref=y", "example.com/a?b=1"), ("http://example.com/?ref=z", "example.com"), ("http://e.com/A?x=1", "e.com/A?x=1"), (None, ""), ("", ""),
    ],
)
def test_canonical(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url("u")).first()[0] == key


def brute(rows):
    """rows: id, key, ts, status, headers."""
    out = {}
    for i, key, ts, status, headers in rows:
        if status != 304:
            continue
        before = [(t, j, h) for j, k, t, s, h in rows if s == 200 and k == key and key and ts is not None and t is not None and t <= ts]
        if not before:
            out[i] = ("none", None, None)
            continue
        _, j, h = max(before, key=lambda x: x[:2])
        tag = lambda x: x.get("etag", "").removeprefix("W/")
        both = "etag" in h and "etag" in headers
        how = "etag" if both and tag(h) == tag(headers) else "last-modified" if not both and "last-modified" in h and h["last-modified"] == headers.get("last-modified") else "mismatch"
        merged = None if how == "mismatch" else h | {k: v for k, v in headers.items() if k not in (*warc.EXCLUDED, "x-hop")}
        out[i] = (how, j, merged)
    return out


def test_by_brute_force(spark):
    import random

    rng = random.Random(0)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        headers = {"etag": ('W/"%d"' if rng.random() < 0.3 else '"%d"') % rng.randrange(3)} if rng.random() < 0.8 else {}
        headers |= {"last-modified": str(rng.randrange(2)), "date": str(i), "content-length": "0", "x-other": str(i), "connection": "X-Hop , close", "x-hop": "1"}
        rows.append((i, key, rng.randrange(400) if rng.random() < 0.98 else None, rng.choice((200, 304, 304, 404)), headers))
    df = spark.createDataFrame([(i, f"http://{k}/", t, s, h) for i, k, t, s, h in rows], "id long, url string, ts long, status int, headers map<string,string>")
    got = {r["id"]: (r["resolution"], r["matched_id"], r["headers"]) for r in warc.resolve_revisits(df.repartition(7)).collect()}
    assert got == brute(rows)


def test_odd_captures(spark):
    rows = [(1, None, 1, 200, {"etag": "a"}), (2, None, 2, 304, {"etag": "a"}), (3, "http://x/", None, 304, {"etag": "a"}), (4, "http://x/", 5, 200, None), (5, "http://x/", 6, 304, None), (5, "http://x/", 6, 304, None)]
    df = spark.createDataFrame(rows, "id long, url string, ts long, status int, headers map<string,string>").withColumn("part", F.lit("clash"))
    got = sorted((r["id"], r["resolution"]) for r in warc.resolve_revisits(df).collect())
    assert got == [(2, "none"), (3, "none"), (5, "mismatch"), (5, "mismatch")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0
