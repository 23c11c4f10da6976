"""WARC records, and resolution of not-modified revisits.

A revisit record (status 304) has no body. It is resolved to the latest earlier full response of the same canonical URL:
an as-of join. Rows get a total order (URL key, time, id) and are spread by a range exchange over that whole order, so a URL
with a third of all captures is split too. In each partition a window carries the last response of the key down; across
partitions only the last response of each partition's last key is passed on, one row for each. Validators decide: equal
entity tags (weak comparison), or, where a side has no tag, equal Last-Modified dates. The resolved record has the
response's headers with those of the 304 laid over them, but for the ones RFC 9111 (3.1, 3.2) keeps from updating a stored
response: fields of the connection and those it names, of proxy authentication, and those that describe the stored body.

Cases: captures with a null or unparsable URL have the empty key and are resolved by nothing; a revisit without a time
is not resolved and a response without one resolves nothing; of responses at the same time the one with the larger id is
later, and a response at the time of a revisit counts as earlier; repeated rows are resolved one by one; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import materialize, read

# Header fields a 304 doesn't update in the stored response; those named by its Connection field are others.
EXCLUDED = (
    "connection", "proxy-connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "content-encoding", "content-length", "content-range", "content-type",
)
#: Bytes unpacked at a time.
CHUNK = 1 << 20

RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.BinaryType()),
])


def _headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines are joined, repeated fields by a comma."""
    out: dict[str, str] = {}
    last = ""
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def unpacked(data: bytes) -> Iterator[bytes]:
    """The data in chunks; gzipped data unpacked, whether it has one member for each record or for all."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield data[at : at + CHUNK]
        return
    member, at = zlib.decompressobj(31), 0
    while at < len(data) or member.unconsumed_tail:
        rest = member.unconsumed_tail
        if not rest:
            rest, at = data[at : at + CHUNK], min(at + CHUNK, len(data))
        yield member.decompress(rest, CHUNK)
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)
    yield member.flush()  # of a file that ends inside a member


def _record(warc: dict[str, str], content: bytes, offset: int) -> dict:
    status, headers, body = None, {}, content
    if warc.get("content-type", "").startswith("application/http") and content.startswith(b"HTTP/"):
        head, _, body = content.partition(b"\r\n\r\n")
        first, _, rest = head.partition(b"\r\n")
        words = first.split()
        status, headers = int(words[1]) if len(words) > 1 and words[1].isdigit() else None, _headers(rest)
    return {
        "offset": offset, "warc_type": warc.get("warc-type"), "record_id": warc.get("warc-record-id"), "url": (warc.get("warc-target-uri") or "").strip("<>") or None,
        "date": warc.get("warc-date"), "refers_to": warc.get("warc-refers-to"), "status": status, "headers": headers, "body": body,
    }


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped. One record is held at a time beside the packed data; a cut-off one ends the file."""
    buffer, start, chunks = bytearray(), 0, unpacked(data)  # start: of the buffer, in the unpacked file
    warc: dict[str, str] | None = None
    while True:
        if warc is None:
            at = buffer.find(b"WARC/")
            end = buffer.find(b"\r\n\r\n", at) if at >= 0 else -1
            if end >= 0:
                warc, offset = _headers(bytes(buffer[at:end])), start + at
                size = warc.get("content-length") or "0"
                length = int(size) if size.isdigit() else 0
                del buffer[: end + 4]
                start += end + 4
                continue
            if at < 0 and len(buffer) > 4:  # a sign may lie across two chunks
                start += len(buffer) - 4
                del buffer[:-4]
        elif len(buffer) >= length:
            yield _record(warc, bytes(buffer[:length]), offset)
            del buffer[:length]
            start += length
            warc = None
            continue
        chunk = next(chunks, None)
        if chunk is None:
            return
        buffer += chunk


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, one task for each file, which holds the packed file (2 GB at most) and a record; offset: in the unpacked file."""
    fields = {f.name: f for f in RECORD.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for record in parse_warc(content.as_py()):
                    rows.append(record | {"path": name, "headers": list(record["headers"].items())})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, T.StructType(list(fields.values())))


def write_warc_record(warc_type: str, record_id: str, url: str, date: str, http: bytes, refers_to: str | None = None) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {warc_type}".encode(), f"WARC-Record-ID: {record_id}".encode(), f"WARC-Target-URI: {url}".encode(), f"WARC-Date: {date}".encode()]
    if refers_to:
        lines.append(f"WARC-Refers-To: {refers_to}".encode())
    lines += [b"Content-Type: application/http", f"Content-Length: {len(http)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + http + b"\r\n\r\n"


# Steps of the canonical form, pattern and replacement, in this order; the URL is trimmed first.
CANONICAL = (
    (r"#.*$", ""),  # fragment
    (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),  # scheme
    (r"^[^/?]*@", ""),  # user information
    (r"^([^/?]*):(80|443)($|[/?])", r"$1$3"),  # default ports
    (r"([?&])(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*", r"$1"),  # tracking parameters
    (r"[&]+", "&"),
    (r"[?]&", "?"),
    (r"[?&]+$", ""),
    (r"/(index|default)[.](html?|php|aspx?)($|[?])", r"/$3"),
    (r"/+($|[?])", r"$1"),  # trailing slash
)


def canonical_url(url: Column | str) -> Column:
    """URL key: without scheme, user, default port, www, fragment, tracking parameters, index page and trailing slash."""
    out = F.trim(F.col(url) if isinstance(url, str) else url)
    for pattern, to in CANONICAL:
        out = F.regexp_replace(out, pattern, to)
    host = F.regexp_replace(F.lower(F.regexp_extract(out, r"^[^/?]*", 0)), r"^www[0-9]*[.]", "")
    return F.coalesce(F.concat(host, F.regexp_extract(out, r"^[^/?]*(.*)$", 1)), F.lit(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def merged_headers(stored: Column, update: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """The stored headers with those of the update laid over them that are not excluded."""
    given = F.coalesce(update, F.create_map().cast("map<string,string>"))
    named = F.transform(F.split(F.lower(F.coalesce(given["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    new = F.map_filter(given, lambda k, v: ~k.isin(*excluded) & ~F.array_contains(named, k) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def captures_of_records(records: DataFrame) -> DataFrame:
    """Captures for resolve_revisits() of read_warc()'s rows: id (the record's), url, ts (microseconds), status, headers.

    A response is a capture with its own status; of revisits those with a status of 304 are, others have a body elsewhere.
    """
    wanted = (F.col("warc_type") == "response") | ((F.col("warc_type") == "revisit") & (F.col("status") == 304))
    return records.where(wanted).select(F.col("record_id").alias("id"), "url", F.unix_micros(F.try_to_timestamp(F.col("date"))).alias("ts"), "status", "headers")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures: id, url, ts, status, headers (map, lower-case names). One row for each revisit (status 304).

    Columns: id, url_key, ts, resolution (etag, last-modified, mismatch or none), matched_id and matched_ts (of the
    latest earlier response), headers (merged; null unless the validators agree).
    """
    full = (F.col("status") == 200) & F.col("ts").isNotNull()
    keyed = captures.select("id", canonical_url("url").alias("url_key"), "ts", "status", "headers").where(full | (F.col("status") == 304))
    response = F.struct(F.col("id").alias("id"), F.col("ts").alias("ts"), F.col("headers").alias("headers"))
    rows = keyed.select("*", F.when(full, 0).otherwise(1).alias("late")).repartitionByRange("url_key", "ts", "late", "id").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "captures")
    order = Window.partitionBy("part", "url_key").orderBy("ts", "late", "id")
    near = rows.withColumn("near", F.last(F.when(full, response), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # A row per partition: its last key, and that key's last response. Keys that go on are the last of a partition.
    ends = rows.groupBy("part").agg(F.max("url_key").alias("key"), F.min("url_key").alias("first_key"))
    tails = rows.where(full).groupBy("part", "url_key").agg(F.max_by(response, F.struct("ts", "id")).alias("tail"))
    carried = ends.join(tails, (ends["part"] == tails["part"]) & (F.col("key") == F.col("url_key")), "left").select(ends["part"].alias("p"), "key", "first_key", "tail")
    # The key of a partition's start may have begun in any earlier one, all between hold nothing else.
    by_key = Window.partitionBy("key").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = carried.withColumn("tail", F.last("tail", ignorenulls=True).over(by_key)).select(F.col("p").alias("tail_part"), F.col("key").alias("tail_key"), "tail")
    starts = carried.select("p", "first_key").join(last, (F.col("first_key") == F.col("tail_key")) & (F.col("tail_part") < F.col("p")), "left")
    far = starts.groupBy("p", "first_key").agg(F.max_by("tail", "tail_part").alias("far"))
    joined = near.where(F.col("status") == 304).join(far, (F.col("part") == F.col("p")) & (F.col("url_key") == F.col("first_key")), "left")
    found = joined.withColumn("match", F.when((F.col("url_key") != "") & F.col("ts").isNotNull(), F.coalesce("near", "far")))
    there = F.col("match.headers")
    by_tag = _tag(F.col("headers")) == _tag(there)
    no_tag = F.col("headers")["etag"].isNull() | there["etag"].isNull()
    by_date = F.col("headers")["last-modified"] == there["last-modified"]
    resolution = F.when(F.col("match").isNull(), "none").when(by_tag, "etag").when(no_tag & by_date, "last-modified").otherwise("mismatch")
    found = found.withColumn("resolution", resolution)
    merged = F.when(F.col("resolution").isin("etag", "last-modified"), merged_headers(there, F.col("headers")))
    return found.select("id", "url_key", "ts", "resolution", F.col("match.id").alias("matched_id"), F.col("match.ts").alias("matched_ts"), merged.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures in the life of each page, at eight times its id and a little more, so that pages of one URL interleave.

    A full response with an entity tag; a revisit with the tag, weakly; a second response, of every third page with a date
    only, else with another tag; a revisit with that date, that tag, or a tag that fits neither. Every fourth page has a
    revisit before all these too, which an earlier page of the URL resolves, or none.
    """
    text = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(F.encode(text, "UTF-8")), F.lit('"'))
    page = F.col("page_id")
    date = F.concat(F.lit("day "), page)
    full = {"content-type": F.lit("text/html"), "content-length": F.octet_length(text).cast("string"), "cache-control": F.lit("max-age=60"), "link": F.lit("</a>; rel=prev")}
    bare = {"content-length": F.lit("0"), "cache-control": F.lit("max-age=120"), "connection": F.lit("close, X-Hop"), "x-hop": F.lit("1")}
    second = {"etag": F.when(page % 3 != 0, F.concat(F.lit('"2'), tag)), "last-modified": F.when(page % 3 == 0, date)}
    events = (
        (page % 4 == 0, 7, 304, bare | {"etag": tag}, -1),
        (F.lit(True), 0, 200, full | {"etag": tag, "last-modified": date}, 0),
        (F.lit(True), 1, 304, bare | {"etag": F.concat(F.lit("W/"), tag), "link": F.lit("</b>; rel=next")}, 2),
        (F.lit(True), 2, 200, full | second, 4),
        (F.lit(True), 3, 304, bare | {"etag": F.when(page % 3 == 1, second["etag"]).when(page % 3 == 2, F.lit('"other"')), "last-modified": second["last-modified"]}, 6),
    )
    rows = []
    for there, number, status, headers, after in events:
        at = 8 * page + after
        named = headers | {"date": at.cast("string")}
        as_map = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values())), lambda k, v: v.isNotNull())
        rows.append(F.when(there, F.struct((8 * page + number).alias("id"), at.alias("ts"), F.lit(status).alias("status"), as_map.alias("headers"))))
    either = F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c")
    return pages.select("url", either).select("c.id", "url", "c.ts", "c.status", "c.headers")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select(F.expr("id div 8").alias("page_id"), F.expr("int(id % 8)").alias("capture"), "url_key", "resolution", F.expr("matched_id div 8").alias("matched_page"), F.expr("int(matched_id % 8)").alias("matched_capture"), F.array_join(lines, "\n").alias("headers"))


def _canonical_sql(url: str) -> str:
    out = f"trim({url}, ' ')"
    for pattern, to in CANONICAL:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return out


_FULL = "'content-type': 'text/html', 'content-length': size, 'cache-control': 'max-age=60', 'link': '</a>; rel=prev'"
_BARE = "'content-length': '0', 'cache-control': 'max-age=120', 'connection': 'close, X-Hop', 'x-hop': '1'"
_SECOND = "CASE WHEN page_id % 3 <> 0 THEN '\"2' || tag END"
_DATED = "CASE WHEN page_id % 3 = 0 THEN 'day ' || page_id END"
_EVENTS = (
    ("page_id % 4 = 0", 7, 304, f"{_BARE}, 'etag': tag", -1),
    ("true", 0, 200, f"{_FULL}, 'etag': tag, 'last-modified': 'day ' || page_id", 0),
    ("true", 1, 304, f"{_BARE}, 'etag': 'W/' || tag, 'link': '</b>; rel=next'", 2),
    ("true", 2, 200, f"{_FULL}, 'etag': {_SECOND}, 'last-modified': {_DATED}", 4),
    ("true", 3, 304, f"{_BARE}, 'etag': CASE page_id % 3 WHEN 1 THEN {_SECOND} WHEN 2 THEN '\"other\"' END, 'last-modified': {_DATED}", 6),
)
WARC_SQL = rf"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, {_canonical_sql("url")} AS u FROM pages
), p AS (
  SELECT page_id, '"' || md5(html) || '"' AS tag, CAST(strlen(html) AS VARCHAR) AS size,
    coalesce(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www[0-9]*[.]', '') || regexp_extract(u, '^[^/?]*(.*)$', 1), '') AS url_key FROM a
), c AS (
  {" UNION ALL ".join(f"SELECT 8 * page_id + {n} AS id, url_key, 8 * page_id + ({at}) AS ts, {status} AS status, MAP {{{headers}, 'date': CAST(8 * page_id + ({at}) AS VARCHAR)}} AS headers FROM p WHERE {there}" for there, n, status, headers, at in _EVENTS)}
), h AS (SELECT * REPLACE (map_from_entries(list_filter(map_entries(headers), lambda e: e.value IS NOT NULL)) AS headers) FROM c
), m AS (
  SELECT r.id, r.url_key, f.id AS other, r.headers AS mine, f.headers AS theirs
  FROM (SELECT * FROM h WHERE status = 304) r ASOF LEFT JOIN (SELECT * FROM h WHERE status = 200 AND url_key <> '') f ON r.url_key = f.url_key AND r.ts >= f.ts
), v AS (
  SELECT *, CASE WHEN other IS NULL THEN 'none' WHEN regexp_replace(mine['etag'], '^W/', '') = regexp_replace(theirs['etag'], '^W/', '') THEN 'etag'
    WHEN (mine['etag'] IS NULL OR theirs['etag'] IS NULL) AND mine['last-modified'] = theirs['last-modified'] THEN 'last-modified' ELSE 'mismatch' END AS resolution
  FROM m
)
SELECT id // 8 AS page_id, CAST(id % 8 AS INT) AS capture, url_key, resolution, other // 8 AS matched_page, CAST(other % 8 AS INT) AS matched_capture,
  CASE WHEN resolution IN ('etag', 'last-modified') THEN array_to_string(list_sort(list_transform(map_entries(map_concat(theirs,
    map_from_entries(list_filter(map_entries(mine), lambda e: e.key NOT IN ({", ".join(f"'{x}'" for x in (*EXCLUDED, 'x-hop'))}))))), lambda e: e.key || ': ' || e.value)), chr(10)) END AS headers
FROM v
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": WARC_SQL}
