"""Resolution of WARC records that say "not modified".

A revisit record stands for the body of an earlier capture. It is resolved to the latest earlier full response of the
same canonical URL, an as-of join: both kinds of record are one stream by URL and time, and each revisit takes the last
response before it. The stream is cut into ranges of time, so that a URL with very many captures is spread over tasks:
the last response of each range is carried into the ranges after it, and a window inside each range does the rest.

The response answers only if the revisit's validators fit: entity tags by weak comparison, without them the time of
the last modification, without it the digest of the body. Headers are merged as a cache does: permitted ones come from
the revisit, all others from the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a "not modified" answer may replace.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not select content.
IGNORED = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without `www.` or default port, whatever the scheme; no fragment, tracking parameters or closing slash; parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(?:[^@]*@)?(?:www\.)?", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(f"^{IGNORED}(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """(record_id, canonical_url, captured_at, source_id, outcome, headers, payload_digest): one row per revisit.

    `records` has record_id (long), record_type ('response' or 'revisit'; others are left out), url, captured_at (long or
    timestamp), status (int; 200 is a full response), headers (map with lower-case names) and payload_digest. Earlier
    means strictly earlier; of responses at one time the one with the greatest id counts. outcome is 'resolved',
    'no_response', 'mismatch' (a validator differs) or 'unverified' (there is none to compare); source_id, the merged
    headers (null ones are empty) and the response's digest are given for 'resolved', the revisit's own otherwise. Rows without URL
    or time can't be placed: such revisits have no response, such responses serve none. Equal records are kept apart.
    """
    spark = records.sparkSession
    url = canonical_url(F.col("url"))
    is_response = (F.col("record_type") == "response") & (F.col("status") == 200)
    placed = records.where((F.col("record_type") == "revisit") | is_response).select(
        url.alias("u"), "captured_at", is_response.alias("full"), "record_id", "headers", "payload_digest"
    )
    ranges = ranges or min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / ranges for i in range(1, ranges)]
    bounds = records.agg(F.percentile_approx("captured_at", at, 10_000)).first()[0] if at else None
    cuts = F.array(*(F.lit(x) for x in sorted(set(bounds or []))))
    part = F.size(F.filter(cuts, lambda x: x < F.col("captured_at"))) if bounds else F.lit(0)
    usable = F.col("u").isNotNull() & F.col("captured_at").isNotNull()
    # a revisit needs its headers, a response what it answers with: one struct serves the window
    held = F.when(F.col("full"), F.struct("captured_at", "record_id", "headers", "payload_digest"))
    stream = placed.where(usable).select("*", part.alias("part"), held.alias("held"))
    latest = F.max_by("held", F.struct("captured_at", "record_id"))
    last = stream.where("full").groupBy("u", "part").agg(latest.alias("own"))
    # last response before each range in which the URL occurs
    by_part = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = stream.where("not full").select("u", "part").distinct().select("*", F.lit(None).cast(last.schema["own"].dataType).alias("own"))
    carried = last.unionByName(seen).groupBy("u", "part").agg(F.first("own", True).alias("own")).select("u", "part", F.last("own", True).over(by_part).alias("before"))
    inside = Window.partitionBy("u", "part").orderBy("captured_at", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = stream.select("*", F.last("held", True).over(inside).alias("near")).where("not full").join(carried, ["u", "part"], "left")
    answered = joined.select("u", "captured_at", "record_id", "headers", "payload_digest", F.coalesce("near", "before").alias("r"))
    lost = placed.where(~usable & ~F.col("full")).select("u", "captured_at", "record_id", "headers", "payload_digest", F.lit(None).cast(last.schema["own"].dataType).alias("r"))
    both = answered.unionByName(lost)

    def header(of: str, name: str) -> Column:
        return F.expr(f"try_element_at({of}, '{name}')")

    strong = lambda x: F.regexp_replace(F.trim(x), "^W/", "")
    tag, time = header("headers", "etag"), header("headers", "last-modified")
    fits = (
        F.when(tag.isNotNull() & header("r.headers", "etag").isNotNull(), strong(tag) == strong(header("r.headers", "etag")))
        .when(time.isNotNull() & header("r.headers", "last-modified").isNotNull(), time == header("r.headers", "last-modified"))
        .when(F.col("payload_digest").isNotNull() & F.col("r.payload_digest").isNotNull(), F.col("payload_digest") == F.col("r.payload_digest"))
    )
    outcome = (
        F.when(F.col("r").isNull(), "no_response").when(fits.isNull(), "unverified").when(fits, "resolved").otherwise("mismatch")
    )
    none = F.create_map().cast("map<string,string>")
    permitted = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(PERMITTED))
    others = F.map_filter(F.coalesce("r.headers", none), lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    merged = F.map_concat(others, permitted)
    done = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id",
        F.col("u").alias("canonical_url"),
        "captured_at",
        F.when(done, F.col("r.record_id")).alias("source_id"),
        "outcome",
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("r.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def header_lines(headers: Column) -> Column:
    """name: value lines by name, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "; ")


def records_of(pages: DataFrame) -> DataFrame:
    """The crawl that the `pages` table is taken to be: each page is captured in full and asked for again later.

    Page p is captured at second 10 * p with its digest as entity tag, and asked for again at second 10 * p + 25 with a
    weak tag; every fifth question has another tag, every seventh only the time of the last modification, every
    eleventh page answered 404 at first. Cache-Control and Server differ, one being permitted and the other not.
    """
    p, digest = F.col("page_id"), F.md5("html")
    modified = F.concat(F.lit("day "), (p % 1000).cast("string"))
    first = F.create_map(
        F.lit("etag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("a"), F.lit("content-type"), F.lit("text/html")
    )
    tag = F.when(p % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), digest, F.lit('"')))
    second = F.create_map(F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=600"), F.lit("server"), F.lit("b"))
    by_time = F.create_map(F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=600"), F.lit("server"), F.lit("b"))
    two = F.array(
        F.struct((2 * p).alias("record_id"), F.lit("response").alias("record_type"), (10 * p).alias("captured_at"), F.when(p % 11 == 0, 404).otherwise(200).alias("status"), first.alias("headers"), digest.alias("payload_digest")),
        F.struct((2 * p + 1).alias("record_id"), F.lit("revisit").alias("record_type"), (10 * p + 25).alias("captured_at"), F.lit(304).alias("status"), F.when(p % 7 == 0, by_time).otherwise(second).alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
    )
    return pages.select("url", F.explode(two).alias("r")).select("url", "r.*")


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(html) AS digest, 'day ' || CAST(page_id % 1000 AS VARCHAR) AS modified,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(?:[^@]*@)?(?:www\.)?', ''), ':(?:80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)'))), '&') AS query
  FROM p),
c AS (SELECT *, host || path || CASE WHEN coalesce(query, '') <> '' THEN '?' || query ELSE '' END AS u FROM q),
full_ AS (
  SELECT u, 10 * page_id AS t, max(page_id) AS source FROM c WHERE page_id % 11 <> 0 GROUP BY ALL),
asked AS (SELECT *, 10 * page_id + 25 AS t FROM c),
met AS (
  SELECT a.*, f.source FROM asked a ASOF LEFT JOIN full_ f ON a.u = f.u AND a.t > f.t),
r AS (
  SELECT m.*, s.digest AS source_digest, s.modified AS source_modified,
         CASE WHEN m.source IS NULL THEN 'no_response'
              WHEN m.page_id % 7 = 0 THEN CASE WHEN m.modified = s.modified THEN 'resolved' ELSE 'mismatch' END
              WHEN m.page_id % 5 = 0 THEN 'mismatch'
              WHEN m.digest = s.digest THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM met m LEFT JOIN c s ON s.page_id = m.source)
SELECT 2 * page_id + 1 AS record_id, u AS canonical_url, t AS captured_at,
       CASE WHEN outcome = 'resolved' THEN 2 * source END AS source_id, outcome,
       CASE WHEN outcome = 'resolved' THEN
         'cache-control: max-age=600; content-type: text/html; etag: ' || CASE WHEN page_id % 7 = 0 THEN '"' || source_digest ELSE 'W/"' || digest END
         || '"; last-modified: ' || source_modified || '; server: a'
       WHEN page_id % 7 = 0 THEN 'cache-control: max-age=600; last-modified: ' || modified || '; server: b'
       ELSE 'cache-control: max-age=600; etag: ' || CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/"' || digest || '"' END || '; server: b' END AS headers,
       CASE WHEN outcome = 'resolved' THEN source_digest END AS payload_digest
FROM r
"""
