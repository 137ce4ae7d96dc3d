"""Revisits against a plain as-of search."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.warc import PERMITTED, canonical_url, resolve_revisits

HEADERS = T.MapType(T.StringType(), T.StringType())
SCHEMA = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()), T.StructField("captured_at", T.LongType()), T.StructField("status", T.IntegerType()), T.StructField("headers", HEADERS), T.StructField("payload_digest", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("part", T.StringType())])


def test_canonical_urls(spark):
    pairs = [
        ("http://WWW.Example.com:80/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
        ("https://example.com/a?utm_source=feed", "example.com/a"),
        ("https://user@example.com:8443", "example.com:8443"),
        ("example.com/A//", "example.com/A"),
        ("https://e.org/?ref=x&q=&q", "e.org?q&q="),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "u string").select("u", canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == dict(pairs)


def plain(rows):
    out = []
    for i, kind, url, t, _, headers, digest, *_ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url is not None and None not in (r[3], t) and r[3] < t]
        if not earlier:
            out.append((i, None, "no_response", headers, digest))
            continue
        r = max(earlier, key=lambda r: (r[3], r[0]))
        mine, theirs = headers or {}, r[5] or {}
        weak = lambda x: x.strip().removeprefix("W/")
        if mine.get("etag") and theirs.get("etag"):
            fits = weak(mine["etag"]) == weak(theirs["etag"])
        elif mine.get("last-modified") and theirs.get("last-modified"):
            fits = mine["last-modified"] == theirs["last-modified"]
        elif digest and r[6]:
            fits = digest == r[6]
        else:
            fits = None
        if fits:
            out.append((i, r[0], "resolved", theirs | {k: v for k, v in mine.items() if k in PERMITTED}, r[6]))
        else:
            out.append((i, None, {None: "unverified", False: "mismatch"}[fits], headers, digest))
    return sorted(out, key=str)


def test_revisits_equal_plain(spark):
    rng = random.Random(10)
    rows = []
    for i in range(900):
        headers = {k: rng.choice(v) for k, v in {"etag": ['"a"', 'W/"a"', '"b"'], "last-modified": ["m1", "m2"], "server": ["s1", "s2"], "cache-control": ["c1", "c2"]}.items() if rng.random() < 0.6}
        rows.append((i, rng.choice(["response", "revisit", "request"]), rng.choice(["hot", "hot", "hot", "x", "y", "z", None]), rng.choice([None] + [rng.randrange(300)] * 20), rng.choice([200, 200, 200, 404, None]), rng.choice([headers] * 9 + [None]), rng.choice(["d1", "d2", None]), "clash", "clash"))
    rows += [rows[0], rows[1]]
    for ranges in (1, 7):
        found = resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3), ranges).collect()
        want = plain(rows)
        assert sorted(((r.record_id, r.source_id, r.outcome, r.headers, r.payload_digest) for r in found), key=lambda x: (str(x[:3]))) and len(found) == len(want)
        norm = lambda x: str((*x[:3], sorted(x[3].items()) if x[3] is not None else None, x[4]))
        assert sorted(norm((r.record_id, r.source_id, r.outcome, r.headers, r.payload_digest)) for r in found) == sorted(map(norm, want))
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
