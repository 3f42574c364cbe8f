"""Not-modified revisits in WARC captures: each gets the payload and headers it stands for.

A revisit (status 304) refers to the latest earlier full response (status 200) of the same canonical
URL. The as-of join runs in two levels, so that a URL with a third of all captures is spread over tasks:
first within (URL, day), where an ordered window sees at most one row for each second, then over the days of a URL
for what a day starts with. Equal URL and time are one point of that order; of several responses at one
time the one with the largest record_id counts. Headers and payloads join by record_id and one of ``SALTS`` salts, for the salts that
a response's revisits have, so a response with a third of all revisits is spread over tasks too.

Canonical URL: scheme and host in lower case (without a scheme: http), the scheme's own default port and the fragment removed, an empty path
as ``/``; path and parameters stay as they are. A crawler's further rules (session parameters, www.) are an argument.

Validators: an ETag of the 304 must equal the response's (weakly compared only if the 304's is weak); without an ETag a
Last-Modified must equal; without either the response counts only if it has neither.
Headers: those of the response, overwritten by the 304's, except hop-by-hop fields, fields that its
Connection header names, and Content-Encoding, -Length, -Range and -Type.

Outcomes: ``resolved``; ``mismatch`` (a validator differs); ``unvalidated`` (the 304 has no validator and
the response has); ``missing`` (no earlier response); full responses are ``original``.

Defined cases: a null url or time never matches (``missing``); null headers count as none; header
names are compared in lower case; repeated records are resolved each; other statuses are left
out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.scratch import Scratch

#: Fields of a 304 that never replace a stored one: hop-by-hop and content fields (RFC 9110, RFC 9111).
FIXED_FIELDS = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
]
DAY = 86_400
SALTS = 16


def canonical_url(url: Column) -> Column:
    """See the module's text; null for null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    scheme = F.when(scheme == "", "http").otherwise(scheme)
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)


def _lower_names(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string, string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # of names that differ in case only the last in order counts
    return F.aggregate(
        F.array_sort(pairs), F.expr("cast(map() as map<string, string>)"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])),
    )


def merge_headers(stored: Column, update: Column) -> Column:
    """Header map (lower-case names) of a response after a 304."""
    named = F.transform(F.split(F.lower(F.coalesce(update["connection"], F.lit(""))), ","), lambda c: F.trim(c))
    barred = F.concat(F.array(*map(F.lit, FIXED_FIELDS)), named)
    new = F.map_filter(update, lambda k, _: ~F.array_contains(barred, k))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def _last(order: Window, what: str) -> Column:
    return F.last(what, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def _as_of(tmp: Scratch, points: DataFrame) -> DataFrame:
    """points: u, t (distinct), own (record_id of the response there, or null) -> u, t, base: the own
    of the latest earlier point that has one."""
    points = points.withColumn("day", F.floor(F.col("t") / DAY))
    inside = _last(Window.partitionBy("u", "day").orderBy("t"), "own")
    days = points.where("own is not null").groupBy("u", "day").agg(F.max_by("own", "t").alias("last"))
    every = points.select("u", "day").distinct().join(days, ["u", "day"], "left")
    carried = every.withColumn("carry", _last(Window.partitionBy("u").orderBy("day"), "last")).select("u", "day", "carry")
    return tmp.save(
        points.withColumn("inside", inside).join(carried, ["u", "day"]).select("u", "t", F.coalesce("inside", "carry").alias("base")), "as_of"
    )


def _salted(revisits: DataFrame, responses: DataFrame) -> DataFrame:
    """revisits (base_id, salt) with the columns of responses (base_id; one row each): a response is copied to the salts that ask for it."""
    asked = revisits.where("base_id is not null").select("base_id", "salt").distinct()
    return revisits.join(responses.join(asked, "base_id"), ["base_id", "salt"], "left")


def resolve_revisits(records: DataFrame, canonical: Callable[[Column], Column] = canonical_url) -> DataFrame:
    """records: record_id long, url, t long (seconds), status int, headers map<string, string>, payload string. ``canonical``: what
    makes a URL's canonical form.

    Returns record_id, base_id (the response), outcome, headers (merged; lower-case names) and payload."""
    tmp = Scratch(records.sparkSession, "revisits")
    rows = records.where("status in (200, 304)").select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical(F.col("url")).alias("url"),
        F.col("t").cast("long").alias("t"),
        (F.col("status") == 304).alias("revisit"),
        _lower_names(F.col("headers")).alias("headers"),
        "payload",
    )
    light = tmp.save(rows.select("record_id", F.sha2("url", 256).alias("u"), "t", "revisit", "headers"), "captures")
    timed = light.where("u is not null and t is not null")
    points = timed.groupBy("u", "t").agg(F.max(F.when(~F.col("revisit"), F.col("record_id"))).alias("own"))
    base = _as_of(tmp, tmp.save(points, "points"))
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt")
    revisits = tmp.save(light.where("revisit").join(base, ["u", "t"], "left").select("record_id", salt, "headers", F.col("base").alias("base_id")), "based")
    full = light.where("not revisit").groupBy("record_id").agg(F.max_by("headers", F.struct("t", F.map_entries("headers").cast("string"))).alias("stored"))
    both = _salted(revisits, full.withColumnRenamed("record_id", "base_id"))
    tag, stored_tag = F.col("headers")["etag"], F.col("stored")["etag"]
    since, stored_since = F.col("headers")["last-modified"], F.col("stored")["last-modified"]
    plain = lambda c: F.regexp_replace(c, r"^W/", "")
    same_tag = F.when(tag.startswith("W/"), plain(tag) == plain(stored_tag)).otherwise(tag == stored_tag)
    outcome = (
        F.when(F.col("base_id").isNull(), "missing")
        .when(tag.isNotNull(), F.when(F.coalesce(same_tag, F.lit(False)), "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(F.coalesce(since == stored_since, F.lit(False)), "resolved").otherwise("mismatch"))
        .when(stored_tag.isNull() & stored_since.isNull(), "resolved")
        .otherwise("unvalidated")
    )
    judged = tmp.save(both.withColumn("outcome", outcome), "judged")
    good = F.col("outcome") == "resolved"
    payloads = rows.where("not revisit").groupBy("record_id").agg(F.max("payload").alias("payload"))
    resolved = (
        _salted(judged.where(good), payloads.withColumnRenamed("record_id", "base_id"))
        .select("record_id", "base_id", "outcome", merge_headers(F.col("stored"), F.col("headers")).alias("headers"), "payload")
    )
    others = judged.where(~good).select("record_id", "base_id", "outcome", "headers", F.lit(None).cast("string").alias("payload"))
    originals = rows.where("not revisit").select("record_id", F.col("record_id").alias("base_id"), F.lit("original").alias("outcome"), "headers", "payload")
    return originals.unionByName(resolved).unionByName(others)


#: The crawl that the query makes of ``pages``: a full response each at a time of its own, and a 304 of the same URL
#: up to three days later. By a hash of the URL its ETag is right (0-3), weak (4), another (5) or absent
#: with Last-Modified (6) or without (7). Each page's visitor also asks for the front page of its host, a 304 each; the front page was captured
#: in full with the host's smallest page_id, before all else.
SPAN = 30 * DAY
START = 1_700_000_000


def _fields(*pairs) -> Column:
    listed = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs])
    return F.map_from_entries(F.filter(listed, lambda e: e["v"].isNotNull()))


def crawl_of(pages: DataFrame) -> DataFrame:
    """WARC captures: record_id 4 * page_id (200 of the page), + 1 (304 of it), + 2 (304 of the host's front page) and + 3 (200 of
    the front page, for the first page of a host)."""
    n = F.conv(F.substring(F.md5("url"), 1, 7), 16, 10).cast("long")
    kind = n % 8
    first = F.lit(START) + (F.col("page_id") * 7919) % SPAN
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    since = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    new_tag = F.when(kind < 4, tag).when(kind == 4, F.concat(F.lit("W/"), tag)).when(kind == 5, F.lit('"other"'))
    front = F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1), F.lit("/"))
    none = F.lit(None).cast("string")
    full = pages.select(
        (F.col("page_id") * 4).alias("record_id"), "url", first.alias("t"), F.lit(200).alias("status"),
        _fields(("ETag", tag), ("Last-Modified", since), ("Content-Type", F.lit("text/html")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 4 + 1).alias("record_id"), "url", (first + 1 + n % (3 * DAY)).alias("t"), F.lit(304).alias("status"),
        _fields(("ETag", new_tag), ("Last-Modified", F.when(kind == 6, since)), ("Content-Type", F.lit("text/none")), ("Cache-Control", F.concat(F.lit("max-age="), kind)), ("Connection", F.lit("close, X-Hop")), ("X-Hop", F.lit("1"))).alias("headers"),
        none.alias("payload"),
    )
    visits = pages.select(
        (F.col("page_id") * 4 + 2).alias("record_id"), front.alias("url"), first.alias("t"), F.lit(304).alias("status"),
        _fields(("ETag", F.concat(F.lit('"'), F.md5(front), F.lit('"'))), ("Age", kind)).alias("headers"), none.alias("payload"),
    )
    hosts = pages.groupBy(front.alias("url")).agg(F.min("page_id").alias("page_id"))
    fronts = hosts.select(
        (F.col("page_id") * 4 + 3).alias("record_id"), "url", F.lit(START - 1).cast("long").alias("t"), F.lit(200).alias("status"),
        _fields(("ETag", F.concat(F.lit('"'), F.md5("url"), F.lit('"')))).alias("headers"), F.concat(F.lit("front of "), "url").alias("payload"),
    )
    return full.unionByName(again).unionByName(visits).unionByName(fronts)


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve_revisits(crawl_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return done.select("record_id", "base_id", "outcome", shown.alias("headers"), F.md5("payload").alias("payload_md5"))


QUERIES = {"op1_revisits": op1_revisits}
ORACLE = {
    "op1_revisits": r"""
WITH u AS (SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/' AS front, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
p AS (SELECT *, crc.c AS c, crc.c % 8 AS k, concat('"', md5(html), '"') AS tag, concat('day ', page_id % 97) AS since, 1700000000 + (page_id * 7919) % 2592000 AS t FROM u, LATERAL (SELECT CAST(concat('0x', substr(md5(url), 1, 7)) AS BIGINT) AS c) crc),
r AS (SELECT 4 * page_id AS id, bare, t, 200 AS status, tag, since, CAST(NULL AS BIGINT) AS k, html AS body FROM p
  UNION ALL SELECT 4 * page_id + 1, bare, t + 1 + c % 259200, 304, CASE WHEN k < 4 THEN tag WHEN k = 4 THEN concat('W/', tag) WHEN k = 5 THEN '"other"' END, CASE WHEN k = 6 THEN since END, k, NULL FROM p
  UNION ALL SELECT 4 * page_id + 2, front, t, 304, concat('"', md5(front), '"'), NULL, k, NULL FROM p
  UNION ALL SELECT 4 * min(page_id) + 3, front, 1699999999, 200, concat('"', md5(front), '"'), NULL, NULL, concat('front of ', front) FROM p GROUP BY front),
s AS (SELECT *, CASE WHEN regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) ELSE 'http' END AS scheme, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM r),
h AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path FROM s),
z AS (SELECT *, concat(scheme, '://', host, CASE WHEN path = '' THEN '/' ELSE path END, regexp_extract(rest, '(\?.*)$', 1)) AS canon FROM h),
m AS (SELECT x.id, max_by(y.id, (y.t, y.id)) AS base FROM z x JOIN z y ON x.canon = y.canon AND y.t < x.t WHERE x.status = 304 AND y.status = 200 GROUP BY x.id),
j AS (SELECT x.id, m.base, x.id % 4 = 2 AS visit, x.k, x.tag, x.since, y.id % 4 = 3 AS of_front, y.tag AS stag, y.since AS ssince, y.body,
  CASE WHEN m.base IS NULL THEN 'missing' WHEN x.tag IS NOT NULL THEN CASE WHEN regexp_replace(x.tag, '^W/', '') = y.tag THEN 'resolved' ELSE 'mismatch' END
       WHEN x.since IS NOT NULL THEN CASE WHEN coalesce(x.since = y.since, FALSE) THEN 'resolved' ELSE 'mismatch' END WHEN y.tag IS NULL AND y.since IS NULL THEN 'resolved' ELSE 'unvalidated' END AS outcome
  FROM z x LEFT JOIN m ON m.id = x.id LEFT JOIN z y ON y.id = m.base WHERE x.status = 304)
SELECT CAST(id AS BIGINT) AS record_id, CAST(id AS BIGINT) AS base_id, 'original' AS outcome,
  CASE WHEN since IS NULL THEN concat('etag=', tag) ELSE concat('cache-control=max-age=60;content-type=text/html;etag=', tag, ';last-modified=', since) END AS headers, md5(body) AS payload_md5 FROM r WHERE status = 200
UNION ALL
SELECT CAST(id AS BIGINT), CAST(base AS BIGINT), outcome,
  CASE WHEN outcome = 'resolved' THEN concat_ws(';', CASE WHEN visit THEN concat('age=', k) END, CASE WHEN NOT visit THEN concat('cache-control=max-age=', k) WHEN NOT of_front THEN 'cache-control=max-age=60' END,
                                                CASE WHEN NOT of_front THEN 'content-type=text/html' END, 'etag=' || coalesce(tag, stag), 'last-modified=' || coalesce(since, ssince))
       WHEN visit THEN concat('age=', k, ';etag=', tag)
       ELSE concat_ws(';', concat('cache-control=max-age=', k), 'connection=close, X-Hop', 'content-type=text/none', 'etag=' || tag, 'last-modified=' || since, 'x-hop=1') END,
  CASE WHEN outcome = 'resolved' THEN md5(body) END FROM j"""
}
