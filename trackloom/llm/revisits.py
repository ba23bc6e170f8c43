"""Resolution of not-modified revisits in a crawl log (operator 5), in DataFrame operations only.

A revisit record says that a server answered "not modified"; what it stands for is the latest earlier full
response of the same canonical URL, provided that the validators agree: equal ETags (weak marks aside) where
both have one, else equal Last-Modified where both have one.  The resolved record takes the response's payload
and headers, updated by those headers that such an answer may change.

The as-of join must not put all captures of one URL into a task.  Records are cut into time ranges at quantiles of all
timestamps; within (URL, range) a window finds the latest full response, and between ranges only each one's last
response is carried on, at most a row for each URL and range.

Captures of equal time are not earlier than each other; of several full responses at one time the largest id counts.
Null URLs and times never match; headers may be null; equal rows are each resolved.  Ids name responses in the result and break ties, but rows are matched by URL and time, so ids
that are repeated or null lose nothing.  Other columns stay behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import shuffle_width

#: Headers that a 304 answer may update; parameters that only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "^(utm_.*|ref|gclid|fbclid)(=|$)"
#: Fewest time ranges.
RANGES = 64


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without default port, no fragment, a path of at least "/", parameters sorted and without tracking ones."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(host, F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme == "", bare).otherwise(whole)


def _value(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(_value(headers, "etag"), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url (canonical), outcome, response_id, headers and payload of every revisit of records.

    records: record_id long, url string, at long (time), kind string ("response" or "revisit"), status int, headers map (names in
    lower case), payload string.  A full response is one of status 200.  outcome: resolved, no_earlier_response or validator_mismatch.
    """
    ranges = max(RANGES, shuffle_width(records))
    all_rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "at", "kind", (F.col("kind") == "response").alias("full"), "status", "headers", "payload")
    full = all_rows.where("full and status = 200 and url is not null and at is not null")
    revisit = all_rows.where("kind = 'revisit'").select("record_id", "url", "at", "headers")
    # ranges - 1 numbers, from a summary of all times; where they lie decides only how work is dealt
    edges = sorted({int(x) for x in records.stat.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.25 / ranges) or []})
    part = F.lit(0)
    if edges:
        numbers = F.array(*(F.lit(x) for x in edges))
        part = F.size(F.filter(numbers, lambda x: x <= F.col("at")))
    stamp = F.struct(F.col("at").alias("at"), F.col("record_id").alias("id"))
    # what a revisit stands for follows from its URL and time alone, so equal ones are asked once, whatever their ids
    asked = revisit.where("url is not null and at is not null").select("url", "at").distinct()
    events = full.select("url", "at", F.lit(1).alias("turn"), stamp.alias("response")).union(asked.select("url", "at", F.lit(0), F.lit(None).cast(full.select(stamp.alias("s")).schema["s"].dataType))).withColumn("part", part)
    inside = Window.partitionBy("url", "part").orderBy("at", "turn", F.col("response.id")).rowsBetween(Window.unboundedPreceding, 0)
    near = events.withColumn("found", F.last("response", ignorenulls=True).over(inside)).where("turn = 0").select("url", "part", "at", "found")
    last = events.groupBy("url", "part").agg(F.max("response").alias("last"))
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select("url", "part", "carried")
    asof = near.join(carried, ["url", "part"], "left").select("url", "at", F.coalesce("found", "carried").alias("of"))
    asof = asof.where("of is not null").select("url", "at", F.col("of.id").alias("response_id"), F.col("of.at").alias("response_at"))
    named = revisit.join(asof, ["url", "at"], "left")
    # of full responses of one URL, time and id the one with the least payload, then headers, counts
    # ids may be null, so a key is (is it null, id or 0): plain equality, under which payloads lie as they were grouped and are shuffled once
    key = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c), F.lit(0)))
    none, known = key("record_id")
    base = full.groupBy(F.col("url").alias("of_url"), F.col("at").alias("of_at"), none.alias("of_none"), known.alias("of_id")).agg(F.min_by(F.struct(F.col("headers").alias("old"), "payload"), F.struct("payload", F.to_json("headers"))).alias("b"))
    base = base.select("of_url", "of_at", "of_none", "of_id", "b.*")
    none, known = key("response_id")
    both = named.join(base, (F.col("url") == F.col("of_url")) & (F.col("response_at") == F.col("of_at")) & (none == F.col("of_none")) & (known == F.col("of_id")), "left")
    new, old = F.col("headers"), F.col("old")
    tags = _tag(new).isNotNull() & _tag(old).isNotNull()
    dates = _value(new, "last-modified").isNotNull() & _value(old, "last-modified").isNotNull()
    agree = F.when(tags, _tag(new) == _tag(old)).when(dates, _value(new, "last-modified") == _value(old, "last-modified")).otherwise(False)
    outcome = F.when(F.col("response_at").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    done = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return done.select("record_id", "url", "outcome", F.when(ok, F.col("response_id")).alias("response_id"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("payload")).alias("payload"))


def capture_log(pages: DataFrame) -> DataFrame:
    """Records derived from the pages table: each page is captured in full, and asked for again three times.

    The first answer comes before the capture for every seventh page, the second repeats the capture's ETag under another
    spelling of the URL, the third has another ETag for every fifth page.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    at = F.col("page_id") * 7
    host = F.regexp_replace("url", "#.*$", "")
    other = F.concat(F.regexp_replace(host, "^http", "HTTP"), F.when(host.contains("?"), F.lit("&utm_source=a")).otherwise(F.lit("?utm_source=a")), F.lit("#again"))

    def headers(*pairs):
        return F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p))

    def record(k, url, at, kind, status, head, payload):
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), url.alias("url"), at.alias("at"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), head.alias("headers"), payload.alias("payload"))

    none = F.lit(None).cast("string")
    when = lambda x: ("date", x.cast("string"))
    rows = F.array(
        record(0, F.col("url"), at, "response", 200, headers(("etag", F.concat(F.lit("W/"), tag)), when(at), ("content-type", "text/html"), ("server", "a"), ("cache-control", "max-age=1")), F.col("html")),
        record(1, F.col("url"), F.when(F.col("page_id") % 7 == 0, at - 1).otherwise(at + 1), "revisit", 304, headers(("etag", tag), when(at + 1)), none),
        record(2, other, at + 5000, "revisit", 304, headers(("etag", tag), when(at + 5000), ("cache-control", "max-age=9"), ("server", "b"), ("content-length", "0")), none),
        record(3, F.col("url"), at + 9000, "revisit", 304, headers(("etag", F.when(F.col("page_id") % 5 == 0, F.lit("changed")).otherwise(tag)), when(at + 9000), ("content-type", "text/plain")), none),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def report(pages: DataFrame) -> DataFrame:
    """The revisits of the pages' capture log: headers as "name=value" sorted and joined by ";", the payload as its md5."""
    found = resolve(capture_log(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url", "outcome", "response_id", F.coalesce(text, F.lit("")).alias("headers"), F.md5("payload").alias("payload_md5"))


#: DuckDB SQL for report().
REPORT_SQL = r"""
WITH p AS (SELECT page_id, url, html, md5(coalesce(html, '')) tag, page_id * 7 tm, regexp_replace(url, '#.*$', '') bare FROM pages),
c AS (SELECT page_id * 4 record_id, url, tm, 1 f, 'W/' || tag etag, tm d, html FROM p
  UNION ALL SELECT page_id * 4 + 1, url, CASE WHEN page_id % 7 = 0 THEN tm - 1 ELSE tm + 1 END, 0, tag, tm + 1, NULL FROM p
  UNION ALL SELECT page_id * 4 + 2, regexp_replace(bare, '^http', 'HTTP') || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_source=a#again', tm + 5000, 0, tag, tm + 5000, NULL FROM p
  UNION ALL SELECT page_id * 4 + 3, url, tm + 9000, 0, CASE WHEN page_id % 5 = 0 THEN 'changed' ELSE tag END, tm + 9000, NULL FROM p),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') b FROM c),
s AS (SELECT *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) scheme, lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) host,
  regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_.*|ref|gclid|fbclid)(=|$)'))), '&') q FROM u),
k AS (SELECT record_id, tm, f, etag, d, html, CASE WHEN scheme = '' THEN b ELSE scheme || '://' || regexp_replace(host, CASE WHEN scheme = 'https' THEN ':443$' ELSE ':80$' END, '')
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END url FROM s),
r AS (SELECT * FROM k WHERE f = 1 QUALIFY row_number() OVER (PARTITION BY url, tm ORDER BY record_id DESC) = 1),
j AS (SELECT v.record_id, v.url, v.etag, v.d, r.record_id rid, r.etag retag, r.html FROM (SELECT * FROM k WHERE f = 0) v ASOF LEFT JOIN r ON v.url = r.url AND v.tm > r.tm),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_earlier_response' WHEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END outcome FROM j)
SELECT record_id, url, outcome, CASE WHEN outcome = 'resolved' THEN rid END response_id,
  CASE WHEN outcome <> 'resolved' THEN '' ELSE 'cache-control=max-age=' || CASE WHEN record_id % 4 = 2 THEN '9' ELSE '1' END || ';content-type=text/html;date=' || CAST(d AS VARCHAR) || ';etag=' || etag || ';server=a' END headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END payload_md5 FROM o
"""
