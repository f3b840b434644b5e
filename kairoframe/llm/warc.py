"""Resolution of not-modified revisits in web archives.

Records are (record_id, uri, ts, status, headers, body): a status of 304 is a revisit without a body,
a status of 200 with a body a full response. Each revisit is joined as of its time to the latest
earlier full response of the same canonical URL. It is resolved when the validators agree: entity
tags by weak comparison where both have one, else last-modified dates where both have one; with
neither pair it isn't validated. A resolved revisit has the response's body, and the response's headers
updated by those of the revisit that may change (all but the ones that describe a body or a hop).

What a revisit finds depends on its URL and its second alone, so captures are one row for each of those
before anything is ordered. The as-of join then is two windows: one inside each URL's day, which has
86,400 seconds at most however many captures, and one over the URL's days, each of them a single row.
Headers and bodies are joined afterwards, by URL, second and record id.

Every revisit gives one row, repeated ones too, also where records share an id. Of responses in the same
second the larger id counts, and no id least; of responses that agree in URL, second and id one counts, by
a hash of headers and body. Records at exactly the revisit's second aren't earlier. Records with a null
URI or time, and revisits without an earlier response, are `unmatched`. Header names are lower-cased; of
names that differ in case only, the last stays. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, plain

#: Header fields that a not-modified answer doesn't change (RFC 9110 and 9111).
UNCHANGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical(url: Column) -> Column:
    """Without scheme, `www.`, default port, fragment, utm parameters and trailing slash; host in lower case."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "(?i)^https?://(www[.])?", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*&", "$1")
    rest = F.regexp_replace(rest, "[?&]utm_[a-z]+=[^&]*$", "")
    return F.concat(F.regexp_replace(host, ":(80|443)$", ""), F.regexp_replace(rest, "/$", ""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of equal ones the last entry stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.expr("cast(map() as map<string,string>)"))


def merge_headers(stored: Column, newer: Column) -> Column:
    """Stored headers with those of newer that may change."""
    allowed = F.map_filter(newer, lambda k, v: ~k.isin(UNCHANGED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def latest_before(captures: DataFrame, bucket_seconds: int) -> DataFrame:
    """(url, ts, source) for each second at which a URL was revisited: the latest full response strictly before.

    Captures come as (url, ts, asked, mark), one a URL and second: was it revisited, and the struct
    (ts, no_id, record_id) of a response there; source is such a struct, and there is no row without one.
    """
    rows = captures.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    near = Window.partitionBy("url", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.max("mark").over(near)).where("asked")
    ends = rows.groupBy("url", "bucket").agg(F.max("mark").alias("mark"))
    far = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(ends.withColumn("far", F.max("mark").over(far)).select("url", "bucket", "far"), "bucket-ends")
    found = inside.join(before, ["url", "bucket"]).select("url", "ts", F.coalesce("near", "far").alias("source"))
    return found.where("source is not null")


def resolve(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """One row a revisit: record_id, url, ts, source_id, outcome (resolved, mismatch, unvalidated or unmatched), headers, body."""
    rows = plain(records, "record_id", "uri", "ts", "status", "headers", "body").select(
        "record_id", canonical(F.col("uri")).alias("url"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"),
        lower_names(F.col("headers").cast("map<string,string>")).alias("headers"), "body",
    )
    full = F.coalesce((F.col("status") == 200) & F.col("body").isNotNull(), F.lit(False))
    known = rows.where(full | (F.col("status") == 304)).where("url is not null and ts is not null")
    mark = F.struct("ts", F.col("record_id").isNotNull().alias("has_id"), "record_id")
    captures = known.groupBy("url", "ts").agg(F.max(~full).alias("asked"), F.max(F.when(full, mark)).alias("mark"))
    found = materialise(latest_before(captures, bucket_seconds), "sources")
    named = found.select("url", "ts", F.col("source.ts").alias("source_ts"), F.col("source.has_id").alias("has_id"), F.col("source.record_id").alias("source_id"))
    told = lambda df: df.withColumn("same_id", F.coalesce(F.col("source_id").cast("string"), F.lit("")))
    stored = rows.where(full).select("url", F.col("ts").alias("source_ts"), F.col("record_id").isNotNull().alias("has_id"), F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), "body")
    keys = ["url", "source_ts", "has_id", "same_id"]
    needed = told(stored).drop("source_id").join(told(named).select(keys).distinct(), keys, "left_semi")
    order = F.struct(F.xxhash64(F.array_sort(F.map_entries("stored")), "body"), F.md5("body"))
    stored = needed.groupBy(keys).agg(F.max_by(F.struct("stored", "body"), order).alias("response"))
    revisits = rows.where("status = 304").select("record_id", "url", "ts", F.col("headers").alias("newer"))
    matched = told(revisits.join(named, ["url", "ts"], "left"))
    out = matched.join(stored, keys, "left").select("record_id", "url", "ts", "source_id", "newer", "response.stored", "response.body")
    seen = lambda h, k: F.element_at(h, k)
    etags = seen(F.col("newer"), "etag").isNotNull() & seen(F.col("stored"), "etag").isNotNull()
    dates = seen(F.col("newer"), "last-modified").isNotNull() & seen(F.col("stored"), "last-modified").isNotNull()
    same_tag = F.regexp_replace(seen(F.col("newer"), "etag"), "^W/", "") == F.regexp_replace(seen(F.col("stored"), "etag"), "^W/", "")
    same_date = seen(F.col("newer"), "last-modified") == seen(F.col("stored"), "last-modified")
    outcome = (
        F.when(F.col("stored").isNull(), "unmatched")
        .when(etags, F.when(same_tag, "resolved").otherwise("mismatch"))
        .when(dates, F.when(same_date, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    ok = F.col("outcome") == "resolved"
    out = out.withColumn("outcome", outcome)
    return out.select(
        "record_id", "url", "ts", "source_id", "outcome",
        F.when(ok, merge_headers(F.col("stored"), F.col("newer"))).otherwise(F.col("newer")).alias("headers"), F.when(ok, F.col("body")).alias("body"),
    )
