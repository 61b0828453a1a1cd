"""Not-modified revisit records resolved to the response they stand for.

A revisit (status 304) names no body: it refers to the latest earlier full
response of the same canonical URL. The as-of join has two levels, so one
hot URL is spread over time buckets: the last response of each (url,
bucket) is an aggregate, carried over later buckets by a window of at most
``TIME_BUCKETS`` rows per URL; within a bucket a window looks at strictly
earlier times. Validators are then checked (entity tags by weak
comparison, else equal Last-Modified), and the response's headers are
updated by those headers a 304 may change.

Native DataFrame functions only. Input columns: record_id long, url string,
ts long, status int, etag, last_modified string, headers map<string,string>
(lower-case names), payload_digest string; others are ignored.

Edge cases: a null or empty URL or a null time resolves to nothing
(outcome ``no_earlier``); of responses at the same time the one with the
larger record_id counts; a response at the revisit's own time is not
earlier; repeated rows are revisits each; null headers count as none; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIME_BUCKETS = 256
#: Headers a 304 response carries for the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content.
TRACKING = "ref|gclid|fbclid|sessionid|utm_[a-z]+"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user, fragment or
    tracking parameters, sorted query, no trailing slash on a path."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, "^[^:/?]+://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^:/?]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    made = F.concat(head, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", made)


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve(records: DataFrame, time_buckets: int = TIME_BUCKETS) -> DataFrame:
    """Every revisit: record_id, url_key, ts, outcome (resolved,
    etag_mismatch, modified_mismatch, no_validator, no_earlier),
    refers_to, payload_digest, headers (merged; null unless resolved)."""
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "status", "etag", "last_modified",
        F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"), "payload_digest")
    lo, hi = records.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // time_buckets + 1)
    r = r.withColumn("tb", F.floor((F.col("ts") - F.lit(lo or 0)) / F.lit(width)))
    full = (F.col("status") != 304) & F.col("ts").isNotNull()
    kept = F.struct("record_id", "etag", "last_modified", "headers", "payload_digest")
    rank = F.struct("ts", "record_id")
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()

    last = (r.where(usable & full).groupBy("url_key", "tb").agg(F.max_by(kept, rank).alias("in_bucket")))
    asked = r.where(usable & (F.col("status") == 304)).select("url_key", "tb").distinct()
    # buckets that ask or hold something, in order; what came before each
    line = (asked.join(last, ["url_key", "tb"], "full")
            .withColumn("carried", F.last("in_bucket", ignorenulls=True).over(
                Window.partitionBy("url_key").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)))
            .select("url_key", "tb", "carried"))
    near = F.max_by(F.when(full, kept), F.when(full, rank)).over(
        Window.partitionBy("url_key", "tb").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    inside = r.where(usable).withColumn("near", near).where(F.col("status") == 304)
    found = (inside.join(line, ["url_key", "tb"], "left")
             .withColumn("resp", F.coalesce("near", "carried")).drop("near", "carried", "tb"))
    lost = r.where(~usable & (F.col("status") == 304)).drop("tb") \
            .withColumn("resp", F.lit(None).cast(found.schema["resp"].dataType))
    every = found.unionByName(lost)
    outcome = (F.when(F.col("resp").isNull(), "no_earlier")
               .when(F.col("etag").isNotNull(), F.when(_tag(F.col("etag")) == _tag(F.col("resp.etag")), "resolved")
                     .otherwise("etag_mismatch"))
               .when(F.col("last_modified").isNotNull(),
                     F.when(F.col("last_modified") == F.col("resp.last_modified"), "resolved")
                     .otherwise("modified_mismatch"))
               .otherwise("no_validator"))
    may = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("resp.headers", lambda k, v: ~F.array_contains(F.map_keys(may), k)), may)
    ok = F.col("outcome") == "resolved"
    return every.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", "outcome",
        F.when(ok, F.col("resp.record_id")).alias("refers_to"),
        F.when(ok, F.col("resp.payload_digest")).alias("payload_digest"),
        F.when(ok, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the ``pages`` table: a full response of every
    page, and one or two later requests of its address written another way
    and answered with 304. Tags, dates and times follow from page_id, so
    every outcome occurs."""
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    day = F.concat(F.lit("day-"), (p % 97).cast("string"))

    def record(rid, url, ts, status, etag, modified, headers, payload):
        return F.struct(rid.cast("long").alias("record_id"), url.alias("url"), ts.cast("long").alias("ts"),
                        F.lit(status).alias("status"), etag.alias("etag"), modified.alias("last_modified"),
                        headers.alias("headers"), payload.alias("payload_digest"))

    def headers(kind: str, tag_: Column, n: Column) -> Column:
        return F.create_map(F.lit("content-type"), F.lit(kind), F.lit("etag"), tag_,
                            F.lit("cache-control"), F.concat(F.lit("max-age="), n.cast("string")),
                            F.lit("server"), F.concat(F.lit("s"), n.cast("string")))

    no = F.lit(None).cast("string")
    base = (p * 7919) % 100003 * 1000
    response = record(p * 3, F.col("url"), base, 200, tag, day, headers("text/html", tag, p % 13), digest)
    other = F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=x#top"))
    e1 = F.when(p % 5 == 0, no).when(p % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    m1 = F.when(p % 10 == 0, no).when(p % 15 == 0, F.lit("day-x")).otherwise(day)
    first = record(p * 3 + 1, other, base + F.when(p % 11 == 0, -500).otherwise(500), 304, e1, m1,
                   headers("text/x", F.coalesce(e1, F.lit("-")), p % 17), no)
    second = record(p * 3 + 2, F.upper(F.regexp_extract("url", "^[a-z]+://[^/]*", 0)), base + 700, 304, tag, no,
                    headers("text/y", tag, p % 19), no)
    return pages.select(F.inline(F.array(response, first, second)))
