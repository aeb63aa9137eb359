"""Resolution of not-modified revisits in a web archive.

A revisit record has no body; it stands for the latest earlier full response of the same canonical URL. An
as-of join finds that response; validators decide whether the revisit may stand for it (entity tags by
weak comparison if both sides have one, else modification times, else payload digests); then the revisit's
permitted headers replace the response's and all others stay as they were.

Records are sorted into slices by URL and time, about SLICE_ROWS each, and written to the shared folder. The as-of
join is a window over (URL, slice); what the earlier slices hold of a URL is one row a slice, carried forward by a
second window. So a URL with a third of all records is spread over as many slices as its records need. Record bodies
are not read.

Defined results: only a strictly earlier response counts; of several at one time, the one with the
largest record_id. A null URL, or a null time, is in no relation to others: such records go round the windows. States:
resolved, unvalidated (a response, but no validator on both sides: nothing speaks against it, so headers merge as in
resolved, and the state tells them apart), mismatch, no_source. Header names compare without regard to
case; repeated headers all stay. Repeated revisits give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestra.llm.common import partitions, settled

SLICE_ROWS = 100_000

#: Headers that a not-modified response may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: str) -> Column:
    """Host in lower case without www. and default ports, path without its last slash, query without
    tracking parameters and sorted; scheme, user and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/@?#]*@)?", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: str) -> Column:
    return F.regexp_replace(F.col(tag), r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts (bigint), revisit (boolean), etag, last_modified (bigint), digest and headers
    (array of name and value). Gives for each revisit: record_id, url_key, ts, source_id, source_ts, state,
    digest (the response's, if resolved) and headers (merged; the revisit's own, if it has no source)."""
    spark = records.sparkSession
    rows = records.select("record_id", canonical_url("url").alias("url_key"), F.col("ts").cast("long").alias("ts"), "revisit", "etag", F.col("last_modified").cast("long").alias("last_modified"), "digest", "headers")
    placed = F.col("ts").isNotNull() & F.col("url_key").isNotNull()
    n = max(partitions(spark), -(-rows.count() // SLICE_ROWS))
    sorted_ = settled(spark, rows.where(placed).repartitionByRange(n, "url_key", "ts").withColumn("slice", F.spark_partition_id()))
    sorted_ = sorted_.withColumn("full", F.when(~F.col("revisit"), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers")))
    inside = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = sorted_.withColumn("near", F.max("full").over(inside)).where("revisit")
    slices = sorted_.groupBy("url_key", "slice").agg(F.max("full").alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.max("last").over(before).alias("far")).where("far is not null")
    met = seen.join(carried, ["url_key", "slice"], "left").drop("slice", "full")
    met = met.unionByName(rows.where(~placed & F.col("revisit")), allowMissingColumns=True)
    source = F.coalesce("near", "far")
    met = met.withColumn("s", source).select("*", F.col("s.etag").alias("s_etag"), F.col("s.headers").alias("s_headers"))
    same = (
        F.when(F.col("etag").isNotNull() & F.col("s_etag").isNotNull(), _weak("etag") == _weak("s_etag"))
        .when(F.col("last_modified").isNotNull() & F.col("s.last_modified").isNotNull(), F.col("last_modified") == F.col("s.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("s.digest").isNotNull(), F.col("digest") == F.col("s.digest"))
    )
    state = F.when(F.col("s").isNull(), "no_source").when(same, "resolved").when(same.isNull(), "unvalidated").otherwise("mismatch")
    allowed = F.filter(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.lower(h["name"]).isin(PERMITTED))
    met = met.withColumn("state", state).withColumn("new", allowed).withColumn("names", F.transform("new", lambda h: F.lower(h["name"])))
    stay = F.filter(F.coalesce("s_headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: ~F.array_contains(F.col("names"), F.lower(h["name"])))
    resolved = F.col("state").isin("resolved", "unvalidated")
    return met.select(
        "record_id", "url_key", "ts", F.col("s.record_id").alias("source_id"), F.col("s.ts").alias("source_ts"), "state",
        F.when(resolved, F.col("s.digest")).alias("digest"), F.when(resolved, F.concat(stay, "new")).otherwise(F.col("headers")).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each is fetched in full at time 10 * page_id, and asked for again 5005 later
    with the validators it then had. Every seventh comes back with another entity tag, every third has
    none, every fifth has no modification time, every 35th no validator but its digest."""
    p = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.when(p % 3 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')))
    changed = F.when(p % 7 == 0, F.lit('"0"')).otherwise(F.concat(F.lit("W/"), tag))
    modified = F.when(p % 5 != 0, p * 10 - 1)

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def some(*headers: Column) -> Column:
        return F.filter(F.array(*headers), lambda h: h["value"].isNotNull())

    size = F.octet_length(F.coalesce("html", F.lit("")))
    base = pages.select(p.alias("p"), "url", digest.alias("digest"), tag.alias("tag"), changed.alias("changed"), modified.alias("modified"), size.alias("size"))
    full = base.select(
        (F.col("p") * 2).alias("record_id"), "url", (F.col("p") * 10).alias("ts"), F.lit(False).alias("revisit"), F.col("tag").alias("etag"), F.col("modified").alias("last_modified"), "digest",
        some(header("Content-Type", F.lit("text/html")), header("Content-Length", F.col("size")), header("ETag", F.col("tag")), header("Date", F.col("p") * 10)).alias("headers"),
    )
    again = base.select(
        (F.col("p") * 2 + 1).alias("record_id"), "url", (F.col("p") * 10 + 5005).alias("ts"), F.lit(True).alias("revisit"), F.when(F.col("tag").isNotNull(), F.col("changed")).alias("etag"),
        F.when(F.col("tag").isNull(), F.col("modified")).alias("last_modified"), F.when(F.col("p") % 35 == 0, F.col("digest")).alias("digest"),
        some(header("date", F.col("p") * 10 + 5005), header("cache-control", F.lit("max-age=60")), header("Content-Length", F.lit("0")), header("Server", F.lit("s"))).alias("headers"),
    )
    return full.unionByName(again)
