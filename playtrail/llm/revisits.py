"""WARC revisit records: each not-modified response finds the full response that it confirms.

Records of a canonical URL are put in order of time and record id. A revisit (status 304) takes the latest full response
(status 200) before it, its validators are compared, and the headers that a not-modified response may update are
merged into those of the full response.

The as-of join sorts nothing per URL in one task: records are range-partitioned by (URL, time, id), so a URL with a third of
all records spans many parts. Within a part a window carries the last full response forward; across parts only the last full
response of each (URL, part) is carried, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.llm.shared import written

# The headers that a not-modified response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
FULL, NOT_MODIFIED = 200, 304
RESOLVED, MISMATCH, UNVERIFIED, MISSING = "resolved", "mismatch", "unverified", "missing"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slashes, sorted parameters without
    ``utm_`` ones; no scheme and no fragment. Null for a null url."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*", ""), r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?]*", 0), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r"\Awww\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1), r"/+\z", "")
    query = F.regexp_extract(rest, r"(?s)\A[^?]*\?(.*)\z", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, F.when(path == "", "/").otherwise(path),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"\AW/", "")


def outcome(found: Column, etag: Column, modified: Column) -> Column:
    """How a revisit's validators agree with those of the response found: entity tags where both have one (weak comparison),
    else modification dates where both have one."""
    return (
        F.when(found.isNull(), MISSING)
        .when(etag.isNotNull() & found["etag"].isNotNull(),
              F.when(_strong(etag) == _strong(found["etag"]), RESOLVED).otherwise(MISMATCH))
        .when(modified.isNotNull() & found["last_modified"].isNotNull(),
              F.when(modified == found["last_modified"], RESOLVED).otherwise(MISMATCH))
        .otherwise(UNVERIFIED))


def merged_headers(full: Column, update: Column) -> Column:
    """The full response's headers, with the permitted ones of the revisit in their place."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(full, lambda k, v: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records (record_id, url, ts, status, etag, last_modified, headers)``.

    Gives ``record_id``, ``canonical``, ``ts``, ``outcome``, ``full_id`` and, unless missing or mismatched, the merged
    ``headers``. Headers are a map with lower-case names; a null one counts as empty. Equal times are ordered by record id, and
    repeated records are kept, each resolved alike. A revisit with a null url, time or id is missing its response, and such a
    response is never found; an empty table gives no rows. Other columns are ignored.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "etag", "last_modified",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rows = rows.where(F.col("status").isin(FULL, NOT_MODIFIED))
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    order = ["canonical", "ts", "record_id"]
    placed = written(
        rows.where(known).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "revisit-parts")

    is_full = F.col("status") == FULL
    response = F.when(is_full, F.struct("record_id", "etag", "last_modified", "headers"))
    before = (Window.partitionBy("canonical", "part").orderBy("ts", "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    inside = placed.withColumn("near", F.last(response, ignorenulls=True).over(before)).where(F.col("status") == NOT_MODIFIED)

    # Only URLs that lie in several parts carry anything across.
    last = placed.where(is_full).groupBy("canonical", "part").agg(F.max(F.struct(
        "ts", "record_id", F.struct("record_id", "etag", "last_modified", F.map_entries("headers").alias("headers")).alias("response")))["response"].alias("last"))
    parts = placed.groupBy("canonical", "part").agg(F.count(F.lit(1)).alias("n")).drop("n")
    spread = parts.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical")
    earlier = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.join(spread, "canonical").join(last, ["canonical", "part"], "left")
        .select("canonical", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
        .where("carried IS NOT NULL")
        .select("canonical", "part", F.struct(
            "carried.record_id", "carried.etag", "carried.last_modified",
            F.map_from_entries("carried.headers").alias("headers")).alias("far")))
    found = inside.join(carried, ["canonical", "part"], "left").withColumn("found", F.coalesce("near", "far"))
    lost = rows.where(~known & (F.col("status") == NOT_MODIFIED)).select(
        "record_id", "canonical", "ts", F.lit(MISSING).alias("outcome"),
        F.lit(None).cast(dict(records.dtypes)["record_id"]).alias("full_id"),
        F.lit(None).cast("map<string,string>").alias("headers"))
    result = outcome(F.col("found"), F.col("etag"), F.col("last_modified"))
    merged = merged_headers(F.col("found.headers"), F.col("headers"))
    return found.select(
        "record_id", "canonical", "ts", result.alias("outcome"), F.col("found.record_id").alias("full_id"),
        F.when(result.isin(RESOLVED, UNVERIFIED), merged).alias("headers")).union(lost)


def header_text(headers: Column) -> Column:
    """Headers as lines ``name: value`` in order of their names."""
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of every page, as a crawler that comes back would record them.

    The first is a full response but for every eleventh page; the third is a new version for every fifth page; the others are
    not modified. Urls vary in scheme, fragment and campaign parameter. Some tags are weak, missing or wrong, and some
    not-modified responses carry headers that they may not change.
    """
    visit, page = F.col("visit"), F.col("page_id")
    version = F.when((visit >= 2) & (page % 5 == 0), 1).otherwise(0)
    full = (visit == 0) & (page % 11 != 0) | (visit == 2) & (page % 5 == 0)
    base, fragment = F.substring_index("url", "#", 1), F.regexp_extract("url", r"(?s)#.*", 0)
    url = (
        F.when(visit == 1, F.concat(base, F.lit("#again")))
        .when(visit == 2, F.regexp_replace("url", r"\Ahttps?://", "HTTP://"))
        .when(visit == 3, F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=x"), fragment))
        .otherwise(F.col("url")))
    tag = F.concat(F.lit('"'), F.md5(F.concat("html", version.cast("string"))), F.lit('"'))
    etag = (
        F.when(page % 13 == 0, None).when((visit == 3) & (page % 7 == 0), '"other"')
        .when((visit == 3) & (page % 3 == 0), F.concat(F.lit("W/"), tag)).otherwise(tag))
    modified = F.when(page % 2 == 0, F.concat(F.lit("day "), version.cast("string")))
    ts = (page % 1000 + page % 7 + visit * 1000).cast("bigint")
    headers = {
        "date": ts.cast("string"), "etag": etag, "last-modified": modified,
        "cache-control": F.when(visit != 1, F.concat(F.lit("max-age="), (visit * 60).cast("string"))),
        "content-length": F.when(full, F.length("html").cast("string")),
        "content-type": F.when(full, "text/html").when(page % 4 == 0, "text/plain"),
        "set-cookie": F.when(visit == 2, "a=b"), "vary": F.when(visit == 3, "accept")}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in headers.items()])
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return (
        pages.select("page_id", "url", "html").withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .select((page * 4 + visit).alias("record_id"), url.alias("url"), ts.alias("ts"),
                F.when(full, FULL).otherwise(NOT_MODIFIED).alias("status"), etag.alias("etag"),
                modified.alias("last_modified"), present.alias("headers")))
