"""WARC revisit records of the kind "server not modified", resolved to full responses.

A revisit has no body of its own. It stands for the latest earlier full response of the
same canonical URL, if their validators agree; then the headers that a 304 answer may
renew are taken from the revisit and all others from the response.

The as-of join works on times and ids alone and in slices of time: per URL and slice the
latest response is found by aggregation, these are carried forward over the slices of a
URL, and only records of one URL and slice are ordered with each other. So a URL with a
large share of all records is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
SLICE_SECONDS = 3600
# The header fields a 304 answer may renew (RFC 9110, 15.4.5).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that only track visitors.
TRACKING = "utm_[A-Za-z0-9_]*|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path and query; scheme, fragment, tracking
    parameters, and slashes at the end go. Null stays null."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(host, ":(80|443)$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "([?&])&+", "$1"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+($|[?])", "$1"))


def _headers(headers: Column) -> Column:
    """Headers as (name, value) by name in lower case; of repeated names the first."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(F.trim(e["key"])).alias("name"), e["value"].alias("value")))
    names = F.transform(named, lambda e: e["name"])
    return F.coalesce(F.filter(named, lambda e, i: F.array_position(names, e["name"]) == i + 1),
                      F.array().cast("array<struct<name: string, value: string>>"))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda e: e["name"] == name), F.lit(0))["value"]


def latest_response(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(record_id, response_id) of each revisit in `records` (record_id, target, ts, full):
    the latest record before it, by (ts, record_id), that is full and has its target."""
    last = F.when(F.col("full"), F.struct("ts", "record_id"))
    sliced = records.where("target is not null and ts is not null").withColumn(
        "slice", F.floor(F.col("ts") / slice_seconds))
    earlier = Window.partitionBy("target").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = sliced.groupBy("target", "slice").agg(F.max(last).alias("last")).select(
        "target", "slice", F.max("last").over(earlier)["record_id"].alias("carried"))
    before = Window.partitionBy("target", "slice").orderBy("ts", "record_id").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = sliced.withColumn("inside", F.max(last).over(before)["record_id"]).where("not full")
    return inside.join(carried, ["target", "slice"], "left").select(
        "record_id", F.coalesce("inside", "carried").alias("response_id"))


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit: record_id, target (canonical URL), response_id, verdict, headers.

    `records` has record_id, url, ts (seconds), kind ('response' or 'revisit') and headers (map
    of strings); other columns are left out, rows of another kind are passed over. A record
    given several times counts once; of different records under one id the earliest does (then
    the smallest target, a revisit before a response, the smallest headers). A revisit without
    an id is told as missing, once for equal rows.

    verdict is `missing` without an earlier response (or without URL or time), `matched` if
    the entity tags agree (weak comparison) or, where one of the two has none, the
    modification dates do; `mismatched` if the first that can be compared differs;
    `unchecked` if neither can. headers, an array of (name, value) by name, are the merged
    ones of matched and unchecked revisits and the revisit's own otherwise.
    """
    known = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("target"), F.col("ts").cast("bigint").alias("ts"),
        (F.col("kind") == "response").alias("full"), _headers(F.col("headers")).alias("headers"))
    first = F.min(F.struct("ts", "target", "full", "headers")).alias("first")
    known = (known.where("record_id is not null").groupBy("record_id").agg(first)
             .select("record_id", "first.*")
             .unionByName(known.where("record_id is null").distinct()))
    found = latest_response(known.select("record_id", "target", "ts", "full"), slice_seconds)
    responses = known.where("full").select(
        F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    joined = (known.where("not full").join(found, "record_id", "left")
              .join(responses, "response_id", "left"))
    new, stored = F.col("headers"), F.col("stored")

    def same(name: str) -> Column:  # null if one of the two has none
        weak = "^W/"
        return F.regexp_replace(_header(new, name), weak, "") == F.regexp_replace(
            _header(stored, name), weak, "")

    agree = F.coalesce(same("etag"), same("last-modified"))
    verdict = (F.when(F.col("response_id").isNull(), "missing").when(agree, "matched")
               .when(~agree, "mismatched").otherwise("unchecked"))
    renewed = F.filter(new, lambda e: e["name"].isin(*RENEWED))
    names = F.transform(renewed, lambda e: e["name"])
    merged = F.concat(renewed, F.filter(stored, lambda e: ~F.array_contains(names, e["name"])))
    return joined.withColumn("verdict", verdict).select(
        "record_id", "target", "response_id", "verdict",
        F.array_sort(F.when(F.col("verdict").isin("matched", "unchecked"), merged).otherwise(new))
        .alias("headers"))
