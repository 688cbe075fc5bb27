"""Zeek ``dns.log`` files: tab separated, columns named by a ``#fields`` line."""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nametrail.functions.text import computed_once
from nametrail.sources.addresses import first_ip

# What a file means that does not say otherwise.
DEFAULT_UNSET = "-"
DEFAULT_SET_SEPARATOR = ","

# Largest number of files whose header table is broadcast (about 1 KB each).
MAX_BROADCAST_FILES = 20_000
_LAST_SECOND = 253_402_300_800


@dataclass(frozen=True)
class ZeekHeader:
    """Header of a file; pass one to skip the header scan."""

    fields: tuple[str, ...]
    unset_field: str = DEFAULT_UNSET
    set_separator: str = DEFAULT_SET_SEPARATOR


def _header_value(mark: str) -> Column:
    return F.when(
        F.col("value").startswith(f"#{mark}\t"),
        F.substring(F.col("value"), F.lit(len(mark) + 3), F.length("value")))


def _file_headers(lines: DataFrame) -> DataFrame:
    """One row per file that has a ``#fields`` line."""
    fields = _header_value("fields")
    return (
        lines.where(F.col("value").startswith("#"))
        .groupBy("_file")
        .agg(
            F.max(fields).alias("fields"),
            F.min(fields).alias("other_fields"),
            F.coalesce(F.max(_header_value("unset_field")), F.lit(DEFAULT_UNSET)).alias("unset"),
            F.coalesce(F.max(_header_value("set_separator")),
                       F.lit(DEFAULT_SET_SEPARATOR)).alias("separator"),
        )
        .where(F.col("fields").isNotNull())
    )


def _unescape(separator: str) -> str:
    return re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1), 16)), separator)


def _unescaped(separator: Column) -> Column:
    code = F.regexp_extract(separator, r"^\\x([0-9a-fA-F]{2})$", 1)
    return F.when(code != "", F.decode(F.unhex(code), "UTF-8")).otherwise(separator)


def _records(rows: DataFrame, cell: Callable[[str], Column], unset: Column,
             separator: Column) -> DataFrame:
    """Raw event rows from ``parts``; cells beyond a short row are null."""
    def set_of(name: str) -> Column:
        value = cell(name)
        return F.when((value != "") & (value != unset),
                      F.split(value, F.concat(F.lit("\\Q"), separator, F.lit("\\E"))))

    seconds = cell("ts").try_cast("double")
    ttl = F.get(set_of("TTLs"), F.lit(0)).try_cast("double").try_cast("bigint")
    code = cell("rcode_name")
    in_range = seconds.between(-62_135_596_800, _LAST_SECOND) & (seconds < _LAST_SECOND)
    return rows.select(
        F.timestamp_micros(F.when(in_range, F.round(seconds * 1_000_000).cast("bigint")))
        .alias("timestamp"),
        F.coalesce(cell("id.orig_h"), F.lit("")).alias("src_ip"),
        F.coalesce(cell("query"), F.lit("")).alias("query_name"),
        F.coalesce(cell("qtype_name"), F.lit("")).alias("query_type"),
        F.when(code != unset, F.upper(code)).otherwise(F.lit("")).alias("response_code"),
        F.coalesce(first_ip(set_of("answers")), F.lit("")).alias("response_ip"),
        F.coalesce(ttl, F.lit(0).cast("bigint")).alias("ttl"),
    )


def _parts(lines: DataFrame) -> DataFrame:
    data = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return data.withColumn("parts", computed_once(F.split("value", "\t")))


def parse_zeek_lines(lines: DataFrame, header: ZeekHeader) -> DataFrame:
    """Raw rows from lines that share one known header; also for streams."""
    places = {name: i for i, name in enumerate(header.fields)}

    def cell(name: str) -> Column:
        if name not in places:
            return F.lit(None).cast("string")
        return F.get("parts", F.lit(places[name]))

    return _records(_parts(lines), cell, F.lit(header.unset_field), F.lit(header.set_separator))


def _parse_mixed(lines: DataFrame, headers: DataFrame, small: bool) -> DataFrame:
    """Files with different headers: each line meets the header of its file."""
    named = headers.select(
        "_file", F.split("fields", "\t").alias("names"), "unset",
        _unescaped(F.col("separator")).alias("separator"))
    rows = _parts(lines).join(F.broadcast(named) if small else named, "_file")

    def cell(name: str) -> Column:
        place = F.array_position("names", F.lit(name)).cast("int") - 1
        return F.when(place >= 0, F.get("parts", place))

    return _records(rows, cell, F.col("unset"), F.col("separator"))


def read_zeek(spark: SparkSession, path, header: ZeekHeader | None = None) -> DataFrame:
    """Raw rows of one file or many.

    Without ``header`` one job reads the header lines. Files that all share one
    header (the usual case) are then parsed without a join. Otherwise every line
    is joined to the header of its file, broadcast only below
    ``MAX_BROADCAST_FILES`` files. A file with two different ``#fields`` lines
    raises.
    """
    lines = spark.read.text(path)
    if header is not None:
        return parse_zeek_lines(lines, header)

    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"))
    headers = _file_headers(lines)
    kinds = (
        headers.groupBy("fields", "unset", "separator")
        .agg(F.count("*").alias("files"),
             F.count_if(F.col("fields") != F.col("other_fields")).alias("changed"))
        .agg(F.count("*").alias("kinds"), F.sum("files").alias("files"),
             F.sum("changed").alias("changed"), F.first("fields").alias("fields"),
             F.first("unset").alias("unset"), F.first("separator").alias("separator"))
        .first()
    )
    if kinds.changed:
        raise ValueError("a Zeek file changes its #fields line midway")
    if kinds.kinds == 0:
        return _parse_mixed(lines, headers, small=True)
    if kinds.kinds == 1:
        known = ZeekHeader(tuple(kinds.fields.split("\t")), kinds.unset, _unescape(kinds.separator))
        return parse_zeek_lines(_with_header_only(lines, headers, kinds.files), known)
    return _parse_mixed(lines, headers, small=kinds.files <= MAX_BROADCAST_FILES)


def _with_header_only(lines: DataFrame, headers: DataFrame, n_files: int) -> DataFrame:
    """Drop files without any header when there are some."""
    if len(lines.inputFiles()) == n_files:
        return lines
    keep = headers.select("_file")
    return lines.join(
        F.broadcast(keep) if n_files <= MAX_BROADCAST_FILES else keep, "_file", "left_semi")
