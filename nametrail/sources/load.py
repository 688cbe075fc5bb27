"""One entry point for the three log formats."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from nametrail.sources.bind import read_bind
from nametrail.sources.delimited import read_csv
from nametrail.sources.normalize import normalize_events
from nametrail.sources.zeek import read_zeek

READERS = {"csv": read_csv, "bind": read_bind, "zeek": read_zeek}


def detect_format(spark: SparkSession, path: str) -> str:
    """Format by suffix, else by the first line; ``csv`` when in doubt."""
    if str(path).lower().endswith(".csv"):
        return "csv"
    try:
        first = spark.read.text(path).first()
    except AnalysisException:
        return "csv"
    line = first.value if first else ""
    if line.startswith(("#separator", "#fields")):
        return "zeek"
    if re.match(r"\d{2}-[A-Za-z]{3}-\d{4}\s", line):
        return "bind"
    return "csv"


def load_log(spark: SparkSession, path, fmt: str = "auto", source_tz: str = "UTC",
             keep_extra: bool = False, **reader_options) -> DataFrame:
    """Read DNS logs (a file, a directory or a glob) into ``EVENT_SCHEMA``.

    ``fmt``: ``auto | csv | bind | zeek``. ``auto`` looks at the first line of
    the path; give the format for directories that mix formats. Reader options:
    ``header`` (zeek), ``dedupe_errors`` (bind).
    """
    path = [str(p) for p in path] if isinstance(path, (list, tuple)) else str(path)
    if fmt == "auto":
        fmt = detect_format(spark, path if isinstance(path, str) else path[0])
    if fmt not in READERS:
        raise ValueError(f"unknown log format {fmt!r}: expected auto, {', '.join(READERS)}")
    raw = READERS[fmt](spark, path, **reader_options)
    zone = "UTC" if fmt == "zeek" else source_tz
    if fmt == "bind" and zone != "UTC":
        raw = raw.withColumn("timestamp", raw["timestamp"].cast("string"))
    return normalize_events(raw, zone, keep_extra)
