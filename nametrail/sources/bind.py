"""BIND ``named`` text logs (categories ``queries`` and ``query-errors``)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nametrail.functions.text import computed_once

# The two line formats. Groups: time, client, then per format
# name and type, or response code, name and type.
LINE_TIME = r"^(\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3}) "
CLIENT = r": info: client(?: @0x[0-9a-fA-F]+)? ([0-9a-fA-F:.]+)#\d+ \([^)]*\): "
QUERY_LINE = LINE_TIME + "queries" + CLIENT + r"query: (\S+) \S+ (\S+).*$"
ERROR_LINE = (
    LINE_TIME + "query-errors" + CLIENT
    + r"view \S+: query failed \(([A-Z]+)\) for (\S+)/IN/(\S+).*$"
)
TIME_FORMAT = "dd-MMM-yyyy HH:mm:ss.SSS"

_MARK = "\u0001"


def _groups(pattern: str, order: str) -> Column:
    """The groups of one regex pass as an array; one element if it fails."""
    return F.split(F.regexp_replace("value", pattern, order), _MARK)


def parse_bind_lines(lines: DataFrame, dedupe_errors: bool = False) -> DataFrame:
    """Raw rows from a column ``value`` of log lines; other lines are skipped.

    Both patterns fill the same order: time, client, name, type, code.
    ``dedupe_errors`` drops a query line when the error line of the same lookup
    (same client, name and type, within one second) is present.
    """
    fields = _MARK.join(["$1", "$2", "$3", "$4", ""])
    error_fields = _MARK.join(["$1", "$2", "$4", "$5", "$3"])
    rows = (
        lines.where(F.col("value").contains(": info: client"))
        .select(computed_once(
            F.when(F.col("value").contains(" query-errors: "), _groups(ERROR_LINE, error_fields))
            .otherwise(_groups(QUERY_LINE, fields))).alias("f"))
        .where(F.size("f") == 5)
        .select(
            F.try_to_timestamp(F.get("f", F.lit(0)), F.lit(TIME_FORMAT)).alias("timestamp"),
            F.get("f", F.lit(1)).alias("src_ip"),
            F.get("f", F.lit(2)).alias("query_name"),
            F.get("f", F.lit(3)).alias("query_type"),
            F.get("f", F.lit(4)).alias("response_code"),
            F.lit("").alias("response_ip"),
            F.lit(0).alias("ttl"),
        )
    )
    return _drop_answered_twice(rows) if dedupe_errors else rows


def _drop_answered_twice(rows: DataFrame) -> DataFrame:
    """Equi-join on the lookup key and the second, so that hot clients spread."""
    key = ["src_ip", "query_name", "query_type"]
    second = F.floor(F.unix_micros("timestamp") / 1_000_000)
    errors = (
        rows.where(F.col("response_code") != "")
        .select(*key, F.col("timestamp").alias("_failed_at"), second.alias("_s"))
        .withColumn("_second", F.explode(F.array("_s", F.col("_s") - 1)))
        .drop("_s")
    )
    queries = rows.where(F.col("response_code") == "").withColumn("_second", second)
    gap = F.unix_micros("_failed_at") - F.unix_micros("timestamp")
    unanswered = (
        queries.alias("q").join(
            errors.alias("e"),
            [F.col(f"q.{c}") == F.col(f"e.{c}") for c in [*key, "_second"]]
            + [gap.between(0, 1_000_000)],
            "left_anti")
        .drop("_second")
    )
    return unanswered.unionByName(rows.where(F.col("response_code") != ""))


def read_bind(spark: SparkSession, path, dedupe_errors: bool = False) -> DataFrame:
    return parse_bind_lines(spark.read.text(path), dedupe_errors)
