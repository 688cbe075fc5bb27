"""(host, name) pairs queried at regular intervals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametrail.functions.scoring import capped
from nametrail.operators.alerts import to_alerts
from nametrail.operators.skew import HEAVY_MIN_ROWS, heavy_by_count, sliced

# Score weights and the query count that counts as full.
REGULARITY_WEIGHT, COUNT_WEIGHT = 0.7, 0.3
FULL_COUNT = 50

KEY = ["src_ip", "query_name"]
SLICE_US = 60_000_000
_EXACT = "decimal(38,0)"


def _product(a: str, b: str) -> Column:
    return (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast(_EXACT)



def interval_stats(events: DataFrame, min_queries: int, heavy_min_rows: int, slice_us: int,
                   names: DataFrame | None = None) -> DataFrame:
    """Count, mean and population deviation of the gaps between queries.

    Pairs with too few queries leave by their exact counts before any row is shuffled or
    sorted. Gaps are taken inside each slice; the squares of these and of the gaps between
    slices are summed per key as whole numbers, so the order of adding cannot matter.
    Queries at one instant are gaps of zero.
    """
    counted = (events.groupBy(*KEY).agg(F.count("*").alias("n_rows")) if names is None
               else names.groupBy(*KEY).agg(F.sum("n").alias("n_rows")))
    counts = counted.where(F.col("n_rows") >= min_queries)
    rows = events.select(*KEY, F.unix_micros("timestamp").alias("us")).join(
        counts.select(*KEY), KEY, "left_semi")
    heavy = heavy_by_count(counts, KEY, "n_rows", heavy_min_rows)
    in_slice = Window.partitionBy(*KEY, "slice").orderBy("us")
    slices = (
        sliced(rows, KEY, slice_us, heavy)
        .withColumn("gap", F.col("us") - F.lag("us").over(in_slice))
        .groupBy(*KEY, "slice")
        .agg(F.sum("copies").alias("n"), F.min("us").alias("first_us"),
             F.max("us").alias("last_us"), F.sum(_product("gap", "gap")).alias("squares")))
    by_slice = Window.partitionBy(*KEY).orderBy("slice")
    n, span, near = F.col("n_queries"), F.col("span"), F.col("near")
    # Deviations are taken from the whole number nearest the mean: small and exact.
    squares = (F.col("squares") - 2 * _product("near", "span")
               + _product("near", "near") * (n - 1).cast("decimal(19,0)"))
    mean_us = span / (n - 1)
    return (
        slices
        .withColumn("between", F.col("first_us") - F.lag("last_us").over(by_slice))
        .groupBy(*KEY)
        .agg(F.sum("n").alias("n_queries"), F.max("last_us").alias("last_us"),
             (F.max("last_us") - F.min("first_us")).alias("span"),
             (F.coalesce(F.sum("squares"), F.lit(0).cast(_EXACT))
              + F.coalesce(F.sum(_product("between", "between")), F.lit(0).cast(_EXACT)))
             .cast(_EXACT).alias("squares"))
        .where((n >= min_queries) & (span > 0))
        .withColumn("near", F.round(mean_us).cast("bigint"))
        .withColumn("variance_us", F.greatest(
            F.lit(0.0), squares.cast("double") / (n - 1) - F.pow(mean_us - near, 2)))
        .select(*KEY, "n_queries", F.timestamp_micros("last_us").alias("last_seen"),
                (mean_us / 1_000_000).alias("mean_interval_sec"),
                (F.sqrt("variance_us") / 1_000_000).alias("std_interval_sec"))
    )


def beaconing_features(events: DataFrame, min_queries: int = 6, cv_threshold: float = 0.20, *,
                       heavy_min_rows: int = HEAVY_MIN_ROWS, slice_us: int = SLICE_US,
                       names: DataFrame | None = None) -> DataFrame:
    """Interval metrics and raw score of every pair with a positive mean gap."""
    cv = F.col("coefficient_of_variation")
    score = 100 * (
        REGULARITY_WEIGHT * F.greatest(F.lit(0.0), 1 - cv / cv_threshold)
        + COUNT_WEIGHT * capped(F.col("n_queries"), FULL_COUNT))
    return (
        interval_stats(events, max(min_queries, 2), heavy_min_rows, slice_us, names)
        .withColumn("coefficient_of_variation",
                    F.col("std_interval_sec") / F.col("mean_interval_sec"))
        .withColumn("score", score)
    )


def detect_beaconing(events: DataFrame, min_queries: int = 6, cv_threshold: float = 0.20,
                     score_threshold: float = 50.0, *, heavy_min_rows: int = HEAVY_MIN_ROWS,
                     slice_us: int = SLICE_US, names: DataFrame | None = None) -> DataFrame:
    flagged = beaconing_features(
        events, min_queries, cv_threshold, heavy_min_rows=heavy_min_rows, slice_us=slice_us,
        names=names,
    ).where((F.col("coefficient_of_variation") <= cv_threshold)
            & (F.col("score") >= score_threshold))
    return to_alerts(
        flagged, "beaconing",
        domain=F.col("query_name"), src_ip=F.col("src_ip"), mitre_id="T1071.004",
        reason=F.format_string(
            "%s asked for %s %d times, about every %.0f s (deviation %.1f s, variation %.2f), "
            "as an automated check-in would. Mail sync and update checks poll like this too: "
            "check the destination first.",
            "src_ip", "query_name", "n_queries", "mean_interval_sec", "std_interval_sec",
            "coefficient_of_variation"),
        evidence=[
            F.col("n_queries"),
            F.round("mean_interval_sec", 1).alias("mean_interval_sec"),
            F.round("std_interval_sec", 2).alias("std_interval_sec"),
            F.round("coefficient_of_variation", 3).alias("coefficient_of_variation"),
        ])
