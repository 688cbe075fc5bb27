"""Hosts with a burst of failed lookups inside a sliding time window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nametrail.operators.alerts import joined, percent, to_alerts
from nametrail.operators.rollup import host_totals
from nametrail.operators.skew import HEAVY_MIN_ROWS, heavy_by_count, sliced

# Score weights, sample names per alert.
BURST_WEIGHT, RATIO_WEIGHT = 0.6, 0.4
SAMPLE_NAMES = 3

SLICE_US = 60_000_000
#: Failures of one host and window width that one task joins with the host's window.
SPLIT_ROWS = 1_000_000


def _window_us(window_minutes: float) -> int:
    return round(window_minutes * 60_000_000)


def largest_windows(failed: DataFrame, heavy: DataFrame, window_us: int, min_count: int,
                    slice_us: int) -> DataFrame:
    """Per host: most failures in a closed window, and when that window ends.

    Each failure adds one at its time and takes one away when it leaves the
    window; the running sum at a failure is the count of the window that ends
    there. That is linear, where a sliding range frame recounts its whole frame
    for every row. A departure sorts after the failures of the same instant
    because the window is closed. Slices of heavy hosts run on their own and
    carry the sum of all earlier slices. The first window with the largest count
    wins. Hosts whose maximum stays below ``min_count`` may be left out.
    """
    steps = sliced(failed.select("src_ip", "us"), ["src_ip"], slice_us, heavy).select(
        "src_ip", F.col("slice").isNotNull().alias("heavy"),
        F.inline(F.array(
            F.struct(F.col("us").alias("at"), F.lit(0).alias("leaves"),
                     F.col("copies").alias("delta")),
            F.struct((F.col("us") + window_us).alias("at"), F.lit(1).alias("leaves"),
                     (-F.col("copies")).alias("delta")))),
    ).withColumn("slice", F.when(F.col("heavy"), F.expr(f"at div {slice_us}")))

    so_far = (
        Window.partitionBy("src_ip", "slice").orderBy("at", "leaves")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = (
        steps.withColumn("running", F.sum("delta").over(so_far))
        .groupBy("src_ip", "slice")
        .agg(F.max(F.when(F.col("leaves") == 0, F.struct("running", (-F.col("at")).alias("neg"))))
             .alias("peak"),
             F.sum("delta").alias("delta"))
        .where(F.col("slice").isNotNull() | (F.col("peak.running") >= min_count))
    )
    earlier = (
        Window.partitionBy("src_ip").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1))
    carried = F.coalesce(F.sum("delta").over(earlier), F.lit(0))
    return (
        slices.withColumn("carried", carried)
        .groupBy("src_ip")
        .agg(F.max(F.when(F.col("peak").isNotNull(), F.struct(
            (F.col("carried") + F.col("peak.running")).alias("n"), "peak.neg"))).alias("best"))
        .select("src_ip", F.col("best.n").alias("max_nxdomain_in_window"),
                (-F.col("best.neg")).alias("end_us"))
        .where(F.col("max_nxdomain_in_window") >= min_count)
    )


def host_failures(events: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``src_ip, host_total, total_nxdomain_events``."""
    return host_totals(events, pairs).select(
        "src_ip", F.col("n_queries").alias("host_total"),
        F.col("n_nx").alias("total_nxdomain_events"))


def able_failures(events: DataFrame, hosts: DataFrame, count_threshold: int = 20,
                  min_total: int = 10) -> DataFrame:
    """``src_ip, query_name, us``: failures of the hosts that have enough of them for a burst at
    all; the others' are neither shuffled nor sorted. Bursts and their names both start here."""
    able = hosts.where(F.col("total_nxdomain_events") >= max(count_threshold, min_total))
    return events.where(F.col("response_code") == "NXDOMAIN").select(
        "src_ip", "query_name", F.unix_micros("timestamp").alias("us")).join(
        able.select("src_ip"), "src_ip", "left_semi")


def _scored(bursts: DataFrame, hosts: DataFrame, count_threshold: int,
            min_total: int) -> DataFrame:
    score = 100 * F.least(
        F.lit(1.0),
        BURST_WEIGHT * (F.col("max_nxdomain_in_window") / F.lit(count_threshold * 2.0))
        + RATIO_WEIGHT * F.col("host_nxdomain_ratio"))
    return (
        bursts.join(hosts.where(F.col("total_nxdomain_events") >= min_total), "src_ip")
        .withColumn("host_nxdomain_ratio", F.col("total_nxdomain_events") / F.col("host_total"))
        .select("src_ip", "max_nxdomain_in_window", "total_nxdomain_events", "host_total",
                "host_nxdomain_ratio", "end_us",
                F.timestamp_micros("end_us").alias("last_seen"), score.alias("score"))
    )


def nxdomain_features(events: DataFrame, window_minutes: float = 5.0, count_threshold: int = 20,
                      min_total: int = 10, *, pairs: DataFrame | None = None,
                      heavy_min_rows: int = HEAVY_MIN_ROWS, slice_us: int = SLICE_US,
                      failures: DataFrame | None = None) -> DataFrame:
    """Burst size, window end, sample names, failure ratio and raw score per flagged host."""
    hosts = host_failures(events, pairs)
    if failures is None:
        failures = able_failures(events, hosts, count_threshold, min_total)
    heavy = heavy_by_count(hosts, ["src_ip"], "total_nxdomain_events", heavy_min_rows)
    bursts = largest_windows(failures, heavy, _window_us(window_minutes), count_threshold, slice_us)
    return _scored(bursts, hosts, count_threshold, min_total).join(
        burst_names(failures, bursts, window_minutes), "src_ip")


def burst_names(failures: DataFrame, bursts: DataFrame, window_minutes: float,
                split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``src_ip, names``: the names that failed most inside each burst window.

    An interval join as an equi-join on bins: a window touches two time buckets of its own
    width. Buckets that hold over ``split_rows`` failures of a host are cut into as many bins
    of about that size by a hash of the row. Such buckets are counted first and broadcast: at
    most (failures / split_rows) rows. Names rank by count, then first failure, then text.
    """
    width = _window_us(window_minutes)
    merged = failures.groupBy("src_ip", "query_name", "us").agg(F.count("*").alias("copies"))
    failed = merged.withColumn("bucket", F.expr(f"us div {width}"))
    sizes = failed.groupBy("src_ip", "bucket").agg(F.count("*").alias("rows")).where(
        F.col("rows") > split_rows)
    large = F.broadcast(sizes.select(
        "src_ip", "bucket", F.ceil(F.col("rows") / split_rows).cast("bigint").alias("bins")))
    bins = F.coalesce("bins", F.lit(1).cast("bigint"))
    bucket = F.expr(f"end_us div {width}")
    spans = (
        bursts.select("src_ip", "end_us", F.explode(F.array(bucket - 1, bucket)).alias("bucket"))
        .join(large, ["src_ip", "bucket"], "left")
        .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), bins - 1))).drop("bins"))
    binned = failed.join(large, ["src_ip", "bucket"], "left").withColumn(
        "bin", F.pmod(F.xxhash64("us", "query_name"), bins)).drop("bins")
    rank = Window.partitionBy("src_ip").orderBy(F.desc("n"), "first_us", "query_name")
    return (
        binned.join(spans, ["src_ip", "bucket", "bin"])
        .where(F.col("us").between(F.col("end_us") - width, F.col("end_us")))
        .groupBy("src_ip", "query_name")
        .agg(F.sum("copies").alias("n"), F.min("us").alias("first_us"))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= SAMPLE_NAMES)
        .groupBy("src_ip")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "query_name"))).alias("ranked"))
        .select("src_ip", F.col("ranked.query_name").alias("names"))
    )


def detect_nxdomain_spike(events: DataFrame, window_minutes: float = 5.0,
                          count_threshold: int = 20, min_total: int = 10, *,
                          pairs: DataFrame | None = None,
                          heavy_min_rows: int = HEAVY_MIN_ROWS, slice_us: int = SLICE_US,
                          failures: DataFrame | None = None) -> DataFrame:
    flagged = nxdomain_features(
        events, window_minutes, count_threshold, min_total, pairs=pairs,
        heavy_min_rows=heavy_min_rows, slice_us=slice_us, failures=failures)
    return to_alerts(
        flagged, "nxdomain_spike",
        domain=joined(F.col("names")), src_ip=F.col("src_ip"), mitre_id="T1590.002",
        reason=F.format_string(
            "%d failed lookups (NXDOMAIN) by %s inside %s minutes; %.0f%% of all its queries "
            "fail. Most frequent: %s.",
            "max_nxdomain_in_window", "src_ip", F.lit(f"{window_minutes:g}"),
            percent("host_nxdomain_ratio"), F.array_join("names", ", ")),
        evidence=[
            F.col("max_nxdomain_in_window"),
            F.lit(float(window_minutes)).alias("window_minutes"),
            F.round("host_nxdomain_ratio", 2).alias("host_nxdomain_ratio"),
            F.col("total_nxdomain_events"),
        ])
