"""(host, domain) pairs that look like data carried in subdomains."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import CARRIER_TYPES
from nametrail.functions.scoring import capped
from nametrail.functions.text import shannon_entropy
from nametrail.operators.alerts import percent, to_alerts
from nametrail.operators.rollup import after_grouping

# Feature weights, the values that count as full.
LENGTH_WEIGHT, TYPE_WEIGHT, RATE_WEIGHT, UNIQUE_WEIGHT, ENTROPY_WEIGHT = 0.25, 0.2, 0.2, 0.2, 0.15
FULL_LENGTH, FULL_RATE, FULL_ENTROPY = 50, 10, 4.5
SHORTEST_MINUTES = 1 / 60


def tunneling_score() -> Column:
    return 100 * (
        LENGTH_WEIGHT * capped(F.col("avg_len"), FULL_LENGTH)
        + TYPE_WEIGHT * F.col("txt_null_ratio")
        + RATE_WEIGHT * capped(F.col("rate"), FULL_RATE)
        + UNIQUE_WEIGHT * F.col("unique_ratio")
        + ENTROPY_WEIGHT * capped(F.col("avg_entropy"), FULL_ENTROPY))


def duration_minutes() -> Column:
    """Minutes from ``first_seen`` to ``last_seen``, at least one second."""
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 60_000_000
    return F.greatest(span, F.lit(SHORTEST_MINUTES))


def tunneling_features(events: DataFrame, min_queries: int = 20, *,
                       names: DataFrame | None = None) -> DataFrame:
    """Metrics and raw score of every pair with at least ``min_queries`` queries.

    First grouped by distinct subdomain: that spreads a busy pair over many
    tasks, counts the distinct names, and lets the entropy be computed once per
    name (weighted by its count) instead of once per query.
    """
    longer = F.col("subdomain_label_count") > 0
    key = ["src_ip", "registrable_domain", "subdomain"]
    if names is None:
        counted = events.where(longer).groupBy(*key).agg(
            F.count("*").alias("c"),
            F.count_if(F.col("query_type").isin(CARRIER_TYPES)).alias("carriers"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    else:
        counted = names.where(longer).groupBy(*key).agg(
            F.sum("n").alias("c"), F.sum("n_carriers").alias("carriers"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    names = (
        counted
        .withColumn("packed", F.replace("subdomain", F.lit("."), F.lit("")))
        .withColumn("entropy", after_grouping(shannon_entropy("packed"), "c"))
    )
    n = F.col("n_queries")
    return (
        names.groupBy("src_ip", "registrable_domain")
        .agg(F.sum("c").alias("n_queries"), F.count("*").alias("_names"),
             F.sum("carriers").alias("_carriers"),
             F.sum(F.col("c") * F.length("subdomain")).alias("_chars"),
             F.sum(F.col("c") * F.col("entropy")).alias("_bits"),
             F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        .where(n >= min_queries)
        .withColumn("duration_min", duration_minutes())
        .withColumn("rate", n / F.col("duration_min"))
        .withColumn("avg_len", F.col("_chars") / n)
        .withColumn("txt_null_ratio", F.col("_carriers") / n)
        .withColumn("unique_ratio", F.col("_names") / n)
        .withColumn("avg_entropy", F.col("_bits") / n)
        .select("src_ip", "registrable_domain", "n_queries", "last_seen", "duration_min", "rate",
                "avg_len", "txt_null_ratio", "unique_ratio", "avg_entropy",
                tunneling_score().alias("score"))
    )


def detect_tunneling(events: DataFrame, min_queries: int = 20, score_threshold: float = 45.0, *,
                     names: DataFrame | None = None) -> DataFrame:
    flagged = tunneling_features(events, min_queries, names=names).where(
        F.col("score") >= score_threshold)
    return to_alerts(
        flagged, "tunneling",
        domain=F.col("registrable_domain"), src_ip=F.col("src_ip"), mitre_id="T1071.004",
        reason=F.format_string(
            "%s sent %d queries below %s in %.1f minutes (%.1f per minute); subdomains average "
            "%.0f characters, %.0f%% are unique and %.0f%% of queries are TXT or NULL. "
            "This fits data hidden in query names.",
            "src_ip", "n_queries", "registrable_domain", "duration_min", "rate", "avg_len",
            percent("unique_ratio"), percent("txt_null_ratio")),
        evidence=[
            F.col("n_queries"),
            F.round("avg_len", 1).alias("avg_subdomain_len_chars"),
            F.round("rate", 2).alias("queries_per_min"),
            F.round("unique_ratio", 2).alias("unique_label_ratio"),
            F.round("txt_null_ratio", 2).alias("txt_null_ratio"),
            F.round("avg_entropy", 2).alias("avg_subdomain_entropy"),
        ])
