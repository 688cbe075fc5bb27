"""Domains that resolve to many addresses with short lifetimes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametrail.constants import MAX_HOSTS_PER_ALERT
from nametrail.functions.scoring import capped
from nametrail.operators.alerts import to_alerts
from nametrail.operators.rollup import resolved, with_hosts

# Score weights, address-share factor, lifetime scale, address
# count that counts as full.
IP_WEIGHT, TTL_WEIGHT, VOLUME_WEIGHT = 0.40, 0.30, 0.30
IP_SHARE_FACTOR = 1.5
SHORT_TTL, TTL_RANGE = 300, 3600
FULL_IPS = 10


def fast_flux_features(events: DataFrame, min_resolved: int = 8, min_distinct_ips: int = 4, *,
                       answers: DataFrame | None = None) -> DataFrame:
    """Address metrics and raw score of every domain past both gates.

    Grouped by (domain, address) first, so a domain with most of the traffic
    arrives as one row per address and map task.
    """
    if answers is None:
        by_address = events.where(resolved()).groupBy("registrable_domain", "response_ip").agg(
            F.count("*").alias("c"), F.sum(F.col("ttl").cast("double")).alias("ttl_sum"),
            F.max("timestamp").alias("last_seen"))
    else:
        by_address = answers.where(F.col("response_ip").isNotNull()).groupBy(
            "registrable_domain", "response_ip").agg(
            F.sum("c").alias("c"), F.sum("ttl_sum").alias("ttl_sum"),
            F.max("last_seen").alias("last_seen"))
    ttl = F.col("avg_ttl")
    ttl_score = F.when(ttl <= SHORT_TTL, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - (ttl - SHORT_TTL) / TTL_RANGE))
    score = 100 * (
        IP_WEIGHT * F.least(F.col("ip_ratio") * IP_SHARE_FACTOR, F.lit(1.0))
        + TTL_WEIGHT * ttl_score + VOLUME_WEIGHT * capped(F.col("distinct_ips"), FULL_IPS))
    return (
        by_address.groupBy("registrable_domain")
        .agg(F.count("*").alias("distinct_ips"), F.sum("c").alias("n_resolved"),
             F.sum("ttl_sum").alias("_ttl_sum"), F.max("last_seen").alias("last_seen"))
        .where((F.col("n_resolved") >= min_resolved)
               & (F.col("distinct_ips") >= min_distinct_ips))
        .withColumn("ip_ratio", F.col("distinct_ips") / F.col("n_resolved"))
        .withColumn("avg_ttl", F.col("_ttl_sum") / F.col("n_resolved"))
        .select("registrable_domain", "distinct_ips", "n_resolved", "ip_ratio", "avg_ttl",
                "last_seen", score.alias("score"))
    )


def detect_fast_flux(events: DataFrame, min_resolved: int = 8, min_distinct_ips: int = 4,
                     score_threshold: float = 45.0, *, max_hosts: int = MAX_HOSTS_PER_ALERT,
                     pairs: DataFrame | None = None,
                     answers: DataFrame | None = None) -> DataFrame:
    flagged = fast_flux_features(events, min_resolved, min_distinct_ips, answers=answers).where(
        F.col("score") >= score_threshold)
    return to_alerts(
        with_hosts(flagged, events, pairs, max_hosts, "n_resolved"), "fast_flux",
        domain=F.col("registrable_domain"), src_ip=F.col("hosts"), mitre_id="T1568.001",
        reason=F.format_string(
            "%d lookups of %s returned %d different addresses with an average lifetime of "
            "%.0f s, as rotating front ends would.",
            "n_resolved", "registrable_domain", "distinct_ips", "avg_ttl"),
        evidence=[
            F.col("distinct_ips"),
            F.col("n_resolved").alias("n_resolved_queries"),
            F.round("ip_ratio", 2).alias("unique_ip_ratio"),
            F.round("avg_ttl", 1).alias("avg_ttl_sec"),
        ])
