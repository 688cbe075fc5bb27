"""Domains registered only days before they are queried."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametrail.constants import MAX_HOSTS_PER_ALERT
from nametrail.functions.scoring import capped
from nametrail.operators.alerts import empty_alerts, to_alerts
from nametrail.operators.rollup import aged, with_hosts

# Score weights and the query count that counts as full.
FRESH_WEIGHT, VOLUME_WEIGHT = 0.75, 0.25
FULL_COUNT = 15


def newly_registered_features(events: DataFrame, max_age_days: float = 7.0, *,
                              answers: DataFrame | None = None) -> DataFrame:
    """First known age and raw score of every domain that has an age.

    The age of a domain hardly varies, so grouping by (domain, age) first leaves
    few rows and keeps the first step a hash aggregation; the earliest age (the
    smaller one when two share an instant) is then picked from those rows.
    """
    if answers is None:
        by_age = events.where(aged()).groupBy("registrable_domain", "first_registered_days_ago").agg(
            F.count("*").alias("c"), F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"))
    else:
        by_age = answers.where(aged()).groupBy("registrable_domain", "first_registered_days_ago").agg(
            F.sum("c").alias("c"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"))
    age = F.col("first_registered_days_ago")
    score = 100 * (
        FRESH_WEIGHT * (1 - F.col("age_days") / max_age_days)
        + VOLUME_WEIGHT * capped(F.col("n_queries"), FULL_COUNT))
    return (
        by_age.groupBy("registrable_domain")
        .agg(F.min_by(age, F.struct("first_seen", age)).alias("age_days"),
             F.sum("c").alias("n_queries"), F.max("last_seen").alias("last_seen"))
        .withColumn("score", score)
    )


def detect_newly_registered_domain(events: DataFrame, max_age_days: float = 7.0,
                                   score_threshold: float = 40.0, *,
                                   max_hosts: int = MAX_HOSTS_PER_ALERT,
                                   pairs: DataFrame | None = None,
                                   answers: DataFrame | None = None) -> DataFrame:
    if "first_registered_days_ago" not in events.columns:
        return empty_alerts(events.sparkSession).drop("alert_id")
    flagged = newly_registered_features(events, max_age_days, answers=answers).where(
        (F.col("age_days") <= max_age_days) & (F.col("score") >= score_threshold))
    return to_alerts(
        with_hosts(flagged, events, pairs, max_hosts, "n_aged"), "newly_registered",
        domain=F.col("registrable_domain"), src_ip=F.col("hosts"), mitre_id="T1583.001",
        reason=F.format_string(
            "%s was registered %.0f day(s) before it was first seen and already has %d "
            "quer(ies); established services are rarely that young.",
            "registrable_domain", "age_days", "n_queries"),
        evidence=[F.round("age_days", 1).alias("age_days"), F.col("n_queries")])
