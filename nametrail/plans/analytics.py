"""Traffic statistics, alert search and drill-downs."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import LIST_SEPARATOR, MITRE_TACTIC, MITRE_TECHNIQUES, TACTIC_ORDER
from nametrail.functions.scoring import severity_rank, tactic_rank
from nametrail.functions.text import REGISTRABLE_DOMAIN
from nametrail.operators.rollup import pair_rollup
from nametrail.plans.evaluation import evaluate_against_ground_truth
from nametrail.plans.pipeline import alert_order, numbered
from nametrail.plans.risk import (
    compute_host_risk,
    host_alert_timeline,
    host_tactic_summary,
    kill_chain,
    one_row,
)


def kpis(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Queries, hosts, domains and alerts, one row.

    The distinct counts run on the (host, domain) rollup: the events are
    aggregated on the map side once instead of being expanded per distinct count.
    """
    traffic = pair_rollup(events).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"),
        F.count_distinct("src_ip").alias("unique_hosts"),
        F.count_distinct("registrable_domain").alias("unique_domains"))
    return one_row([traffic, alerts.agg(F.count("*").alias("alerts_raised"))])


#: Buckets that one row of the spine spells out.
SPINE_BUCKETS = 1024


def traffic_series(events: DataFrame, bucket: str = "15 minutes") -> DataFrame:
    """Queries per time bucket from the first to the last, empty ones as zero.

    The spine grows in two steps, blocks of buckets and then the buckets of a block, dealt
    to all tasks in between, so a log with one time far off gives no array of its length.
    The events are read once: first and last bucket come from the counts, whose exchange
    both sides share.
    """
    width = events.sparkSession.sql(
        f"SELECT CAST(unix_micros(timestamp_micros(0) + INTERVAL {bucket}) AS BIGINT)").first()[0]
    at = F.floor(F.unix_micros("timestamp") / F.lit(width).cast("decimal(20,0)")).cast("bigint")
    counts = events.groupBy(at.alias("at")).agg(F.count("*").alias("n_queries"))
    ends = counts.agg(F.min("at").alias("a"), F.max("at").alias("b"),
                      F.sum("n_queries").alias("n")).where("n > 0")  # same columns: same exchange
    blocks = ends.select("a", "b", F.explode(F.sequence(
        F.floor(F.col("a") / SPINE_BUCKETS), F.floor(F.col("b") / SPINE_BUCKETS))).alias("block"))
    begin = F.col("block") * SPINE_BUCKETS
    spine = blocks.repartition("block").select(F.explode(F.sequence(
        F.greatest("a", begin), F.least("b", begin + SPINE_BUCKETS - 1))).alias("at"))
    return (
        spine.join(counts, "at", "left")
        .select(F.timestamp_micros(F.col("at") * width).alias("bucket_start"),
                F.coalesce("n_queries", F.lit(0)).alias("n_queries"))
        .orderBy("bucket_start"))


def value_counts(table: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties in text order."""
    counts = table.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if limit is None else counts.limit(limit)


def top_talkers(events: DataFrame, limit: int = 10) -> DataFrame:
    return value_counts(events, "src_ip", limit)


def top_domains(events: DataFrame, limit: int = 10) -> DataFrame:
    return value_counts(events, "registrable_domain", limit)


def response_codes(events: DataFrame) -> DataFrame:
    return value_counts(events, "response_code")


def alerts_by_detector(alerts: DataFrame) -> DataFrame:
    return value_counts(alerts, "detector")


def alert_search(alerts: DataFrame, severities: Sequence[str] | None = None,
                 detectors: Sequence[str] | None = None, term: str = "",
                 literal: bool = False) -> DataFrame:
    """Alerts by severity, detector and a case-insensitive term.

    The term is a regular expression looked for in the domain and host lists;
    with ``literal`` it is plain text.
    """
    found = alerts
    if severities is not None:
        found = found.where(F.col("severity_label").isin(list(severities)))
    if detectors is not None:
        found = found.where(F.col("detector").isin(list(detectors)))
    if term and literal:
        needle = F.lower(F.lit(term))
        found = found.where(F.lower("domain").contains(needle)
                            | F.lower("src_ip").contains(needle))
    elif term:
        re.compile(term)
        pattern = F.lit("(?i)" + term)
        found = found.where(F.rlike("domain", pattern) | F.rlike("src_ip", pattern))
    return found


def alert_table(alerts: DataFrame) -> DataFrame:
    """The alert list as shown: by severity rank, without evidence."""
    return alerts.orderBy(severity_rank(F.col("severity_label")), *alert_order()).select(
        "alert_id", "timestamp", "severity_label", "detector", "src_ip", "domain", "mitre_id",
        "reason")


def alert_positions(alerts: DataFrame) -> DataFrame:
    """The alert list with each alert's place in it, from 1, in column ``position``."""
    shown = [severity_rank(F.col("severity_label")), *alert_order()]
    return numbered(alerts, shown, "position").select(
        "alert_id", "timestamp", "severity_label", "detector", "src_ip", "domain", "mitre_id",
        "reason", "position")


def alert_preview(alerts: DataFrame, limit: int = 15) -> DataFrame:
    return alerts.orderBy(*alert_order()).drop("evidence").limit(limit)


def top_critical_alerts(alerts: DataFrame, limit: int = 3) -> DataFrame:
    return (alerts.where(F.col("severity_label") == "Critical")
            .orderBy(*alert_order()).limit(limit))


def critical_status(alerts: DataFrame, host_risk: DataFrame | None = None) -> DataFrame:
    """Number of critical alerts and whether any host is critical, one row."""
    host_risk = compute_host_risk(alerts) if host_risk is None else host_risk
    return one_row([
        alerts.agg(F.count_if(F.col("severity_label") == "Critical").alias("critical_alerts")),
        host_risk.agg(F.coalesce(F.bool_or(F.col("risk_label") == "Critical"), F.lit(False))
                      .alias("any_critical_host")),
    ])


def detector_options(alerts: DataFrame) -> DataFrame:
    return alerts.select("detector").distinct().orderBy("detector")


def host_options(host_risk: DataFrame) -> DataFrame:
    return host_risk.select("src_ip", "risk_score").orderBy(F.desc("risk_score"), "src_ip")


def risk_leaderboard(host_risk: DataFrame, limit: int = 8) -> DataFrame:
    return host_risk.orderBy(F.desc("risk_score"), "src_ip").limit(limit)


def _flagged_domains() -> Column:
    """Registrable domains of an alert's list; the text itself where there is none."""
    part = REGISTRABLE_DOMAIN.format(x="part")
    return F.expr(
        f"transform(split(domain, '{LIST_SEPARATOR}'), part -> coalesce(nullif({part}, ''), part))")


def domain_options(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Distinct domains in text order; with ``alerts``, only flagged ones."""
    domains = (events.select("registrable_domain").where(F.col("registrable_domain") != "")
               .distinct())
    if alerts is not None:
        flagged = alerts.select(F.explode(_flagged_domains()).alias("registrable_domain"))
        domains = domains.join(flagged, "registrable_domain", "left_semi")
    return domains.orderBy("registrable_domain")


def default_domain(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """The domain a drill-down opens with: that of the top alert, one row.

    When the top alert names no domain of the log, the first flagged one in text
    order, and the first of all when none is flagged.
    """
    top = (
        alerts.orderBy(*alert_order()).limit(1)
        .select(F.get(_flagged_domains(), F.lit(0)).alias("registrable_domain")))
    flagged = domain_options(events, alerts)
    ranked = [
        flagged.join(F.broadcast(top), "registrable_domain", "left_semi"),
        flagged.limit(1),
        domain_options(events).limit(1),
    ]
    choice = ranked[0].withColumn("choice", F.lit(0))
    for i, option in enumerate(ranked[1:], 1):
        choice = choice.unionByName(option.withColumn("choice", F.lit(i)))
    return choice.orderBy("choice").limit(1).select("registrable_domain")


def domain_alerts(alerts: DataFrame, domain: str, exact: bool = False) -> DataFrame:
    """Alerts that list a domain, in alert order.

    Some detectors list full names: by default these match through their
    registrable domain. ``exact`` compares the listed text itself.
    """
    listed = F.split("domain", LIST_SEPARATOR) if exact else _flagged_domains()
    return alerts.where(F.array_contains(listed, domain)).orderBy(*alert_order())


def domain_metrics(events: DataFrame, alerts: DataFrame, domain: str,
                   exact: bool = False) -> DataFrame:
    """Queries, hosts, failure rate and number of flagging detectors, one row."""
    traffic = (
        events.where(F.col("registrable_domain") == domain)
        .groupBy("src_ip")
        .agg(F.count("*").alias("n"),
             F.count_if(F.col("response_code") == "NXDOMAIN").alias("nx"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries"),
             F.count("*").alias("unique_hosts"),
             F.coalesce(F.try_divide(F.sum("nx"), F.sum("n")), F.lit(0.0)).alias("nxdomain_rate")))
    flagged = domain_alerts(alerts, domain, exact).agg(
        F.count_distinct("detector").alias("n_detectors"))
    return one_row([traffic, flagged])


def domain_history(events: DataFrame, domain: str) -> DataFrame:
    return (
        events.where(F.col("registrable_domain") == domain)
        .select("timestamp", "src_ip", "query_type", "response_code", "response_ip", "ttl")
        .orderBy("timestamp", "src_ip", "query_type", "response_code", "response_ip", "ttl"))


def host_drilldown(alerts: DataFrame, src_ip: str, host_risk: DataFrame | None = None
                   ) -> dict[str, DataFrame]:
    """Risk row, tactic summary, kill chain and timeline of one host."""
    host_risk = compute_host_risk(alerts) if host_risk is None else host_risk
    return {
        "risk": host_risk.where(F.col("src_ip") == src_ip),
        "tactics": host_tactic_summary(alerts, src_ip),
        "kill_chain": kill_chain(alerts, src_ip),
        "timeline": host_alert_timeline(alerts, src_ip),
    }


def detector_report(events: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """Event and alert counts, alerts per detector, first alerts."""
    return {
        "counts": one_row([events.agg(F.count("*").alias("n_events")),
                           alerts.agg(F.count("*").alias("n_alerts"))]),
        "alerts_by_detector": alerts_by_detector(alerts),
        "preview": alert_preview(alerts),
    }


def evaluation_report(events: DataFrame, alerts: DataFrame) -> dict[str, DataFrame] | None:
    """Counts, recall per scenario and false positives; None without labels."""
    result = evaluate_against_ground_truth(events, alerts)
    if result is None:
        return None
    return {
        "counts": one_row([events.agg(F.count("*").alias("n_events")),
                           alerts.agg(F.count("*").alias("n_alerts"))]),
        "per_scenario": result.per_scenario,
        "false_positives": result.fp_summary,
        "false_positive_hosts": result.false_positive_hosts,
    }


def technique_reference(spark) -> DataFrame:
    """Tactics in order with their techniques."""
    techniques = spark.createDataFrame(
        list(MITRE_TECHNIQUES.items()), "mitre_id string, mitre_name string")
    tactics = spark.createDataFrame(list(MITRE_TACTIC.items()), "mitre_id string, tactic string")
    return (
        techniques.join(tactics, "mitre_id")
        .where(F.col("tactic").isin(TACTIC_ORDER))
        .select("tactic", "mitre_id", "mitre_name")
        .orderBy(tactic_rank(F.col("tactic")), "mitre_id"))
