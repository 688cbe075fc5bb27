"""Correlation of alerts: host risk, tactics, timeline, summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import (
    CORRELATION_BONUS_PER_DETECTOR,
    LIST_SEPARATOR,
    MAX_SCORE,
    TACTIC_ORDER,
)
from nametrail.functions.scoring import severity_label, tactic_of, tactic_rank
from nametrail.operators.rollup import pair_rollup
from nametrail.plans.pipeline import DETECTOR_FUNCS, alert_order, detector_rank
from nametrail.schema import HOST_RISK_COLUMNS


def lists_value(column: str, value: str) -> Column:
    """A ``;`` list contains this value."""
    return F.array_contains(F.split(column, LIST_SEPARATOR), value)


#: Detectors that flag a domain; which of its hosts count (a count of the rollup above zero).
DOMAIN_DETECTORS = {
    "dga": None, "typosquat": None, "fast_flux": "n_resolved", "newly_registered": "n_aged"}


def alert_hosts(alerts: DataFrame, events: DataFrame | None = None,
                pairs: DataFrame | None = None) -> DataFrame:
    """``alert_id, src_ip``: every host of every alert.

    The host list of an alert on a domain is cut for display; its hosts come from the
    (host, domain) rollup, by the same condition that the detector lists them by. Alerts of
    other detectors name their hosts in full.
    """
    pairs = pair_rollup(events) if pairs is None else pairs
    flagged = alerts.where(F.col("detector").isin(list(DOMAIN_DETECTORS))).select(
        "alert_id", "detector", F.col("domain").alias("registrable_domain"))
    counts = F.lit(True)
    for detector, count in DOMAIN_DETECTORS.items():
        if count is not None:
            counts = counts & ((F.col("detector") != detector) | (F.col(count) > 0))
    wide = flagged.join(pairs, "registrable_domain").where(counts).select("alert_id", "src_ip")
    named = by_host(alerts.where(~F.col("detector").isin(list(DOMAIN_DETECTORS))))
    return wide.unionByName(named.select("alert_id", "src_ip"))


def by_host(alerts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One row per alert and host; ``hosts`` keeps the list.

    With ``hosts`` (``alert_hosts``) these are all hosts of an alert; without, those its
    text lists, five at most for alerts on domains.
    """
    if hosts is not None:
        return alerts.withColumnRenamed("src_ip", "hosts").join(hosts, "alert_id")
    return (
        alerts.withColumn("hosts", F.col("src_ip"))
        .withColumn("src_ip", F.explode(F.split("src_ip", LIST_SEPARATOR)))
        .withColumn("src_ip", F.trim("src_ip"))
        .where(F.col("src_ip") != ""))


def _sorted_names(column: str) -> Column:
    return F.array_join(F.sort_array(F.collect_list(column)), ", ")


def compute_host_risk(alerts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Risk per host named in any alert, highest first.

    Highest severity plus a bonus per additional detector, at most 100; the label
    follows the unrounded score. Grouped by (host, detector) first, so the second
    step sees at most one row per detector of a host.
    """
    top = F.min(F.struct(
        (-F.col("severity_score")).alias("neg_score"), detector_rank(F.col("detector")),
        "domain", "hosts", "timestamp", "detector", "reason"))
    per_detector = by_host(alerts, hosts).groupBy("src_ip", "detector").agg(
        F.count("*").alias("n"), top.alias("top"))
    risk = F.least(F.lit(MAX_SCORE), -F.col("top.neg_score")
                   + CORRELATION_BONUS_PER_DETECTOR * (F.col("n_detectors") - 1))
    return (
        per_detector.groupBy("src_ip")
        .agg(F.sum("n").alias("n_alerts"), F.count("*").alias("n_detectors"),
             _sorted_names("detector").alias("detectors"), F.min("top").alias("top"))
        .withColumn("risk", risk)
        .withColumn("risk_score", F.round("risk", 1))
        .withColumn("risk_label", severity_label("risk"))
        .withColumn("top_detector", F.col("top.detector"))
        .withColumn("top_reason", F.col("top.reason"))
        .select(*HOST_RISK_COLUMNS)
        .orderBy(F.desc("risk_score"), "src_ip"))


def _tactics(alerts: DataFrame, keys: list[str]) -> DataFrame:
    rank = tactic_rank(F.col("tactic"))
    return (
        alerts.withColumn("tactic", tactic_of(F.col("mitre_id")))
        .groupBy(*keys, "tactic", "detector")
        .agg(F.count("*").alias("n"), F.max("severity_score").alias("severity"))
        .groupBy(*keys, "tactic")
        .agg(F.sum("n").alias("n_alerts"), F.max("severity").alias("max_severity"),
             _sorted_names("detector").alias("detectors"))
        .orderBy(*keys, rank, "tactic"))


def _of_host(alerts: DataFrame, src_ip: str, hosts: DataFrame | None) -> DataFrame:
    if hosts is None:
        return alerts.where(lists_value("src_ip", src_ip))
    return alerts.join(hosts.where(F.col("src_ip") == src_ip).select("alert_id"), "alert_id",
                       "left_semi")


def host_tactic_summary(alerts: DataFrame, src_ip: str,
                        hosts: DataFrame | None = None) -> DataFrame:
    """Tactics that one host's alerts touch, in tactic order, unknown ones last."""
    return _tactics(_of_host(alerts, src_ip, hosts), [])


def all_host_tactics(alerts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """The tactic summary of every host at once."""
    return _tactics(by_host(alerts, hosts), ["src_ip"])


def host_alert_timeline(alerts: DataFrame, src_ip: str,
                        hosts: DataFrame | None = None) -> DataFrame:
    """One host's alerts, oldest first."""
    return _of_host(alerts, src_ip, hosts).orderBy("timestamp", *alert_order())


def kill_chain(alerts: DataFrame, src_ip: str | None = None,
               hosts: DataFrame | None = None) -> DataFrame:
    """All tactics in order with the top severity label, null where untouched.

    For one host, or for every host (then with a ``src_ip`` column).
    """
    keys = ["src_ip"] if src_ip is None else []
    rows = by_host(alerts, hosts) if src_ip is None else _of_host(alerts, src_ip, hosts)
    tactic = tactic_of(F.col("mitre_id"))
    tops = [F.max(F.when(tactic == t, F.col("severity_score"))).alias(f"_{i}")
            for i, t in enumerate(TACTIC_ORDER)]
    cells = F.array([
        F.struct(F.lit(i).alias("position"), F.lit(t).alias("tactic"),
                 F.col(f"_{i}").alias("max_severity"))
        for i, t in enumerate(TACTIC_ORDER)])
    return (
        rows.groupBy(*keys).agg(*tops)
        .select(*keys, F.inline(cells))
        .withColumn("severity_label", F.when(
            F.col("max_severity").isNotNull(), severity_label("max_severity")))
        .orderBy(*keys, "position"))


def summary_metrics(events: DataFrame, alerts: DataFrame,
                    host_risk: DataFrame | None = None) -> DataFrame:
    """The counts of the executive summary, one row."""
    host_risk = compute_host_risk(alerts) if host_risk is None else host_risk
    parts = [
        events.groupBy("src_ip").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.count("*").alias("n_hosts")),
        alerts.groupBy("detector").agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_alerts"),
             F.count("*").alias("n_detectors_fired")),
        host_risk.agg(
            F.count("*").alias("n_flagged_hosts"),
            F.count_if(F.col("risk_label") == "Critical").alias("n_critical_hosts"),
            F.count_if(F.col("n_detectors") > 1).alias("n_multi_detector_hosts")),
    ]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    names = [c for p in parts for c in p.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def top_critical_hosts(host_risk: DataFrame, limit: int = 3) -> DataFrame:
    return (host_risk.where(F.col("risk_label") == "Critical")
            .orderBy(F.desc("risk_score"), "src_ip").limit(limit))


def generate_executive_summary(events: DataFrame, alerts: DataFrame,
                               host_risk: DataFrame | None = None) -> str:
    """A few sentences; reads one row of counts and at most three hosts."""
    host_risk = compute_host_risk(alerts) if host_risk is None else host_risk
    m = summary_metrics(events, alerts, host_risk).first()
    text = [f"{m.n_events:,} DNS queries from {m.n_hosts:,} hosts were examined."]
    if not m.n_alerts:
        return text[0] + " No detector reached its threshold; nothing to follow up."
    text.append(
        f"{m.n_detectors_fired} of {len(DETECTOR_FUNCS)} detectors raised {m.n_alerts:,} "
        f"alert(s) on {m.n_flagged_hosts:,} host(s).")
    if m.n_critical_hosts:
        hosts = "; ".join(
            f"{h.src_ip} ({h.n_detectors} detector(s): {h.detectors})"
            for h in top_critical_hosts(host_risk).collect())
        text.append(f"{m.n_critical_hosts:,} host(s) are at Critical risk, first: {hosts}.")
    else:
        text.append("No host is at Critical risk.")
    if m.n_multi_detector_hosts:
        text.append(
            f"{m.n_multi_detector_hosts:,} host(s) were flagged by several independent detectors.")
    return " ".join(text)
