"""Scoring of alerts against ground-truth labels."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import (
    BENIGN_LABEL,
    HOST_GRANULAR_SCENARIOS,
    LIST_SEPARATOR,
    SCENARIO_TO_DETECTOR,
)
from nametrail.functions.scoring import lookup
from nametrail.functions.text import registrable_domain
from nametrail.plans.risk import by_host
from nametrail.schema import RECALL_COLUMNS


@dataclass(frozen=True)
class Evaluation:
    per_scenario: DataFrame
    false_positive_hosts: DataFrame
    fp_summary: DataFrame


def _is_host_granular(scenario: Column, host_granular: Sequence[str]) -> Column:
    return scenario.isin(list(host_granular)) if host_granular else F.lit(False)


def flagged_units(alerts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Distinct (detector, src_ip, domain) over both lists of every alert."""
    return (
        by_host(alerts, hosts).select(
            "detector", "src_ip", F.explode(F.split("domain", LIST_SEPARATOR)).alias("part"))
        .select("detector", "src_ip", F.coalesce(
            F.nullif(registrable_domain("part"), F.lit("")), F.col("part")).alias("domain"))
        .distinct())


def recall_by_scenario(events: DataFrame, alerts: DataFrame, hosts: DataFrame | None = None, *,
                       scenarios: Mapping[str, str] = SCENARIO_TO_DETECTOR,
                       host_granular: Sequence[str] = HOST_GRANULAR_SCENARIOS) -> DataFrame:
    """Labelled units found by the expected detector, per scenario.

    A unit is a (host, domain) pair, or a host for ``host_granular`` scenarios.
    One join for all scenarios; both sides hold distinct units, so no unit is
    heavy.
    """
    by_hosts = _is_host_granular(F.col("scenario"), host_granular)
    unit_domain = F.when(by_hosts, F.lit("")).otherwise(F.col("domain"))
    truth = (
        events.where(F.col("ground_truth_label").isin(list(scenarios)))
        .select(F.col("ground_truth_label").alias("scenario"), "src_ip",
                F.col("registrable_domain").alias("domain"))
        .withColumn("domain", unit_domain)
        .distinct())
    expected = F.array([F.struct(F.lit(s).alias("scenario"), F.lit(d).alias("detector"))
                        for s, d in scenarios.items()])
    flagged = (
        flagged_units(alerts, hosts)
        .withColumn("scenario", F.explode(F.filter(
            expected, lambda e: e["detector"] == F.col("detector"))["scenario"]))
        .withColumn("domain", unit_domain)
        .select("scenario", "src_ip", "domain", F.lit(1).alias("hit"))
        .distinct())
    position = lookup(F.col("scenario"), {s: i for i, s in enumerate(scenarios)}, len(scenarios))
    return (
        truth.join(flagged, ["scenario", "src_ip", "domain"], "left")
        .groupBy("scenario")
        .agg(F.count("*").alias("ground_truth_total"), F.count("hit").alias("caught"))
        .withColumn("detector", lookup(F.col("scenario"), scenarios, ""))
        .withColumn("unit", F.when(by_hosts, "hosts").otherwise("(host, domain) pairs"))
        .withColumn("recall", F.round(F.col("caught") / F.col("ground_truth_total"), 2))
        .select(*RECALL_COLUMNS)
        .orderBy(position))


def benign_hosts(events: DataFrame) -> DataFrame:
    """Hosts whose every label is benign (unlabelled rows do not count)."""
    label = F.col("ground_truth_label")
    return (
        events.where(label.isNotNull())
        .groupBy("src_ip").agg(F.count_if(label != BENIGN_LABEL).alias("other"))
        .where(F.col("other") == 0)
        .select("src_ip"))


def false_positive_hosts(events: DataFrame, alerts: DataFrame,
                         hosts: DataFrame | None = None) -> DataFrame:
    """Benign-only hosts that appear in any alert."""
    flagged = by_host(alerts, hosts).select("src_ip")
    return benign_hosts(events).join(flagged, "src_ip", "left_semi").orderBy("src_ip")


def false_positive_summary(events: DataFrame, alerts: DataFrame,
                           hosts: DataFrame | None = None) -> DataFrame:
    flagged = by_host(alerts, hosts).select("src_ip").distinct().withColumn("hit", F.lit(1))
    rate = F.coalesce(F.try_divide("false_positive_hosts", "benign_hosts_total"), F.lit(0.0))
    return (
        benign_hosts(events).join(flagged, "src_ip", "left")
        .agg(F.count("*").alias("benign_hosts_total"),
             F.count("hit").alias("false_positive_hosts"))
        .withColumn("false_positive_rate", F.round(rate, 3)))


def evaluate_against_ground_truth(events: DataFrame, alerts: DataFrame,
                                  hosts: DataFrame | None = None) -> Evaluation | None:
    """Recall and false positives; None without any label.

    ``hosts`` (``alert_hosts``) counts every host of an alert instead of the listed ones.
    """
    if ("ground_truth_label" not in events.columns
            or events.where(F.col("ground_truth_label").isNotNull()).isEmpty()):
        return None
    return Evaluation(
        recall_by_scenario(events, alerts, hosts), false_positive_hosts(events, alerts, hosts),
        false_positive_summary(events, alerts, hosts))
