"""From scored feature rows to alert rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import LIST_SEPARATOR
from nametrail.functions.scoring import clamp_score, severity_label, technique_name
from nametrail.schema import ALERT_COLUMNS, ALERT_SCHEMA

# Alerts before ids are given.
UNNUMBERED = [c for c in ALERT_COLUMNS if c != "alert_id"]


def empty_alerts(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA)


def to_alerts(features: DataFrame, detector: str, *, domain: Column, src_ip: Column,
              reason: Column, mitre_id: str, evidence: list[Column]) -> DataFrame:
    """One alert per feature row; needs the columns ``score`` and ``last_seen``.

    The label follows the rounded score that the alert shows.
    """
    return (
        features.select(
            F.col("last_seen").alias("timestamp"),
            F.lit(detector).alias("detector"),
            clamp_score(F.col("score")).alias("severity_score"),
            src_ip.alias("src_ip"),
            domain.alias("domain"),
            reason.alias("reason"),
            F.lit(mitre_id).alias("mitre_id"),
            F.to_json(F.struct(*evidence)).alias("evidence"),
        )
        .withColumn("severity_label", severity_label("severity_score"))
        .withColumn("mitre_name", technique_name(F.col("mitre_id")))
        .select(*UNNUMBERED)
    )


def share(hits: Column) -> Column:
    """Mean of a predicate over the group."""
    return F.avg(F.when(hits, 1.0).otherwise(0.0))


def percent(ratio: str) -> Column:
    return F.col(ratio) * 100


def joined(values: Column) -> Column:
    return F.array_join(values, LIST_SEPARATOR)
