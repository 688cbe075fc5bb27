"""Evidence as semi-structured values beside its JSON text.

Each detector puts other facts into ``evidence``. As VARIANT they keep their types, are read by
path without parsing the text again, and come as rows of one shape for all detectors.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_facts(alerts: DataFrame) -> DataFrame:
    """Adds ``facts``, the evidence as VARIANT; null where the text is no JSON."""
    return alerts.withColumn("facts", F.try_parse_json("evidence"))


def fact(name: str, kind: str = "double") -> Column:
    """One fact of ``facts`` by name, null where an alert has none or of another kind."""
    return F.try_variant_get("facts", f"$.{name}", kind)


def evidence_facts(alerts: DataFrame) -> DataFrame:
    """One row per alert and fact: ``alert_id, detector, domain, src_ip, name, number, text``.

    ``number`` is set for numbers, ``text`` for all else; lists are JSON.
    """
    kept = with_facts(alerts).select("alert_id", "detector", "domain", "src_ip", "facts")
    each = kept.alias("a").lateralJoin(
        alerts.sparkSession.tvf.variant_explode(F.col("a.facts").outer()))
    number = F.try_variant_get("value", "$", "double")
    return each.select(
        "alert_id", "detector", "domain", "src_ip", F.col("key").alias("name"),
        number.alias("number"),
        F.when(number.isNull(), F.try_variant_get("value", "$", "string")).alias("text"))
