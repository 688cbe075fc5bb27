"""Hosts that resolve a public DNS-over-HTTPS provider."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametrail.constants import KNOWN_DOH_PROVIDERS
from nametrail.operators.alerts import joined, to_alerts


def doh_features(events: DataFrame, providers: Sequence[str] | DataFrame = KNOWN_DOH_PROVIDERS, *,
                 names: DataFrame | None = None) -> DataFrame:
    """Providers asked for, per host.

    The match is on the full query name; the registrable domain is what gets
    reported. ``providers``: names, or a DataFrame with a column ``query_name``.
    A list becomes an IN filter that reaches the Parquet scan.
    """
    rows = events.select("src_ip", "query_name", "registrable_domain", F.lit(1).alias("n"),
                         F.col("timestamp").alias("last_seen")) if names is None else names
    if isinstance(providers, DataFrame):
        hits = rows.join(providers.select("query_name"), "query_name", "left_semi")
    else:
        hits = rows.where(F.col("query_name").isin(list(providers)))
    return (
        hits.groupBy("src_ip", "registrable_domain")
        .agg(F.sum("n").alias("c"), F.max("last_seen").alias("last_seen"))
        .groupBy("src_ip")
        .agg(F.sort_array(F.collect_list("registrable_domain")).alias("providers"),
             F.sum("c").alias("n_queries"), F.max("last_seen").alias("last_seen"))
    )


def detect_doh_evasion(events: DataFrame, score: float = 55.0, *,
                       providers: Sequence[str] | DataFrame = KNOWN_DOH_PROVIDERS,
                       names: DataFrame | None = None) -> DataFrame:
    hosts = doh_features(events, providers, names=names).withColumn("score", F.lit(float(score)))
    return to_alerts(
        hosts, "doh_evasion",
        domain=joined(F.col("providers")), src_ip=F.col("src_ip"), mitre_id="T1071.004",
        reason=F.format_string(
            "%s looked up %d public DNS-over-HTTPS provider(s) (%s) in %d quer(ies); later "
            "lookups through them leave no trace in DNS logs.",
            "src_ip", F.size("providers"), F.array_join("providers", ", "), "n_queries"),
        evidence=[F.col("providers"), F.col("n_queries")])
