"""Domains whose label looks machine generated."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import MAX_HOSTS_PER_ALERT
from nametrail.functions.scoring import capped
from nametrail.functions.text import (
    digit_ratio,
    rare_bigram_ratio,
    second_level_label,
    shannon_entropy,
)
from nametrail.operators.alerts import percent, to_alerts
from nametrail.operators.rollup import after_grouping, domain_totals, with_hosts

# Feature weights, the entropy ceiling log2(36), hyphen discount.
ENTROPY_WEIGHT, RARE_WEIGHT, DIGIT_WEIGHT = 0.45, 0.40, 0.15
ENTROPY_CEILING = 5.17
HYPHEN_FACTOR = 0.7


def score_labels(domains: DataFrame, bigrams=None) -> DataFrame:
    """Add label metrics and raw score; needs ``registrable_domain, n_queries``."""
    score = 100 * (
        ENTROPY_WEIGHT * capped(F.col("entropy"), ENTROPY_CEILING)
        + RARE_WEIGHT * F.col("rare_ratio") + DIGIT_WEIGHT * F.col("digit_ratio"))
    discount = F.when(F.col("label").contains("-"), HYPHEN_FACTOR).otherwise(1.0)
    return (
        domains.withColumn("label", second_level_label("registrable_domain"))
        .withColumns({
            "entropy": after_grouping(shannon_entropy("label")),
            "rare_ratio": after_grouping(rare_bigram_ratio("label", bigrams)),
            "digit_ratio": after_grouping(digit_ratio("label"))})
        .withColumn("score", score * discount))


def long_label(min_label_len: int) -> Column:
    return F.length(second_level_label("registrable_domain")) >= min_label_len


def dga_features(events: DataFrame, min_label_len: int = 6, *, pairs: DataFrame | None = None,
                 bigrams=None) -> DataFrame:
    """Label metrics and raw score of every domain with a long enough label."""
    domains = domain_totals(events, pairs).where(long_label(min_label_len))
    return score_labels(domains, bigrams).select(
        "registrable_domain", "label", "n_queries", "last_seen",
        (F.col("n_nx") / F.col("n_queries")).alias("nxdomain_ratio"),
        "entropy", "rare_ratio", "digit_ratio", "score")


def detect_dga(events: DataFrame, min_label_len: int = 6, score_threshold: float = 45.0, *,
               max_hosts: int = MAX_HOSTS_PER_ALERT, pairs: DataFrame | None = None,
               bigrams=None) -> DataFrame:
    flagged = dga_features(events, min_label_len, pairs=pairs, bigrams=bigrams).where(
        F.col("score") >= score_threshold)
    return to_alerts(
        with_hosts(flagged, events, pairs, max_hosts), "dga",
        domain=F.col("registrable_domain"), src_ip=F.col("hosts"), mitre_id="T1568.002",
        reason=F.format_string(
            "The label '%s' reads like generated text: %.2f bits of entropy per character, "
            "%.0f%% rare letter pairs and %.0f%% digits.",
            "label", "entropy", percent("rare_ratio"), percent("digit_ratio")),
        evidence=[
            F.round("entropy", 2).alias("entropy_bits_per_char"),
            F.round("rare_ratio", 2).alias("rare_bigram_ratio"),
            F.round("digit_ratio", 2).alias("digit_ratio"),
            F.col("n_queries"),
            F.round("nxdomain_ratio", 2).alias("nxdomain_ratio"),
        ])
