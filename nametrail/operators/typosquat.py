"""Domains one or two edits away from a watched brand."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.constants import BRAND_WATCHLIST, MAX_HOSTS_PER_ALERT
from nametrail.operators.alerts import to_alerts
from nametrail.operators.rollup import domain_totals, with_hosts

# Score at distance one, loss per further edit, shortest domain.
NEAREST_SCORE, LOSS_PER_EDIT = 92, 24
MIN_DOMAIN_LEN = 4

def nearest_listed_brand(name: Column, brands: Sequence[str], max_distance: int) -> Column:
    """Struct (edit_distance, pos, matched_brand) of the nearest of a few brands, as an
    expression for streams; the smallest (distance, list position) wins, null if none is near."""
    listed = F.array([F.struct(F.lit(i).alias("pos"), F.lit(b).alias("brand"))
                      for i, b in enumerate(brands)])
    measured = F.transform(listed, lambda b: F.struct(
        F.levenshtein(name, b["brand"], max_distance).alias("edit_distance"), b["pos"].alias("pos"),
        b["brand"].alias("matched_brand")))
    return F.array_min(F.filter(measured, lambda c: c["edit_distance"] >= 0))


def deletion_keys(name: Column, max_distance: int) -> Column:
    """All strings made by deleting at most ``max_distance`` characters.

    Two strings within that edit distance share at least one of these keys.
    """
    def one_shorter(s: Column) -> Column:
        return F.when(F.length(s) > 0, F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1),
                               F.substring(s, i + 1, F.length(s)))),
        ).otherwise(F.array(s))

    level = keys = F.array(name)
    for _ in range(max_distance):
        level = F.array_distinct(F.flatten(F.transform(level, one_shorter)))
        keys = F.array_union(keys, level)
    return keys


def nearest_brand(domains: DataFrame, brands: DataFrame, max_distance: int) -> DataFrame:
    """Nearest brand per domain (``brands`` has columns ``brand, pos``), ties to the first.

    Domains and brands meet on deletion keys (an equi-join), then the distance
    is verified. Domains without a brand of similar length make no keys; exact
    brands are removed first. The number of keys per name depends only on its
    length.
    """
    lengths = brands.select(
        F.explode(F.sequence(F.length("brand") - max_distance, F.length("brand") + max_distance))
        .alias("len")).distinct()
    names = (
        domains.select("registrable_domain")
        .join(brands, F.col("registrable_domain") == F.col("brand"), "left_anti")
        .join(lengths, F.length("registrable_domain") == F.col("len"), "left_semi")
        .withColumn("key", F.explode(deletion_keys(F.col("registrable_domain"), max_distance)))
    )
    keyed = brands.withColumn("key", F.explode(deletion_keys(F.col("brand"), max_distance)))
    best = (
        names.join(keyed, "key")
        .select("registrable_domain", "brand", "pos",
                F.levenshtein("registrable_domain", "brand", max_distance).alias("edit_distance"))
        .where(F.col("edit_distance") >= 1)
        .groupBy("registrable_domain")
        .agg(F.min(F.struct("edit_distance", "pos", F.col("brand").alias("matched_brand")))
             .alias("best"))
    )
    return domains.join(best, "registrable_domain").select(
        "registrable_domain", "n_queries", "last_seen", "best.edit_distance",
        "best.matched_brand")


def typosquat_features(events: DataFrame, max_distance: int = 2, *,
                       brands: Sequence[str] | DataFrame = BRAND_WATCHLIST,
                       pairs: DataFrame | None = None) -> DataFrame:
    """Nearest brand within ``max_distance`` edits of every other domain.

    ``brands``: names in tie-break order, or a DataFrame ``brand, pos`` where ``pos`` is
    anything that orders. Domains and brands meet on deletion keys whatever the list's size.
    """
    domains = domain_totals(events, pairs).where(
        F.length("registrable_domain") >= MIN_DOMAIN_LEN)
    listed = brands if isinstance(brands, DataFrame) else domains.sparkSession.createDataFrame(
        [(b, i) for i, b in enumerate(brands)], "brand string, pos int")
    near = nearest_brand(domains, listed.select("brand", "pos"), max_distance)
    return near.withColumn("score", (
        NEAREST_SCORE - (F.col("edit_distance") - 1) * LOSS_PER_EDIT).cast("double"))


def detect_typosquatting(events: DataFrame, max_distance: int = 2, *,
                         brands: Sequence[str] | DataFrame = BRAND_WATCHLIST,
                         max_hosts: int = MAX_HOSTS_PER_ALERT,
                         pairs: DataFrame | None = None) -> DataFrame:
    flagged = typosquat_features(events, max_distance, brands=brands, pairs=pairs)
    return to_alerts(
        with_hosts(flagged, events, pairs, max_hosts), "typosquat",
        domain=F.col("registrable_domain"), src_ip=F.col("hosts"), mitre_id="T1583.001",
        reason=F.format_string(
            "'%s' differs from the watched brand '%s' by %d edit(s), as a look-alike domain would.",
            "registrable_domain", "matched_brand", "edit_distance"),
        evidence=[F.col("edit_distance"), F.col("matched_brand"), F.col("n_queries")])
