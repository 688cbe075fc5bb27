"""Ordered work per key when one key may hold a large share of all rows.

A window over ``partitionBy(key)`` puts every row of a key into one task. Here
the few heavy keys are found first; their rows are merged per
instant and cut into time slices, so that a window runs per (key, slice). The
caller folds the slices of a key together afterwards. All other keys form one
slice each. Which keys count as heavy only decides where rows are processed: the
folded result is the same to the last bit for every choice, as sums are exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys with this many rows are cut. There are at most (rows / HEAVY_MIN_ROWS) of them,
# and only their 8-byte hashes are broadcast: 4 MB for 1e12 rows.
HEAVY_MIN_ROWS = 2_000_000

_HASH = "_key_hash"


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys).alias(_HASH)


def heavy_by_count(totals: DataFrame, keys: list[str], count: str, min_rows: int) -> DataFrame:
    """Hashes of all keys with at least ``min_rows`` rows, from exact counts per key."""
    return totals.where(F.col(count) >= min_rows).select(key_hash(keys))


def sliced(rows: DataFrame, keys: list[str], slice_us: int, heavy: DataFrame) -> DataFrame:
    """``keys, us`` -> ``keys, us, copies, slice``; ``heavy`` lists hashed keys.

    ``slice`` is null for ordinary keys. Rows of heavy keys are pre-aggregated to
    one row per instant (``copies`` counts them), so a slice has at most
    ``slice_us`` rows. With an empty heavy list AQE removes that branch and its
    scan, and the anti join from the other one.
    """
    hashed = rows.select(*keys, "us", key_hash(keys))
    heavy = F.broadcast(heavy)
    ordinary = hashed.join(heavy, _HASH, "left_anti").select(
        *keys, "us", F.lit(1).cast("bigint").alias("copies"),
        F.lit(None).cast("bigint").alias("slice"))
    cut = (
        hashed.join(heavy, _HASH, "left_semi")
        .groupBy(*keys, "us").agg(F.count("*").alias("copies"))
        .select(*keys, "us", "copies", F.expr(f"us div {slice_us}").alias("slice")))
    return ordinary.unionByName(cut)
