"""Mergeable state of days: totals and HyperLogLog sketches of hosts per day and domain.

The exact counts of ``analytics.kpis`` read the events of the whole range. The state has one
row per day and domain, at most 2^LG_SIZE bytes of sketch each, and answers for any range of
days without the events. Rows of one day add up, so late rows are appended as state of their
own; ``compacted`` unites them. Totals and domains are exact; numbers of hosts have a relative
standard error of ``standard_error()``, and are all but exact below a few hundred hosts.
"""

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base-2 logarithm of a sketch's number of buckets.
LG_SIZE = 12
STATE_SCHEMA = ("registrable_domain string, n_queries bigint, n_nx bigint, hosts binary, "
                "event_date date")


def standard_error(lg_size: int = LG_SIZE) -> float:
    return 1.04 / math.sqrt(1 << lg_size)


def day_state(events: DataFrame, lg_size: int = LG_SIZE) -> DataFrame:
    """One row per day and domain; partial sketches are united before the shuffle's end, so a
    domain with most of the rows arrives as one sketch per task."""
    return events.groupBy("registrable_domain", F.to_date("timestamp").alias("event_date")).agg(
        F.count("*").alias("n_queries"),
        F.count_if(F.col("response_code") == "NXDOMAIN").alias("n_nx"),
        F.hll_sketch_agg("src_ip", lg_size).alias("hosts"),
    ).select("registrable_domain", "n_queries", "n_nx", "hosts", "event_date")


def _united() -> list[Column]:
    return [F.sum("n_queries").alias("n_queries"), F.sum("n_nx").alias("n_nx"),
            F.hll_union_agg("hosts").alias("hosts")]


def compacted(state: DataFrame) -> DataFrame:
    """One row per day and domain again, after appends."""
    return state.groupBy("registrable_domain", "event_date").agg(*_united()).select(
        "registrable_domain", "n_queries", "n_nx", "hosts", "event_date")


def append_state(state: DataFrame, path: str) -> None:
    """Add the state of some events to the stored one, a folder per day."""
    state.repartition("event_date").write.mode("append").partitionBy("event_date").parquet(path)


def read_state(spark: SparkSession, path: str, first: date | None = None,
               last: date | None = None) -> DataFrame:
    """The stored state of a range of days, ends included; other days' folders are not read."""
    state = spark.read.schema(STATE_SCHEMA).parquet(path)
    if first is not None:
        state = state.where(F.col("event_date") >= F.lit(first))
    if last is not None:
        state = state.where(F.col("event_date") <= F.lit(last))
    return state


def state_kpis(state: DataFrame) -> DataFrame:
    """``total_queries, unique_domains`` (exact) and ``approx_hosts``, one row."""
    by_domain = state.groupBy("registrable_domain").agg(*_united())
    return by_domain.agg(
        F.coalesce(F.sum("n_queries"), F.lit(0)).alias("total_queries"),
        F.count("*").alias("unique_domains"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("hosts")), F.lit(0)).alias("approx_hosts"))


def domain_reach(state: DataFrame) -> DataFrame:
    """Queries, failures and about how many hosts, per domain."""
    return state.groupBy("registrable_domain").agg(*_united()).select(
        "registrable_domain", "n_queries", "n_nx",
        F.hll_sketch_estimate("hosts").alias("approx_hosts"))
