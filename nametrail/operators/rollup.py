"""Shared rollups and what is derived from them.

The finest one is ``name_rollup`` by (host, name); ``pair_rollup`` by (host, domain), and from
it the totals per domain and per host, follow without another look at the events.
``answer_rollup`` does the same for addresses and ages. ``run_all_detectors`` keeps both, so
that all detectors together read the log four times.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametrail.constants import CARRIER_TYPES, LIST_SEPARATOR, MAX_HOSTS_PER_ALERT


def resolved() -> Column:
    """The query got an address."""
    return (F.col("response_code") == "NOERROR") & (F.col("response_ip") != "")


def aged() -> Column:
    """The registration age of the domain is known."""
    return F.col("first_registered_days_ago").isNotNull()


NAME_KEY = ["src_ip", "query_name", "registrable_domain", "subdomain", "subdomain_label_count"]
ANSWER_KEY = ["registrable_domain", "response_ip", "first_registered_days_ago"]


def name_rollup(events: DataFrame, *more: str) -> DataFrame:
    """One row per (src_ip, query_name), with the columns that follow from the name.

    All buffers are numbers and times: a hash aggregation with map-side combine. ``more``
    columns split the rows further; ``united_names`` puts such parts together.
    """
    return events.groupBy(*NAME_KEY, *more).agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_if(F.col("response_code") == "NXDOMAIN").alias("n_nx"),
        F.count_if(resolved()).alias("n_resolved"),
        F.count_if(aged()).alias("n_aged") if "first_registered_days_ago" in events.columns
        else F.lit(0).cast("bigint").alias("n_aged"),
        F.count_if(F.col("query_type").isin(CARRIER_TYPES)).alias("n_carriers"))


def united_names(parts: DataFrame) -> DataFrame:
    """The rollup of all events, from rollups of parts of them."""
    return parts.groupBy(*NAME_KEY).agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *(F.sum(c).alias(c) for c in ("n_nx", "n_resolved", "n_aged", "n_carriers")))


def pairs_of_names(names: DataFrame) -> DataFrame:
    """The rows of ``pair_rollup``, from those of ``name_rollup``."""
    return names.groupBy("src_ip", "registrable_domain").agg(
        F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"),
        *(F.sum(c).alias(c) for c in ("n_nx", "n_resolved", "n_aged")))


def answer_rollup(events: DataFrame, *more: str) -> DataFrame:
    """One row per (registrable_domain, response_ip, first_registered_days_ago).

    The address is null where the query got none. Ages hardly vary inside a domain, so there
    are about as many rows as different answers.
    """
    known = "first_registered_days_ago" in events.columns
    age = F.col("first_registered_days_ago") if known else F.lit(None).cast("double")
    return (
        events.select("registrable_domain", F.when(resolved(), F.col("response_ip")).alias("response_ip"),
                      age.alias("first_registered_days_ago"), "timestamp", "ttl", *more)
        .where(F.col("response_ip").isNotNull() | F.col("first_registered_days_ago").isNotNull())
        .groupBy(*ANSWER_KEY, *more)
        .agg(F.count("*").alias("c"), F.sum(F.col("ttl").cast("double")).alias("ttl_sum"),
             F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")))


def united_answers(parts: DataFrame) -> DataFrame:
    """The same for ``answer_rollup``."""
    return parts.groupBy(*ANSWER_KEY).agg(
        F.sum("c").alias("c"), F.sum("ttl_sum").alias("ttl_sum"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def pair_rollup(events: DataFrame) -> DataFrame:
    """One row per (src_ip, registrable_domain).

    Every buffer is a plain number, so this is a hash aggregation with map-side
    combine. Detectors that need domain totals or host lists aggregate this
    table again instead of the events.
    """
    nx = F.col("response_code") == "NXDOMAIN"
    return events.groupBy("src_ip", "registrable_domain").agg(
        F.count("*").alias("n"),
        F.max("timestamp").alias("last_seen"),
        F.count_if(nx).alias("n_nx"),
        F.count_if(resolved()).alias("n_resolved"),
        F.count_if(aged()).alias("n_aged"),
    )


def domain_totals(events: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``registrable_domain, n_queries, n_nx, last_seen``.

    From the rollup where one is at hand, else straight from the events: the
    partial aggregation then sends one row per domain and task.
    """
    if pairs is None:
        return events.groupBy("registrable_domain").agg(
            F.count("*").alias("n_queries"),
            F.count_if(F.col("response_code") == "NXDOMAIN").alias("n_nx"),
            F.max("timestamp").alias("last_seen"))
    return pairs.groupBy("registrable_domain").agg(
        F.sum("n").alias("n_queries"), F.sum("n_nx").alias("n_nx"),
        F.max("last_seen").alias("last_seen"))


def host_totals(events: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``src_ip, n_queries, n_nx``, from the rollup or the events."""
    if pairs is None:
        return events.groupBy("src_ip").agg(
            F.count("*").alias("n_queries"),
            F.count_if(F.col("response_code") == "NXDOMAIN").alias("n_nx"))
    return pairs.groupBy("src_ip").agg(
        F.sum("n").alias("n_queries"), F.sum("n_nx").alias("n_nx"))


def bounded_hosts(pairs: DataFrame, max_hosts: int = MAX_HOSTS_PER_ALERT) -> DataFrame:
    """``registrable_domain, hosts``: the first ``max_hosts`` hosts in text order.

    ``pairs`` has distinct (src_ip, registrable_domain). The row-number filter is
    planned as a group limit that already runs before the exchange, so a domain
    that every host asks for still sends only ``max_hosts`` rows per task.
    """
    by_host = Window.partitionBy("registrable_domain").orderBy("src_ip")
    return (
        pairs.select("registrable_domain", "src_ip")
        .withColumn("_rank", F.row_number().over(by_host))
        .where(F.col("_rank") <= max_hosts)
        .groupBy("registrable_domain")
        .agg(F.array_join(F.sort_array(F.collect_list("src_ip")), LIST_SEPARATOR).alias("hosts"))
    )


def with_hosts(flagged: DataFrame, events: DataFrame, pairs: DataFrame | None, max_hosts: int,
               among: str | None = None) -> DataFrame:
    """Attach host lists to flagged domains (one row per domain on both sides).

    ``among`` names the rollup count that must not be zero for a host to be
    listed.
    """
    pairs = pair_rollup(events) if pairs is None else pairs
    if among is not None:
        pairs = pairs.where(F.col(among) > 0)
    return flagged.join(bounded_hosts(pairs, max_hosts), "registrable_domain")


def after_grouping(value: Column, count: str = "n_queries") -> Column:
    """Tie an expression over a group key to an aggregate of the group.

    Catalyst moves a filter on a pure function of the key below the aggregation
    and would evaluate costly text features once per event instead of once per
    key. The count is never zero, so the value does not change.
    """
    return F.when(F.col(count) > 0, value)
