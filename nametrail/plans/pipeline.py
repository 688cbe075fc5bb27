"""Run detectors over one event table and number the alerts."""

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from inspect import signature

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametrail.functions.scoring import lookup
from nametrail.operators import (
    detect_beaconing,
    detect_dga,
    detect_doh_evasion,
    detect_fast_flux,
    detect_newly_registered_domain,
    detect_nxdomain_spike,
    detect_tunneling,
    detect_typosquatting,
    pair_rollup,
)
from nametrail.operators.alerts import empty_alerts
from nametrail.operators.nxdomain import able_failures, host_failures
from nametrail.operators.rollup import answer_rollup, name_rollup, pairs_of_names
from nametrail.plans.lineage import materialized
from nametrail.schema import ALERT_COLUMNS

# Registry, in tie-break order. Add an entry to run a detector of your own:
# any callable ``(events, **params) -> alerts`` with the alert columns.
DETECTOR_FUNCS: dict[str, Callable[..., DataFrame]] = {
    "dga": detect_dga,
    "tunneling": detect_tunneling,
    "beaconing": detect_beaconing,
    "nxdomain_spike": detect_nxdomain_spike,
    "typosquat": detect_typosquatting,
    "fast_flux": detect_fast_flux,
    "newly_registered": detect_newly_registered_domain,
    "doh_evasion": detect_doh_evasion,
}


def detector_rank(detector: Column) -> Column:
    return lookup(detector, {name: i for i, name in enumerate(DETECTOR_FUNCS)},
                  len(DETECTOR_FUNCS))


def alert_order() -> list[Column]:
    """Total order of alerts: severity first, then registry, domain and host."""
    return [F.desc("severity_score"), detector_rank(F.col("detector")), F.asc("domain"),
            F.asc("src_ip"), F.asc("timestamp")]


@dataclass(frozen=True)
class Rollups:
    """What detectors share; each field goes to the detectors with a parameter of its name."""

    pairs: DataFrame
    names: DataFrame | None = None
    answers: DataFrame | None = None
    failures: DataFrame | None = None

    @classmethod
    def kept(cls, events: DataFrame, params: Mapping[str, dict], names: DataFrame | None = None,
             answers: DataFrame | None = None) -> "Rollups":
        """All of them, kept while they are used. Each but ``pairs`` reads the events once,
        unless it is given."""
        names = name_rollup(events) if names is None else names
        names = names.persist(StorageLevel.MEMORY_AND_DISK)
        pairs = pairs_of_names(names).persist(StorageLevel.MEMORY_AND_DISK)
        burst = params.get("nxdomain_spike", {})
        limits = {k: burst[k] for k in ("count_threshold", "min_total") if k in burst}
        failures = able_failures(events, host_failures(events, pairs), **limits)
        answers = answer_rollup(events) if answers is None else answers
        return cls(pairs, names, answers.persist(StorageLevel.MEMORY_AND_DISK),
                   failures.persist(StorageLevel.MEMORY_AND_DISK))

    def of(self, func: Callable) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items()
                if v is not None and k in signature(func).parameters}

    def unpersist(self) -> None:
        for df in vars(self).values():
            if df is not None:
                df.unpersist()


def union_alerts(events: DataFrame, params: Mapping[str, dict] | None = None,
                 detectors: Iterable[str] | None = None,
                 rollups: Rollups | None = None) -> DataFrame:
    """Alerts of all detectors without ids, as one lazy plan.

    ``params`` holds keyword arguments per detector name. Detectors that accept one of the
    ``rollups`` do not rescan the events for it; without any, they share the (host, domain) one.
    """
    params = params or {}
    rollups = Rollups(pair_rollup(events)) if rollups is None else rollups
    branches = []
    for name in DETECTOR_FUNCS if detectors is None else detectors:
        func = DETECTOR_FUNCS[name]
        branches.append(func(events, **{**rollups.of(func), **params.get(name, {})}))
    if not branches:
        return empty_alerts(events.sparkSession).drop("alert_id")
    return reduce(DataFrame.unionByName, branches)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row number, from 1, in this order; rows come back in it.

    The rows are range partitioned and sorted, so no task sees all of them. A
    checkpoint fixes the ranges; a number is then the position inside its range plus
    the size of all earlier ranges, a table with one row per range.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialized(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_position", position))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .select(*rows.columns, (F.col("_offset") + F.col("_position") + 1).alias(name)))


def number_alerts(alerts: DataFrame) -> DataFrame:
    """Add ``ALT-0001 …`` in alert order; rows come back in that order."""
    return (
        numbered(alerts, alert_order(), "_number")
        .withColumn("alert_id", F.format_string("ALT-%04d", "_number"))
        .select(*ALERT_COLUMNS))


def run_all_detectors(events: DataFrame, params: Mapping[str, dict] | None = None,
                      detectors: Iterable[str] | None = None, **known: DataFrame) -> DataFrame:
    """All alerts, highest severity first, with sequential ids.

    Runs at once: the rollups and the found alerts are kept while the ids are
    given, and the numbered table is checkpointed, so later queries read it
    instead of repeating detection. All detectors together read the events four
    times: for names, for answers, for the instants of pairs with enough queries
    and for the failures of hosts with enough of them. Rollups that are ``known``
    (``names``, ``answers``) are not made again.
    """
    rollups = Rollups.kept(events, params or {}, **known)
    found = union_alerts(events, params, detectors, rollups).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return number_alerts(found)
    finally:
        found.unpersist()
        rollups.unpersist()
