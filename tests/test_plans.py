"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nametrail import operators as ops
from nametrail.plans import union_alerts
from nametrail.sources import write_events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "parquet")
    write_events(entry.dns_events(spark, SF), path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_nested_loops(stored):
    text = plan(union_alerts(stored, entry.PARAMS))
    for word in ("EvalPython", "InPandas", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(stored):
    doh = plan(ops.doh_features(stored, entry.PROVIDERS))
    assert "In(query_name" in doh and "response_ip" not in doh
    flux = plan(ops.fast_flux_features(stored))
    assert "EqualTo(response_code,NOERROR)" in flux and "query_type" not in flux
    day = plan(ops.pair_rollup(stored.where("event_date = date'2024-01-02'")))
    assert "PartitionFilters: [isnotnull(event_date" in day


def test_text_features_stay_above_the_aggregation(stored):
    text = plan(ops.detect_dga(stored))
    below = text[text.index("Exchange hashpartitioning(registrable_domain"):]
    assert "array_distinct" in text and "array_distinct" not in below
    squat = plan(ops.detect_typosquatting(stored, brands=entry.BRANDS))
    assert "levenshtein" in squat
    assert "levenshtein" not in squat[squat.rindex("Exchange hashpartitioning(registrable_domain"):]


def test_host_lists_are_limited_before_the_exchange(stored):
    text = plan(ops.bounded_hosts(ops.pair_rollup(stored)))
    assert "row_number(), 5, Partial" in text


def test_rollups_are_hash_aggregations(stored):
    for df in (ops.pair_rollup(stored), ops.fast_flux_features(stored),
               ops.tunneling_features(stored)):
        assert "SortAggregate" not in plan(df)


def test_unused_heavy_branch_disappears(stored):
    df = ops.beaconing_features(stored)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    # The counts and the rows; the rows meet the counts once, and no heavy key.
    assert final.count("FileScan") == 2 and final.count("LeftSemi") == 1


def test_ids_do_not_need_a_single_task(spark):
    from nametrail.operators.alerts import UNNUMBERED
    from nametrail.plans import number_alerts

    alerts = spark.range(10).select(*[
        {"severity_score": F.lit(1.0), "timestamp": F.current_timestamp(),
         "domain": F.col("id").cast("string")}.get(c, F.lit("x")).alias(c) for c in UNNUMBERED])
    text = plan(number_alerts(alerts))
    window = text[text.index("Window"):]
    assert "SinglePartition" in window and "severity_score" not in window[:window.index("Scan")]
