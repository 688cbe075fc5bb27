"""Stored day states against exact counts."""

from datetime import date, timedelta

import pytest
from compare import START
from pyspark.sql import functions as F

from nametrail.plans import sketches
from nametrail.plans.analytics import kpis
from nametrail.schema import ALERT_SCHEMA
from nametrail.sources import empty_events


@pytest.fixture(scope="module")
def events(spark):
    row = F.col("id")
    return spark.range(60_000).select(
        (F.lit(START) + F.make_dt_interval(hours=(row % 96).cast("int"))).alias("timestamp"),
        F.concat(F.lit("10."), row % 20_000).alias("src_ip"),
        F.concat(F.lit("d"), F.when(row % 3 == 0, 0).otherwise(row % 50), F.lit(".com"))
        .alias("registrable_domain"),
        F.when(row % 4 == 0, "NXDOMAIN").otherwise("NOERROR").alias("response_code"),
        F.lit("").alias("response_ip"), F.lit(None).cast("double").alias("first_registered_days_ago"),
    ).cache()


def exact(events):
    rows = events.groupBy("registrable_domain").agg(
        F.count("*").alias("n"), F.count_if(F.col("response_code") == "NXDOMAIN").alias("nx"),
        F.count_distinct("src_ip").alias("hosts")).collect()
    return {r.registrable_domain: (r.n, r.nx, r.hosts) for r in rows}


def close(approx, count):
    return abs(approx - count) <= max(1, 4 * sketches.standard_error() * count)


def test_states_of_parts_add_up(spark, events, tmp_path):
    path = str(tmp_path / "state")
    for k in (2, 0, 1):
        sketches.append_state(sketches.day_state(events.where(F.crc32("src_ip") % 3 == k)), path)
    stored, whole = sketches.read_state(spark, path), sketches.day_state(events)
    assert stored.count() > whole.count() == sketches.compacted(stored).count()
    want = exact(events)
    for state in (stored, sketches.compacted(stored), whole):
        got = {r.registrable_domain: r for r in sketches.domain_reach(state).collect()}
        assert set(got) == set(want)
        for name, (n, nx, hosts) in want.items():
            assert (got[name].n_queries, got[name].n_nx) == (n, nx)
            assert close(got[name].approx_hosts, hosts)
        row = sketches.state_kpis(state).first()
        assert (row.total_queries, row.unique_domains) == (60_000, len(want))
        assert close(row.approx_hosts, 20_000)


def test_any_range_of_days(spark, events, tmp_path):
    path = str(tmp_path / "state")
    sketches.append_state(sketches.day_state(events), path)
    first = START.date() + timedelta(days=1)
    for last in (first, first + timedelta(days=1), None):
        days = F.to_date("timestamp")
        part = events.where((days >= F.lit(first)) & (days <= F.lit(last or date(2100, 1, 1))))
        state = sketches.read_state(spark, path, first, last)
        row, want = sketches.state_kpis(state).first(), exact(part)
        assert row.total_queries == part.count() and row.unique_domains == len(want)
        assert close(row.approx_hosts, part.select("src_ip").distinct().count())
        text = state._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in text


def test_exact_kpis_agree_and_empty_logs(spark, events):
    alerts = spark.createDataFrame([], ALERT_SCHEMA)
    row = kpis(events, alerts).first()
    state = sketches.state_kpis(sketches.day_state(events)).first()
    assert (state.total_queries, state.unique_domains) == (row.total_queries, row.unique_domains)
    assert close(state.approx_hosts, row.unique_hosts)
    empty = sketches.state_kpis(sketches.day_state(empty_events(spark))).first()
    assert tuple(empty) == (0, 0, 0)


def test_evidence_as_typed_facts(spark):
    import json

    from nametrail.plans.evidence import evidence_facts, fact, with_facts

    texts = {"a": '{"n_queries":3,"matched_brand":"x.com","ratio":0.25}', "b": '{"providers":["p","q"]}',
             "c": "no json", "d": None, "e": "{}"}
    alerts = spark.createDataFrame([(i, "det", "d", "h", t) for i, t in texts.items()],
                                   "alert_id string, detector string, domain string, src_ip string, evidence string")
    got = {(r.alert_id, r.name): r.number if r.text is None else r.text
           for r in evidence_facts(alerts).where("name is not null").collect()}
    assert got == {("a", "n_queries"): 3.0, ("a", "matched_brand"): "x.com", ("a", "ratio"): 0.25,
                   ("b", "providers"): json.dumps(["p", "q"], separators=(",", ":"))}
    rows = with_facts(alerts).select("alert_id", fact("n_queries", "bigint").alias("n"),
                                     fact("matched_brand", "string").alias("brand")).collect()
    assert {r.alert_id: (r.n, r.brand) for r in rows} == {
        "a": (3, "x.com"), **{i: (None, None) for i in "bcde"}}
