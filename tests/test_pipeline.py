import pytest
from pyspark.sql import functions as F

from nametrail.operators.alerts import UNNUMBERED
from nametrail.plans import DETECTOR_FUNCS, run_all_detectors, union_alerts
from nametrail.plans.pipeline import alert_order
from nametrail.schema import ALERT_COLUMNS, ALERT_SCHEMA
from nametrail.sources import empty_events


def scenario_rows():
    """One attack per detector, plus two quiet hosts."""
    def label(name, rows):
        return [{**r, "ground_truth_label": name} for r in rows]

    rows = label("dga", [
        {"src_ip": "10.0.0.1", "query_name": q, "response_code": "NXDOMAIN", "timestamp": i * 400}
        for i, q in enumerate(["x9k2qz7vw4bt.net", "qzxvkjwq7.com", "w8rj3zq5xk.org"])])
    rows += label("tunneling", [
        {"src_ip": "10.0.0.2", "query_name": f"{i:040x}.evil.net", "query_type": "TXT",
         "timestamp": i * 6} for i in range(30)])
    rows += label("beaconing", [
        {"src_ip": "10.0.0.3", "query_name": "c2.home.net", "timestamp": i * 60}
        for i in range(40)])
    rows += label("nxdomain_flood", [
        {"src_ip": "10.0.0.4", "query_name": f"host{i}.target.com", "response_code": "NXDOMAIN",
         "timestamp": i * 3} for i in range(40)])
    rows += label("typosquat", [
        {"src_ip": "10.0.0.5", "query_name": "www.paypa1.com", "timestamp": 9}])
    rows += label("fast_flux", [
        {"src_ip": "10.0.0.6", "query_name": "flux.net", "response_ip": f"9.9.9.{i}",
         "timestamp": i * i * 7} for i in range(12)])
    rows += label("newly_registered", [
        {"src_ip": "10.0.0.7", "query_name": "freshly.org", "first_registered_days_ago": 1.0,
         "timestamp": i * i} for i in range(4)])
    rows += label("doh_evasion", [
        {"src_ip": "10.0.0.8", "query_name": "dns.google", "timestamp": 4}])
    rows += label("benign", [
        {"src_ip": f"10.0.1.{h}", "query_name": q, "response_ip": "8.8.8.8",
         "timestamp": i * i * 11 + h, "first_registered_days_ago": 4000.0}
        for h in range(2) for i, q in enumerate(
            ["www.google.com", "mail.google.com", "github.com", "office.com"] * 2)])
    return rows


@pytest.fixture(scope="module")
def events(make_events):
    return make_events(scenario_rows()).cache()


@pytest.fixture(scope="module")
def alerts(events):
    return run_all_detectors(events)


def test_every_scenario_is_caught_by_its_detector(alerts):
    by_host = {h: set() for h in (f"10.0.0.{i}" for i in range(1, 9))}
    for a in alerts.collect():
        for host in a.src_ip.split(";"):
            by_host.setdefault(host, set()).add(a.detector)
    for i, detector in enumerate(DETECTOR_FUNCS, 1):
        assert detector in by_host[f"10.0.0.{i}"]
    assert not any(h.startswith("10.0.1.") for h in by_host)


def test_schema_order_and_ids(alerts):
    assert alerts.columns == ALERT_COLUMNS
    assert [f.dataType for f in alerts.schema] == [f.dataType for f in ALERT_SCHEMA]
    rows = alerts.orderBy(*alert_order()).collect()
    assert [r.alert_id for r in rows] == [f"ALT-{i + 1:04d}" for i in range(len(rows))]
    assert [r.severity_score for r in rows] == sorted((r.severity_score for r in rows), reverse=True)


def test_input_order_and_partitions_do_not_matter(events, alerts):
    mixed = run_all_detectors(events.repartition(13, F.rand(3)))
    assert sorted(mixed.collect()) == sorted(alerts.collect())


def test_labels_are_never_read(events, alerts):
    hidden = union_alerts(events.withColumn("ground_truth_label", F.lit(None).cast("string")))
    assert sorted(hidden.collect()) == sorted(alerts.select(UNNUMBERED).collect())


def test_union_equals_the_single_detectors(events, alerts):
    single = [r for f in DETECTOR_FUNCS.values() for r in f(events).collect()]
    assert sorted(single) == sorted(alerts.select(UNNUMBERED).collect())


def test_parameters_and_own_detector(events, monkeypatch):
    some = union_alerts(events, {"doh_evasion": {"score": 90.0}}, ["doh_evasion"])
    assert some.first().severity_label == "Critical"

    def silent_hosts(events, score=50.0):
        return DETECTOR_FUNCS["doh_evasion"](events, score).withColumn("detector", F.lit("own"))

    monkeypatch.setitem(DETECTOR_FUNCS, "own", silent_hosts)
    found = run_all_detectors(events, {"own": {"score": 99.0}}, ["doh_evasion", "own"])
    assert [r.detector for r in found.orderBy("alert_id").collect()] == ["own", "doh_evasion"]
    assert union_alerts(events, detectors=[]).count() == 0


def test_empty_events(spark):
    alerts = run_all_detectors(empty_events(spark))
    assert alerts.columns == ALERT_COLUMNS and alerts.count() == 0


def test_many_alerts_are_numbered_without_gaps(spark):
    from nametrail.plans import number_alerts

    many = spark.range(0, 25_000, numPartitions=7).select(*[
        {"severity_score": (F.col("id") % 3).cast("double"), "timestamp": F.timestamp_seconds("id"),
         "detector": F.lit("dga"), "domain": F.concat(F.lit("d"), F.col("id"))}.get(
            c, F.lit("x")).alias(c) for c in UNNUMBERED])
    rows = number_alerts(many).orderBy(*alert_order()).select("alert_id").collect()
    assert [r.alert_id for r in rows] == [f"ALT-{i + 1:04d}" for i in range(25_000)]


@pytest.fixture()
def counted(spark):
    """Events that count how often each of their rows is read."""
    reads = spark.sparkContext.accumulator(0)

    def build(events):
        def run(batches):
            for batch in batches:
                reads.add(batch.num_rows)
                yield batch
        return events.mapInArrow(run, events.schema)

    return reads, build


def test_all_detectors_read_the_log_four_times(events, alerts, counted):
    reads, build = counted
    assert sorted(run_all_detectors(build(events)).collect()) == sorted(alerts.collect())
    assert reads.value == 4 * events.count()


def test_rollups_follow_from_each_other(events):
    from nametrail.operators.rollup import name_rollup, pair_rollup, pairs_of_names

    pairs = pair_rollup(events)
    again = pairs_of_names(name_rollup(events)).select(*pairs.columns)
    assert sorted(again.collect()) == sorted(pairs.collect())
