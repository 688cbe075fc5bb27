"""Streams run to the end of their input and compared with the batch operators."""

import random
from datetime import timedelta

import pytest
from compare import START
from pyspark.sql import functions as F
from test_pipeline import scenario_rows
from test_skew import random_rows
from test_sources import BIND, CSV, ZEEK

from nametrail import operators as ops
from nametrail import streaming as st
from nametrail.plans import analytics, union_alerts
from nametrail.schema import EVENT_COLUMNS
from nametrail.sources import ZeekHeader, load_log

ZEEK_FIELDS = ("ts", "uid", "id.orig_h", "query", "qtype_name", "rcode_name", "answers", "TTLs")


@pytest.fixture(autouse=True, scope="module")
def state_store(spark):
    before = spark.conf.get(st.stateful.STORE)
    st.use_state_store(spark)
    yield
    spark.conf.set(st.stateful.STORE, before)


@pytest.fixture()
def drain(spark, tmp_path):
    def run(df, mode="append"):
        name = f"out_{random.randrange(10**9)}"
        query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
                 .option("checkpointLocation", str(tmp_path / name))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.table(name)
    return run


@pytest.fixture()
def feed(spark, make_events, tmp_path):
    """Write rows as one Parquet file per chunk, in the given order."""
    def run(rows, chunks=1):
        path = str(tmp_path / f"in_{random.randrange(10**9)}")
        size = -(-len(rows) // chunks)
        for i in range(chunks):
            part = make_events(rows[i * size:(i + 1) * size]).coalesce(1)
            part.write.mode("append").parquet(path)
        return st.stream_log(spark, path, "parquet", maxFilesPerTrigger=1)
    return run


def in_time_order(rows):
    return sorted(rows, key=lambda r: r["timestamp"])


@pytest.mark.parametrize("fmt,text,options", [
    ("bind", BIND, {}), ("csv", CSV, {"columns": CSV.splitlines()[0].split(",")}),
    ("zeek", ZEEK, {"header": ZeekHeader(ZEEK_FIELDS)})])
def test_streamed_logs_equal_loaded_logs(spark, tmp_path, drain, fmt, text, options):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(text)
    batch = load_log(spark, str(folder), fmt)
    assert sorted(drain(st.stream_log(spark, str(folder), fmt, **options)).collect(), key=str) == \
        sorted(batch.collect(), key=str)


def test_unknown_stream_format(spark):
    with pytest.raises(ValueError):
        st.stream_log(spark, "/nowhere", "zeek")


def test_duplicates_and_late_rows(feed, drain):
    rows = [{"timestamp": 0}, {"timestamp": 0}, {"timestamp": 3600}, {"timestamp": 3300},
            {"timestamp": 60, "src_ip": "late"}, {"timestamp": 7200}]
    out = drain(st.without_duplicates(feed(rows, chunks=6))).collect()
    assert sorted(r.timestamp for r in out) == [
        START + timedelta(seconds=s) for s in (0, 3300, 3600, 7200)]


def test_traffic(feed, drain, make_events):
    rows = in_time_order(random_rows(1))
    want = analytics.traffic_series(make_events(rows)).where("n_queries > 0").collect()
    got = drain(st.traffic_counts(feed(rows, 3)), "complete").orderBy("bucket_start").collect()
    assert got == want


def test_sliding_windows_never_exceed_the_exact_count(feed, drain, make_events):
    rows = in_time_order(random_rows(2))
    exact = {r.src_ip: r.max_nxdomain_in_window for r in ops.nxdomain_features(
        make_events(rows), window_minutes=5, count_threshold=5, min_total=1).collect()}
    got = drain(st.nxdomain_windows(feed(rows, 2), count_threshold=5), "complete").collect()
    assert got and all(r.n_failed <= exact[r.src_ip] for r in got)


def test_flagged_events(feed, drain, make_events):
    rows = scenario_rows()
    events = make_events(rows)
    got = drain(st.flag_events(feed(rows, 2)))
    assert got.columns[:len(EVENT_COLUMNS)] == EVENT_COLUMNS
    for column, detect in (("dga_score", ops.detect_dga), ("matched_brand", ops.detect_typosquatting)):
        flagged = {r[0] for r in got.where(F.col(column).isNotNull())
                   .select("registrable_domain").collect()}
        assert flagged == {r.domain for r in detect(events).collect()}
    assert {r.src_ip for r in got.where("doh").collect()} == {"10.0.0.8"}


def test_tunneling_sessions(feed, drain, make_events):
    rows = [r for r in scenario_rows() if r["src_ip"] == "10.0.0.2"]
    later = [{"timestamp": 50_000, "query_name": "a.b.com"}]
    batch = ops.tunneling_features(make_events(rows)).first()
    got = drain(st.tunneling_sessions(feed(rows + later, 2))).collect()
    assert len(got) == 1 and got[0].n_queries == batch.n_queries
    assert got[0].score == pytest.approx(batch.score, abs=0.5)


def last_per_key(table, keys, column):
    best = {}
    for r in table.collect():
        key = tuple(r[k] for k in keys)
        if key not in best or r[column] >= best[key][column]:
            best[key] = r
    return best


def test_beacon_state_equals_batch(feed, drain, make_events):
    rows = in_time_order(random_rows(3, 250))
    want = {(r.src_ip, r.query_name): r for r in ops.beaconing_features(
        make_events(rows), 2).collect()}
    got = last_per_key(drain(st.beacon_state(feed(rows, 4)), "update"),
                       ["src_ip", "query_name"], "n_queries")
    for key, r in want.items():
        assert got[key].n_queries == r.n_queries
        assert got[key].mean_interval_sec == pytest.approx(r.mean_interval_sec, rel=1e-9)
        assert got[key].std_interval_sec == pytest.approx(r.std_interval_sec, rel=1e-7)


def test_burst_state_equals_batch(feed, drain, make_events):
    rows = in_time_order(random_rows(4, 250))
    want = {(r.src_ip,): r for r in ops.nxdomain_features(
        make_events(rows), window_minutes=2, count_threshold=5, min_total=1).collect()}
    got = last_per_key(drain(st.burst_state(feed(rows, 4), 2.0, 5), "update"),
                       ["src_ip"], "max_nxdomain_in_window")
    assert {k: (r.max_nxdomain_in_window, r.end_us) for k, r in got.items()} == {
        k: (r.max_nxdomain_in_window, r.end_us) for k, r in want.items()}


def test_batch_detectors_on_micro_batches(spark, feed, make_events, tmp_path):
    rows = in_time_order(scenario_rows())
    some = ["typosquat", "doh_evasion", "fast_flux"]
    seen = {}

    def deliver(alerts, batch_id):
        seen[batch_id] = sorted(alerts.drop("alert_id").collect())

    writer = st.detect_on_batches(
        feed(rows, 2), str(tmp_path / "store"), str(tmp_path / "ck"), deliver, detectors=some)
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [0, 1]
    assert seen[1] == sorted(union_alerts(make_events(rows), detectors=some).collect())


def test_all_detectors_on_shuffled_micro_batches(spark, feed, make_events, tmp_path):
    rows = shuffled_within(scenario_rows(), 4000, 1)
    old = [{"timestamp": -200_000, "query_name": "dns.google", "src_ip": "10.9.9.9"}]
    seen = {}

    def deliver(alerts, batch_id):
        seen[batch_id] = sorted(alerts.drop("alert_id").collect())

    store = tmp_path / "store"
    writer = st.detect_on_batches(
        feed(old + rows, 3), str(store), str(tmp_path / "ck"), deliver, hours=24.0)
    writer.trigger(availableNow=True).start().awaitTermination()
    assert seen[2] == sorted(union_alerts(make_events(rows)).collect())
    # What has passed is gone, and events themselves are not kept.
    assert {p.name for p in store.iterdir()} == {"names", "answers", "instants"}
    slices = sorted(int(p.name.removeprefix("slice=")) for p in store.glob("*/*/slice=*"))
    assert slices[0] * 900 > START.timestamp() - 86_400 - 900


def test_state_of_micro_batches_does_not_grow_with_repeats(spark, make_events):
    from nametrail.streaming.live import _parts

    rows = [{"timestamp": i % 60, "query_name": f"h{i % 5}.x.com", "src_ip": f"10.0.0.{i % 4}"}
            for i in range(240)]
    once, often = make_events(rows), make_events(rows * 20)
    for name, part in _parts(often).items():
        assert part.count() == _parts(once)[name].count() <= 60, name


def shuffled_within(rows, seconds, seed):
    """Rows in an order in which none is later than its neighbours by more than this."""
    import random

    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r["timestamp"] + rng.random() * seconds)


@pytest.mark.parametrize("seed", range(2))
def test_late_rows_within_the_watermark_count(feed, drain, make_events, seed):
    rows = shuffled_within(random_rows(seed + 20, 250), 500, seed)
    want = {(r.src_ip, r.query_name): r for r in ops.beaconing_features(make_events(rows), 2).collect()}
    got = last_per_key(drain(st.beacon_state(feed(rows, 5)), "update"),
                       ["src_ip", "query_name"], "n_queries")
    for key, r in want.items():
        assert got[key].n_queries == r.n_queries
        assert got[key].mean_interval_sec == pytest.approx(r.mean_interval_sec, rel=1e-9)
        assert got[key].std_interval_sec == pytest.approx(r.std_interval_sec, rel=1e-7)
    want = {(r.src_ip,): (r.max_nxdomain_in_window, r.end_us) for r in ops.nxdomain_features(
        make_events(rows), window_minutes=2, count_threshold=5, min_total=1).collect()}
    last = {}
    for r in drain(st.burst_state(feed(rows, 5), 2.0, 5), "update").collect():
        n, end = last.get((r.src_ip,), (0, 0))
        if (r.max_nxdomain_in_window, -r.end_us) > (n, -end):
            last[r.src_ip,] = (r.max_nxdomain_in_window, r.end_us)
    assert last == want


def test_a_batch_of_late_rows_hides_nothing(spark, feed, make_events, tmp_path):
    # One micro-batch for each row or two: few rows, or it takes minutes.
    rows = in_time_order([r for r in scenario_rows() if r["src_ip"] in ("10.0.0.5", "10.0.0.7")])
    late = [{"timestamp": -80_000, "query_name": "late.com"}]
    far = [{"timestamp": 10**9, "query_name": "future.com"}]
    seen = {}

    def deliver(alerts, batch_id):
        seen[batch_id] = sorted(alerts.drop("alert_id").collect())

    writer = st.detect_on_batches(feed(rows + far + late, len(rows) + 1), str(tmp_path / "store"),
                                  str(tmp_path / "ck"), deliver, hours=24.0, detectors=["typosquat"])
    writer.trigger(availableNow=True).start().awaitTermination()
    want = sorted(union_alerts(make_events(rows), detectors=["typosquat"]).collect())
    assert want and seen[max(seen)] == want


class Handle:
    """State of one key in dictionaries that count what is loaded."""

    def __init__(self):
        self.values, self.maps, self.timers, self.loaded = {}, {}, [], 0

    def getValueState(self, name, schema):
        return Value(self.values, name)

    def getMapState(self, name, key, schema):
        return Map(self, self.maps.setdefault(name, {}), name)

    def registerTimer(self, ms):
        self.timers.append(ms)


class Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, row):
        self.values[self.name] = row

    def clear(self):
        self.values.pop(self.name, None)


class Map:
    def __init__(self, handle, entries, name):
        self.handle, self.entries, self.name = handle, entries, name

    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        if self.name == "instants":
            self.handle.loaded += len(self.entries[key][0])
        return self.entries[key]

    def updateValue(self, key, row):
        self.entries[key] = row

    def removeKey(self, key):
        self.entries.pop(key, None)

    def iterator(self):
        return iter(list(self.entries.items()))

    def clear(self):
        self.entries.clear()


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def feed_key(processor, us, watermark_ms):
    import pandas as pd

    return [tuple(r) for out in processor.handleInputRows(
        ("host", "name")[: 2 if isinstance(processor, st.stateful.BeaconState) else 1],
        iter([pd.DataFrame({"us": us})]), Clock(watermark_ms)) for r in out.to_numpy().tolist()]


def test_a_key_with_a_million_instants_loads_single_slices():
    import numpy as np

    beacon, burst = st.stateful.BeaconState(10**7, 24), st.stateful.BurstState(3 * 10**8, 20, 10**7, 24)
    for processor in (beacon, burst):
        handle = Handle()
        processor.init(handle)
        many = np.arange(10**6) * 600 + 10**12  # 10 minutes
        feed_key(processor, many, 0)
        assert handle.loaded == 0 or processor is burst
        handle.loaded = 0
        (row,) = feed_key(processor, np.array([10**12 + 6 * 10**8]), 0)
        if processor is beacon:
            assert handle.loaded == 0 and row[2] == 10**6 + 1
        else:
            assert row[1] == 500_001  # the last window is no larger, so none of it is loaded
            assert handle.loaded <= 32 * 16_667
        assert len(handle.maps["instants"]) == 61


def test_state_is_bounded_and_ends():
    import numpy as np

    for processor in (st.stateful.BeaconState(10**7, 1), st.stateful.BurstState(6 * 10**7, 2, 10**7, 1)):
        handle = Handle()
        processor.init(handle)
        for minute in range(60):
            us = minute * 6 * 10**7 + np.arange(0, 6 * 10**7, 10**6)
            feed_key(processor, us, max(0, minute - 10) * 60_000)
            assert len(handle.maps["sums"]) <= 6 * 12 + 1
        assert len(handle.timers) == 1
        assert list(processor.handleExpiredTimer(("h",), None, Clock(handle.timers[0]))) == []
        assert len(handle.timers) == 2 and handle.values
        list(processor.handleExpiredTimer(("h",), None, Clock(handle.timers[1])))
        assert not handle.values and not handle.maps["sums"] and not handle.maps["instants"]
