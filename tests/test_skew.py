"""Heavy-key paths against the plain path and against brute force."""

import math
import random
from collections import Counter

import pytest
from compare import START

from nametrail import operators as ops
from nametrail.operators.nxdomain import nxdomain_features

US = 1_000_000


def random_rows(seed, n=400):
    """Two hosts hold most rows; many rows share an instant."""
    rng = random.Random(seed)
    return [{
        "src_ip": rng.choice(["10.0.0.1"] * 5 + ["10.0.0.2"] * 3 + [f"10.0.1.{i}" for i in range(6)]),
        "query_name": rng.choice(["a.x.com", "b.x.com", "c.y.com", "d.z.com"]),
        "response_code": rng.choice(["NXDOMAIN", "NXDOMAIN", "NOERROR"]),
        "timestamp": rng.choice([rng.randint(0, 900), rng.randint(0, 90) * 10, rng.random() * 900]),
    } for _ in range(n)]


def us(row):
    return round(row["timestamp"] * US)


def bursts(rows, width, threshold):
    out = {}
    for host in {r["src_ip"] for r in rows}:
        times = sorted(us(r) for r in rows
                       if r["src_ip"] == host and r["response_code"] == "NXDOMAIN")
        best = (0, None)
        for end in times:
            n = sum(end - width <= t <= end for t in times)
            if n > best[0]:
                best = (n, end)
        if best[0] >= threshold:
            inside = [r for r in rows if r["src_ip"] == host and r["response_code"] == "NXDOMAIN"
                      and best[1] - width <= us(r) <= best[1]]
            counts = Counter(r["query_name"] for r in inside)
            first = {q: min(us(r) for r in inside if r["query_name"] == q) for q in counts}
            names = sorted(counts, key=lambda q: (-counts[q], first[q], q))[:3]
            out[host] = (best[0], best[1], names)
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("heavy_min_rows,slice_us", [
    (10**9, 60 * US), (1, 7 * US), (60, 45 * US)])
def test_bursts_match_brute_force(make_events, seed, heavy_min_rows, slice_us):
    rows = random_rows(seed)
    found = nxdomain_features(
        make_events(rows), window_minutes=1, count_threshold=6, min_total=1,
        heavy_min_rows=heavy_min_rows, slice_us=slice_us).collect()
    got = {
        r.src_ip: (r.max_nxdomain_in_window, round((r.last_seen - START).total_seconds() * US),
                   r.names)
        for r in found}
    assert got == bursts(rows, 60 * US, 6)


def intervals(rows, min_queries):
    out = {}
    for key in {(r["src_ip"], r["query_name"]) for r in rows}:
        times = sorted(us(r) for r in rows if (r["src_ip"], r["query_name"]) == key)
        gaps = [(b - a) / US for a, b in zip(times, times[1:])]
        if len(times) >= min_queries and sum(gaps) > 0:
            mean = sum(gaps) / len(gaps)
            out[key] = (len(times), mean,
                        math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("heavy_min_rows,slice_us", [
    (10**9, 60 * US), (1, 7 * US), (30, 45 * US)])
def test_intervals_match_brute_force(make_events, seed, heavy_min_rows, slice_us):
    rows = random_rows(seed)
    found = ops.beaconing_features(
        make_events(rows), 6, heavy_min_rows=heavy_min_rows, slice_us=slice_us).collect()
    want = intervals(rows, 6)
    assert {(r.src_ip, r.query_name) for r in found} == set(want)
    for r in found:
        n, mean, std = want[r.src_ip, r.query_name]
        assert r.n_queries == n
        assert r.mean_interval_sec == pytest.approx(mean, rel=1e-12)
        assert r.std_interval_sec == pytest.approx(std, rel=1e-9)


def test_many_queries_at_one_instant_only(make_events):
    rows = [{"query_name": "a.com", "timestamp": 5}] * 50
    events = make_events(rows)
    assert ops.beaconing_features(events, 6, heavy_min_rows=1).count() == 0
    one_more = make_events(rows + [{"query_name": "a.com", "timestamp": 105}])
    plain, heavy = (ops.beaconing_features(one_more, 6, heavy_min_rows=m).first()
                    for m in (10**9, 1))
    assert plain.std_interval_sec == pytest.approx(heavy.std_interval_sec, rel=1e-12)
    assert plain.mean_interval_sec == heavy.mean_interval_sec == 2.0


def test_every_heavy_key_is_found(spark):
    from pyspark.sql import functions as F

    from nametrail.operators.skew import heavy_by_count

    totals = spark.range(0, 20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4).alias("n"))
    assert heavy_by_count(totals, ["k"], "n", 3).distinct().count() == 5_000


def test_slicing_never_changes_a_bit(make_events):
    rows = random_rows(5, 600)
    events = make_events(rows)
    forms = [sorted(map(tuple, ops.beaconing_features(
        events.repartition(n), 6, 1.0, heavy_min_rows=heavy, slice_us=slice_us).collect()))
        for n, heavy, slice_us in ((1, 10**9, 60 * US), (5, 1, 7 * US), (3, 40, 45 * US))]
    assert forms[0] and forms[0] == forms[1] == forms[2]


def test_host_lists_are_bounded_and_sorted(make_events):
    from nametrail.operators.rollup import bounded_hosts, pair_rollup

    events = make_events([{"query_name": "x.com", "src_ip": f"10.0.0.{i}"} for i in range(30)])
    pairs = pair_rollup(events)
    want = sorted(f"10.0.0.{i}" for i in range(30))
    assert bounded_hosts(pairs).first().hosts == ";".join(want[:5])
    assert bounded_hosts(pairs, 100).first().hosts == ";".join(want)


@pytest.mark.parametrize("split_rows", [1, 7, 10**6])
def test_names_of_one_window_with_most_rows(make_events, split_rows):
    from nametrail.operators import nxdomain

    rows = [{"src_ip": "10.0.0.1", "query_name": f"n{i % 7}.x.com", "response_code": "NXDOMAIN",
             "timestamp": i % 50} for i in range(400)]
    rows += [{**r, "src_ip": "10.0.0.2"} for r in rows[:30]]
    events = make_events(rows)
    failures = nxdomain.able_failures(events, nxdomain.host_failures(events, None), 6, 1)
    found = nxdomain_features(events, window_minutes=1, count_threshold=6, min_total=1).select(
        "src_ip", "end_us")
    got = {r.src_ip: r.names for r in nxdomain.burst_names(failures, found, 1, split_rows).collect()}
    assert got == {h: names for h, (_, _, names) in bursts(rows, 60 * US, 6).items()}
