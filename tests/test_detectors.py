"""Rows just inside and just outside every gate of the detectors."""

import json
import math

import pytest

from nametrail import operators as ops
from nametrail.operators.alerts import UNNUMBERED


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def repeat(n, step, **row):
    return [{**row, "timestamp": i * step} for i in range(n)]


def label_score(label):
    counts = [label.count(c) for c in set(label)]
    entropy = -sum(c / len(label) * math.log2(c / len(label)) for c in counts)
    return entropy


def test_dga(make_events):
    name = "x9k2qz7vw4bt.net"
    events = make_events(
        [{"query_name": name, "src_ip": f"10.0.0.{i}", "response_code": "NXDOMAIN" if i else "NOERROR",
          "timestamp": i} for i in range(7)]
        + [{"query_name": q} for q in
           ("x9k2q.net", "googlemail.com", "mail-support.com", "", "service.com")])
    alert = one(ops.detect_dga(events))
    label = name.split(".")[0]
    score = 100 * (0.45 * label_score(label) / 5.17 + 0.40 * 1.0 + 0.15 * 4 / 12)
    assert alert.domain == name and alert.detector == "dga"
    assert alert.severity_score == pytest.approx(score, abs=0.1)
    assert alert.src_ip == "10.0.0.0;10.0.0.1;10.0.0.2;10.0.0.3;10.0.0.4"
    assert alert.timestamp.second == 6
    assert (alert.mitre_id, alert.severity_label) == ("T1568.002", "High")
    evidence = json.loads(alert.evidence)
    assert evidence["n_queries"] == 7 and evidence["digit_ratio"] == 0.33
    assert evidence["nxdomain_ratio"] == 0.86
    assert alert.asDict().keys() == set(UNNUMBERED)


def test_dga_hyphen_discount_and_parameters(make_events):
    events = make_events([{"query_name": "qzxv-kjwq.com"}, {"query_name": "qzxvkjwq.com"}])
    scores = {r.label: r.score for r in ops.dga_features(events).collect()}
    plain = 100 * (0.45 * label_score("qzxvkjwq") / 5.17 + 0.40)
    hyphen = 70 * (0.45 * label_score("qzxv-kjwq") / 5.17 + 0.40)
    assert scores["qzxvkjwq"] == pytest.approx(plain)
    assert scores["qzxv-kjwq"] == pytest.approx(hyphen)
    assert ops.detect_dga(events, min_label_len=9, score_threshold=0.0).count() == 1
    assert ops.detect_dga(events, score_threshold=plain).count() == 1
    assert one(ops.detect_dga(events, score_threshold=50, max_hosts=1)).src_ip == "10.0.0.1"


def tunnel(n, step=6, **extra):
    return [{"query_name": f"{i:040x}.evil.net", "query_type": "NULL" if i % 2 else "TXT",
             "timestamp": i * step, **extra} for i in range(n)]


def test_tunneling(make_events):
    alert = one(ops.detect_tunneling(make_events(tunnel(20))))
    assert (alert.domain, alert.src_ip, alert.mitre_id) == ("evil.net", "10.0.0.1", "T1071.004")
    evidence = json.loads(alert.evidence)
    assert evidence["n_queries"] == 20 and evidence["avg_subdomain_len_chars"] == 40.0
    assert evidence["unique_label_ratio"] == 1.0 and evidence["txt_null_ratio"] == 1.0
    assert evidence["queries_per_min"] == round(20 / (19 * 6 / 60), 2)
    assert ops.detect_tunneling(make_events(tunnel(19))).count() == 0
    slow = repeat(25, 3600, query_name="www.evil.net")
    assert ops.detect_tunneling(make_events(slow)).count() == 0
    assert ops.detect_tunneling(make_events(repeat(25, 1, query_name="evil.net"))).count() == 0


def test_tunneling_weights_repeated_names(make_events):
    events = make_events(
        repeat(3, 0, query_name="aa.evil.net") + repeat(1, 0, query_name="ab.cd.evil.net"))
    row = one(ops.tunneling_features(events, 4))
    assert row.avg_len == (3 * 2 + 5) / 4 and row.unique_ratio == 0.5
    assert row.avg_entropy == pytest.approx(2.0 / 4)
    assert row.duration_min == pytest.approx(1 / 60) and row.rate == pytest.approx(240)


def test_beaconing(make_events):
    jitter = [0, 2, -3, 1, 3, -2]
    rows = [{"query_name": "c2.evil.net", "timestamp": i * 60 + jitter[i % 6]} for i in range(50)]
    alert = one(ops.detect_beaconing(make_events(rows)))
    assert alert.domain == "c2.evil.net" and alert.detector == "beaconing"
    gaps = [b["timestamp"] - a["timestamp"] for a, b in zip(rows, rows[1:])]
    mean = sum(gaps) / len(gaps)
    cv = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean
    assert alert.severity_score == pytest.approx(100 * (0.7 * (1 - cv / 0.2) + 0.3), abs=0.06)
    assert json.loads(alert.evidence)["coefficient_of_variation"] == pytest.approx(cv, abs=5e-4)


@pytest.mark.parametrize("rows", [
    repeat(5, 60, query_name="a.com"),
    repeat(9, 0, query_name="a.com"),
    [{"query_name": "a.com", "timestamp": t} for t in (0, 60, 100, 160, 200, 260, 300)],
])
def test_beaconing_negatives(make_events, rows):
    assert ops.detect_beaconing(make_events(rows)).count() == 0


def test_beaconing_needs_the_same_full_name(make_events):
    rows = [{"query_name": f"n{i % 2}.a.com", "timestamp": 60 * i} for i in range(10)]
    assert ops.detect_beaconing(make_events(rows)).count() == 0
    assert one(ops.detect_beaconing(make_events(repeat(6, 60, query_name="")))).domain == ""


def test_beaconing_exactly_regular(make_events):
    row = one(ops.beaconing_features(make_events(repeat(6, 60, query_name="a.com"))))
    assert row.coefficient_of_variation == 0.0
    assert row.score == pytest.approx(100 * (0.7 + 0.3 * 6 / 50))


def failures(times, **row):
    return [{"response_code": "NXDOMAIN", "query_name": f"n{i % 4}.x.com", "timestamp": t, **row}
            for i, t in enumerate(times)]


def test_nxdomain_closed_window(make_events):
    times = [0] + [100 + i for i in range(18)] + [300]
    alert = one(ops.detect_nxdomain_spike(make_events(failures(times) + repeat(20, 1))))
    assert alert.src_ip == "10.0.0.1" and alert.mitre_id == "T1590.002"
    assert alert.timestamp.minute == 5 and alert.timestamp.second == 0
    assert alert.severity_score == pytest.approx(100 * (0.6 * 20 / 40 + 0.4 * 0.5))
    assert alert.domain == "n0.x.com;n1.x.com;n2.x.com"
    assert json.loads(alert.evidence) == {
        "max_nxdomain_in_window": 20, "window_minutes": 5.0, "host_nxdomain_ratio": 0.5,
        "total_nxdomain_events": 20}
    late = times[:-1] + [300.000001]
    assert ops.detect_nxdomain_spike(make_events(failures(late))).count() == 0
    assert ops.detect_nxdomain_spike(make_events(failures(times[:-1]))).count() == 0


def test_nxdomain_first_window_and_names_inside_it(make_events):
    busy = failures(range(0, 20))
    outside = failures([10_000 + i * 1000 for i in range(30)], query_name="other.com")
    again = failures(range(100_000, 100_020))
    alert = one(ops.detect_nxdomain_spike(make_events(busy + outside + again)))
    assert alert.timestamp.hour == 9 and alert.timestamp.second == 19
    assert "other.com" not in alert.domain
    assert one(ops.detect_nxdomain_spike(make_events(busy), min_total=20)).detector
    assert ops.detect_nxdomain_spike(make_events(busy), min_total=21).count() == 0


def test_typosquat(make_events):
    names = ["paypa1.com", "paypal.com", "paypaI1.com", "paypxyz.com", "goggle.com", "abc",
             "gooogle.co", "login.amaz0n.com"]
    rows = {r.registrable_domain: r for r in ops.typosquat_features(
        make_events([{"query_name": n} for n in names])).collect()}
    found = {d: (r.matched_brand, r.edit_distance, r.score) for d, r in rows.items()}
    assert found == {
        "paypa1.com": ("paypal.com", 1, 92.0), "paypai1.com": ("paypal.com", 2, 68.0),
        "goggle.com": ("google.com", 1, 92.0), "gooogle.co": ("google.com", 2, 68.0),
        "amaz0n.com": ("amazon.com", 1, 92.0)}


def test_typosquat_tie_takes_the_earlier_brand(spark, make_events):
    events = make_events([{"query_name": "abcd.com"}])
    for brands in (["abcx.com", "abcy.com"], ["abcy.com", "abcx.com"]):
        assert one(ops.typosquat_features(events, brands=brands)).matched_brand == brands[0]
        table = spark.createDataFrame(list(zip(brands, range(2))), "brand string, pos int")
        assert one(ops.typosquat_features(events, brands=table)).matched_brand == brands[0]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_typosquat_brand_table_equals_list(spark, make_events, distance):
    import random

    rng = random.Random(distance)
    names = {"".join(rng.choices("abc", k=rng.randint(2, 7))) + ".io" for _ in range(150)}
    events = make_events([{"query_name": n} for n in names])
    brands = sorted(names)[:20] + ["zzz.io", "abcabc.com"]
    table = spark.createDataFrame(list(zip(brands, range(len(brands)))), "brand string, pos int")
    listed = ops.typosquat_features(events, distance, brands=brands)
    joined = ops.typosquat_features(events, distance, brands=table)
    assert sorted(listed.collect()) == sorted(joined.collect())
    assert listed.count() > 0


def lookups(n, ips, **row):
    return [{"query_name": "flux.net", "response_ip": f"1.1.1.{i % ips}", "timestamp": i, **row}
            for i in range(n)]


def test_fast_flux(make_events):
    alert = one(ops.detect_fast_flux(make_events(
        lookups(8, 8) + [{"query_name": "flux.net", "timestamp": 500, "src_ip": "10.9.9.9"}])))
    assert alert.severity_score == pytest.approx(100 * (0.4 + 0.3 + 0.3 * 0.8))
    assert alert.src_ip == "10.0.0.1" and alert.timestamp.second == 7
    assert json.loads(alert.evidence) == {
        "distinct_ips": 8, "n_resolved_queries": 8, "unique_ip_ratio": 1.0, "avg_ttl_sec": 60.0}
    assert ops.detect_fast_flux(make_events(lookups(8, 3))).count() == 0
    assert ops.detect_fast_flux(make_events(lookups(7, 7))).count() == 0
    assert ops.detect_fast_flux(make_events(lookups(8, 8, response_ip=""))).count() == 0
    slow = one(ops.fast_flux_features(make_events(lookups(8, 8, ttl=2100))))
    assert slow.score == pytest.approx(100 * (0.4 + 0.3 * 0.5 + 0.3 * 0.8))


def test_newly_registered(make_events):
    rows = [
        {"query_name": "new.com", "first_registered_days_ago": 0.0, "timestamp": 5},
        {"query_name": "week.com", "first_registered_days_ago": 7.0},
        {"query_name": "old.com", "first_registered_days_ago": 8.0},
        {"query_name": "unknown.com"},
        {"query_name": "new.com", "timestamp": 50, "src_ip": "10.0.0.9"},
        {"query_name": "grown.com", "first_registered_days_ago": 9.0, "timestamp": 1},
        {"query_name": "grown.com", "first_registered_days_ago": 1.0, "timestamp": 2},
        {"query_name": "tie.com", "first_registered_days_ago": 2.0, "timestamp": 2},
        {"query_name": "tie.com", "first_registered_days_ago": 1.0, "timestamp": 2},
        {"query_name": "minus.com", "first_registered_days_ago": -30.0},
    ]
    events = make_events(rows)
    alerts = {a.domain: a for a in ops.detect_newly_registered_domain(events).collect()}
    assert set(alerts) == {"new.com", "tie.com", "minus.com"}
    new = alerts["new.com"]
    assert (new.src_ip, new.timestamp.second) == ("10.0.0.1", 5)
    assert new.severity_score == pytest.approx(100 * (0.75 + 0.25 / 15), abs=0.06)
    assert json.loads(alerts["tie.com"].evidence) == {"age_days": 1.0, "n_queries": 2}
    assert alerts["minus.com"].severity_score == 100.0
    assert ops.detect_newly_registered_domain(events.drop("first_registered_days_ago")).count() == 0


def test_doh(spark, make_events):
    names = ["doh.opendns.com", "www.opendns.com", "cloudflare-dns.com",
             "mozilla.cloudflare-dns.com", "dns.google"]
    events = make_events([{"query_name": n, "timestamp": i} for i, n in enumerate(names)]
                         + [{"query_name": "opendns.com", "src_ip": "10.0.0.2"}])
    alert = one(ops.detect_doh_evasion(events))
    assert alert.domain == "cloudflare-dns.com;dns.google;opendns.com"
    assert (alert.severity_score, alert.severity_label) == (55.0, "Medium")
    assert json.loads(alert.evidence) == {
        "providers": ["cloudflare-dns.com", "dns.google", "opendns.com"], "n_queries": 4}
    table = spark.createDataFrame([("dns.google",)], "query_name string")
    assert one(ops.detect_doh_evasion(events, providers=table)).domain == "dns.google"


@pytest.mark.parametrize("detect", [
    ops.detect_dga, ops.detect_tunneling, ops.detect_beaconing, ops.detect_nxdomain_spike,
    ops.detect_typosquatting, ops.detect_fast_flux, ops.detect_newly_registered_domain,
    ops.detect_doh_evasion])
def test_empty_events_give_no_alerts(spark, detect):
    from nametrail.sources import empty_events

    alerts = detect(empty_events(spark))
    assert alerts.columns == UNNUMBERED and alerts.count() == 0
