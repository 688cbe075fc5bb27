from datetime import datetime, timedelta

import pytest

from nametrail.plans import (
    compute_host_risk,
    evaluate_against_ground_truth,
    generate_executive_summary,
    host_alert_timeline,
    host_tactic_summary,
)
from nametrail.plans import analytics as an
from nametrail.plans import risk
from nametrail.schema import ALERT_SCHEMA, HOST_RISK_COLUMNS, RECALL_COLUMNS

START = datetime(2026, 8, 18, 9, 0, 0)
TECHNIQUE = {"dga": "T1568.002", "tunneling": "T1071.004", "beaconing": "T1071.004",
             "nxdomain_spike": "T1590.002", "typosquat": "T1583.001"}
ROWS = [  # detector, score, hosts, domain, seconds
    ("dga", 96.0, "10.0.0.1;10.0.0.2", "qzxv.com", 50),
    ("tunneling", 70.0, "10.0.0.1", "evil.net", 10),
    ("tunneling", 60.0, "10.0.0.1", "evil2.net", 40),
    ("beaconing", 66.5, "10.0.0.3", "a.b.co.uk", 20),
    ("nxdomain_spike", 62.0, "10.0.0.1", "n1.x.com;n2.y.org", 30),
    ("other", 12.0, " 10.0.0.4 ;", "solo", 60),
]


@pytest.fixture(scope="module")
def alerts(spark):
    from nametrail.functions.scoring import SEVERITY_LABEL

    rows = [(f"ALT-{i:04d}", START + timedelta(seconds=s), d, score, "", hosts, domain,
             f"reason {i}", TECHNIQUE.get(d, "T0"), "", "{}")
            for i, (d, score, hosts, domain, s) in enumerate(ROWS, 1)]
    df = spark.createDataFrame(rows, ALERT_SCHEMA)
    from pyspark.sql import functions as F
    return df.withColumn("severity_label", F.expr(SEVERITY_LABEL.format(x="severity_score"))).cache()


@pytest.fixture(scope="module")
def events(make_events):
    return make_events([
        {"src_ip": "10.0.0.1", "query_name": "a.evil.net", "ground_truth_label": "tunneling"},
        {"src_ip": "10.0.0.1", "query_name": "b.evil.net", "ground_truth_label": "tunneling",
         "timestamp": 3700},
        {"src_ip": "10.0.0.9", "query_name": "evil.net", "ground_truth_label": "tunneling"},
        {"src_ip": "10.0.0.3", "query_name": "z.b.co.uk", "ground_truth_label": "beaconing"},
        {"src_ip": "10.0.0.1", "query_name": "zzz.org", "ground_truth_label": "nxdomain_flood",
         "response_code": "NXDOMAIN"},
        {"src_ip": "10.0.0.2", "query_name": "x.com", "ground_truth_label": "benign"},
        {"src_ip": "10.0.0.5", "query_name": "x.com", "ground_truth_label": "benign"},
        {"src_ip": "10.0.0.5", "query_name": "y.org"},
    ]).cache()


def test_host_risk(alerts):
    table = compute_host_risk(alerts)
    assert table.columns == HOST_RISK_COLUMNS
    rows = table.collect()
    assert [r.src_ip for r in rows] == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4"]
    first = rows[0]
    assert (first.risk_score, first.risk_label) == (100.0, "Critical")
    assert (first.n_alerts, first.n_detectors) == (4, 3)
    assert first.detectors == "dga, nxdomain_spike, tunneling"
    assert (first.top_detector, first.top_reason) == ("dga", "reason 1")
    assert (rows[1].risk_score, rows[2].risk_score) == (96.0, 66.5)


def test_bonus_per_detector(alerts):
    two = alerts.where("detector in ('tunneling', 'nxdomain_spike')")
    row = compute_host_risk(two).first()
    assert row.risk_score == 78.0 and row.risk_label == "High"


def test_tactics_timeline_and_kill_chain(alerts):
    rows = host_tactic_summary(alerts, "10.0.0.1").collect()
    assert [(r.tactic, r.n_alerts, r.max_severity, r.detectors) for r in rows] == [
        ("Reconnaissance", 1, 62.0, "nxdomain_spike"),
        ("Command and Control", 3, 96.0, "dga, tunneling")]
    assert host_tactic_summary(alerts, "10.0.0").count() == 0
    assert risk.all_host_tactics(alerts).where("src_ip = '10.0.0.4'").first().tactic == "Other"
    order = [r.alert_id for r in host_alert_timeline(alerts, "10.0.0.1").collect()]
    assert order == ["ALT-0002", "ALT-0005", "ALT-0003", "ALT-0001"]
    chain = risk.kill_chain(alerts, "10.0.0.1").collect()
    assert [(c.tactic, c.severity_label) for c in chain] == [
        ("Reconnaissance", "Medium"), ("Resource Development", None),
        ("Command and Control", "Critical")]


def test_summary(spark, events, alerts):
    m = risk.summary_metrics(events, alerts).first()
    assert (m.n_events, m.n_hosts, m.n_alerts, m.n_detectors_fired) == (8, 5, 6, 5)
    assert (m.n_flagged_hosts, m.n_critical_hosts, m.n_multi_detector_hosts) == (4, 2, 1)
    text = generate_executive_summary(events, alerts)
    assert "8 DNS queries" in text and "10.0.0.1 (3 detector(s)" in text
    quiet = generate_executive_summary(events, alerts.limit(0))
    assert "No detector" in quiet
    calm = generate_executive_summary(events, alerts.where("severity_score < 65"))
    assert "No host is at Critical risk" in calm


def test_recall(events, alerts):
    result = evaluate_against_ground_truth(events, alerts)
    assert result.per_scenario.columns == RECALL_COLUMNS
    rows = {r.scenario: r for r in result.per_scenario.collect()}
    assert list(rows) == ["tunneling", "beaconing", "nxdomain_flood"]
    assert (rows["tunneling"].ground_truth_total, rows["tunneling"].caught,
            rows["tunneling"].recall) == (2, 1, 0.5)
    assert rows["beaconing"].recall == 1.0
    flood = rows["nxdomain_flood"]
    assert (flood.unit, flood.detector, flood.recall) == ("hosts", "nxdomain_spike", 1.0)


def test_false_positives(events, alerts):
    result = evaluate_against_ground_truth(events, alerts)
    assert [r.src_ip for r in result.false_positive_hosts.collect()] == ["10.0.0.2"]
    row = result.fp_summary.first()
    assert (row.benign_hosts_total, row.false_positive_hosts, row.false_positive_rate) == (2, 1, 0.5)


def test_without_labels(events, alerts):
    assert evaluate_against_ground_truth(events.drop("ground_truth_label"), alerts) is None
    assert an.evaluation_report(events.drop("ground_truth_label"), alerts) is None
    from pyspark.sql import functions as F
    assert evaluate_against_ground_truth(
        events.withColumn("ground_truth_label", F.lit(None).cast("string")), alerts) is None


def test_traffic_tables(events, alerts):
    k = an.kpis(events, alerts).first()
    assert (k.total_queries, k.unique_hosts, k.unique_domains, k.alerts_raised) == (8, 5, 5, 6)
    series = an.traffic_series(events).collect()
    assert [r.n_queries for r in series] == [7, 0, 0, 0, 1]
    assert an.traffic_series(events.limit(0)).count() == 0
    assert [(r.src_ip, r.n) for r in an.top_talkers(events, 2).collect()] == [
        ("10.0.0.1", 3), ("10.0.0.5", 2)]
    assert an.top_domains(events, 1).first().registrable_domain == "evil.net"
    assert {r.response_code: r.n for r in an.response_codes(events).collect()} == {
        "NOERROR": 7, "NXDOMAIN": 1}
    assert an.alerts_by_detector(alerts).first().detector == "tunneling"


def test_alert_search(alerts):
    def ids(df):
        return sorted(r.alert_id for r in df.collect())

    assert ids(an.alert_search(alerts, term="EVIL\\d")) == ["ALT-0003"]
    assert ids(an.alert_search(alerts, term="10.0.0.2")) == ["ALT-0001"]
    assert ids(an.alert_search(alerts, term="evil.", literal=True)) == ["ALT-0002"]
    assert ids(an.alert_search(alerts, ["High"], ["beaconing"])) == ["ALT-0004"]
    assert an.alert_search(alerts, severities=[]).count() == 0
    with pytest.raises(Exception):
        an.alert_search(alerts, term="(")


def test_alert_tables(alerts):
    labels = [r.severity_label for r in an.alert_table(alerts).collect()]
    assert labels == ["Critical", "High", "High", "Medium", "Medium", "Low"]
    assert "evidence" not in an.alert_preview(alerts, 2).columns
    assert an.alert_preview(alerts, 2).count() == 2
    assert [r.alert_id for r in an.top_critical_alerts(alerts).collect()] == ["ALT-0001"]
    status = an.critical_status(alerts).first()
    assert (status.critical_alerts, status.any_critical_host) == (1, True)
    calm = an.critical_status(alerts.limit(0)).first()
    assert (calm.critical_alerts, calm.any_critical_host) == (0, False)
    assert [r.detector for r in an.detector_options(alerts).collect()][0] == "beaconing"
    hosts = an.host_options(compute_host_risk(alerts)).collect()
    assert hosts[0].src_ip == "10.0.0.1"
    assert an.risk_leaderboard(compute_host_risk(alerts), 2).count() == 2


def test_domain_drilldown(events, alerts):
    options = [r.registrable_domain for r in an.domain_options(events).collect()]
    assert options == ["b.co.uk", "evil.net", "x.com", "y.org", "zzz.org"]
    flagged = [r.registrable_domain for r in an.domain_options(events, alerts).collect()]
    assert flagged == ["b.co.uk", "evil.net", "x.com", "y.org"]
    assert [r.alert_id for r in an.domain_alerts(alerts, "x.com").collect()] == ["ALT-0005"]
    assert an.domain_alerts(alerts, "x.com", exact=True).count() == 0
    assert an.domain_alerts(alerts, "n1.x.com", exact=True).count() == 1
    row = an.domain_metrics(events, alerts, "evil.net").first()
    assert (row.total_queries, row.unique_hosts, row.nxdomain_rate, row.n_detectors) == (3, 2, 0, 1)
    empty = an.domain_metrics(events, alerts, "none.com").first()
    assert (empty.total_queries, empty.nxdomain_rate, empty.n_detectors) == (0, 0.0, 0)
    times = [r.timestamp for r in an.domain_history(events, "evil.net").collect()]
    assert times == sorted(times) and len(times) == 3
    assert an.default_domain(events, alerts).first()[0] == "b.co.uk"
    top = alerts.where("detector = 'tunneling'")
    assert an.default_domain(events, top).first()[0] == "evil.net"
    assert an.default_domain(events, alerts.limit(0)).first()[0] == "b.co.uk"


def test_reports(spark, events, alerts):
    report = an.detector_report(events, alerts)
    assert report["counts"].first().asDict() == {"n_events": 8, "n_alerts": 6}
    parts = an.host_drilldown(alerts, "10.0.0.3")
    assert parts["risk"].first().risk_label == "High" and parts["timeline"].count() == 1
    assert an.evaluation_report(events, alerts)["false_positives"].count() == 1
    reference = an.technique_reference(spark).collect()
    assert reference[0].tactic == "Reconnaissance" and len(reference) == 5


def test_all_hosts_of_an_alert_count(make_events):
    from nametrail.operators import detect_newly_registered_domain, detect_typosquatting
    from nametrail.plans import alert_hosts, number_alerts
    from nametrail.plans.risk import all_host_tactics, compute_host_risk, kill_chain

    rows = [{"query_name": "paypa1.com", "src_ip": f"10.0.0.{i}"} for i in range(30)]
    rows += [{"query_name": "young.org", "src_ip": f"10.0.1.{i}",
              "first_registered_days_ago": 0.0 if i < 20 else None} for i in range(25)] * 2
    events = make_events(rows)
    alerts = number_alerts(detect_typosquatting(events).unionByName(
        detect_newly_registered_domain(events)))
    hosts = alert_hosts(alerts, events)
    assert hosts.count() == 50 and hosts.distinct().count() == 50
    assert compute_host_risk(alerts).count() == 10
    assert compute_host_risk(alerts, hosts).count() == 50
    assert all_host_tactics(alerts, hosts).select("src_ip").distinct().count() == 50
    assert kill_chain(alerts, hosts=hosts).select("src_ip").distinct().count() == 50
    assert kill_chain(alerts, "10.0.0.29", hosts).where("max_severity is not null").count() == 1


def test_traffic_over_eight_thousand_years(make_events):
    from datetime import datetime

    events = make_events([{"timestamp": datetime(1970, 1, 1)}, {"timestamp": datetime(9999, 12, 31)}])
    days = an.traffic_series(events, "1 day")
    assert days.count() == 2_932_897
    assert [r.n_queries for r in days.where("n_queries > 0").collect()] == [1, 1]
