"""

The driver's tables hold no DNS log, so every query runs on a DNS-shaped view of
``events`` joined to ``pages`` (see ``FIXTURES.md`` section 7). The detectors run
with parameters that give alerts on that view.
"""

from __future__ import annotations

import importlib
import importlib.util
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from nametrail import operators as ops
from nametrail.constants import MULTI_PART_TLDS, VOCABULARY
from nametrail.functions import text
from nametrail.operators.skew import HEAVY_MIN_ROWS
from nametrail.plans import analytics, evaluation, pipeline, risk, sketches
from nametrail.plans.evidence import evidence_facts
from nametrail.plans.lineage import shared_folder
from nametrail.sources import export_alerts_csv, load_log, write_events
from nametrail.sources.bind import parse_bind_lines
from nametrail.sources.normalize import normalize_events
from nametrail.sources.zeek import ZeekHeader, parse_zeek_lines

Query = Callable[[SparkSession, str], DataFrame]

BRANDS = ["ththhe.com", "thther.org", "tionsh.net"]
PROVIDERS = ["blog.theran.com", "www.tionble.com"]
DGA_SCORE = 30.0
TUNNEL = {"min_queries": 8, "score_threshold": 22.0}
BEACON = {"min_queries": 6, "cv_threshold": 1.0, "score_threshold": 20.0}
BURST = {"window_minutes": 1440.0, "count_threshold": 4, "min_total": 4}
PARAMS = {
    "dga": {"score_threshold": DGA_SCORE},
    "tunneling": TUNNEL,
    "beaconing": BEACON,
    "nxdomain_spike": BURST,
    "typosquat": {"brands": BRANDS},
    "doh_evasion": {"providers": PROVIDERS},
}
HOST = "10.0.0.46"
DOMAIN = "ththhe.com"
SEARCH = {"severities": ["Critical", "High"], "term": "^th.*[.](com|org)$"}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per event: user -> host, page of the event -> queried name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n_pages = pages.agg(F.count("*")).scalar()
    host = F.regexp_extract(F.lower("url"), "^https?://([^/:?#]+)", 1)
    names = pages.select(
        "page_id", F.regexp_replace(host, "[.]example[.]", ".").alias("query_name"))
    page, user, kind = F.col("page_id"), F.col("user_id"), F.col("event_type")
    return (
        events.withColumn("page_id", F.col("event_id") % n_pages)
        .join(names, "page_id")
        .select(
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("10.0."), F.floor(user / 256), F.lit("."), user % 256).alias("src_ip"),
            "query_name",
            F.when(kind == "signup", "TXT").when(kind == "purchase", "NULL").otherwise("A")
            .alias("query_type"),
            F.when(kind == "error", "NXDOMAIN").otherwise("NOERROR").alias("response_code"),
            F.when(kind == "error", "").otherwise(F.concat(
                F.lit("203.0.113."), F.regexp_extract("props", '"k": *([0-9]+)', 1)))
            .alias("response_ip"),
            F.floor(F.col("value") * 10).alias("ttl"),
            F.when(page % 3 != 0, page % 30).cast("double").alias("first_registered_days_ago"),
            F.when(user % 4 == 0, "benign").when(page % 5 == 0, "dga")
            .when(page % 5 == 1, "tunneling").when(page % 5 == 2, "fast_flux")
            .otherwise("benign").alias("ground_truth_label"),
        ))


def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(_raw(spark, sf_dir))


_ALERT_TABLES: dict[tuple[str, str], DataFrame] = {}


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table of a log; written once per application, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ALERT_TABLES:
        _ALERT_TABLES[key] = pipeline.run_all_detectors(dns_events(spark, sf_dir), PARAMS)
    return _ALERT_TABLES[key]


def _us(column: str) -> Column:
    return F.unix_micros(column)


def _long(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def _three(column: str) -> Column:
    return F.round(F.col(column), 3).alias(column)


def _six(column: str) -> Column:
    return F.round(F.col(column).cast("double"), 6).alias(column)


# -- queries -----------------------------------------------------------------

def normalize_domains(spark, sf_dir):
    return dns_events(spark, sf_dir).select(
        _us("timestamp").alias("us"), "src_ip", "query_name", "query_type", "response_code",
        "response_ip", "ttl", "query_size_bytes", "first_registered_days_ago",
        "ground_truth_label", "registrable_domain", "subdomain",
        _long("subdomain_label_count"), _long("subdomain_len"))


def _labels(spark, sf_dir):
    """Distinct labels of all names, and the names themselves with their dots."""
    names = dns_events(spark, sf_dir).groupBy("query_name").agg(F.count("*").alias("n_queries"))
    return names.withColumn("label", text.second_level_label("query_name"))


def label_entropy(spark, sf_dir):
    return _labels(spark, sf_dir).select(
        "query_name", "n_queries",
        F.round(text.shannon_entropy("query_name"), 6).alias("name_entropy"),
        F.round(text.shannon_entropy("label"), 6).alias("label_entropy"))


def rare_bigrams(spark, sf_dir):
    return _labels(spark, sf_dir).select(
        "query_name", "n_queries",
        F.round(text.rare_bigram_ratio("query_name"), 6).alias("rare_ratio"),
        F.round(text.digit_ratio("query_name"), 6).alias("digit_ratio"))


def levenshtein_pairs(spark, sf_dir):
    names = dns_events(spark, sf_dir).select("query_name", "registrable_domain").distinct()
    return names.select(
        "query_name", "registrable_domain",
        text.levenshtein("query_name", "registrable_domain").cast("bigint").alias("distance"),
        text.levenshtein("query_name", "registrable_domain", 4).cast("bigint")
        .alias("distance_up_to_4"))


def sql_functions(spark, sf_dir):
    text.register_sql_functions(spark)
    dns_events(spark, sf_dir).select("query_name").distinct().createOrReplaceTempView("dns_names")
    return spark.sql("""
        SELECT query_name, registrable_domain(query_name) AS domain,
               subdomain(query_name) AS sub,
               CAST(size(split_domain_labels(query_name)) AS BIGINT) AS n_labels,
               round(shannon_entropy(query_name), 6) AS entropy,
               round(rare_bigram_ratio(query_name), 6) AS rare_ratio,
               round(digit_ratio(query_name), 6) AS digit_ratio,
               severity_label(shannon_entropy(query_name) * 25) AS severity
        FROM dns_names""")


def dga_features(spark, sf_dir):
    return ops.dga_features(dns_events(spark, sf_dir)).select(
        "registrable_domain", "label", _long("n_queries"), _us("last_seen").alias("last_us"),
        _six("nxdomain_ratio"), _six("entropy"), _six("rare_ratio"), _six("digit_ratio"),
        _six("score"))


def tunneling_features(spark, sf_dir):
    return ops.tunneling_features(dns_events(spark, sf_dir), TUNNEL["min_queries"]).select(
        "src_ip", "registrable_domain", _long("n_queries"), _us("last_seen").alias("last_us"),
        _six("duration_min"), _six("rate"), _six("avg_len"), _six("txt_null_ratio"),
        _six("unique_ratio"), _six("avg_entropy"), _six("score"))


def _beaconing(spark, sf_dir, **skew):
    return ops.beaconing_features(
        dns_events(spark, sf_dir), BEACON["min_queries"], BEACON["cv_threshold"], **skew,
    ).select(
        "src_ip", "query_name", _long("n_queries"), _us("last_seen").alias("last_us"),
        _three("mean_interval_sec"), _three("std_interval_sec"),
        _six("coefficient_of_variation"),
        _six("score"))


def beaconing_features(spark, sf_dir):
    return _beaconing(spark, sf_dir)


def beaconing_heavy_pairs(spark, sf_dir):
    """The same features with the busiest pairs cut into slices of a day."""
    return _beaconing(spark, sf_dir, heavy_min_rows=7, slice_us=86_400_000_000)


def _burst(spark, sf_dir, heavy_min_rows=HEAVY_MIN_ROWS, slice_us=60_000_000):
    hosts = ops.nxdomain_features(
        dns_events(spark, sf_dir), **BURST, heavy_min_rows=heavy_min_rows, slice_us=slice_us)
    return hosts.select(
        "src_ip", _long("max_nxdomain_in_window"), _long("total_nxdomain_events"),
        _long("host_total"), _six("host_nxdomain_ratio"), _long("end_us"),
        F.array_join("names", ";").alias("names"), _six("score"))


def nxdomain_burst(spark, sf_dir):
    return _burst(spark, sf_dir)


def nxdomain_burst_heavy_hosts(spark, sf_dir):
    """The same bursts with the busiest hosts cut into slices of an hour."""
    return _burst(spark, sf_dir, heavy_min_rows=7, slice_us=3_600_000_000)


def _typosquat(features):
    return features.select(
        "registrable_domain", _long("edit_distance"), "matched_brand", _long("n_queries"),
        _us("last_seen").alias("last_us"), _six("score"))


def typosquat(spark, sf_dir):
    return _typosquat(ops.typosquat_features(dns_events(spark, sf_dir), brands=BRANDS))


def typosquat_brand_table(spark, sf_dir):
    """Every domain of even length as a brand: the equi-join path."""
    events = dns_events(spark, sf_dir)
    names = events.where(F.length("registrable_domain") % 2 == 0).select(
        F.col("registrable_domain").alias("brand")).distinct()
    brands = names.withColumn("pos", F.xxhash64("brand"))
    near = ops.typosquat_features(events, brands=brands)
    return near.select(
        "registrable_domain", _long("edit_distance"), _long("n_queries"), _six("score"))


def fast_flux(spark, sf_dir):
    return ops.fast_flux_features(dns_events(spark, sf_dir)).select(
        "registrable_domain", _long("distinct_ips"), _long("n_resolved"), _six("ip_ratio"),
        _six("avg_ttl"), _us("last_seen").alias("last_us"), _six("score"))


def newly_registered(spark, sf_dir):
    return ops.newly_registered_features(dns_events(spark, sf_dir)).select(
        "registrable_domain", _six("age_days"), _long("n_queries"),
        _us("last_seen").alias("last_us"), _six("score"))


def doh_hosts(spark, sf_dir):
    return ops.doh_features(dns_events(spark, sf_dir), PROVIDERS).select(
        "src_ip", F.array_join("providers", ";").alias("providers"), _long("n_queries"),
        _us("last_seen").alias("last_us"))


def host_lists(spark, sf_dir):
    return ops.bounded_hosts(ops.pair_rollup(dns_events(spark, sf_dir)))


def _alert_columns(alerts):
    return alerts.select(
        "alert_id", _us("timestamp").alias("us"), "detector", "severity_score",
        "severity_label", "src_ip", "domain", "mitre_id", "mitre_name")


def alerts_union(spark, sf_dir):
    return _alert_columns(pipeline.run_all_detectors(dns_events(spark, sf_dir), PARAMS))


def host_risk(spark, sf_dir):
    return risk.compute_host_risk(alert_table(spark, sf_dir)).select(
        "src_ip", "risk_score", "risk_label", _long("n_alerts"), _long("n_detectors"),
        "detectors", "top_detector")


def risk_leaderboard(spark, sf_dir):
    return analytics.risk_leaderboard(risk.compute_host_risk(alert_table(spark, sf_dir))).select(
        "src_ip", "risk_score", "risk_label", _long("n_alerts"), _long("n_detectors"),
        "detectors", "top_detector")


def tactic_summary(spark, sf_dir):
    return risk.all_host_tactics(alert_table(spark, sf_dir)).select(
        "src_ip", "tactic", _long("n_alerts"), "max_severity", "detectors")


def host_tactics(spark, sf_dir):
    return risk.host_tactic_summary(alert_table(spark, sf_dir), HOST).select(
        "tactic", _long("n_alerts"), "max_severity", "detectors")


def timeline(spark, sf_dir):
    return risk.host_alert_timeline(alert_table(spark, sf_dir), HOST).select(
        _us("timestamp").alias("us"), "detector", "severity_score", "severity_label", "src_ip",
        "domain", "mitre_id")


def kill_chain(spark, sf_dir):
    return risk.kill_chain(alert_table(spark, sf_dir)).select(
        "src_ip", _long("position"), "tactic", "max_severity", "severity_label")


def summary_metrics(spark, sf_dir):
    metrics = risk.summary_metrics(dns_events(spark, sf_dir), alert_table(spark, sf_dir))
    return metrics.select(*[_long(c) for c in metrics.columns])


def recall_by_scenario(spark, sf_dir):
    return evaluation.recall_by_scenario(
        dns_events(spark, sf_dir), alert_table(spark, sf_dir)).select(
        "scenario", "detector", "unit", _long("ground_truth_total"), _long("caught"), "recall")


def false_positives(spark, sf_dir):
    return evaluation.false_positive_summary(
        dns_events(spark, sf_dir), alert_table(spark, sf_dir)).select(
        _long("benign_hosts_total"), _long("false_positive_hosts"), "false_positive_rate")


def false_positive_hosts(spark, sf_dir):
    return evaluation.false_positive_hosts(dns_events(spark, sf_dir), alert_table(spark, sf_dir))


def all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host of every alert, by the rollup of the log."""
    return risk.alert_hosts(alert_table(spark, sf_dir), dns_events(spark, sf_dir))


def alert_hosts(spark, sf_dir):
    return all_hosts(spark, sf_dir).select("alert_id", "src_ip")


def host_risk_all_hosts(spark, sf_dir):
    return risk.compute_host_risk(alert_table(spark, sf_dir), all_hosts(spark, sf_dir)).select(
        "src_ip", "risk_score", "risk_label", _long("n_alerts"), _long("n_detectors"),
        "detectors", "top_detector")


def tactic_summary_all_hosts(spark, sf_dir):
    return risk.all_host_tactics(alert_table(spark, sf_dir), all_hosts(spark, sf_dir)).select(
        "src_ip", "tactic", _long("n_alerts"), "max_severity", "detectors")


def host_tactics_all_hosts(spark, sf_dir):
    return risk.host_tactic_summary(
        alert_table(spark, sf_dir), HOST, all_hosts(spark, sf_dir)).select(
        "tactic", _long("n_alerts"), "max_severity", "detectors")


def timeline_all_hosts(spark, sf_dir):
    return risk.host_alert_timeline(
        alert_table(spark, sf_dir), HOST, all_hosts(spark, sf_dir)).select(
        _us("timestamp").alias("us"), "detector", "severity_score", "severity_label", "src_ip",
        "domain", "mitre_id")


def kill_chain_all_hosts(spark, sf_dir):
    return risk.kill_chain(alert_table(spark, sf_dir), hosts=all_hosts(spark, sf_dir)).select(
        "src_ip", _long("position"), "tactic", "max_severity", "severity_label")


def recall_all_hosts(spark, sf_dir):
    return evaluation.recall_by_scenario(
        dns_events(spark, sf_dir), alert_table(spark, sf_dir), all_hosts(spark, sf_dir)).select(
        "scenario", "detector", "unit", _long("ground_truth_total"), _long("caught"), "recall")


def false_positives_all_hosts(spark, sf_dir):
    return evaluation.false_positive_summary(
        dns_events(spark, sf_dir), alert_table(spark, sf_dir), all_hosts(spark, sf_dir)).select(
        _long("benign_hosts_total"), _long("false_positive_hosts"), "false_positive_rate")


def typosquat_cut_brands(spark, sf_dir):
    """Every domain without its first character as a brand, ties by the brand's text."""
    events = dns_events(spark, sf_dir)
    brands = events.select(F.expr("substring(registrable_domain, 2)").alias("brand")).distinct()
    near = ops.typosquat_features(events, brands=brands.withColumn("pos", F.col("brand")))
    return _typosquat(near)


def timestamp_layouts(spark, sf_dir):
    """The events' times as text in six layouts and zones, one of them unreadable, and back."""
    local = F.col("timestamp").cast("timestamp_ntz")
    n = F.col("user_id") % 6
    raw = _raw(spark, sf_dir).withColumn("user_id", F.expr(
        "cast(split(src_ip, '[.]')[2] as bigint) * 256 + cast(split(src_ip, '[.]')[3] as bigint)"))
    text = (
        F.when(n == 0, F.date_format(local, "MM/dd/yyyy HH:mm:ss"))
        .when(n == 1, F.date_format(local, "yyyy/MM/dd HH:mm:ss"))
        .when(n == 2, F.date_format(local, "yyyyMMdd HH:mm:ss"))
        .when(n == 3, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(n == 4, F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("no time")))
    return normalize_events(raw.withColumn("timestamp", text)).groupBy("src_ip", "query_name").agg(
        F.count("*").alias("n"), F.min(_us("timestamp")).alias("first_us"),
        F.max(_us("timestamp")).alias("last_us"))


def alert_list(spark, sf_dir):
    """The alert table in its order, which the position proves."""
    return analytics.alert_positions(alert_table(spark, sf_dir)).select(
        "alert_id", "severity_label", "detector", "src_ip", "domain", "mitre_id", "position")


def alert_preview(spark, sf_dir):
    return analytics.alert_preview(alert_table(spark, sf_dir)).select(
        "alert_id", _us("timestamp").alias("us"), "detector", "severity_score", "severity_label",
        "src_ip", "domain", "mitre_id")


def kpis(spark, sf_dir):
    row = analytics.kpis(dns_events(spark, sf_dir), alert_table(spark, sf_dir))
    return row.select(*[_long(c) for c in row.columns])


def traffic_15min(spark, sf_dir):
    return analytics.traffic_series(dns_events(spark, sf_dir)).select(
        _us("bucket_start").alias("bucket_us"), _long("n_queries"))


def top_talkers(spark, sf_dir):
    return analytics.top_talkers(dns_events(spark, sf_dir)).select("src_ip", _long("n"))


def top_domains(spark, sf_dir):
    return analytics.top_domains(dns_events(spark, sf_dir)).select("registrable_domain", _long("n"))


def response_codes(spark, sf_dir):
    return analytics.response_codes(dns_events(spark, sf_dir)).select("response_code", _long("n"))


def alerts_by_detector(spark, sf_dir):
    return analytics.alerts_by_detector(alert_table(spark, sf_dir)).select("detector", _long("n"))


def alert_search(spark, sf_dir):
    return analytics.alert_search(alert_table(spark, sf_dir), **SEARCH).select(
        _us("timestamp").alias("us"), "detector", "severity_score", "severity_label", "src_ip",
        "domain")


def critical_status(spark, sf_dir):
    return analytics.critical_status(alert_table(spark, sf_dir)).select(
        _long("critical_alerts"), "any_critical_host")


def top_critical_alerts(spark, sf_dir):
    return analytics.top_critical_alerts(alert_table(spark, sf_dir)).select(
        "detector", "severity_score", "domain", "src_ip")


def domain_detail(spark, sf_dir):
    return analytics.domain_metrics(dns_events(spark, sf_dir), alert_table(spark, sf_dir), DOMAIN
                                    ).select(
        _long("total_queries"), _long("unique_hosts"), _six("nxdomain_rate"),
        _long("n_detectors"))


def domain_alerts(spark, sf_dir):
    return analytics.domain_alerts(alert_table(spark, sf_dir), DOMAIN).select(
        "detector", "severity_score", "src_ip", "domain")


def domain_history(spark, sf_dir):
    return analytics.domain_history(dns_events(spark, sf_dir), DOMAIN).select(
        _us("timestamp").alias("us"), "src_ip", "query_type", "response_code", "response_ip",
        "ttl")


def flagged_domains(spark, sf_dir):
    return analytics.domain_options(dns_events(spark, sf_dir), alert_table(spark, sf_dir))


def default_domain(spark, sf_dir):
    return analytics.default_domain(dns_events(spark, sf_dir), alert_table(spark, sf_dir))


def bind_lines(spark, sf_dir):
    """The events written as BIND log lines and read back."""
    return _parsed(normalize_events(parse_bind_lines(_bind_text(spark, sf_dir))))


def _bind_text(spark, sf_dir):
    stamp = F.date_format("timestamp", "dd-MMM-yyyy HH:mm:ss.SSS")
    failed = F.col("response_code") == "NXDOMAIN"
    return dns_events(spark, sf_dir).select(F.when(failed, F.format_string(
        "%s query-errors: info: client @0x7f %s#53 (%s): view main: query failed (NXDOMAIN) "
        "for %s/IN/%s at query.c:1", stamp, "src_ip", "query_name", "query_name", "query_type"),
    ).otherwise(F.format_string(
        "%s queries: info: client %s#53 (%s): query: %s IN %s + (10.0.0.1)",
        stamp, "src_ip", "query_name", "query_name", "query_type")).alias("value"))


def _parsed(events):
    return events.select(
        _us("timestamp").alias("us"), "src_ip", "query_name", "query_type", "response_code",
        "response_ip", "ttl", "query_size_bytes", "registrable_domain")


ZEEK_FIELDS = ("ts", "uid", "id.orig_h", "query", "qtype_name", "rcode_name", "answers", "TTLs")


def _zeek_cells(spark, sf_dir):
    answer = F.when(F.col("response_ip") == "", "-").otherwise(
        F.concat(F.lit("alias.example,"), "response_ip"))
    lifetimes = F.concat(F.col("ttl").cast("string"), F.lit(".0,5.0"))
    us = F.unix_micros("timestamp")
    seconds = F.concat_ws(".", F.floor(us / 1_000_000).cast("string"),
                          F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    cells = (seconds, F.lit("C1"), F.col("src_ip"), F.col("query_name"), F.col("query_type"),
             F.lower("response_code"), answer, lifetimes)
    return dns_events(spark, sf_dir).select(*(c.alias(f) for c, f in zip(cells, ZEEK_FIELDS)))


def zeek_lines(spark, sf_dir):
    """The events written as Zeek rows and read back."""
    cells = _zeek_cells(spark, sf_dir)
    lines = cells.select(F.concat_ws("\t", *(f"`{f}`" for f in ZEEK_FIELDS)).alias("value"))
    return _parsed(normalize_events(parse_zeek_lines(lines, ZeekHeader(ZEEK_FIELDS))))


#: Files of each kind that the Zeek round trip writes.
N_FILES = 4


def _log_folder(spark):
    return f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"


def csv_files(spark, sf_dir):
    """The events written to CSV files and loaded from them, the format found by a look at it."""
    folder = _log_folder(spark)
    write_events(dns_events(spark, sf_dir), folder, "csv")
    return load_log(spark, folder).select(
        _us("timestamp").alias("us"), "src_ip", "query_name", "query_type", "response_code",
        "response_ip", "ttl", "query_size_bytes", "first_registered_days_ago",
        "ground_truth_label", "registrable_domain", "subdomain", _long("subdomain_label_count"),
        _long("subdomain_len"))


def bind_files(spark, sf_dir):
    """The same with BIND log files."""
    folder = _log_folder(spark)
    _bind_text(spark, sf_dir).write.text(folder)
    return _parsed(load_log(spark, folder))


def zeek_files(spark, sf_dir):
    """The same with Zeek files of two kinds: the second has other fields in another order."""
    folder = _log_folder(spark)
    cells = _zeek_cells(spark, sf_dir)
    other = ["query", "ts", "answers", "qtype_name", "id.orig_h", "rcode_name", "TTLs"]
    even = F.crc32("`query`") % 2 == 0
    for mode, part, fields in (("error", cells.where(even), list(ZEEK_FIELDS)),
                               ("append", cells.where(~even), other)):
        lines = part.select(F.pmod(F.xxhash64("`query`", "ts"), F.lit(N_FILES)).alias("file"),
                            F.concat_ws("\t", *(f"`{f}`" for f in fields)).alias("value"))
        heads = spark.range(N_FILES).select(
            F.col("id").alias("file"), F.lit("\t".join(["#fields", *fields])).alias("value"))
        head_first = [F.col("file"), F.desc(F.col("value").startswith("#"))]
        (lines.unionByName(heads).repartition(N_FILES, "file").sortWithinPartitions(*head_first)
         .select("value").write.mode(mode).text(folder))
    return _parsed(load_log(spark, folder))


def alert_files(spark, sf_dir):
    """The alert table exported as CSV and read back."""
    folder = _log_folder(spark)
    export_alerts_csv(alert_table(spark, sf_dir), folder)
    read = spark.read.options(header=True, escape='"').csv(folder)
    assert "evidence" not in read.columns
    return _alert_columns(read.withColumns({
        "timestamp": F.col("timestamp").cast("timestamp"),
        "severity_score": F.col("severity_score").cast("double")}))


def alert_evidence(spark, sf_dir):
    """Every fact of every alert's evidence, all detectors."""
    return evidence_facts(alert_table(spark, sf_dir)).select(
        "detector", "domain", "src_ip", "name", "number", "text")


def _stored_state(spark, sf_dir):
    """The events' days as stored state; every third event arrives later."""
    folder = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    events = dns_events(spark, sf_dir)
    late = F.crc32(F.col("timestamp").cast("string")) % 3 == 0
    for part in (events.where(~late), events.where(late)):
        sketches.append_state(sketches.day_state(part), folder)
    return events, sketches.read_state(spark, folder)


def _close(approx, exact):
    """Within four standard errors, or one host."""
    bound = F.greatest(F.lit(1.0), 4 * sketches.standard_error() * F.col(exact))
    return (F.abs(F.col(approx) - F.col(exact)) <= bound).alias("hosts_close")


def kpi_sketches(spark, sf_dir):
    """KPIs from stored days; the sketch's number of hosts beside the exact one."""
    events, state = _stored_state(spark, sf_dir)
    exact = events.agg(F.count_distinct("src_ip").alias("unique_hosts"))
    row = risk.one_row([sketches.state_kpis(state), exact])
    return row.select(_long("total_queries"), _long("unique_domains"), _long("unique_hosts"),
                      _close("approx_hosts", "unique_hosts"))


def domain_sketches(spark, sf_dir):
    """The same per domain."""
    events, state = _stored_state(spark, sf_dir)
    exact = ops.pair_rollup(events).groupBy("registrable_domain").agg(
        F.count("*").alias("unique_hosts"))
    return sketches.domain_reach(state).join(exact, "registrable_domain").select(
        "registrable_domain", _long("n_queries"), _long("n_nx"), _long("unique_hosts"),
        _close("approx_hosts", "unique_hosts"))


QUERIES = [
    normalize_domains, label_entropy, rare_bigrams, levenshtein_pairs, sql_functions,
    bind_lines, zeek_lines,
    dga_features, tunneling_features, beaconing_features, beaconing_heavy_pairs,
    nxdomain_burst, nxdomain_burst_heavy_hosts, typosquat, typosquat_brand_table, fast_flux,
    newly_registered, doh_hosts, host_lists,
    alerts_union, host_risk, risk_leaderboard, tactic_summary, host_tactics, timeline,
    kill_chain, summary_metrics, recall_by_scenario, false_positives, false_positive_hosts,
    kpis, traffic_15min, top_talkers, top_domains, response_codes, alerts_by_detector,
    alert_search, critical_status, top_critical_alerts, domain_detail, domain_alerts,
    domain_history, flagged_domains, default_domain,
    alert_hosts, host_risk_all_hosts, tactic_summary_all_hosts, host_tactics_all_hosts,
    timeline_all_hosts, kill_chain_all_hosts, recall_all_hosts, false_positives_all_hosts,
    typosquat_cut_brands, timestamp_layouts, alert_list, alert_preview,
    csv_files, bind_files, zeek_files, alert_files, kpi_sketches, domain_sketches,
    alert_evidence,
]


def entry(spark: SparkSession) -> DataFrame:
    """All detectors over the DNS view at sf0.001."""
    return alerts_union(spark, "/root/testdata/sf0.001")


def _training_data():
    """The training-data operators' queries, if that part of the package is there."""
    try:
        found = importlib.util.find_spec("nametrail.llm.queries")
    except ModuleNotFoundError:
        found = None
    return importlib.import_module("nametrail.llm.queries") if found else None


def queries() -> dict[str, Query]:
    more = _training_data()
    return {q.__name__: q for q in QUERIES} | (more.QUERIES if more else {})


def oracle_sql() -> dict[str, str]:
    from duckdb_oracles import build

    more = _training_data()
    return build(
        words=VOCABULARY, suffixes=MULTI_PART_TLDS, brands=BRANDS, providers=PROVIDERS,
        dga_score=DGA_SCORE, tunnel=TUNNEL, beacon=BEACON, burst=BURST, host=HOST, domain=DOMAIN,
    ) | (more.SQL if more else {})
