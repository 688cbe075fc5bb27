"""Schemas of the tables this library reads and writes."""

from pyspark.sql import types as T


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


EVENT_SCHEMA = _schema(
    ("timestamp", T.TimestampType(), False),
    ("src_ip", T.StringType(), False),
    ("query_name", T.StringType(), False),
    ("query_type", T.StringType(), False),
    ("response_code", T.StringType(), False),
    ("response_ip", T.StringType(), False),
    ("ttl", T.LongType(), False),
    ("query_size_bytes", T.LongType(), False),
    ("first_registered_days_ago", T.DoubleType(), True),
    ("ground_truth_label", T.StringType(), True),
    ("registrable_domain", T.StringType(), False),
    ("subdomain", T.StringType(), False),
    ("subdomain_label_count", T.IntegerType(), False),
    ("subdomain_len", T.IntegerType(), False),
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# Column order of the event CSV.
EVENT_CSV_COLUMNS = [
    "timestamp", "src_ip", "query_name", "query_type", "response_code",
    "response_ip", "ttl", "query_size_bytes", "first_registered_days_ago",
    "ground_truth_label",
]

ALERT_SCHEMA = _schema(
    ("alert_id", T.StringType(), True),
    ("timestamp", T.TimestampType(), True),
    ("detector", T.StringType(), True),
    ("severity_score", T.DoubleType(), True),
    ("severity_label", T.StringType(), True),
    ("src_ip", T.StringType(), True),
    ("domain", T.StringType(), True),
    ("reason", T.StringType(), True),
    ("mitre_id", T.StringType(), True),
    ("mitre_name", T.StringType(), True),
    ("evidence", T.StringType(), True),
)
ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()

HOST_RISK_COLUMNS = [
    "src_ip", "risk_score", "risk_label", "n_alerts", "n_detectors",
    "detectors", "top_detector", "top_reason",
]

RECALL_COLUMNS = [
    "scenario", "detector", "unit", "ground_truth_total", "caught", "recall",
]
