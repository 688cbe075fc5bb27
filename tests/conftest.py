import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import START  # noqa: E402

DEFAULTS = {
    "timestamp": START, "src_ip": "10.0.0.1", "query_name": "example.com", "query_type": "A",
    "response_code": "NOERROR", "response_ip": "", "ttl": 60,
    "first_registered_days_ago": None, "ground_truth_label": None,
}
RAW_SCHEMA = (
    "timestamp timestamp, src_ip string, query_name string, query_type string, "
    "response_code string, response_ip string, ttl bigint, first_registered_days_ago double, "
    "ground_truth_label string")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; ``timestamp`` may be seconds after a fixed start."""
    from nametrail.sources import normalize_events

    def build(rows):
        full = []
        for row in rows:
            merged = {**DEFAULTS, **row}
            if not isinstance(merged["timestamp"], datetime):
                merged["timestamp"] = START + timedelta(seconds=merged["timestamp"])
            full.append(tuple(merged[c] for c in DEFAULTS))
        return normalize_events(spark.createDataFrame(full, RAW_SCHEMA))

    return build
