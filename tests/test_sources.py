import pytest
from pyspark.sql import functions as F

from nametrail.schema import ALERT_COLUMNS, EVENT_COLUMNS, EVENT_SCHEMA
from nametrail.sources import (
    ZeekHeader,
    detect_format,
    empty_events,
    export_alerts_csv,
    load_log,
    write_events,
)

BIND = """\
03-Mar-2025 22:10:11.007 queries: info: client @0x55aa01 172.16.4.8#40001 (Shop.Example.ORG): query: Shop.Example.ORG. IN A + (172.16.0.1)
03-mar-2025 22:10:12.000 queries: info: client 2001:db8::1#5 (a.b): query: a.b IN NULL -E(0)K (172.16.0.1)
03-MAR-2025 22:10:15.210 query-errors: info: client @0x1 172.16.4.9#33 (no.such.test): view home: query failed (NXDOMAIN) for no.such.test/IN/A at query.c:77
03-Mar-2025 22:10:15.001 queries: info: client @0x1 172.16.4.9#33 (no.such.test): query: no.such.test IN A + (172.16.0.1)
31-Feb-2025 22:10:15.001 queries: info: client @0x1 172.16.4.9#33 (no.such.test): query: no.such.test IN A + (172.16.0.1)
 03-Mar-2025 22:10:15.001 queries: info: client @0x1 172.16.4.9#33 (no.such.test): query: no.such.test IN A + (172.16.0.1)
03-Mar-2025 22:11:00.000 zone: info: zone test/IN: loaded serial 7
"""

ZEEK = """\
#separator \\x09
#set_separator\t,
#unset_field\t-
#path\tdns
#fields\tts\tuid\tid.orig_h\tquery\tqtype_name\trcode_name\tanswers\tTTLs
1723973723.456789\tC1\t10.0.0.1\tA.com.\tA\tnoerror\tcname.x,1.2.3.4\t30.0,60.0
-\tC2\t10.0.0.2\tb.com\tA\tNXDOMAIN\t-\t-
1723973724.5\tC3\t10.0.0.3\tc.com
inf\tC4\t10.0.0.4\td.com\tA\tNOERROR\t-\t-
1723973725.0\tC5\t10.0.0.5\te.com\tAAAA\t-\tx,2001:db8::1,1.1.1.1\tinf\textra\tcells
"""

ZEEK_OTHER = """\
#separator \\x09
#set_separator\t\\x2c
#unset_field\t(none)
#fields\tquery\tts\tid.orig_h\tanswers\trcode_name
f.org\t1723973726.0\t10.0.0.6\t9.9.9.9,8.8.8.8\t(none)
"""


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def by_name(df):
    return {r.query_name: r for r in df.collect()}


def test_bind_lines(spark, tmp_path):
    path = put(tmp_path, "q.log", BIND)
    assert detect_format(spark, path) == "bind"
    df = load_log(spark, path)
    assert df.count() == 4
    assert df.columns == EVENT_COLUMNS
    assert sorted(r.response_code for r in df.collect()) == ["", "", "", "NXDOMAIN"]
    rows = by_name(df)
    assert rows["a.b"].src_ip == "2001:db8::1" and rows["a.b"].query_type == "NULL"
    shop = rows["shop.example.org"]
    assert shop.timestamp.isoformat() == "2025-03-03T22:10:11.007000"
    assert (shop.ttl, shop.query_size_bytes, shop.subdomain) == (0, 33, "shop")


def test_bind_error_merge_and_zone(spark, tmp_path):
    path = put(tmp_path, "q.log", BIND)
    merged = load_log(spark, path, "bind", dedupe_errors=True)
    assert sorted(r.response_code for r in merged.collect()) == ["", "", "NXDOMAIN"]
    local = load_log(spark, path, "bind", source_tz="America/New_York")
    assert by_name(local)["shop.example.org"].timestamp.isoformat() == "2025-03-04T03:10:11.007000"


def test_zeek_file(spark, tmp_path):
    path = put(tmp_path, "dns.log", ZEEK)
    assert detect_format(spark, path) == "zeek"
    rows = by_name(load_log(spark, path))
    assert set(rows) == {"a.com", "c.com", "e.com"}
    a, c, e = rows["a.com"], rows["c.com"], rows["e.com"]
    assert (a.response_ip, a.ttl, a.response_code) == ("1.2.3.4", 30, "NOERROR")
    assert a.timestamp.microsecond == 456789
    assert (c.response_code, c.response_ip, c.ttl, c.query_type) == ("", "", 0, "")
    assert (e.response_ip, e.ttl, e.response_code) == ("2001:db8::1", 0, "")


def test_zeek_directory_with_two_headers(spark, tmp_path):
    put(tmp_path, "a.log", ZEEK)
    put(tmp_path, "b.log", ZEEK_OTHER)
    put(tmp_path, "c.log", "1723973726.0\tC1\t10.0.0.1\tlost.com\n")
    rows = by_name(load_log(spark, str(tmp_path), "zeek"))
    assert set(rows) == {"a.com", "c.com", "e.com", "f.org"}
    assert (rows["f.org"].response_ip, rows["f.org"].response_code) == ("9.9.9.9", "")
    assert rows["a.com"].ttl == 30


def test_zeek_header_cases(spark, tmp_path):
    bare = put(tmp_path, "bare.log", ZEEK.split("TTLs\n")[1])
    fields = ("ts", "uid", "id.orig_h", "query", "qtype_name", "rcode_name", "answers", "TTLs")
    assert load_log(spark, bare, "zeek", header=ZeekHeader(fields)).count() == 3
    assert load_log(spark, bare, "zeek").count() == 0
    changing = put(tmp_path, "changing.log", ZEEK + ZEEK_OTHER)
    with pytest.raises(ValueError, match="fields"):
        load_log(spark, changing, "zeek")
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    put(mixed, "a.log", ZEEK)
    put(mixed, "b.log", "1723973726.0\tC1\t10.0.0.1\tlost.com\n")
    assert load_log(spark, str(mixed), "zeek").count() == 3


CSV = """\
query_name,timestamp,src_ip,query_type,response_code,response_ip,ttl,ground_truth_label,note
WWW.Example.co.uk.,2026-08-18T10:15:23.456,10.0.0.1,null,noerror,1.2.3.4,1.5,benign,n1
b.com,not a time,10.0.0.2,A,NOERROR,,60,,n2
c.com,2026-08-18 10:15:24,10.0.0.3,NULL,,,x,dga,n3
"d,e.com",2026-08-18,NA,A,NXDOMAIN,,inf,,n4
"""


def test_csv(spark, tmp_path):
    path = put(tmp_path, "log.CSV", CSV)
    assert detect_format(spark, path) == "csv"
    df = load_log(spark, path)
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in EVENT_SCHEMA]
    rows = by_name(df)
    assert set(rows) == {"www.example.co.uk", "c.com", "d,e.com"}
    w, c, d = rows["www.example.co.uk"], rows["c.com"], rows["d,e.com"]
    assert (w.query_type, w.ttl, w.response_code, w.subdomain) == ("NULL", 1, "NOERROR", "www")
    assert (c.query_type, c.ttl, c.response_code) == ("NULL", 0, "")
    assert (d.src_ip, d.ttl, d.ground_truth_label) == ("NA", 0, None)
    assert w.query_size_bytes == 17 + len("www.example.co.uk")
    assert w.first_registered_days_ago is None
    extra = load_log(spark, path, keep_extra=True)
    assert extra.columns[-1] == "note" and by_name(extra)["c.com"].note == "n3"


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        load_log(spark, put(tmp_path, "bad.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError, match="format"):
        load_log(spark, put(tmp_path, "x.csv", CSV), "xml")


def test_csv_directory_with_another_column_order_is_refused(spark, tmp_path):
    put(tmp_path, "a.csv", CSV)
    swapped = "\n".join(",".join(line.split(",")[::-1]) for line in CSV.splitlines()[:2])
    put(tmp_path, "b.csv", swapped + "\n")
    with pytest.raises(Exception, match="CSV header"):
        load_log(spark, str(tmp_path), "csv").count()


def test_empty_input(spark, tmp_path):
    assert empty_events(spark).schema == EVENT_SCHEMA
    path = put(tmp_path, "empty.csv", CSV.splitlines()[0] + "\n")
    df = load_log(spark, path)
    assert df.columns == EVENT_COLUMNS and df.count() == 0


def test_event_round_trips(spark, make_events, tmp_path):
    events = make_events([
        {"query_name": "a.b.c.com", "timestamp": 0.25, "ground_truth_label": "dga"},
        {"query_name": "x.org", "timestamp": 86400, "first_registered_days_ago": 3.0}])
    write_events(events, str(tmp_path / "csv"), "csv")
    assert sorted(load_log(spark, str(tmp_path / "csv"), "csv").collect()) == sorted(
        events.collect())
    write_events(events, str(tmp_path / "parquet"))
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert sorted(back.select(EVENT_COLUMNS).collect()) == sorted(events.collect())
    assert sorted(p.name for p in (tmp_path / "parquet").glob("event_date=*")) == [
        "event_date=2026-08-18", "event_date=2026-08-19"]
    with pytest.raises(ValueError):
        write_events(events, str(tmp_path / "x"), "orc")


def test_alert_export(spark, tmp_path):
    alerts = spark.range(1).select(*[
        (F.lit(1.5) if c == "severity_score" else F.current_timestamp() if c == "timestamp"
         else F.lit(c)).alias(c) for c in ALERT_COLUMNS])
    export_alerts_csv(alerts, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == [c for c in ALERT_COLUMNS if c != "evidence"]


TIMES = [
    ("2026-08-18T10:15:23.456", "2026-08-18 10:15:23.456"), ("08/18/2026 10:15:23", "2026-08-18 10:15:23"),
    ("8/1/2026", "2026-08-01 00:00:00"), ("2026/08/18 10:15", "2026-08-18 10:15:00"),
    ("20260818 10:15:23", "2026-08-18 10:15:23"), ("2026-08-18", "2026-08-18 00:00:00"),
    ("2026-08-18 101523", "2026-08-18 10:15:23"), ("2026-08-18T10:15:23Z", "2026-08-18 10:15:23"),
    ("2026-08-18 10:15:23+02:00", "2026-08-18 08:15:23"), (" 2026-08-18 10:15:23 ", "2026-08-18 10:15:23"),
    ("2026-03-08 02:30:00", "2026-03-08 02:30:00"), ("13/45/2026 1:2:3", None), ("soon", None), ("", None),
    (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session(spark, zone):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from nametrail.sources.normalize import parsed_timestamp, rejected_rows

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(t,) for t, _ in TIMES], "timestamp string")
        got = [r.us for r in frame.select(F.unix_micros(parsed_timestamp(F.col("timestamp"))).alias("us"))
               .collect()]
        want = [w and round(datetime.fromisoformat(w).replace(tzinfo=timezone.utc).timestamp() * 10**6)
                for _, w in TIMES]
        assert got == want
        assert rejected_rows(frame).count() == 4
        madrid = frame.limit(1).select(F.unix_micros(
            parsed_timestamp(F.col("timestamp"), "Europe/Madrid"))).first()[0]
        assert madrid == want[0] - 7_200_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
