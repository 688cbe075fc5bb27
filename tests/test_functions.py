import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from nametrail.functions import (
    common_bigrams,
    digit_ratio,
    levenshtein,
    rare_bigram_ratio,
    register_sql_functions,
    registrable_domain,
    severity_label,
    shannon_entropy,
    split_domain_labels,
    subdomain,
    tactic_of,
    technique_name,
)
from nametrail.functions.scoring import clamp_score
from nametrail.sources.addresses import is_ip

SPLITS = [
    ("", "", []),
    ("google.com", "google.com", []),
    ("www.google.com", "google.com", ["www"]),
    ("vpn.example.co.uk", "example.co.uk", ["vpn"]),
    ("co.uk", "co.uk", []),
    ("a.co.uk", "a.co.uk", []),
    ("localhost", "localhost", []),
    ("192.168.1.1", "1.1", ["192", "168"]),
    ("4.3.2.1.in-addr.arpa", "in-addr.arpa", ["4", "3", "2", "1"]),
    ("a..com", ".com", ["a"]),
    (".foo.com", "foo.com", [""]),
    ("FOO.Com..", "foo.com", []),
    ("foo.com. ", "com.", ["foo"]),
    ("4a6f.tunnel.evil-corp.net", "evil-corp.net", ["4a6f", "tunnel"]),
    (" x.y.z ", "y.z", ["x"]),
    (None, "", []),
]


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_domain_split(spark):
    rows = texts(spark, [s[0] for s in SPLITS]).select(
        "x", registrable_domain("x").alias("r"), split_domain_labels("x").alias("l"),
        subdomain("x").alias("s")).collect()
    for row, (given, registrable, labels) in zip(rows, SPLITS):
        assert (row.x, row.r, row.l) == (given, registrable, labels)
        assert row.s == ".".join(labels)


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0


def rare_ratio(label, common):
    pairs = [seg[i:i + 2] for seg in label.split("-") for i in range(len(seg) - 1)]
    return sum(p not in common for p in pairs) / len(pairs) if pairs else 0.0


def test_text_features_against_plain_python(spark):
    rng = random.Random(7)
    values = ["", "a", "aaaaaa", "abca", "------", "a-b", "x9k2qz7vw4bt", "münchen", "日本語"]
    values += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-", k=rng.randint(1, 40)))
               for _ in range(300)]
    common = set(common_bigrams())
    rows = texts(spark, values).select(
        "x", shannon_entropy("x").alias("h"), rare_bigram_ratio("x").alias("r"),
        digit_ratio("x").alias("d")).collect()
    for row in rows:
        assert row.h == pytest.approx(entropy(row.x), abs=1e-12)
        assert math.copysign(1, row.h) == 1 or row.h < 0
        assert row.r == pytest.approx(rare_ratio(row.x, common), abs=1e-15)
        digits = sum(c in "0123456789" for c in row.x) / len(row.x) if row.x else 0.0
        assert row.d == pytest.approx(digits, abs=1e-15)
        assert row.h <= math.log2(len(set(row.x)) or 1) + 1e-9


def test_own_vocabulary(spark):
    row = texts(spark, ["xyxy"]).select(
        rare_bigram_ratio("x", common_bigrams(["xyx"])).alias("r")).first()
    assert row.r == 0.0


def test_bigram_count():
    assert len(common_bigrams()) == 185


def test_levenshtein(spark):
    row = spark.sql("select 'paypa1.com' a, 'paypal.com' b, 'zzz' c").select(
        levenshtein("a", "b").alias("one"), levenshtein("a", "c", 2).alias("far")).first()
    assert (row.one, row.far) == (1, -1)


@pytest.mark.parametrize("score,label", [
    (84.9, "High"), (85.0, "Critical"), (64.9, "Medium"), (65.0, "High"), (39.9, "Low"),
    (40.0, "Medium"), (0.0, "Low")])
def test_severity(spark, score, label):
    row = spark.range(1).select(F.lit(score).alias("s")).select(severity_label("s").alias("l"))
    assert row.first().l == label


def test_clamp_and_lookups(spark):
    row = spark.range(1).select(
        clamp_score(F.lit(120.0)).alias("high"), clamp_score(F.lit(-3.0)).alias("low"),
        clamp_score(F.lit(12.34)).alias("mid"),
        tactic_of(F.lit("T1590.002")).alias("tactic"), tactic_of(F.lit("T0")).alias("other"),
        technique_name(F.lit("T1568.001")).alias("name"), technique_name(F.lit("T0")).alias("none"),
    ).first()
    assert (row.high, row.low, row.mid) == (100.0, 0.0, 12.3)
    assert (row.tactic, row.other) == ("Reconnaissance", "Other")
    assert (row.name, row.none) == ("Dynamic Resolution: Fast Flux DNS", "")


def test_sql_functions_are_inlined(spark):
    register_sql_functions(spark)
    texts(spark, ["a.b.example.co.uk"]).createOrReplaceTempView("names")
    df = spark.sql("select registrable_domain(x) r, subdomain(x) s, shannon_entropy(x) h, "
                   "rare_bigram_ratio(x) b, digit_ratio(x) d, severity_label(66.0D) v, "
                   "split_domain_labels(x) l from names")
    row = df.first()
    assert (row.r, row.s, row.v, row.l) == ("example.co.uk", "a.b", "High", ["a", "b"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def looks_like_ip(value):
    try:
        ipaddress.ip_address(value)
        return True
    except ValueError:
        return False


def test_ip_literals_match_the_standard_library(spark):
    rng = random.Random(11)
    values = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "1::", "fe80::1%eth0",
              "fe80::1%", "fe80::1%a%b", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
              "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1::2::3",
              "12345::", "1.2.3.4\n", "cname.x", "", ":", ":::", "1:2:3:4:5:6:7:8:9", "::1.2.3"]
    for _ in range(3000):
        n = rng.randint(0, 8)
        parts = [rng.choice(["", "0", "1", "ab", "FFFF", "12345", "1.2.3.4", "g"]) for _ in range(n)]
        values.append(":".join(parts))
        values.append(".".join(str(rng.choice([0, 7, 99, 255, 256, "01"])) for _ in range(4)))
    rows = texts(spark, values).select("x", is_ip(F.col("x")).alias("ip")).collect()
    wrong = [r.x for r in rows if r.ip != looks_like_ip(r.x)]
    assert wrong == []
