"""IPv4 / IPv6 literal test as regular expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"


def _ipv6() -> str:
    full = [f"{_GROUP}(?::{_GROUP}){{7}}", f"{_GROUP}(?::{_GROUP}){{5}}:{IPV4}"]
    short = []
    for before in range(8):
        head = f"{_GROUP}(?::{_GROUP}){{{before - 1}}}" if before else ""
        after, after_v4 = 7 - before, 5 - before
        tails = [""]
        if after:
            tails.append(f"{_GROUP}(?::{_GROUP}){{0,{after - 1}}}")
        if after_v4 >= 0:
            tails.append(f"(?:{_GROUP}:){{0,{after_v4}}}{IPV4}")
        short.append(f"{head}::(?:{'|'.join(tails)})")
    return f"(?:{'|'.join(full + short)})(?:%[^%]+)?"


IP_LITERAL = rf"^(?:{IPV4}|{_ipv6()})\z"


def is_ip(value: Column) -> Column:
    return value.rlike(IP_LITERAL)


def first_ip(values: Column) -> Column:
    """First address literal of an array, "" when there is none."""
    return F.coalesce(F.get(F.filter(values, is_ip), F.lit(0)), F.lit(""))
