"""Raw log rows -> the fixed event table, as one projection and one filter."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nametrail.functions.text import clean_name, registrable_of_clean
from nametrail.schema import EVENT_COLUMNS, EVENT_SCHEMA

# Fixed value: bytes of a DNS header plus question overhead, used when a source
# does not report the size on the wire.
FIXED_QUERY_BYTES = 17


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str) -> Column:
    """Double; text that is no finite number becomes null."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


#: Layouts besides ISO text, as (pattern, its ISO form). A log of another layout passes its own.
TIMESTAMP_LAYOUTS = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T](.*))?$", "$3-$1-$2 $4"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:[ T](.*))?$", "$1-$2-$3 $4"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[ T]?(\d{2}:?\d{2}.*))?$", "$1-$2-$3 $4"),
    (r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4"),
)
_ZONED = r"[0-9]\s*(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)$"


def instant(local: Column, source_tz: str) -> Column:
    """The instant of a time without zone, whatever zone the session has."""
    utc = F.convert_timezone(F.lit(source_tz), F.lit("UTC"), local)
    seconds = (F.datediff(F.to_date(utc), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400
               + F.hour(utc) * 3600 + F.minute(utc) * 60)
    micros = (F.extract(F.lit("SECOND"), utc) * 1_000_000).cast("bigint")
    return F.timestamp_micros(seconds * 1_000_000 + micros)


def parsed_timestamp(text: Column, source_tz: str = "UTC",
                     layouts: Sequence[tuple[str, str]] = TIMESTAMP_LAYOUTS) -> Column:
    """A time in ISO form or one of the layouts; null for other text.

    A zone in the text holds; without one the time is read in ``source_tz``. The session's
    time zone plays no part.
    """
    text = F.trim(text)
    for pattern, iso in layouts:
        text = F.regexp_replace(text, pattern, iso)
    text = F.trim(text)
    has_time = text.contains(":")  # a date alone has a minus that is no zone
    return F.when(has_time & text.rlike(_ZONED), text.try_cast("timestamp")).otherwise(
        instant(text.try_cast("timestamp_ntz"), source_tz))


def _timestamp(raw: DataFrame, source_tz: str, layouts: Sequence[tuple[str, str]]) -> Column:
    kind = raw.schema["timestamp"].dataType
    if isinstance(kind, T.TimestampType):
        return F.col("timestamp")
    if isinstance(kind, T.TimestampNTZType):
        return instant(F.col("timestamp"), source_tz)
    return parsed_timestamp(F.col("timestamp").cast("string"), source_tz, layouts)


def rejected_rows(raw: DataFrame, source_tz: str = "UTC",
                  layouts: Sequence[tuple[str, str]] = TIMESTAMP_LAYOUTS) -> DataFrame:
    """The rows that ``normalize_events`` drops: those without a usable timestamp."""
    return raw.where(_timestamp(raw, source_tz, layouts).isNull())


def normalize_events(raw: DataFrame, source_tz: str = "UTC", keep_extra: bool = False,
                     layouts: Sequence[tuple[str, str]] = TIMESTAMP_LAYOUTS) -> DataFrame:
    """Bring rows of any source to ``EVENT_SCHEMA``.

    Rows without a usable timestamp are dropped; ``rejected_rows`` shows them. ``raw`` needs ``timestamp,
    src_ip, query_name, query_type, response_code, response_ip, ttl``; the other
    columns are optional. Times without a zone are read in ``source_tz``,
    in ISO form or one of ``layouts``, whatever the session's zone. Works on streams as well: there is
    no sort and no shuffle.
    """
    has = set(raw.columns)
    missing = F.lit(None)
    size = _number("query_size_bytes").try_cast("bigint") if "query_size_bytes" in has else missing
    age = (
        _number("first_registered_days_ago")
        if "first_registered_days_ago" in has else missing.cast("double")
    )
    label = (
        F.nullif(F.col("ground_truth_label").cast("string"), F.lit(""))
        if "ground_truth_label" in has else missing.cast("string")
    )
    extra = [c for c in raw.columns if c not in EVENT_COLUMNS] if keep_extra else []

    rows = raw.select(
        _timestamp(raw, source_tz, layouts).alias("timestamp"),
        _text("src_ip").alias("src_ip"),
        F.rtrim(F.lower(_text("query_name")), F.lit(".")).alias("query_name"),
        F.upper(_text("query_type")).alias("query_type"),
        F.upper(_text("response_code")).alias("response_code"),
        _text("response_ip").alias("response_ip"),
        F.coalesce(_number("ttl").try_cast("bigint"), F.lit(0).cast("bigint")).alias("ttl"),
        size.cast("bigint").alias("query_size_bytes"),
        age.alias("first_registered_days_ago"),
        label.alias("ground_truth_label"),
        *extra,
    ).where(F.col("timestamp").isNotNull())

    return (
        rows.withColumn("query_size_bytes", F.coalesce(
            "query_size_bytes", F.length("query_name").cast("bigint") + FIXED_QUERY_BYTES))
        .transform(derive_domain_columns)
        .select(*EVENT_COLUMNS, *extra)
    )


def derive_domain_columns(events: DataFrame) -> DataFrame:
    """Add registrable domain, subdomain, its label count and its length."""
    dots = F.length("subdomain") - F.length(F.replace("subdomain", F.lit("."), F.lit("")))
    return (
        events.withColumn("_clean", clean_name("query_name"))
        .withColumn("registrable_domain", registrable_of_clean("_clean"))
        .withColumn("subdomain", F.expr(
            "left(_clean, length(_clean) - length(registrable_domain) - 1)"))
        .withColumn("subdomain_label_count", F.when(
            F.length("_clean") > F.length("registrable_domain"), dots + 1).otherwise(F.lit(0)))
        .withColumn("subdomain_len", F.length("subdomain"))
        .drop("_clean")
    )
