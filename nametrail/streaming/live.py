"""Structured Streaming forms of the batch operators (extensions).

The batch tool reads finite logs only; these let the same columns, features and
detectors run on files as they arrive. Where a streaming form is not the same as
the batch operator, its docstring says how it differs.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametrail.constants import BRAND_WATCHLIST, CARRIER_TYPES, KNOWN_DOH_PROVIDERS
from nametrail.functions.text import shannon_entropy
from nametrail.operators.alerts import share
from nametrail.operators.dga import long_label, score_labels
from nametrail.operators.rollup import answer_rollup, name_rollup, united_answers, united_names
from nametrail.operators.tunneling import duration_minutes, tunneling_score
from nametrail.operators.typosquat import MIN_DOMAIN_LEN, nearest_listed_brand
from nametrail.plans.pipeline import run_all_detectors
from nametrail.schema import EVENT_SCHEMA
from nametrail.sources.bind import parse_bind_lines
from nametrail.sources.delimited import REQUIRED
from nametrail.sources.normalize import normalize_events
from nametrail.sources.zeek import ZeekHeader, parse_zeek_lines

DELAY = "10 minutes"


def stream_log(spark: SparkSession, path: str, fmt: str, *, header: ZeekHeader | None = None,
               columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Normalized events of files that appear below ``path``; no shuffle, no state.

    ``fmt``: ``parquet`` (files written by ``write_events``), ``bind``, ``zeek``
    (needs ``header``) or ``csv`` (needs ``columns``, the names in file order; a
    file with another header raises).
    """
    reader = spark.readStream.options(**options)
    if fmt == "parquet":
        return reader.schema(EVENT_SCHEMA).parquet(path)
    if fmt == "bind":
        return normalize_events(parse_bind_lines(reader.text(path)))
    if fmt == "zeek" and header is not None:
        return normalize_events(parse_zeek_lines(reader.text(path), header))
    if fmt == "csv" and columns is not None and set(REQUIRED) <= set(columns):
        schema = ", ".join(f"`{c}` string" for c in columns)
        raw = (reader.schema(schema).option("header", True).option("enforceSchema", False)
               .option("escape", '"').csv(path))
        return normalize_events(raw)
    raise ValueError(f"cannot stream format {fmt!r} with the given header or columns")


def without_duplicates(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Drop repeats of a query row seen within the watermark delay, and late rows."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["timestamp", "src_ip", "query_name", "query_type", "response_code", "response_ip"])


def traffic_counts(events: DataFrame, bucket: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    """Queries per time bucket; buckets without queries give no row."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", bucket)).agg(F.count("*").alias("n_queries"))
        .select(F.col("window.start").alias("bucket_start"), "n_queries"))


def nxdomain_windows(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                     count_threshold: int = 20, delay: str = DELAY) -> DataFrame:
    """Hosts with many failures in a sliding window.

    Windows start at multiples of ``slide``, so the count is at most that of the
    batch operator, whose window may end at any query.
    """
    return (
        events.where(F.col("response_code") == "NXDOMAIN")
        .withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", window, slide), "src_ip")
        .agg(F.count("*").alias("n_failed"))
        .where(F.col("n_failed") >= count_threshold)
        .select("src_ip", F.col("window.start").alias("window_start"), "n_failed"))


def flag_events(events: DataFrame, *, min_label_len: int = 6, dga_threshold: float = 45.0,
                brands: Sequence[str] = BRAND_WATCHLIST, max_distance: int = 2,
                providers: Sequence[str] = KNOWN_DOH_PROVIDERS) -> DataFrame:
    """Events whose name alone is suspicious, in one stateless pass.

    Adds ``dga_score``, ``matched_brand``, ``edit_distance`` and ``doh``: the
    domain-level scores of the three batch detectors, per event.
    """
    scored = score_labels(events.withColumn("n_queries", F.lit(1)))
    near = F.when(F.length("registrable_domain") >= MIN_DOMAIN_LEN,
                  nearest_listed_brand(F.col("registrable_domain"), brands, max_distance))
    return (
        scored.withColumns({
            "dga_score": F.when(
                long_label(min_label_len) & (F.col("score") >= dga_threshold), F.col("score")),
            "best": near,
            "doh": F.col("query_name").isin(list(providers))})
        .withColumn("best", F.when(F.col("best.edit_distance") >= 1, F.col("best")))
        .where(F.col("dga_score").isNotNull() | F.col("best").isNotNull() | F.col("doh"))
        .select(*events.columns, "dga_score", "best.matched_brand", "best.edit_distance", "doh"))


def tunneling_sessions(events: DataFrame, gap: str = "10 minutes", min_queries: int = 20,
                       score_threshold: float = 45.0, delay: str = DELAY) -> DataFrame:
    """Tunneling score per activity session of a (host, domain) pair.

    The batch score over one session instead of the whole log; distinct names are
    estimated (within about 1 %), since streams have no exact distinct count.
    """
    n = F.col("n_queries")
    packed = events.withColumn("packed", F.replace("subdomain", F.lit("."), F.lit("")))
    return (
        packed.where(F.col("subdomain_label_count") > 0)
        .withWatermark("timestamp", delay)
        .groupBy("src_ip", "registrable_domain", F.session_window("timestamp", gap))
        .agg(F.count("*").alias("n_queries"), F.avg("subdomain_len").alias("avg_len"),
             share(F.col("query_type").isin(CARRIER_TYPES)).alias("txt_null_ratio"),
             F.approx_count_distinct("subdomain", 0.01).alias("names"),
             F.avg(shannon_entropy("packed")).alias("avg_entropy"),
             F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .where(n >= min_queries)
        .withColumn("rate", n / duration_minutes())
        .withColumn("unique_ratio", F.least(F.col("names") / n, F.lit(1.0)))
        .withColumn("score", tunneling_score())
        .where(F.col("score") >= score_threshold)
        .select("src_ip", "registrable_domain", "n_queries", "avg_len", "txt_null_ratio", "rate",
                "unique_ratio", "avg_entropy", "first_seen", "last_seen", "score"))


#: Seconds of a slice of time, the unit in which state of micro-batches is kept and expires.
SLICE_SECONDS = 900


def _parts(batch: DataFrame) -> dict[str, DataFrame]:
    """What is kept of a micro-batch, by slice: two rollups, and the instants of its queries."""
    sliced = batch.withColumn(
        "slice", F.floor(F.unix_seconds("timestamp") / SLICE_SECONDS).cast("bigint"))
    failed = F.col("response_code") == "NXDOMAIN"
    instants = sliced.groupBy("src_ip", "query_name", failed.alias("failed"), "timestamp", "slice")
    return {"names": name_rollup(sliced, "slice"), "answers": answer_rollup(sliced, "slice"),
            "instants": instants.agg(F.count("*").alias("copies"))}


def _instants_as_events(instants: DataFrame) -> DataFrame:
    """The columns of events that detectors still need beside the rollups."""
    return instants.select(
        "src_ip", "query_name", "timestamp",
        F.when(F.col("failed"), "NXDOMAIN").otherwise("").alias("response_code"),
        F.lit(None).cast("double").alias("first_registered_days_ago"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")).drop("_copy")


def _expire(spark: SparkSession, store: str, first: int) -> None:
    """Delete the slices before ``first``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{store}/*/batch_id=*/slice=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern):
        name = status.getPath().getName()
        if int(name.removeprefix("slice=")) < first:
            files.delete(status.getPath(), True)


def detect_on_batches(events: DataFrame, store: str, checkpoint: str,
                      deliver: Callable[[DataFrame, int], None], *, hours: float = 24.0,
                      ahead_hours: float = 24.0, params=None, detectors=None):
    """Alerts of the trailing ``hours`` after each micro-batch, from state that adds up.

    Of each micro-batch the rollups and the instants are written by slices of 15 minutes,
    ``store/*/batch_id=N/slice=S`` (overwritten on a replay, so a restart repeats nothing);
    its events are never read again. The rollups of the trailing slices are united, and
    ``deliver(alerts, batch_id)`` gets what the detectors find in them: the alerts of the
    batch detectors over the same whole slices. The time trails the newest row of the store,
    so late rows alone move nothing back; slices that begin more than ``ahead_hours`` past the
    clock do not count, those that have passed are deleted. Detectors of your own find the
    host, name, time and failure of each event. Returns the ``DataStreamWriter``; call
    ``trigger(...)`` and ``start()`` on it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        stored = {}
        for name, part in _parts(batch).items():
            (part.write.mode("overwrite").partitionBy("slice")
             .parquet(f"{store}/{name}/batch_id={batch_id}"))
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema)
            stored[name] = spark.read.schema(f"{columns}, batch_id int").parquet(f"{store}/{name}")
        batch.unpersist()
        clock = spark.range(1).select(F.unix_seconds(F.current_timestamp())).first()[0]
        limit = (clock + round(ahead_hours * 3600)) // SLICE_SECONDS
        counted = stored["names"].where(F.col("slice") <= limit)
        last = counted.agg(F.max("slice")).first()[0]
        if last is None:
            return
        newest = counted.where(F.col("slice") == last).agg(
            F.max(F.unix_micros("last_seen"))).first()[0]
        first = (newest - round(hours * 3_600_000_000)) // (SLICE_SECONDS * 1_000_000)
        recent = {name: df.where(F.col("slice").between(first, limit)) for name, df in stored.items()}
        deliver(run_all_detectors(
            _instants_as_events(recent["instants"]), params, detectors,
            names=united_names(recent["names"]), answers=united_answers(recent["answers"])), batch_id)
        _expire(spark, store, first)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
