"""A training corpus from raw documents: grade, deduplicate, decontaminate, mix, encode.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir), and ``run`` writes
what each returns as Parquet in the shared folder and hands it on as the next one's docs.
All but the last return rows of ``documents`` with its columns (and any others it came with).
Stages decide by row: ids may be null, and may stand for several texts. A row is named by a
64-bit hash of its columns; rows equal in all of them share what is decided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, small
from nametrail.llm.decontaminate import benchmark_overlaps
from nametrail.llm.mixing import balance_sources
from nametrail.llm.near_dup import near_duplicates
from nametrail.llm.quality import fit_grades, keep_graded
from nametrail.llm.token_files import read_token_files, write_token_files

#: Least probability of the highest grade of documents that stay.
KEEP_TAIL = 0.5
#: No stage but the last can be said in SQL, and the last depends on them.
ORACLE_SQL = None


def rated_grade():
    """0 for toxic documents, 1 for others of low quality, 2 for good ones."""
    return (F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1)
            .when((F.col("toxic") == 0) & (F.col("quality") == 1), 2))


def row_key(docs: DataFrame) -> Column:
    """Names a row by its content: the same whenever and wherever the row is read."""
    return F.xxhash64(*(docs[c] for c in docs.columns))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose row key is not the one column of `keys`."""
    gone = small(Tables(docs.sparkSession).save(keys.toDF("_gone").distinct()))
    return docs.join(gone, row_key(docs) == gone["_gone"], "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest grade is at least as likely as not; all, if nothing is rated."""
    model = fit_grades(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rated_grade(), n_grades=3)
    return keep_graded(docs, model, KEEP_TAIL)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Texts without words and documents without an id are groups of their own. Of several texts
    under the smallest id of a group, each stays that has this id.
    """
    found = near_duplicates(docs, percent=80, row_key=row_key(docs))
    return _without(docs, found.where(~F.col("kept")).select("row_key"))


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    keyed = docs.select(row_key(docs).alias("_key"), "text")
    leaks = benchmark_overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="_key")
    return _without(docs, leaks.select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Equal rows cannot be told apart: each of them is taken as often as all can be, and one of
    them by what is left over.
    """
    keyed = docs.select(row_key(docs).alias("_key"), "text", "source")
    mixed = balance_sources(keyed, weights=(3.0, 1.0, 2.0), share=1.5, max_copies=2.0, id_column="_key")
    taken = Tables(spark).save(mixed.groupBy(F.col("doc_id").alias("_key")).agg(
        F.sum("copies").alias("_all"), F.count("*").alias("_rows")))
    copies = small(taken)
    columns = [docs[c] for c in docs.columns]
    joined = docs.join(copies, row_key(docs) == copies["_key"])

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return (rows.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
                .select(*docs.columns))

    every = repeated(joined.withColumn("_times", F.floor(F.col("_all") / F.col("_rows"))), F.col("_times"))
    left = joined.where(F.col("_all") % F.col("_rows") > 0).groupBy("_key").agg(
        F.first("_all").alias("_all"), F.first("_rows").alias("_rows"), F.first(F.struct(*columns)).alias("_row"))
    return every.unionByName(repeated(
        left.select("_row.*", (F.col("_all") % F.col("_rows")).alias("_times")), F.col("_times")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, read back: doc_id, start, n_tokens, ids_crc32 per document.

    Copies of a document stand next to each other.
    """
    files = write_token_files(docs, Tables(spark), "byte_bpe_50k.json", end_id=2)
    return read_token_files(files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_unseen),
    ("source_mix", mix_sources),
    ("token_files", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
