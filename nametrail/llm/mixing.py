"""Mixing sources to target weights by entropy balancing.

Each document is taken at a rate between 0 and `max_copies`. Among all rates that give
every source its target number of words, entropy balancing takes those nearest to one
copy each in relative entropy. Their form is known::

    rate = min(max_copies, exp(lambda_source * size / mean_size_source))

and the lambdas minimise a convex dual function whose gradient is the words at hand minus
the target. Newton's method finds them: each iteration is one distributed aggregation of
gradient and curvature, over the counts of (source, size) instead of single documents,
with an interval around each root that a step outside falls back into. Sums are exact
decimals, so reruns agree to the last digit.

Rates become whole copies by carrying the rounding error from one document to the next
one of like size, inside buckets of a few thousand documents that split large sources.
What a bucket still misses is made up for by single copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, ship, word_count

#: Documents of a source in one rounding bucket, about.
BUCKET_DOCS = 4096
#: The words of a source may miss the target by this share before rounding.
TOLERANCE = 1e-9
MAX_ITERATIONS = 80


def source_targets(totals: DataFrame, weights: Sequence[float], share: float,
                   max_copies: float) -> DataFrame:
    """Adds `s` (number of the source in code point order, null last), `weight` and `target`.

    `totals` has one row per source with `source` and `source_size`. Together the sources
    share `share` times all sizes by weight (the weights repeat in source order); a target
    stops at `max_copies` times its source's size and the rest is shared anew, which is
    min(max_copies * size, level * weight) at the one level that uses all up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "s")
    everything = Window.partitionBy()
    numbered = (
        totals.withColumn("s", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                                           (F.col("s") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("full_before", F.coalesce(
            F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(
            by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("full_before"))
                    / F.col("weight_left")))
    # The sources at or above the level where all is used up keep their share by weight.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    return (numbered.withColumn("level", level["level"])
            .withColumn("target", F.when(F.col("level").isNull(), F.col("most"))
                        .otherwise(F.least("most", F.col("level") * F.col("weight"))))
            .select("s", "source", "source_size", "n_docs", "weight", "target"))


def _tilt(strength: Column, size: Column, mean: Column, max_copies: float) -> Column:
    return F.exp(F.least(strength * size / mean, F.lit(math.log(max_copies))))


def solve_tilts(sizes: DataFrame, targets: list, max_copies: float) -> dict[int, float]:
    """The lambda of each source by safeguarded Newton iterations on the dual.

    `sizes` has (s, size, n); `targets` one row per source, the parameter vector of the
    problem. A source whose target is all it can give gets infinity, one with target 0
    minus infinity; such a source and one without words take no part.
    """
    spark = sizes.sparkSession
    tilts: dict[int, float] = {}
    state: dict[int, list[float]] = {}
    for row in targets:
        most = max_copies * row.source_size
        if row.source_size == 0:
            tilts[row.s] = 0.0
        elif row.target >= most * (1 - 1e-12):
            tilts[row.s] = math.inf
        elif row.target <= 0:
            tilts[row.s] = -math.inf
        else:
            state[row.s] = [0.0, -math.inf, math.inf]
    wanted = {row.s: row for row in targets}
    rate = _tilt(F.col("tilt"), F.col("size"), F.col("mean"), max_copies)
    exact = "decimal(38,6)"
    for _ in range(MAX_ITERATIONS):
        if not state:
            break
        asked = spark.createDataFrame(
            [(s, at[0], wanted[s].source_size / wanted[s].n_docs) for s, at in state.items()],
            "s int, tilt double, mean double")
        sums = sizes.join(asked, "s").groupBy("s").agg(
            F.sum((F.col("n") * F.col("size") * rate).cast(exact)).alias("words"),
            F.sum(F.when(rate < max_copies * (1 - 1e-12), F.col("n") * F.col("size")
                         * F.col("size") / F.col("mean") * rate).otherwise(0.0).cast(exact))
            .alias("slope"))
        for row in sums.collect():  # one row per source still moving
            at, low, high = state[row.s]
            excess, slope = float(row.words) - wanted[row.s].target, float(row.slope)
            if abs(excess) <= max(TOLERANCE * wanted[row.s].target, 1e-3):
                tilts[row.s] = at
                del state[row.s]
                continue
            low, high = (low, at) if excess > 0 else (at, high)
            step = at - excess / slope if slope > 0 else math.nan
            if not low < step < high:
                step = ((low + high) / 2 if math.isfinite(low + high)
                        else 2 * low + 1 if math.isinf(high) else 2 * high - 1)
            if step == at:
                tilts[row.s] = at
                del state[row.s]
            else:
                state[row.s] = [step, low, high]
    return tilts | {s: at[0] for s, at in state.items()}


def _rounder(most: int):
    """Copies, at most `most`, of the documents of one bucket. The rounding error goes on to
    the next smaller document; what is left at the end is made up for, the largest that fit
    first, by one copy more or less of a document."""

    def run(key, rows):
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        sizes, carried, copies = rows["size"].tolist(), 0.0, []
        for size, rate in zip(sizes, rows["rate"].tolist()):
            whole = math.floor(rate)
            carried += (rate - whole) * size
            extra = int(size > 0 and rate > whole and carried >= size / 2)
            carried -= extra * size
            copies.append(whole + extra)
        for i, size in enumerate(sizes):
            if 0 < size < 2 * abs(carried):
                change = 1 if carried > 0 else -1
                if 0 <= copies[i] + change <= most:
                    copies[i] += change
                    carried -= change * size
        return rows.assign(copies=copies)[["doc_id", "s", "size", "rate", "copies"]]

    return run


def balance_sources(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0),
                    share: float = 1.5, max_copies: float = 2.0, text: str = "text",
                    source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken.

    `size` counts the words of the whole text (null or empty: 0, never taken), `taken` is
    copies * size. Null sources are one source, the last. A document without words gets one
    copy. Repeated rows are mixed as documents of their own; those with the same id and size
    may differ in copies, in no order that matters. No documents: no rows. Other columns
    are left out.
    """
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    sized = tables.save(docs.select(
        docs[id_column].cast("bigint").alias("doc_id"), docs[source].alias("source"),
        word_count(docs[text]).alias("size")))
    counted = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = tables.save(source_targets(totals, weights, share, max_copies))
    known = targets.collect()  # one row per source
    named = targets.select("s", F.col("source").alias("_source"))
    tilts = solve_tilts(
        tables.save(counted.join(named, F.col("source").eqNullSafe(F.col("_source")))
                    .select("s", "size", "n")), known, max_copies)
    solved = docs.sparkSession.createDataFrame(
        [(row.s, row.source, row.source_size, row.target, row.n_docs,
          row.source_size / row.n_docs or 1.0, tilts[row.s]) for row in known],
        "s int, _source string, source_size bigint, target double, n_docs bigint, mean double, "
        "tilt double")
    rate = (F.when(F.col("size") == 0, 1.0)
            .when(F.col("tilt") == math.inf, float(max_copies))
            .when(F.col("tilt") == -math.inf, 0.0)
            .otherwise(_tilt(F.col("tilt"), F.col("size"), F.col("mean"), max_copies)))
    buckets = F.ceil(F.col("n_docs") / BUCKET_DOCS)
    rated = (
        sized.join(solved.drop("target", "source_size"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rate", rate)
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), buckets))
        .select("doc_id", "s", "size", "rate", "bucket"))
    rounded = rated.groupBy("s", "bucket").applyInPandas(
        _rounder(math.floor(max_copies)), "doc_id bigint, s int, size bigint, rate double, copies int")
    return (rounded.join(solved.select("s", "_source", "source_size", "target"), "s")
            .select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target",
                    "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))
