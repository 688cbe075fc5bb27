"""Quality grades of documents by ordinal cumulative-link regression.

One latent score per document, the sum of weights of its hashed words and of a few hashed
measures of its form, meets ordered thresholds::

    P(grade <= k) = sigmoid(threshold[k] - score),  threshold[0] < threshold[1] < ...

All grades share the weights. The model gives an expected grade and the probability of the
upper grades. It is fitted on at most `max_rows` rated documents, those whose ids hash
lowest. Words seen in fewer than `min_docs` of them carry no weight, nor do words whose
documents' mean grade lies within `MIN_DEVIATION` standard errors of the overall mean:
most words say nothing about quality, and their weights would only be noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.llm.common import chunks, ship, text_bytes, word_hashes

#: Rated documents that the model is fitted on, at most.
MAX_ROWS = 20_000
MIN_DOCS = 5
#: Words hash to this many bits.
WORD_BITS = 30
MIN_DEVIATION = 4.0
RIDGE = 0.1
ROUNDS = 150
_FORM_BINS = 32
_FORM_BASE = 1 << (WORD_BITS + 1)


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: Kinds of bytes whose share is a measure of form.
_SHARES = (
    _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_set("0123456789"), _byte_set("!?"),
    _byte_set("#$%&*@^~+=<>"), _byte_set("|\t"), _byte_set(".,;:"), _byte_set("\n"),
    _byte_set(" "), _byte_set("/\\_{}[]()\"'"))


def _bin(share: np.ndarray) -> np.ndarray:
    """0 for nothing, then finer bins for smaller shares."""
    steps = np.floor(2 * np.log2(np.maximum(share, 2.0**-12))) + 25
    return np.where(share > 0, np.clip(steps, 1, _FORM_BINS - 1), 0).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) of all distinct features of the texts, in order."""
    n = len(texts)
    raw, at = text_bytes(texts)
    words, first = word_hashes(texts, plain=True)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashed = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    sizes, counts = np.maximum(np.diff(at), 1), np.diff(first)
    measures = []
    for chosen in _SHARES:
        total = np.concatenate([[0], np.cumsum(chosen[raw])])
        measures.append((total[at[1:]] - total[at[:-1]]) / sizes)
    repeated = np.zeros(len(words), bool)
    repeated[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.unique(owner << np.int64(WORD_BITS) | hashed)
    distinct = np.bincount(pairs >> WORD_BITS, minlength=n)
    measures.append(np.bincount(owner[repeated], minlength=n) / np.maximum(counts, 1))
    measures.append(1 - distinct / np.maximum(counts, 1))
    form = [_FORM_BASE + k * _FORM_BINS + _bin(m) for k, m in enumerate(measures)]
    form.append(_FORM_BASE + len(measures) * _FORM_BINS
                + np.minimum(np.log2(counts + 1), _FORM_BINS - 1).astype(np.int64))
    owners = np.concatenate([pairs >> WORD_BITS, np.tile(np.arange(n), len(form))])
    return owners, np.concatenate([pairs & ((1 << WORD_BITS) - 1), *form])


@dataclass
class CumulativeLink:
    """Weights by feature (in order) and thresholds between the grades 0 .. len(thresholds)."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, feature = features(texts)
        if not len(self.known):
            return np.zeros(len(texts))
        slot = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        weight = np.where(self.known[slot] == feature, self.weights[slot], 0.0)
        return np.bincount(owner, weights=weight, minlength=len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss(theta: np.ndarray, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray,
          n_weights: int, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood plus ridge, and its gradient. theta: weights, first threshold,
    logarithms of the distances between thresholds."""
    weights, first, gaps = theta[:n_weights], theta[n_weights], np.exp(theta[n_weights + 1 :])
    cuts = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
    score = np.bincount(rows, weights=weights[columns], minlength=len(grades))
    upper, lower = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
    chance = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
    by_score = up - low  # of the loss by the score
    by_cut = (np.bincount(grades + 1, weights=-up, minlength=len(cuts))
              + np.bincount(grades, weights=low, minlength=len(cuts)))[1:-1]
    gradient = np.concatenate([
        np.bincount(columns, weights=by_score[rows], minlength=n_weights) + ridge * weights,
        [by_cut.sum()], np.cumsum(by_cut[:0:-1])[::-1] * gaps])
    return float(-np.log(chance).sum() + 0.5 * ridge * weights @ weights), gradient


def _minimise(loss, theta: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, slope = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, kept = -slope, []
        for s, y, r in reversed(steps):
            a = r * (s @ direction)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y, _ = steps[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept)):
            direction = direction + s * (a - r * (y @ direction))
        size = 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).max()))
        fall = float(slope @ direction)
        for _ in range(30):
            there = theta + size * direction
            new_value, new_slope = loss(there)
            if new_value <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = there - theta, new_slope - slope
        if s @ y > 1e-10:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value <= 1e-7 * abs(value)
        theta, value, slope = there, new_value, new_slope
        if done:
            break
    return theta


def fit_rows(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, known: np.ndarray,
             n_grades: int, ridge: float = RIDGE) -> CumulativeLink:
    start = np.zeros(len(known) + n_grades - 1)
    start[len(known)] = -1.0
    theta = _minimise(lambda t: _loss(t, rows, columns, grades, len(known), ridge), start, ROUNDS)
    cuts = theta[len(known)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(known) + 1 :]))])
    return CumulativeLink(known, theta[: len(known)], cuts)


def fit_grades(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int,
               max_rows: int = MAX_ROWS, min_docs: int = MIN_DOCS, text: str = "text",
               id_column: str = "doc_id") -> CumulativeLink | None:
    """Fits on the documents that `ratings` (by the id column) grades 0 .. n_grades - 1.

    Null grades, and ratings without a document, are left out; None if nothing is left. The
    bound keeps what the driver gets (features, not texts) and the model small.
    """
    ship(docs.sparkSession)
    rated = (ratings.select(ratings[id_column].cast("bigint").alias("doc_id"),
                            grade.cast("int").alias("grade"))
             .where(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull())
             .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows))
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            owner, feature = features(part.column("text"))
            order = np.argsort(owner, kind="stable")
            at = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
            feature = feature[order].astype("<u4")
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("grade"),
                pa.array([feature[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
            ], names=["doc_id", "grade", "features"])

    # `rated` is broadcast: its size is bounded by max_rows.
    table = (chosen.join(F.broadcast(rated), "doc_id")
             .mapInArrow(run, "doc_id bigint, grade int, features binary").toArrow())
    if not table.num_rows:
        return None
    # Sums of floats depend on their order; the rows come in any.
    table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    rows_of = [np.frombuffer(x, "<u4") for x in table.column("features").to_pylist()]
    grades = table.column("grade").to_numpy().astype(np.int64)
    feature = np.concatenate(rows_of)
    rows = np.repeat(np.arange(len(rows_of)), [len(x) for x in rows_of])
    known, use, number = informative(feature, grades[rows], grades, min_docs)
    return fit_rows(rows[use], number, grades, known, n_grades)


def informative(feature: np.ndarray, graded: np.ndarray, grades: np.ndarray, min_docs: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that carry weight, which entries they are, and the number of each entry's.

    `graded` has the grade of the document of each entry.
    """
    known, slot, times = np.unique(feature, return_inverse=True, return_counts=True)
    sums = np.bincount(slot, weights=graded - grades.mean(), minlength=len(known))
    far = np.abs(sums) >= MIN_DEVIATION * max(grades.std(), 1e-9) * np.sqrt(times)
    kept = (times >= min_docs) & (far | (known >= _FORM_BASE))
    use = kept[slot]
    return known[kept].astype(np.int64), use, (np.cumsum(kept) - 1)[slot[use]]


def grade_documents(docs: DataFrame, model: CumulativeLink | None, text: str = "text",
                    id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, score, expected_grade, tail (probability of the highest grade).

    Whole texts, no shuffle; null texts count as empty, ids may be null or repeated. Without
    a model all three are null. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    if model is None:
        missing = F.lit(None).cast("double")
        return chosen.select("doc_id", missing.alias("score"), missing.alias("expected_grade"),
                             missing.alias("tail"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for part in chunks(batches):
            scores = made.scores(part.column("text"))
            tails = made.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array(tails.sum(axis=1)),
                 pa.array(tails[:, -1])], names=["doc_id", "score", "expected_grade", "tail"])

    return chosen.mapInArrow(run, "doc_id bigint, score double, expected_grade double, tail double")


def keep_graded(docs: DataFrame, model: CumulativeLink | None, least_tail: float,
                text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose highest grade has at least this probability.

    Every row is judged by its own text, whatever its id; without a model all stay.
    """
    if model is None:
        return docs
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for part in chunks(batches, place):
            tail = made.tails(made.scores(part.column(place)))[:, -1]
            yield part.filter(pa.array(tail >= least_tail))

    return docs.mapInArrow(run, docs.schema)
