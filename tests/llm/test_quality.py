"""The cumulative-link fit against a plain dense solver, and grades against direct sums."""

import math

import numpy as np
import pyarrow as pa
import pytest

from nametrail.llm import queries as q
from nametrail.llm import quality

SF = "/root/testdata/sf0.001"


def dense_loss(theta, x, grades, n_grades, ridge):
    """Minus the log-likelihood of each row's grade, written out, plus the ridge."""
    weights, cuts = theta[: x.shape[1]], [theta[x.shape[1]]]
    for step in theta[x.shape[1] + 1 :]:
        cuts.append(cuts[-1] + math.exp(step))
    total = 0.5 * ridge * sum(w * w for w in weights)
    for row, grade in zip(x, grades):
        score = float(row @ weights)
        below = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
        total -= math.log(below[grade + 1] - below[grade])
    return total


def newton(loss, theta, step=1e-4):
    """Newton's method with differences for slopes and curvature."""
    n = len(theta)
    unit = np.eye(n) * step
    for _ in range(40):
        slope = np.array([(loss(theta + u) - loss(theta - u)) / (2 * step) for u in unit])
        curve = np.array([[(loss(theta + u + v) - loss(theta + u - v) - loss(theta - u + v)
                            + loss(theta - u - v)) / (4 * step * step) for v in unit] for u in unit])
        move = np.linalg.solve(curve + 1e-9 * np.eye(n), slope)
        size = 1.0
        while loss(theta - size * move) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-7:
            break
    return theta


@pytest.mark.parametrize("seed,n_grades", [(1, 3), (2, 3), (3, 4)])
def test_fit_equals_a_dense_solver(seed, n_grades):
    rng = np.random.default_rng(seed)
    x = (rng.random((80, 5)) < 0.4).astype(float)
    latent = x @ np.array([2.0, -1.5, 0.5, 0.0, 1.0]) + rng.logistic(size=80)
    grades = np.digitize(latent, np.linspace(-0.5, 2, n_grades - 1))
    rows, columns = np.nonzero(x)
    model = quality.fit_rows(rows, columns, grades, np.arange(5), n_grades, ridge=0.1)
    start = np.zeros(5 + n_grades - 1)
    start[5] = -1.0
    want = newton(lambda t: dense_loss(t, x, grades, n_grades, 0.1), start)
    cuts = want[5] + np.concatenate([[0.0], np.cumsum(np.exp(want[6:]))])
    assert np.abs(model.weights - want[:5]).max() < 0.02
    assert np.abs(model.thresholds - cuts).max() < 0.02


def test_query_equals_direct_sums(spark, monkeypatch):
    kept = {}
    plain = q.fit_grades

    def fit(*args, **limits):
        kept["model"] = plain(*args, **limits)
        return kept["model"]

    monkeypatch.setattr(q, "fit_grades", fit)
    got = {r.doc_id: r for r in q.op6_quality(spark, SF).collect()}
    model = kept["model"]
    weights = dict(zip(model.known.tolist(), model.weights.tolist()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and weights
    for doc in docs:
        _, feature = quality.features(pa.array([doc.text], pa.string()))
        score = math.fsum(weights.get(f, 0.0) for f in feature.tolist())
        tails = [1 - 1 / (1 + math.exp(score - t)) for t in model.thresholds]
        assert got[doc.doc_id].tail == pytest.approx(tails[-1], abs=1e-9)
        assert got[doc.doc_id].expected_grade == pytest.approx(math.fsum(tails), abs=1e-9)
        assert got[doc.doc_id].keep == (tails[-1] >= q.KEEP_TAIL)
