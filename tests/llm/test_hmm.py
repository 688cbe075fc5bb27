"""The hidden Markov model against sums over all paths, and its scores against plain recursion."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nametrail.llm import hmm
from nametrail.llm import queries as q
from nametrail.llm.common import Tables

SF = "/root/testdata/sf0.001"


def random_model(states, seed):
    rng = np.random.default_rng(seed)
    start, middle = rng.random(states), rng.random(states)
    moves, emits = rng.random((states, states)), rng.random((hmm.SYMBOLS, states))
    return hmm.Model(start / start.sum(), middle / middle.sum(), moves / moves.sum(1, keepdims=True),
                     emits / emits.sum(0))


def paths(model, symbols, start):
    """Probability of each path of states."""
    for path in product(range(len(start)), repeat=len(symbols)):
        p = start[path[0]]
        for a, b in zip(path, path[1:]):
            p *= model.moves[a, b]
        yield path, p * math.prod(model.emits[s, k] for s, k in zip(symbols, path))


SEQUENCES = [[3, 1, 4, 1, 5], [9], [2, 6], [5, 3, 5, 8]]


def test_forward_is_the_sum_over_all_paths():
    model = random_model(3, 1)
    got = hmm.forward_log10(model, np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES]))
    want = [math.log10(sum(p for _, p in paths(model, s, model.start))) for s in SEQUENCES]
    assert got == pytest.approx(want, abs=1e-12)


def test_expected_counts_are_those_of_all_paths():
    model, first = random_model(3, 2), np.array([True, False, True, False])
    got, want = hmm.Counts.none(3), hmm.Counts.none(3)
    hmm.forward_backward(model, np.concatenate(SEQUENCES), np.array([len(s) for s in SEQUENCES]), first, got)
    for symbols, begins in zip(SEQUENCES, first):
        every = list(paths(model, symbols, model.start if begins else model.middle))
        total = sum(p for _, p in every)
        for path, p in every:
            share = p / total
            for s, k in zip(symbols, path):
                want.emits[s, k] += share
                want.middle[k] += share
            for a, b in zip(path, path[1:]):
                want.moves[a, b] += share
            want.start[path[0]] += share * begins
    for name in ("emits", "moves", "start", "middle"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-12)


def test_rounds_raise_the_likelihood(spark, make_docs):
    texts = [" ".join((["ein", "der", "und"] if i % 2 else ["the", "and", "one"]) * (i % 7 + 1)) for i in range(40)]
    docs, tables = make_docs(list(enumerate(texts))), Tables(spark)
    hmm.ship(spark)
    corpus = hmm.count_words(docs, tables)
    symbols = hmm._with_ends(*hmm.tokens(pa.array(texts)))
    model, before = hmm.first_model(corpus, 3), -math.inf
    for _ in range(4):
        likelihood = hmm.forward_log10(model, *symbols).sum()
        assert likelihood > before - 1e-3
        before = likelihood
        model = hmm.improved(hmm.expected_counts(docs, model), corpus)


def words_of(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_scores(rows, corpus, model):
    """n_known, base_score and score of each (doc_id, held_out, text), word by word."""
    counts = Counter(w for _, held, t in rows if not held for w in [*words_of(t), ""])
    total, distinct = sum(counts.values()), len(counts)
    of = {w: hmm.END if w == "" else int(hmm._symbols(hmm.tokens(pa.array([w]))[0])[0]) for w in
          {w for _, _, t in rows for w in [*words_of(t), ""]}}
    in_bucket, kinds = Counter(), Counter()
    for w, n in counts.items():
        in_bucket[of[w]] += n
        kinds[of[w]] += 1
    d = corpus.discount
    unseen = np.zeros(len(model.start))
    for b in range(hmm.BUCKETS):
        unseen += model.emits[b] * (d * kinds[b] / in_bucket[b] if in_bucket[b] else 1)
    unseen += model.emits[hmm.UNSEEN]
    out = []
    for i, held, text in rows:
        state, score, base = model.start, 0.0, 0.0
        tokens = [*words_of(text), ""]
        for t, w in enumerate(tokens):
            state = (state @ model.moves if t else state)
            if w == "":
                state = state * model.emits[hmm.END]
            elif counts[w]:
                state = state * model.emits[of[w]] * (counts[w] - d) / in_bucket[of[w]]
            else:
                state = state * unseen
            score += math.log10(state.sum())
            state = state / state.sum()
            base += math.log10((counts[w] + 1) / (total + distinct + 1))
        out.append((i, held, len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    return out


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    return [(i, zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in rows]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_query_equals_plain_recursion(spark, documents, monkeypatch, frequent):
    kept = {}
    plain = hmm.train

    def train(*args):
        kept["trained"] = plain(*args)
        return kept["trained"]

    monkeypatch.setattr(hmm, "train", train)
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    got = sorted(q.op11_language_model(spark, SF).collect())
    corpus, model = kept["trained"]
    assert len(corpus.frequent) <= frequent
    want = plain_scores(documents, corpus, model)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [r.score for r in got] == pytest.approx([w[6] for w in want], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_all_words_add_up(spark, documents):
    tables = Tables(spark)
    hmm.ship(spark)
    docs = spark.createDataFrame([(i, t) for i, h, t in documents if not h], "doc_id bigint, text string")
    corpus, model = hmm.train(docs, tables, 4, 1)
    model = hmm.with_unseen(model, corpus)
    words = np.zeros(hmm.SYMBOLS)
    rows = corpus.words.toPandas()
    of = hmm._symbols(rows["h"].to_numpy().view(np.uint64))
    np.add.at(words, of, (rows["n"] - corpus.discount) / corpus.tokens[of])
    words[hmm.UNSEEN] = words[hmm.END] = 1
    assert words @ model.emits == pytest.approx(np.ones(4), rel=1e-6)


def test_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (None, "no id", None), (None, "no id", None)]
    docs = make_docs(rows)
    got = hmm.score_texts(docs, F.col("doc_id") % 2 == 0, states=2, rounds=1).collect()
    assert len(got) == len(rows) and sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(
        (i is None, i or 0) for i, *_ in rows)
    assert all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert [(r.n_tokens, r.n_known, r.held_out) for r in got if r.doc_id == 0] == [(1, 1, True)]
    alone = hmm.score_texts(docs, F.lit(True), states=2, rounds=1).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in alone)
    assert all(math.isfinite(r.score) for r in alone)
    assert hmm.score_texts(make_docs([]), F.lit(False), states=2, rounds=1).count() == 0


def test_expected_counts_add_up(spark, make_docs):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(500))) for i in range(20)]
    docs, tables = make_docs(rows), Tables(spark)
    hmm.ship(spark)
    corpus = hmm.count_words(docs, tables)
    counts = hmm.expected_counts(docs, hmm.first_model(corpus, 3))
    assert counts.emits.sum() == pytest.approx(20 * 501, rel=1e-4)
    assert counts.start.sum() == pytest.approx(20, rel=1e-4)
    assert counts.moves.sum() == pytest.approx(20 * 500, rel=1e-4)
