"""Periodic runs against a search of all periods."""

import random
import time

import numpy as np
import pytest
from compare import differences, duck, oracle_rows

from nametrail.llm import periodic
from nametrail.llm import queries as q

SF = "/root/testdata/sf0.001"


def brute_runs(words, least_length=6, least_exponent=4):
    best = {}
    for d in range(1, len(words) // least_exponent + 1):
        i = 0
        while i < len(words) - d:
            if words[i] != words[i + d]:
                i += 1
                continue
            j = i
            while j < len(words) - d and words[j] == words[j + d]:
                j += 1
            if j + d - i >= max(least_length, least_exponent * d):
                best.setdefault((i, j + d), d)
            i = j
    return sorted((s, e - s, d) for (s, e), d in best.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, d in runs for i in range(s + d, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts, *limits):
    return [[tuple(r) for r in runs.tolist()] for runs in periodic._of_batch(texts, *(limits or (6, 4)))[1]]


@pytest.mark.parametrize("bits", range(1, 17))
def test_transform_and_back(bits):
    x = np.random.default_rng(bits).integers(-30000, 30000, (2, 1 << bits)).astype(float)
    back = periodic.transform(periodic.transform(x.copy()), inverse=True)
    assert (periodic._reduced(back * pow(1 << bits, -1, periodic.PRIME) - x) == 0).all()


def test_squared_differences_are_exact():
    rng = np.random.default_rng(1)
    blocks, windows = (rng.integers(-50, 50, (3, n)).astype(float) for n in (64, 128))
    got = periodic.mismatches(blocks, windows, 65)
    want = [[-2 * (a * w[s : s + 64]).sum() for s in range(65)] for a, w in zip(blocks, windows)]
    assert (periodic._reduced(got - np.array(want)) == 0).all()


def stretched(rng, size, kinds):
    words = [str(rng.randrange(kinds)) for _ in range(size)]
    for _ in range(rng.randrange(4) if size else 0):
        start, period = rng.randrange(size), rng.randrange(1, max(2, size // 3))
        for i in range(start + period, min(size, start + period * rng.randrange(2, 12))):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    for _ in range(40):
        many = [stretched(rng, rng.choice([0, 1, 5, 6, 7, 30, 100, 400]), rng.choice([1, 2, 2, 3, 20]))
                for _ in range(rng.randrange(1, 12))]
        assert found([" ".join(w) for w in many]) == [brute_runs(w) for w in many]


@pytest.mark.parametrize("limits", [(6, 3), (3, 3), (20, 5)])
def test_other_limits(limits):
    rng = random.Random(9)
    many = [stretched(rng, 200, 2) for _ in range(20)]
    assert found([" ".join(w) for w in many], *limits) == [brute_runs(w, *limits) for w in many]


def test_words_that_share_a_residue(monkeypatch):
    monkeypatch.setattr(periodic, "mix64", lambda x: x % np.uint64(2))
    rng = random.Random(4)
    many = [stretched(rng, 300, 6) for _ in range(10)]
    assert found([" ".join(w) for w in many]) == [brute_runs(w) for w in many]


def test_long_texts_in_short_time():
    assert found(["a " * 3])[0] == []
    begun = time.time()
    assert found(["a " * 300_000])[0] == [(0, 300_000, 1)]
    far = [str(i % 70_000) for i in range(300_000)]
    assert found([" ".join(far)])[0] == [(0, 300_000, 70_000)]
    never = ["01"[i.bit_count() & 1] for i in range(1 << 16)]
    assert found([" ".join(never)])[0] == []
    assert time.time() - begun < 30


def test_operator_on_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (None, "a b a b a b a b c"), (None, "a b a b a b a b c")]
    got = periodic.periodic_runs(make_docs(rows)).collect()
    want = []
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        runs = brute_runs(words) if len(words) < 5000 else []
        want.append((i, len(words), runs, brute_collapsed(words, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got),
                  key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(make_docs([]), least_exponent=2)


def test_query_equals_its_statement(spark):
    assert differences(q.op13_periodic_runs(spark, SF), *oracle_rows(duck(SF), q.OP13_SQL)) == []


def test_query_on_odd_ids(spark, make_docs, odd_rows):
    rows = [*odd_rows, (None, "no id"), *((i, f"a b c d e f g {i} h i j k l m") for i in range(100, 160))]
    got = {r.doc_id: r.text for r in q.stretched(make_docs(rows)).collect()}
    assert got[0] is None and got[None] == "no id"
    assert any(len(set(got[i].split())) < len(got[i].split()) for i in range(100, 160))
