"""Spelling variants against a comparison of all pairs."""

import random

import numpy as np
import pytest
from compare import differences, duck, oracle_rows

from nametrail.llm import queries as q
from nametrail.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10, least_length=7, least_count=2):
    kept = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    out = {}
    for w, n in kept.items():
        near = [v for v in kept if one_edit(v, w)]
        best = min(near, key=lambda v: (-kept[v], v), default=None)
        form = best if best is not None and kept[best] >= ratio * n else None
        out[w] = [form, n, len(near), kept.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


def result(frame, **limits):
    rows = spelling.spelling_variants(frame, **limits).collect()
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def edited(rng, word, letters):
    i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind != 1) :]


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abc", 2), ("aé日\U0001f600", 3), ("qwertzuiop", 4)])
def test_all_near_words_are_found(spark, letters, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([7, 7, 8, 9, 12, 20])))
        counts[word] = rng.choice([2, 3, 40, 500, 7000])
        for _ in range(rng.randrange(8)):
            word = edited(rng, word, letters)
            counts[word] = rng.choice([1, 2, 3, 40, 500, 7000, 10**6])
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert result(frame) == brute(counts)


def test_words_about_the_length_of_halves(spark):
    rng = random.Random(6)
    counts = {}
    for size in range(61, 68):
        for word in ("x" * size, "xy" * (size // 2), "".join(rng.choice("ab") for _ in range(size))):
            for _ in range(4):
                counts[word] = rng.choice([2, 30, 400])
                word = edited(rng, word, "xy")
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert result(frame) == brute(counts)


def test_short_words(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 99)
              for _ in range(150)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert result(frame, ratio=2, least_length=4, least_count=1) == brute(counts, 2, 4, 1)


def test_pivots_are_the_rarest_apart():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, spelling.BUCKETS)
    for word in ("aaaaaaa", "abababab", "distinct", "wordsapart", "abcd"):
        grams = spelling.prefix_grams(word, counts)
        cost = {i: n for n, i in grams}
        pairs = [(cost[i] + cost[j]) for i in cost for j in cost if j >= i + 2]
        i, j = spelling.pivot_places(grams)
        assert j >= i + 2 and cost[i] + cost[j] == min(pairs)


def test_odd_rows(spark):
    long = "x" * 70_000
    rows = [(None, 5), ("", 9), ("lacking", None), ("variant", 2), ("variant", 1), ("variantt", 30),
            ("variants", 30), (long, 2), (long + "y", 20), ("\n\n\n\n\n\n\n\n", 2), ("tie\x00tie\x00", 2)]
    frame = spark.createDataFrame([(w, n, "x", "y", 1) for w, n in rows],
                                  "word string, n bigint, form string, root string, near int")
    got = result(frame)
    want = brute({"variant": 3, "variantt": 30, "variants": 30, long: 2, long + "y": 20,
                  "\n" * 8: 2, "tie\x00tie\x00": 2})
    assert got == want
    assert got["variant"] == ("variants", 3, 2, 30, "variants")
    assert result(frame.limit(0)) == {}
    for bad in ({"least_length": 3}, {"ratio": 1}):
        with pytest.raises(ValueError):
            result(frame, **bad)


def test_chains_of_forms(spark):
    word = "abcdefghij"
    counts = {word[:i] + "z" * (10 - i): 2 * 10**i for i in range(11)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = result(frame)
    assert got == brute(counts) and {r[-1] for r in got.values()} == {word}


def test_one_stem_for_many_words(spark):
    counts = {f"prefix{i:04d}": 2 + i % 60 for i in range(3000)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert result(frame) == brute(counts)


def test_words_of_documents(spark, make_docs, odd_rows):
    got = {r.word: r.n for r in q.letter_words(make_docs([*odd_rows, (None, "Nothing ÀÉÎÕÜàéî nothing")])).collect()}
    assert got["nothing"] + got.get("nothng", 0) >= 1 and "ÀÉÎÕÜàéî" in got
    assert q.letter_words(make_docs([])).count() == 0


def test_query_equals_its_statement(spark):
    assert differences(q.op12_spelling(spark, SF), *oracle_rows(duck(SF), q.OP12_SQL)) == []
