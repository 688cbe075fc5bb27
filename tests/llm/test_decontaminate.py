"""Overlaps with replaced words: what the masks reach, and the query against every diagonal."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest

from nametrail.llm import queries as q
from nametrail.llm.decontaminate import MASKS, benchmark_overlaps

SF = "/root/testdata/sf0.001"


def test_masks_meet_every_stretch_of_13_words_with_80_percent_equal():
    """States are the last 12 words (1 equal), an equal word counts 1 and another -4: 80 percent
    are equal if the sum is not below 0. Stretches that no mask meets are carried on, best sums only."""
    size, never = 1 << 12, -(10**9)
    window, state = np.arange(2 * size), np.arange(size) << 1
    met = np.zeros(2 * size, bool)
    for mask in MASKS:
        assert len(mask) <= 13
        met |= window & int(mask, 2) == int(mask, 2)
    free = ~met[state | 1]
    ahead = np.zeros(size, np.int64)  # the most that words still to come can add
    for _ in range(10_000):
        best = np.maximum(ahead[state & size - 1] - 4, np.where(free, ahead[(state | 1) & size - 1] + 1, never))
        if (np.maximum(best, 0) == ahead).all():
            break
        ahead = np.maximum(best, 0)
    else:
        pytest.fail("stretches of any length are not met")
    sums = np.full(size, never)
    sums[1] = 1
    for n in range(2, 10_000):
        after = np.full(size, never)
        np.maximum.at(after, state & size - 1, sums - 4)
        np.maximum.at(after, ((state | 1) & size - 1)[free], sums[free] + 1)
        sums = after
        assert n < 13 or sums[1::2].max() < 0, n
        if n >= 13 and (sums + ahead).max() < 0:
            return
    pytest.fail("no length from which on all stretches are met")


def test_overlap_between_the_former_masks(make_docs, spark):
    item = [f"w{k}" for k in range(15)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    text = " ".join("other" if k in (7, 8, 11) else w for k, w in enumerate(item))
    got = benchmark_overlaps(make_docs([(4, f"begin {text} end")]), items).collect()
    assert [tuple(r) for r in got] == [(4, 1, 1, 0, 15, 12)]


def every_overlap(docs, items):
    """(doc_id, item_id): length of the longest overlap, on all diagonals."""
    numbers = defaultdict(lambda: len(numbers))
    split = [(i, np.array([numbers[w] for w in t.encode().lower().split()], np.int64)) for i, t in items]
    found = {}
    for doc_id, text in docs:
        words = np.array([numbers[w] for w in text.encode().lower().split()], np.int64)
        for item_id, item in split:
            here, there = np.nonzero(words[:, None] == item)
            diagonals = defaultdict(list)
            for at, shift in zip(here.tolist(), (here - there).tolist()):
                diagonals[shift].append(at)
            for at in diagonals.values():
                for a in range(len(at) - 10):
                    for b in range(a + 10, len(at)):
                        n = at[b] - at[a] + 1
                        if n >= 13 and 5 * (b - a + 1) >= 4 * n:
                            found[doc_id, item_id] = max(n, found.get((doc_id, item_id), 0))
    return found


def test_query_against_every_diagonal(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = every_overlap(docs, items)
    assert want
    got = {(r.doc_id, r.item_id): r.n_words for r in q.op8_decontaminate(spark, SF).collect()}
    assert got == want
