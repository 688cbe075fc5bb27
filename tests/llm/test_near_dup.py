"""Near-duplicates at the pipeline's threshold, and pairs that groups must not pass over."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_groups import brute_components

import corpus_pipeline
from nametrail.llm import near_dup
from nametrail.llm.near_dup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_links_at_80_percent(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, (_, c) in brute_components(rows, percent=80).items() if i == c}
    assert want != {i for i, (_, c) in brute_components(rows, percent=85).items() if i == c}
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, SF).collect()} == want


def group(signs, keys, i):
    """A group's table as `_links` and `_keep_similar` take it; all rows have the same set."""
    n = len(signs)
    return pa.table({
        "rep": pa.array(range(n), pa.int64()), "i": pa.array([i] * n, pa.int32()),
        "key": pa.array([7] * n, pa.int64()), "x": pa.array([0] * n, pa.int32()),
        "y": pa.array([0] * n, pa.int32()), "side": pa.array([0] * n, pa.int32()),
        "a": pa.array(list(keys), pa.list_(pa.int64())),
        "sketch": pa.array([s.astype("<u2").tobytes() for s in signs], pa.binary()),
        "shingles": pa.array([np.arange(50, dtype="<u8").tobytes()] * n, pa.binary()),
    })


def test_pair_whose_sketches_agree_before_its_first_shared_key():
    signs = np.zeros((2, near_dup._HASHES), np.uint16)  # as of very long texts
    keys = np.arange(2 * near_dup.TABLES, dtype=np.int64).reshape(2, -1)
    keys[:, 3] = keys[:, 5] = 7  # shared from table 3 on
    for i, found in ((3, 1), (5, 0)):
        table = group(signs, keys, i)
        assert near_dup._keep_similar(0.85)(table).num_rows == 2 * found
        assert near_dup._links(85)(table).num_rows == found


@pytest.mark.parametrize("percent, agreeing", [(85, 110), (80, 98)])
def test_pair_whose_sketches_agree_less_than_its_sets(percent, agreeing):
    signs = np.zeros((2, near_dup._HASHES), np.uint16)
    signs[1, : near_dup._HASHES - agreeing] = 1
    keys = np.full((2, near_dup.TABLES), 7, np.int64)
    assert near_dup._links(percent)(group(signs, keys, 0)).num_rows == 1


def test_id_with_two_texts_keeps_the_links_of_both(make_docs):
    texts = [" ".join(f"{name}{k}" for k in range(200)) for name in "abcdef"]
    ids = [(5, 2, 3), (7, 7, 8), (9, 6, 9)]
    rows = []
    for (named, one, two), first, second in zip(ids, texts[::2], texts[1::2]):
        rows += [(named, first), (named, second), (one, first + " end"), (two, second + " end")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows), percent=85).collect())
    assert got == [
        (2, 197, 2, True), (3, 197, 3, True), (5, 196, 2, False), (5, 196, 3, False),
        (6, 197, 6, True), (7, 196, 7, True), (7, 196, 7, True), (7, 197, 7, True),
        (8, 197, 7, False), (9, 196, 6, False), (9, 196, 9, True), (9, 197, 9, True)]
