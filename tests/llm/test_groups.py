import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nametrail.llm import ann, mixing, near_dup
from nametrail.llm.ann import cosines, nearest
from nametrail.llm.common import Tables
from nametrail.llm.components import components
from nametrail.llm.mixing import balance_sources
from nametrail.llm.near_dup import near_duplicates
from nametrail.llm.revisits import canonical_url, resolve_revisits


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else zip(*(words[i:] for i in range(5))))


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, n, pick):
    out = list(words)
    for _ in range(n):
        out[pick.randrange(len(out))] = f"new{pick.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    pick = random.Random(11)
    rows, doc_id = [], 1000
    for size in (2, 3, 5, 60):
        base = [f"w{pick.randrange(10**6)}" for _ in range(120)]
        for _ in range(size):
            rows.append((doc_id, edited(base, pick.randrange(5), pick)))
            doc_id += 1
    passage = [f"p{i}" for i in range(60)]
    for _ in range(80):  # share a passage, are not alike
        rows.append((doc_id, " ".join([*passage, *(f"w{pick.randrange(10**6)}" for _ in range(60))])))
        doc_id += 1
    rows += [(doc_id + i, "exact copy of one and the same text") for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates_like_brute_force(make_docs, odd_rows, copies, monkeypatch, block):
    monkeypatch.setattr(near_dup, "SKETCH_BLOCK", block)
    monkeypatch.setattr(near_dup, "SET_BLOCK", block)
    rows = odd_rows + copies
    got = near_duplicates(make_docs(rows), percent=85).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_ids_or_rows(make_docs):
    got = near_duplicates(make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None) == [
        (0, None, True), (2, None, True)]
    assert near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (2, 50), (3, 50), (4, 4)]
    got = {r.node: r.root for r in components(
        spark.createDataFrame(links, "u bigint, v bigint"), Tables(spark)).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 7: 5, 9: 5, 3: 2, 50: 2}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Tables(spark)).count() == 0


def water_level(sizes, share=1.5, cap=2.0):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in full]
        target = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return full | target
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def mix_rows():
    pick = random.Random(12)
    names = ["hot"] * 20 + ["a", "Z", "é", None, "b", ""]
    rows = [(i, " ".join(["w"] * min(1500, int(pick.paretovariate(1.1) * 20))), pick.choice(names)) for i in range(3000)]
    return rows + [(5000, None, "a"), (5001, "", None), (5002, " ", "only empty"), (7, "w w", "hot")]


def test_mix_meets_its_targets(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 200)
    rows = mix_rows()
    docs = make_docs(rows)
    got = balance_sources(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets = water_level(sizes)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(targets[r.source], rel=1e-9)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(0.01 * target, 60), source
    key = ["doc_id", "size", "rate", "taken"]
    again = balance_sources(docs.repartition(5)).select(*key).collect()
    assert sorted(again) == sorted((r.doc_id, r.size, r.rate, r.taken) for r in got)


def test_mix_rates_are_tilted_exponentially(make_docs):
    rows = [r for r in mix_rows() if r[2] == "hot"] + [(9000, "w " * 10, "a")]
    got = [r for r in balance_sources(make_docs(rows), weights=(1.0,), share=0.6).collect()
           if r.source == "hot" and r.size]
    slope = {round(float(np.log(r.rate) / r.size), 9) for r in got if 1e-9 < r.rate < 1.999}
    assert len(slope) == 1
    assert sum(r.rate * r.size for r in got) == pytest.approx(got[0].target, rel=1e-6)


def test_mix_of_nothing(make_docs):
    assert balance_sources(make_docs([])).count() == 0
    got = balance_sources(make_docs([(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def brute_nearest(vectors, every=50, count=5):
    ids, rows = zip(*vectors)
    matrix = np.array(rows, np.float64)
    out = {}
    for k, q in enumerate(ids):
        if q % every == 0:
            score = cosines(np.repeat(matrix[k : k + 1], len(ids), 0), matrix)
            order = sorted((-s, i) for i, s in zip(ids, score) if i != q)[:count]
            out[q] = [(i, -s) for s, i in order]
    return out


def test_nearest_vectors_and_copies(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(300)]  # a large group of copies
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [None, *[1.0] * 15]), (3003, [float("nan")] * 16),
           (3004, [float("inf"), *[1.0] * 15]), (3005, [1.0] * 3), (3006, []), (None, [1.0] * 16)]
    frame = spark.createDataFrame(
        [(i, v, "x", 1, "x") for i, v in rows + odd + rows[:20]],
        "vec_id bigint, embedding array<float>, id string, q int, label string").repartition(4)
    got = defaultdict(list)
    for r in sorted(nearest(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
        exact = dict(zip((i for i, _ in rows), (None for _ in rows)))
        assert all(i in exact for i, _ in found)
    assert hits / (5 * len(want)) >= 0.95
    assert [i for i, _ in got[50]] == [2000, 2001, 2002, 2003, 2004]


def test_nearest_of_few_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e-30, 1e-30]), (2, [0.0, 3e30])], schema)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(few).collect()]
    assert sorted(got) == [(0, 1, 1, 0.707107), (0, 2, 2, 0.0)]
    assert nearest(few.limit(0)).count() == 0
    assert nearest(few.where("vec_id = 0")).count() == 0


def test_nearest_in_shards_and_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_LEAST_ROWS", 200)
    rng = np.random.default_rng(14)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    rows += [(4000 + 50 * i, rows[7][1]) for i in range(12)]  # queries that are copies
    again = [rows[7]] * 4 + rows[100:103] * 9 + rows[-12:]
    frame = spark.createDataFrame(rows + again, "vec_id bigint, embedding array<double>").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("nearest", "nearest in shards")
    try:
        found = nearest(frame).collect()
        jobs = sc.statusTracker().getJobIdsForGroup("nearest")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 20  # rounds and steps of the search are none of their own
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = [i in dict(want[q]) for q, best in got.items() for i, _ in best]
    assert len(hits) == 5 * len(want) and np.mean(hits) >= 0.98
    assert all(got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) for q in got)
    assert [i for i, _ in got[4000]] == [7, 4050, 4100, 4150, 4200]
    assert [i for i, _ in got[4550]] == [7, 4000, 4050, 4100, 4150]
    for q, best in got.items():
        for i, score in best:
            assert dict(want[q]).get(i, score) == pytest.approx(score, abs=1e-12)


@pytest.mark.parametrize("rows", [1, 2, 20, 700])
def test_graph_of_a_shard_like_brute_force(rows):
    full = np.random.default_rng(15).normal(size=(rows, 13)).astype("<f4")
    shard = ann.Shard(full, np.arange(rows))
    graph = ann.build_graph(shard, 8)
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    want = np.argsort(-sims, axis=1)[:, : min(8, rows - 1)]
    lists = [row[row >= 0].tolist() for row in graph]
    assert all(len(set(x)) == len(x) == min(8, rows - 1) and k not in x for k, x in enumerate(lists))
    hits = [i in want[k] for k, x in enumerate(lists) for i in x]
    assert not hits or np.mean(hits) >= 0.95


RECORDS = "record_id bigint, url string, ts bigint, kind string, headers map<string,string>, target string"


def revisit_rows():
    etag = {"ETag": '"a"', "Content-Type": "text/html", "Date": "1", "Set-Cookie": "s"}
    return [
        (1, "http://Example.com/x/", 100, "response", etag, "?"),
        (2, "https://example.com:443/x?utm_source=f#top", 9000, "revisit",
         {"etag": 'W/"a"', "DATE": "2", "date": "3", "Content-Length": "0"}, "?"),
        (3, "http://example.com/x", 9000, "response", {"ETag": '"b"'}, "?"),
        (4, "http://example.com/x", 9000, "revisit", {"ETag": '"a"'}, "?"),
        (5, "http://example.com/x", 50, "revisit", {"ETag": '"a"'}, "?"),
        (6, "http://example.com/x", 99_000, "revisit", {"Last-Modified": "x"}, "?"),
        (7, None, 100, "revisit", None, "?"), (8, "http://example.com/x", None, "revisit", {}, "?"),
        (9, "http://example.com/y", 1, "request", {}, "?"),
        (10, "http://example.com/z", 1, "response", {"Last-Modified": "m", "Vary": "v"}, "?"),
        (11, "http://example.com/z", 2, "revisit", {"Last-Modified": "m", "Vary": None, "ETag": "q"}, "?"),
    ]


def test_revisits_are_checked_and_merged(spark):
    frame = spark.createDataFrame(revisit_rows(), RECORDS).repartition(3)
    got = {r.record_id: r for r in resolve_revisits(frame).collect()}
    assert {i: (r.response_id, r.verdict) for i, r in got.items()} == {
        2: (1, "matched"), 4: (3, "mismatched"), 5: (None, "missing"), 6: (3, "unchecked"),
        7: (None, "missing"), 8: (None, "missing"), 11: (10, "matched")}
    merged = {h.name: h.value for h in got[2].headers}
    assert merged == {"etag": 'W/"a"', "content-type": "text/html", "date": merged["date"],
                      "set-cookie": "s"}
    assert merged["date"] in ("2", "3") and len(got[2].headers) == 4
    assert {h.name for h in got[4].headers} == {"etag"}
    assert resolve_revisits(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seconds", [10, 3600])
def test_as_of_join_like_brute_force(spark, seconds):
    pick = random.Random(14)
    rows = [(i, pick.choice(["http://hot.example/a"] * 5 + [f"http://h{i % 9}.example/"]), pick.randrange(900),
             pick.choice(["response", "revisit"]), {}, "?") for i in range(2000)]
    got = {r.record_id: r.response_id for r in
           resolve_revisits(spark.createDataFrame(rows, RECORDS), seconds).collect()}
    for i, url, ts, kind, _, _ in rows:
        if kind == "revisit":
            before = [(t, j) for j, u, t, k, _, _ in rows if k == "response" and u == url and (t, j) < (ts, i)]
            assert got[i] == (max(before)[1] if before else None)


def test_canonical_urls(spark):
    urls = [("HTTP://WWW.Example.com:80/A/?b=1&utm_x=2&c=3#f", "www.example.com/A?b=1&c=3"),
            ("https://e.org/?ref=x", "e.org"), ("https://e.org/p.html?utm_source=feed", "e.org/p.html"),
            ("https://e.org", "e.org"), ("e", "e"), ("", ""), (None, None)]
    frame = spark.createDataFrame(urls, "url string, want string")
    assert frame.where(~canonical_url(F.col("url")).eqNullSafe(F.col("want"))).collect() == []


def test_repeated_records_are_resolved_once(spark):
    rows = [(1, "http://a.com/x", 10, "response", {"ETag": "t", "Server": "s"}, "?"),
            (2, "http://a.com/x", 20, "revisit", {"ETag": "t"}, "?")]
    once = resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert len(once) == 1 and once[0].verdict == "matched"
    assert resolve_revisits(spark.createDataFrame(rows * 2, RECORDS).repartition(3)).collect() == once
    other = (1, "http://a.com/x", 15, "response", {"ETag": "u"}, "?")
    assert resolve_revisits(spark.createDataFrame([*rows, other], RECORDS)).collect() == once
    nameless = (None, "http://a.com/x", 30, "revisit", {}, "?")
    got = resolve_revisits(spark.createDataFrame([*rows, nameless, nameless], RECORDS)).collect()
    assert sorted((r.record_id or 0, r.verdict) for r in got) == [(0, "missing"), (2, "matched")]


def test_most_revisits_have_several_earlier_responses(spark):
    from nametrail.llm.queries import page_captures

    records = page_captures(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).select(
        "url", "ts", "kind").collect()
    responses, revisits = {}, []
    for r in records:
        if r.kind == "response":
            responses.setdefault(r.url, []).append(r.ts)
        else:
            revisits.append((r.url.removesuffix("#again"), r.ts))
    several = sum(sum(t < ts for t in responses.get(url, [])) >= 2 for url, ts in revisits)
    assert several > len(revisits) / 2
