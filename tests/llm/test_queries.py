"""The registered queries on whole small tables against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import differences, duck, oracle_rows
from test_groups import brute_components, brute_nearest, water_level
from test_text_filters import brute_lines

import __spark_entry__ as entry
import corpus_pipeline
from nametrail.llm import queries as q
from nametrail.llm.common import tokenizer_path
from nametrail.llm.secrets import reference_spans
from nametrail.llm.token_prefix import counter

SF = "/root/testdata/sf0.001"


def table(name, columns, where="true"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet' where {where}").fetchall()


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id, text, source")


def rows(spark, name):
    return q.QUERIES[name](spark, SF).collect()


def test_all_queries_are_registered():
    assert set(q.QUERIES) <= set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n[: n.index("_") + 1] for n in q.QUERIES if n != "pipeline"}


def test_nearest(spark):
    vectors = table("embeddings", "vec_id, embedding")
    want, got = brute_nearest(vectors), defaultdict(dict)
    for r in rows(spark, "op1_nearest"):
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    known = {k: dict(v) for k, v in want.items()}
    hits = [i in known[k] for k, v in got.items() for i, _ in v.values()]
    assert np.mean(hits) >= 0.9
    for k, found in got.items():
        for i, score in found.values():
            assert known[k].get(i, score) == pytest.approx(score, abs=1e-12)


def test_revisits(spark):
    statement = entry.oracle_sql()["op2_revisits"]
    assert differences(q.op2_revisits(spark, SF), *oracle_rows(duck(SF), statement)) == []


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op3_near_dup")}
    assert got == brute_components([d[:2] for d in docs])


def test_token_counts(spark, docs):
    library = counter("piece_bpe_32k.model").library
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op4_token_counts")}
    assert got == {i: (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096)
                   for i, t, _ in docs}


def encoded(pairs):
    from tokenizers import Tokenizer

    library, start, out = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, []
    for doc_id, text in sorted(pairs):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs):
    assert sorted(map(tuple, rows(spark, "op5_token_files"))) == encoded([d[:2] for d in docs])


def test_quality(spark):
    got = {r.doc_id: r for r in rows(spark, "op6_quality")}
    labels = table("labels", "doc_id, quality, toxic")
    kept = defaultdict(list)
    for doc_id, quality, toxic in labels:
        kept[0 if toxic else 1 + quality].append(got[doc_id].keep)
    assert len(got) == len(table("documents", "doc_id"))
    assert np.mean(kept[2]) >= 0.97 and np.mean(kept[0] + kept[1]) <= 0.3


def test_line_dedup(spark, docs):
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest())
            for i, n, k, t in brute_lines([d[:2] for d in docs], 40, 5)]
    assert sorted(map(tuple, rows(spark, "op7_line_dedup"))) == want


def leaks(documents, items, size=13):
    grams = defaultdict(set)
    for item, text in items:
        words = text.lower().split()
        for k in range(len(words) - size + 1):
            grams[tuple(words[k : k + size])].add(item)
    found = set()
    for doc_id, text in documents:
        words = text.lower().split()
        for k in range(len(words) - size + 1):
            found |= {(doc_id, i) for i in grams.get(tuple(words[k : k + size]), ())}
    return found


def test_decontamination(spark, docs):
    got = rows(spark, "op8_decontaminate")
    want = leaks([d[:2] for d in docs], table("benchmark", "item_id, text"))
    assert want and want <= {(r.doc_id, r.item_id) for r in got}
    for r in got:
        assert r.n_words >= 13 and r.n_same >= 0.8 * r.n_words


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_secrets")}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        spans = reference_spans(text)
        counts = Counter(k for _, k, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def check_mix(got, sources, slack=0.02):
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[sources[r.doc_id]] += r.size
        taken[sources[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for source, target in water_level(sizes).items():
        assert abs(taken[source] - target) <= max(slack * target, 60)


def test_source_mix(spark, docs):
    got = rows(spark, "op10_source_mix")
    assert len(got) == len(docs)
    assert all(r.size == len(t.split()) for r, (_, t, _) in zip(
        sorted(got, key=lambda r: r.doc_id), sorted(docs)))
    check_mix(got, {i: s for i, _, s in docs})
    assert sorted(got) == sorted(rows(spark, "op10_source_mix"))


def test_pipeline_stage_by_stage(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "near_dedup", "decontamination", "source_mix", "token_files"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns

    def step(name):
        out = stages[name](spark, frame, SF)
        assert out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema)

    frame = step("quality_classifier")
    graded = {r.doc_id for r in rows(spark, "op6_quality") if r.keep}
    kept = {r.doc_id: r for r in frame.collect()}
    assert set(kept) == graded
    frame = step("near_dedup")
    want = {i for i, (_, c) in brute_components(
        [(i, r.text) for i, r in kept.items()], percent=80).items() if i == c}
    assert {r.doc_id for r in frame.collect()} == want
    frame = step("decontamination")
    found = leaks([(i, kept[i].text) for i in want], table("benchmark", "item_id, text"))
    clean = {r.doc_id for r in frame.collect()}
    assert clean <= want - {i for i, _ in found} and len(clean) >= len(want) - len(found) - 1
    frame = step("source_mix")
    copies = Counter(r.doc_id for r in frame.collect())
    sizes, taken = Counter(), Counter()
    for i in clean:
        sizes[kept[i].source] += len(kept[i].text.split())
        taken[kept[i].source] += copies[i] * len(kept[i].text.split())
    for source, target in water_level(sizes).items():
        assert abs(taken[source] - target) <= max(0.02 * target, 60)
    last = stages["token_files"](spark, frame, SF)
    assert sorted(map(tuple, last.collect())) == encoded(
        [(i, kept[i].text) for i, n in copies.items() for _ in range(n)])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_on_odd_tables(spark, make_docs, odd_rows):
    rows_ = [*odd_rows, (None, "some text of no id at all here", None)]
    for frame in (make_docs(rows_), make_docs([])):
        columns, n = frame.columns, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == columns, name
            frame = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
        assert (frame.count() > 0) == (n > 0)


def test_mix_goes_by_row(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows_ = [(None, " ".join(f"w{i}x{j}" for j in range(40 + i % 20)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows_ += [(7, "one text that is given nine times over", "en", "s0", 1)] * 9
    rows_ += [(8, f"several texts under one id number {i}", "en", "s1", 1) for i in range(9)]
    docs = spark.createDataFrame(rows_, schema).repartition(5)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    sizes = Counter()
    for r in rows_:
        sizes[r[3]] += len(r[1].split())
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    for source, target in water_level(sizes).items():
        assert abs(taken[source] - target) <= 60
    times, given = Counter(map(tuple, mixed)), Counter(rows_)
    assert all(times[r] <= 2 * n for r, n in given.items()) and set(times) <= set(given)


def test_one_of_several_texts_under_an_id_goes(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    copy, other = "a text of some ten words that is copied elsewhere too", "another text which has nothing in common"
    leak = table("benchmark", "text")[0][0]
    docs = spark.createDataFrame([(1, copy, "en", "s", 1), (2, copy, "en", "s", 1), (2, other, "en", "s", 1),
                                  (None, other + " again and again", "en", "s", 1)], schema)
    kept = corpus_pipeline.keep_distinct(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(
        [(1, copy), (2, other), (0, other + " again and again")])
    docs = spark.createDataFrame([(3, leak, "en", "s", 1), (3, other, "en", "s", 1), (None, leak, "en", "s", 1),
                                  (None, other, "en", "s", 1)], schema)
    kept = corpus_pipeline.keep_unseen(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(3, other), (0, other)])


def test_line_dedup_equals_its_statement(spark):
    assert differences(q.op7_line_dedup(spark, SF), *oracle_rows(duck(SF), q.OP7_SQL)) == []
