import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nametrail.llm import lines as lines_module
from nametrail.llm.decontaminate import MASKS, Block, benchmark_overlaps, longest_overlap, seed_hashes
from nametrail.llm.lines import PerfectHash, drop_common_lines
from nametrail.llm.quality import _loss, fit_grades, grade_documents, keep_graded
from nametrail.llm.secrets import BASE_RULES, MORE_RULES, automaton, find_secrets, reference_spans

STRIP = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, chars, docs):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {lower(x.strip(STRIP)) for x in (text or "").split("\n")}:
            if len(key) >= chars:
                holders[key].append(doc_id)
    common = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if common.get(lower(x.strip(STRIP)), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_like_brute_force(make_docs, odd_rows):
    common = "A line that many of the documents hold é"
    rows = odd_rows + [(20 + i, f"own {i}\n  {common}\t\nend\n{common.replace('A', 'a')}") for i in range(7)]
    rows += [(40 + i, "é" * 39) for i in range(6)] + [(50 + i, "é" * 40) for i in range(6)]
    got = sorted(map(tuple, drop_common_lines(make_docs(rows)).collect()))
    assert got == brute_lines(rows, 40, 5)
    assert sum(r[2] for r in got) == 12 + 5
    assert drop_common_lines(make_docs([])).count() == 0


def test_lines_in_several_blocks_of_shards(make_docs, monkeypatch):
    monkeypatch.setattr(lines_module, "SHARD_KEYS", 4)
    monkeypatch.setattr(lines_module, "BLOCK_KEYS", 6)
    rows = [(i, "\n".join(f"line number {k} of a text that repeats" + "." * 9 for k in range(i % 30)))
            for i in range(90)]
    assert sorted(map(tuple, drop_common_lines(make_docs(rows)).collect())) == brute_lines(rows, 40, 5)


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(-2**63, 2**63 - 1, 50_000))
    made = PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert 8 * len(made.bits) < 6 * len(keys)
    assert len(PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def test_secrets_like_the_regular_expressions(make_docs, odd_rows):
    pick = random.Random(4)
    parts = ["token", "secret", "PassWord", "api_key", "APIkey", "=", ":", " ", "'", '"', "abc", "deadbeef",
             "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKL", "é", "\n", ",", "x-_.", "passwd", "a" * 9]
    rows = odd_rows + [(100 + i, "".join(pick.choice(parts) for _ in range(pick.randrange(1, 25))))
                       for i in range(3000)]
    base = {r.kind for r in BASE_RULES}
    got = sorted((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans if s.kind in base])
                 for r in find_secrets(make_docs(rows)).collect())
    want = sorted((i, [(a, k, b) for a, k, b in reference_spans(t or "")]) for i, t in rows)
    assert got == want
    assert sum(len(x) for _, x in got) > 500
    assert find_secrets(make_docs([])).count() == 0


def test_more_secrets_keep_the_base_ones(make_docs):
    text = "é ghp_" + "a1" * 18 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890 eyJa.eyJb.c"
    spans = find_secrets(make_docs([(1, text)])).first().spans
    assert [(s.kind, text[s.start : s.end][:4]) for s in spans] == [
        ("github", "ghp_"), ("hex", "a1a1"), ("private_key", "----"), ("slack", "xoxb"), ("jwt", "eyJa")]


def test_automaton_is_minimal_and_small():
    made = automaton(BASE_RULES + MORE_RULES)
    assert len(made.table) <= made.states_before < 1000
    rows = {(bool(made.flags[i]), int(made.flags[i]), tuple(r)) for i, r in enumerate(made.table.tolist())}
    assert len(rows) == len(made.table)


def test_masks_meet_all_replacements_they_promise():
    from itertools import combinations

    for words, replaced in ((13, 2), (16, 3)):
        placed = [{p + i for i, bit in enumerate(m) if bit == "1"}
                  for m in MASKS for p in range(words - len(m) + 1)]
        assert all(any(not mask & set(c) for mask in placed) for c in combinations(range(words), replaced))


def test_longest_overlap_like_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < 0.75
        start, end = longest_overlap(same, 0.8)
        spans = [b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                 if same[a:b].mean() >= 0.8 and same[a] and same[b - 1]]
        assert end - start == max(spans, default=0)
        assert end == start or same[start:end].mean() >= 0.8


def test_benchmark_passages_are_found_and_clean_texts_left(spark, make_docs, odd_rows):
    pick = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(pick.choice(vocabulary) for _ in range(30))) for i in range(40)]
    items += [(900, "too short"), (901, None), (902, "")]
    rows, want = list(odd_rows), set()
    for i in range(40):
        words = items[i][1].split()[5:25]
        for k in pick.sample(range(20), 3):
            words[k] = "other"
        filler = " ".join(pick.choice(vocabulary) for _ in range(50))
        rows.append((100 + i, f"{filler}\n{' '.join(words).upper()} {filler}"))
        want.add((100 + i, i))
    rows += [(200 + i, " ".join(pick.choice(vocabulary) for _ in range(300))) for i in range(40)]
    rows += [(None, items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in benchmark_overlaps(make_docs(rows), benchmark).collect()}
    assert set(got) == want | {(None, 3)}
    assert all(r.n_same >= 0.8 * r.n_words and r.n_words >= 13 for r in got.values())
    assert benchmark_overlaps(make_docs([]), benchmark).count() == 0
    assert benchmark_overlaps(make_docs(rows), benchmark.limit(0)).count() == 0


def test_seed_hashes_ignore_masked_words():
    words = np.arange(20, dtype=np.uint64)
    other = words.copy()
    other[3] = 99  # a 0 of the first mask at position 0
    assert seed_hashes(words, MASKS[0])[0] == seed_hashes(other, MASKS[0])[0]
    assert len(seed_hashes(words[:5], MASKS[0])) == 0
    assert Block.build([], [], MASKS, 13).item_ids == []


@pytest.fixture(scope="module")
def rated(spark, make_docs):
    pick = random.Random(7)
    vocabulary = [f"word{i}" for i in range(300)]

    def text(kind):
        words = [pick.choice(vocabulary) for _ in range(60)]
        if kind == 0:
            words[pick.randrange(60)] = pick.choice(["vile,", "Awful", "nasty."])
        if kind == 1:
            words = [w + "%%%" for w in words[:20]] * 3
        return " ".join(words)

    rows = [(i, text(i % 3)) for i in range(900)]
    ratings = spark.createDataFrame(
        [(i, i % 3) for i in range(600)] + [(1, None), (None, 2), (5000, 1), (2, 7)],
        "doc_id bigint, grade int")
    return rows, ratings


def test_grades_of_documents_not_fitted_on(make_docs, rated):
    rows, ratings = rated
    docs = make_docs(rows)
    model = fit_grades(docs, ratings, F.col("grade"), 3)
    got = {r.doc_id: r for r in grade_documents(docs, model).collect()}
    held = [got[i] for i in range(600, 900)]
    assert np.mean([abs(r.expected_grade - r.doc_id % 3) < 0.5 for r in held]) > 0.95
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in held)
    again = fit_grades(docs.repartition(7), ratings, F.col("grade"), 3)
    assert (again.weights == model.weights).all()


def test_grading_odd_documents(make_docs, odd_rows, rated):
    rows, ratings = rated
    docs = make_docs(rows)
    model = fit_grades(docs, ratings, F.col("grade"), 3)
    odd = make_docs([*odd_rows, (None, "word1")])
    graded = grade_documents(odd, model).collect()
    assert len(graded) == len(odd_rows) + 1 and all(r.tail is not None for r in graded)
    kept = keep_graded(odd, model, 0.5)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.tail >= 0.5 for r in graded)
    assert grade_documents(make_docs([]), model).count() == 0
    assert fit_grades(make_docs([]), ratings, F.col("grade"), 3) is None
    assert {r.tail for r in grade_documents(odd, None).collect()} == {None}
    assert keep_graded(odd, None, 0.5).count() == odd.count()


def test_loss_has_its_gradient():
    rng = np.random.default_rng(8)
    rows, columns = np.repeat(np.arange(30), 4), rng.integers(0, 6, 120)
    grades, theta = rng.integers(0, 4, 30), rng.normal(size=9) * 0.3
    _, gradient = _loss(theta, rows, columns, grades, 6, 0.5)
    for k, unit in enumerate(np.eye(9) * 1e-6):
        change = _loss(theta + unit, rows, columns, grades, 6, 0.5)[0] - _loss(
            theta - unit, rows, columns, grades, 6, 0.5)[0]
        assert abs(change / 2e-6 - gradient[k]) < 1e-4




def test_secrets_take_time_in_proportion():
    import time

    from nametrail.llm.secrets import BASE_RULES, MORE_RULES, automaton

    machine = automaton(BASE_RULES + MORE_RULES)
    for unit in ("eyJ", "AKIA", "password=", "-----BEGIN ", "xoxb-", "eyJa.", "token: "):
        lane = (unit * (1_000_000 // len(unit))).encode()
        begun = time.time()
        machine.matches(lane)
        assert time.time() - begun < 10, unit


def test_all_rules_match_leftmost_and_longest():
    import random
    import re

    from nametrail.llm.secrets import BASE_RULES, MORE_RULES, automaton

    rules = BASE_RULES + MORE_RULES
    machine = automaton(rules)
    plain = [re.compile(rule.pattern) for rule in rules]
    rng = random.Random(8)
    parts = ["eyJ", ".", "ey", "J", "aB3_", "-", "xoxb-", "ghp_", "0123456789abcdef", "AKIA", "Z9", "token", "=",
             ": ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "PRIVATE ", "password", "a" * 36, " "]
    for _ in range(3000):
        lane = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), n, m.end()) for n, p in enumerate(plain) for m in p.finditer(lane)]
        got = machine.matches(lane.encode())
        short = {n for n, rule in enumerate(rules) if rule.least > 1}
        assert [g for g in got if g[1] not in short] == [w for w in want if w[1] not in short]
        assert set(got) <= set(want)
