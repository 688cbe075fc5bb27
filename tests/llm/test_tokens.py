import random
import zlib

import numpy as np
import pytest

from nametrail.llm import token_files
from nametrail.llm.common import Tables, tokenizer_path
from nametrail.llm.token_files import BLOCK_IDS, encoder, pack, read_token_files, unpack, write_token_files
from nametrail.llm.token_prefix import (
    chars_in_budget, counter, prefix_token_counts, tokens_of_prefix)

PIECES = ["a", "b", " ", "  ", "\n", "▁", "é", "the", "ing", ".", ",", "\U0001f600", "'s", "1", "_", "<s>",
          "<|endoftext|>", "\t", "　", "\x1f", "12"]


def random_texts(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randrange(1, 30))) for _ in range(n)]


def test_every_prefix_has_the_librarys_count():
    made = counter("piece_bpe_32k.model")
    for text in random_texts(800, 1):
        steps = made.text_steps(text)
        counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=int)
        assert counts.tolist() == [len(made.library.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_budget_and_truncation():
    steps = counter("piece_bpe_32k.model").text_steps("The quick brown fox jumps over it")
    total = tokens_of_prefix(steps, 10**6)
    assert chars_in_budget(steps, total) == len("The quick brown fox jumps over it")
    for budget in range(total):
        n = chars_in_budget(steps, budget)
        assert tokens_of_prefix(steps, n) <= budget
    assert chars_in_budget(b"", 5) == 0 == tokens_of_prefix(b"", 5)


def test_prefix_counts_of_odd_documents(make_docs, odd_rows):
    library = counter("piece_bpe_32k.model").library
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in prefix_token_counts(make_docs(odd_rows)).collect())
    assert got == sorted((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in odd_rows)
    assert prefix_token_counts(make_docs([])).count() == 0
    assert prefix_token_counts(make_docs([(None, "a")])).first().doc_id is None


@pytest.mark.parametrize("top", [2, 50_257, 1 << 32, 1 << 60, 1 << 63])
@pytest.mark.parametrize("n", [0, 1, BLOCK_IDS - 1, BLOCK_IDS, BLOCK_IDS + 1, 3000])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64)
    ids[rng.random(n) < 0.7] >>= np.uint64(9)
    words, offsets = pack(ids)
    assert (unpack(words) == ids).all()
    for k in range(len(offsets) - 1):  # every block by itself
        block = ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS]
        assert (unpack(words[offsets[k] : offsets[k + 1]]) == block).all()


def test_simple8b_is_dense():
    words, _ = pack(np.ones(BLOCK_IDS, np.uint64))
    assert len(words) == 10  # 8 words of 60 ids, then 30 and 2


def test_words_have_the_ids_of_whole_texts():
    made = encoder("byte_bpe_50k.json")
    texts = ["", *random_texts(3000, 2)]
    whole = made.library.encode_batch(texts, add_special_tokens=False)
    assert made.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole]


def test_plain_words_skip_the_librarys_other_steps(monkeypatch):
    """Words of letters, with marks behind them or not, cost one call of the model each."""
    import tokenizers

    taken = []

    class Library:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **how):
            taken.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

        @classmethod
        def from_file(cls, path, load=tokenizers.Tokenizer.from_file):
            return cls(load(path))

    monkeypatch.setattr(tokenizers, "Tokenizer", Library)
    made = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["thonre été, Ωmega жук$$$\nanhe. thonre.%%%", "sttible\nathawh, it's x1"]
    whole = made.library.encode_batch(texts, add_special_tokens=False)
    taken.clear()
    assert made.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole]
    assert sorted(x for x in taken if any(c.isalnum() for c in x)) == [" it's", " x1"]


def test_letters_and_marks_have_the_librarys_ids():
    made = encoder("byte_bpe_50k.json")
    texts = [f"a {c}. x{c}, {c}y!\n{c}; z{c}??\nx{c} {c * 3}$$$$$$$$$" for c in token_files._LETTERS]
    texts += [f"a{m} a{m}{m} {m}a\na{m} a{m}a {m}" for m in "".join(map(chr, range(33, 127)))]
    whole = made.library.encode_batch(texts, add_special_tokens=False)
    assert made.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole]


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    made = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join(f"{'ab' * (i % 7)}c{'d' * i}." for i in range(300)), "x" * 5000 + " y"]
    whole = made.library.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert made.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in whole]
        assert len(made.known) <= 51 and sum(map(len, made.known)) <= 52 * 64 * token_files.CACHE_CHARS


def test_token_files_of_odd_documents(spark, make_docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    files = write_token_files(make_docs(odd_rows), Tables(spark))
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in read_token_files(files).collect())
    want, start = [], 0
    for doc_id, text in sorted(odd_rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert read_token_files(write_token_files(make_docs([]), Tables(spark))).count() == 0
