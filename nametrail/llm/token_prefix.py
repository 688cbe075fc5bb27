"""Exact token counts of every prefix of a text, by dynamic programming over pieces.

A byte-pair encoding is fixed by its neighbours: a sequence of pieces is the encoding of
its text exactly if each piece and each pair of neighbours encodes to itself. So of all
pieces that end at a position, one alone goes with the last piece of the prefix before
it, and the counts follow from left to right::

    count[i] = count[i - len(piece)] + 1        piece: the last one of prefix i

No piece of the model spans the beginning of a word, so the recurrence runs inside words
and a text's counts are its words' one after another. A word met before is not worked
out again. Each document gets one signed byte per code point: by how much the count of
the prefix that ends there exceeds that of the prefix before. Their running sum is the count of every prefix, which answers
truncation and budget questions without encoding anything again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nametrail.llm.common import chunks, ship, tokenizer_path

#: Words a Python worker remembers before it starts anew (about 200 bytes each).
CACHE_WORDS = 700_000
#: Longer words are worked out without being remembered.
CACHE_CHARS = 64
_SPACE = "\u2581"
#: Marks that may stand right behind a word.
_MARKS = ",.!?;:"


class PrefixCounter:
    """Prefix counts of a sentencepiece BPE model without normalisation of its own."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte,
                   self.library.is_unused)
        self.rank = {self.library.id_to_piece(i): -self.library.get_score(i) for i in range(size)
                     if not any(f(i) for f in special)}
        self.longest = max(map(len, self.rank))
        bad = [p for p in self.rank if _SPACE in p.lstrip(_SPACE) or "\n" in p]
        if bad:
            raise ValueError(f"pieces over the beginning of a word: {bad[:3]}")
        joined = {a + b for p in self.rank for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(m for m in _MARKS if not any(x[1] == m for x in joined))
        # Independent parts: a line end, a word of letters before a mark that no piece joins
        # to a letter, and else all up to the next space or line end.
        self.units = re.compile(
            f"{_SPACE}*[^\\W\\d_]+(?=[{_SPACE}\n{marks}]|\\Z)|{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n").findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        #: Pieces of several characters that encode to themselves.
        self.sound = {p for p in self.rank if len(p) > 1 and self.merged(p) == [p]}

    def merged(self, text: str) -> list[str]:
        """Encoding of a short text by merges, best rank first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def goes_with(self, left: str, right: str) -> bool:
        if len(self.pairs) > CACHE_WORDS:
            self.pairs.clear()
        good = self.merged(left + right) == [left, right] if left else True
        self.pairs[left, right] = good
        return good

    def steps(self, word: str) -> bytes:
        """By how many tokens each prefix of the word exceeds the one before, as signed bytes."""
        sound, pairs, reach = self.sound, self.pairs, self.longest
        last, count, steps = [""], [0], bytearray()
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - reach), i - 1):
                piece = word[j:i]
                if piece in sound:
                    left = last[j]
                    good = pairs.get((left, piece))
                    if good or good is None and self.goes_with(left, piece):
                        total = count[j] + 1
                        break
            else:  # a character the model does not know falls back to its bytes
                piece = word[i - 1]
                total = count[i - 1] + (1 if piece in self.rank else len(piece.encode()))
            steps.append((total - count[-1]) & 255)
            last.append(piece)
            count.append(total)
        return bytes(steps)

    def text_steps(self, text: str) -> bytes:
        """One signed byte for each code point of the text; the leading space the model adds
        is counted with the first code point."""
        if not text:
            return b""
        units, known = self.units(_SPACE + text.replace(" ", _SPACE)), self.words
        try:
            steps = b"".join([known[u] for u in units])
        except KeyError:
            if len(known) >= CACHE_WORDS:
                known.clear()
            parts = []
            for unit in units:
                part = known.get(unit)
                if part is None:
                    part = self.steps(unit)
                    if len(unit) <= CACHE_CHARS:
                        known[unit] = part
                parts.append(part)
            steps = b"".join(parts)
        head = np.frombuffer(steps[:2], np.int8)
        return np.int8(head.sum()).tobytes() + steps[2:]


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(tokenizer_path(model))


def prefix_token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model",
                        text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: id, `n_bytes`, `n_tokens`, and `steps`, the count of every prefix as
    signed byte differences by code point (see `tokens_of_prefix`, `chars_in_budget`).

    Whole texts, one pass, no shuffle. A null or empty text has 0 bytes, 0 tokens and empty
    steps. Rows repeat as they come; a null id stays null; other columns are left out.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(model)
        for part in chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            steps = [made.text_steps(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64()),
                pa.array(steps, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_tokens", "steps"])

    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, steps binary")


def tokens_of_prefix(steps: bytes, chars: int) -> int:
    """Tokens of the first `chars` code points of the text."""
    return int(np.frombuffer(steps, np.int8)[:chars].sum(dtype=np.int64))


def chars_in_budget(steps: bytes, tokens: int) -> int:
    """Code points of the longest prefix that takes at most `tokens` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= tokens)
    return int(fits[-1]) + 1 if len(fits) else 0
