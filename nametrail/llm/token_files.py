"""Token ids of documents in Simple-8b words, written as tables and read back.

Format. One row per document, in ascending doc_id order over the files `part=00000`,
`part=00001`, ...: doc_id, `start` (ids before it in its part), `n_tokens`, `offsets`
and `words`. `words` holds little-endian unsigned 64-bit words. The top four bits of a
word are its selector, the other sixty hold as many ids as the selector says, the first
one lowest:

    selector  0   1   2   3   4   5  6  7  8  9  10  11  12  13
    ids      60  30  20  15  12  10  8  7  6  5   4   3   2   1
    bits      1   2   3   4   5   6  7  8 10 12  15  20  30  60

Selector 15 is the escape: its word holds the low 60 bits of one id too wide for any
selector, and the word behind it the rest. Blocks of BLOCK_IDS ids are packed each by
itself, and `offsets` holds where each block's words begin (little-endian unsigned 32
bit), so that any block can be decoded alone and all of them at once with array
operations.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, chunks, ship, tokenizer_path

# Fixed values of Simple-8b: ids in a word and bits of an id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
BLOCK_IDS = 512
#: Words whose ids a Python worker remembers before it starts anew; a longer one counts as
#: several, one of more than 64 times CACHE_CHARS is not kept.
CACHE_WORDS = 700_000
CACHE_CHARS = 48
#: Letters of Unicode 3.2 below U+0530, which are letters in every later version too.
_LETTERS = "".join(c for c in map(chr, range(0x530))
                   if c.isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L")
#: Letters behind at most one space, and marks behind them.
_MARKS = re.escape(string.punctuation)
_PLAIN = re.compile(f"( ?[{_LETTERS}]+)([{_MARKS}]{{0,8}})")
#: White space, as `str.split` sees it, but for space and line end.
_OTHER_SPACES = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]
_U = np.uint64


_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _best_selectors(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the selector of a word that begins there and stays before `ends`."""
    n = len(ids)
    if n and int(ids.max()) < len(_WIDTHS):
        most = _WIDTHS[ids]
    else:  # rounding may add a bit above 2^53, which is still a right choice
        most = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    room = np.minimum(ends - np.arange(n), COUNTS[0]).astype(np.uint8)
    best, span = np.full(n, ESCAPE, np.uint8), 1
    for selector in range(len(COUNTS) - 1, -1, -1):  # `most`: the widest of the next `span` ids
        count = int(COUNTS[selector])
        while span < count:
            step = min(span, count - span)
            if step < n:
                most[: n - step] = np.maximum(most[: n - step], most[step:])
            span += step
        np.copyto(best, np.uint8(selector), where=(most <= BITS[selector]) & (room >= count))
    return best


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and where each block's words begin (one more entry: the end)."""
    return pack_many(ids, np.array([0, len(ids)]), block)[:2]


def pack_many(ids: np.ndarray, starts: np.ndarray, block: int = BLOCK_IDS
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `pack` for several lists in one array; the third result is each list's first block.

    All blocks are packed in step: the k-th round places the k-th word of every block.
    """
    ids = np.ascontiguousarray(ids, _U)
    n_blocks = -(-np.diff(starts) // block)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
    begin = starts[owner] + (np.arange(len(owner)) - first_block[owner]) * block
    end = np.minimum(begin + block, starts[owner + 1])
    best = _best_selectors(ids, np.repeat(end, end - begin))
    taken = np.concatenate([COUNTS, [0, 1]])[best]
    live, at, marks = np.arange(len(begin)), begin.copy(), np.zeros(len(ids), bool)
    while len(live):
        here = at[live]
        marks[here] = True
        at[live] = here + taken[here]
        live = live[at[live] < end[live]]
    position = np.flatnonzero(marks)
    selector = best[position].astype(np.int64)
    sizes = 1 + (selector == ESCAPE)
    place = np.concatenate([[0], np.cumsum(sizes)])
    words = np.zeros(place[-1], _U)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            value = ids[position[rows]]
            words[place[rows]] = (value & _U((1 << 60) - 1)) | _U(ESCAPE << 60)
            words[place[rows] + 1] = value >> _U(60)
            continue
        word = np.full(len(rows), int(s) << 60, _U)
        for i in range(COUNTS[s]):
            word |= ids[position[rows] + i] << _U(i * BITS[s])
        words[place[rows]] = word
    return words, place[np.searchsorted(position, np.append(begin, len(ids)))], first_block


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, one after another."""
    words = np.ascontiguousarray(words, _U)
    selector = (words >> _U(60)).astype(np.int64)
    marks = np.flatnonzero(selector == ESCAPE)
    if len(marks):  # the word behind an escape is no word of its own
        behind = np.zeros(len(words), bool)
        for at in marks.tolist():
            if not behind[at]:
                behind[at + 1] = True
        high, kept = words[np.minimum(np.arange(len(words)) + 1, len(words) - 1)], ~behind
        words, selector, high = words[kept], selector[kept], high[kept]
    counts = np.concatenate([COUNTS, [0, 1]])[selector]
    place = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(place[-1], _U)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            ids[place[rows]] = (words[rows] & _U((1 << 60) - 1)) | (high[rows] << _U(60))
            continue
        mask = _U((1 << int(BITS[s])) - 1)
        for i in range(COUNTS[s]):
            ids[place[rows] + i] = (words[rows] >> _U(i * BITS[s])) & mask
    return ids


class WordIds(dict):
    """Ids of words with the white space before them, asked of the library when first met.

    Letters, with a space before them or not, are one pre-token, and the marks behind them are
    another. The library's model takes such pre-tokens without the steps before it, in the
    characters that stand for their bytes. Other words take all steps.
    """

    def __init__(self, library, plain: bool) -> None:
        super().__init__()
        self.library, self.plain, self.tokenize = library, plain, library.model.tokenize
        self.used = 0
        self.line_end, self.marks = self._encode("\n"), lru_cache(4096)(self._encode)
        self.shown = {ord(c): library.pre_tokenizer.pre_tokenize_str(c)[0][0]
                      for c in " " + _LETTERS} if plain else {}

    def _encode(self, text: str) -> bytes:
        done = self.library.encode_batch_fast([text], add_special_tokens=False)
        return array("I", done[0].ids).tobytes()

    def __missing__(self, key: str) -> bytes:
        behind_line = key[0] == "\n"
        text = key[1:] if behind_line else " " + key
        parts = _PLAIN.fullmatch(text) if self.plain else None
        if parts is None:
            ids = self._encode(text)
        elif parts[2]:
            ids = self[key[: -len(parts[2])]] + self.marks(parts[2])
            behind_line = False
        else:
            ids = array("I", [t.id for t in self.tokenize(text.translate(self.shown))]).tobytes()
        if behind_line:
            ids = self.line_end + ids
        if self.used >= CACHE_WORDS:
            self.clear()
            self.used = 0
        if len(key) <= 64 * CACHE_CHARS:
            self[key] = ids
            self.used += 1 + len(key) // CACHE_CHARS
        return ids


class WordEncoder:
    """A byte-level BPE tokenizer that remembers the ids of words.

    A single space between two characters that are no white space always begins a
    pre-token, and a single line end between two such is one by itself. So the ids of a text
    are those of its words, one after another, each with the space or line end before it. A
    text with any other white space goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        plan, added = self.library.pre_tokenizer, self.library.get_added_tokens_decoder().values()
        self.by_words = type(plan).__name__ == "ByteLevel" and self.library.normalizer is None
        #: Ids of words behind a space, and of words with the line end before them.
        self.known = WordIds(self.library, plain=self.by_words and not any(
            re.fullmatch(f"[{_LETTERS}]*[{_MARKS}]*", t.content) for t in added))
        self.head = len(self.known.line_end)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        known = self.known
        for i, text in enumerate(texts):
            if self.by_words and single_spaced(text):
                words = f"\n{text}".replace("\n", " \n").split(" ")[1:]
                out[i] = b"".join(map(known.__getitem__, words))[self.head :]
        whole = [i for i, x in enumerate(out) if x is None]
        done = self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
        for i, x in zip(whole, done):
            out[i] = array("I", x.ids).tobytes()
        return out


def single_spaced(text: str) -> bool:
    """Whether all white space of a text that is not empty is single spaces or line ends
    between other characters."""
    flat = text.replace("\n", " ")
    return (flat != "" and "  " not in flat and flat[0] != " " != flat[-1]
            and not any(c in flat for c in _OTHER_SPACES))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(tokenizer_path(path))


_FILE = ("part int, doc_id bigint, start bigint, n_tokens bigint, offsets binary, words binary")


def write_token_files(docs: DataFrame, tables: Tables, tokenizer: str = "byte_bpe_50k.json",
                      end_id: int = 2, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Encodes whole texts (null: empty), adds `end_id` to each, writes the files, and returns
    them as read from disk: part, doc_id, start (within the part), n_tokens, offsets, words.

    Documents are dealt by doc_id ranges, sorted, and encoded in order; null ids come first.
    Rows that repeat an id stand next to each other, those of equal text are interchangeable.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for rows in chunks(batches):
            ids = [x + end for x in made.encode([t or "" for t in rows.column("text").to_pylist()])]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            words, offsets, first = pack_many(np.frombuffer(b"".join(ids), "<u4"), at)
            raw = words.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows.num_rows, part, np.int32)),
                rows.column("doc_id"),
                pa.array(start + at[:-1]),
                pa.array(sizes),
                pa.array([(offsets[a : b + 1] - offsets[a]).astype("<u4").tobytes()
                          for a, b in zip(first[:-1], first[1:])], pa.binary()),
                pa.array([raw[8 * offsets[a] : 8 * offsets[b]]
                          for a, b in zip(first[:-1], first[1:])], pa.binary()),
            ], names=["part", "doc_id", "start", "n_tokens", "offsets", "words"])
            start += int(at[-1])

    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    ordered = (chosen.repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    return tables.save(ordered.mapInArrow(run, _FILE))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "words"):
            counts = rows.column("n_tokens").to_numpy(zero_copy_only=False)
            blocks = rows.column("words").to_pylist()
            ids = unpack(np.frombuffer(b"".join(blocks), "<u8")).astype("<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(counts)]) * 4
            if at[-1] != len(ids):
                raise ValueError("the words hold another number of ids than the file says")
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"),
                pa.array([ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
            ], names=["doc_id", "start", "n_tokens", "ids"])

    # One row per part; the sum over earlier parts is where a part begins.
    before = F.coalesce(F.sum("ids_in_part").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part")).select(
        F.col("part").alias("_part"), before.alias("base"))
    placed = files.join(F.broadcast(bases), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "words")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def crc_of_ids(ids: bytes) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers, as `F.crc32` gives it."""
    return zlib.crc32(ids)
