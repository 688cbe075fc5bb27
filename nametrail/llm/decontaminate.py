"""Benchmark passages in documents, found by spaced seeds and proved word by word.

A seed is a fixed mask over word positions; words under a 0 may be anything. The hashes
of all seeds of the benchmark items meet those of the documents, every meeting names a
document, an item and how far they are shifted against each other, and along that shift
the words are compared: an overlap counts if it spans `min_words` words or more and at
least `min_same` of them are equal. The three standard masks together meet every stretch
of 13 words or more, of any length, that begins and ends with equal words and of which 80
percent are equal (tests/llm/test_decontaminate.py goes through all of them).

The benchmark is taken in blocks of bounded size; each block's hashes go to all executors
and meet the documents where these are read. Documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nametrail.llm.common import chunks, mix64, seeds, ship, word_hashes

#: Masks of six and five words; found by search for the cover named above.
MASKS = ("11101011", "11001000111", "110111")
MIN_WORDS = 13
MIN_SAME = 0.8
#: Words of benchmark items in one block, about.
BLOCK_WORDS = 500_000
#: Meetings looked at together.
MEETINGS = 1 << 18
_FILTER_BITS = 22


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's words at each position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    chosen = [i for i, bit in enumerate(mask) if bit == "1"]
    with np.errstate(over="ignore"):
        for i, factor in zip(chosen, seeds(len(chosen), salt=len(mask))):
            out += words[i : i + n] * factor
    return mix64(out)


def _fits(at: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of the first n positions lie `span` words before the end of their text."""
    ends = np.repeat(at[1:], np.diff(at))[:n]
    return np.arange(n) + span <= ends


@dataclass
class Block:
    """Benchmark items as word hashes, and for each mask its seeds: hashes in order and places."""

    item_ids: list
    at: np.ndarray
    words: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, item_ids: list, texts: list[str], masks: Sequence[str], min_words: int) -> Block:
        words, at = word_hashes(pa.array(texts, pa.string()))
        made = []
        long_enough = np.repeat(np.diff(at) >= min_words, np.diff(at))
        for mask in masks:
            hashes = seed_hashes(words, mask)
            place = np.flatnonzero(_fits(at, len(hashes), len(mask)) & long_enough[: len(hashes)])
            order = np.argsort(hashes[place], kind="stable")
            place = place[order]
            values, first = np.unique(hashes[place], return_index=True)
            made.append((values, np.append(first, len(place)), place))
        return cls(item_ids, at, words, made)

    def meetings(self, words: np.ndarray, at: np.ndarray, masks: Sequence[str]
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position among the words, position among the items' words) of equal seeds."""
        for mask, (values, first, place) in zip(masks, self.seeds):
            hashes = seed_hashes(words, mask)
            if not len(values) or not len(hashes):
                continue
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[values >> np.uint64(64 - _FILTER_BITS)] = True
            near = np.flatnonzero(sieve[hashes >> np.uint64(64 - _FILTER_BITS)])
            slot = np.minimum(np.searchsorted(values, hashes[near]), len(values) - 1)
            equal = values[slot] == hashes[near]
            near, slot = near[equal], slot[equal]
            inside = near + len(mask) <= at[np.searchsorted(at, near, "right")]
            near, slot = near[inside], slot[inside]
            times = first[slot + 1] - first[slot]
            begin = 0
            while begin < len(near):
                total = np.cumsum(times[begin:])
                end = begin + max(1, int(np.searchsorted(total, MEETINGS, "right")))
                own = times[begin:end]
                index = np.repeat(first[slot[begin:end]] - np.cumsum(own) + own, own) + np.arange(own.sum())
                yield np.repeat(near[begin:end], own), place[index]
                begin = end


def longest_overlap(same: np.ndarray, min_same: float) -> tuple[int, int]:
    """(start, end) of the longest stretch that begins and ends with equal words and of which
    at least `min_same` are equal; the first of equals, (0, 0) if there is none."""
    if not same.any():
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - min_same, -min_same))])
    at_end = np.where(np.concatenate([[False], same]), sums, -np.inf)
    later = np.maximum.accumulate(at_end[::-1])  # the highest from an end on, from the last one back
    starts = np.flatnonzero(same)
    ends = len(same) - np.searchsorted(later, sums[starts] - 1e-9, "left")
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


_ROW = ("doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, "
        "n_same bigint")


def _overlaps(block: Block, words: np.ndarray, at: np.ndarray, masks: Sequence[str],
              min_words: int, min_same: float) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """The longest proved overlap of each (text, item): (words, -start, item start, same)."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    seen: set[tuple[int, int, int]] = set()
    for here, there in block.meetings(words, at, masks):
        text = np.searchsorted(at, here, "right") - 1
        item = np.searchsorted(block.at, there, "right") - 1
        pairs = np.unique(np.column_stack([text, item, here - there]), axis=0)
        for t, i, shift in pairs.tolist():
            if (t, i, shift) in seen:
                continue
            seen.add((t, i, shift))
            low = max(int(at[t]), int(block.at[i]) + shift)
            high = min(int(at[t + 1]), int(block.at[i + 1]) + shift)
            same = words[low:high] == block.words[low - shift : high - shift]
            start, end = longest_overlap(same, min_same)
            if end - start >= min_words:
                found = (end - start, -(low + start - int(at[t])),
                         low + start - shift - int(block.at[i]), int(same[start:end].sum()))
                best[t, i] = max(best.get((t, i), found), found)
    return best


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS,
                       min_words: int = MIN_WORDS, min_same: float = MIN_SAME,
                       text: str = "text", id_column: str = "doc_id",
                       item_column: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, doc_start and
    item_start (in words), n_words, n_same: the longest overlap, the earliest of equals.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Items with fewer than `min_words` words
    prove nothing and are left out, as are null texts. Whole documents are searched; null and
    repeated ids are kept as they are; equal items give a row each. Other columns are left out.
    """
    ship(docs.sparkSession)
    masks = tuple(masks)
    context = docs.sparkSession.sparkContext
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part in chunks(batches):
                words, at = word_hashes(part.column("text"))
                if not len(words):
                    continue
                found = _overlaps(block, words, at, masks, min_words, min_same)
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], block.item_ids[i], -start, item_start, n, same)
                        for (t, i), (n, start, item_start, same) in sorted(found.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, pa.int64()) for column in zip(*rows)],
                        names=[c.split()[0] for c in _ROW.split(", ")])
        return run

    out = None
    for item_ids, texts in _item_blocks(benchmark, text, item_column):
        shared = context.broadcast(Block.build(item_ids, texts, masks, min_words))
        rows = chosen.mapInArrow(searcher(shared), _ROW)
        out = rows if out is None else out.unionByName(rows)
    return out


def _item_blocks(benchmark: DataFrame, text: str, item_column: str
                 ) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about BLOCK_WORDS words; at least one block."""
    ids, texts, words, first = [], [], 0, True
    rows = benchmark.where(benchmark[text].isNotNull()).select(
        benchmark[item_column].cast("bigint"), benchmark[text].cast("string"))
    for item, body in rows.toLocalIterator():
        if texts and words > BLOCK_WORDS:
            yield ids, texts
            ids, texts, words, first = [], [], 0, False
        ids.append(item)
        texts.append(body)
        words += len(body.split())
    if texts or first:
        yield ids, texts
