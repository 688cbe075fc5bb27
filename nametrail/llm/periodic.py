"""Periodic runs of words, located by block convolutions.

A run is a stretch of words with a smallest period q, at least `least_exponent` times as
long as q, that no neighbouring word extends. For the dyadic block size B, periods from
(2B-1)/(e-1) to the next size's first one are sought (e: the least exponent): whatever its
alignment, such a run holds a whole block of the grid that recurs q words later inside the
run. The sum of squared differences between a block and all places of its following window
is a convolution; it is taken exactly in the integers modulo 65537, as a number-theoretic
transform. All blocks of a size, over all texts of a batch, go through the transform
together. A block recurs where the sum is zero. Sums that are zero only modulo 65537, or
because two words share a residue, are told apart afterwards.

Each such place gives a distance, and the distance seeds an extension to both sides: prefix
hashes find how far the words repeat, and every run that is kept is then compared word for
word. Stretches with the same ends are one run, with the smallest distance as its period.
Blocks deep inside a run already known can only find multiples of its period and are left
out. Work is n log n words a text plus what the seeds need, memory grows with the longest
text only; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nametrail.llm.common import chunks, mix64, powers, ship

#: The transform's modulus, a prime with roots of unity for all powers of two up to 65536,
#: and a generator of its units.
PRIME, GENERATOR = 65537, 3
#: Longest block that is transformed whole; of longer ones the first words are.
LONGEST_BLOCK = 1 << 15
#: Numbers that one step of the transform handles at a time.
SLICE = 1 << 17
#: Transforms up to this size are one product with the matrix of powers.
WHOLE_MATRIX = 64

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues nearest to zero, in place; exact below 2^53."""
    x -= np.rint(x * (1 / PRIME)) * PRIME
    return x


@lru_cache(maxsize=64)
def _matrix(size: int, inverse: bool, rows: int, columns: int) -> np.ndarray:
    """Powers root^(i*k) for i < rows and k < columns; root has order `size`."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    power = np.ones(size, np.int64)
    for i in range(1, size):
        power[i] = power[i - 1] * root % PRIME
    at = np.outer(np.arange(rows), np.arange(columns)) % size
    return _reduced(power[at].astype(np.float64))


def transform(x: np.ndarray, inverse: bool = False, keep: int | None = None) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two up to 65536 long), without the
    division by the length; `keep` numbers of each result are enough."""
    rows, size = x.shape
    keep = keep or size
    if size <= WHOLE_MATRIX:
        return _reduced(x @ _matrix(size, inverse, size, keep))
    # Two steps: n = right * n1 + n2 and k = k1 + left * k2.
    left = 1 << (size.bit_length() - 1) // 2
    right = size // left
    x = _reduced(np.matmul(_matrix(left, inverse, left, left), x.reshape(rows, left, right)))
    x = _reduced(x * _matrix(size, inverse, left, right))
    x = _reduced(np.matmul(x, _matrix(right, inverse, right, right)))
    return x.transpose(0, 2, 1).reshape(rows, size)[:, :keep]


def mismatches(blocks: np.ndarray, windows: np.ndarray, places: int) -> np.ndarray:
    """For each row, minus twice the products of the block with the window at the first
    `places` places, modulo PRIME. Windows are twice as long as blocks."""
    size = windows.shape[1]
    padded = np.zeros_like(windows)
    padded[:, : blocks.shape[1]] = blocks
    product = _reduced(transform(windows) * transform(padded, inverse=True))
    scale = -2 * pow(size, -1, PRIME) % PRIME
    return _reduced(transform(product, inverse=True, keep=places) * scale)


class _Words:
    """Word numbers of several texts one after another, longest text first."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
        #: Numbers modulo PRIME that stand for the words, and running sums of their squares.
        self.values = (mixed % np.uint64(PRIME)).astype(np.int64) - PRIME // 2
        self.squares = np.concatenate([[0], np.cumsum(self.values**2)])
        with np.errstate(over="ignore"):
            self.hashes = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(len(ids)))])

    def equal(self, at: np.ndarray, distance: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words at `at` and as many `distance` later have the same hash."""
        h = self.hashes
        with np.errstate(over="ignore"):
            return (h[at + size] - h[at]) * powers(len(h))[distance - 1] == (
                h[at + distance + size] - h[at + distance])

    def extend(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the stretch around `at` in which words `distance` apart have equal hashes."""
        first = self.ends[self.owner[at]] - self.sizes[self.owner[at]]

        def furthest(limit: np.ndarray, same) -> np.ndarray:
            low, high = np.zeros_like(limit), limit.copy()
            while (low < high).any():
                middle = (low + high + 1) >> 1
                right = same(middle)
                low, high = np.where(right, middle, low), np.where(right, high, middle - 1)
            return low

        after = furthest(self.ends[self.owner[at]] - at - distance, lambda n: self.equal(at, distance, n))
        before = furthest(at - first, lambda n: self.equal(at - n, distance, n))
        return at - before, at + after + distance

    def exact(self, at: int, start: int, end: int, distance: int) -> tuple[int, int]:
        """The same stretch by the words themselves, within the ends that the hashes gave."""
        same = self.ids[start : end - distance] == self.ids[start + distance : end]
        if same.all():
            return start, end
        wrong = np.flatnonzero(~same) + start
        before, after = wrong[wrong < at], wrong[wrong >= at]
        return (int(before[-1]) + 1 if len(before) else start,
                int(after[0]) + distance if len(after) else end)


def _seeds(words: _Words, block: int, low: int, high: int, covered: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the grid (by their first word) and the distances low .. high at which they recur.

    Of neighbouring blocks that recur at one distance, the first stands for all."""
    n = len(covered)
    size = min(block, LONGEST_BLOCK)
    at = np.arange(0, n - size, block)
    at = at[covered[at] < at + block + high]
    values = np.concatenate([words.values[:n], np.zeros(3 * size + high, np.int64)])
    squares = np.concatenate([words.squares[: n + 1], np.full(3 * size + high, words.squares[n])])
    found_at: list[np.ndarray] = []
    found: list[np.ndarray] = []
    step = max(1, SLICE // (2 * size))
    for k in range(0, len(at), step):
        mine = at[k : k + step]
        blocks = values[mine[:, None] + np.arange(size)].astype(np.float64)
        own = squares[mine + size] - squares[mine]
        for first in range(low, high + 1, size):
            places = min(size, high + 1 - first)
            near = np.minimum(mine + first, n)
            windows = values[near[:, None] + np.arange(2 * size)].astype(np.float64)
            place = near[:, None] + np.arange(places)
            total = own[:, None] + squares[place + size] - squares[place]
            total = (total % PRIME).astype(np.float64) + mismatches(blocks, windows, places)
            row, column = np.nonzero(_reduced(total) == 0)
            found_at.append(mine[row])
            found.append(first + column)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, distance = np.concatenate(found_at), np.concatenate(found)
    there = start + distance + size <= n
    start, distance = start[there], distance[there]
    good = (words.owner[start] == words.owner[start + distance]) & (
        covered[start] < start + block + distance)
    good[good] = words.equal(start[good], distance[good], np.full(int(good.sum()), size))
    start, distance = start[good], distance[good]
    # Neighbouring blocks that recur whole at one distance lie in one stretch.
    order = np.lexsort((start, distance))
    start, distance = start[order], distance[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(distance) != 0) | (np.diff(start) != size) | (
        np.diff(words.owner[start]) != 0)
    return start[first], distance[first]


def runs_of(ids: np.ndarray, sizes: np.ndarray, least_length: int = 6, least_exponent: int = 4
            ) -> tuple[np.ndarray, np.ndarray]:
    """Runs of texts whose word numbers stand one after another, longest text first.

    Returns the text of each run, and rows (start, length, period) by text, start, period.
    """
    words = _Words(ids, sizes)
    known: dict[tuple[int, int], int] = {}
    reach = np.zeros(len(ids), np.int64)
    block, spread = 1, least_exponent - 1
    while True:
        low, high = -(-(2 * block - 1) // spread), -(-(4 * block - 1) // spread) - 1
        n_texts = int(np.searchsorted(-sizes, -max(least_length, low * least_exponent), "right"))
        if not n_texts:
            break
        n = int(words.ends[n_texts - 1])
        at, distance = _seeds(words, block, low, high, np.maximum.accumulate(reach[:n]))
        if len(at):
            start, end = words.extend(at, distance)
            long = end - start >= np.maximum(least_length, least_exponent * distance)
            rows = np.stack([start, end, distance, at], 1)[long]
            if len(rows):
                _, first = np.unique(rows[:, :3], axis=0, return_index=True)
                for s, e, d, seed in rows[first].tolist():
                    if (s, e) in known:
                        continue  # with a smaller period
                    s, e = words.exact(seed, s, e, d)
                    if e - s >= max(least_length, least_exponent * d):
                        known[s, e] = min(d, known.get((s, e), d))
                        reach[s] = max(reach[s], e)
        block *= 2
    if not known:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    runs = np.array([(s, e - s, d) for (s, e), d in known.items()], np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = words.owner[runs[:, 0]]
    runs[:, 0] -= words.ends[owner] - words.sizes[owner]
    return owner, runs


def _of_batch(texts: list[str | None], least_length: int, least_exponent: int
              ) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of each text, and its runs."""
    split = [(t or "").encode().split() for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    flat = pa.array([w for i in order for w in split[i]], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, runs = runs_of(ids, np.array([len(split[i]) for i in order], np.int64),
                          least_length, least_exponent)
    ends = np.searchsorted(owner, np.arange(len(order) + 1))
    of_text: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(split)
    for k, i in enumerate(order):
        of_text[i] = runs[ends[k] : ends[k + 1]]
    return split, of_text


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4,
                  text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start, then period) and
    collapsed_text, which keeps of each run the first period only.

    Words are `[^\\x20\\x09-\\x0D]+`, compared byte for byte. Runs have at least `least_length`
    words and `least_exponent` (3 or more) periods. A null or empty text, or one of separators
    only, has no words, no runs and an empty collapsed text. Repeated rows, shared and null ids
    give a row each; other columns are left out.
    """
    if least_exponent < 3:
        raise ValueError("the least exponent is 3")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            split, runs = _of_batch(part.column("text").to_pylist(), least_length, least_exponent)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in runs],
                         _RUN_TYPE),
                pa.array([_collapsed(w, r) for w, r in zip(split, runs)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed_text"])

    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUN}, collapsed_text string")
