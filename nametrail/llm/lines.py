"""Dropping lines that many documents hold, by an indexed table of line hashes.

The distinct lines are counted by 128-bit hashes of their keys. Those found in enough
documents go into shards by hash, and each shard becomes a minimal perfect hash with
three arrays of its size: fingerprints, document counts and largest ids. The hash is a
cascade of bit arrays: a key's bit in the first array is set if no other key of the shard
falls on it, the others go on to the next array; a key's slot is the number of bits set
before its own. That takes about four bits a key. Documents then compute the slots of
their lines, compare fingerprints and read the arrays; no line is joined or shuffled. The
shards are handed out in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, chunks, mix64, seeds, ship

#: Keys in a shard, about.
SHARD_KEYS = 1 << 18
#: Keys whose arrays are handed to the executors at once: about 30 bytes each.
BLOCK_KEYS = 1 << 21
#: Bits of the cascade's arrays per key left.
SPREAD = 2.0
_STRIP = b" \t\n\x0b\x0c\r"
_LEVELS = seeds(64, salt=7)


def line_key(line: bytes) -> bytes:
    """A line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least


def _key_hashes(text: str, least: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The text's lines, the numbers of those long enough to count, and their hashes."""
    lines = text.encode().split(b"\n")
    numbers, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= least and _long_enough(key := line_key(line), least):
            numbers.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return lines, numbers, hashes


def _slots(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class PerfectHash:
    """Slots 0 .. n-1 for n distinct 64-bit keys; anything at all for other keys."""

    def __init__(self, bits: np.ndarray, levels: np.ndarray) -> None:
        #: One byte for eight positions; where each level's positions begin.
        self.bits, self.levels = bits, levels
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, parts, levels = keys.astype(np.uint64), [], [0]
        while len(left):
            if len(parts) == len(_LEVELS):
                raise ValueError("the keys are not distinct")
            size = -(-int(len(left) * SPREAD + 1) // 8) * 8
            at = cls._place(left, len(parts), size)
            times = np.bincount(at, minlength=size)
            parts.append(np.packbits(times == 1, bitorder="little"))
            levels.append(levels[-1] + size)
            left = left[times[at] > 1]
        return cls(np.concatenate(parts or [np.zeros(0, np.uint8)]), np.array(levels, np.int64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys * _LEVELS[level]) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some of the keys that are not in the set."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(len(self.levels) - 1):
            if not len(left):
                break
            size = int(self.levels[level + 1] - self.levels[level])
            at = self._place(keys[left], level, size) + self.levels[level]
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            there = (byte >> bit) & 1 == 1
            low = byte[there] & ((1 << bit[there].astype(np.int64)) - 1).astype(np.uint8)
            out[left[there]] = self.before[at[there] >> 3] + np.bitwise_count(low)
            left = left[~there]
        return out


@dataclass
class Shard:
    number: int
    slots: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    def look_up(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the shard, and the largest id holding each of those."""
        slot = self.slots.slots(first)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == second[known]
        return known, self.keepers[slot[known]]


_COUNTS = "first bigint, second bigint, n_docs bigint, keeper bigint"
_SHARDS = ("shard int, n_keys bigint, bits binary, levels binary, fingerprints binary, "
           "counts binary, keepers binary")


def count_lines(docs: DataFrame, least: int) -> DataFrame:
    """Distinct keys by hash: number of documents and largest id holding each.

    `docs` has doc_id and text. Batches are summed before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=8 << 20):
            hashes: list[bytes] = []
            ids: list[int] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                own = set(_key_hashes(text or "", least)[2])
                hashes.extend(own)
                ids.extend([np.iinfo(np.int64).min if doc_id is None else doc_id] * len(own))
            if not hashes:
                continue
            first, second = _slots(hashes)
            sums = pd.DataFrame({"first": first, "second": second, "keeper": ids}).groupby(
                ["first", "second"], sort=False)["keeper"].agg(["size", "max"]).reset_index()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums[c].to_numpy(np.int64)) for c in ("first", "second", "size", "max")],
                names=["first", "second", "n_docs", "keeper"])

    return docs.mapInArrow(run, _COUNTS).groupBy("first", "second").agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def build_shards(counted: DataFrame, n_shards: int) -> DataFrame:
    """A row of arrays for each shard of the counted lines."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["first"].to_numpy(np.int64)
        # Lines that share the first half of their hash cannot share a slot; the second
        # half of 128 bits then tells them apart, in a shard part of their own.
        order = np.lexsort((rows["second"].to_numpy(np.int64), first))
        rows, first = rows.iloc[order], first[order]
        turn = np.zeros(len(first), np.int64)
        for i in np.flatnonzero(np.diff(first) == 0):
            turn[i + 1] = turn[i] + 1
        out = []
        for k in range(turn.max() + 1):
            part = rows[turn == k]
            made = PerfectHash.build(part["first"].to_numpy(np.int64))
            slot = made.slots(part["first"].to_numpy(np.int64))
            arrays = []
            for column in ("second", "n_docs", "keeper"):
                values = np.empty(len(part), "<i8")
                values[slot] = part[column].to_numpy(np.int64)
                arrays.append(values.tobytes())
            out.append((int(part["shard"].iloc[0]), len(part), made.bits.tobytes(),
                        made.levels.astype("<i8").tobytes(), *arrays))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SHARDS.split(", ")])

    return (counted.withColumn("shard", F.pmod("second", F.lit(n_shards)).cast("int"))
            .groupBy("shard").applyInPandas(build, _SHARDS))


def _loaded(row) -> Shard:
    return Shard(
        row.shard, PerfectHash(np.frombuffer(row.bits, np.uint8), np.frombuffer(row.levels, "<i8")),
        *(np.frombuffer(x, "<i8") for x in (row.fingerprints, row.counts, row.keepers)))


def _blocks(shards: DataFrame) -> Iterator[list[Shard]]:
    """The shards in lists of bounded size; the driver never holds more than one list and a row."""
    block, keys = [], 0
    for row in shards.toLocalIterator():
        if block and keys + row.n_keys > BLOCK_KEYS:
            yield block
            block, keys = [], 0
        block.append(_loaded(row))
        keys += row.n_keys
    yield block


def drop_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5,
                      text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_lines (before), n_dropped, kept_text.

    Lines whose key has at least `least_chars` code points and is found in at least
    `least_docs` documents go, except in the document with the largest id that holds it
    (with repeated ids, in each such row). A null or empty text is one empty line. A null
    id is below all others. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"))
    common = tables.save(count_lines(chosen, least_chars).where(F.col("n_docs") >= least_docs))
    n_shards = max(1, -(-common.count() // SHARD_KEYS))
    shards = tables.save(build_shards(common, n_shards))

    def dropper(shared, earlier: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part in chunks(batches):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                split = [_key_hashes(t or "", least_chars) for t in texts]
                owner = np.repeat(np.arange(len(ids)), [len(n) for _, n, _ in split])
                number = np.array([i for _, n, _ in split for i in n], np.int64)
                doomed = np.zeros(len(owner), bool)
                if len(owner):
                    first, second = _slots([h for _, _, hashes in split for h in hashes])
                    own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids])[owner]
                    of_shard = second % n_shards
                    for shard in block:
                        mine = np.flatnonzero(of_shard == shard.number)
                        known, keeper = shard.look_up(first[mine], second[mine])
                        doomed[mine[known]] |= own[mine[known]] != keeper
                gone: list[set[int]] = [set() for _ in ids]
                if earlier:
                    for i, numbers in enumerate(part.column("gone").to_pylist()):
                        gone[i].update(numbers)
                for i, n in zip(owner[doomed].tolist(), number[doomed].tolist()):
                    gone[i].add(n)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text"),
                    pa.array([sorted(g) for g in gone], pa.list_(pa.int32())),
                ], names=["doc_id", "text", "gone"])
        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column("text").to_pylist()
            gone = part.column("gone").to_pylist()
            lines = [(t or "").split("\n") for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"),
                pa.array([len(x) for x in lines], pa.int64()),
                pa.array([len(g) for g in gone], pa.int64()),
                pa.array(["\n".join([x for i, x in enumerate(own) if i not in g]) if g else t or ""
                          for t, own, g in zip(texts, lines, map(set, gone))], pa.string()),
            ], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    marked = chosen
    for k, block in enumerate(_blocks(shards)):
        marked = marked.mapInArrow(dropper(spark.sparkContext.broadcast(block), k > 0),
                                   "doc_id bigint, text string, gone array<int>")
    return marked.mapInArrow(cut, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")
