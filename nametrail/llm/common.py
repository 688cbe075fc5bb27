"""Helpers of the training-data operators: shared tables, Arrow batches, word hashes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy work takes at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 20
#: The separators of `[^\x20\x09-\x0D]+`.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, wherever the driver found it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if getattr(sc, "_nametrail_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="nametrail-")) / "nametrail.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "nametrail").rglob("*.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(str(archive))
    sc._nametrail_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: the session's checkpoint folder, or a new one where none is
    named and the session is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='nametrail-shared-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """Tables in the shared folder that cut lineage; `drop` deletes those no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/nametrail-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._nametrail_path = path
        return saved

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished work, which it does when their owners
        in the driver are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(df._nametrail_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids that are broadcast at most (a few tens of bytes each).
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of ids, marked for broadcast if a count shows it is small enough;
    else joins with it shuffle both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def chunks(batches: Iterator[pa.RecordBatch], column: str | int = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about `limit` bytes of text."""
    for batch in batches:
        sizes = lengths(batch.column(column))
        if not len(sizes):
            continue
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins (one more entry: the end)."""
    import pyarrow.compute as pc

    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    first = np.uint64((salt * 0x632BE59BD9B4E019) & _MASK)
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + first) | np.uint64(1)


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse; the longest array so far is kept."""
    known = _POWERS.get(inverse)
    if known is None or len(known) < n:
        base = np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE)
        size = 1 << max(20, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            known = _POWERS[inverse] = np.multiply.accumulate(np.full(size, base, np.uint64))
    return known[:n]


def _byte_tables(lower: bool, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    values, gap = mix64(np.arange(256, dtype=np.uint64) + np.uint64(12345)), np.zeros(256, bool)
    gap[list(SPACES)] = True
    if plain:
        gap[[b for b in range(128) if not chr(b).isalnum()]] = True
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values, gap


_TABLES = {(lower, plain): _byte_tables(lower, plain)
           for lower in (False, True) for plain in (False, True)}


def word_hashes(texts: pa.Array, lower: bool = True, plain: bool = False
                ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, and where each text's words begin.

    `lower` lower-cases A-Z; with `plain`, ASCII marks separate words as well.

    The hash is a polynomial in a fixed base over per-byte random numbers, so that one
    running sum over the bytes serves all words.
    """
    raw, at = text_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    values, gap = _TABLES[lower, plain]
    solid = ~gap[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[raw] * powers(n), out=total[1:])
        words = mix64((total[last + 1] - total[first]) * powers(n, inverse=True)[first]
                      + (last - first).astype(np.uint64))
    return words, np.searchsorted(first, at).astype(np.int64)


def binary_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; an existing path is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
