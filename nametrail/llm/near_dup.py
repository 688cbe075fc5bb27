"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two collections of `TABLES` small keys are computed for each document, each key of
`ROWS` minhashes. Every pair of a key from the first and one from the second collection
is a table key: TABLES * TABLES tables with keys of 2 * ROWS minhashes from only
2 * TABLES * ROWS minhashes. Two documents are candidates if they share a table key, that
is, one key of either collection. So documents are grouped by the keys of the first
collection, and inside a group the keys of the second complete the pair.

At similarity s the tables miss a pair with probability 2 * (1 - s**4)**20 at most: 0.000053
at 0.80, 0.00000078 at 0.85. The sketches, which let a pair pass if `SLACK` standard deviations
below the similarity or less, miss 0.00000001 or 0.00000002 more (the binomial tail): 0.000053
and 0.0000008 in all.

Steps: documents with equal sets count once; groups of one are dropped by counts; inside
a group candidates whose sketches agree too little are passed over; the sets of the others
are compared in full, most alike first, and a pair already linked is not compared again.
Only links that join something are written. Groups of any size are dealt to tasks in pairs
of blocks, so no task holds more than two blocks. Components of the links give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, chunks, mix64, seeds, ship, small, word_hashes
from nametrail.llm.components import components

SHINGLE = 5
TABLES = 20
ROWS = 4
#: Documents of a group in one block: where sketches meet, and where sets do.
SKETCH_BLOCK = 256
SET_BLOCK = 256
#: Sketches may fall short of the similarity by this many standard deviations.
SLACK = 6.0
_HASHES = 2 * TABLES * ROWS
_SALT = np.uint64(0xA0761D6478BD642F)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in order, and where each text's begin.

    A text with fewer words has one shingle, the whole sequence; without words it has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = np.maximum(len(words) - size + 1, 0)
    factors = seeds(size, salt=3)
    with np.errstate(over="ignore"):
        grams = np.zeros(whole, np.uint64)
        for k in range(size):
            grams += words[k : k + whole] * factors[k]
        inside = np.arange(whole) + size <= at[1:][owner[:whole]] if whole else np.zeros(0, bool)
        owners, hashes = [owner[:whole][inside]], [mix64(grams[inside])]
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            own = words[at[i] : at[i + 1]]
            owners.append(np.array([i]))
            hashes.append(mix64((own * factors[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
    owner, grams = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    owner, grams = owner[fresh], grams[fresh]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1))


def _segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return total[at[1:]] - total[at[:-1]]


def _set_hashes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's 128-bit hash."""
    with np.errstate(over="ignore"):
        return tuple(_segment_sums(mix64(grams ^ s), at).view(np.int64) for s in (_SALT, ~_SALT))


_FACTORS = (seeds(_HASHES, salt=11) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (seeds(_HASHES, salt=13) >> np.uint64(17)).astype(np.uint32)


def minhashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minhashes of the texts that have shingles, a row each."""
    high = (grams >> np.uint64(32)).astype(np.uint32)
    begin = at[:-1][np.diff(at) > 0]
    out, work = np.empty((len(begin), _HASHES), np.uint32), np.empty_like(high)
    with np.errstate(over="ignore"):
        for k in range(_HASHES):
            np.multiply(high, _FACTORS[k], out=work)
            np.add(work, _SHIFTS[k], out=work)
            out[:, k] = np.minimum.reduceat(work, begin)
    return out


_SKETCH = ("doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, a array<bigint>, "
           "b array<bigint>, sketch binary")


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: size and 128-bit hash of its set, the keys of both collections, and
    16 bits of each minhash. `docs` has doc_id and text, and maybe row_key, which goes along."""
    along = [c for c in docs.columns if c == "row_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(ROWS, salt=5)
        for part in chunks(batches):
            grams, at = shingles(part.column("text"))
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            first, second = _set_hashes(grams, at)
            with np.errstate(over="ignore"):
                signs = minhashes(grams, at) if len(full) else np.zeros((0, _HASHES), np.uint32)
                keys = mix64((signs.reshape(len(full), 2 * TABLES, ROWS).astype(np.uint64)
                              * factors).sum(axis=2, dtype=np.uint64)).view(np.int64)
            low = (signs >> np.uint32(8)).astype("<u2")
            a, b, sketch = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
            for i, row, own in zip(full.tolist(), keys, low):
                a[i], b[i], sketch[i] = row[:TABLES], row[TABLES:], own.tobytes()
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(first),
                pa.array(second), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())),
                pa.array(sketch, pa.binary()), *(part.column(c) for c in along),
            ], names=[*(c.split()[0] for c in _SKETCH.split(", ")), *along])

    return docs.mapInArrow(run, ", ".join([_SKETCH, *(f"{c} bigint" for c in along)]))


def _live(keys: DataFrame) -> DataFrame:
    """The rows (rep, i, key) whose key others have too."""
    shared = keys.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(shared, ["i", "key"])


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Deals the rows of each group (i, key) of `n` to all pairs of its blocks: adds x, y, side.

    A pair of blocks x <= y is one task's group; `side` is the block of the row.
    """
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    return (rows.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
            .drop("other"))


def _pairs(signs: np.ndarray, keys: np.ndarray, i: int, side: np.ndarray, x: int, y: int,
           threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, agreement) of the group's candidates that are this group's to compare.

    Candidates share a key of the second collection. A pair belongs to the group of the first
    key of the first collection (`keys`, which groups are made by) that it shares, and to the
    pair of blocks it lies in. Sketches of long texts agree by chance too often to tell that.
    """
    n = len(signs)
    bands = np.ascontiguousarray(signs).view("<u8").reshape(n, 2 * TABLES)  # four 16-bit parts each
    found = []
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / _HASHES)
    for u in range(n - 1):
        rest = np.arange(u + 1, n)
        if x != y:
            rest = rest[side[rest] != side[u]]
        same = (bands[rest, TABLES:] == bands[u, TABLES:]).any(axis=1)
        rest = rest[same]
        if i and len(rest):
            rest = rest[~(keys[rest, :i] == keys[u, :i]).any(axis=1)]
        if len(rest):
            alike = (signs[rest] == signs[u]).mean(axis=1)
            kept = alike >= least
            found.append((np.full(kept.sum(), u), rest[kept], alike[kept]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def _signs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and keys of the first collection, a row per row of the table."""
    sketch, n = table.column("sketch").to_pylist(), table.num_rows
    return (np.frombuffer(b"".join(sketch), "<u2").reshape(n, _HASHES),
            table.column("a").combine_chunks().flatten().to_numpy().reshape(n, TABLES))


def _keep_similar(threshold: float):
    """Of each dealt group the rows that have a candidate worth a full comparison."""

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        u, v, _ = _pairs(*_signs(table), table.column("i")[0].as_py(), table.column("side").to_numpy(),
                         x, y, threshold)
        return table.select(["rep", "i", "key"]).take(pa.array(np.union1d(u, v)))

    return run


class _Sets:
    """Intersections of sets of hashes, as bits over the hashes that several sets hold."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        joined = np.concatenate(sets)
        _, slot, times = np.unique(joined, return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        width = int(shared.sum()) // 64 + 1
        self.bits = np.zeros((len(sets), width), np.uint64)
        owner, slot = np.repeat(np.arange(len(sets)), self.sizes), slot.reshape(-1)
        use = shared[slot]
        owner, at = owner[use], place[slot[use]]
        np.bitwise_or.at(self.bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def linked(self, u: int, v: int, percent: int) -> bool:
        both = int(np.bitwise_count(self.bits[u] & self.bits[v]).sum())
        return 100 * both >= percent * (int(self.sizes[u]) + int(self.sizes[v]) - both)


def _links(percent: int):
    """Links of a dealt group that join something in it, compared on full sets."""

    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_pylist()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        u, v, alike = _pairs(*_signs(table), table.column("i")[0].as_py(),
                             table.column("side").to_numpy(), x, y, percent / 100)
        sets = _Sets([np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()])
        root = list(range(len(reps)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for k in np.argsort(-alike, kind="stable").tolist():
            a, b = find(int(u[k])), find(int(v[k]))
            if a != b and sets.linked(int(u[k]), int(v[k]), percent):
                root[a] = b
                out.append((reps[u[k]], reps[v[k]]))
        columns = list(zip(*out)) or [[], []]
        return pa.table({"u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64())})

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the sets in the saved table `wanted` (rep, h1, h2, named), each from
    a document with the id `named` whose set has this hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            grams, at = shingles(part.column("text"))
            first, second = _set_hashes(grams, at)
            own = np.flatnonzero((first == part.column("h1").to_numpy())
                                 & (second == part.column("h2").to_numpy()))
            raw, at = grams.astype("<u8").tobytes(), at.tolist()
            yield pa.RecordBatch.from_arrays([
                part.column("rep").take(pa.array(own)),
                pa.array([raw[8 * at[k] : 8 * at[k + 1]] for k in own.tolist()], pa.binary()),
            ], names=["rep", "shingles"])

    chosen = docs.join(small(wanted), docs["doc_id"] == wanted["named"]).select("rep", "h1", "h2", "text")
    return chosen.mapInArrow(run, "rep bigint, shingles binary").dropDuplicates(["rep"])


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text",
                    id_column: str = "doc_id", row_key: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (the component's smallest id).

    A `row_key` (bigint) is returned as well; it names the row where ids do not.

    Sets are the distinct five-word shingles of the whole text, A-Z lower-cased. Two
    documents are linked if 100 * intersection >= percent * union. Null and empty texts have
    empty sets and stand alone. A null id stands alone, has no component and is kept.
    Rows that repeat a doc_id with equal text share all results; of different texts under
    one id each is compared, and its row has its own component. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         docs[text].cast("string").alias("text"),
                         *([] if row_key is None else [row_key.alias("row_key")]))
    along = [c for c in chosen.columns if c == "row_key"]
    made = tables.save(sketches(chosen))
    whole_set = ["h1", "h2", "n_shingles"]
    usable = made.where("n_shingles > 0 and doc_id is not null")
    # A set is named by a number of its own (rep), as an id may have several texts.
    reps = tables.save(usable.groupBy(*whole_set).agg(
        F.min("doc_id").alias("named"), F.first("a").alias("a"), F.first("b").alias("b"),
        F.first("sketch").alias("sketch")).withColumn("rep", F.monotonically_increasing_id()))
    exploded = {side: reps.select("rep", F.posexplode(side).alias("i", "key")) for side in "ab"}
    second = _live(exploded["b"]).select("rep").distinct()
    first = _live(exploded["a"]).join(second, "rep", "left_semi")
    signs = reps.select("rep", "a", "sketch")
    similar = tables.save(
        _dealt(first.join(signs, "rep"), SKETCH_BLOCK).groupBy("i", "key", "x", "y")
        .applyInArrow(_keep_similar(percent / 100), "rep bigint, i int, key bigint").distinct())
    sizes = similar.groupBy("i", "key").agg(F.count("*").alias("n"))
    wanted = reps.join(similar.select("rep").distinct(), "rep").select("rep", "h1", "h2", "named")
    compared = tables.save(_sets_of(chosen, tables.save(wanted)))
    links = tables.save(
        _dealt(similar.join(sizes, ["i", "key"]).join(signs, "rep").join(compared, "rep"), SET_BLOCK)
        .groupBy("i", "key", "x", "y").applyInArrow(_links(percent), "u bigint, v bigint"))
    roots = components(links, tables)
    members = roots.select("root", F.col("node").alias("rep")).unionByName(
        roots.select("root", F.col("root").alias("rep")).distinct())
    members = members.join(reps.select("rep", "named"), "rep")
    least = members.groupBy("root").agg(F.min("named").alias("least"))
    classes = reps.select("rep", "named", *whole_set).join(
        members.select("rep", "root").join(least, "root"), "rep", "left").select(
        *whole_set, F.coalesce("least", "named").alias("root"))
    usual = F.col("n_shingles") > 0
    return (made.select("doc_id", *whole_set, *along).join(classes, whole_set, "left")
            .select("doc_id", "n_shingles", *along,
                    F.when(usual & F.col("doc_id").isNotNull(), F.col("root"))
                    .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
