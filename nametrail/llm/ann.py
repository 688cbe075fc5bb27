"""Approximate nearest neighbours by NN-descent and greedy graph search, in shards.

Vectors are dealt to shards by a hash of what they hold. A shard builds its own neighbour graph
and is searched from every query with the whole beam; the best of all shards are the result.
What a shard needs for each vector lies in mapped files of the task's temp folder, so that
memory holds the parts in use.

Build. Random hyperplanes deal the vectors into small leaves, several times over, and the
nearest of each leaf make a first neighbour graph. Then neighbours of neighbours are
joined: for every vector its neighbours, and a bounded sample of those it is a neighbour
of, are compared with each other, and each keeps the best it has met. That is repeated
until the graph hardly gains.

Search. A query begins at itself or, where it is none of the graph's, at the best few of a
sample, and again and again the best ones met so far that
were not yet opened are opened: their neighbours in the graph join the ones met. It ends
when the best `beam` ones are all opened.

Vectors that are equal count once in the graph (their copies come back in the results), so
a group of copies of any size is one vector. Graph and search use components of one byte; the
best `beam` of a search are measured in double precision on the original vectors.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nametrail.llm.common import ship

NEIGHBOURS = 32
#: Vectors of which a vector is a neighbour that take part in its comparisons, at most.
REVERSE = 24
TREES = 8
LEAF_ROWS = 192
LEAF_MOST = 384
#: Neighbours that a leaf, and a comparison among neighbours, reports for each vector.
LEAF_REPORTS = 8
JOIN_REPORTS = 5
MAX_ROUNDS = 8
#: The build ends when the similarities gain less than this share.
LEAST_GAIN = 0.001
BEAM = 200
OPENED_AT_ONCE = 64
#: Vectors at which queries begin that are none of the graph's, the best of so many.
ENTRIES = 32
ENTRY_SAMPLE = 4096
#: Shards are SHARDS_LEAST, fewer for few rows, more beyond so many components in each (a vector
#: counts as LEAST_DIMS of them at least, since places have 21 bits).
SHARDS_LEAST = 12
SHARD_LEAST_ROWS = 4096
SHARD_COMPONENTS = 1 << 27
LEAST_DIMS = 64
#: Rows that numpy takes at once, and candidates that are merged into the graph at once.
ROWS_AT_ONCE = 1 << 14
CENTRES_AT_ONCE = 256
CANDIDATES_AT_ONCE = 1 << 21
SEEN_BYTES = 1 << 25
BATCH_COMPONENTS = 1 << 22

_ROW = "vec_id bigint, full binary"
_MET = "q bigint, vec_id bigint, score double"


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """The rows whose bytes `_binary` gave."""
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(-1, dims)


def prepared(vectors: DataFrame, dims: int, kind: str, id_column: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """(vec_id, full) of the vectors that take part: of `dims` finite components, not all zero,
    with an id. `full` holds the components as numpy's `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)  # null is NaN
                full = flat.reshape(part.num_rows, dims).astype(kind, copy=False)
                usable = np.isfinite(full).all(axis=1) & (full != 0).any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").filter(pa.array(usable)), _binary(full[usable])],
                    names=["vec_id", "full"])

    step = max(1, BATCH_COMPONENTS // dims)
    element = "float" if kind == "<f4" else "double"
    chosen = vectors.select(vectors[id_column].cast("bigint").alias("vec_id"),
                            vectors[vector].cast(f"array<{element}>").alias("vector"))
    return chosen.where((F.size("vector") == dims) & F.col("vec_id").isNotNull()).mapInArrow(run, _ROW)


def _scratch(shape: tuple[int, int], kind: np.dtype | type | str, empty: int = 0) -> np.ndarray:
    """An array in a file that ends with it."""
    if not math.prod(shape):
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:
        out = np.memmap(file, kind, "w+", shape=shape)
    if empty:
        out[:] = empty
    return out.view(np.ndarray)


def _scaled(full: np.ndarray) -> np.ndarray:
    """Directions in single precision; tiny and huge vectors have one as well."""
    unit = full.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    return (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)


class Shard:
    """Vectors by their place in the shard: what is compared, and the lists of neighbours.

    A list is a sorted row of whole numbers: cost, place and two bits of age, where the cost falls
    as the similarity rises; `empty` stands for no neighbour. An age of 3 means taken in during
    this round, 1 in the round before, 0 earlier.
    """

    def __init__(self, full: np.ndarray, rows: np.ndarray) -> None:
        self.rows, self.dims = len(rows), full.shape[1]
        self.bits = max(1, int(self.rows).bit_length())
        self.cost_bits = min(23, 62 - 2 * self.bits)
        self.step = float((1 << (self.cost_bits - 1)) - 2) / 2
        self.place, self.cost = (1 << self.bits) - 1, (1 << self.cost_bits) - 1
        self.empty = np.int64((1 << (self.cost_bits + self.bits + 2)) - 1)
        wide = -(-self.dims // 8) * 8
        self.short = _scratch((self.rows, wide), np.int8)
        self.inverse = np.zeros(self.rows, np.float32)
        for a in range(0, self.rows, ROWS_AT_ONCE):
            unit = _scaled(full[rows[a : a + ROWS_AT_ONCE]])
            short = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True)))
            self.short[a : a + ROWS_AT_ONCE, : self.dims] = short
            self.inverse[a : a + ROWS_AT_ONCE] = 1 / np.linalg.norm(short, axis=1)
        self.words = self.short.view(np.int64)
        # What is filled again and again; new memory each time costs more than the work in it.
        self.taken, self.single = np.empty((0, wide // 8), np.int64), np.empty((0, wide), np.float32)
        self.sims = np.empty(0, np.float32)

    def singles(self, places: np.ndarray) -> np.ndarray:
        """Components in single precision; overwritten by the next call."""
        if len(places) > len(self.taken):
            self.taken = np.empty((len(places), self.words.shape[1]), np.int64)
            self.single = np.empty((len(places), self.short.shape[1]), np.float32)
        taken, single = self.taken[: len(places)], self.single[: len(places)]
        np.take(self.words, places, axis=0, out=taken, mode="clip")
        np.copyto(single, taken.view(np.int8))
        return single

    def units(self, places: np.ndarray) -> np.ndarray:
        """Directions; zeros for a place of -1. Overwritten by the next call."""
        scale = self.inverse.take(places, mode="clip")
        scale[places < 0] = 0
        single = self.singles(places)
        return np.multiply(single, scale[:, None], out=single)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarities of the rows of a and b, matrix by matrix; overwritten by the next call."""
        shape = (len(a), a.shape[1], b.shape[1])
        if math.prod(shape) > len(self.sims):
            self.sims = np.empty(math.prod(shape), np.float32)
        return np.matmul(a, b.transpose(0, 2, 1), out=self.sims[: math.prod(shape)].reshape(shape))

    def costs(self, similarity: np.ndarray) -> np.ndarray:
        return np.maximum(((np.float32(1.0) - similarity) * np.float32(self.step)).astype(np.int64), 0)

    def keys(self, similarity: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of neighbours that are new in this round."""
        return ((self.costs(similarity) << self.bits | places) << 2) | 3

    def places(self, keys: np.ndarray) -> np.ndarray:
        """-1 for `empty`."""
        return np.where(keys == self.empty, -1, (keys >> 2) & self.place)

    def similarity(self, keys: np.ndarray) -> np.ndarray:
        """About the similarity a key was made of; below -1 for `empty`."""
        return (1 - (keys >> (self.bits + 2)) / self.step).astype(np.float32)

    def merged(self, keys: np.ndarray, count: int) -> np.ndarray:
        """The `count` best of each row, a place once and as the older one."""
        turned = ((keys & (self.place << 2 | 3)) << self.cost_bits) | (keys >> (self.bits + 2))
        turned.sort(axis=1)
        place = turned >> (self.cost_bits + 2)
        best = ((turned & self.cost) << (self.bits + 2)) | (turned >> self.cost_bits)
        best[:, 1:][place[:, 1:] == place[:, :-1]] = self.empty
        best.sort(axis=1)
        return best[:, :count]


def _leaf_neighbours(shard: Shard, code: np.ndarray) -> np.ndarray:
    """Keys of each vector's best in its leaf. Leaves beyond LEAF_MOST rows are split at random."""
    found = np.full((shard.rows, LEAF_REPORTS), shard.empty)
    order = np.argsort(code, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, shard.rows)
    mix = np.random.default_rng(21)
    for start, end in zip(np.append(0, ends[:-1]), ends):
        leaf = order[start:end]
        parts = -(-len(leaf) // LEAF_MOST)
        for places in np.array_split(mix.permutation(leaf), parts) if parts > 1 else [leaf]:
            count = min(LEAF_REPORTS, len(places) - 1)
            if count < 1:
                continue
            unit = shard.units(places)[None]
            sims = shard.products(unit, unit)[0]
            np.fill_diagonal(sims, -np.inf)
            best = np.argpartition(sims, -count, axis=1)[:, -count:]
            found[places, :count] = shard.keys(np.take_along_axis(sims, best, 1), places[best])
    return found


def _first_graph(shard: Shard, neighbours: int) -> np.ndarray:
    """The best of all leaves."""
    bits = max(0, math.ceil(math.log2(shard.rows / LEAF_ROWS)))
    graph = _scratch((shard.rows, neighbours), np.int64, shard.empty)
    weights = 1 << np.arange(bits, dtype=np.int64)
    planes = np.random.default_rng(20)
    for _ in range(TREES):
        plane = planes.standard_normal((shard.short.shape[1], bits), dtype=np.float32)
        code = np.zeros(shard.rows, np.int64)
        for a in range(0, shard.rows, ROWS_AT_ONCE):
            code[a : a + ROWS_AT_ONCE] = (
                (shard.short[a : a + ROWS_AT_ONCE].astype(np.float32) @ plane > 0) @ weights)
        found = _leaf_neighbours(shard, code)
        for a in range(0, shard.rows, ROWS_AT_ONCE):
            part = slice(a, a + ROWS_AT_ONCE)
            graph[part] = shard.merged(np.concatenate([graph[part], found[part]], axis=1), neighbours)
    return graph


def _reverse(shard: Shard, graph: np.ndarray, number: int) -> np.ndarray:
    """For each place a sample of those that have it in their lists: place * 2, and 1 more if it
    is new there; -1 for none."""
    out = _scratch((shard.rows, REVERSE), np.int32, -1)
    odd = (0x9E3779B1 + 2 * 0x7F4A7C15 * number) & 0x7FFFFFFF | 1
    for start in range(0, shard.rows, 4 * ROWS_AT_ONCE):
        end, pairs = min(shard.rows, start + 4 * ROWS_AT_ONCE), []
        for a in range(0, shard.rows, 4 * ROWS_AT_ONCE):
            lists = graph[a : a + 4 * ROWS_AT_ONCE]
            place = ((lists >> 2) & shard.place).astype(np.int32)
            at = np.flatnonzero((place >= start) & (place < end))
            mixed = ((at // graph.shape[1] + a) * odd) & 0x7FFFFFFF
            pairs.append((place.ravel()[at].astype(np.int64) - start) << 32 | mixed << 1
                         | (lists.ravel()[at] & 1))
        pairs = np.concatenate(pairs)
        pairs.sort()
        centre = pairs >> 32
        rank = np.arange(len(pairs)) - np.searchsorted(centre, np.arange(end - start))[centre]
        kept = rank < REVERSE
        pairs, place = pairs[kept], centre[kept] + start
        mixed = (pairs >> 1) & 0x7FFFFFFF
        out[place, rank[kept]] = ((mixed * pow(odd, -1, 1 << 31)) & 0x7FFFFFFF) << 1 | (pairs & 1)
    return out


def _compare(shard: Shard, members: np.ndarray, fresh: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `fresh` members of a row (places, -1 for none) against all of them: (place, key)
    of what improves on a member's worst, the JOIN_REPORTS best of each one at most."""
    n, width = members.shape
    missing = members < 0
    unit = shard.units(members.ravel()).reshape(n, width, -1)
    sims = shard.products(unit[:, :fresh], unit)
    np.einsum("nii->ni", sims[:, :, :fresh])[:] = -4
    floor = np.where(missing, np.float32(4), worst.take(members, mode="clip"))
    if missing.any() and floor.min() < 0:
        np.copyto(sims, np.float32(-4), where=missing[:, None, :])
    better = np.flatnonzero(sims > floor[:, :fresh, None])
    if len(better) > n * fresh and width > JOIN_REPORTS:
        fifth = np.partition(sims, -JOIN_REPORTS, axis=2)[:, :, -JOIN_REPORTS, None]
        better = np.flatnonzero(sims >= np.maximum(fifth, np.nextafter(floor[:, :fresh, None], np.float32(9))))
    row, place = better // width // fresh, members.ravel()
    mine, other = better // width % fresh + row * width, better % width + row * width
    value = sims.ravel()[better]
    if fresh < width:
        later = sims[:, :, fresh:]
        better = later > floor[:, None, fresh:]
        if fresh > JOIN_REPORTS and np.count_nonzero(better) > JOIN_REPORTS * n * (width - fresh) // 2:
            better &= later >= np.partition(later, -JOIN_REPORTS, axis=1)[:, None, -JOIN_REPORTS]
        row, new, old = np.nonzero(better)
        mine, other = np.append(mine, row * width + fresh + old), np.append(other, row * width + new)
        value = np.append(value, later[row, new, old])
    mine, other = place[mine], place[other]
    known = (mine >= 0) & (other >= 0) & (mine != other)
    return mine[known], shard.keys(value[known], other[known])


def _take_in(shard: Shard, graph: np.ndarray, worst: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
    """Merges new keys into the lists of these places."""
    neighbours, low = graph.shape[1], shard.bits + shard.cost_bits
    both = (places << low) | (keys >> 2)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
    place = both >> low
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    sizes = np.minimum(np.diff(np.append(starts, len(place))), neighbours)
    for a in range(0, len(starts), ROWS_AT_ONCE):
        at, size = starts[a : a + ROWS_AT_ONCE], sizes[a : a + ROWS_AT_ONCE]
        there = np.arange(size.max()) < size[:, None]
        rows, columns = np.nonzero(there)
        more = np.full(there.shape, shard.empty)
        more[rows, columns] = (both[at[rows] + columns] & ((1 << low) - 1)) << 2 | 3
        lists = place[at]
        graph[lists] = shard.merged(np.concatenate([graph[lists], more], axis=1), neighbours)
        worst[lists] = shard.similarity(graph[lists, -1])


def _round(shard: Shard, graph: np.ndarray, worst: np.ndarray, number: int) -> None:
    """One round of joining neighbours of neighbours. Two that both were known to a vector in the
    round before have been compared there and are not again."""
    for a in range(0, shard.rows, ROWS_AT_ONCE):
        part = graph[a : a + ROWS_AT_ONCE]
        part[:] = np.where(part == shard.empty, part, part & ~np.int64(3) | ((part & 3) >> 1))
    backward = _reverse(shard, graph, number)
    places, keys, waiting = [], [], 0
    for a in range(0, shard.rows, ROWS_AT_ONCE):
        lists = graph[a : a + ROWS_AT_ONCE]
        # Sorted by age, new ones first; -1 is no member. Those of this round wait for the next.
        forward = np.where(lists == shard.empty, -1, shard.places(lists) << 1 | ((lists & 3) == 1))
        members = np.concatenate([forward, backward[a : a + ROWS_AT_ONCE]], axis=1)
        members.sort(axis=1)
        members[:, :-1][members[:, :-1] >> 1 == members[:, 1:] >> 1] = -1
        fresh = (members >= 0) & (members & 1 == 1)
        members = np.take_along_axis(members, np.argsort(
            np.where(fresh, 0, np.where(members >= 0, 1, 2)).astype(np.int8), axis=1, kind="stable"), 1) >> 1
        count, filled = fresh.sum(axis=1), (members >= 0).sum(axis=1)
        order = np.lexsort((filled, count))
        for b in range(np.searchsorted(count[order], 1), len(order), CENTRES_AT_ONCE):
            chosen = order[b : b + CENTRES_AT_ONCE]
            found = _compare(shard, members[chosen, : filled[chosen].max()], int(count[chosen].max()), worst)
            places.append(found[0])
            keys.append(found[1])
            waiting += len(found[0])
            if waiting >= CANDIDATES_AT_ONCE:
                _take_in(shard, graph, worst, np.concatenate(places), np.concatenate(keys))
                places, keys, waiting = [], [], 0
    if waiting:
        _take_in(shard, graph, worst, np.concatenate(places), np.concatenate(keys))


def build_graph(shard: Shard, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The lists of neighbours of all vectors of a shard: places, -1 for none."""
    graph = _first_graph(shard, neighbours)

    def reached() -> float:
        return sum(float(shard.similarity(part[part != shard.empty]).sum(dtype=np.float64))
                   for part in np.array_split(graph, -(-shard.rows // ROWS_AT_ONCE)))

    total = reached()
    worst = shard.similarity(np.array(graph[:, -1]))
    for number in range(MAX_ROUNDS):
        before = total
        _round(shard, graph, worst, number)
        total = reached()
        if total - before <= LEAST_GAIN * abs(total):
            break
    out = _scratch(graph.shape, np.int32)
    for a in range(0, shard.rows, ROWS_AT_ONCE):
        out[a : a + ROWS_AT_ONCE] = shard.places(graph[a : a + ROWS_AT_ONCE])
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision; the scale of a row plays no part."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(
        np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def entries(shard: Shard, asked: np.ndarray) -> np.ndarray:
    """Places at which a query that is none of the graph's begins: the best of a sample."""
    # The shard is in the order of a hash, so its first vectors are a sample.
    sample = shard.units(np.arange(min(ENTRY_SAMPLE, shard.rows)))[:, : shard.dims]
    count = min(ENTRIES, len(sample))
    return np.argpartition(asked @ sample.T, -count, axis=1)[:, -count:]


def search(shard: Shard, graph: np.ndarray, asked: np.ndarray, begin: np.ndarray,
           beam: int = BEAM) -> np.ndarray:
    """The places of the best `beam` vectors that a greedy search from each query has met, the
    best first; -1 for none. `asked` has the queries' directions, `begin` places to begin at
    (-1 for none)."""
    n = len(asked)
    padded = np.zeros((n, shard.short.shape[1]), np.float32)
    padded[:, : shard.dims] = asked
    seen = np.zeros(n * shard.rows, bool)
    # In the search the lowest bit of a key tells that a vector was opened.
    best = np.full((n, beam), shard.empty)
    bases = np.arange(n + 1) * shard.rows
    met = (bases[:-1, None] + begin)[begin >= 0]
    while len(met):
        met = met[~seen.take(met)]
        met.sort()
        met = met[np.append(True, met[1:] != met[:-1])[: len(met)]]
        seen[met] = True
        ends = np.searchsorted(met, bases)
        sizes = np.diff(ends)
        place = met - np.repeat(bases[:-1], sizes)
        sims = np.empty(len(met), np.float32)
        for k in np.flatnonzero(sizes):
            part = slice(ends[k], ends[k + 1])
            np.dot(shard.singles(place[part]), padded[k], out=sims[part])
        sims *= shard.inverse.take(place)
        # A cost is rounded, so what may equal the last one's passes as well.
        last = shard.similarity(best[:, -1]) - np.float32(2 / shard.step)
        kept = np.flatnonzero(sims > np.repeat(last, sizes))
        sizes = np.diff(np.searchsorted(kept, ends))
        more = np.flatnonzero(sizes)
        if len(more):
            fresh = np.full((len(more), sizes.max()), shard.empty)
            fresh[np.arange(sizes.max()) < sizes[more, None]] = (
                shard.keys(sims[kept], place[kept]) & ~np.int64(3))
            both = np.concatenate([best[more], fresh], axis=1)
            both.sort(axis=1)
            best[more] = both[:, :beam]
        closed = (best & 1) == 0
        query, column = np.nonzero(closed & (np.cumsum(closed, axis=1) <= OPENED_AT_ONCE))
        opened = best[query, column]
        best[query, column] |= 1
        there = graph.take((opened >> 2) & shard.place, axis=0)
        met = (bases[query][:, None] + there)[there >= 0]
    return shard.places(best)


def _answers(ids: np.ndarray, starts: np.ndarray, full: np.ndarray, rows: np.ndarray, q: np.ndarray,
             asked: np.ndarray, found: np.ndarray, count: int) -> pa.RecordBatch:
    """(q, vec_id, score) of the `count` best of each query, copies included and itself left out,
    ties to the smaller id. `ids` holds the ids of copies one after another, by place from `starts`;
    `rows` tells where in `full` a place's vector is."""
    n = len(found)
    score = np.full(found.shape, -np.inf)
    query, column = np.nonzero(found >= 0)
    score[query, column] = cosines(asked[query].astype(np.float64),
                                   full[rows[found[query, column]]].astype(np.float64))
    least = ids[starts[np.maximum(found, 0)]]
    first = np.lexsort((least, -score), axis=1)[:, : count + 1]
    found, score = np.take_along_axis(found, first, 1), np.take_along_axis(score, first, 1)
    at = np.maximum(found, 0)
    copy = np.arange(count + 1)
    there = (found >= 0)[:, :, None] & (copy < (starts[at + 1] - starts[at])[:, :, None])
    vec_id = ids[np.minimum(starts[at][:, :, None] + copy, len(ids) - 1)]
    there &= vec_id != q[:, None, None]
    vec_id, there = vec_id.reshape(n, -1), there.reshape(n, -1)
    score = np.where(there, np.repeat(score, count + 1, axis=1), -np.inf)
    first = np.lexsort((vec_id, -score), axis=1)[:, :count]
    query, column = np.nonzero(np.take_along_axis(there, first, 1))
    chosen = first[query, column]
    return pa.RecordBatch.from_arrays(
        [pa.array(q[query]), pa.array(vec_id[query, chosen]), pa.array(score[query, chosen])],
        names=["q", "vec_id", "score"])


class _Store:
    """Rows (key, vec_id, full) as they come, the vectors in a file."""

    def __init__(self, kind: str, dims: int) -> None:
        self.file, self.kind, self.dims = tempfile.TemporaryFile(), kind, dims
        self.keys, self.names = [], []

    def add(self, key: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        self.keys.append(key.copy())
        self.names.append(ids.copy())
        self.file.write(np.ascontiguousarray(full).data)

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.file.flush()
        key, ids = np.concatenate(self.keys), np.concatenate(self.names)
        full = np.memmap(self.file, self.kind, "r", shape=(len(ids), self.dims)).view(np.ndarray)
        self.file.close()
        return key, ids, full


def _answered(held: _Store, asking: _Store, count: int, neighbours: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Builds the graph of a shard and searches it."""
    key, ids, full = held.read()
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    same = np.zeros(len(ids), bool)
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    for part in np.array_split(again, -(-len(again) // ROWS_AT_ONCE) or 1):
        a, b = full[order[part]], full[order[part - 1]]
        same[part] = (a.view(np.uint8) == b.view(np.uint8)).all(axis=1)
    repeated = same & np.append(False, ids[1:] == ids[:-1])
    order, key, ids, same = (x[~repeated] for x in (order, key, ids, same))
    starts = np.flatnonzero(~same)
    rows, key, starts = order[starts], key[starts], np.append(starts, len(ids))
    shard = Shard(full, rows)
    graph = build_graph(shard, neighbours)
    asked_key, q, asked = asking.read()
    at_once = max(1, min(256, SEEN_BYTES // shard.rows))
    for a in range(0, len(q), at_once):
        part = slice(a, a + at_once)
        direction, vectors = _scaled(asked[part]), asked[part]
        begin = entries(shard, direction)
        own = np.minimum(np.searchsorted(key, asked_key[part]), shard.rows - 1)
        known = (full[rows[own]].view(np.uint8) == np.ascontiguousarray(vectors).view(np.uint8)).all(axis=1)
        begin[known] = -1
        begin[known, 0] = own[known]
        found = search(shard, graph, direction, begin, beam)
        yield _answers(ids, starts, full, rows, q[part], vectors, found, count)


def _searched(dims: int, kind: str, count: int, neighbours: int, beam: int
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (shard, asks, key, vec_id, full) of whole shards: vectors, and queries, which ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[tuple[int, bool], _Store] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, asks, key, ids = (batch.column(c).to_numpy(zero_copy_only=False)
                                     for c in ("shard", "asks", "key", "vec_id"))
            full = _matrix(batch.column("full"), kind, dims)
            group = shard.astype(np.int64) * 2 + asks
            for one in np.unique(group).tolist():
                chosen = group == one
                store = stores.setdefault(divmod(one, 2), _Store(kind, dims))
                store.add(key[chosen], ids[chosen], full[chosen])
        for one in sorted({one for one, _ in stores}):
            held, asking = stores.pop((one, 0), None), stores.pop((one, 1), None)
            if held and asking:
                yield from _answered(held, asking, count, neighbours, beam)

    return run


def nearest(vectors: DataFrame, every: int = 50, count: int = 5, neighbours: int = NEIGHBOURS,
            beam: int = BEAM, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `count` nearest found of each vector whose id is
    divisible by `every`, itself left out; ties go to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without an id or with another number of components than most have. Rows that repeat
    id and vector count once. An empty table gives no rows; other columns are left out.
    """
    ship(vectors.sparkSession)
    lengths = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dims")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, n = (lengths.dims, lengths.n) if lengths else (1, 0)
    shards = max(1, min(SHARDS_LEAST, n // SHARD_LEAST_ROWS),
                 math.ceil(n * max(dims, LEAST_DIMS) / SHARD_COMPONENTS))
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = prepared(vectors, dims, kind, id_column, vector).withColumn("key", F.xxhash64("full"))
    # A vector's copies: no more of them than a result holds, and the query itself. Rows that
    # repeat an id have its turn; the shard drops them.
    first = Window.partitionBy("key", "full").orderBy("vec_id")
    held = rows.withColumn("turn", F.dense_rank().over(first)).where(F.col("turn") <= count + 1)
    dealt = held.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"),
                        F.lit(False).alias("asks"), "key", "vec_id", "full")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["key", "vec_id", "full"])
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(True).alias("asks"), "key", "vec_id", "full")
    met = (dealt.unionByName(asked).repartitionById(shards, F.col("shard"))
           .mapInArrow(_searched(dims, kind, count, neighbours, beam), _MET))
    ordered = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= count)
            .select(F.col("q").alias("query_id"), "rank", "vec_id", "score"))
