"""Spelling variants: words one edit apart, by pivotal bigrams.

All bigrams have one order, rare ones first, by the counts of 65,536 hash buckets of bigrams
over the words. A word's prefix is its three first bigrams in that order (more, where the
third is tied); by dynamic programming over their places it chooses two that do not overlap
and are rarest together, its pivots. One edit touches at most one of two disjoint bigrams. So
of two near words, that with the earlier prefix end has a pivot which the other one holds too,
and holds in its prefix. Pivots are therefore joined with prefix bigrams in both directions.

Position limits make the join keys narrow. The only edit lies on one side of the shared
bigram, so the word up to and with the bigram, or from the bigram on, is the same in both. If
that part has fewer than `LONG_SIDE` code points, the other side is cut in halves, of which
one must be equal as well; for that the probing word assumes each of the three lengths that
its partner may have. Keys are 64-bit hashes of those parts. What meets on a key is compared
by letter sets and then by edit distance, inside the join; pairs found twice count once.

Words of `HALVED` code points or more share a half with a near word; their halves are the keys,
as the bigrams of such words (runs of one letter, say) are often tied.

Every word is indexed, no list is cut. A key that many words share costs comparisons, which
a skewed join spreads over tasks, but makes no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, mix64, ship

#: Buckets of bigrams whose counts are handed to all tasks (512 KB).
BUCKETS = 1 << 16
#: Code points of a shared part that are a key by themselves.
LONG_SIDE = 6
#: Shortest words that have two bigrams apart, and of those that are matched by halves.
SHORTEST, HALVED = 4, 64


def _buckets(points: np.ndarray) -> np.ndarray:
    """Bucket of each bigram of a sequence of code points."""
    pairs = (points[:-1].astype(np.uint64) << np.uint64(21)) | points[1:].astype(np.uint64)
    return (mix64(pairs) % np.uint64(BUCKETS)).astype(np.int64)


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4")


def bigram_counts(words: DataFrame) -> np.ndarray:
    """Bigrams of the words in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                # No bigram reaches over a line end, which stands between the words.
                points = _points("\n".join(batch.column("word").slice(k, 4096).to_pylist()))
                inner = (points[:-1] != 10) & (points[1:] != 10)
                total += np.bincount(_buckets(points)[inner], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = (words.select("word").mapInArrow(count, "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def prefix_grams(word: str, counts: np.ndarray) -> list[tuple[int, int]]:
    """(count, place) of the bigrams up to the third in the common order, ties with it included;
    by place."""
    ranked = sorted((n, word[i : i + 2], i) for i, n in enumerate(counts[_buckets(_points(word))].tolist()))
    last = ranked[2][:2]
    return sorted(((n, i) for n, gram, i in ranked if (n, gram) <= last), key=lambda x: x[1])


def pivot_places(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two bigrams that do not overlap and have the least count together.

    One pass over the places: the cheapest bigram that ends before the present one, and the
    best pair so far.
    """
    best, cheapest, ready = None, None, 0
    for n, i in grams:
        while grams[ready][1] <= i - 2:
            cheapest = min(cheapest or grams[ready], grams[ready])
            ready += 1
        if cheapest and (best is None or n + cheapest[0] < best[0]):
            best = (n + cheapest[0], cheapest[1], i)
    return best[1], best[2]


def _before_keys(word: str, i: int, length: int) -> list[str]:
    """Keys of a word, or of its partner of that length, if they are equal up to the bigram at i."""
    end = i + 2
    if end >= LONG_SIDE:
        return ["l" + word[:end]]
    half = (length - end) // 2
    tail = length - end - half
    return [f"m{length}:{word[: end + half]}", f"n{length}:{word[:end]}\n{word[len(word) - tail :]}"]


def _after_keys(word: str, i: int, length: int) -> list[str]:
    """The same, if they are equal from the bigram at i on."""
    end = len(word) - i
    if end >= LONG_SIDE:
        return ["r" + word[i:]]
    half = (length - end) // 2
    tail = length - half
    return [f"s{length}:{word[:half]}\n{word[i:]}", f"t{length}:{word[max(0, len(word) - tail) :]}"]


def _half_keys(word: str, length: int) -> list[str]:
    """Keys of a long word, or of its partner of that length, by its first or second half."""
    half = length // 2
    return [f"x{length}:{word[:half]}", f"y{length}:{word[len(word) - (length - half) :]}"]


def word_keys(word: str, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Hashes under which a word is indexed, by its prefix, and those it probes, by its pivots."""
    size = len(word)
    index, probe = set(), set()
    for length in (size - 1, size, size + 1):
        if length >= HALVED:
            probe.update(_half_keys(word, length))
    if size >= HALVED:
        index.update(_half_keys(word, size))
    else:
        grams = prefix_grams(word, counts)
        for _, i in grams:
            index.update(_before_keys(word, i, size), _after_keys(word, i, size))
        for i in pivot_places(grams):
            for length in (size - 1, size, size + 1):
                probe.update(_before_keys(word, i, length), _after_keys(word, i, length))
    return tuple([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in keys] for keys in (index, probe))


def keyed_words(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """word, letters (a set of 64 kinds of letters as bits), index and probe keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.column("word").slice(k, 2048)
                own = part.to_pylist()
                keys = [word_keys(w, table) for w in own]
                letters = [int(np.bitwise_or.reduce(np.int64(1) << (_points(w) & 63).astype(np.int64)))
                           for w in own]
                yield pa.RecordBatch.from_arrays([
                    part, pa.array(letters, pa.int64()),
                    pa.array([i for i, _ in keys], pa.list_(pa.int64())),
                    pa.array([p for _, p in keys], pa.list_(pa.int64())),
                ], names=["word", "letters", "index", "probe"])

    shared = words.sparkSession.sparkContext.broadcast(counts)
    return words.select("word").mapInArrow(
        run, "word string, letters bigint, index array<bigint>, probe array<bigint>")


def one_edit(a: str, b: str) -> bool:
    """Whether two long words are exactly one edit apart, in one pass over them."""
    short, long = sorted((_points(a), _points(b)), key=len)
    if len(long) - len(short) > 1:
        return False
    if len(short) == len(long):
        return int((short != long).sum()) == 1
    differ = np.flatnonzero(short != long[:-1])
    at = int(differ[0]) if len(differ) else len(short)
    return bool((short[at:] == long[at + 1 :]).all())


def _met(keyed: DataFrame, near: Column) -> DataFrame:
    left = keyed.select(F.explode("probe").alias("key"), F.col("word").alias("first"),
                        F.col("letters").alias("first_letters"))
    right = keyed.select(F.explode("index").alias("key"), F.col("word").alias("second"),
                         F.col("letters").alias("second_letters"))
    # One edit changes the set of letters by two at most.
    alike = F.bit_count(F.col("first_letters").bitwiseXOR(F.col("second_letters"))) <= 2
    return left.join(right, (left["key"] == right["key"]) & alike & near).select("first", "second")


def near_pairs(keyed: DataFrame) -> DataFrame:
    """Each pair of words exactly one edit apart, once: first, second.

    Spark's distance takes time with the square of the length, so pairs of long words are
    compared in Python instead.
    """
    long = F.length("word") >= HALVED

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [one_edit(a, b) for a, b in zip(batch["first"].to_pylist(), batch["second"].to_pylist())]
            yield batch.filter(pa.array(near, pa.bool_()))

    met = _met(keyed.where(~long), F.levenshtein("first", "second", 1) == 1).unionByName(
        _met(keyed.where(F.length("word") >= HALVED - 1),
             (F.col("first") != F.col("second")) & (
                 F.greatest(F.length("first"), F.length("second")) >= HALVED))
        .mapInArrow(verified, "first string, second string"))
    return met.select(F.least("first", "second").alias("first"),
                      F.greatest("first", "second").alias("second")).distinct()


def _roots(forms: DataFrame, tables: Tables, longest: int) -> DataFrame:
    """word, root: the end of each chain of forms, which has `longest` steps at most."""
    roots = tables.save(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = tables.save(roots.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root")))
    return roots


def spelling_variants(words: DataFrame, ratio: float = 10, least_length: int = 7,
                      least_count: int = 2) -> DataFrame:
    """Words with their near words: word, n, n_near, form, form_n, root.

    `words` has word and n; rows of one word are added up, null words and counts left out.
    Words of at least `least_length` code points (4 or more) and count `least_count` take part.
    Words are near if exactly one code point is inserted, deleted or replaced. The form of a
    word is its near word of largest n (of equal ones the smallest in code-point order) if that
    n is at least `ratio` times its own; form and form_n are null otherwise. The root is what
    following forms leads to, the word itself if it has none. Other columns are left out; an
    empty table gives no rows.
    """
    if least_length < SHORTEST or ratio <= 1:
        raise ValueError("words need 4 code points, and forms a ratio above 1")
    spark = words.sparkSession
    ship(spark)
    tables = Tables(spark)
    known = tables.save(
        words.where(F.col("word").isNotNull() & F.col("n").isNotNull())
        .groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
        .where((F.length("word") >= least_length) & (F.col("n") >= least_count)))
    keyed = tables.save(keyed_words(known, bigram_counts(known)))
    pairs = tables.save(near_pairs(keyed))
    tables.drop(keyed)
    both = pairs.select(F.col("first").alias("word"), F.col("second").alias("near")).unionByName(
        pairs.select(F.col("second").alias("word"), F.col("first").alias("near")))
    counted = both.join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    form = -F.col("best.minus") >= ratio * F.col("n")
    told = tables.save(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(form, F.col("best.near")).alias("form"),
        F.when(form, -F.col("best.minus")).alias("form_n")))
    most = told.agg(F.max("n")).first()[0] or 1
    longest = int(log(max(1, most / max(1, least_count)), ratio) + 1e-9) + 1
    roots = _roots(told.where(F.col("form").isNotNull()), tables, longest)
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
