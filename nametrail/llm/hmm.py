"""Hidden Markov language model: Baum-Welch over all partitions, scaled forward scores.

A text's tokens are its lower-cased words and one end. A hidden state emits a symbol: the end,
an unseen word, or one of 65,534 hash buckets of words; the bucket then gives the word by its own counts. So
the states' tables have a fixed size and can be handed to every task, while the counts of the
words, which grow with the corpus, stay a table on Spark. A word of count c in a bucket of N
tokens has the share (c - D) / N; what the discount D takes from all words of all buckets is
a state's probability of a word never seen, which is one event, as in the base score.

Each Baum-Welch round is one pass over all training texts. A task runs the forward and
backward recursion, scaled at each step, on sequences side by side, and yields its expected
counts by symbol and state; Spark sums them, and the driver, which holds nothing but the
states' tables, divides. For this, texts are taken in pieces of `PIECE` tokens, so that no
sequence is long; later pieces begin from the mean of the states. Every token counts in every
round.

Scores are exact: the forward recursion goes through each whole text. The counts of frequent
words (at most `FREQUENT` of them, found by a histogram of the counts) are at hand in each
task; other words are joined with their counts, once for each document and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametrail.llm.common import Tables, chunks, mix64, ship, word_hashes

#: Symbols that states emit; the last ones are an unseen word and the end of a text.
SYMBOLS = 1 << 16
BUCKETS, UNSEEN, END = SYMBOLS - 2, SYMBOLS - 2, SYMBOLS - 1
#: Hidden states, and Baum-Welch rounds over the corpus.
STATES, ROUNDS = 12, 3
#: Probability that a state stays before anything is learnt, and how much more likely than in
#: the others a symbol is in the state that favours it.
STAY, FAVOUR = 0.999, 16.0
#: Tokens of a training sequence, and tokens that a task holds at once, about.
PIECE, HELD = 1024, 1 << 18
#: Words whose counts are handed to all tasks (16 bytes each).
FREQUENT = 1 << 20
#: Counts added to a state's symbols in proportion to the corpus, and to its moves.
SMOOTHING, MOVE = 50.0, 1.0
#: Bytes of text that a task takes at once.
BATCH = 2 << 20


@dataclass
class Model:
    start: np.ndarray
    middle: np.ndarray
    moves: np.ndarray
    #: By symbol and state.
    emits: np.ndarray


@dataclass
class Corpus:
    """What is known of the training texts: `words` (h, n) is on Spark, the rest is bounded."""

    words: DataFrame
    n_docs: int
    n_tokens: int
    n_distinct: int
    discount: float
    #: Tokens and distinct words of each symbol.
    tokens: np.ndarray
    distinct: np.ndarray
    #: Least count of the words in `frequent`, their hashes in order and their counts.
    least: int
    frequent: np.ndarray
    counts: np.ndarray


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return np.mod(hashes.view(np.int64), BUCKETS)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more: the end)."""
    return word_hashes(texts)


def count_words(docs: DataFrame, tables: Tables) -> Corpus:
    """Counts of all words of the texts, and of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=4 * BATCH):
            found, n = np.unique(tokens(part.column("text"))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["h", "n"])

    words = tables.save(docs.select("text").mapInArrow(run, "h bigint, n bigint")
                        .groupBy("h").agg(F.sum("n").alias("n")))
    n_docs = docs.count()
    sizes = words.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("symbol")).agg(
        F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    by_symbol = np.zeros((2, SYMBOLS), np.int64)
    at = sizes.column("symbol").to_numpy()
    by_symbol[0, at], by_symbol[1, at] = sizes.column("n").to_numpy(), sizes.column("words").to_numpy()
    by_symbol[:, END] = n_docs, n_docs > 0
    # Counts to 1,023 one by one, larger ones sixteen to an octave.
    kind = F.when(F.col("n") < 1024, F.col("n")).otherwise(
        (864 + F.floor(16 * F.log2("n"))).cast("bigint"))
    steps = {r.kind: r for r in words.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    least, room = 1 << 62, FREQUENT
    for k in sorted(steps, reverse=True):
        room -= steps[k].words
        if room < 0:
            break
        least = steps[k].least
    once, twice = (steps[k].words if k in steps else 0 for k in (1, 2))
    chosen = words.where(F.col("n") >= least).toArrow()
    h = chosen.column("h").to_numpy()
    order = np.argsort(h)
    return Corpus(words, n_docs, int(by_symbol[0].sum()), int(by_symbol[1].sum()),
                  min(0.9, max(0.1, once / max(1, once + 2 * twice))), by_symbol[0], by_symbol[1],
                  least, h[order], chosen.column("n").to_numpy()[order])


class Sequences:
    """Symbols of several sequences side by side: all first ones, all second ones ..."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max()) if len(sizes) else 0
        #: Sequences that have a symbol at each step, and where the step's symbols begin.
        self.active = np.searchsorted(-sizes[self.order], -np.arange(longest), "left")
        self.begins = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        step = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols = np.empty(len(symbols), np.int64)
        self.symbols[self.begins[step] + np.repeat(rank, sizes)] = symbols


def forward_log10(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sequence, exactly, in memory for one step."""
    seq = Sequences(symbols, sizes)
    total = np.zeros(len(sizes))
    state = np.tile(model.start, (len(sizes), 1))
    for t, n in enumerate(seq.active.tolist()):
        state = state[:n] @ model.moves if t else state[:n]
        state = state * model.emits[seq.symbols[seq.begins[t] : seq.begins[t + 1]]]
        scale = state.sum(1)
        state /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[seq.order] = total
    return out


@dataclass
class Counts:
    """Expected counts: of symbols by state, of moves, and of states at first and at all tokens."""

    emits: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    middle: np.ndarray

    @classmethod
    def none(cls, states: int) -> Counts:
        return cls(np.zeros((SYMBOLS, states)), np.zeros((states, states)), np.zeros(states), np.zeros(states))


def forward_backward(model: Model, symbols: np.ndarray, sizes: np.ndarray, first: np.ndarray,
                     into: Counts) -> None:
    """Add the expected counts of sequences; `first` tells which of them begin a text."""
    seq = Sequences(symbols, sizes)
    emits = model.emits[seq.symbols]
    alpha = np.empty_like(emits)
    scale = np.empty(len(symbols))
    begins, active = seq.begins.tolist(), seq.active.tolist()
    before = np.where(first[seq.order][:, None], model.start, model.middle)
    for t, n in enumerate(active):
        at = slice(begins[t], begins[t] + n)
        own = np.multiply(before[:n], emits[at], out=alpha[at])
        own.sum(1, out=scale[at])
        own /= scale[at][:, None]
        before = own @ model.moves
    back = model.moves.T.copy()
    met = np.zeros_like(back)
    beta = np.ones((0, len(model.start)))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = slice(begins[t], begins[t] + n)
        if n > len(beta):
            beta = np.concatenate([beta, np.ones((n - len(beta), len(model.start)))])
        ahead = emits[at]
        ahead *= beta
        ahead /= scale[at][:, None]
        alpha[at] *= beta
        if t:
            met += alpha[begins[t - 1] : begins[t - 1] + n].T @ ahead
        beta = ahead @ back
    into.moves += met * model.moves
    for k in range(len(model.start)):
        into.emits[:, k] += np.bincount(seq.symbols, alpha[:, k], SYMBOLS)
    if len(active):
        into.start += alpha[: active[0]][first[seq.order]].sum(0)
    into.middle += alpha.sum(0)


def _shares(corpus: Corpus) -> np.ndarray:
    """Share of each symbol in the corpus, none of them zero."""
    return (corpus.tokens + 1) / (corpus.tokens.sum() + SYMBOLS)


def first_model(corpus: Corpus, states: int) -> Model:
    """States that hardly change within a text; each favours symbols of its own, by fixed numbers."""
    likings = mix64(np.arange(SYMBOLS * states, dtype=np.uint64)).reshape(SYMBOLS, states)
    best = likings == likings.max(1, keepdims=True)
    emits = _shares(corpus)[:, None] * np.where(best, FAVOUR, 1.0)
    flat = np.full(states, 1 / states)
    moves = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    return Model(flat, flat, moves, emits / emits.sum(0))


def improved(counts: Counts, corpus: Corpus) -> Model:
    """The model that the expected counts give."""
    emits = counts.emits + SMOOTHING * _shares(corpus)[:, None]
    moves, start, middle = counts.moves + MOVE, counts.start + MOVE, counts.middle + MOVE
    return Model(start / start.sum(), middle / middle.sum(), moves / moves.sum(1, keepdims=True),
                 emits / emits.sum(0))


def with_unseen(model: Model, corpus: Corpus) -> Model:
    """The model with each state's probability of an unseen word: what the discount leaves of
    the buckets, and buckets without words."""
    left = np.minimum(1.0, corpus.discount * corpus.distinct / np.maximum(1, corpus.tokens))
    left[corpus.tokens == 0] = 1.0
    left[END] = 0.0
    emits = model.emits.copy()
    emits[UNSEEN] = left @ model.emits
    return Model(model.start, model.middle, model.moves, emits)


def _with_ends(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with their ends, and the number of each."""
    sizes = np.diff(at) + 1
    symbols = np.full(len(hashes) + len(sizes), END, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(sizes) - 1] = False
    symbols[inner] = _symbols(hashes)
    return symbols, sizes


def expected_counts(docs: DataFrame, model: Model) -> Counts:
    """One Baum-Welch pass over the texts, summed by Spark."""
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts.none(states)
        for part in chunks(batches, limit=BATCH):
            symbols, sizes = _with_ends(*tokens(part.column("text")))
            pieces = -(-sizes // PIECE)
            first = np.zeros(int(pieces.sum()), bool)
            first[np.cumsum(pieces) - pieces] = True
            lengths = np.full(len(first), PIECE, np.int64)
            lengths[np.cumsum(pieces) - 1] = sizes - (pieces - 1) * PIECE
            ends, done, begun = np.cumsum(lengths), 0, 0
            while done < len(lengths):
                stop = max(done + 1, int(np.searchsorted(ends, begun + HELD, "right")))
                forward_backward(shared.value, symbols[begun : ends[stop - 1]], lengths[done:stop],
                                 first[done:stop], sums)
                done, begun = stop, int(ends[stop - 1])
        used = np.flatnonzero(sums.emits.any(1))
        # The other counts go along under numbers below zero.
        keys = np.concatenate([used, -1 - np.arange(states + 2)])
        rows = np.concatenate([sums.emits[used], sums.moves, [sums.start, sums.middle]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), *(pa.array(rows[:, k].astype(np.float32)) for k in range(states))],
            names=["symbol", *names])

    schema = "symbol bigint, " + ", ".join(f"{c} float" for c in names)
    summed = docs.select("text").mapInArrow(run, schema).groupBy("symbol").agg(
        *(F.sum(c).alias(c) for c in names)).toArrow()
    keys = summed.column("symbol").to_numpy()
    rows = np.stack([summed.column(c).to_numpy() for c in names], 1) if len(keys) else np.zeros((0, states))
    out = Counts.none(states)
    out.emits[keys[keys >= 0]] = rows[keys >= 0]
    for key, row in zip((-1 - keys[keys < 0]).tolist(), rows[keys < 0]):
        if key < states:
            out.moves[key] = row
        elif key == states:
            out.start = row
        else:
            out.middle = row
    shared.unpersist()
    return out


def train(docs: DataFrame, tables: Tables, states: int = STATES, rounds: int = ROUNDS
          ) -> tuple[Corpus, Model]:
    """Word counts and a model of the texts; each round reads all of them."""
    corpus = count_words(docs, tables)
    model = first_model(corpus, states)
    for _ in range(rounds):
        model = improved(expected_counts(docs, model), corpus)
        tables.release()
    return corpus, model


_RARE = pa.struct([("h", pa.int64()), ("at", pa.int32())])


def _prepared(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Per row: symbols, what the frequent words give, and the other words with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (corpus.frequent, corpus.counts, corpus.tokens, corpus.discount, corpus.n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, of_symbol, discount, n_docs = shared.value
        for part in chunks(batches, limit=BATCH):
            hashes, at = tokens(part.column("text"))
            symbols, sizes = _with_ends(hashes, at)
            n, h = len(sizes), hashes.view(np.int64)
            owner = np.repeat(np.arange(n), np.diff(at))
            slot = np.searchsorted(frequent, h)
            hit = slot < len(frequent)
            hit[hit] = frequent[slot[hit]] == h[hit]
            c, left = counts[slot[hit]], np.flatnonzero(~hit)
            rare = pa.StructArray.from_arrays(
                [pa.array(h[left]), pa.array((left - at[owner[left]]).astype(np.int32))], fields=list(_RARE))
            share = np.log10((c - discount) / of_symbol[_symbols(hashes[hit])])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.array(symbols.astype(np.int32))),
                pa.array(np.bincount(owner[hit], minlength=n).astype(np.int64) + (n_docs > 0)),
                pa.array(np.bincount(owner[hit], np.log10(c + 1.0), n) + log10(n_docs + 1), pa.float64()),
                pa.array(np.bincount(owner[hit], share, n), pa.float64()),
                pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner[left], np.arange(n + 1)).astype(np.int32)), rare),
            ], names=["doc_id", "held_out", "symbols", "known", "plain", "words", "rare"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, symbols array<int>, known bigint, plain double, "
             "words double, rare array<struct<h:bigint,at:int>>")


def _with_rare(prepared: DataFrame, corpus: Corpus) -> DataFrame:
    """The prepared rows with the sums of their rare words, and the places of unseen ones."""
    rare = prepared.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.at")
    counted = rare.join(corpus.words.where(F.col("n") < corpus.least), "h", "left")
    of_symbol = prepared.sparkSession.createDataFrame(pa.table(
        {"bucket": np.arange(SYMBOLS), "tokens": np.maximum(1, corpus.tokens)}))
    placed = counted.join(F.broadcast(of_symbol), F.pmod("h", F.lit(BUCKETS)) == F.col("bucket"))
    sums = placed.groupBy("row").agg(
        F.count("n").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_plain"),
        F.sum(F.log10((F.col("n") - corpus.discount) / F.col("tokens"))).alias("more_words"),
        F.collect_list(F.when(F.col("n").isNull(), F.col("at"))).alias("unseen"))
    return prepared.drop("rare").join(sums, "row", "left")


def _model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """Adds the model's log10 probability of the symbols, unseen words put in."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c not in ("symbols", "unseen")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, unseen = batch.column("symbols"), batch.column("unseen")
            ends = np.cumsum(np.diff(symbols.offsets.to_numpy()))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + 2 * HELD, "right")))
                own = symbols.slice(start, stop - start).flatten().to_numpy().astype(np.int64)
                sizes = np.diff(ends[start:stop], prepend=base)
                places = unseen.slice(start, stop - start)
                missing = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                own[places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    + np.repeat(np.cumsum(sizes) - sizes, missing)] = UNSEEN
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(start, stop - start) for c in names),
                     pa.array(sizes), pa.array(forward_log10(shared.value, own, sizes))],
                    names=[*names, "n_tokens", "model"])
                start = stop

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kept}, n_tokens bigint, model double")


def score_texts(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS,
                text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, told apart by 64-bit hashes
    (of a billion distinct words, 0.03 pairs would share one), and an end. The model learns from
    the rows that are not `held_out` (null counts as not) and scores all: log10 probabilities by
    add-one counts of the training tokens (base_score) and by the hidden Markov model (score).
    n_known tokens were met in training. A null or empty text has the end alone. Without
    training rows nothing is known. Repeated rows, shared and
    null ids give a row each; other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    chosen = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                         F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         docs[text].cast("string").alias("text"))
    corpus, model = train(chosen.where(~F.col("held_out")), tables, states, rounds)
    prepared = tables.save(_prepared(chosen, corpus).withColumn("row", F.monotonically_increasing_id()))
    scored = _model_scores(_with_rare(prepared, corpus), with_unseen(model, corpus))

    def and_more(own: str, more: str) -> Column:
        return F.col(own) + F.coalesce(more, F.lit(0))

    total = log10(corpus.n_tokens + corpus.n_distinct + 1)
    return scored.select(
        "doc_id", "held_out", "n_tokens", and_more("known", "more").alias("n_known"),
        F.lit(corpus.n_tokens).cast("bigint").alias("train_tokens"),
        (and_more("plain", "more_plain") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + and_more("words", "more_words")).alias("score"))
