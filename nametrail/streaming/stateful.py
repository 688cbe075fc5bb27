"""Detectors that keep state per key between micro-batches (extensions).

Both run on ``transformWithState`` and keep times in slices: one map entry per slice of
``SLICE_US`` holds its instants, another one what they add up to. A micro-batch loads only the
slices its rows fall into (and, for bursts, those of windows that may beat the largest one);
all else is read from the sums. Slices that the watermark has passed are folded into one
value and removed, so a key has at most (delay + window) / slice entries however many rows it
has. Rows may come in any order within the watermark's delay, and what is given out after each
micro-batch counts them already. One timer per key, in event time, forgets idle keys.

The session needs the RocksDB state store: ``use_state_store(spark)``.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_HOURS = 24.0
SLICE_US = 10_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that map state and timers need, for queries started from now on."""
    spark.conf.set(STORE, ROCKSDB)


@dataclass
class Span:
    """Count, first and last time and sum of squared gaps of the instants of a stretch of time.

    All are whole numbers, so spans put together in order equal the span of all their rows.
    """

    n: int = 0
    first: int = 0
    last: int = 0
    squares: int = 0

    @classmethod
    def of(cls, times: np.ndarray, counts: np.ndarray) -> "Span":
        gaps = np.diff(times).astype(object)
        return cls(int(counts.sum()), int(times[0]), int(times[-1]), int((gaps * gaps).sum()))

    @classmethod
    def stored(cls, row: tuple) -> "Span":
        return cls(row[0], row[1], row[2], int(row[3]))

    def row(self) -> tuple:
        return self.n, self.first, self.last, str(self.squares)

    def then(self, later: "Span") -> "Span":
        if not self.n or not later.n:
            return later if later.n else self
        return Span(self.n + later.n, self.first, later.last,
                    self.squares + later.squares + (later.first - self.last) ** 2)

    def interval_seconds(self) -> tuple[float, float]:
        """Mean and population deviation of the gaps."""
        if self.n < 2:
            return 0.0, 0.0
        gaps, span = self.n - 1, self.last - self.first
        variance = max(0, self.squares * gaps - span * span) / gaps**2
        return span / gaps / 1e6, variance**0.5 / 1e6


SPAN = "n bigint, first bigint, last bigint, squares string"


class _Sliced(StatefulProcessor):
    """Instants per slice, and the timer that ends an idle key."""

    #: Schemas of a slice's summary and of the key's value besides the timer.
    summary = value = ""

    def __init__(self, slice_us: int, idle_hours: float) -> None:
        self.slice_us, self.idle_ms = slice_us, round(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", f"{self.value}, newest bigint, timer boolean")
        self.sums = handle.getMapState("sums", "slice bigint", self.summary)
        self.instants = handle.getMapState("instants", "slice bigint", "us array<bigint>, n array<bigint>")

    def close(self) -> None:
        pass

    def summarized(self, times: np.ndarray, counts: np.ndarray) -> tuple:
        raise NotImplementedError

    def load(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Instants of one slice in order, and the rows at each."""
        times, counts = self.instants.getValue((number,)) if self.instants.containsKey((number,)) else ([], [])
        return np.array(times, np.int64), np.array(counts, np.int64)

    def add(self, rows: Iterator[pd.DataFrame], earliest: int) -> list[int]:
        """Puts the rows from ``earliest`` on into their slices; returns the slices' numbers."""
        new: dict[int, list[np.ndarray]] = {}
        for batch in rows:
            us = np.sort(batch["us"].to_numpy(np.int64))
            us = us[us >= earliest]
            numbers = us // self.slice_us
            for part in np.split(us, np.flatnonzero(np.diff(numbers)) + 1):
                if len(part):
                    new.setdefault(int(part[0] // self.slice_us), []).append(part)
        for number, parts in new.items():
            times, counts = self.load(number)
            every = np.concatenate([times, *parts])
            weights = np.concatenate([counts, np.ones(len(every) - len(times), np.int64)])
            times, where = np.unique(every, return_inverse=True)
            counts = np.bincount(where, weights, len(times)).astype(np.int64)
            self.instants.updateValue((number,), (times.tolist(), counts.tolist()))
            self.sums.updateValue((number,), self.summarized(times, counts))
        return sorted(new)

    def remove(self, number: int) -> None:
        self.sums.removeKey((number,))
        self.instants.removeKey((number,))

    def keep(self, value: tuple, newest: int, timer: bool, watermark_ms: int) -> None:
        """Store the key's value; where no timer runs, start one."""
        if not timer:
            self.handle.registerTimer(max(newest // 1000, watermark_ms) + self.idle_ms)
        self.own.update((*value, newest, True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *value, newest, _ = self.own.get()
        ends = newest // 1000 + self.idle_ms
        if ends > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(ends)
        else:
            for state in (self.own, self.sums, self.instants):
                state.clear()
        return iter(())


class BeaconState(_Sliced):
    summary = SPAN
    value = SPAN

    def summarized(self, times: np.ndarray, counts: np.ndarray) -> tuple:
        return Span.of(times, counts).row()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *value, newest, timer = self.own.get() if self.own.exists() else (0, 0, 0, "0", 0, False)
        folded = Span.stored(value)
        # What is older than the folded slices lies outside the delay.
        earliest = (folded.last // self.slice_us + 1) * self.slice_us if folded.n else -(1 << 62)
        self.add(rows, earliest)
        watermark = timerValues.getCurrentWatermarkInMs()
        total, passed = folded, []
        for number, span in sorted((k[0], Span.stored(v)) for k, v in self.sums.iterator()):
            total = total.then(span)
            if (number + 1) * self.slice_us <= watermark * 1000:
                folded, passed = total, [*passed, number]
        for number in passed:
            self.remove(number)
        self.keep(folded.row(), max(newest, total.last), timer, watermark)
        if total.n:
            yield pd.DataFrame([(*key, total.n, *total.interval_seconds(), total.last)], columns=[
                "src_ip", "query_name", "n_queries", "mean_interval_sec", "std_interval_sec", "last_us"])


class BurstState(_Sliced):
    summary = "n bigint"
    value = "best bigint, end bigint"

    def __init__(self, window_us: int, count_threshold: int, slice_us: int, idle_hours: float) -> None:
        super().__init__(slice_us, idle_hours)
        self.window_us, self.least = window_us, count_threshold

    def summarized(self, times: np.ndarray, counts: np.ndarray) -> tuple:
        return (int(counts.sum()),)

    def largest(self, numbers: list[int], held: dict[int, tuple]) -> tuple[int, int]:
        """Most rows in a closed window that ends inside the last of these slices, and its end.

        ``held`` keeps the slices that the last call loaded and this one needs again.
        """
        for k in [k for k in held if k < numbers[0]]:
            del held[k]
        held.update({k: self.load(k) for k in numbers if k not in held})
        parts = [held[k] for k in numbers]
        ends = parts[-1][0]
        times = np.concatenate([t for t, _ in parts])
        sums = np.concatenate([[0], np.cumsum(np.concatenate([c for _, c in parts]))])
        inside = (sums[np.searchsorted(times, ends, "right")]
                  - sums[np.searchsorted(times, ends - self.window_us, "left")])
        at = int(inside.argmax())
        return int(inside[at]), int(ends[at])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, end, newest, timer = self.own.get() if self.own.exists() else (0, 0, 0, False)
        watermark = timerValues.getCurrentWatermarkInMs()
        touched = self.add(rows, -(1 << 62))
        sums = {k[0]: v[0] for k, v in self.sums.iterator()}
        near, held = self.window_us // self.slice_us + 1, {}
        for number in sorted(sums):
            # Windows that end here change only if a slice was touched within one window before.
            if not any(number - near <= t <= number for t in touched):
                continue
            numbers = [k for k in sorted(sums) if number - near <= k <= number]
            if sum(sums[k] for k in numbers) < max(best, self.least):
                continue
            most, at = self.largest(numbers, held)
            if most > best or (most == best and at < end):
                best, end = most, at
        newest = max([newest, *((t + 1) * self.slice_us - 1 for t in touched)])
        for number in sums:
            # A late row can only add to windows that end after the watermark.
            if (number + 1) * self.slice_us <= watermark * 1000 - self.window_us:
                self.remove(number)
        self.keep((best, end), newest, timer, watermark)
        if best >= self.least:
            yield pd.DataFrame([(*key, best, end)], columns=["src_ip", "max_nxdomain_in_window", "end_us"])


def beacon_state(events: DataFrame, delay: str = "10 minutes", idle_hours: float = IDLE_HOURS,
                 slice_us: int = SLICE_US) -> DataFrame:
    """Running interval statistics per (host, name), after each micro-batch.

    The last row of a pair equals the batch features of its rows. A pair idle for
    ``idle_hours`` is forgotten; slower beacons need more.
    """
    return (
        events.withWatermark("timestamp", delay)
        .select("timestamp", "src_ip", "query_name", F.unix_micros("timestamp").alias("us"))
        .groupBy("src_ip", "query_name")
        .transformWithStateInPandas(
            BeaconState(slice_us, idle_hours),
            "src_ip string, query_name string, n_queries bigint, mean_interval_sec double, "
            "std_interval_sec double, last_us bigint", "Update", "EventTime"))


def burst_state(events: DataFrame, window_minutes: float = 5.0, count_threshold: int = 20,
                delay: str = "10 minutes", idle_hours: float = IDLE_HOURS,
                slice_us: int = SLICE_US) -> DataFrame:
    """Hosts whose largest closed failure window reached the threshold so far.

    The exact count of the batch operator, and the first window that has it.
    """
    return (
        events.where(F.col("response_code") == "NXDOMAIN")
        .withWatermark("timestamp", delay)
        .select("timestamp", "src_ip", F.unix_micros("timestamp").alias("us"))
        .groupBy("src_ip")
        .transformWithStateInPandas(
            BurstState(round(window_minutes * 60_000_000), count_threshold, slice_us, idle_hours),
            "src_ip string, max_nxdomain_in_window bigint, end_us bigint", "Update", "EventTime"))
