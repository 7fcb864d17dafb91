"""State processors: a small value and a reorder buffer per post or tag, both of which end.

Rows may come in any order within the watermark's delay. Each processor holds
back the rows that the watermark has not passed, so that what is final only
ever advances in event-time order; an event-time timer releases them, and a
key that has been silent for ``keep_hours`` is cleared. Rows that the watermark
has passed already are dropped by the engine.

Posts and tags are many and each has few rows, so they are dealt over a fixed
number of buckets, and the keyed state of the stream is that of a bucket: one
call, one read and one write for all its keys, as two integer matrices. A call
steps only keys that have new or released rows. Memory per call is one bucket's
rows of one batch and of one delay; more buckets make it smaller.

Rows of a key are handled as sorted arrays: a step jumps to the next row that
can change the state (binary search), it does not visit all rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crestline.config import DEFAULT, STATE_RANK, Config
from crestline.functions import scalars as S

METRICS = ("views", "likes", "comments", "shares", "saves")
HOUR = 3_600_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = np.iinfo(np.int64).min  # stands for a missing number inside arrays


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB provider; set for the session, unless it is already."""
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


BUCKETS = 1024


class Reordered(StatefulProcessor):
    """Rows of every key of a bucket in event-time order, as numbers: ``COLUMNS``, the first of them the time in microseconds.

    A subclass turns a key's released rows, sorted by all columns, into its next
    value and output (``step``), and a bucket's outputs into a frame (``frame``).
    """

    KEY = "post_id"
    COLUMNS: tuple[str, ...] = ()
    VALUE = ""

    def __init__(self, keep_hours: float):
        self.keep = int(keep_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows (key, COLUMNS) that wait, rows (key, expiry in ms, VALUE) of known keys, and the time in ms of the next release or expiry.
        self.state = handle.getValueState("state", "waiting binary, held binary, due bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = np.concatenate([self.numbers(f) for f in rows])
        yield from self._run(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._run(np.zeros((0, 1 + len(self.COLUMNS)), np.int64), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def numbers(self, frame: pd.DataFrame) -> np.ndarray:
        """The rows of a frame as an integer matrix, the key first."""
        return np.stack([frame[c].astype("Int64").to_numpy(np.int64, na_value=NONE) for c in (self.KEY, *self.COLUMNS)], axis=1)

    def step(self, value: list[int] | None, rows: np.ndarray, waiting: np.ndarray) -> tuple[tuple | None, Any]:
        """A key's value after the released rows, and its output or None."""
        raise NotImplementedError

    def frame(self, keys: list[int], outs: list) -> pd.DataFrame:
        """The outputs of some keys as rows."""
        raise NotImplementedError

    def advance(self, key: Any, value: tuple | None, rows: np.ndarray, waiting: np.ndarray) -> tuple[tuple | None, pd.DataFrame | None]:
        """One key's step with its output as a frame."""
        value, out = self.step(None if value is None else list(value), rows, waiting)
        return value, None if out is None else self.frame([key[0]], [out])

    def _run(self, new: np.ndarray, mark_ms: int) -> Iterator[pd.DataFrame]:
        width = 2 + len(self.VALUE.split(","))
        old_due = None
        waiting, held = np.zeros((0, new.shape[1]), np.int64), np.zeros((0, width), np.int64)
        if self.state.exists():
            a, b, old_due = self.state.get()
            waiting, held = np.frombuffer(a, np.int64).reshape(-1, new.shape[1]), np.frombuffer(b, np.int64).reshape(-1, width)
        rows = np.concatenate([waiting, new])
        rows = rows[np.lexsort(rows.T[::-1])]
        ready = rows[:, 1] <= mark_ms * 1000
        keys, starts = np.unique(rows[:, 0], return_index=True)
        released = np.add.reduceat(ready.astype(np.int64), starts) if len(keys) else starts
        todo = np.flatnonzero((released > 0) | np.isin(keys, new[:, 0]))
        # ``held`` is sorted by key.
        at = np.searchsorted(held[:, 0], keys[todo])
        known = at < len(held)
        known[known] = held[at[known], 0] == keys[todo][known]
        ends = np.append(starts[1:], len(rows))
        plain, values, gone, outs, out_keys = rows[:, 1:], [], [], [], []
        for i, h, is_known in zip(todo.tolist(), at.tolist(), known.tolist()):
            key, start, end = int(keys[i]), int(starts[i]), int(ends[i])
            split = start + int(released[i])
            before = held[h].tolist() if is_known else None
            value, out = self.step(before[2:] if before else None, plain[start:split], plain[split:end])
            if value is not None:
                expiry = (int(plain[end - 1, 0]) + self.keep) // 1000
                values.append((key, max(expiry, before[1]) if before else expiry, *value))
            if is_known:
                gone.append(h)
            if out is not None:
                out_keys.append(key)
                outs.append(out)
        waiting = rows[~ready]
        held = np.concatenate([np.delete(held, gone, axis=0), np.array(values, np.int64).reshape(-1, width)])
        held = held[(held[:, 1] > mark_ms) | np.isin(held[:, 0], waiting[:, 0])]
        held = held[np.argsort(held[:, 0], kind="stable")]
        times = [-(-int(waiting[:, 1].min()) // 1000)] if len(waiting) else []
        times += [int(held[:, 1].min())] if len(held) else []
        due = min(times, default=None)
        if due != old_due:
            if old_due is not None:
                self.handle.deleteTimer(old_due)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.state.clear()
        else:
            self.state.update((waiting.tobytes(), held.tobytes(), due))
        if outs:
            yield self.frame(out_keys, outs)


def _ints(values) -> pd.Series:
    """Integers of which ``NONE`` and None are missing."""
    numbers = np.array([NONE if v is None else v for v in values] if isinstance(values, list) else values, np.int64)
    return pd.Series(pd.arrays.IntegerArray(numbers, numbers == NONE))


class SnapshotDedup(Reordered):
    """Keeps a snapshot unless it repeats the newest kept one within the window; emits when the watermark has passed it."""

    OUT = "post_id bigint, observed_us bigint, views bigint, likes bigint, comments bigint, shares bigint, saves bigint"
    COLUMNS = ("observed_us", *METRICS)
    VALUE = "t bigint, " + ", ".join(f"{m} bigint" for m in METRICS)

    def __init__(self, cfg: Config = DEFAULT, keep_hours: float = 192.0):
        super().__init__(keep_hours)
        self.gap = int(cfg.dedup_minutes * 60_000_000)

    def step(self, value, rows, waiting):
        if not len(rows):
            return value, None
        first = np.array([value], np.int64) if value is not None else np.zeros((0, rows.shape[1]), np.int64)
        both = np.concatenate([first, rows])
        t = both[:, 0]
        # A row that differs from the one before it, or lies further from it than the window, starts a stretch and is kept.
        start = np.ones(len(both), bool)
        start[1:] = (both[1:, 1:] != both[:-1, 1:]).any(axis=1) | (np.diff(t) > self.gap)
        heads = np.flatnonzero(start)
        keep = [heads]
        for a, b in zip(heads, [*heads[1:], len(both)]):
            at = a
            while t[b - 1] - t[at] > self.gap:
                at = a + int(np.searchsorted(t[a:b], t[at] + self.gap, "right"))
                keep.append(np.array([at]))
        kept = np.unique(np.concatenate(keep))
        last = both[kept[-1]]
        out = both[kept[kept >= len(first)]]
        return tuple(last.tolist()), out

    def frame(self, keys, outs):
        rows = np.concatenate(outs)
        of = np.repeat(_ints(keys).to_numpy(np.int64, na_value=NONE), [len(o) for o in outs])
        return pd.DataFrame({"post_id": _ints(of), **{c: _ints(rows[:, i]) for i, c in enumerate(self.COLUMNS)}})


class HeldState(Reordered):
    """Trend-state machine: upgrades at once, downgrades after the hold; emits when the watermark has passed a row."""

    OUT = "key bigint, at_us bigint, candidate string, trend_state string, since_us bigint"
    KEY = "key"
    COLUMNS = ("at_us", "code")
    VALUE = "code bigint, since bigint"
    # Fixed numbers of the states inside arrays.
    NAMES = tuple(STATE_RANK)

    def __init__(self, cfg: Config = DEFAULT, keep_hours: float = 24.0 * 40):
        super().__init__(keep_hours)
        self.hold = int(cfg.hysteresis_hours * HOUR)

    def numbers(self, frame):
        codes = frame["candidate"].map({n: i for i, n in enumerate(self.NAMES)})
        return super().numbers(frame.assign(code=codes))

    def step(self, value, rows, waiting):
        n = len(rows)
        if not n:
            return value, None
        at, code = rows[:, 0], rows[:, 1]
        state, since = np.zeros(n, np.int64), np.zeros(n, np.int64)
        cur, since_us = (int(value[0]), int(value[1])) if value is not None else (int(code[0]), int(at[0]))
        runs = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
        for a, b in zip(runs, [*runs[1:], n]):
            c, change = int(code[a]), b
            if c != cur:
                up = STATE_RANK[self.NAMES[c]] >= STATE_RANK[self.NAMES[cur]]
                change = a if up else a + int(np.searchsorted(at[a:b], since_us + self.hold))
            state[a:change], since[a:change] = cur, since_us
            if change < b:
                cur, since_us = c, int(at[change])
                state[change:b], since[change:b] = cur, since_us
        return (cur, since_us), np.stack([at, code, state, since], axis=1)

    def frame(self, keys, outs):
        rows, names = np.concatenate(outs), np.array(self.NAMES, object)
        of = np.repeat(_ints(keys).to_numpy(np.int64, na_value=NONE), [len(o) for o in outs])
        return pd.DataFrame({"key": _ints(of), "at_us": rows[:, 0], "candidate": names[rows[:, 1]], "trend_state": names[rows[:, 2]], "since_us": rows[:, 3]})


class LiveVelocity(Reordered):
    """Carries a post's last anchors and emits its rates after every batch that brings or releases rows.

    The emitted row covers all rows so far, those still waiting included, so it
    is provisional: a late point that changes it brings a new row for the post,
    which replaces the earlier one (update mode). ``last_us`` and ``last_views``
    are for posts without an interval, see ``with_estimate``.
    """

    OUT = (
        "post_id bigint, published_us bigint, kind string, vph double, vph_previous double, confidence string, intervals bigint, had_drop boolean, "
        "last_us bigint, last_views bigint"
    )
    COLUMNS = ("observed_us", "views", "published_us")
    VALUE = "n bigint, t0 bigint, v0 bigint, t1 bigint, v1 bigint, t2 bigint, v2 bigint, fell bigint, last_t bigint, last_v bigint, published bigint"

    def __init__(self, cfg: Config = DEFAULT, keep_hours: float = 192.0):
        super().__init__(keep_hours)
        self.gap = int(cfg.min_interval_hours * HOUR)

    def numbers(self, frame):
        return super().numbers(frame[frame["views"].notna() & frame["published_us"].notna()])

    def _walk(self, s: list[int], rows: np.ndarray) -> list[int]:
        t, v = rows[:, 0].tolist(), rows[:, 1].tolist()
        n, t0, v0, t1, v1, t2, v2, fell, last_t, last_v, published = s
        at = bisect_left(t, t0 + self.gap)
        while at < len(t):
            n, t2, v2, t1, v1, fell = n + 1, t1, v1, t0, v0, int(fell or v[at] < v0)
            t0, v0 = t[at], v[at]
            at = max(at + 1, bisect_left(t, t0 + self.gap))
        if t:
            last_t, last_v = t[-1], v[-1]
        return [n, t0, v0, t1, v1, t2, v2, fell, last_t, last_v, published]

    def step(self, value, rows, waiting):
        if value is None:
            if not len(rows) and not len(waiting):
                return None, None
            published = int((rows if len(rows) else waiting)[0, 2])
            value = (0, published, 0, NONE, NONE, NONE, NONE, 0, NONE, NONE, published)
        final = self._walk(list(value), rows)
        n, t0, v0, t1, v1, t2, v2, fell, last_t, last_v, published = self._walk(final, waiting)

        def rate(ta, va, tb, vb):
            return max(vb - va, 0) / ((tb - ta) / HOUR)

        real = n - 1
        row = (
            published, "OBSERVED" if real >= 1 else "ESTIMATED", rate(t1, v1, t0, v0) if n >= 1 else None, rate(t2, v2, t1, v1) if real >= 2 else None,
            "HIGH" if real >= 2 else "MEDIUM" if real >= 1 else "LOW", n, bool(fell), last_t, last_v,
        )
        return tuple(final), row

    def frame(self, keys, outs):
        frame = pd.DataFrame(outs, columns=[c.split()[0] for c in self.OUT.split(", ")][1:]).astype({"vph": "float64", "vph_previous": "float64"})
        for c in ("published_us", "last_us", "last_views"):
            frame[c] = _ints(frame[c].tolist())
        frame.insert(0, "post_id", _ints(keys))
        return frame


def with_estimate(rates: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Rates of ``velocity_stream`` with the estimate of posts that have no interval yet: last views by age at ``now``."""
    age = F.greatest(S.age_hours(F.timestamp_micros("published_us"), S.as_time(now)), F.lit(cfg.min_estimation_age_hours))
    vph: Column = F.when(F.col("intervals") > 0, F.col("vph")).otherwise(F.col("last_views") / age)
    return rates.withColumn("vph", vph)


def _with(df: DataFrame, at_us: str, late: str, processor: Reordered, mode: str) -> DataFrame:
    use_rocksdb(df.sparkSession)
    bucket = F.pmod(F.xxhash64(processor.KEY), F.lit(BUCKETS))
    timed = df.withColumns({"_at": F.timestamp_micros(at_us), "_bucket": bucket}).withWatermark("_at", late)
    return timed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUT, outputMode=mode, timeMode="EventTime"
    )


def dedup_stream(snapshots: DataFrame, cfg: Config = DEFAULT, late: str = "1 hour", keep_hours: float = 192.0) -> DataFrame:
    """Input: post_id, observed_us and the five metrics."""
    return _with(snapshots, "observed_us", late, SnapshotDedup(cfg, keep_hours), "Append")


def held_state_stream(candidates: DataFrame, cfg: Config = DEFAULT, late: str = "1 hour", keep_hours: float = 24.0 * 40) -> DataFrame:
    """Input: key, at_us, candidate."""
    return _with(candidates, "at_us", late, HeldState(cfg, keep_hours), "Append")


def velocity_stream(snapshots: DataFrame, cfg: Config = DEFAULT, late: str = "1 hour", keep_hours: float = 192.0) -> DataFrame:
    """Input: post_id, published_us, observed_us, views."""
    return _with(snapshots, "observed_us", late, LiveVelocity(cfg, keep_hours), "Update")
