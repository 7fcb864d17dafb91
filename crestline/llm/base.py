"""Shared pieces: Arrow-batched maps over texts, seeded mixing, size-checked broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A worker handles texts in slices of about this many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 2 << 20
# A frame is broadcast only after counting at most this many rows of a few fixed-width columns.
BROADCAST_ROWS = 1 << 20
# An Arrow batch holds about this many bytes, unless the session sets its own bound.
BATCH_BYTES = 8 << 20
_BATCH_KEY, _UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)

# What a worker keeps from task to task, of one operator at a time.
_KEPT: dict[tuple, object] = {}


def release(operator: str = "") -> None:
    """Drop what the worker keeps for other operators than ``operator``."""
    for name in [k for k in _KEPT if k[0] != operator]:
        del _KEPT[name]


def kept(operator: str, key, make: Callable[[], object]):
    """The worker's object ``key`` of ``operator``, made at its first use."""
    release(operator)
    if (operator, key) not in _KEPT:
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]


def bound_batches(df: DataFrame) -> None:
    """Bound the bytes of the session's Arrow batches: rows are whole texts of any length."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _UNBOUNDED) == _UNBOUNDED:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) of a batch, null as empty; a slice holds one text at least."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    at, n = 0, batch.num_rows
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]) if n else np.zeros(0, np.int64)
    while at < n:
        end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1 : at + 20_000]), SLICE_BYTES - sizes[at]))
        end = min(max(end, at + 1), n, at + 20_000)
        yield at, end, [b"" if x is None else x for x in col.slice(at, end - at).to_pylist()]
        at = end


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema, operator: str = "") -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; no shuffle, memory bounded by a batch and what ``operator`` keeps."""
    bound_batches(df)

    def run(batches):
        release(operator)
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers made from a rule."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    return mix(mix(base)) | np.uint64(1)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it counts at most ``limit`` rows, else unchanged.

    Use on stored tables of fixed-width columns only: the count is then a
    footer read, and the bound on rows bounds the bytes.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
