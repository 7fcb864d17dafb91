"""Packing documents into sequences of a fixed number of tokens.

Only lengths decide how pieces combine, and a length is at most the capacity.
So the plan is made on the histogram of lengths, whatever the number of
documents: exact complements of one, two or three other lengths are looked up
in indexes of length sums and consumed as often as counts allow; what is left
goes where it fits best. Pieces are then numbered within their length by
shard-wise counts, and each looks its place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.base import bound_batches, text_slices
from crestline.llm.tokens import default_path, encoder
from crestline.session import materialize

CAPACITY = 2048


def complement(gap: int, left: np.ndarray, pairs: np.ndarray) -> tuple[int, ...] | None:
    """Lengths, largest first, that fill ``gap`` exactly; one, else two, else three of them.

    ``left`` counts the pieces of each length; ``pairs[s]`` is the larger half
    of some two lengths of sum ``s``, 0 without one, and may be out of date.
    """
    if left[gap]:
        return (gap,)

    def two(s: int) -> tuple[int, int] | None:
        a = int(pairs[s]) if s >= 2 else 0
        if a and left[a] and left[s - a] > (a == s - a):
            return a, s - a
        if s < 2:
            return None
        half = np.arange((s + 1) // 2, s)
        ok = (left[half] > 0) & (left[s - half] > (half == s - half))
        pairs[s] = half[ok][-1] if ok.any() else 0
        return (int(pairs[s]), s - int(pairs[s])) if pairs[s] else None

    if found := two(gap):
        return found
    for a in np.flatnonzero(left[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        left[a] -= 1
        rest = two(gap - a)
        left[a] += 1
        if rest and rest[0] <= a:
            return a, *rest
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), covering every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for k, c in counts.items():
        left[k] = c
    pairs = np.zeros(capacity + 1, np.int64)
    made: list[tuple[tuple[int, ...], int]] = []
    spare: dict[int, int] = {}
    for a in range(capacity, 0, -1):
        while left[a]:
            if a == capacity:
                found: tuple[int, ...] | None = ()
            else:
                left[a] -= 1
                found = complement(capacity - a, left, pairs)
                left[a] += 1
            if found is None:
                spare[a] = int(left[a])
                left[a] = 0
                break
            need = Counter((a, *found))
            times = min(int(left[k]) // v for k, v in need.items())
            for k, v in need.items():
                left[k] -= v * times
            made.append(((a, *found), times))
    return made + best_fit(spare, capacity)


def best_fit(spare: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: open sequences of equal content are handled together."""
    open_by_gap: dict[int, list[list]] = {}
    for a in sorted(spare, reverse=True):
        n = spare[a]
        while n:
            gap = min((g for g in open_by_gap if g >= a), default=None)
            if gap is None:
                per = capacity // a
                full, rest = divmod(n, per)
                for k, times in ((per, full), (rest, 1)):
                    if k and times:
                        open_by_gap.setdefault(capacity - k * a, []).append([(a,) * k, times])
                break
            group = open_by_gap[gap]
            content, times = group[-1]
            take = min(n, times)
            open_by_gap.setdefault(gap - a, []).append([(*content, a), take])
            n -= take
            if take == times:
                group.pop()
                if not group:
                    del open_by_gap[gap]
            else:
                group[-1][1] -= take
    return [(tuple(c), t) for groups in open_by_gap.values() for c, t in groups]


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, shard, nth) with ``nth`` counting equal lengths of a shard."""

    def fn(batches):
        shard, seen = TaskContext.get().partitionId(), Counter()
        enc = encoder(tokenizer)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, _, texts in text_slices(batch):
                rows = []
                for i, ids in enumerate(enc.encode(texts, end), a):
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((names[i], piece, at // 4, n, zlib.crc32(part), shard, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _PIECE)], schema=_PIECE)

    bound_batches(docs)
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(fn, "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, nth long")


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("nth", pa.int64())])


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: rank from which a slot applies, its first sequence, step-wise offset of the slot.

    The plan's sequences are numbered in order; within a length, ranks are
    handed to slots in the same order.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, times in made:
        offset = 0
        for a in lengths:
            rows.setdefault(a, []).append((used[a], base, offset))
            used[a] += times
            offset += a
        base += times
    return {a: tuple(np.array(c, np.int64) for c in zip(*r)) for a, r in rows.items()}


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and ``end``; a null or empty text is ``end`` alone.
    Only documents longer than ``capacity`` are cut. Repeated rows and null ids
    are packed like any other row; an empty table gives no sequences.

    The plan has at most a few entries per length and reaches the executors as
    one broadcast bounded by the capacity, not by the data.
    """
    pieces = materialize(token_pieces(docs, tokenizer or default_path(), end, capacity, doc_id, text), "pieces")
    per = materialize(pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    first = materialize(per.withColumn("first", F.coalesce(before, F.lit(0)).cast("long")).drop("n"), "first")
    ranked = pieces.join(first, ["shard", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )

    def fn(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for a in np.unique(length).tolist():
                at, base, offset = shared.value[a]
                m = length == a
                k = np.searchsorted(at, rank[m], side="right") - 1
                seq[m], off[m] = base[k] + rank[m] - at[k], offset[k]
            cols = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(fn, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
