"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of the benchmark items. Words are the symbols and
two of them a block: the shift table says how far the search may jump from a
block, a block that may end a pattern leads to a bucket of patterns with that
suffix, and a direct comparison of the words confirms each occurrence. All
patterns of one searcher have the same length, so jumps are as long as can be.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm.base import map_texts, text_slices

# Words of benchmark items in one searcher; larger benchmarks are searched in several passes.
BLOCK_WORDS = 1_000_000
# An item longer than this is cut into overlapping segments, so that a pass stays near its bound.
SEGMENT_WORDS = 50_000

_SPANS = "array<struct<start:long,end:long,item:string>>"

# Digits, a-z and everything beyond ASCII belong to words; A-Z are lower-cased.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def bare_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WuManber:
    """All word patterns of one length ``size``."""

    def __init__(self, size: int, patterns: dict[tuple, list[int]]):
        self.size, self.block = size, min(2, size)
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, owners in patterns.items():
            for end in range(self.block, size + 1):
                key = p[end - self.block : end] if self.block > 1 else p[end - 1]
                jump = size - end
                if jump < self.shift.get(key, size):
                    self.shift[key] = jump
            self.buckets.setdefault(p[size - self.block :] if self.block > 1 else p[-1], []).append((p[0], list(p), owners))
        self.farthest = size - self.block + 1

    def search(self, words: list[bytes], out: list[tuple[int, int, list[int]]]) -> None:
        """Append (start, end, owners) of every occurrence."""
        n, size, shift, far = len(words), self.size, self.shift, self.farthest
        i = size - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if w in shift:
                    out.append((i, i + 1, self.buckets[w][0][2]))
            return
        while i < n:
            key = (words[i - 1], words[i])
            jump = shift.get(key, far)
            if jump == 0:
                a = i - size + 1
                for head, p, owners in self.buckets[key]:
                    if words[a] == head and words[a : i + 1] == p:
                        out.append((a, i + 1, owners))
                jump = 1
            i += jump


def build(items: list[tuple[int, list[bytes]]], window: int) -> list[WuManber]:
    """One searcher per pattern length; an item shorter than the window is one pattern."""
    by_size: dict[int, dict[tuple, list[int]]] = {}
    for k, words in items:
        size = min(window, len(words))
        for a in range(len(words) - size + 1) if size else ():
            owners = by_size.setdefault(size, {}).setdefault(tuple(words[a : a + size]), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [WuManber(size, p) for size, p in sorted(by_size.items())]


def benchmark_segments(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, n_words, seg, words): items as words, long ones in segments that overlap by a window less one."""

    def fn(batch):
        ids = batch.column(0).to_pylist()
        rows = []
        for a, _, texts in text_slices(batch):
            for i, t in enumerate(texts, a):
                w = bare_words(t)
                for seg, at in enumerate(range(0, max(1, len(w) - window + 1), SEGMENT_WORDS)):
                    part = w[at : at + SEGMENT_WORDS + window - 1]
                    if part:
                        rows.append((ids[i], len(part), seg, b" ".join(part).decode()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["item", "n_words", "seg", "words"])

    cols = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return map_texts(cols, fn, "item string, n_words long, seg long, words string")


def _search(docs: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """All columns but the last, which is the text, with (n_words, spans): merged word ranges and their items."""
    shared = docs.sparkSession.sparkContext.broadcast(([x for x, _ in items], [w.encode().split() for _, w in items]))
    state: dict = {}
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())])

    def fn(batch):
        names, words_of = shared.value
        if "s" not in state:
            state["s"] = build(list(enumerate(words_of)), window)
        for a, e, texts in text_slices(batch):
            counts, spans = [], []
            for t in texts:
                words = bare_words(t)
                hits: list = []
                for s in state["s"]:
                    s.search(words, hits)
                counts.append(len(words))
                spans.append(_merged(hits, names) if hits else [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(a, e - a) for k in range(batch.num_columns - 1)), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span))],
                [*batch.schema.names[:-1], "n_words", "spans"],
            )

    out = T.StructType(docs.schema.fields[:-1])
    return map_texts(docs, fn, T.StructType([*out.fields, *T._parse_datatype_string(f"n_words long, spans {_SPANS}").fields]))


def _merged(hits: list, names: list) -> list[dict]:
    """Touching or overlapping spans of one item become one."""
    by: dict = {}
    for start, end, owners in sorted(hits, key=lambda h: h[0]):
        for k in owners:
            runs = by.setdefault(names[k], [])
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(end, runs[-1][1])
            else:
                runs.append([start, end])
    return [{"start": a, "end": b, "item": k} for k, runs in sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")) for a, b in runs]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of every row of ``docs``.

    ``spans`` are word ranges with the item they come from. A null or empty text
    has no words; a null or empty item no windows; items with equal ids count
    once; an item without an id marks words, but is not listed or counted. An
    empty benchmark hits nothing. Repeated rows are reported as often as they
    occur; other columns are ignored.

    The benchmark goes to the executors in blocks of about ``block_words``
    words; one block is one pass without a shuffle, several passes are joined
    on the row's id and text hash.
    """
    found = _found(docs, benchmark, window, doc_id, text, item_id, item_text, block_words, False)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item"]), lambda x: x.isNotNull())))
    covered = F.expr(
        "aggregate(array_sort(transform(spans, s -> struct(s.start AS a, s.end AS e))), struct(0L AS t, 0L AS m), "
        "(x, s) -> struct(x.t + greatest(0L, s.e - greatest(x.m, s.a)) AS t, greatest(x.m, s.e) AS m), x -> x.t)"
    )
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all their columns."""
    return _found(docs, benchmark, window, doc_id, text, item_id, item_text, block_words, True).where(F.size("spans") == 0).select("_row.*")


def _found(docs, benchmark, window, doc_id, text, item_id, item_text, block_words, carry: bool) -> DataFrame:
    """(doc_id, key, _row, n_words, spans); ``_row`` holds all columns of the row if ``carry``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("int")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("_row"), F.col(text).cast("string").alias("text"))
    segments = benchmark_segments(benchmark, window, item_id, item_text)
    size = segments.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))

    def block(b: int) -> list:
        rows = segments.where(F.pmod(F.xxhash64("item", "seg"), F.lit(blocks)) == b).select("item", "words").collect()
        return sorted(((r["item"], r["words"]) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1]))

    if blocks == 1:
        return _search(docs, block(0), window)
    # Rows are told apart by id and text; equal rows have equal results.
    name = F.sha2(F.to_json(F.struct("doc_id", "text")), 256)
    keyed = docs.select("doc_id", name.alias("key"), "_row", "text")
    more = None
    for b in range(blocks):
        hit = _search(keyed.select("key", "text"), block(b), window).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
        more = hit if more is None else more.unionByName(hit)
    more = more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return _search(keyed, [], window).drop("spans").join(more, "key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
