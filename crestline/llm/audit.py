"""Audit of filters that act in sequence: what each removes in every order of application.

A document is reduced to a mask of the filters it fails. Four of them depend on
the text alone; the fifth (a copy of a smaller id's text) needs all texts, and
is found with radix tries:

1. A task inserts the texts it reads into a compressed trie whose terminals hold
   the smallest id; only one row per distinct text goes on with its text, the
   others are known to be copies.
2. Those texts are range-partitioned by prefixes, as long as a sample needs to
   tell ranges of even weight apart. A range that many texts share beyond the
   sampled prefix is dealt further by a digest of the whole text.
3. A range is inserted into a trie again; a traversal of its terminals flags
   every row with a larger id than the terminal's.

Masks are then counted per part, and all orders are sums over at most 32 masks.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.base import bound_batches, map_texts, release, small, text_slices
from crestline.session import materialize

LETTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LATER = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

# A task's trie is emptied when it holds so many bytes of text; a range gets about so many.
TRIE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
# Texts sampled for the range bounds, and how much of each is looked at.
SAMPLE = 1 << 13
PREFIX = 256


def text_mask(t: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = t.split()
    n = len(words)
    points = len(t.translate(None, _LATER))
    upper = len(t) - len(t.translate(None, _UPPER))
    marks = len(t.translate(None, _MARKS)) < len(t)
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 3 * points) << 2 | marks << 3


class Node:
    """A trie node: ``text[a:b]`` leads to it, ``text[:b]`` is its path. Of the texts that end here, ``low`` is the smallest id and ``seen`` counts (id, part)."""

    __slots__ = ("text", "a", "b", "edges", "low", "seen", "mask")

    def __init__(self, text: bytes, a: int, b: int):
        self.text, self.a, self.b = text, a, b
        self.edges: dict[int, Node] = {}
        self.low: int | None = None
        self.seen: dict[tuple[int | None, str], int] | None = None
        self.mask = 0


def _same(x: bytes, y: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTrie:
    """Compressed trie over whole texts; edges are slices of the texts that made them."""

    def __init__(self):
        self.root = Node(b"", 0, 0)
        self.bytes = 0

    def insert(self, text: bytes, doc_id: int | None, part: str, n: int = 1, mask: int | None = None) -> None:
        """Add ``n`` rows to the terminal of ``text`` and take their id into its minimum; a new terminal gets its mask."""
        at, pos = self.root, 0
        while pos < len(text):
            child = at.edges.get(text[pos])
            if child is None:
                child = at.edges[text[pos]] = Node(text, pos, len(text))
                self.bytes += len(text) - pos + 200
                at, pos = child, len(text)
                break
            size = child.b - child.a
            label, rest = child.text[child.a : child.b], text[pos : pos + size]
            if label == rest:
                at, pos = child, pos + size
                continue
            k = _same(label, rest)
            fork = Node(child.text, child.a, child.a + k)
            at.edges[text[pos]] = fork
            child.a += k
            fork.edges[child.text[child.a]] = child
            at, pos = fork, pos + k
        if at.seen is None:
            at.seen = {}
            at.mask = text_mask(text) if mask is None else mask
        at.seen[doc_id, part] = at.seen.get((doc_id, part), 0) + n
        self.bytes += 150
        if doc_id is not None and (at.low is None or doc_id < at.low):
            at.low = doc_id

    def terminals(self) -> Iterator[Node]:
        """Nodes where texts end, depth first with an explicit stack."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.seen is not None:
                yield node
            todo.extend(node.edges.values())


_MASK = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_ROW = pa.schema([*_MASK, pa.field("bucket", pa.int32()), pa.field("salt", pa.int32()), pa.field("text", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _bounds(docs: DataFrame) -> tuple[list[bytes], list[int]]:
    """Range bounds, and over how many groups each range is dealt.

    Bounds are the shortest prefixes that tell neighbouring sampled texts
    apart, chosen at even steps of bytes. The bytes of every range are then
    counted over all texts.
    """
    total = docs.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("s")).first()
    if not total["n"]:
        return [], [1]
    every = max(1, math.ceil(total["n"] / SAMPLE))
    # Rows without an id share a hash; the text's digest spreads them.
    rows = docs.where(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(every)) == 0).select(
        F.substring(F.col("text").cast("binary"), 1, PREFIX).alias("p"), F.octet_length("text").alias("n")
    ).toArrow()
    sampled = sorted((p or b"", n or 0) for p, n in zip(rows.column("p").to_pylist(), rows.column("n").to_pylist()))
    ranges = max(1, min(SAMPLE // 4, math.ceil((total["s"] or 0) / RANGE_BYTES)))
    step = sum(n for _, n in sampled) / ranges
    bounds: list[bytes] = []
    held = 0
    for (p, n), (q, _) in zip(sampled, sampled[1:]):
        held += n
        if held >= step and p != q:
            bounds.append(q[: _same(p, q) + 1])
            held = 0
    if ranges == 1:
        return [], [1]
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def weigh(batch):
        size = [0] * (len(shared.value) + 1)
        for _, _, texts in text_slices(batch):
            for t in texts:
                size[bisect.bisect_right(shared.value, t)] += len(t)
        used = [i for i, s in enumerate(size) if s]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([size[i] for i in used], pa.int64())], ["bucket", "bytes"])

    sums = {r["bucket"]: r["s"] for r in map_texts(docs, weigh, "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("s")).collect()}
    return bounds, [max(1, math.ceil(sums.get(i, 0) / (4 * RANGE_BYTES))) for i in range(len(bounds) + 1)]


def document_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): ``n`` equal rows; bit k of ``mask`` is set if they fail filter ``LETTERS[k]``.

    A null text is empty, a null part the empty string. Of rows with equal id
    and text none is a copy of the other. A row without an id is no copy, and
    no row is a copy of it. Other columns are ignored.
    """
    cols = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    )
    bounds, salts = _bounds(cols)
    shared = docs.sparkSession.sparkContext.broadcast((bounds, salts, sum(salts)))
    copy = 1 << LETTERS.index("E")

    def flush(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        bounds, salts, groups = shared.value
        rows, size = [], 0
        for node in trie.terminals():
            t = node.text[: node.b]
            b = bisect.bisect_right(bounds, t)
            salt = xxhash.xxh64_intdigest(t) % salts[b]
            for (i, p), n in node.seen.items():
                if i == node.low and i is not None:
                    rows.append((i, p, node.mask, n, b, salt, t))
                    size += len(t)
                else:  # settled: a copy, or without an id
                    rows.append((i, p, node.mask | (0 if i is None else copy), n, -1, hash(i) % groups, None))
                if len(rows) >= 5_000 or size >= 4 << 20:
                    yield _batch(rows, _ROW)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _ROW)

    def mark(batches):
        release()
        trie = RadixTrie()
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, _, texts in text_slices(batch):
                for i, t in enumerate(texts, a):
                    trie.insert(t, ids[i], parts[i])
                if trie.bytes >= TRIE_BYTES:
                    yield from flush(trie)
                    trie = RadixTrie()
        yield from flush(trie)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows = RadixTrie(), []
        for batch in batches:
            got = {f.name: c for f, c in zip(batch.schema, batch.columns)}
            for i, p, m, n, t in zip(*(got[c].to_pylist() for c in ("doc_id", "part", "mask", "n", "text"))):
                if t is None:
                    rows.append((i, p, m, n))
                else:
                    trie.insert(t, i, p, n, m)
            if len(rows) >= 5_000:
                yield _batch(rows, _MASK)
                rows = []
        for node in trie.terminals():
            rows.extend((i, p, node.mask | (copy if i > node.low else 0), n) for (i, p), n in node.seen.items())
            if len(rows) >= 5_000:
                yield _batch(rows, _MASK)
                rows = []
        if rows:
            yield _batch(rows, _MASK)

    bound_batches(docs)
    dealt = cols.mapInArrow(mark, "doc_id long, part string, mask int, n long, bucket int, salt int, text binary")
    return dealt.groupBy("bucket", "salt").applyInArrow(flag, "doc_id long, part string, mask int, n long")


def audit_orders(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Counts of every part, order of the five filters and step; ``masks`` as of ``document_masks``.

    A document counts as good (toxic) if some label row of its id says 1. Rows
    without an id have no label. A part without failures has rows of zeros; no
    documents give no rows. Masks are counted first, so that the orders unfold
    over at most 32 rows of each part.
    """
    flag = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(
        F.max((F.coalesce(F.col(quality), F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce(F.col(toxic), F.lit(0)) == 1).cast("long")).alias("bad")
    )
    flag = small(materialize(flag, "label-flags"))
    rows = masks.join(flag, masks.doc_id == flag["_id"], "left")
    zero = F.lit(0).cast("long")
    counts = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", zero)).alias("good"), F.sum(F.col("n") * F.coalesce("bad", zero)).alias("bad")
    )
    counts = materialize(counts, "mask-counts")
    # What a step does depends on the set of filters before it, not on their order: 80 cases.
    bits = range(len(LETTERS))
    cases = [(sum(1 << x for x in s), k) for k in bits for r in bits for s in itertools.combinations([x for x in bits if x != k], r)]
    case = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(k).alias("k")) for s, k in cases]))
    each = counts.select("*", case.alias("c")).select("*", "c.before", "c.k", F.expr("shiftleft(1, c.k)").alias("bit"))
    here = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(cond, value="n"):
        return F.sum(F.when(cond, F.col(value)).otherwise(zero))

    sums = each.groupBy("part", "before", "k").agg(
        total(~gone & ~here).alias("kept"), total(~gone & here).alias("removed"), total(gone & here).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(~gone & here, "good").alias("good_lost"), total(~gone & here, "bad").alias("toxic_lost"),
    )
    # So many orders have exactly the set before the filter.
    size = F.bit_count(F.col("before"))
    orders = F.element_at(F.array(*[F.lit(math.factorial(j) * math.factorial(len(LETTERS) - 1 - j)).cast("long") for j in bits]), size + 1)
    shapley = sums.groupBy("part", "k").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = [("".join(LETTERS[x] for x in p), j + 1, sum(1 << x for x in p[:j]), p[j]) for p in itertools.permutations(bits) for j in bits]
    names = {}
    for name, j, before, k in steps:
        names.setdefault((before, k), []).append(name)
    listed = F.create_map(*[x for (s, k), v in names.items() for x in (F.lit(s * 8 + k), F.array(*map(F.lit, v)))])
    return sums.join(shapley, ["part", "k"]).select(
        "part", F.explode(F.element_at(listed, F.col("before") * 8 + F.col("k"))).alias("filter_order"), (size + 1).cast("int").alias("step"),
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
