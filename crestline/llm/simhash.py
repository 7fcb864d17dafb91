"""SimHash near-duplicates: fingerprints in a vantage-point tree by Hamming distance.

1. A text's fingerprint is the bitwise majority of the XXH64 values of its word
   shingles. Texts of equal fingerprint are one class, so copies never meet.
2. A vantage-point tree is fitted on a bounded sample of fingerprints: a node
   holds a fingerprint and a radius, near ones go left, far ones right. Its
   leaves are the shards. Every fingerprint has one home shard; by the triangle
   inequality a partner within the threshold can lie across a node's boundary
   only if the own distance is that close to the radius, so only such
   fingerprints are sent to the other side too, and only from near to far: the
   pair is found there once.
3. A shard is joined by the same tree built over its members, down to blocks
   that are compared directly. A shard that outgrew its bound is dealt to cells
   of chunk pairs first. Links that are already implied inside a shard are not
   listed, so n near copies give about n links.

Every pruning is a necessary condition of a link: the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.base import bound_batches, map_texts, small, text_slices
from crestline.llm.components import components
from crestline.session import materialize

# Fingerprints that the tree is fitted on (every fingerprint is routed through it), and about how many a shard shall hold.
SAMPLE = 1 << 20
SHARD = 1 << 14
# A shard of more rows than this is dealt to pairs of chunks of at most so many.
CELL = 1 << 16
# Inside a shard, so many fingerprints are compared directly, with so many at once.
BLOCK, SPAN = 256, 1 << 12
# Vantage points tried per node, and shingles hashed at once.
TRIES = 8
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all ``width``-word shingles, A-Z lower-cased; 0 without words.

    A text of fewer words is one shingle. The text is hashed in chunks, so that
    a very long one needs little more memory than its words.
    """
    words = text.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        m = max(1, len(part) - width + 1)
        starts, ends = (end - size)[:m].tolist(), end[min(width, len(part)) - 1 :].tolist()
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    if not n:
        return 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint's 64 bits as a signed number."""

    def fn(batch):
        for a, e, texts in text_slices(batch):
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), pa.array(found)], ["doc_id", "fp"])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(cols, fn, "doc_id long, fp long")


class VantageTree:
    """A tree of (vantage point, radius) nodes; leaves are numbered from 0.

    ``left``/``right`` hold a node's number, or -1 - leaf. A fingerprint at
    distance <= radius is at home on the left.
    """

    def __init__(self, sample: np.ndarray, leaf: int, t: int, seed: int = 1):
        self.t = t
        self.at: list[int] = []
        self.radius: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(sample, -1, False)]
        while todo:
            own, parent, right = todo.pop()
            cut = self._cut(own, rng) if len(own) > leaf else None
            if cut is None:
                name = -1 - self.leaves
                self.leaves += 1
            else:
                name = len(self.at)
                v, r, d = cut
                self.at.append(v), self.radius.append(r), self.left.append(0), self.right.append(0)
                todo.append((own[d > r], name, True))
                todo.append((own[d <= r], name, False))
            if parent >= 0:
                (self.right if right else self.left)[parent] = name
        self.arrays = np.array(self.at, np.uint64), np.array(self.radius, np.int64), np.array(self.left, np.int64), np.array(self.right, np.int64)

    def _cut(self, own: np.ndarray, rng) -> tuple[int, int, np.ndarray] | None:
        """The vantage point and radius that leave the smaller larger half, boundary crossers counted; None if none gains."""
        best = None
        for v in own[rng.integers(0, len(own), TRIES)]:
            d = np.bitwise_count(own ^ v).astype(np.int64)
            count = np.cumsum(np.bincount(d, minlength=66))
            mid = int(np.searchsorted(count, len(own) // 2))
            for r in {max(mid - self.t - 1, 0), max(mid - 1, 0), mid, mid + self.t}:
                near = int(count[min(r, 65)])
                cross = near - int(count[r - self.t]) if r >= self.t else near
                worst = max(near, len(own) - near + cross)
                if near and near < len(own) and (best is None or worst < best[0]):
                    best = worst, int(v), r, d
        return best[1:] if best and best[0] <= 0.9 * len(own) else None

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of every fingerprint: its home leaf, and the leaves across boundaries within the threshold."""
        if not self.at:
            rows = np.arange(len(fps))
            return rows, np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        at, radius, left, right = self.arrays
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            d = np.bitwise_count(fps[row] ^ at[node]).astype(np.int64)
            near, far = d <= radius[node], d > radius[node]
            # At home on the near side and close to the boundary: also a visitor of the far side. A visitor has to
            # follow both sides on which a partner may lie.
            over = near & (d > radius[node] - self.t)
            back = far & ~home & (d <= radius[node] + self.t)
            row, node, home = (
                np.concatenate([row[near], row[far], row[over], row[back]]),
                np.concatenate([left[node[near]], right[node[far]], right[node[over]], left[node[back]]]),
                np.concatenate([home[near], home[far], np.zeros(int(over.sum() + back.sum()), bool)]),
            )
            out = node < 0
            if out.any():
                done.append((row[out], -1 - node[out], home[out]))
                row, node, home = row[~out], node[~out], home[~out]
        return tuple(np.concatenate(x) for x in zip(*done))


def _blocks(own: np.ndarray, guests: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (own members, guests) of a shard so that every pair within ``t`` shares one, with an own member in it."""
    tree = VantageTree(own, BLOCK, t) if len(own) > BLOCK else None
    if tree is None or not tree.at:
        yield own, guests
        return
    row, leaf, home = tree.route(own)
    more, leaf_of = _visit(tree, guests)
    name = np.concatenate([leaf, leaf_of])
    value = np.concatenate([own[row], guests[more]])
    kind = np.concatenate([home, np.zeros(len(more), bool)])
    order = np.argsort(name, kind="stable")
    cuts = np.flatnonzero(np.diff(name[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        part = order[a:b]
        yield value[part][kind[part]], value[part][~kind[part]]


def _visit(tree: VantageTree, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for fingerprints at home elsewhere: every leaf that may hold a partner."""
    at, radius, left, right = tree.arrays
    row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(row):
        d = np.bitwise_count(fps[row] ^ at[node]).astype(np.int64)
        near, far = d <= radius[node] + tree.t, d > radius[node] - tree.t
        row, node = np.concatenate([row[near], row[far]]), np.concatenate([left[node[near]], right[node[far]]])
        out = node < 0
        rows.append(row[out]), leaves.append(-1 - node[out])
        row, node = row[~out], node[~out]
    return np.concatenate(rows), np.concatenate(leaves)


def shard_links(own: np.ndarray, guests: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that give the components of all pairs within ``t`` of a shard, an own member in each pair: one per joined group at most."""
    values = np.unique(np.concatenate([own, guests]))
    top = np.arange(len(values))
    ends: list[np.ndarray] = []
    for mine, theirs in _blocks(np.unique(own), np.unique(guests), t):
        both = np.concatenate([mine, theirs])
        where = np.searchsorted(values, both)
        for a in range(0, len(mine), BLOCK):
            for b in range(a, len(both), SPAN):
                x, y = np.nonzero(np.bitwise_count(mine[a : a + BLOCK, None] ^ both[None, b : b + SPAN]) <= t)
                x, y = where[x + a], where[y + b]
                while True:
                    # Pairs of one tree are implied; of the others, each root takes its smallest neighbour as parent.
                    p, q = top[x], top[y]
                    new = p != q
                    if not new.any():
                        break
                    x, y, low, high = x[new], y[new], np.minimum(p, q)[new], np.maximum(p, q)[new]
                    order = np.lexsort((low, high))
                    first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
                    top[high[first]] = low[first]
                    ends.append(np.stack([x[first], y[first]]))
                    while not np.array_equal(top[top], top):
                        top = top[top]
    pairs = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    return values[pairs[0]], values[pairs[1]]


def _sample(classes: DataFrame, n: int) -> np.ndarray:
    every = max(1, math.ceil(n / SAMPLE))
    rows = classes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toArrow()
    return np.sort(rows.column("fp").to_numpy()).view(np.uint64)


def hamming_links(classes: DataFrame, t: int = 2) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` of a stored table that give the components of all pairs within ``t`` bits."""
    spark = classes.sparkSession
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    sample = _sample(classes, n)
    # A leaf of the sample stands for a shard of all fingerprints; it keeps enough sample points to place the radius.
    tree = VantageTree(sample, max(8, math.ceil(len(sample) * SHARD / n)), t)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            row, leaf, home = shared.value.route(fps)
            for a in range(0, len(row), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[cut]), pa.array(fps[row[cut]].view(np.int64)), pa.array(home[cut])], ["leaf", "fp", "home"])

    # Stored, since sizes are counted first.
    routed = materialize(classes.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean"), "shards")
    sizes = materialize(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("own")).where("own > 0"), "shard-sizes")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    placed = routed.join(small(sizes.select("leaf", chunks.alias("chunks"))), "leaf")
    one = placed.where("chunks = 1").select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    # Cells of chunk pairs: chunk c of an overgrown shard is in the cells (c, x) and (x, c).
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    cells = placed.where("chunks > 1").withColumn("c", mine).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("leaf", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "fp", "home")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, homes = [], []
        for b in batches:
            fps.append(b.column(b.schema.get_field_index("fp")).to_numpy())
            homes.append(b.column(b.schema.get_field_index("home")).to_numpy(zero_copy_only=False))
        fp, home = np.concatenate(fps).view(np.uint64), np.concatenate(homes)
        a, b = shard_links(fp[home], fp[~home], t)
        for k in range(0, len(a), 1 << 16):
            cut = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(a[cut].view(np.int64)), pa.array(b[cut].view(np.int64))], ["a", "b"])

    bound_batches(classes)
    return one.unionByName(cells).groupBy("leaf", "i", "j").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, t: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links between
    fingerprints that differ in at most ``t`` bits. Null and empty texts and
    texts without words have fingerprint 0, which links like any other. A row
    with a null id takes part in no link and has a null component; repeated
    rows are reported as often as they occur. Other columns are ignored; an
    empty table gives an empty result.
    """
    members = materialize(fingerprints(docs, width, doc_id, text), "fingerprints")
    classes = materialize(members.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-classes")
    links = materialize(hamming_links(classes, t), "fp-links")
    comp = components(links, "a", "b")
    named = materialize(classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "fp-named")
    lowest = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "fp-lowest")
    # Most fingerprints stand alone: their component is their own smallest id, and only the others are looked up.
    labels = materialize(named.join(lowest, "component").select("fp", "component_id"), "fp-labels")
    return members.join(labels, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
