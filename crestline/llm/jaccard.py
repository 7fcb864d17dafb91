"""Exact Jaccard join over word shingles as a metric-space join.

Jaccard distance is a metric, but two unrelated texts are at distance 1 from
each other and from every pivot, so pivots alone would replicate the corpus
everywhere. Regions are therefore opened where distances carry information:

1. Equal sets become one class. Shingles held by one class only are counted:
   they are the distance of a document to the union of all others, and bound
   the size of any partner. Documents that cannot have a partner leave.
2. The rarest shingles of what is left (as many as a partner may lack, and one
   more) open regions; linked documents share a region. Large regions with the
   same most central document are one region.
3. A region is joined recursively: pivots (the documents with the least of
   their own) draw Voronoi cells, documents within the triangle-inequality
   window of a cell are replicated into it, documents of a region's main
   component stay as boundary, and a cell small enough is compared directly.

Every filter is a necessary condition of a link, so the join is exact up to
64-bit hashes of shingles. Links that join two already linked documents through
their pivot are not listed: a group of k near copies gives about k links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.base import bound_batches, map_texts, small, text_slices
from crestline.llm.components import compact, components
from crestline.llm.words import shingle_sets
from crestline.session import materialize

# Shingles per counting group, per flushed block of a worker, and per batch of its output.
GROUP_ROWS = 1_000_000
FLUSH_ROWS = 1 << 19
OUT_ROWS = 1 << 17
# Documents read for hints about frequent shingles, and how many hints are broadcast. They
# only spare shuffles: a missing hint costs time, a wrong one a weaker filter, never a link.
HINT_DOCS = 8_192
HINTS = 1 << 16
HOT_CLASSES = 4_096
# Counts above this are not told apart when shingles are ordered by rarity.
RARE = 16
# A region of at most so many documents is compared pair by pair; so is a merged region or cell with so many pairs.
DIRECT = 16
DIRECT_WORK = 65_536
# Pairs compared per file of distances: a pair carries two sets.
PAIR_ROWS = 10_000
PIVOTS = 3


def _finger(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s))


def _longs(a) -> pa.Array:
    return pa.array(np.asarray(a).astype(np.uint64).view(np.int64))


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a binary column begin, and the last one ends, in its data."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _packed(column: pa.Array, kind) -> np.ndarray:
    """All values of a binary column end to end, as numbers of ``kind``; no copy."""
    at = _offsets(column)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind)


def shingle_members(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fp) of every row; ``fp`` names its shingle set, null for an empty one."""

    def fn(batch):
        ids = batch.column(0)
        for a, e, texts in text_slices(batch):
            sets = shingle_sets(texts, width)
            n = [len(s) for s in sets]
            fp = pa.array([_finger(s) if len(s) else 0 for s in sets], pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, e - a), pa.array(n, pa.int64()), pa.compute.if_else(pa.array([x > 0 for x in n]), fp, None)],
                ["doc_id", "n_shingles", "fp"],
            )

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(cols, fn, "doc_id long, n_shingles long, fp long")


def _hints(docs: DataFrame, n_docs: int, width: int) -> np.ndarray:
    """Shingles that at least RARE documents of a bounded sample hold."""
    every = max(1, math.ceil(n_docs / HINT_DOCS))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def fn(batch):
        for _, _, texts in text_slices(batch):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sets))], ["s"])

    rows = map_texts(sample, fn, "s long").groupBy("s").count().where(F.col("count") >= RARE)
    top = rows.orderBy(F.desc("count"), "s").limit(HINTS).select("s").collect()
    return np.sort(np.array([r["s"] for r in top], np.int64).view(np.uint64))


def _blocks(docs: DataFrame, hints: np.ndarray, hot: dict[int, int], parts: int, width: int) -> DataFrame:
    """Shingles of every class, packed by (worker block, part): sorted low words, document slots, classes."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((hints, hot))

    def fn(batch):
        hints, hot = shared.value
        ids = batch.column(0).to_pylist()
        pend: list[np.ndarray] = []
        fps: list[int] = []
        ns: list[int] = []

        def flush():
            s = np.concatenate(pend)
            slot = np.repeat(np.arange(len(pend), dtype=np.uint32), [len(x) for x in pend])
            order = np.argsort(s)
            s, slot = s[order], slot[order]
            at = np.searchsorted(hints, s)
            known = (hints[np.minimum(at, len(hints) - 1)] == s) if len(hints) else np.zeros(len(s), bool)
            fp, n = np.array(fps, np.uint64), np.array(ns, np.int32)
            out = {"part": [], "low": [], "slot": [], "fp": [], "n": []}

            def put(part, low, slots):
                used, local = np.unique(slots, return_inverse=True)
                for k, v in zip(out, (part, low.tobytes(), local.astype(np.uint32).tobytes(), fp[used].tobytes(), n[used].tobytes())):
                    out[k].append(v)

            if known.any():
                put(-1 - int(fp[0] % np.uint64(parts)), s[known], slot[known])
            s, slot = s[~known], slot[~known]
            part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cut = np.flatnonzero(np.diff(part, prepend=part[:1] - np.uint64(1))) if len(part) else []
            for a, b in zip(cut, [*cut[1:], len(part)]):
                put(int(part[a]), s[a:b].astype(np.uint32), slot[a:b])
            pend.clear(), fps.clear(), ns.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out["part"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("low", "slot", "fp", "n"))], list(out)
            )

        size = 0
        for a, _, texts in text_slices(batch):
            for i, s in enumerate(shingle_sets(texts, width), a):
                if not len(s) or ids[i] is None:
                    continue
                f = _finger(s)
                if f in hot and hot[f] != ids[i]:
                    continue
                pend.append(s), fps.append(f), ns.append(len(s))
                size += len(s)
            if size >= FLUSH_ROWS:
                yield flush()
                size = 0
        if pend:
            yield flush()

    return map_texts(docs, fn, "part int, low binary, slot binary, fp binary, n binary")


def _shared(blocks: DataFrame, parts: int) -> DataFrame:
    """(fp, n, key, df): shingles that at least two classes hold; ``df`` is told apart up to RARE.

    A group is one slice of the hash range. Shingles known to be frequent come
    in groups of their own and pass through.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = 0, 0
        got: dict[str, list[np.ndarray]] = {"low": [], "slot": [], "fp": [], "n": []}
        for t in batches:
            at = t.schema.get_field_index
            part = t.column(at("part"))[0].as_py()
            docs = _packed(t.column(at("fp")), np.uint64)
            each = np.diff(_offsets(t.column(at("fp")))) // 8
            words = np.diff(_offsets(t.column(at("slot")))) // 4
            shift = (before + np.cumsum(each) - each).astype(np.uint32)
            got["slot"].append(_packed(t.column(at("slot")), np.uint32) + np.repeat(shift, words))
            got["low"].append(_packed(t.column(at("low")), np.uint64 if part < 0 else np.uint32).copy())
            got["fp"].append(docs.copy())
            got["n"].append(_packed(t.column(at("n")), np.int32).copy())
            before += len(docs)
        low, slot, fp, n = (np.concatenate(got.pop(k)) for k in ("low", "slot", "fp", "n"))
        if part < 0:
            key = ((((low >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)) << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))
            df = np.full(len(low), RARE, np.int32)
        else:
            first = np.zeros(len(fp), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            keep = first[slot]
            low, slot = low[keep], slot[keep]
            order = np.argsort(low, kind="stable")
            low, slot = low[order], slot[order]
            cut = np.flatnonzero(np.diff(low, prepend=low[:1] + np.uint32(1))) if len(low) else np.zeros(0, int)
            runs = np.repeat(np.diff(np.append(cut, len(low))), np.diff(np.append(cut, len(low))))
            many = runs >= 2
            low, slot = low[many], slot[many]
            key = (np.uint64(part) << np.uint64(32)) | low.astype(np.uint64)
            df = np.minimum(runs[many], RARE).astype(np.int32)
        for a in range(0, len(slot), OUT_ROWS):
            cut = slice(a, a + OUT_ROWS)
            yield pa.RecordBatch.from_arrays(
                [_longs(fp[slot[cut]]), pa.array(n[slot[cut]]), _longs(key[cut]), pa.array(df[cut])], ["fp", "n", "key", "df"]
            )

    bound_batches(blocks)
    return blocks.groupBy("part").applyInArrow(fn, "fp long, n int, key long, df int")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) of the wanted classes, read once from their representative's text."""

    def fn(batch):
        want = batch.column(1).to_pylist()
        for a, e, texts in text_slices(batch):
            sets = shingle_sets(texts, width)
            rows = [(w, s) for w, s in zip(want[a:e], sets) if len(s) and np.uint64(_finger(s)).view(np.int64) == w]
            if rows:
                ends = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([s for _, s in rows])))],
                    ["fp", "shingles"],
                )

    rows = docs.join(small(wanted), docs.doc_id == wanted.rep).select("doc_id", "fp", "text")
    return map_texts(rows, fn, "fp long, shingles array<long>").dropDuplicates(["fp"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both): size of the intersection of every pair's sets."""
    one = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).alias("both"))


def jaccard_links(
    docs: DataFrame, members: DataFrame, classes: DataFrame, width: int = 5, p: int = 75, q: int = 100
) -> DataFrame:
    """(a, b): linked classes, enough of them to give the components of all links.

    Two classes link when q * intersection >= p * union. ``docs`` holds
    (doc_id, text), ``members`` and ``classes`` are stored tables.
    """
    g = math.gcd(p, q)
    p, q = p // g, q // g
    spark = docs.sparkSession
    total = classes.agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).first()
    if not total["c"]:
        return spark.createDataFrame([], "a long, b long")
    hot = {
        np.int64(r["fp"]).view(np.uint64).item(): r["rep"]
        for r in classes.where("copies > 1").orderBy(F.desc("copies"), "fp").limit(HOT_CLASSES).collect()
    }
    parts = max(1, math.ceil(total["s"] / GROUP_ROWS))
    hints = _hints(docs, total["c"], width)
    shared = _shared(_blocks(docs, hints, hot, parts, width), parts)

    # Of n shingles a partner lacks at most n - ceil(n p / q); those in one class only come first in the order.
    # Two linked documents meet in the region of their first common shingle: the i shingles before it are lost
    # to the overlap, so the partner there has at most (n - i) (p + q) / p - n shingles.
    own = Window.partitionBy("fp")
    place = F.expr("n - a + r - 1")
    prefix = (
        shared.withColumn("a", F.count(F.lit(1)).over(own).cast("int"))
        .where(F.col("a") * q >= F.col("n") * p)
        .withColumn("r", F.row_number().over(own.orderBy("df", "key")))
        .withColumn("i", place)
        .where(F.expr(f"i <= n - cast(ceil(n * {p} / {q}) as int)"))
        .groupBy("key", "fp", "n").agg(F.expr(f"cast(floor((n - min(i)) * {p + q} / {p}) as int) - n").alias("top"))
    )
    # Each written file may make the JVM start a process, so tables go into files of bounded rows, not one per shuffle partition.
    prefix = materialize(prefix.coalesce(4 * parts), "prefix")
    long = prefix.count()
    counts = compact(prefix.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "counts", long)
    regions = compact(prefix.join(counts, "key"), "regions", long)
    wanted = compact(regions.select("fp").distinct().join(classes, "fp").select("fp", "rep"), "wanted", total["c"])
    sets = materialize(_sets(docs, wanted, width).coalesce(4 * parts), "sets")

    linked = F.expr(f"both * {p + q} >= (na + nb) * {p}")
    fits = F.expr("na <= top_b and nb <= top_a")

    def side(df, x, *more):
        return df.select("region", F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("top").alias(f"top_{x}"), F.col("tag").alias(f"tag_{x}"), *more)

    def direct(cells: DataFrame) -> DataFrame:
        """Pairs of small regions, with one of the cell's own documents and not tied already."""
        x, y = side(cells, "a", F.col("core").alias("ca")), side(cells, "b", F.col("core").alias("cb"))
        return x.join(y, "region").where("a < b and (ca or cb) and tag_a <> tag_b").where(fits).select("a", "b", "na", "nb")

    def settle(cells: DataFrame) -> DataFrame:
        """Members that some other member could link with; regions with pairs left to compare, and how many at most."""
        cells = compact(cells, "cells", rows)
        free = F.col("core")
        bound = compact(
            cells.groupBy("region").agg(
                F.min("n").alias("n_any"), F.max("top").alias("top_any"), F.min(F.when(free, F.col("n"))).alias("n_free"), F.max(F.when(free, F.col("top"))).alias("top_free")
            ), "bounds", rows,
        )
        kept = cells.join(bound, "region").where(
            (free & F.expr("n_any <= top and n <= top_any")) | (~free & F.expr("n_free <= top and n <= top_free"))
        ).drop("n_any", "top_any", "n_free", "top_free")
        kept = compact(kept, "kept", rows)
        size = kept.groupBy("region").agg(
            (F.count(F.lit(1)) * F.count(F.when(free, 1))).alias("work"), F.min("tag").alias("_lo"), F.max("tag").alias("_hi")
        ).where("work > 1 and _lo <> _hi").drop("_lo", "_hi")
        return compact(kept.join(compact(size, "sizes", rows), "region"), "state", rows)

    own_tag = F.col("fp").alias("tag")
    none = F.lit(None).cast("long").alias("main")
    opened = regions.select(F.struct("key", F.lit(0).cast("long").alias("at")).alias("region"), "fp", "n", "top", F.lit(True).alias("core"), own_tag, "size")
    pairs = [direct(opened.where(F.col("size") <= DIRECT))]
    # A group of near copies shares many shingles, and so many regions. Large regions whose document with the
    # least of its own is the same become one: what shared a region still does.
    large = regions.where(F.col("size") > DIRECT)
    head = compact(large.groupBy("key").agg(F.max_by("fp", F.struct(F.col("top") / F.col("n"), "fp")).alias("head")), "heads", long)
    merged = compact(large.join(head, "key").groupBy("head", "fp", "n").agg(F.max("top").alias("top")), "merged", long)
    # Tables of the rounds hold a few rows per document of the large regions.
    rows = 2 * PIVOTS * merged.count()
    # A size band is as wide as partners' sizes may differ; every document is in its own band and, if others begin there, the next.
    merged = merged.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(q / p) + 1e-9).cast("long"))
    begun = compact(merged.select("head", "band").distinct(), "bands", rows)
    start = merged.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).join(begun, ["head", "band"], "left_semi").select(
        F.struct(F.col("head").alias("key"), F.col("band").alias("at")).alias("region"), "fp", "n", "top", F.lit(True).alias("core"), own_tag, none
    )
    now = settle(start)
    pairs.append(direct(now.where(F.col("work") <= DIRECT_WORK)))
    state = now.where(F.col("work") > DIRECT_WORK).drop("work")
    links: list[DataFrame] = []
    known: DataFrame | None = None
    tied = 0
    theta = F.lit(1 - p / q + 1e-9)
    while state.limit(1).count():
        rank = Window.partitionBy("region", "core").orderBy((F.col("top") / F.col("n")).desc(), "fp")
        chosen = compact(state.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= PIVOTS), "pivots", rows)
        star = compact(side(state, "a", "core", "main").join(side(chosen, "b", F.when(F.col("core"), F.col("_r")).alias("rb")), "region").where("a <> b"), "star", rows)
        up = F.col("a") < F.col("b")
        ask = star.where(fits).where("tag_a <> tag_b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(up, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb")
        ).distinct()
        if known is not None:
            ask = ask.join(known, ["a", "b"], "left_anti")
        ask = compact(ask, "asked", rows)
        n_ask = ask.count()
        found = materialize(_overlaps(ask, sets).coalesce(max(1, -(-n_ask // PAIR_ROWS))), "distances")
        tied += n_ask
        links.append(found.where(linked).select("a", "b"))
        known = found if known is None else known.unionByName(found)
        # Documents of equal tag are in one component already and need no comparison.
        every = links[0]
        for x in links[1:]:
            every = every.unionByName(x)
        tags = compact(components(every, "a", "b", tied), "tags", rows)
        dist = known.select("a", "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d"))
        both_ways = dist.unionByName(dist.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        # All pairs of a pivot are settled, so it leaves. Pairs that sizes or tags exclude have no distance; they count as far.
        left = star.join(chosen.select("region", F.col("fp").alias("a")), ["region", "a"], "left_anti")
        near = compact(
            left.join(both_ways, ["a", "b"], "left").select("region", "a", "na", "top_a", "tag_a", "core", "main", "b", "rb", F.coalesce("d", F.lit(1.0)).alias("d"), F.col("d").isNotNull().alias("seen")), "near", rows
        )
        # The component of a region's first pivot is its main one; documents outside it are the ones to compare on.
        # Each belongs to the Voronoi cell of its nearest pivot.
        nearest = near.groupBy("region", "a").agg(F.min_by("b", F.struct("d", "b")).alias("cell"), F.coalesce(F.max("main"), F.max(F.when(F.col("rb") == 1, F.col("b")))).alias("head"))
        few = small(tags)
        cells = near.join(nearest, ["region", "a"]).join(few.select(F.col("node").alias("a"), F.col("component").alias("ta")), "a", "left").join(
            few.select(F.col("node").alias("head"), F.col("component").alias("th")), "head", "left"
        )
        cells = cells.withColumn("tag", F.coalesce("ta", "tag_a")).withColumn("inner", F.expr("core and cell = b") & (F.col("tag") != F.coalesce("th", "head")))
        cells = compact(cells.select("region", "a", "b", "na", "top_a", "d", "seen", "tag", "head", "inner"), "voronoi", rows)
        span = cells.where("inner").groupBy("region", "b").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max(~F.col("seen")).alias("open"))
        span = compact(span, "spans", rows)
        grown = (
            cells.join(span, ["region", "b"])
            .where(F.col("inner") | F.col("open") | ~F.col("seen") | ((F.col("d") >= F.col("lo") - theta) & (F.col("d") <= F.col("hi") + theta)))
            .select(
                F.struct(F.xxhash64("region").alias("key"), F.col("b").alias("at")).alias("region"), F.col("a").alias("fp"), F.col("na").alias("n"), F.col("top_a").alias("top"),
                F.col("inner").alias("core"), "tag", F.col("head").alias("main"),
            )
        )
        now = settle(grown)
        pairs.append(direct(now.where(F.col("work") <= DIRECT_WORK)))
        state = now.where(F.col("work") > DIRECT_WORK).drop("work")
    ask = pairs[0]
    for x in pairs[1:]:
        ask = ask.unionByName(x)
    ask = ask.distinct()
    if known is not None:
        ask = ask.join(known, ["a", "b"], "left_anti")
    ask = materialize(ask.coalesce(4 * parts), "asked")
    links.append(materialize(_overlaps(ask, sets).coalesce(max(1, -(-ask.count() // PAIR_ROWS))), "overlaps").where(linked).select("a", "b"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.distinct()


def jaccard_components(
    docs: DataFrame, width: int = 5, p: int = 75, q: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``.

    ``class_id`` is the smallest id with the same shingle set, ``component_id``
    the smallest one reachable by links. A row without text or words links with
    nothing and is its own component; a row with a null id takes part in no
    link and has null ids; repeated rows are reported as often as they occur.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    members = materialize(shingle_members(docs, width), "members")
    classes = compact(
        members.where("fp is not null and doc_id is not null")
        .groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")),
        "classes", members.count(),
    )
    many = classes.count()
    links = jaccard_links(docs, members, classes, width, p, q)
    links = compact(links, "links", 2 * many)
    comp = compact(components(links, "a", "b", links.count()), "comp", many)
    named = compact(comp.join(classes, comp.node == classes.fp).select("fp", "component", "rep"), "named", many)
    lowest = compact(named.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest", many)
    of = named.join(lowest, "component").select("fp", "component_id")
    labels = compact(
        classes.join(of, "fp", "left").select("fp", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id")), "labels", many
    )
    has = F.col("doc_id").isNotNull()
    return members.join(labels, "fp", "left").select(
        "doc_id", "n_shingles",
        F.when(has, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(has, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns.

    Rows without an id stay. Of rows that agree in id and text one stays; an id
    that stands for several texts stays with each text unless one of them is
    linked to a smaller id.
    """
    rows = docs.count()
    found = compact(jaccard_components(docs, doc_id=doc_id, text=text, **options), "found", rows)
    gone = compact(found.where("component_id < doc_id").select("doc_id").distinct(), "gone", rows)
    again = compact(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again", rows)
    key = F.col(f"`{doc_id}`").cast("long")
    left = docs.join(small(gone).withColumnRenamed("doc_id", "_id"), key == F.col("_id"), "left_anti")
    once = left.join(small(again).withColumnRenamed("doc_id", "_id"), key == F.col("_id"), "left_anti")
    more = left.join(small(again).withColumnRenamed("doc_id", "_id"), key == F.col("_id"), "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(more)
