"""Greedy anchor walk: keep a point once it is far enough from the last kept one.

Velocity intervals and the five-minute snapshot dedup are both this walk.
Ordinary keys fold a sorted array; heavy keys follow next-anchor pointers
that are composed by doubling, so each round is a join on (key, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.session import materialize

CHUNK_US = 60_000_000


def _far(gap: Column, min_gap_us: int, strict: bool) -> Column:
    return gap > min_gap_us if strict else gap >= min_gap_us


def fold_anchors(points: Column, start: Column, min_gap_us: int, strict: bool = False) -> Column:
    """Anchors of one sorted ``array<struct<t,v>>``, beginning with ``start``."""

    def step(acc: Column, p: Column) -> Column:
        far = _far(p["t"] - acc["t"], min_gap_us, strict)
        return F.when(far, F.struct(p["t"].alias("t"), F.concat(acc["a"], F.array(p)).alias("a"))).otherwise(acc)

    zero = F.struct(start["t"].alias("t"), F.array(start).alias("a"))
    return F.aggregate(points, zero, step)["a"]


def _next_anchor(nodes: DataFrame, pts: DataFrame, keys: list[str], min_gap_us: int, strict: bool) -> DataFrame:
    """For each node row (keys, t) the first point at distance >= gap: column nxt.

    A lookup row is placed at t+gap in the minute that holds it; the first
    point at or after it is found there, else at the head of the next
    non-empty minute.
    """
    reach = min_gap_us + (1 if strict else 0)
    look = nodes.select(*keys, "t", (F.col("t") + reach).alias("x"), F.lit(0).alias("q"))
    rows = look.withColumn("pt", F.lit(None).cast("bigint")).unionByName(
        pts.select(*keys, F.lit(None).cast("bigint").alias("t"), F.col("t").alias("x"), F.lit(1).alias("q"), F.col("t").alias("pt"))
    )
    rows = rows.withColumn("chunk", F.floor(F.col("x") / CHUNK_US))
    w = Window.partitionBy(*keys, "chunk").orderBy("x", "q").rowsBetween(0, Window.unboundedFollowing)
    heads = (
        rows.groupBy(*keys, "chunk")
        .agg(F.min("pt").alias("head"))
        .withColumn(
            "later",
            F.min("head").over(
                Window.partitionBy(*keys).orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
            ),
        )
        .drop("head")
    )
    found = rows.withColumn("here", F.min("pt").over(w)).where("q = 0")
    return found.join(heads, [*keys, "chunk"]).select(*keys, "t", F.coalesce("here", "later").alias("nxt"))


def walk_anchors(points: DataFrame, starts: DataFrame, keys: list[str], min_gap_us: int, strict: bool = False) -> DataFrame:
    """Anchor rows (keys, t, v) after each start, by pointer doubling.

    ``points`` (keys, t, v) has one row per (keys, t); ``starts`` (keys, t).
    Rounds grow with log2 of the longest chain; every join key is (keys, t).
    """
    points = materialize(points.select(*keys, "t", "v"), "anchor-points")
    jump = materialize(_next_anchor(points, points, keys, min_gap_us, strict), "anchor-jump")
    first = _next_anchor(starts, points, keys, min_gap_us, strict).where("nxt is not null")
    seen = materialize(first.select(*keys, F.col("nxt").alias("t")), "anchor-seen")
    while True:
        more = materialize(
            seen.join(jump, [*keys, "t"]).where("nxt is not null").select(*keys, F.col("nxt").alias("t")),
            "anchor-more",
        )
        if more.isEmpty():
            break
        seen = seen.unionByName(more)
        hop = jump.select(*keys, F.col("t").alias("nxt"), F.col("nxt").alias("nxt2"))
        jump = materialize(
            jump.where("nxt is not null").join(hop, [*keys, "nxt"]).select(*keys, "t", F.col("nxt2").alias("nxt")),
            "anchor-jump",
        )
    return seen.join(points, [*keys, "t"]).select(*keys, "t", "v")
