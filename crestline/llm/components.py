"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.session import materialize

# A round's tables are written in files of about so many rows, however many partitions the shuffle has.
FILE_ROWS = 100_000


def compact(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` rows, stored in few files."""
    return materialize(df.coalesce(max(1, -(-rows // FILE_ROWS))), name)


def _edge_sum(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    ``rows``, if known, is about the number of edges: they are then stored in few files from the start.

    Alternating large-star / small-star rounds. Every round is a minimum per
    node (combined map-side), stored, and a join back on the node. Both sides
    of that join are read from storage, so that AQE can split a hub's edges
    over several tasks. Each round's edges are written to the shared folder; the edge set stops changing after O(log n) rounds.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "star") if rows is None else compact(e, "star", rows)
    last = _edge_sum(e)
    while True:
        e = compact(_small_star(_large_star(e, last[0]), last[0]), "star", 2 * last[0])
        now = _edge_sum(e)
        if now == last:
            break
        last = now
    tops = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(tops, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = compact(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low", 2 * n)
    out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = compact(down.groupBy("u").agg(F.min("v").alias("m")), "low", 2 * n)
    out = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()
