"""Exact grouped percentiles as weighted order statistics.

Values are counted per (group, value), map-side first. A monotone function
cuts the value range into chunks; running sums over a group's chunks say which
chunk holds a wanted rank, and only the values of that chunk are put in order.
So no task gathers or sorts a whole group, and small and large groups take the
same path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _x, _c): how often every non-null value of a group occurs."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    return rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))


def _chunk(x: Column) -> Column:
    """About 90 chunks a decade on either side of zero; every step is monotone in floating point."""
    return (F.signum(x) * F.floor(F.log1p(F.abs(x) * 1e6) * 40)).cast("int")


def _running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_c"))


def percentiles(counts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """(keys, n, one column per name): linearly interpolated percentiles of ``counts`` (keys, _x, _c).

    ``counts`` holds a value of a group once. Groups without values have no row.
    """
    marked = counts.withColumn("_k", _chunk(F.col("_x")))
    chunks = _running(marked.groupBy(*keys, "_k").agg(F.sum("_c").alias("_c")), keys, "_k").withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    # Ranks are told by (name, side): the lower and the upper neighbour of the wanted position.
    ranks = F.array(*[
        F.struct(F.lit(f"{name}{side}").alias("q"), (f((F.col("_n") - 1) * F.lit(p)) + 1).cast("bigint").alias("rank"))
        for name, p in wanted.items() for side, f in (("<", F.floor), (">", F.ceil))
    ])
    holds = F.filter(ranks, lambda r: (F.col("_below") < r["rank"]) & (r["rank"] <= F.col("_upto")))
    targets = chunks.select(*keys, "_k", "_n", F.col("_below").alias("_skip"), holds.alias("_ranks")).where(F.size("_ranks") > 0)
    inside = _running(marked.join(targets, [*keys, "_k"]), [*keys, "_k"], "_x")
    hit = F.filter("_ranks", lambda r: (F.col("_skip") + F.col("_below") < r["rank"]) & (r["rank"] <= F.col("_skip") + F.col("_upto")))
    found = inside.select(*keys, "_n", "_x", F.explode(hit).alias("_r")).groupBy(*keys).agg(
        F.first("_n").alias("n"), *[F.max(F.when(F.col("_r.q") == f"{name}{side}", F.col("_x"))).alias(f"{name}{side}") for name in wanted for side in "<>"]
    )

    def between(name: str, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"`{name}<`"), F.col(f"`{name}>`")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.select(*keys, "n", *[between(name, p) for name, p in wanted.items()])


def median_and_deviation(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys, n, median, mad): median and median absolute deviation of the non-null values."""
    counts = counted(df, keys, value)
    mid = percentiles(counts, keys, {"median": 0.5})
    away = counts.join(mid, keys).select(*keys, F.abs(F.col("_x") - F.col("median")).alias("_x"), "_c")
    mad = percentiles(away.groupBy(*keys, "_x").agg(F.sum("_c").alias("_c")), keys, {"mad": 0.5})
    return mid.join(mad.drop("n"), keys)
