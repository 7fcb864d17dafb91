"""Guards that keep one heavy key from landing in one task or one array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A broadcast key list is at most this long (longs/short strings: a few MB).
BROADCAST_KEYS = 200_000


def heavy_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys owning more than ``limit`` rows, or None when there are none.

    One pass over the key columns with map-side counts. The result has at most
    rows/limit rows; it is marked for broadcast only when its counted size is
    below BROADCAST_KEYS.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    n = big.limit(BROADCAST_KEYS + 1).count()
    if n == 0:
        return None
    return F.broadcast(big) if n <= BROADCAST_KEYS else big


def split_heavy(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of heavy keys or None)."""
    big = heavy_keys(df, keys, limit)
    if big is None:
        return df, None
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")


SALTS = 16


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key`` when one key may own a third of ``rows``: it is dealt over SALTS tasks by a hash of ``by``.

    ``facts`` (few rows per key) is repeated once per salt, below the exchange.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], chunk: str) -> DataFrame:
    """Add ``prev_<c>``: the preceding row's values within ``keys``.

    Works in two levels so that no task sees a whole key: inside a chunk by
    ``lag``, and at a chunk's first row by the last row of the preceding
    non-empty chunk. ``chunk`` is a monotone function of the order (a time
    bucket); its count per key is bounded by the time span.
    """
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    wk = Window.partitionBy(*keys).orderBy(chunk)
    row = F.struct(*order, *cols)
    tails = (
        df.groupBy(*keys, chunk)
        .agg(F.max_by(row, F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(wk))
        .drop("_tail")
    )
    out = df.withColumn("_lag", F.lag(row).over(w)).join(tails, [*keys, chunk], "left")
    prev = F.coalesce("_lag", "_carry")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in (*order, *cols)])


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunk: str) -> DataFrame:
    """Running maximum of ``value`` along the order, in two levels as above."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wk = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        df.groupBy(*keys, chunk)
        .agg(F.max(value).alias("_top"))
        .withColumn("_carry", F.max("_top").over(wk))
        .drop("_top")
    )
    joined = df.join(tops, [*keys, chunk], "left")
    return joined.withColumn(out, F.greatest(F.max(value).over(w), F.col("_carry"))).drop("_carry")
