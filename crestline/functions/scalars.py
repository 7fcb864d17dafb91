"""Column-building maths shared by the analytics operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def as_time(now: datetime | str | Column) -> Column:
    """``now`` as a timestamp column; literals keep filters pushable."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def plus_hours(ts: Column, hours: float | Column) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_micros(F.unix_micros(ts) + (h * HOUR_US).cast("bigint"))


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours with sub-second precision (negative if end < start)."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(HOUR_US))


def age_hours(published: Column, now) -> Column:
    return F.greatest(F.lit(0.0), hours_between(published, as_time(now)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log1p_floor(x: Column) -> Column:
    """log1p with negatives raised to 0; null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(F.lit(0.0), x.cast("double"))))


def freshness(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / F.lit(float(half_life)))


def engagement_ratio(count: Column, views: Column) -> Column:
    """(count+1)/(views+1); null when either is missing or views is negative."""
    return F.when(
        count.isNotNull() & views.isNotNull() & (views >= 0),
        (count + 1).cast("double") / (views + 1).cast("double"),
    )


def robust_z(value: Column, median_log: Column, mad_log: Column, cfg) -> Column:
    z = (log1p_floor(value) - median_log) / (F.lit(cfg.mad_scale) * mad_log)
    return F.when(value.isNotNull(), F.when(mad_log <= 0, F.lit(0.0)).otherwise(clamp(z, cfg.z_min, cfg.z_max)))


def total_weight(parts: Sequence[tuple[Column, float]]) -> Column:
    live = [F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in parts if w > 0]
    out = live[0]
    for c in live[1:]:
        out = out + c
    return out


def weighted_mean(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted combination over the available parts, weights rescaled to 1.

    Parts that are null or carry weight <= 0 drop out; nothing left gives null.
    """
    den = total_weight(parts)
    num = None
    for v, w in parts:
        if w <= 0:
            continue
        term = F.coalesce(v * F.lit(float(w)), F.lit(0.0))
        num = term if num is None else num + term
    return F.when(den > 0, num / den)


def round_half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards +infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def acceleration(current: Column, previous: Column, confidence: Column, limit: float) -> Column:
    """log2 growth ratio; only with HIGH confidence and a positive previous rate."""
    cur = F.greatest(F.lit(0.0), current)
    return F.when(
        (confidence == "HIGH") & current.isNotNull() & (previous > 0),
        F.when(cur == 0, F.lit(-float(limit))).otherwise(clamp(F.log2(cur / previous), -limit, limit)),
    )


def null_if_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)
