"""Robust per-platform baselines on the log scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import BASELINE_METRICS, DEFAULT, PLATFORMS, Config
from crestline.functions import scalars as S
from crestline.operators.quantiles import median_and_deviation

KEY = ["platform", "market", "metric"]


def metric_samples(posts: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Long form (platform, market, metric, x) of the reference cohort, log1p scale.

    ``posts`` carries views, likes, comments, shares, vph and first_seen_at.
    """
    cutoff = S.plus_hours(S.as_time(now), -24.0 * cfg.cohort_days)
    v = F.col("views")
    wide = posts.where((F.col("first_seen_at") >= cutoff) & (v >= cfg.cohort_min_views)).select(
        "platform",
        "market",
        v.cast("double").alias("views"),
        F.col("vph").cast("double").alias("vph"),
        S.engagement_ratio(F.col("likes"), v).alias("like_ratio"),
        S.engagement_ratio(F.col("comments"), v).alias("comment_ratio"),
        S.engagement_ratio(F.col("shares"), v).alias("share_ratio"),
    )
    long = wide.unpivot(["platform", "market"], list(BASELINE_METRICS), "metric", "raw")
    return long.where("raw is not null").select(*KEY, S.log1p_floor(F.col("raw")).alias("x"))


def median_and_mad(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median, mad) over ``x``; exact for groups of any size."""
    return median_and_deviation(samples, keys)


def scoring_baselines(
    posts: DataFrame, previous: DataFrame | None, now, cfg: Config = DEFAULT, markets: list[str] | None = None
) -> DataFrame:
    """One row per (platform, market, metric) with the baseline to use.

    Computed when the cohort has enough samples, else the previous row when
    that one had, else the default. ``n`` is this run's sample count unless the
    previous row is taken, so a default never becomes a trusted previous.
    ``markets`` spares the pass that looks them up.
    """
    spark = posts.sparkSession
    grid = spark.createDataFrame(
        [(p, m, *cfg.default_baselines[(p, m)]) for p in PLATFORMS for m in BASELINE_METRICS],
        "platform string, metric string, d_median double, d_mad double",
    )
    if markets is None:
        named = posts.select("market").distinct()
    else:
        named = spark.createDataFrame([(m,) for m in markets], "market string")
    got = median_and_mad(metric_samples(posts, now, cfg), KEY)
    # The grid is platforms x metrics x markets: tens of rows.
    out = named.join(F.broadcast(grid)).join(got, KEY, "left")
    if previous is not None:
        prev = previous.where(F.col("n") >= cfg.baseline_min_n).select(
            *KEY, F.col("n").alias("p_n"), F.col("median").alias("p_median"), F.col("mad").alias("p_mad")
        )
        out = out.join(prev, KEY, "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("p_n", "p_median", "p_mad")})
    own = F.coalesce(F.col("n"), F.lit(0)) >= cfg.baseline_min_n
    old = F.col("p_n").isNotNull()

    def pick(a: str, b: str, c: str):
        return F.when(own, F.col(a)).when(old, F.col(b)).otherwise(F.col(c))

    return out.select(
        *KEY,
        F.when(~own & old, F.col("p_n").cast("bigint")).otherwise(F.coalesce("n", F.lit(0))).alias("n"),
        pick("median", "p_median", "d_median").cast("double").alias("median"),
        pick("mad", "p_mad", "d_mad").cast("double").alias("mad"),
        F.when(own, "COMPUTED").when(old, "PREVIOUS").otherwise("DEFAULT").alias("origin"),
    )


def wide_baselines(baselines: DataFrame) -> DataFrame:
    """One row per (platform, market): <metric>_median, <metric>_mad."""
    aggs = []
    for m in BASELINE_METRICS:
        hit = F.col("metric") == m
        aggs.append(F.max(F.when(hit, F.col("median"))).alias(f"{m}_median"))
        aggs.append(F.max(F.when(hit, F.col("mad"))).alias(f"{m}_mad"))
    return baselines.groupBy("platform", "market").agg(*aggs)


def stored_baselines(baselines: DataFrame, now) -> DataFrame:
    """The persisted form: four decimals."""
    return baselines.select(
        *KEY,
        S.as_time(now).alias("computed_at"),
        F.col("n").cast("int").alias("n"),
        F.col("median").cast("decimal(18,4)").alias("median"),
        F.col("mad").cast("decimal(18,4)").alias("mad"),
    )
