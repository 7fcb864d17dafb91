"""Views-per-hour from a post's snapshot history, from scratch or by advancing stored folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators.anchors import walk_anchors
from crestline.operators.skew import BROADCAST_KEYS, split_heavy
from crestline.session import materialize

POINT = "array<struct<t:bigint,v:bigint>>"
# What the walk over a post's points has to remember: intervals so far, the last three anchors (the newest is 0),
# whether an anchor fell below the one before it, and the last point.
FOLD = "struct<n:int,t0:bigint,v0:bigint,t1:bigint,v1:bigint,t2:bigint,v2:bigint,fell:boolean,last_t:bigint,last_v:bigint>"
_FIELDS = [f.split(":")[0] for f in FOLD[7:-1].split(",")]


def _fold(**values: Column) -> Column:
    none = F.lit(None)
    return F.struct(*[values.get(f, none).alias(f) for f in _FIELDS]).cast(FOLD)


def new_fold(published: Column) -> Column:
    """The fold before any point: publication is an anchor of zero views."""
    return _fold(n=F.lit(0), t0=F.unix_micros(published), v0=F.lit(0), fell=F.lit(False))


def advance(fold: Column, points: Column, gap_us: int) -> Column:
    """``fold`` after a sorted array of (t, v) points, none before its last one."""

    def step(a: Column, p: Column) -> Column:
        last = {"last_t": p["t"], "last_v": p["v"]}
        far = (p["t"] - a["t0"]) >= gap_us
        moved = _fold(n=a["n"] + 1, t0=p["t"], v0=p["v"], t1=a["t0"], v1=a["v0"], t2=a["t1"], v2=a["v1"], fell=a["fell"] | (p["v"] < a["v0"]), **last)
        kept = _fold(**{f: a[f] for f in _FIELDS if f not in last}, **last)
        return F.when(far, moved).otherwise(kept)

    return F.aggregate(points, fold, step)


def velocity_columns(fold: Column, published: Column, now: Column, cfg: Config = DEFAULT) -> list[Column]:
    """vph_kind, vph, vph_previous, velocity_confidence and had_negative_delta of a fold."""

    def rate(x: str, y: str) -> Column:
        return F.greatest(fold[f"v{y}"] - fold[f"v{x}"], F.lit(0)).cast("double") / ((fold[f"t{y}"] - fold[f"t{x}"]) / F.lit(float(S.HOUR_US)))

    real = fold["n"] - 1  # intervals not starting at the publication
    age = F.greatest(S.age_hours(published, now), F.lit(cfg.min_estimation_age_hours))
    known = published.isNotNull() & fold["last_v"].isNotNull()
    return [
        F.when(known & (real >= 1), "OBSERVED").when(known, "ESTIMATED").otherwise("NONE").alias("vph_kind"),
        F.when(known & (fold["n"] >= 1), rate("1", "0")).when(known, fold["last_v"].cast("double") / age).alias("vph"),
        F.when(known & (real >= 2), rate("2", "1")).alias("vph_previous"),
        F.when(known & (real >= 2), "HIGH").when(known & (real >= 1), "MEDIUM").when(known, "LOW").alias("velocity_confidence"),
        F.coalesce(known & fold["fell"], F.lit(False)).alias("had_negative_delta"),
    ]


def _points(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("views is not null").select("post_id", F.unix_micros("observed_at").alias("t"), F.col("views").cast("bigint").alias("v"))


def _gap(cfg: Config) -> int:
    return int(cfg.min_interval_hours * S.HOUR_US)


def post_folds(posts: DataFrame, snapshots: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(post_id, published_at, fold) of every post, from its whole history.

    Posts meet their points before these are gathered, so that other posts'
    snapshots never are. A post with more than ``max_group_rows`` points is
    walked by pointer doubling over many tasks.
    """
    base = posts.select("post_id", "published_at")
    usual, heavy = split_heavy(_points(snapshots), ["post_id"], cfg.max_group_rows)
    pts = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "v"))))
    folded = base.join(usual, "post_id", "left").groupBy("post_id").agg(F.first("published_at").alias("published_at"), pts.alias("pts"))
    folded = folded.select("post_id", "published_at", advance(new_fold(F.col("published_at")), F.col("pts"), _gap(cfg)).alias("fold"))
    if heavy is not None:
        walked = _heavy_folds(base, heavy, _gap(cfg))
        folded = folded.join(walked.select("post_id"), "post_id", "left_anti").unionByName(walked)
    return folded


def post_velocity(posts: DataFrame, snapshots: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """A velocity row per post (post_id, published_at of ``posts``).

    Publication counts as a virtual zero-view point. Points closer than the
    minimum interval to the running anchor merge into it; the last interval is
    the current rate and the one before it the previous rate.
    """
    folds = post_folds(posts, snapshots, cfg)
    return folds.select("post_id", *velocity_columns(F.col("fold"), F.col("published_at"), S.as_time(now), cfg))


def velocity_of_folds(posts: DataFrame, folds: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """As ``post_velocity``, from stored folds: no snapshot is read."""
    kept = posts.select("post_id", "published_at").join(folds.select("post_id", "fold"), "post_id", "left")
    return kept.select("post_id", *velocity_columns(F.col("fold"), F.col("published_at"), S.as_time(now), cfg))


def advance_folds(stored: DataFrame, posts: DataFrame, fresh: DataFrame, history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Folds (post_id, published_at, fold) of the rows of ``posts`` after the snapshots ``fresh``.

    ``stored`` holds the folds of these posts so far; a post without one is
    new. Points after the last known one advance the fold. A post whose
    publication time changed, or with a point at or before its last one, is
    folded anew from its ``history`` (stored and fresh snapshots), which is
    read for such posts only, and not at all if there are none.
    """
    gap = _gap(cfg)
    new = _points(fresh).groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("pts"))
    old = stored.select("post_id", F.col("published_at").alias("was"), "fold")
    # Sides with a row per post are shuffled: a broadcast of each would pass through the driver.
    rows = posts.select("post_id", "published_at").join(old.hint("merge"), "post_id", "left").join(new.hint("merge"), "post_id", "left")
    first = F.try_element_at("pts", F.lit(1))["t"]
    late = F.col("fold").isNotNull() & (~F.col("was").eqNullSafe(F.col("published_at")) | F.coalesce(first <= F.col("fold.last_t"), F.lit(False)))
    rows = materialize(rows.withColumn("late", late), "fold-rows")
    start = F.coalesce("fold", new_fold(F.col("published_at")))
    on = rows.where("not late").select("post_id", "published_at", advance(start, F.coalesce("pts", F.array().cast(POINT)), gap).alias("fold"))
    again = rows.where("late").select("post_id", "published_at")
    n = again.count()
    if not n:
        return on
    ids = again.select("post_id")
    own = history.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, "post_id", "left_semi")
    return on.unionByName(post_folds(again, own, cfg))


def _heavy_folds(base: DataFrame, heavy: DataFrame, gap: int) -> DataFrame:
    firsts = heavy.groupBy("post_id", "t").agg(F.min("v").alias("v"))
    known = base.join(heavy.groupBy("post_id").agg(F.max(F.struct("t", "v")).alias("last")), "post_id")
    starts = known.where("published_at is not null").select("post_id", F.unix_micros("published_at").alias("t"))
    anchors = (
        walk_anchors(firsts, starts, ["post_id"], gap)
        .groupBy("post_id")
        .agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("rest"))  # at most span/gap rows per post
    )
    fold = advance(new_fold(F.col("published_at")), F.coalesce("rest", F.array().cast(POINT)), gap)
    at_end = F.struct(*[F.col("last.t" if f == "last_t" else "last.v" if f == "last_v" else f"f.{f}").alias(f) for f in _FIELDS]).cast(FOLD)
    return known.join(anchors, "post_id", "left").withColumn("f", fold).select("post_id", "published_at", at_end.alias("fold"))
