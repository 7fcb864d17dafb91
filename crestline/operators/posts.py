"""Per-post scores, tiers and trend states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import COMPONENTS, DEFAULT, SCORING_VERSION, STATE_RANK, Config
from crestline.functions import scalars as S
from crestline.operators.baselines import scoring_baselines, wide_baselines
from crestline.operators.velocity import post_velocity, velocity_of_folds
from crestline.session import materialize


# --- sources of the scoring run -------------------------------------------------

def eligible_posts(posts: DataFrame, market: str, now, cfg: Config = DEFAULT) -> DataFrame:
    since = S.plus_hours(S.as_time(now), -cfg.baseline_hours)
    return posts.where((F.col("market") == market) & (F.col("last_seen_at") >= since))


def snapshots_of(snapshots: DataFrame, posts: DataFrame) -> DataFrame:
    return snapshots.join(posts.select("post_id").distinct(), "post_id", "left_semi")


def posts_seen_between(posts: DataFrame, start: Column, end: Column) -> DataFrame:
    seen = F.col("last_seen_at")
    return posts.where((seen >= start) & (seen < end))


# --- components -----------------------------------------------------------------

def with_components(posts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds c_<component> in 0..1 plus the z values behind velocity and reach.

    z values and their squashed forms become columns first: the combinations
    use each of them several times.
    """

    def z(value: str, base: str) -> Column:
        return S.robust_z(F.col(value), F.col(f"{base}_median"), F.col(f"{base}_mad"), cfg)

    ratios = {name: f"{name}_ratio" for name in cfg.engagement_weights}
    out = posts.withColumns(
        {"z_velocity": z("vph", "vph"), "z_reach": z("views", "views"), **{f"z_{n}": z(m, m) for n, m in ratios.items()}}
    )
    out = out.withColumns(
        {
            "s_velocity": S.sigmoid(F.col("z_velocity")),
            "s_keep": S.clamp(F.lit(1.0) - F.col("age_hours") / F.lit(cfg.shrink_hours), cfg.shrink_min, cfg.shrink_max),
            **{f"s_{n}": S.sigmoid(F.col(f"z_{n}")) for n in ratios},
        }
    )
    v = F.col("s_velocity")
    out = out.withColumns(
        {
            # An estimated rate shrinks towards the neutral middle as the post ages.
            "c_velocity": F.when(F.col("vph_kind") == "ESTIMATED", F.lit(0.5) + (v - 0.5) * F.col("s_keep")).otherwise(v),
            "c_reach": S.sigmoid(F.col("z_reach")),
            "c_engagement": S.weighted_mean([(F.col(f"s_{n}"), w) for n, w in cfg.engagement_weights.items()]),
            "c_freshness": S.freshness(F.col("age_hours"), cfg.freshness_half_life),
            "c_hashtagMomentum": F.col("hashtag_momentum"),
            "c_acceleration": S.sigmoid(F.col("acceleration")),
        }
    )
    return out.drop("s_velocity", "s_keep", *[f"{k}_{n}" for n in ratios for k in ("s", "z")])


def score(weights: dict[str, float]) -> Column:
    combined = S.weighted_mean([(F.col(f"c_{k}"), weights[k]) for k in COMPONENTS])
    return S.round_half_up(F.lit(100.0) * S.clamp(combined, 0.0, 1.0))


def explanation(name: str, weights: dict[str, float]) -> Column:
    """array<struct> with one entry per component; w_<name> holds the available weight."""
    total = F.col(f"w_{name}")
    raw = {
        "velocity": F.col("vph"),
        "reach": F.col("views").cast("double"),
        "freshness": F.col("age_hours"),
        "hashtagMomentum": F.col("hashtag_momentum"),
        "acceleration": F.col("acceleration"),
    }
    z = {"velocity": F.col("z_velocity"), "reach": F.col("z_reach")}
    null = F.lit(None).cast("double")
    rows = []
    for k in COMPONENTS:
        c, w = F.col(f"c_{k}"), float(weights[k])
        live = c.isNotNull() & F.lit(w > 0)
        rows.append(
            F.struct(
                F.lit(name).alias("score"),
                F.lit(k).alias("component"),
                live.alias("available"),
                raw.get(k, null).alias("raw"),
                z.get(k, null).alias("z"),
                c.alias("normalized"),
                F.lit(w).alias("weight_configured"),
                F.when(live & (total > 0), F.lit(w) / total).alias("weight_used"),
            )
        )
    return F.array(*rows)


# --- tags on posts --------------------------------------------------------------

def post_tag_momentum(post_tags: DataFrame, hashtags: DataFrame, tracked: DataFrame, posts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(post_id, hashtag_momentum): mean of the strongest known tag momenta.

    Joined on (tag, platform), so two platforms tracking one name keep apart.
    The rank filter prunes map-side, so a post with countless tags is harmless.
    """
    plain = hashtags.where("not is_generic and not is_blocked").select("hashtag_id")
    known = tracked.where("momentum is not null").select(
        "hashtag_id", "platform", F.col("momentum").cast("double").alias("m")
    )
    rows = (
        post_tags.select("post_id", "hashtag_id")
        .join(plain, "hashtag_id", "left_semi")
        .join(posts.select("post_id", "platform"), "post_id")
        .join(known, ["hashtag_id", "platform"])
    )
    w = Window.partitionBy("post_id").orderBy(F.col("m").desc(), F.col("hashtag_id"))
    top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cfg.momentum_top_k)
    return top.groupBy("post_id").agg((F.sum("m") / F.count("m")).alias("hashtag_momentum"))


# --- tier and state -------------------------------------------------------------

def tier_columns(cfg: Config = DEFAULT) -> dict[str, Column]:
    """tier, is_early_breakout, confidence_cap from the post's own columns."""
    views, age, conf = F.col("views"), F.col("age_hours"), F.col("velocity_confidence")
    comments, shares = F.col("comments"), F.col("shares")
    vph = F.coalesce("vph", F.lit(0.0))
    ok = (
        views.isNotNull()
        & F.col("published_at").isNotNull()
        & F.col("content_type").isin("video", "reel", "carousel")
        & (F.col("availability") == "ACTIVE")
    )
    neither = comments.isNull() & shares.isNull()
    floor = (
        neither
        | F.coalesce(comments >= cfg.floor_comments, F.lit(False))
        | F.coalesce(shares >= cfg.floor_shares, F.lit(False))
    )
    early = (
        age.between(cfg.early_min_age, cfg.early_max_age)
        & (views >= cfg.early_min_views)
        & (vph >= cfg.early_min_vph)
        & (F.coalesce(conf.isin("HIGH", "MEDIUM"), F.lit(False)) | (views >= cfg.early_low_confidence_views))
        & floor
    )
    viral = (views >= cfg.viral_min_views) & (age <= cfg.viral_max_age)
    watch = (age <= cfg.watch_max_age) & (views >= cfg.watch_min_views) & (vph >= cfg.watch_min_vph)
    tier = F.when(viral, "VIRAL_QUALIFIED").when(early, "EARLY_BREAKOUT").when(watch, "WATCH").otherwise("NOISE")
    return {
        "tier": F.when(ok, tier),
        "is_early_breakout": F.coalesce(ok & early, F.lit(False)),
        "confidence_cap": F.when(ok & neither, "MEDIUM"),
    }


def post_state(cfg: Config = DEFAULT) -> Column:
    trend = F.coalesce("trend_score", F.lit(0))
    rising = F.coalesce("rising_score", F.lit(0))
    age = F.col("age_hours")
    return (
        F.when((age <= cfg.breakout_max_age) & (rising >= cfg.breakout_min_rising), "BREAKOUT")
        .when(rising >= cfg.rising_min_rising, "RISING")
        .when((age > cfg.dead_min_age) & (F.coalesce("vph", F.lit(0.0)) <= cfg.dead_max_vph), "DEAD")
        .when((F.col("acceleration") <= cfg.falling_max_acceleration) & (trend >= cfg.stable_min_trend), "FALLING")
        .when(trend >= cfg.active_min_trend, "ACTIVE")
        .otherwise("STABLE")
    )


def state_rank(state: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])
    return F.try_element_at(ranks, state)


def held_state(previous: Column, since: Column, candidate: Column, now, hours: float) -> Column:
    """Upgrades and equal ranks apply at once; downgrades wait out the window."""
    now = S.as_time(now)
    elapsed = S.hours_between(F.coalesce(since, now), now)
    keep = (elapsed < hours) & (state_rank(candidate) < state_rank(previous))
    return F.when(previous.isNull() | ~keep, candidate).otherwise(previous)


def state_since(previous: Column, since: Column, state: Column, now) -> Column:
    return F.when(state == previous, since).otherwise(S.as_time(now))


def refresh_priority(now, cfg: Config = DEFAULT) -> Column:
    """Next refresh after the state is known (first platform only)."""
    soon = S.plus_hours(S.as_time(now), cfg.boost_hours)
    due, state = F.col("next_refresh_at"), F.col("trend_state")
    moved = F.when(state.isin("BREAKOUT", "RISING"), F.least(F.coalesce(due, soon), soon)).when(
        ~state.isin("DEAD", "FALLING"), due
    )
    return F.when(F.col("platform") == "tiktok", moved).otherwise(due)


# --- the whole row --------------------------------------------------------------

def measured_posts(posts: DataFrame, snapshots: DataFrame | None, now, cfg: Config = DEFAULT, folds: DataFrame | None = None) -> DataFrame:
    """Posts with age, velocity, acceleration and engagement ratios; the velocity from stored ``folds`` if given, else from ``snapshots``."""
    vel = post_velocity(posts, snapshots, now, cfg) if folds is None else velocity_of_folds(posts, folds, now, cfg)
    drop = {"vph", "vph_kind", "velocity_confidence"} & set(posts.columns)
    out = posts.drop(*drop).join(vel, "post_id")
    return out.withColumns(
        {
            "age_hours": F.coalesce(S.age_hours(F.col("published_at"), now), F.lit(0.0)),
            "acceleration": S.acceleration(
                F.col("vph"), F.col("vph_previous"), F.col("velocity_confidence"), cfg.acceleration_clamp
            ),
            "like_ratio": S.engagement_ratio(F.col("likes"), F.col("views")),
            "comment_ratio": S.engagement_ratio(F.col("comments"), F.col("views")),
            "share_ratio": S.engagement_ratio(F.col("shares"), F.col("views")),
        }
    )


def scored_posts(
    posts: DataFrame,
    snapshots: DataFrame,
    post_tags: DataFrame,
    hashtags: DataFrame,
    tracked: DataFrame,
    now,
    market: str = "global",
    previous_baselines: DataFrame | None = None,
    cfg: Config = DEFAULT,
    keep_components: bool = False,
    stage: bool = True,
) -> DataFrame:
    """The scored row of every eligible post; ``posts`` carries the stored state.

    The measured posts feed the baselines (three passes) and the scores, so
    they are written once to the shared folder: one row per eligible post,
    against a recomputation from the snapshots per pass with ``stage=False``.
    """
    live = eligible_posts(posts, market, now, cfg)
    measured = measured_posts(live, snapshots, now, cfg)
    if stage:
        measured = materialize(measured, "measured")
    base = wide_baselines(scoring_baselines(measured, previous_baselines, now, cfg, [market]))
    momentum = post_tag_momentum(post_tags, hashtags, tracked, live, cfg)
    # base has one row per (platform, market): a broadcast of a few rows.
    joined = measured.join(F.broadcast(base), ["platform", "market"]).join(momentum, "post_id", "left")
    return finish_scores(joined, now, cfg, keep_components)


def finish_scores(joined: DataFrame, now, cfg: Config = DEFAULT, keep_components: bool = False) -> DataFrame:
    out = with_components(joined, cfg)
    out = out.withColumns({"trend_score": score(cfg.trend_weights), "rising_score": score(cfg.rising_weights)})
    out = out.withColumns(tier_columns(cfg))
    out = out.withColumn("candidate_state", post_state(cfg))
    prev, since = F.col("previous_state"), F.col("previous_since")
    out = out.withColumnsRenamed({"trend_state": "previous_state", "trend_state_since": "previous_since"})
    out = out.withColumn("trend_state", held_state(prev, since, F.col("candidate_state"), now, cfg.hysteresis_hours))
    out = out.withColumns(
        {
            "trend_state_since": state_since(prev, since, F.col("trend_state"), now),
            "next_refresh_at": refresh_priority(now, cfg),
            "scored_at": S.as_time(now),
            "scoring_version": F.lit(SCORING_VERSION),
        }
    )
    if keep_components:
        for name, weights in (("trend", cfg.trend_weights), ("rising", cfg.rising_weights)):
            out = out.withColumn(f"w_{name}", S.total_weight([(F.col(f"c_{k}"), weights[k]) for k in COMPONENTS]))
        out = out.withColumn(
            "score_components",
            F.concat(explanation("trend", cfg.trend_weights), explanation("rising", cfg.rising_weights)),
        )
    drop: Iterable[str] = [c for c in out.columns if c.endswith(("_median", "_mad")) or c in ("w_trend", "w_rising")]
    return out.drop(*drop)


def explain_rows(scored: DataFrame) -> DataFrame:
    """One row per (post, score, component)."""
    return scored.select("post_id", F.inline_outer("score_components"))


SCORE_FIELDS = (
    "vph", "vph_kind", "velocity_confidence", "trend_score", "rising_score", "tier", "trend_state",
    "trend_state_since", "next_refresh_at", "scored_at", "scoring_version",
)


def write_back_scores(posts: DataFrame, scored: DataFrame) -> DataFrame:
    """The posts table after the run: scored rows replaced, others untouched."""
    fields = [c for c in (*SCORE_FIELDS, "score_components") if c in posts.columns and c in scored.columns]
    fresh = scored.select("post_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = posts.join(fresh, "post_id", "left")
    cols = []
    for c in posts.columns:
        if c not in fields:
            cols.append(F.col(c))
            continue
        new = F.col(f"_{c}")
        if c == "vph":
            new = new.cast("decimal(14,2)")
        elif c == "vph_kind":
            new = F.nullif(new, F.lit("NONE"))
        cols.append(F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c))
    return out.select(*cols)
