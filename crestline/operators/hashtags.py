"""Tag rollups, rolling evidence, momentum and tag trend states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, QUALIFIED_TIERS, Config
from crestline.functions import scalars as S
from crestline.operators.posts import held_state
from crestline.operators.quantiles import counted, percentiles

TAG_KEY = ["platform", "market", "hashtag_id"]
DAY_KEY = ["date", *TAG_KEY]


def creator_key() -> Column:
    """Creator identity; a post without any is its own creator."""
    return F.coalesce("creator_username", "creator_external_id", F.col("post_id").cast("string"))


def is_qualified() -> Column:
    return F.coalesce(F.col("tier").isin(*QUALIFIED_TIERS), F.lit(False))


def tagged_posts(posts: DataFrame, post_tags: DataFrame) -> DataFrame:
    """One row per (post, tag) with the columns the rollups read."""
    return post_tags.select("post_id", "hashtag_id").join(
        posts.select(
            "post_id", "platform", "market", "tier", "views", "vph", "last_seen_at", creator_key().alias("creator")
        ),
        "post_id",
    )


def daily_rollup(posts: DataFrame, post_tags: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows per (date, platform, market, tag), date = UTC day the post was last seen.

    Counts and the distinct-creator count combine map-side; the median is an
    order statistic of counted values, so that a hot tag-day fills no task.
    """
    rows = tagged_posts(posts, post_tags).withColumns(
        {
            "date": S.utc_day(F.col("last_seen_at")),
            # Stored rates have two decimals; whole hundredths keep the middle exact.
            "_cents": (F.col("vph").cast("decimal(14,2)") * 100).cast("bigint"),
        }
    )
    q = is_qualified()
    aggs = [
        F.count(F.lit(1)).alias("posts_seen"),
        F.count_if(F.col("tier") == "WATCH").alias("watch_posts"),
        F.count_if(F.col("tier") == "VIRAL_QUALIFIED").alias("viral_posts"),
        F.count_if(F.col("tier") == "EARLY_BREAKOUT").alias("breakout_posts"),
        F.count_distinct("creator").alias("distinct_creators"),
        S.null_if_zero(F.sum(F.when(q, F.col("views")))).alias("viral_views_sum"),
    ]
    med = percentiles(counted(rows, DAY_KEY, "_cents"), DAY_KEY, {"median_vph": 0.5}).drop("n")
    out = rows.groupBy(*DAY_KEY).agg(*aggs).join(med, DAY_KEY, "left")
    return out.withColumns(
        {"scans": F.col("posts_seen"), "median_vph": (S.round_half_up(F.col("median_vph")) / 100).cast("decimal(14,2)")}
    )


def evidence_since(tagged: DataFrame, since: dict[str, Column]) -> DataFrame:
    """Per tag, for every named instant: qualified, creators and watch counts.

    ``since`` maps a name to the instant (a column, so it may differ per row);
    all windows come out of one grouped pass.
    """
    seen = F.col("last_seen_at")
    aggs = []
    for name, start in since.items():
        inside = seen >= start
        aggs += [
            F.count_if(inside & is_qualified()).alias(f"qualified_{name}"),
            F.count_distinct(F.when(inside & is_qualified(), F.col("creator"))).alias(f"creators_{name}"),
            F.count_if(inside & (F.col("tier") == "WATCH")).alias(f"watch_{name}"),
        ]
    return tagged.groupBy(*TAG_KEY).agg(*aggs)


def rolling_day(tagged: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """v24, c24, w24 per tag."""
    start = S.plus_hours(S.as_time(now), -cfg.primary_hours)
    out = evidence_since(tagged.where(F.col("last_seen_at") >= start), {"d": start})
    return out.select(
        *TAG_KEY, F.col("qualified_d").alias("v24"), F.col("creators_d").alias("c24"), F.col("watch_d").alias("w24")
    )


def revival_evidence(tagged: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Qualified posts by any path inside the revival window."""
    start = S.plus_hours(S.as_time(now), -cfg.revival_hours)
    return tagged.where((F.col("last_seen_at") >= start) & is_qualified()).groupBy(*TAG_KEY).agg(
        F.count(F.lit(1)).alias("qualified_any_path")
    )


def trailing_history(daily: DataFrame, today: Column) -> DataFrame:
    """b7 over the existing rows of the 7 days before ``today``; days since the first row."""
    d = F.col("date")
    week = (d >= F.date_sub(today, 7)) & (d < today)
    return daily.groupBy(*TAG_KEY).agg(
        F.coalesce(F.avg(F.when(week, F.col("viral_posts"))), F.lit(0.0)).alias("b7"),
        F.greatest(F.datediff(today, F.min("date")), F.lit(0)).alias("history_days"),
    )


def growth(v24: Column, b7: Column, cfg: Config = DEFAULT) -> Column:
    return F.log2((v24 + F.lit(cfg.growth_prior)) / (b7 + F.lit(cfg.growth_prior)))


def momentum(g: Column, v24: Column, cfg: Config = DEFAULT) -> Column:
    return S.sigmoid(g) * (F.lit(1.0) - F.exp(-v24.cast("double") / F.lit(cfg.momentum_shrink)))


def tag_state(cfg: Config = DEFAULT) -> Column:
    """Decision list over v24, c24, w24, b7, g, history_days."""
    v24, c24, w24, b7, g = (F.col(c) for c in ("v24", "c24", "w24", "b7", "g"))
    bar = (v24 >= cfg.tag_breakout[0]) & (c24 >= cfg.tag_breakout[1]) & (g >= cfg.tag_breakout[2])
    return (
        F.when((F.col("history_days") < cfg.new_history_days) & ~bar, "NEW")
        .when(bar, "BREAKOUT")
        .when((v24 >= cfg.tag_rising[0]) & (c24 >= cfg.tag_rising[1]) & (g >= cfg.tag_rising[2]), "RISING")
        .when((b7 >= cfg.tag_falling[0]) & (g <= cfg.tag_falling[1]), "FALLING")
        .when(v24 >= cfg.tag_active_v24, "ACTIVE")
        .when((v24 >= cfg.tag_stable[0]) | (w24 >= cfg.tag_stable[1]), "STABLE")
        .otherwise("DEAD")
    )


def daily_states(daily: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Backfill: trend state and momentum for every stored day of every tag.

    The day's own counts stand for the last 24 hours and a 7-day range frame
    gives b7. Frames hold one row per day of one tag, so they stay small.
    """
    n = F.unix_date("date")
    by_tag = Window.partitionBy(*TAG_KEY)
    week = by_tag.orderBy(n).rangeBetween(-7, -1)
    out = daily.withColumns(
        {
            "v24": F.col("viral_posts") + F.col("breakout_posts"),
            "c24": F.col("distinct_creators"),
            "w24": F.col("watch_posts"),
            "b7": F.coalesce(F.avg("viral_posts").over(week), F.lit(0.0)),
            "history_days": F.datediff(F.col("date"), F.min("date").over(by_tag)),
        }
    )
    out = out.withColumn("g", growth(F.col("v24"), F.col("b7"), cfg))
    out = out.withColumns({"trend_state": tag_state(cfg), "momentum": momentum(F.col("g"), F.col("v24"), cfg)})
    return out


def tracked_states(
    tracked: DataFrame, tagged: DataFrame, daily: DataFrame, now, cfg: Config = DEFAULT
) -> DataFrame:
    """Every tracked tag with v24/c24/w24, b7, g, momentum and the held state.

    Tags unseen in the window keep a row with zeros.
    """
    now = S.as_time(now)
    roll = rolling_day(tagged, now, cfg)
    hist = trailing_history(daily, S.utc_day(now))
    out = tracked.join(roll, TAG_KEY, "left").join(hist, TAG_KEY, "left").fillna(
        0, ["v24", "c24", "w24", "b7", "history_days"]
    )
    out = out.withColumn("g", growth(F.col("v24"), F.col("b7"), cfg))
    out = out.withColumnsRenamed({"trend_state": "previous_state", "trend_state_since": "previous_since", "momentum": "previous_momentum"})
    out = out.withColumns({"candidate_state": tag_state(cfg), "momentum": momentum(F.col("g"), F.col("v24"), cfg)})
    prev, since = F.col("previous_state"), F.col("previous_since")
    out = out.withColumn("trend_state", held_state(prev, since, F.col("candidate_state"), now, cfg.hysteresis_hours))
    return out.withColumn(
        "trend_state_since", F.when(F.col("trend_state") == prev, F.coalesce(since, now)).otherwise(now)
    )


def weak_streak(daily_with_state: DataFrame, days: int = 3) -> DataFrame:
    """Length of the FALLING/DEAD prefix over the newest ``days`` rows (null states skipped)."""
    newest = Window.partitionBy(*TAG_KEY).orderBy(F.col("date").desc())
    recent = daily_with_state.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= days)
    known = recent.where("trend_state is not null").withColumn("rn", F.row_number().over(newest))
    weak = F.col("trend_state").isin("FALLING", "DEAD")
    return known.groupBy(*TAG_KEY).agg(
        F.coalesce(F.min(F.when(~weak, F.col("rn"))) - 1, F.max("rn")).cast("bigint").alias("weak_evals")
    )


def today_stats(tracked_now: DataFrame, rollup_today: DataFrame, today: Column) -> DataFrame:
    """The day's stat rows: tracked tags (zeros when unseen) plus untracked seen ones."""
    t = tracked_now.select(*TAG_KEY, "trend_state", F.col("momentum").cast("decimal(6,5)").alias("momentum"))
    counts = ["posts_seen", "watch_posts", "viral_posts", "breakout_posts", "distinct_creators", "scans"]
    out = t.join(rollup_today.drop("date"), TAG_KEY, "full_outer").fillna(0, counts)
    return out.withColumn("date", today)


def write_back_tracked(tracked: DataFrame, tracked_now: DataFrame) -> DataFrame:
    """The tracked table with the run's state, since and momentum set."""
    fresh = tracked_now.select(
        "tracked_id",
        "trend_state",
        "trend_state_since",
        F.col("momentum").cast("decimal(6,5)").alias("momentum"),
    )
    keep = [c for c in tracked.columns if c not in ("trend_state", "trend_state_since", "momentum")]
    return tracked.select(*keep).join(fresh, "tracked_id").select(*tracked.columns)
