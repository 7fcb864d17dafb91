"""Deduplicated streams and rolling counts from built-in operators.

Rolling counts are kept by panes: the stream holds one row per (pane, tag,
post), the post's last sighting in that slice of time. A window ends with every
pane and spans many of them, but a sighting is not copied into each: it counts
from its pane until the post is seen again or the span is over, which is one
step up and one step down of a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.hashtags import is_qualified

TAG = ["platform", "hashtag_id"]


def claim_once(updates: DataFrame, key: str = "update_id", at: str = "received_at", memory: str = "7 days") -> DataFrame:
    """Each id passes once within the memory span."""
    return updates.withWatermark(at, memory).dropDuplicatesWithinWatermark([key])


def pane_sightings(sightings: DataFrame, at: str = "observed_at", late: str = "1 hour", pane: str = "30 minutes") -> DataFrame:
    """(pane_start, platform, hashtag_id, post_id, last_at, tier, creator): a post's last sighting per pane and tag.

    Input: ``at``, platform, hashtag_id, post_id, tier, creator. State lives
    until the watermark has passed its pane.
    """
    timed = sightings.withWatermark(at, late)
    last = F.max(F.struct(F.col(at).alias("last_at"), "tier", "creator")).alias("r")
    g = timed.groupBy(F.window(at, pane).alias("w"), *TAG, "post_id").agg(last)
    return g.select(F.col("w.start").alias("pane_start"), *TAG, "post_id", "r.*")


def latest_panes(updates: DataFrame, number: str = "batch_id") -> DataFrame:
    """The last update of every (pane, tag, post) of an update-mode sink."""
    rest = [c for c in ("last_at", "tier", "creator")]
    g = updates.groupBy("pane_start", *TAG, "post_id").agg(F.max_by(F.struct(*rest), number).alias("r"))
    return g.select("pane_start", *TAG, "post_id", "r.*")


def daily_counts(panes: DataFrame) -> DataFrame:
    """Posts, qualified and watch posts per (pane, platform, tag); with panes of a day, the UTC-day rollup."""
    return panes.groupBy(F.col("pane_start").alias("window_start"), *TAG).agg(
        F.count(F.lit(1)).alias("posts_seen"), F.count_if(is_qualified()).alias("qualified"), F.count_if(F.col("tier") == "WATCH").alias("watch")
    )


def rolling_counts(panes: DataFrame, pane_us: int = 1_800_000_000, span: int = 48) -> DataFrame:
    """Per window of ``span`` panes, ending with each pane: posts seen, qualified and watch posts, creators of qualified posts (c24).

    A post counts once per window, with the tier of its last sighting there.
    Windows without a sighting have no row.
    """
    p = F.floor(F.unix_micros("pane_start") / pane_us).cast("bigint")
    seen = Window.partitionBy(*TAG, "post_id").orderBy("p")
    rows = panes.select(*TAG, "post_id", "tier", "creator", p.alias("p")).withColumn(
        "until", F.least(F.coalesce(F.lead("p").over(seen), F.col("p") + span), F.col("p") + span)
    )
    one, q, w = F.lit(1), is_qualified().cast("int"), (F.col("tier") == "WATCH").cast("int")

    def steps(df: DataFrame, start: Column, end: Column, **counts: Column) -> DataFrame:
        up = F.struct(start.alias("e"), *[c.cast("bigint").alias(n) for n, c in counts.items()])
        down = F.struct(end.alias("e"), *[(-c).cast("bigint").alias(n) for n, c in counts.items()])
        return df.select(*TAG, F.inline(F.array(up, down)))

    zero, none = F.lit(0), F.lit(0)
    posts = steps(rows, F.col("p"), F.col("until"), posts_seen=one, qualified=F.coalesce(q, none), watch=F.coalesce(w, none), c24=zero)
    # Of a creator's overlapping stretches only what the earlier ones do not cover.
    before = F.max("until").over(Window.partitionBy(*TAG, "creator").orderBy("p", "post_id").rowsBetween(Window.unboundedPreceding, -1))
    made = rows.where(is_qualified()).withColumn("start", F.greatest("p", before)).where("start < until")
    creators = steps(made, F.col("start"), F.col("until"), posts_seen=zero, qualified=zero, watch=zero, c24=one)
    names = ("posts_seen", "qualified", "watch", "c24")
    change = posts.unionByName(creators).groupBy(*TAG, "e").agg(*[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy(*TAG).orderBy("e")  # one row per tag and pane
    level = change.select(*TAG, "e", *[F.sum(n).over(order).alias(n) for n in names], F.lead("e").over(order).alias("next")).where("posts_seen > 0")
    ends = level.withColumn("e", F.explode(F.sequence("e", F.col("next") - 1)))
    at = F.timestamp_micros((F.col("e") - (span - 1)) * pane_us)
    return ends.select(at.alias("window_start"), F.timestamp_micros((F.col("e") + 1) * pane_us).alias("window_end"), *TAG, *names)
