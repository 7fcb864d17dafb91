"""The analytics run over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators import baselines as B
from crestline.operators import categories as C
from crestline.operators import cooccurrence as X
from crestline.operators import hashtags as H
from crestline.operators import lifecycle as L
from crestline.operators import posts as P
from crestline.session import materialize
from crestline.sources.tables import Store, Transaction


# What the run itself maintains. A second run at the same instant starts from these tables as they were before the first.
OWN = ("posts", "scoring_baselines", "hashtag_categories", "post_categories", "hashtag_cooccurrence_daily", "hashtag_daily_stats", "hashtag_tier_events", "tracked_hashtags")


def run_analytics(store: Store, now, market: str = "global", cfg: Config = DEFAULT) -> None:
    """Score posts, then roll up tags and move the tracking tiers; all tables change by one commit.

    A second run at the same instant and market puts the tables it maintains
    back to what they were before the first one (posts of later batches stay),
    so that it leaves the same tables.
    """
    with store.transaction() as tx:
        name = f"analytics {market}"
        at = str(store.spark.range(1).select(S.as_time(now).cast("string")).first()[0])
        note = tx.note(name)
        base = note["base"] if note and note["at"] == at and tx.restore(OWN, note["base"], note["made"]) else tx.before
        score_posts(tx, now, market, cfg)
        classify(tx, now, market, cfg)
        update_tags(tx, now, market, cfg)
        tx.note(name, {"at": at, "base": base, "made": tx.next["version"]})


def score_posts(store: Transaction, now, market: str = "global", cfg: Config = DEFAULT) -> None:
    posts, previous = store.read("posts"), store.read("scoring_baselines")
    live = P.eligible_posts(posts, market, now, cfg)
    # Three consumers (baselines, scores, write-back) read one staged table; velocities come from the folds that ingest keeps.
    measured = materialize(P.measured_posts(live, None, now, cfg, folds=store.read("post_folds")), "measured")
    base = materialize(B.scoring_baselines(measured, previous, now, cfg, [market]), "baselines")
    momentum = P.post_tag_momentum(store.read("post_hashtags"), store.read("hashtags"), store.read("tracked_hashtags"), live, cfg)
    # One row per (platform, market).
    joined = measured.join(F.broadcast(B.wide_baselines(base)), ["platform", "market"]).join(momentum, "post_id", "left")
    scored = P.finish_scores(joined, now, cfg, keep_components=True)
    store.upsert("posts", P.write_back_scores(live, scored))
    others = previous.join(base.select(*B.KEY), B.KEY, "left_anti")
    store.rewrite("scoring_baselines", B.stored_baselines(base, now).unionByName(others))


def classify(store: Transaction, now, market: str = "global", cfg: Config = DEFAULT) -> None:
    live = P.eligible_posts(store.read("posts"), market, now, cfg)
    bridge = store.read("post_hashtags").join(live.select("post_id"), "post_id", "left_semi")
    tags = store.read("hashtags").join(bridge.select("hashtag_id").distinct(), "hashtag_id", "left_semi")
    stored = store.read("hashtag_categories")
    cats = materialize(C.add_missing_categories(stored, C.tag_categories(tags, bridge, cfg)), "tag-categories")
    store.rewrite("hashtag_categories", cats)
    fresh = C.post_categories(live, bridge, cats, store.read("post_discoveries"), cfg)
    store.rewrite("post_categories", C.replace_post_categories(store.read("post_categories"), live, fresh))


def update_tags(store: Transaction, now, market: str = "global", cfg: Config = DEFAULT) -> None:
    now = S.as_time(now)
    day, day_start = S.utc_day(now), F.date_trunc("day", now)
    posts = store.read("posts").where(F.col("market") == market)
    bridge, tags = store.read("post_hashtags"), store.read("hashtags")
    tracked_all = store.read("tracked_hashtags")
    tracked = tracked_all.where(F.col("market") == market)
    today = P.posts_seen_between(posts, day_start, S.plus_hours(day_start, 24))
    tagged = H.tagged_posts(posts, bridge)

    pairs = X.daily_pairs(today, X.tag_lists(bridge.join(today.select("post_id"), "post_id", "left_semi"), tags, cfg))
    store.overwrite_partitions("hashtag_cooccurrence_daily", pairs)

    daily = store.read("hashtag_daily_stats").where(F.col("market") == market)
    state = materialize(H.tracked_states(tracked, tagged, daily.where(F.col("date") < day), now, cfg), "tag-states")
    store.overwrite_partitions("hashtag_daily_stats", H.today_stats(state, H.daily_rollup(today, bridge, cfg), day))

    daily = store.read("hashtag_daily_stats").where(F.col("market") == market)
    evidence = L.lifecycle_evidence(state, tagged, daily, now, cfg)
    moves = L.transition_events(L.admitted(L.decide(evidence, now, cfg), cfg), now)
    moves = materialize(moves, "moves")
    after = L.apply_transitions(H.write_back_tracked(tracked, state), moves)
    after = materialize(after, "tracked")
    events = store.read("hashtag_tier_events").unionByName(moves)
    found = L.candidate_tags(tagged, tags, after, now, cfg)
    new = _as_tracked(L.admitted_candidates(found, after, events, day_start, cfg), now, after)
    new = materialize(new, "new-tracked")
    entered = new.select(
        "tracked_id", F.lit(None).cast("string").alias("from_tier"), F.col("tier").alias("to_tier"),
        F.lit("candidate_generation").alias("reason"), now.alias("at"),
    )
    store.append("hashtag_tier_events", moves.unionByName(entered))
    rest = tracked_all.where(F.col("market") != market)
    store.rewrite("tracked_hashtags", after.unionByName(new).unionByName(rest))


def _as_tracked(candidates: DataFrame, now, like: DataFrame) -> DataFrame:
    given = {
        "tracked_id": F.xxhash64(*H.TAG_KEY), "tier": F.lit("EXPLORATION"), "source": F.lit("DISCOVERED"),
        "trend_state": F.lit("NEW"), "tier_changed_at": S.as_time(now), "scans_total": F.lit(0), "probes_in_tier": F.lit(0),
        "consecutive_empty_scans": F.lit(0),
    }
    cols = []
    for f in like.schema.fields:
        c = given.get(f.name, F.col(f.name) if f.name in candidates.columns else F.lit(None))
        cols.append(c.cast(f.dataType).alias(f.name))
    return candidates.select(*cols)
