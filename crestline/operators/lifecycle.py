"""Tag tracking: transitions, tier caps, candidates and manual overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators.hashtags import TAG_KEY, evidence_since, is_qualified, revival_evidence, weak_streak

EVENT_COLUMNS = ("tracked_id", "from_tier", "to_tier", "reason", "at")


def lifecycle_evidence(tracked_now: DataFrame, tagged: DataFrame, daily_with_state: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Tracked tags with everything the decision needs, from grouped passes only."""
    changed = tracked_now.select(*TAG_KEY, "tier_changed_at")
    # Fewer rows than tags x platforms; size-based joins decide the strategy.
    in_tier = tagged.join(changed, TAG_KEY).withColumn(
        "since", F.coalesce("tier_changed_at", F.timestamp_seconds(F.lit(0)))
    )
    ev = evidence_since(in_tier, {"tier": F.col("since")})
    out = (
        tracked_now.join(ev, TAG_KEY, "left")
        .join(revival_evidence(tagged, now, cfg), TAG_KEY, "left")
        .join(weak_streak(daily_with_state), TAG_KEY, "left")
    )
    out = out.fillna(0, ["qualified_tier", "creators_tier", "watch_tier", "qualified_any_path", "weak_evals"])
    days = S.hours_between(F.col("tier_changed_at"), S.as_time(now)) / 24.0
    return out.withColumn("days_in_tier", days)


def decide(evidence: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Adds action (promote/demote/hold), to_tier and reason.

    A tag whose tier never changed counts as being there for ever.
    """
    tier = F.col("tier")
    days = F.col("days_in_tier")
    early = days * 24.0 < cfg.tier_hold_hours
    revived = F.col("qualified_any_path") >= cfg.revival_min_posts
    proven = (
        (F.col("qualified_tier") >= cfg.promote_min_posts) & (F.col("creators_tier") >= cfg.promote_min_creators)
    ) | F.coalesce(F.col("trend_state").isin("BREAKOUT", "RISING"), F.lit(False))
    spent = (F.col("probes_in_tier") >= cfg.demote_min_probes) & (days.isNull() | (days >= cfg.demote_min_days))
    weak = F.col("weak_evals") >= cfg.demote_weak_evals
    empty = F.col("consecutive_empty_scans") >= cfg.demote_empty_scans
    # The reason strings stored with every event.
    reason = (
        F.when(tier == "CORE", "core_never_auto_transitions")
        .when(F.coalesce(early, F.lit(False)), "hysteresis_window_active")
        .when((tier == "DORMANT") & revived, "passive_revival")
        .when(tier == "DORMANT", "no_revival_evidence")
        .when((tier == "EXPLORATION") & proven, "exploration_criteria_met")
        .when((tier == "EXPLORATION") & spent, "exploration_probes_exhausted")
        .when(tier == "EXPLORATION", "still_probing")
        .when(weak, "consecutive_weak_trend_state")
        .when(empty, "consecutive_zero_viral_scans")
        .otherwise("active_performing")
    )
    target = {
        "passive_revival": ("promote", "EXPLORATION"),
        "exploration_criteria_met": ("promote", "ACTIVE"),
        "exploration_probes_exhausted": ("demote", "DORMANT"),
        "consecutive_weak_trend_state": ("demote", "DORMANT"),
        "consecutive_zero_viral_scans": ("demote", "DORMANT"),
    }
    out = evidence.withColumn("reason", reason)
    action, to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, (a, t) in target.items():
        hit = F.col("reason") == r
        action, to = F.when(hit, a).otherwise(action), F.when(hit, t).otherwise(to)
    return out.withColumns({"action": F.coalesce(action, F.lit("hold")), "to_tier": to})


def tier_cap(tier: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(tier == "EXPLORATION", cfg.cap_exploration).when(tier == "ACTIVE", cfg.cap_active)


def admitted(decisions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Moves that happen: every demotion, and promotions into free slots.

    Set semantics: demotions free their slots, ACTIVE fills first (freeing
    EXPLORATION slots), then EXPLORATION; newcomers enter by evidence
    (in-tier qualified, any-path qualified) and id.
    """
    where = ["platform", "market"]
    tier, act = F.col("tier"), F.col("action")
    sizes = decisions.groupBy(*where).agg(
        F.count_if((tier == "ACTIVE") & (act != "demote")).alias("active_stay"),
        F.count_if((tier == "EXPLORATION") & (act == "hold")).alias("expl_stay"),
        F.count_if((tier == "EXPLORATION") & (act == "promote")).alias("expl_up"),
    )
    active_free = F.greatest(F.lit(cfg.cap_active) - F.col("active_stay"), F.lit(0))
    still = F.greatest(F.col("expl_up") - active_free, F.lit(0))
    free = F.when(F.col("to_tier") == "ACTIVE", active_free).otherwise(
        F.lit(cfg.cap_exploration) - F.col("expl_stay") - still
    )
    w = Window.partitionBy(*where, "to_tier").orderBy(
        F.col("qualified_tier").desc(), F.col("qualified_any_path").desc(), F.col("tracked_id")
    )
    up = decisions.where(act == "promote").withColumn("slot", F.row_number().over(w))
    up = up.where(F.col("slot") <= max(cfg.cap_active, cfg.cap_exploration)).join(sizes, where)
    cols = decisions.columns
    return decisions.where(act == "demote").unionByName(up.where(F.col("slot") <= free).select(*cols))


def eviction_check(decisions: DataFrame, priority: str, cfg: Config = DEFAULT) -> DataFrame:
    """For promotions into a full tier: would the newcomer beat the weakest member?"""
    where = ["platform", "market"]
    members = decisions.groupBy(*where, F.col("tier").alias("to_tier")).agg(
        F.count(F.lit(1)).alias("size"), F.min(priority).alias("weakest")
    )
    up = decisions.where("action = 'promote'").join(members, [*where, "to_tier"], "left")
    size = F.coalesce("size", F.lit(0))
    free = size < tier_cap(F.col("to_tier"), cfg)
    stronger = F.coalesce(F.col(priority) > F.col("weakest"), F.lit(False))
    return up.select(
        "tracked_id", *where, "to_tier", size.alias("size"), (free | stronger).alias("admit"), (~free & stronger).alias("evict_weakest")
    )


def transition_events(moves: DataFrame, now) -> DataFrame:
    return moves.select("tracked_id", F.col("tier").alias("from_tier"), "to_tier", "reason", S.as_time(now).alias("at"))


def apply_transitions(tracked: DataFrame, events: DataFrame) -> DataFrame:
    """Tracked table after the events: tier set, timers and counters reset."""
    e = events.select("tracked_id", F.col("to_tier").alias("_to"), F.col("at").alias("_at"))
    out = tracked.join(e, "tracked_id", "left")
    moved = F.col("_to").isNotNull()
    zero = F.lit(0)
    return out.withColumns(
        {
            "tier": F.coalesce("_to", "tier"),
            "tier_changed_at": F.coalesce("_at", "tier_changed_at"),
            "probes_in_tier": F.when(moved, zero).otherwise(F.col("probes_in_tier")),
            "consecutive_empty_scans": F.when(moved, zero).otherwise(F.col("consecutive_empty_scans")),
        }
    ).select(*tracked.columns)


def candidate_tags(tagged: DataFrame, hashtags: DataFrame, tracked: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Untracked, plain tags with enough qualified posts by enough creators."""
    since = S.plus_hours(S.as_time(now), -cfg.candidate_hours)
    plain = hashtags.where("not is_generic and not is_blocked").select("hashtag_id", F.col("name").alias("tag"))
    rows = tagged.where((F.col("last_seen_at") >= since) & is_qualified()).join(
        tracked.select(*TAG_KEY), TAG_KEY, "left_anti"
    )
    stats = rows.groupBy(*TAG_KEY).agg(
        F.count(F.lit(1)).alias("qualified_posts"), F.count_distinct("creator").alias("distinct_creators")
    )
    return stats.where(
        (F.col("qualified_posts") >= cfg.candidate_min_posts) & (F.col("distinct_creators") >= cfg.candidate_min_creators)
    ).join(plain, "hashtag_id")


def admitted_candidates(
    candidates: DataFrame, tracked: DataFrame, tier_events: DataFrame, day_start: Column, cfg: Config = DEFAULT
) -> DataFrame:
    """Candidates that enter EXPLORATION today, per platform and market.

    Slots = min(daily quota minus today's entries, pool cap minus pool size).
    """
    where = ["platform", "market"]
    pool = tracked.groupBy(*where).agg(F.count_if(F.col("tier") == "EXPLORATION").alias("pool"))
    at = F.col("at")
    today = (
        tier_events.where((F.col("to_tier") == "EXPLORATION") & (at >= day_start) & (at < S.plus_hours(day_start, 24)))
        .join(tracked.select("tracked_id", *where), "tracked_id")
        .groupBy(*where)
        .agg(F.count(F.lit(1)).alias("entered"))
    )
    ok = candidates.where(F.length("tag") >= cfg.candidate_min_length)
    w = Window.partitionBy(*where).orderBy(F.col("qualified_posts").desc(), F.col("hashtag_id"))
    most = max(cfg.cap_new_per_day, cfg.cap_exploration)
    ranked = ok.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    slots = F.least(
        F.lit(cfg.cap_new_per_day) - F.coalesce("entered", F.lit(0)), F.lit(cfg.cap_exploration) - F.coalesce("pool", F.lit(0))
    )
    joined = ranked.join(pool, where, "left").join(today, where, "left")
    return joined.where(F.col("rn") <= slots).select(*candidates.columns, "rn")


def track_if_absent(tracked_keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (hashtag_id, platform, market, tier, source) rows not tracked yet."""
    return wanted.dropDuplicates(TAG_KEY).join(tracked_keys.select(*TAG_KEY), TAG_KEY, "left_anti")


def manual_overrides(tracked: DataFrame, hashtags: DataFrame, requests: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Batch of manual track/untrack requests -> (new tracked rows, audit events).

    ``requests``: hashtag_id, platform, market, action ('track'/'untrack'), tier.
    Blocked tags are never tracked; a tracked tag is left alone by ``track``;
    ``untrack`` moves any tier except DORMANT to DORMANT.
    """
    reason, at = F.lit("MANUAL_ADMIN").alias("reason"), S.as_time(now).alias("at")
    allowed = requests.where("action = 'track'").join(
        hashtags.where("is_blocked").select("hashtag_id"), "hashtag_id", "left_anti"
    )
    new = track_if_absent(tracked, allowed.withColumn("source", F.lit("MANUAL"))).withColumn(
        "tracked_id", F.xxhash64(*TAG_KEY)
    )
    added = new.select("tracked_id", F.lit(None).cast("string").alias("from_tier"), F.col("tier").alias("to_tier"), reason, at)
    drop = requests.where("action = 'untrack'").select(*TAG_KEY).distinct()
    removed = (
        tracked.where("tier <> 'DORMANT'")
        .join(drop, TAG_KEY, "left_semi")
        .select("tracked_id", F.col("tier").alias("from_tier"), F.lit("DORMANT").alias("to_tier"), reason, at)
    )
    return new.select("tracked_id", *TAG_KEY, "tier", "source"), added.unionByName(removed)
