"""Collection planning and ledger queries: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S

FAILED = ("FAILED", "TIMED_OUT")
TERMINAL = ("INGESTED", *FAILED)


# --- slots ------------------------------------------------------------------------

def _slots(ts: Column, hours) -> Column:
    """Slot instants of the previous, current and next UTC day."""
    day = F.date_trunc("day", ts)
    return F.array(*[S.plus_hours(day, 24.0 * d + h) for d in (-1, 0, 1) for h in sorted(hours)])


def slot_start(ts: Column, hours) -> Column:
    """Latest slot boundary at or before ``ts``."""
    return F.array_max(F.filter(_slots(ts, hours), lambda s: s <= ts))


def next_slot(ts: Column, hours) -> Column:
    """First slot boundary strictly after ``ts``."""
    return F.array_min(F.filter(_slots(ts, hours), lambda s: s > ts))


def slot_key(kind: str, platform: Column, market: Column, start: Column) -> Column:
    iso = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat_ws(":", F.lit(kind), platform, market, iso)


# --- discovery --------------------------------------------------------------------

def interval_hours(cfg: Config = DEFAULT) -> Column:
    """Hours until a tag of this tier, source and state is due again."""
    h, tier = cfg.interval_hours, F.col("tier")
    return (
        F.when((tier == "CORE") & F.col("trend_state").isin("BREAKOUT", "RISING"), h["CORE_TIGHT"])
        .when(tier == "CORE", h["CORE"])
        .when(tier == "ACTIVE", h["ACTIVE"])
        .when(tier == "EXPLORATION", h["EXPLORATION"])
        .when(F.col("source") == "SEED", h["DORMANT_SEED"])
        .otherwise(h["DORMANT_OTHER"])
    )


def next_due(now, cfg: Config = DEFAULT) -> Column:
    return S.plus_hours(S.as_time(now), interval_hours(cfg).cast("double"))


def tier_class() -> Column:
    return F.when(F.col("tier") == "CORE", 0).when(F.col("tier") == "ACTIVE", 1).otherwise(2)


def due_tags(tracked: DataFrame, hashtags: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Due tags per platform, market and tier class, never-due first, cut per class."""
    now = S.as_time(now)
    ok = hashtags.where("not is_blocked").select("hashtag_id")
    due = tracked.join(ok, "hashtag_id", "left_semi").where(F.col("next_due_at").isNull() | (F.col("next_due_at") <= now))
    due = due.withColumn("tier_class", tier_class())
    w = Window.partitionBy("platform", "market", "tier_class").orderBy(F.col("next_due_at").asc_nulls_first(), "tracked_id")
    batch = cfg.slot_core + cfg.slot_active + cfg.slot_rest
    limit = (
        F.when(F.col("tier_class") == 0, cfg.slot_core + cfg.batch_headroom)
        .when(F.col("tier_class") == 1, cfg.slot_active + cfg.batch_headroom)
        .otherwise(cfg.slot_rest + -(-batch // 2) + cfg.batch_headroom)
    )
    most = max(cfg.slot_core, cfg.slot_active, cfg.slot_rest + -(-batch // 2)) + cfg.batch_headroom
    rows = due.withColumn("due_rank", F.row_number().over(w)).where(F.col("due_rank") <= most)
    return rows.where(F.col("due_rank") <= limit)


def discovery_batch(due: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The batch per platform: CORE, then ACTIVE, then the rest, rolling over."""
    size = cfg.slot_core + cfg.slot_active + cfg.slot_rest
    w = Window.partitionBy("platform", "market").orderBy("tier_class", "due_rank")
    return due.withColumn("batch_rank", F.row_number().over(w)).where(F.col("batch_rank") <= size)


# --- refresh ----------------------------------------------------------------------

def refresh_due(now, cfg: Config = DEFAULT) -> Column:
    now = S.as_time(now)
    age = S.hours_between(F.col("published_at"), now)
    eligible = (
        (F.col("availability") == "ACTIVE")
        & (F.col("paid_refresh_count") < cfg.refresh_max_count)
        & (F.col("views") >= cfg.refresh_min_views)
        & age.between(0, cfg.refresh_max_age)
    )
    return F.coalesce(eligible, F.lit(False)) & (F.col("next_refresh_at").isNull() | (F.col("next_refresh_at") <= now))


def refresh_batch(posts: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    rows = posts.where((F.col("platform") == "tiktok") & refresh_due(now, cfg))
    return rows.orderBy(F.col("next_refresh_at").asc_nulls_first(), "post_id").limit(cfg.refresh_batch)


# --- ledger -----------------------------------------------------------------------

def job_cost(jobs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Adds cost_est_usd = records/1000 x rate, exact to six decimals."""
    rate = None
    for provider, usd in cfg.usd_per_1k.items():
        hit, val = F.col("provider") == provider, F.lit(usd).cast("decimal(6,3)")
        rate = F.when(hit, val) if rate is None else rate.when(hit, val)
    cost = F.col("records_returned").cast("decimal(18,0)") * rate / F.lit(1000).cast("decimal(4,0)")
    return jobs.withColumn("cost_est_usd", cost.cast("decimal(12,6)"))


def usage_since(jobs: DataFrame, since: Column, provider: str | None = None) -> DataFrame:
    rows = jobs.where(F.col("submitted_at") >= since)
    if provider:
        rows = rows.where(F.col("provider") == provider)
    zero = F.lit(0).cast("decimal(12,6)")
    return rows.agg(
        F.coalesce(F.sum("records_returned"), F.lit(0)).alias("records_used"),
        F.coalesce(F.sum("cost_est_usd"), zero).alias("cost_usd"),
    )


def budget_status(jobs: DataFrame, now, profile: str = "LEAN", cfg: Config = DEFAULT) -> DataFrame:
    """One row of usage against a profile; day, month and capped provider in one pass."""
    now = S.as_time(now)
    day, month = F.date_trunc("day", now), F.date_trunc("month", now)
    limit_records, usd_max, capped_max = cfg.budget_profiles[profile]
    usd_max, capped_max = (F.lit(x).cast("decimal(12,6)") for x in (usd_max, capped_max))
    n, cost = F.col("records_returned"), F.col("cost_est_usd")
    zero = F.lit(0).cast("decimal(12,6)")
    today, capped = F.col("submitted_at") >= day, F.col("provider") == "apify"
    u = jobs.where(F.col("submitted_at") >= month).agg(
        F.coalesce(F.sum(F.when(today, n)), F.lit(0)).alias("used_today"),
        F.coalesce(F.sum(n), F.lit(0)).alias("used_this_month"),
        F.coalesce(F.sum(cost), zero).alias("usd_month"),
        F.coalesce(F.sum(F.when(capped, cost)), zero).alias("apify_usd_month"),
    )
    out = u.select(
        F.lit(profile).alias("profile"), "*",
        F.greatest(F.lit(0), F.lit(limit_records) - F.col("used_today")).alias("remaining_daily_records"),
        F.greatest(zero, usd_max - F.col("usd_month")).alias("remaining_monthly_usd"),
        (F.col("used_today") >= limit_records).alias("daily_records_exceeded"),
        (F.col("usd_month") >= usd_max).alias("monthly_usd_exceeded"),
        (F.col("apify_usd_month") >= capped_max).alias("apify_monthly_usd_exceeded"),
    )
    can = ~F.col("monthly_usd_exceeded") & ~F.col("daily_records_exceeded")
    return out.withColumns({"can_submit": can, "can_submit_apify": can & ~F.col("apify_monthly_usd_exceeded")})


def run_outcomes(jobs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(run_id, jobs, ingested, status): status stays OPEN while work or a retry remains."""
    g = jobs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "INGESTED").alias("ingested"),
        F.bool_and(F.col("status").isin(*TERMINAL)).alias("terminal"),
        F.bool_and(F.col("status").isin(*FAILED)).alias("all_failed"),
    )
    retry = F.col("all_failed") & (F.col("jobs") < cfg.max_attempts)
    status = (
        F.when(~F.col("terminal") | retry, "OPEN")
        .when(F.col("ingested") == F.col("jobs"), "COMPLETED")
        .when(F.col("ingested") > 0, "PARTIAL")
        .otherwise("FAILED")
    )
    return g.select("run_id", "jobs", "ingested", status.alias("status"))


def retryable_runs(jobs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Runs whose every attempt failed and that have an attempt left."""
    g = jobs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.bool_and(F.col("status").isin(*FAILED)).alias("all_failed")
    )
    return g.where(F.col("all_failed") & (F.col("attempts") < cfg.max_attempts)).select("run_id", "attempts")


def new_runs(stored: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned runs whose slot key is not stored yet (one per key)."""
    return planned.dropDuplicates(["slot_key"]).join(stored.select("slot_key"), "slot_key", "left_anti")


def latest_activity(jobs: DataFrame) -> DataFrame:
    """One row: newest submission per discovery platform and of any refresh."""
    t, kind, p = F.col("submitted_at"), F.col("job_type"), F.col("platform")
    disc = kind == "HASHTAG_DISCOVERY"
    return jobs.where(t.isNotNull()).agg(
        F.max(F.when(disc & (p == "tiktok"), t)).alias("last_tiktok_discovery"),
        F.max(F.when(disc & (p == "instagram"), t)).alias("last_instagram_discovery"),
        F.max(F.when(kind == "POST_REFRESH", t)).alias("last_refresh"),
    )


def tier_counts(tracked: DataFrame, market: str) -> DataFrame:
    tiers = tracked.sparkSession.createDataFrame([(t,) for t in ("CORE", "ACTIVE", "EXPLORATION", "DORMANT")], "tier string")
    got = tracked.where(F.col("market") == market).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(got, "tier", "left").fillna(0, ["n"])


def recent_errors(errors: DataFrame, since: Column, limit: int) -> DataFrame:
    rows = errors.where(F.col("at") >= since)
    return rows.orderBy(F.col("at").desc(), "scope").limit(limit).select("at", "scope", "severity", "message")


def staleness(runs: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """One row: newest planned run and whether collection looks dead."""
    now = S.as_time(now)
    last = F.max("planned_at")
    minutes = S.hours_between(last, now) * 60
    return runs.agg(last.alias("last_planned_at"), F.coalesce(minutes > cfg.stale_minutes, F.lit(True)).alias("stale"))


def tag_history(daily: DataFrame, hashtags: DataFrame, market: str, since: Column) -> DataFrame:
    """History rows from a date on, newest first within the ordered output."""
    rows = daily.where((F.col("market") == market) & (F.col("date") >= since))
    out = rows.join(hashtags.select("hashtag_id", F.col("name").alias("tag")), "hashtag_id")
    return out.select(
        "date", "platform", "market", "tag", "trend_state", F.col("momentum").alias("radar_momentum"),
        F.col("posts_seen").alias("radar_posts_seen"), (F.col("viral_posts") + F.col("breakout_posts")).alias("qualified_posts"),
        "breakout_posts", "distinct_creators", "median_vph", "scans",
    ).orderBy(F.col("date").desc(), "platform", "tag")


def timed_out_jobs(jobs: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Open jobs older than their provider's limit, with the age in minutes."""
    limit = None
    for provider, minutes in cfg.job_max_minutes.items():
        hit = F.col("provider") == provider
        limit = F.when(hit, minutes) if limit is None else limit.when(hit, minutes)
    age = S.hours_between(F.col("submitted_at"), S.as_time(now)) * 60
    return jobs.where(F.col("status").isin("SUBMITTED", "RUNNING") & (age > limit)).withColumn("age_minutes", age)


def error_since(errors: DataFrame, scope: str, since: Column) -> DataFrame:
    """One row: was anything recorded for the scope at or after the instant?"""
    hit = (F.col("scope") == scope) & (F.col("at") >= since)
    return errors.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def warning_once_a_day(stale: DataFrame, errors: DataFrame, scope: str, message: str, now) -> DataFrame:
    """The warning row to append, unless one exists today or nothing is stale."""
    now = S.as_time(now)
    seen = error_since(errors, scope, F.date_trunc("day", now))
    return stale.where("stale").crossJoin(seen).where("not found").select(  # single rows
        now.alias("at"), F.lit(scope).alias("scope"), F.lit("WARN").alias("severity"), F.lit(message).alias("message")
    )


# --- bookkeeping --------------------------------------------------------------------

def record_scans(tracked: DataFrame, scans: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Apply a batch of scans (tracked_id, scanned_at, records) to the tracked table."""
    s = scans.groupBy("tracked_id").agg(F.max("scanned_at").alias("_at"), F.max_by("records", "scanned_at").alias("_n"))
    out = tracked.join(s, "tracked_id", "left")
    hit = F.col("_at").isNotNull()
    one = F.when(hit, 1).otherwise(0)
    return out.withColumns(
        {
            "last_scanned_at": F.coalesce("_at", "last_scanned_at"),
            "next_due_at": F.when(hit, next_due(F.col("_at"), cfg)).otherwise(F.col("next_due_at")),
            "scans_total": F.col("scans_total") + one,
            "probes_in_tier": F.col("probes_in_tier") + one,
            "consecutive_empty_scans": F.when(hit & (F.col("_n") > 0), 0).otherwise(F.col("consecutive_empty_scans") + one),
        }
    ).select(*tracked.columns)


def back_off_failed(tracked: DataFrame, failed: DataFrame, now, hours: float) -> DataFrame:
    """Failed scans (tracked_id) become due again after ``hours``."""
    f = failed.select("tracked_id").distinct().withColumn("_f", F.lit(True))
    due = F.when(F.col("_f"), S.plus_hours(S.as_time(now), hours)).otherwise(F.col("next_due_at"))
    return tracked.join(f, "tracked_id", "left").withColumn("next_due_at", due).select(*tracked.columns)


def complete_refreshes(posts: DataFrame, observed: DataFrame, requested: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """Observed posts that were requested: counter +1 and the next refresh set.

    ``observed``/``requested``: (platform, external_id) rows. The next refresh
    counts from ``refreshed_at`` of ``observed`` if it has that column, else
    from ``now``.
    """
    key = ["platform", "external_id"]
    at = F.max("refreshed_at") if "refreshed_at" in observed.columns else F.lit(None).cast("timestamp")
    hits = observed.groupBy(*key).agg(at.alias("_at")).join(requested.select(*key).distinct(), key, "left_semi").withColumn("_r", F.lit(True))
    out = posts.join(hits, key, "left")
    start = F.col("_at") if now is None else F.coalesce("_at", S.as_time(now))
    return out.withColumns(
        {
            "paid_refresh_count": F.col("paid_refresh_count") + F.when(F.col("_r"), 1).otherwise(0),
            "next_refresh_at": F.when(F.col("_r"), S.plus_hours(start, cfg.refresh_step_hours)).otherwise(F.col("next_refresh_at")),
        }
    ).select(*posts.columns)
