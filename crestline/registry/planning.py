"""Queries over the collection ledger and the tracking plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.config import DEFAULT as CFG
from crestline.functions import scalars as S
from crestline.operators import planning as P
from crestline.registry.base import big, compose, cte, out, query
from crestline.registry.model import model

HOUR = 3_600_000_000


def _slot_sql(op: str, cmp: str) -> str:
    items = ", ".join(f"d + ({24 * k + h}) * {HOUR}" for k in (-1, 0, 1) for h in (5, 13, 21))
    return f"list_{op}(list_filter([{items}], lambda s: s {cmp} u))"


cte("slot_in", "SELECT event_id, epoch_us(ts) AS u, epoch_us(date_trunc('day', ts)) AS d, CASE WHEN user_id % 2 = 0 THEN 'tiktok' ELSE 'instagram' END AS platform FROM events")


@query(
    "discovery_slots",
    "P1, P2",
    compose(
        f"SELECT event_id, slot_start, next_slot, 'discovery:' || platform || ':global:' || strftime(make_timestamp(slot_start), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS slot_key FROM (SELECT *, {_slot_sql('max', '<=')} AS slot_start, {_slot_sql('min', '>')} AS next_slot FROM slot_in)"
    ),
)
def slots(spark, sf):
    ev = model(spark, sf).table("events")
    start = P.slot_start(F.col("ts"), CFG.discovery_slots)
    platform = F.when(F.col("user_id") % 2 == 0, "tiktok").otherwise("instagram")
    return out(
        ev, "event_id", start.alias("slot_start"), P.next_slot(F.col("ts"), CFG.discovery_slots).alias("next_slot"),
        P.slot_key("discovery", platform, F.lit("global"), start).alias("slot_key"),
    )


DUE = "CASE WHEN tier = 'CORE' AND prev_state IN ('BREAKOUT', 'RISING') THEN 24 WHEN tier = 'CORE' THEN 48 WHEN tier IN ('ACTIVE', 'EXPLORATION') THEN 24 WHEN source = 'SEED' THEN 168 ELSE 336 END"


@query("discovery_interval", "P3", compose(f"SELECT tracked_id, {DUE} AS hours, now_us + {DUE} * {HOUR} AS next_due_at FROM tracked"))
def interval(spark, sf):
    m = model(spark, sf)
    return out(m.tracked, "tracked_id", P.interval_hours().alias("hours"), P.next_due(m.now).alias("next_due_at"))


cte(
    "due",
    """SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.platform, tier_class ORDER BY due_us NULLS FIRST, tracked_id) AS due_rank FROM (
 SELECT *, CASE tier WHEN 'CORE' THEN 0 WHEN 'ACTIVE' THEN 1 ELSE 2 END AS tier_class FROM tracked WHERE due_us IS NULL OR due_us <= now_us) t
 JOIN tags h ON h.hashtag_id = t.hashtag_id AND NOT h.is_blocked) WHERE due_rank <= CASE tier_class WHEN 0 THEN 9 WHEN 1 THEN 8 ELSE 10 END""",
)


@query("due_tags", "P4", compose("SELECT tracked_id, platform, tier, due_rank FROM due"))
def due(spark, sf):
    m = model(spark, sf)
    return out(P.due_tags(m.tracked, m.hashtags, m.now), "tracked_id", "platform", "tier", "due_rank")


@query(
    "discovery_batch",
    "P5",
    compose("SELECT tracked_id, platform, tier, batch_rank FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY tier_class, due_rank) AS batch_rank FROM due) WHERE batch_rank <= 6"),
)
def batch(spark, sf):
    m = model(spark, sf)
    return out(P.discovery_batch(P.due_tags(m.tracked, m.hashtags, m.now)), "tracked_id", "platform", "tier", "batch_rank")


@query(
    "refresh_batch",
    "P6",
    compose(
        """SELECT post_id, views, refresh_us AS next_refresh_at FROM posts WHERE platform = 'tiktok' AND availability = 'ACTIVE' AND paid_refresh_count < 3 AND views >= 5000
 AND (now_us - pub_us) / 3600000000.0 BETWEEN 0 AND 48 AND (refresh_us IS NULL OR refresh_us <= now_us) ORDER BY refresh_us NULLS FIRST, post_id LIMIT 20"""
    ),
)
def refresh(spark, sf):
    m = model(spark, sf)
    return out(P.refresh_batch(m.posts, m.now), "post_id", "views", "next_refresh_at")


RATE = "CASE provider WHEN 'apify' THEN 2.3 ELSE 1.5 END"
cte("jcost", f"SELECT *, CAST(records_returned * {RATE} / 1000 AS DECIMAL(12, 6)) AS cost FROM jobs")


@query("job_cost", "I16", compose("SELECT job_id, provider, records_returned, round(CAST(cost AS DOUBLE), 6) AS cost_est_usd FROM jcost"))
def cost(spark, sf):
    return out(P.job_cost(model(spark, sf).jobs), "job_id", "provider", "records_returned", "cost_est_usd")


@query(
    "usage_since",
    "P7",
    compose(
        """SELECT 'all' AS who, CAST(sum(records_returned) AS BIGINT) AS records_used, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd FROM jcost WHERE submitted_us >= lnow_us - 86400000000 * 90
UNION ALL SELECT 'apify', CAST(sum(records_returned) AS BIGINT), round(CAST(sum(cost) AS DOUBLE), 6) FROM jcost WHERE submitted_us >= lnow_us - 86400000000 * 90 AND provider = 'apify'"""
    ),
)
def usage(spark, sf):
    m = model(spark, sf)
    jobs, since = P.job_cost(m.jobs), S.plus_hours(m.ledger_now, -24.0 * 90)
    a = P.usage_since(jobs, since).withColumn("who", F.lit("all"))
    b = P.usage_since(jobs, since, "apify").withColumn("who", F.lit("apify"))
    return out(a.unionByName(b))


@query(
    "budget_status",
    "P8",
    compose(
        """SELECT profile, used_today, used_this_month, round(CAST(usd AS DOUBLE), 6) AS usd_month, round(CAST(ausd AS DOUBLE), 6) AS apify_usd_month, greatest(0, lim - used_today) AS remaining_daily_records,
 round(greatest(0.0, CAST(usd_max - usd AS DOUBLE)), 6) AS remaining_monthly_usd, used_today >= lim AS daily_records_exceeded, usd >= usd_max AS monthly_usd_exceeded, ausd >= amax AS apify_monthly_usd_exceeded,
 NOT (used_today >= lim OR usd >= usd_max) AS can_submit, NOT (used_today >= lim OR usd >= usd_max OR ausd >= amax) AS can_submit_apify
FROM (VALUES ('FREE', 220, 1.0, 1.0), ('LEAN', 360, 10.0, 4.5), ('STANDARD', 1050, 40.0, 20.0)) p(profile, lim, usd_max, amax),
(SELECT CAST(coalesce(sum(records_returned) FILTER (WHERE submitted_us >= lnow_us - 25200000000), 0) AS BIGINT) AS used_today, CAST(coalesce(sum(records_returned), 0) AS BIGINT) AS used_this_month,
 coalesce(sum(cost), 0) AS usd, coalesce(sum(cost) FILTER (WHERE provider = 'apify'), 0) AS ausd FROM jcost WHERE submitted_us >= epoch_us(date_trunc('month', make_timestamp(lnow_us))))"""
    ),
)
def budget(spark, sf):
    m = model(spark, sf)
    jobs = P.job_cost(m.jobs)
    parts = [P.budget_status(jobs, m.ledger_now, p) for p in CFG.budget_profiles]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "run_outcomes",
    "P9",
    compose(
        """SELECT run_id, jobs, ingested, CASE WHEN open > 0 OR (failed = jobs AND jobs < 2) THEN 'OPEN' WHEN ingested = jobs THEN 'COMPLETED' WHEN ingested > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (
 SELECT run_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'INGESTED') AS ingested, count(*) FILTER (WHERE status IN ('FAILED', 'TIMED_OUT')) AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS open FROM jobs GROUP BY 1)"""
    ),
)
def outcomes(spark, sf):
    return out(P.run_outcomes(model(spark, sf).jobs))


@query(
    "retryable_runs",
    "P10",
    compose("SELECT job_id * 2 // 3 AS run_id, count(*) AS attempts FROM jobs GROUP BY 1 HAVING count(*) < 2 AND bool_and(status IN ('FAILED', 'TIMED_OUT'))"),
)
def retryable(spark, sf):
    jobs = model(spark, sf).jobs.withColumn("run_id", F.floor(F.col("job_id") * 2 / 3).cast("bigint"))
    return out(P.retryable_runs(jobs))


@query(
    "new_runs_by_slot",
    "P11",
    compose("SELECT DISTINCT 'slot:' || CAST(o_custkey AS VARCHAR) AS slot_key FROM orders WHERE 'slot:' || CAST(o_custkey AS VARCHAR) NOT IN (SELECT slot_key FROM runs WHERE run_id % 2 = 0)"),
)
def runs_by_slot(spark, sf):
    m = model(spark, sf)
    planned = m.table("orders").select(F.concat(F.lit("slot:"), F.col("o_custkey").cast("string")).alias("slot_key"))
    return P.new_runs(m.runs.where("run_id % 2 = 0"), planned)


@query(
    "latest_activity",
    "P12",
    compose(
        """SELECT max(submitted_us) FILTER (WHERE job_type = 'HASHTAG_DISCOVERY' AND platform = 'tiktok') AS last_tiktok_discovery, max(submitted_us) FILTER (WHERE job_type = 'HASHTAG_DISCOVERY' AND platform = 'instagram') AS last_instagram_discovery,
 max(submitted_us) FILTER (WHERE job_type = 'POST_REFRESH') AS last_refresh FROM jobs"""
    ),
)
def activity(spark, sf):
    return out(P.latest_activity(model(spark, sf).jobs))


@query(
    "tracked_tier_counts",
    "P12",
    compose("SELECT v.tier, count(t.tracked_id) AS n FROM (VALUES ('CORE'), ('ACTIVE'), ('EXPLORATION'), ('DORMANT')) v(tier) LEFT JOIN tracked t ON t.tier = v.tier GROUP BY 1"),
)
def tiers(spark, sf):
    return out(P.tier_counts(model(spark, sf).tracked, "global"))


cte(
    "errs",
    "SELECT us AS at_us, 'scope' || (k % 5) AS scope, CASE WHEN k % 2 = 0 THEN 'WARN' ELSE 'ERROR' END AS severity, 'event ' || event_id AS message, now_us FROM ev WHERE event_type = 'error'",
)


def errors(m):
    e = m.events.where("event_type = 'error'")
    return e.select(
        F.col("ts").alias("at"), F.concat(F.lit("scope"), (F.col("k") % 5).cast("string")).alias("scope"),
        F.when(F.col("k") % 2 == 0, "WARN").otherwise("ERROR").alias("severity"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
    )


@query("recent_errors", "P12", compose("SELECT at_us AS at, scope, severity, message FROM errs WHERE at_us >= now_us - 86400000000 ORDER BY at_us DESC, scope LIMIT 10"))
def recent(spark, sf):
    m = model(spark, sf)
    return out(P.recent_errors(errors(m), S.plus_hours(m.now, -24), 10))


@query("collection_staleness", "P13", compose("SELECT max(planned_us) AS last_planned_at, (any_value(lnow_us) - max(planned_us)) / 60000000.0 > 90 AS stale FROM runs"))
def stale(spark, sf):
    m = model(spark, sf)
    return out(P.staleness(m.runs, m.ledger_now))


HISTORY_SQL = compose(
    """SELECT CAST(d.date AS VARCHAR) AS date, d.platform, d.market, t.name AS tag, d.trend_state, round(d.momentum, 5) AS radar_momentum, d.posts_seen AS radar_posts_seen, d.viral_posts + d.breakout_posts AS qualified_posts,
 d.breakout_posts, d.distinct_creators, d.median_vph, d.scans FROM daily d JOIN tags t USING (hashtag_id), nowc WHERE d.date >= CAST(now AS DATE) - 7"""
)


@query("tag_history_week", "P14, E4", HISTORY_SQL)
def history(spark, sf):
    m = model(spark, sf)
    h = P.tag_history(m.daily, m.hashtags, "global", F.date_sub(S.utc_day(m.now), 7))
    return out(h.withColumn("radar_momentum", F.round("radar_momentum", 5)))


@query(
    "timed_out_jobs",
    "P15",
    compose("SELECT job_id, provider, round((lnow_us - submitted_us) / 60000000.0, 3) AS age_minutes FROM jobs WHERE status = 'RUNNING' AND (lnow_us - submitted_us) / 60000000.0 > CASE provider WHEN 'apify' THEN 90 ELSE 120 END"),
)
def timed_out(spark, sf):
    m = model(spark, sf)
    return out(P.timed_out_jobs(m.jobs, m.ledger_now), "job_id", "provider", F.round("age_minutes", 3).alias("age_minutes"))


@query(
    "error_seen_since",
    "P16",
    compose("SELECT bool_or(scope = 'scope3' AND at_us >= now_us // 86400000000 * 86400000000) AS found_today, bool_or(scope = 'nothing') AS found_other, NOT bool_or(scope = 'nothing') AND true AS warned FROM errs"),
)
def error_seen(spark, sf):
    m = model(spark, sf)
    e, day = errors(m), F.date_trunc("day", m.now)
    a = P.error_since(e, "scope3", day).select(F.col("found").alias("found_today"))
    b = P.error_since(e, "nothing", day).select(F.col("found").alias("found_other"))
    warn = P.warning_once_a_day(P.staleness(m.runs, m.now), e, "nothing", "collection looks stale", m.now)
    return a.crossJoin(b).crossJoin(warn.agg((F.count(F.lit(1)) == 1).alias("warned")))


cte("scanrows", "SELECT h AS tracked_id, max(us) AS at_us, arg_max(n, us) AS n FROM (SELECT us, event_id, (user_id * 2 + 2) % 270 AS h, k % 3 AS n FROM ev) GROUP BY 1")


@query(
    "tags_after_scans",
    "I15, P3",
    compose(
        f"""SELECT t.tracked_id, coalesce(s.at_us, t.scanned_us) AS last_scanned_at, CASE WHEN s.at_us IS NULL THEN t.due_us ELSE s.at_us + {DUE} * {HOUR} END AS next_due_at,
 t.scans_total + CASE WHEN s.at_us IS NULL THEN 0 ELSE 1 END AS scans_total, t.probes_in_tier + CASE WHEN s.at_us IS NULL THEN 0 ELSE 1 END AS probes_in_tier,
 CASE WHEN s.n > 0 THEN 0 ELSE t.consecutive_empty_scans + CASE WHEN s.at_us IS NULL THEN 0 ELSE 1 END END AS consecutive_empty_scans
FROM tracked t LEFT JOIN scanrows s USING (tracked_id)"""
    ),
)
def after_scans(spark, sf):
    m = model(spark, sf)
    scans = m.events.select(
        ((F.col("user_id") * 2 + 2) % 270).alias("tracked_id"), F.col("ts").alias("scanned_at"), (F.col("k") % 3).alias("records")
    )
    t = P.record_scans(m.tracked, scans)
    return out(t, "tracked_id", "last_scanned_at", "next_due_at", "scans_total", "probes_in_tier", "consecutive_empty_scans")


@query(
    "tags_after_failed_scans",
    "I18",
    compose("SELECT t.tracked_id, CASE WHEN t.tracked_id IN (SELECT tracked_id FROM scanrows) THEN now_us + 21600000000 ELSE due_us END AS next_due_at FROM tracked t"),
)
def after_failed(spark, sf):
    m = model(spark, sf)
    failed = m.events.select(((F.col("user_id") * 2 + 2) % 270).alias("tracked_id"))
    return out(P.back_off_failed(m.tracked, failed, m.now, 6), "tracked_id", "next_due_at")


@query(
    "refresh_completion",
    "I14",
    compose(
        """SELECT post_id, paid_refresh_count + CASE WHEN hit THEN 1 ELSE 0 END AS paid_refresh_count, CASE WHEN hit THEN now_us + 21600000000 ELSE refresh_us END AS next_refresh_at FROM (
 SELECT *, post_id IN (SELECT post_id FROM ev WHERE event_type = 'click') AND post_id IN (SELECT post_id FROM ev WHERE event_type = 'view') AS hit FROM posts)"""
    ),
)
def refresh_completion(spark, sf):
    m = model(spark, sf)

    def keys(kind):
        return m.events.where(F.col("event_type") == kind).select("platform", (F.col("post_id") + 7_000_000_000).cast("string").alias("external_id"))

    p = P.complete_refreshes(m.posts, keys("click"), keys("view"), m.now)
    return out(p, "post_id", "paid_refresh_count", "next_refresh_at")
