"""Queries over the daily report, its sections, exports and live views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from crestline.functions import scalars as S
from crestline.operators import planning as P
from crestline.operators import report as R
from crestline.registry.base import big, compose, cte, out, query
from crestline.registry.model import model
from crestline.registry.tags import post_cats, tier_events
from crestline.session import materialize
from crestline.sources import exports as E
from crestline.sources import lookups as K

KEY = "coalesce(trend_score0, 0) DESC, coalesce(rising_score0, 0) DESC, coalesce(vph, 0) DESC, coalesce(views, 0) DESC, pub_us DESC, post_id"
RISE = "coalesce(rising_score0, 0) DESC, coalesce(vph, 0) DESC, pub_us DESC, post_id"
cte("rc", "SELECT *, 'MEDIUM' AS velocity_confidence FROM posts WHERE pub_us >= now_us - 259200000000")
cte(
    "pool",
    """SELECT *, platform || ':' || coalesce(creator_username, 'anon:' || post_id) AS ck, CASE WHEN pub_us BETWEEN now_us - 86400000000 AND now_us THEN 'TODAY' WHEN pub_us >= now_us - 259200000000 AND pub_us < now_us - 86400000000 THEN 'STILL_HOT' END AS win
FROM rc WHERE availability = 'ACTIVE' AND content_type IN ('video', 'reel') AND coalesce(prev_state, '') <> 'DEAD' AND trend_score0 IS NOT NULL AND tier IN ('VIRAL_QUALIFIED', 'EARLY_BREAKOUT')""",
)
cte(
    "todaytop",
    f"""SELECT *, row_number() OVER (ORDER BY {KEY}) AS rank FROM (SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {KEY}) AS pr FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY {KEY}) AS cr FROM pool WHERE win = 'TODAY') WHERE cr <= 2)
 ORDER BY pr <= 8 DESC, {KEY} LIMIT 30)""",
)
cte(
    "stillhot",
    "SELECT *, row_number() OVER (ORDER BY coalesce(trend_score0, 0) DESC, coalesce(rising_score0, 0) DESC, post_id) AS rank FROM pool WHERE win = 'STILL_HOT' QUALIFY rank <= 15",
)
cte(
    "risingnow",
    f"SELECT *, row_number() OVER (ORDER BY coalesce(rising_score0, 0) DESC, post_id) AS rank FROM (SELECT * FROM pool WHERE win IS NOT NULL ORDER BY {RISE} LIMIT 10)",
)
cte(
    "items",
    "SELECT 'TODAY' AS section, rank, post_id FROM todaytop UNION ALL SELECT 'STILL_HOT', rank, post_id FROM stillhot UNION ALL SELECT 'RISING_NOW', rank, post_id FROM risingnow",
)


def candidates(m):
    return R.report_candidates(m.posts, "global", m.now)


def labelled(m):
    return R.with_labels(R.sections(candidates(m), m.now), m.post_tags, post_cats(m))


@query(
    "report_candidates",
    "S8",
    compose(
        """SELECT c.post_id, c.platform, t.hashtags, coalesce(k.categories, '') AS categories FROM rc c JOIN (SELECT post_id, string_agg(name, '|' ORDER BY position) AS hashtags FROM ptags GROUP BY 1) t USING (post_id)
LEFT JOIN (SELECT post_id, string_agg(category, '|' ORDER BY category) AS categories FROM postcat GROUP BY 1) k USING (post_id)"""
    ),
)
def report_candidates(spark, sf):
    m = model(spark, sf)
    c = R.with_labels(candidates(m), m.post_tags, post_cats(m))
    return c.select("post_id", "platform", F.concat_ws("|", "hashtags").alias("hashtags"), F.concat_ws("|", "categories").alias("categories"))


@query("rankable_posts", "R1", compose("SELECT post_id, tier FROM pool"))
def rankable(spark, sf):
    return candidates(model(spark, sf)).where(R.rankable()).select("post_id", "tier")


@query("report_windows", "R2, K17", compose("SELECT post_id, win AS report_window FROM pool WHERE win IS NOT NULL"))
def windows(spark, sf):
    m = model(spark, sf)
    return R.pools(candidates(m), m.now).select("post_id", F.col("window").alias("report_window"))


@query("today_top", "R3", compose("SELECT rank, post_id, platform, ck AS creator FROM todaytop"))
def today_top(spark, sf):
    m = model(spark, sf)
    pool = R.pools(candidates(m), m.now).where("window = 'TODAY'")
    return out(R.today_top(pool), "rank", "post_id", "platform", R.creator_of().alias("creator"))


BYUSER = "coalesce(trend_score0, 0) DESC, coalesce(rising_score0, 0) DESC, coalesce(vph, 0) DESC, coalesce(views, 0) DESC, pub_us DESC, post_id"


@query(
    "month_top_with_caps",
    "R3",
    compose(
        f"""SELECT row_number() OVER (ORDER BY {BYUSER}) AS rank, post_id, platform FROM (SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {BYUSER}) AS pr FROM (SELECT *, row_number() OVER (PARTITION BY platform || ':' || coalesce(creator_username, 'anon:' || post_id) ORDER BY {BYUSER}) AS cr FROM posts WHERE pub_us IS NOT NULL) WHERE cr <= 2)
 ORDER BY pr <= 8 DESC, {BYUSER} LIMIT 30)"""
    ),
)
def month_top(spark, sf):
    """The same constrained list over every post, where the creator cap binds."""
    return out(R.today_top(model(spark, sf).posts.where("published_at is not null")), "rank", "post_id", "platform")


@query("still_hot", "R4", compose("SELECT rank, post_id FROM stillhot"))
def still_hot(spark, sf):
    m = model(spark, sf)
    return out(R.still_hot(R.pools(candidates(m), m.now).where("window = 'STILL_HOT'")), "rank", "post_id")


@query("rising_now", "R5", compose("SELECT rank, post_id FROM risingnow"))
def rising_now(spark, sf):
    m = model(spark, sf)
    return out(R.rising_now(R.pools(candidates(m), m.now), 10), "rank", "post_id")


cte(
    "export",
    """SELECT p.*, row_number() OVER (ORDER BY coalesce(p.trend_score0, 0) DESC, p.post_id) AS rank FROM posts p WHERE post_id IN (SELECT post_id FROM items) QUALIFY rank <= 100""",
)


@query("export_pool", "R6", compose("SELECT rank, post_id FROM export"))
def export_pool(spark, sf):
    m = model(spark, sf)
    return out(R.export_pool(R.sections(candidates(m), m.now)), "rank", "post_id")


@query(
    "report_items",
    "R7, K23",
    compose(
        """SELECT i.section, i.rank, i.post_id, CASE WHEN length(caption) > 9 THEN substr(caption, 1, 9) || '…' ELSE caption END AS caption_preview, round(greatest(0.0, (now_us - pub_us) / 3600000000.0), 6) AS age_hours,
 i.post_id IN (SELECT post_id FROM ev WHERE event_type = 'view') AS in_yesterday_report FROM items i JOIN posts USING (post_id)"""
    ),
)
def report_items(spark, sf):
    from dataclasses import replace

    from crestline.config import DEFAULT

    m = model(spark, sf)
    seen = m.events.where("event_type = 'view'").select("post_id")
    rows = R.report_items(R.sections(candidates(m), m.now), seen, m.now, replace(DEFAULT, caption_chars=9))
    return out(rows, "section", "rank", "post_id", "caption_preview", "age_hours", "in_yesterday_report")


@query(
    "report_counts",
    "R8, K18",
    compose(
        """SELECT (SELECT count(*) FROM pool WHERE win = 'TODAY' AND tier = 'VIRAL_QUALIFIED') AS viral_qualified, (SELECT count(*) FROM pool WHERE win = 'TODAY' AND tier = 'EARLY_BREAKOUT') AS early_breakout,
 (SELECT count(*) FROM rc WHERE tier = 'WATCH' AND pub_us BETWEEN now_us - 86400000000 AND now_us) AS watch"""
    ),
)
def counts(spark, sf):
    m = model(spark, sf)
    return out(R.report_counts(candidates(m), m.now))


@query(
    "report_distribution",
    "R9",
    compose(
        """SELECT 'platform' AS kind, v.p AS label, count(post_id) AS posts FROM (VALUES ('tiktok'), ('instagram')) v(p) LEFT JOIN (SELECT * FROM pool WHERE win = 'TODAY') t ON t.platform = v.p GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM pool JOIN postcat USING (post_id) WHERE win = 'TODAY' GROUP BY 2"""
    ),
)
def distribution(spark, sf):
    m = model(spark, sf)
    pool = R.pools(candidates(m), m.now).where("window = 'TODAY'")
    a = R.platform_distribution(pool).select(F.lit("platform").alias("kind"), F.col("platform").alias("label"), "posts")
    b = R.category_distribution(pool, post_cats(m)).select(F.lit("category").alias("kind"), F.col("category").alias("label"), "posts")
    return out(a.unionByName(b))


def topic_clusters(m):
    """Three fixed-rank clusters cut from the tag vocabulary, by topic number."""
    n = F.col("hashtag_id") % 3
    g = m.hashtags.where("hashtag_id > 100").groupBy((n + 1).cast("int").alias("cluster_rank"))
    c = g.agg(F.sort_array(F.collect_set("name")).alias("tags"), F.sum("hashtag_id").alias("qualified_posts"))
    return c.select("cluster_rank", F.element_at("tags", 1).alias("label"), "tags", "qualified_posts", F.lit(None).cast("bigint").alias("views_sum"))


cte(
    "csample",
    """SELECT cluster_rank, section, rank, row_number() OVER (PARTITION BY cluster_rank ORDER BY CASE section WHEN 'TODAY' THEN 0 ELSE 1 END, rank) AS position FROM (
 SELECT DISTINCT hashtag_id % 3 + 1 AS cluster_rank, section, rank FROM items JOIN ptags USING (post_id) WHERE section <> 'RISING_NOW' AND hashtag_id > 100) QUALIFY position <= 5""",
)


@query("cluster_sample_ranks", "R10, K19", compose("SELECT cluster_rank, section, rank, position FROM csample"))
def cluster_samples(spark, sf):
    m = model(spark, sf)
    return out(R.cluster_samples(topic_clusters(m), labelled(m)), "cluster_rank", "section", "rank", "position")


cte(
    "titems",
    """SELECT tracked_id, t.platform, name AS tag, CASE tracked_id % 5 WHEN 0 THEN 'BREAKOUT' WHEN 1 THEN 'RISING' ELSE prev_state END AS trend_state, coalesce(posts_seen, 0) AS seen_posts,
 coalesce(viral_posts, 0) + coalesce(breakout_posts, 0) AS qualified_posts, coalesce(distinct_creators, 0) AS distinct_creators, median_vph
FROM tracked t LEFT JOIN (SELECT rollup.* FROM rollup, today WHERE date = today) r USING (platform, hashtag_id)""",
)
_sec = "SELECT '{0}' AS section, row_number() OVER (ORDER BY qualified_posts DESC, seen_posts DESC, tag, platform) AS rank, * FROM titems WHERE {1} QUALIFY rank <= 10"
cte("tsec", " UNION ALL ".join(f"SELECT * FROM ({_sec.format(n, w)})" for n, w in (("BREAKOUT", "trend_state = 'BREAKOUT'"), ("RISING", "trend_state = 'RISING'"), ("TOP", "true"))))


def today_daily(m):
    return m.daily.where(F.col("date") == S.utc_day(m.now))


def tag_rows(m):
    state = F.when(F.col("tracked_id") % 5 == 0, "BREAKOUT").when(F.col("tracked_id") % 5 == 1, "RISING").otherwise(F.col("trend_state"))
    # Three sections are cut from the tags with their counts.
    return R.tag_sections(materialize(R.tag_items(m.tracked.withColumn("trend_state", state), today_daily(m)), "tag-items"))


@query("report_tag_sections", "R11, K24", compose("SELECT section, rank, tag, platform, seen_posts, qualified_posts, distinct_creators, median_vph FROM tsec"))
def tag_sections(spark, sf):
    return out(tag_rows(model(spark, sf)), "section", "rank", "tag", "platform", "seen_posts", "qualified_posts", "distinct_creators", "median_vph")


cte(
    "ttags",
    """SELECT DISTINCT kind, tag FROM (SELECT CASE WHEN from_tier IS NULL THEN 'NEW' WHEN to_tier = 'DORMANT' THEN 'DEMOTED' END AS kind, name AS tag FROM tevents WHERE at_us >= now_us - 345600000000 AND at_us < now_us) WHERE kind IS NOT NULL""",
)


@query("tier_event_tags", "R12", compose("SELECT * FROM ttags"))
def tier_tags(spark, sf):
    m = model(spark, sf)
    return R.tier_event_tags(tier_events(m), m.tracked, "global", S.plus_hours(m.now, -96), m.now)


def ledger(m):
    """Ledger tables with post, snapshot and tag rows on the ledger's clock."""
    o = m.table("orders")
    posts = o.select(F.col("o_orderkey").alias("post_id"), F.lit("global").alias("market"), F.col("o_orderdate").alias("first_seen_at"))
    snaps = m.table("lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_shipdate").alias("observed_at"))
    tracked = m.tracked.withColumn("last_scanned_at", S.plus_hours(m.ledger_now, -(F.col("tracked_id") % 90 * 24).cast("double")))
    return m.runs, P.job_cost(m.jobs), posts, snaps, tracked, S.plus_hours(m.ledger_now, -24.0 * 30), m.ledger_now


W = "BETWEEN lnow_us - 2592000000000 AND lnow_us - 1"
cte(
    "summary",
    f"""SELECT (SELECT count(*) FROM runs WHERE planned_us {W}) AS runs, (SELECT count(*) FROM runs WHERE planned_us {W} AND status = 'FAILED') AS runs_failed, (SELECT count(*) FROM runs WHERE planned_us {W} AND status = 'PARTIAL') AS runs_partial,
 (SELECT CAST(coalesce(sum(records_returned), 0) AS BIGINT) FROM jobs WHERE run_id IN (SELECT run_id FROM runs WHERE planned_us {W})) AS posts_scanned,
 (SELECT CAST(coalesce(sum(records_returned), 0) AS BIGINT) FROM jobs WHERE platform = 'tiktok' AND run_id IN (SELECT run_id FROM runs WHERE planned_us {W})) AS scanned_tiktok,
 (SELECT CAST(coalesce(sum(records_returned), 0) AS BIGINT) FROM jobs WHERE platform = 'instagram' AND run_id IN (SELECT run_id FROM runs WHERE planned_us {W})) AS scanned_instagram,
 (SELECT count(DISTINCT l_orderkey) FROM lineitem, lnow WHERE epoch_us(l_shipdate) {W}) AS unique_posts, (SELECT count(*) FROM lineitem, lnow WHERE epoch_us(l_shipdate) {W}) AS snapshots,
 (SELECT count(*) FROM orders, lnow WHERE epoch_us(o_orderdate) {W}) AS new_posts, (SELECT count(*) FROM tracked WHERE tracked_id % 90 BETWEEN 1 AND 30) AS tags_scanned,
 (SELECT CAST(coalesce(sum(records_returned), 0) AS BIGINT) FROM jcost WHERE submitted_us >= lnow_us - 2592000000000) AS records_used, (SELECT round(CAST(coalesce(sum(cost), 0) AS DOUBLE), 6) FROM jcost WHERE submitted_us >= lnow_us - 2592000000000) AS est_cost_usd""",
)


@query("collection_summary", "R13", compose("SELECT * FROM summary"))
def summary(spark, sf):
    runs, jobs, posts, snaps, tracked, start, end = ledger(model(spark, sf))
    return out(R.collection_summary(runs, jobs, posts, snaps, tracked, "global", start, end))


cte(
    "outc",
    f"""SELECT v.p AS platform, count(j.job_id) AS jobs, count(j.job_id) FILTER (WHERE j.status IN ('FAILED', 'TIMED_OUT')) AS failed FROM (VALUES ('tiktok'), ('instagram')) v(p)
LEFT JOIN (SELECT * FROM jobs WHERE run_id IN (SELECT run_id FROM runs WHERE planned_us {W})) j ON j.platform = v.p GROUP BY 1""",
)
cte("unfin", f"SELECT coalesce(bool_or(status IN ('PLANNED', 'RUNNING')), false) AS unfinished FROM runs WHERE planned_us {W}")


@query("platform_outcomes", "R14", compose("SELECT o.*, unfinished FROM outc o, unfin"))
def outcomes(spark, sf):
    runs, jobs, *_, start, end = ledger(model(spark, sf))
    return out(R.platform_outcomes(runs, jobs, start, end).crossJoin(R.unfinished_runs(runs, start, end)))


@query(
    "partial_reasons",
    "R15",
    compose(
        """SELECT array_to_string(list_filter(list_concat(['analytics:failed'], (SELECT list(CASE WHEN jobs > 0 AND failed = jobs THEN platform || ':discovery_failed' WHEN failed > 0 THEN platform || ':discovery_partial' END ORDER BY platform DESC) FROM outc),
 [(SELECT CASE WHEN unfinished THEN 'collection:unfinished_jobs' END FROM unfin)], ['collection:budget_exhausted']), lambda x: x IS NOT NULL), ',') AS partial_reasons, 'PARTIAL' AS status"""
    ),
)
def reasons(spark, sf):
    m = model(spark, sf)
    runs, jobs, *_, start, end = ledger(m)
    # Budget over a year of the ledger, so that its monthly ceiling is exceeded.
    year = jobs.withColumn("submitted_at", F.lit(None).cast("timestamp")).withColumn("submitted_at", m.ledger_now)
    b = P.budget_status(year, m.ledger_now)
    r = R.partial_reasons(R.platform_outcomes(runs, jobs, start, end), R.unfinished_runs(runs, start, end), b, ["analytics:failed", "analytics:failed"])
    return r.select(F.concat_ws(",", "partial_reasons").alias("partial_reasons"), "status")


cte(
    "reports",
    "SELECT CAST(day AS VARCHAR) AS report_date, count(*) FILTER (WHERE tier = 'VIRAL_QUALIFIED') AS viral_qualified, count(*) FILTER (WHERE tier = 'EARLY_BREAKOUT') AS early_breakout, count(*) AS posts_scanned, max(post_id) AS top_post FROM (SELECT *, CAST(make_timestamp(first_us) AS DATE) AS day FROM posts) GROUP BY 1",
)


def reports(m):
    d = S.utc_day(F.col("first_seen_at"))
    g = m.posts.groupBy(d.cast("string").alias("report_date"), "market").agg(
        F.count_if(F.col("tier") == "VIRAL_QUALIFIED").alias("viral_qualified"), F.count_if(F.col("tier") == "EARLY_BREAKOUT").alias("early_breakout"),
        F.count(F.lit(1)).alias("posts_scanned"), F.max("post_id").alias("top_post"),
    )
    return g


def span(r):
    """First and last report date, as text."""
    return tuple(r.agg(F.min("report_date").cast("string"), F.max("report_date").cast("string")).first())


@query(
    "previous_and_latest_report",
    "S10",
    compose("SELECT 'previous' AS kind, * FROM reports WHERE report_date = (SELECT max(report_date) FROM reports WHERE report_date < (SELECT max(report_date) FROM reports)) UNION ALL SELECT 'latest', * FROM reports WHERE report_date = (SELECT max(report_date) FROM reports)"),
)
def previous_latest(spark, sf):
    r = reports(model(spark, sf))
    a = K.previous_report(r, F.lit(span(r)[1]), "global").withColumn("kind", F.lit("previous"))
    b = K.latest_report(r, "global").withColumn("kind", F.lit("latest"))
    return out(a.unionByName(b).drop("market"))


METRICS = ["viral_qualified", "early_breakout", "posts_scanned"]


@query(
    "versus_yesterday",
    "R16, R22",
    compose(
        """SELECT m AS metric, c AS current, p AS previous, c - p AS delta, round((c - p) * 100.0 / nullif(p, 0), 6) AS pct FROM (SELECT unnest(['viral_qualified', 'early_breakout', 'posts_scanned']) AS m,
 unnest([a.viral_qualified, a.early_breakout, a.posts_scanned]) AS c, unnest([b.viral_qualified, b.early_breakout, b.posts_scanned]) AS p FROM reports a, reports b WHERE a.report_date = (SELECT max(report_date) FROM reports) AND b.report_date = (SELECT max(report_date) FROM reports WHERE report_date < (SELECT max(report_date) FROM reports)))
UNION ALL SELECT m, c, NULL, NULL, NULL FROM (SELECT unnest(['viral_qualified', 'early_breakout', 'posts_scanned']) AS m, unnest([viral_qualified, early_breakout, posts_scanned]) AS c FROM reports WHERE report_date = (SELECT min(report_date) FROM reports))"""
    ),
)
def versus(spark, sf):
    r = reports(model(spark, sf))
    lo, hi = span(r)
    a = R.versus_previous(r.where(F.col("report_date") == hi), K.previous_report(r, F.lit(hi), "global"), METRICS)
    b = R.versus_previous(r.where(F.col("report_date") == lo), K.previous_report(r, F.lit(lo), "global"), METRICS)
    return out(a.unionByName(b))


@query(
    "report_date_in_zone",
    "R17, K20",
    "SELECT event_id, strftime(timezone('Europe/Kyiv', timezone('UTC', ts)), '%Y-%m-%d') AS report_date, strftime(ts, '%Y-%m-%d') AS stats_date FROM events",
)
def date_in_zone(spark, sf):
    ev = model(spark, sf).table("events")
    return ev.select("event_id", R.report_date(F.col("ts"), "Europe/Kyiv").alias("report_date"), S.utc_day(F.col("ts")).cast("string").alias("stats_date"))


def document(m):
    """The frozen document of the model's last day.

    Its sections read posts and tags in a dozen places: both are derived from
    the events once and stored, and so are the cut lists made of them.
    """
    m = m.staged("posts", "post_tags", "hashtags")
    runs, jobs, posts, snaps, tracked, start, end = ledger(m)
    # Every reader of the runs keeps those of the window only.
    runs = materialize(runs.where((F.col("planned_at") >= start) & (F.col("planned_at") < end)), "runs")
    cands, cats = materialize(candidates(m), "candidates"), post_cats(m)
    secs = materialize(R.sections(cands, m.now), "sections")
    viewed = m.events.where("event_type = 'view'").join(F.broadcast(secs.select("post_id").distinct()), "post_id", "left_semi")
    items = materialize(R.report_items(R.with_labels(secs, m.post_tags, cats), viewed.select("post_id"), m.now), "items")
    pool = R.pools(cands, m.now).where("window = 'TODAY'")
    clusters = topic_clusters(m)
    collection = R.collection_summary(runs, jobs, posts, snaps, tracked, "global", start, end)
    why = R.partial_reasons(R.platform_outcomes(runs, jobs, start, end), R.unfinished_runs(runs, start, end), P.budget_status(jobs, m.ledger_now))
    return R.assemble_report(
        now=m.now, zone="UTC", market="global", items=items, export=R.export_pool(items), tags=tag_rows(m),
        tier_tags=R.tier_event_tags(tier_events(m), m.tracked, "global", S.plus_hours(m.now, -96), m.now), clusters=clusters,
        samples=R.cluster_samples(clusters, items), counts=R.report_counts(cands, m.now), platforms=R.platform_distribution(pool),
        categories=R.category_distribution(pool, cats), collection=collection, reasons=why,
        comparison=R.versus_previous(
            R.report_counts(cands, m.now), K.previous_report(reports(m), R.report_date(m.now, "UTC"), "global"), METRICS[:2]
        ),
    )


@query(
    "daily_report_document",
    "R18",
    compose(
        """SELECT 1 AS schema_version, (SELECT count(*) FROM todaytop) AS today, (SELECT count(*) FROM stillhot) AS hot, (SELECT count(*) FROM risingnow) AS rising, (SELECT count(*) FROM export) AS exported,
 (SELECT string_agg(post_id, ',' ORDER BY rank) FROM todaytop) AS today_ids, (SELECT string_agg(tag, ',' ORDER BY rank) FROM tsec WHERE section = 'TOP') AS top_tags,
 (SELECT string_agg(tag, ',' ORDER BY tag) FROM ttags WHERE kind = 'NEW') AS newly_tracked, (SELECT count(*) FROM pool WHERE win = 'TODAY' AND platform = 'tiktok') AS tiktok_posts,
 (SELECT string_agg(rank, ',' ORDER BY cluster_rank, position) FROM csample) AS sample_ranks, (SELECT posts_scanned FROM summary) AS posts_scanned"""
    ),
)
def daily_report(spark, sf):
    d = document(model(spark, sf))

    def ids(c, f):
        return F.concat_ws(",", F.transform(c, lambda x: x[f].cast("string")))

    return out(
        d, "schema_version", F.size("items_today").alias("today"), F.size("items_still_hot").alias("hot"), F.size("items_rising_now").alias("rising"),
        F.size("export_candidates").alias("exported"), ids("items_today", "post_id").alias("today_ids"), ids("hashtags_top", "tag").alias("top_tags"),
        F.concat_ws(",", "newly_tracked").alias("newly_tracked"), F.col("by_platform")["tiktok"].alias("tiktok_posts"),
        F.concat_ws(",", F.flatten(F.transform("clusters", lambda c: F.transform(c["sample_ranks"], lambda x: x.cast("string"))))).alias("sample_ranks"),
        F.col("collection.posts_scanned").alias("posts_scanned"),
    )


_itemrow = "SELECT '{0}' AS kind, x.rank, CAST(x.post_id AS VARCHAR) AS name, rc.platform, rc.views AS amount, CAST(rc.trend_score0 AS BIGINT) AS score, t.hashtags AS labels FROM {1} x JOIN rc ON rc.post_id = x.post_id JOIN tagnames t ON t.post_id = x.post_id"
cte("tagnames", "SELECT post_id, string_agg(name, '|' ORDER BY position) AS hashtags FROM ptags GROUP BY 1")
cte(
    "docrows",
    " UNION ALL ".join(_itemrow.format(k, c) for k, c in (("TODAY", "todaytop"), ("STILL_HOT", "stillhot"), ("RISING_NOW", "risingnow"), ("EXPORT", "export")))
    + """ UNION ALL SELECT 'TAG_' || section, rank, tag, platform, CAST(seen_posts AS BIGINT), CAST(qualified_posts AS BIGINT), '' FROM tsec
UNION ALL SELECT 'CLUSTER', c.cluster_rank, c.label, NULL, NULL, NULL, coalesce(s.ranks, '') FROM (SELECT hashtag_id % 3 + 1 AS cluster_rank, min(name) AS label FROM tags WHERE hashtag_id > 100 GROUP BY 1) c
LEFT JOIN (SELECT cluster_rank, string_agg(rank, '|' ORDER BY position) AS ranks FROM csample GROUP BY 1) s USING (cluster_rank)""",
)


def document_rows(doc):
    """The sections of a frozen document, one row per entry."""
    none = F.lit(None)
    parts = []
    for kind, field in (("TODAY", "items_today"), ("STILL_HOT", "items_still_hot"), ("RISING_NOW", "items_rising_now"), ("EXPORT", "export_candidates")):
        x = doc.select(F.explode(field).alias("x"))
        parts.append(x.select(F.lit(kind).alias("kind"), "x.rank", F.col("x.post_id").cast("string").alias("name"), "x.platform", F.col("x.views").alias("amount"), F.col("x.trend_score").cast("bigint").alias("score"), F.concat_ws("|", "x.hashtags").alias("labels")))
    for kind, field in (("BREAKOUT", "hashtags_breakout"), ("RISING", "hashtags_rising"), ("TOP", "hashtags_top")):
        x = doc.select(F.explode(field).alias("x"))
        parts.append(x.select(F.lit(f"TAG_{kind}").alias("kind"), "x.rank", F.col("x.tag").alias("name"), "x.platform", F.col("x.seen_posts").cast("bigint").alias("amount"), F.col("x.qualified_posts").cast("bigint").alias("score"), F.concat_ws("|", "x.related_tags").alias("labels")))
    x = doc.select(F.explode("clusters").alias("x"))
    ranks = F.concat_ws("|", F.transform("x.sample_ranks", lambda r: r.cast("string")))
    parts.append(x.select(F.lit("CLUSTER").alias("kind"), F.col("x.cluster_rank").alias("rank"), F.col("x.label").alias("name"), none.cast("string").alias("platform"), none.cast("bigint").alias("amount"), none.cast("bigint").alias("score"), ranks.alias("labels")))
    return out(reduce(lambda a, b: a.unionByName(b), parts))


@query("daily_report_rows", "R18", compose("SELECT * FROM docrows"))
def daily_report_rows(spark, sf):
    return document_rows(materialize(document(model(spark, sf)), "document"))


@query("report_json_export", "E3", compose("SELECT * FROM docrows"))
def report_json(spark, sf):
    """The entries of the document as its JSON text gives them back."""
    doc = materialize(document(model(spark, sf)), "document")
    text = materialize(E.json_document(doc), "document-json")
    return document_rows(text.select(F.from_json("document", doc.schema).alias("d")).select("d.*"))


@query(
    "reports_to_freeze",
    "I13",
    compose("SELECT report_date, posts_scanned FROM reports WHERE CAST(substr(report_date, 9, 2) AS INT) % 3 <> 0"),
)
def to_freeze(spark, sf):
    r = reports(model(spark, sf))
    stored = r.withColumn("delivered_at", F.when(F.substring("report_date", 9, 2).cast("int") % 3 == 0, F.col("report_date").cast("timestamp")))
    return out(R.freeze_report(stored, r), "report_date", "posts_scanned")


def _live_sql(where: str, mode: str) -> str:
    if mode == "rising":
        return f"SELECT *, row_number() OVER (ORDER BY coalesce(rising_score0, 0) DESC, post_id) AS rank FROM (SELECT * FROM pool WHERE (now_us - pub_us) / 3600000000.0 <= 24 AND {where} ORDER BY {RISE} LIMIT 30)"
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {KEY}) AS rank FROM pool WHERE {where}) WHERE rank <= 30"


@query(
    "live_views",
    "R19, H25",
    compose(
        f"""SELECT 'trend' AS view, rank, post_id FROM ({_live_sql('true', 'trend')}) UNION ALL SELECT 'rising', rank, post_id FROM ({_live_sql('true', 'rising')})
UNION ALL SELECT 'gaming_tiktok', rank, post_id FROM ({_live_sql("platform = 'tiktok' AND post_id IN (SELECT post_id FROM postcat WHERE category IN ('gaming', 'pc', 'playstation'))", 'trend')})"""
    ),
)
def live_views(spark, sf):
    m = model(spark, sf)
    c, cats = candidates(m), post_cats(m)
    parts = {
        "trend": R.live_view(c, m.now), "rising": R.live_view(c, m.now, "rising"),
        "gaming_tiktok": R.live_view(c, m.now, "trend", "tiktok", "gaming", cats),
    }
    rows = [df.select(F.lit(n).alias("view"), "rank", "post_id") for n, df in parts.items()]
    return out(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query(
    "frozen_view_page",
    "R20",
    compose(f"SELECT rank, post_id, 2 AS page, greatest(1, CAST(ceil((SELECT count(*) FROM ({_live_sql('true', 'trend')})) / 5.0) AS BIGINT)) AS total_pages FROM ({_live_sql('true', 'trend')}) WHERE rank BETWEEN 6 AND 10"),
)
def frozen_page(spark, sf):
    m = model(spark, sf)
    view = R.freeze_view(R.live_view(candidates(m), m.now), "v1", "trend", m.now)
    old = view.withColumns({"view_id": F.lit("v0"), "expires_at": m.now})
    pages = view.unionByName(old)
    rows = R.view_page(pages, "v1", 2, m.now).unionByName(R.view_page(pages, "v0", 1, m.now))
    return out(rows, "rank", "post_id", "page", "total_pages")


@query(
    "theme_summary",
    "R21",
    compose(
        """SELECT 'cluster' AS kind, c.cluster_rank AS position, c.label, coalesce(s.detail, '') AS detail FROM (SELECT hashtag_id % 3 + 1 AS cluster_rank, min(name) AS label FROM tags WHERE hashtag_id > 100 GROUP BY 1) c
LEFT JOIN (SELECT cluster_rank, string_agg(rank, ',' ORDER BY position) AS detail FROM csample GROUP BY 1) s USING (cluster_rank)
UNION ALL SELECT 'tag', row_number() OVER (ORDER BY section, rank) AS position, tag, platform FROM tsec WHERE section <> 'TOP' QUALIFY position <= 8"""
    ),
)
def themes(spark, sf):
    m = model(spark, sf)
    c = topic_clusters(m)
    return out(R.theme_summary(c, R.cluster_samples(c, labelled(m)), tag_rows(m)))


@query(
    "candidate_csv_rows",
    "E1",
    compose(
        """SELECT 'rank,qualification,trend_state,platform,creator,published_at,age_hours,views,likes,comments,shares,vph,vph_kind,velocity_confidence,trend_score,rising_score,categories,hashtags,caption,canonical_url' AS line, 0 AS line_no
UNION ALL SELECT e.rank || ',' || tier || ',' || coalesce(prev_state, '') || ',' || platform || ',' || coalesce(creator_username, '') || ',' || strftime(make_timestamp(pub_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(pub_us // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z,' ||
 printf('%.2f', (now_us - pub_us) / 3600000000.0) || ',' || views || ',' || likes || ',' || comments || ',' || coalesce(CAST(shares AS VARCHAR), '') || ',' || printf('%.2f', vph) || ',OBSERVED,MEDIUM,' || trend_score0 || ',' || rising_score0 || ',' ||
 coalesce(k.categories, '') || ',' || t.hashtags || ',' || coalesce(caption, '') || ',' || canonical_url, e.rank
FROM export e JOIN (SELECT post_id, string_agg(name, '|' ORDER BY position) AS hashtags FROM ptags GROUP BY 1) t USING (post_id) LEFT JOIN (SELECT post_id, string_agg(category, '|' ORDER BY category) AS categories FROM postcat GROUP BY 1) k USING (post_id)"""
    ),
)
def candidate_csv(spark, sf):
    m = model(spark, sf)
    items = R.report_items(labelled(m), m.events.select("post_id").limit(0), m.now)
    return out(E.csv_lines(E.candidate_csv_rows(R.export_pool(items)), ["rank"]), "line", "line_no")


@query(
    "csv_quoting",
    "E2",
    compose("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents"""),
)
def csv_quoting(spark, sf):
    return model(spark, sf).table("documents").select("doc_id", E.csv_field(F.col("text")).alias("field"))
