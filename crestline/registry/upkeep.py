"""Queries over source quality, retention and the history export."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.functions import scalars as S
from crestline.operators import quality as Q
from crestline.operators import retention as X
from crestline.operators.planning import tag_history
from crestline.registry.base import big, compose, cte, out, query, r6
from crestline.registry.ingest import raw_b1, raw_p1
from crestline.registry.model import model
from crestline.sources import exports as E


def t1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


_pct = ", ".join(f"{t1(f'count(*) FILTER (WHERE age < {h}) / count(age) * 100')} AS pct_lt_{h}h" for h in (6, 12, 24, 48, 72))
cte("ages", "SELECT event_type, CASE WHEN (now_us - 604800000000 * 2 - epoch_us(ts)) >= 0 THEN (now_us - 604800000000 * 2 - epoch_us(ts)) / 3600000000.0 END AS age FROM events, nowc")


@query(
    "source_freshness",
    "Q1",
    compose(
        f"""SELECT event_type, count(*) AS sample_size, count(age) AS with_timestamp, {", ".join(f"{t1(f'quantile_cont(age, {p / 100})')} AS p{p}_age_hours" for p in (25, 50, 75, 90))},
 {t1('min(age)')} AS min_age_hours, {t1('max(age)')} AS max_age_hours, {_pct} FROM ages GROUP BY 1"""
    ),
)
def freshness(spark, sf):
    """Now lies two weeks back, so half the records are dated in the future."""
    m = model(spark, sf)
    return out(Q.freshness_profile(m.table("events"), ["event_type"], "ts", S.plus_hours(m.now, -336)))


PATHS = ["text", "lang", "info.source", "info.words", "info.first", "n_chars"]


def documents(m):
    d = m.table("documents")
    words = F.filter(F.split("text", " "), lambda w: w.startswith("#"))
    first = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text"))
    return d.select("doc_id", "text", "lang", F.col("n_chars"), F.struct("source", words.alias("words"), first.alias("first")).alias("info"))


@query(
    "field_coverage",
    "Q2",
    """SELECT field, present, total, floor(present * 1000.0 / total + 0.5) / 10 AS pct FROM (SELECT unnest(['text', 'lang', 'info.source', 'info.words', 'info.first', 'n_chars']) AS field,
 unnest([count(*) FILTER (WHERE regexp_matches(text, '\\S')), count(lang), count(*) FILTER (WHERE trim(source) <> ''), count(*) FILTER (WHERE len(list_filter(string_split(text, ' '), lambda w: starts_with(w, '#'))) > 0),
 count(*) FILTER (WHERE doc_id % 3 <> 0 AND regexp_matches(text, '\\S')), count(n_chars)]) AS present, count(*) AS total FROM documents)""",
)
def coverage(spark, sf):
    return Q.field_coverage(documents(model(spark, sf)), PATHS)


@query(
    "query_relevance",
    "Q3",
    """SELECT source, count(*) AS total, count(*) FILTER (WHERE hit) AS matched, floor(count(*) FILTER (WHERE hit) * 1000.0 / count(*) + 0.5) / 10 AS pct FROM (
 SELECT source, contains(lower(text), 'ation') OR contains(lower(text), 'und') OR contains(lower(text), 'fr') OR lower(lang) IN ('ation', 'und', 'fr') AS hit FROM documents) GROUP BY 1""",
)
def relevance(spark, sf):
    d = model(spark, sf).table("documents")
    return Q.relevance(d, F.col("text"), F.array(F.concat(F.lit("#"), F.upper("lang"))), ["#ation", "UND", "fr", ""], ["source"])


def candidate_fields(m):
    d = m.table("documents")
    k = F.col("doc_id") % 5
    return d.select(
        "doc_id", "source", F.struct(F.when(k < 2, F.col("lang")).otherwise("").alias("a"), F.when(k == 3, "x").alias("b")).alias("alt"),
        F.when(k >= 4, F.col("n_chars")).alias("plain"),
    )


@query(
    "first_present_field",
    "Q4",
    "SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'alt.a' WHEN doc_id % 5 = 3 THEN 'alt.b' WHEN doc_id % 5 = 4 THEN 'plain' END AS field, CASE WHEN doc_id % 5 < 2 THEN lang WHEN doc_id % 5 = 3 THEN 'x' WHEN doc_id % 5 = 4 THEN CAST(n_chars AS VARCHAR) END AS value FROM documents",
)
def first_field(spark, sf):
    d = candidate_fields(model(spark, sf))
    field, value = Q.first_present(d, ["alt.a", "alt.b", "plain"])
    return d.select("doc_id", field.alias("field"), value.alias("value"))


@query(
    "field_consistency",
    "Q4",
    """SELECT source, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)), ','), '') AS fields, CASE WHEN count(DISTINCT f) = 0 THEN 'ABSENT' WHEN count(DISTINCT f) = 1 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM (
 SELECT source, CASE WHEN doc_id % 5 < 2 THEN 'alt.a' WHEN doc_id % 5 = 3 THEN 'alt.b' WHEN doc_id % 5 = 4 THEN 'plain' END AS f FROM documents) GROUP BY 1""",
)
def consistency(spark, sf):
    return Q.field_consistency(candidate_fields(model(spark, sf)), ["alt.a", "alt.b", "plain"], ["source"])


@query(
    "record_edge_cases",
    "Q5",
    """SELECT lang, count(*) AS records, count(*) - count(DISTINCT md5(text)) AS duplicate_ids, count(*) FILTER (WHERE doc_id % 7 = 0) AS negative_counts, count(*) FILTER (WHERE doc_id % 6 = 0) AS numeric_texts,
 count(*) FILTER (WHERE doc_id % 4 = 0) AS missing_views, count(*) FILTER (WHERE NOT contains(text, '#')) AS untagged FROM documents GROUP BY 1""",
)
def edges(spark, sf):
    d, i = model(spark, sf).table("documents"), F.col("doc_id")
    return Q.edge_cases(
        d, F.md5("text"), [F.when(i % 7 == 0, -1).otherwise(i), i], [F.when(i % 6 == 0, i.cast("string")).otherwise("n/a")],
        F.when(i % 4 != 0, i), F.when(F.col("text").contains("#"), F.array(F.lit("t"))), ["lang"],
    )


@query(
    "attribution_verdict",
    "Q6",
    """SELECT source, count(*) AS records, count(*) FILTER (WHERE source = 'web' OR source = 'books' AND doc_id % 2 = 0) AS explicit, count(*) FILTER (WHERE lang = 'de') AS inferable,
 CASE WHEN count(*) FILTER (WHERE source = 'web' OR source = 'books' AND doc_id % 2 = 0) = count(*) THEN 'SUPPORTED' WHEN count(*) FILTER (WHERE source = 'web' OR source = 'books' AND doc_id % 2 = 0) > 0 OR count(*) FILTER (WHERE lang = 'de') > 0 THEN 'AMBIGUOUS' ELSE 'NOT_SUPPORTED' END AS verdict
FROM documents GROUP BY 1""",
)
def attribution(spark, sf):
    d = model(spark, sf).table("documents")
    q = F.when((F.col("source") == "web") | ((F.col("source") == "books") & (F.col("doc_id") % 2 == 0)), "q")
    rec = d.select("source", "lang", F.struct(F.struct(q.alias("search_keyword")).alias("discovery_input")).alias("input"))
    return Q.attribution(rec, ["input.discovery_input.search_keyword"], F.array(F.concat(F.lit("#"), F.upper("lang"))), ["#DE"], ["source"])


@query(
    "canonical_hosts",
    "Q7",
    "SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS pages, false AS canonical FROM pages GROUP BY 1",
)
def hosts(spark, sf):
    host, own = Q.canonical_host(F.col("url"), "tiktok.com")
    return model(spark, sf).table("pages").groupBy(host.alias("host"), own.alias("canonical")).agg(F.count(F.lit(1)).alias("pages"))


cte(
    "srcprof",
    """SELECT platform, provider, count(*) AS n, floor(count(*) FILTER (WHERE age < 24) * 1000.0 / count(*) + 0.5) / 10 AS pct FROM (
 SELECT CASE WHEN user_id % 2 = 0 THEN 'tiktok' ELSE 'instagram' END AS platform, CASE WHEN k % 2 = 0 THEN 'apify' ELSE 'brightdata' END AS provider, (now_us - us) / 3600000000.0 / (1 + k % 2 * 9 + user_id % 2 * 20) AS age FROM ev) GROUP BY 1, 2""",
)


@query(
    "source_recommendation",
    "Q8",
    compose(
        """SELECT platform, CASE WHEN r1 = 'POOR' THEN 'neither' ELSE p1 END AS primary_discovery, CASE WHEN r1 = 'POOR' THEN 'INCONCLUSIVE' WHEN r2 <> 'POOR' THEN p2 ELSE 'neither' END AS fallback,
 'apify' AS refresh, CASE WHEN r1 = 'POOR' THEN 'FAILED' ELSE 'PASSED' END AS gate, CASE r1 WHEN 'POOR' THEN 'NO' WHEN 'GOOD' THEN 'YES' ELSE 'PARTIALLY' END AS product_fit FROM (
 SELECT platform, max(provider) FILTER (WHERE rn = 1) AS p1, max(rating) FILTER (WHERE rn = 1) AS r1, max(provider) FILTER (WHERE rn = 2) AS p2, max(rating) FILTER (WHERE rn = 2) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY CASE rating WHEN 'GOOD' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END DESC, provider) AS rn FROM (SELECT *, CASE WHEN pct >= 40 THEN 'GOOD' WHEN pct >= 15 THEN 'PARTIAL' ELSE 'POOR' END AS rating FROM srcprof)) GROUP BY 1)"""
    ),
)
def recommendation(spark, sf):
    m = model(spark, sf)
    k, u = F.col("k"), F.col("user_id")
    provider = F.when(k % 2 == 0, "apify").otherwise("brightdata")
    stretch = F.lit(1) + k % 2 * 9 + u % 2 * 20
    age_us = ((F.unix_micros(m.now) - F.unix_micros("ts")) / stretch).cast("bigint")
    rows = m.events.select("platform", provider.alias("provider"), F.timestamp_micros(F.unix_micros(m.now) - age_us).alias("at"))
    prof = Q.freshness_profile(rows, ["platform", "provider"], "at", m.now)
    prof = prof.select("platform", "provider", F.lit("TESTED").alias("outcome"), "pct_lt_24h", "with_timestamp", (F.col("provider") == "apify").alias("refresh_supported"))
    return Q.recommendations(prof)


# --- retention --------------------------------------------------------------------

GONE = "coalesce(pub_us, first_us) < cut - 86400000000 * CASE tier WHEN 'NOISE' THEN 14 WHEN 'WATCH' THEN 30 ELSE 180 END"
cte("rpost", "SELECT *, now_us + 86400000000 * 10 AS cut FROM posts")


def later(m):
    """Ten days on, when the oldest posts have outlived their tier."""
    return S.plus_hours(m.now, 240)


@query("post_retention", "X1", compose(f"SELECT post_id, tier, {GONE} AS expired FROM rpost"))
def post_retention(spark, sf):
    m = model(spark, sf)
    return m.posts.select("post_id", "tier", X.post_expired(later(m)).alias("expired"))


cte(
    "tabs",
    f"""SELECT 'posts' AS table_name, count(*) FILTER (WHERE {GONE}) AS expired FROM rpost
UNION ALL SELECT 'post_snapshots', count(*) FILTER (WHERE us < now_us + 86400000000 * (80 - 90)) FROM obs
UNION ALL SELECT 'post_discoveries', count(*) FILTER (WHERE us < now_us + 86400000000 * (20 - 30)) FROM obs
UNION ALL SELECT 'hashtag_daily_stats', count(*) FILTER (WHERE date < CAST(now AS DATE) + 350 - 365) FROM rollup, nowc
UNION ALL SELECT 'collection_runs', count(*) FILTER (WHERE planned_us < lnow_us - 86400000000 * 90) FROM runs
UNION ALL SELECT 'provider_jobs', count(*) FROM jobs WHERE run_id IN (SELECT run_id FROM runs WHERE planned_us < lnow_us - 86400000000 * 90)""",
)


@query("retention_counts", "X2, X4", compose("SELECT * FROM tabs"))
def retention_counts(spark, sf):
    m = model(spark, sf)
    snaps = m.observations.select("post_id", "observed_at")
    parts = [
        X.sweep_counts({"posts": m.posts}, later(m)), X.sweep_counts({"post_snapshots": snaps}, S.plus_hours(m.now, 24 * 80)),
        X.sweep_counts({"post_discoveries": snaps}, S.plus_hours(m.now, 24 * 20)),
        X.sweep_counts({"hashtag_daily_stats": m.daily}, S.plus_hours(m.now, 24 * 350)),
        X.sweep_counts({"collection_runs": m.runs, "provider_jobs": m.jobs}, m.ledger_now),
    ]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query(
    "retention_cascade",
    "X3",
    compose(
        f"""SELECT 'posts' AS table_name, count(*) AS kept, 0 AS detached FROM rpost WHERE NOT ({GONE})
UNION ALL SELECT 'post_snapshots', count(*), 0 FROM obs WHERE post_id NOT IN (SELECT post_id FROM rpost WHERE {GONE}) UNION ALL SELECT 'post_hashtags', count(*), 0 FROM ptags WHERE post_id NOT IN (SELECT post_id FROM rpost WHERE {GONE})
UNION ALL SELECT 'provider_jobs', count(*), 0 FROM jobs WHERE run_id NOT IN (SELECT run_id FROM runs WHERE planned_us < lnow_us - 86400000000 * 90)
UNION ALL SELECT 'job_refs', count(*), count(*) FILTER (WHERE l_orderkey IN (SELECT job_id FROM jobs WHERE run_id IN (SELECT run_id FROM runs WHERE planned_us < lnow_us - 86400000000 * 90))) FROM lineitem"""
    ),
)
def cascade(spark, sf):
    m = model(spark, sf)
    kept = X.sweep({"posts": m.posts, "post_snapshots": m.observations.select("post_id", "observed_at"), "post_hashtags": m.post_tags}, later(m))
    ledger = X.sweep({"collection_runs": m.runs, "provider_jobs": m.jobs}, m.ledger_now)
    refs = m.table("lineitem").select("l_linenumber", F.col("l_orderkey").alias("provider_job_id"))
    old = m.runs.where(X.row_expired("collection_runs", m.ledger_now)).select("run_id")
    dead = m.jobs.join(old, "run_id", "left_semi")
    left = X.detach(refs, dead, F.lit(True), "job_id", "provider_job_id")
    zero = F.lit(0).cast("bigint").alias("detached")
    rows = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("table_name"), "kept", zero) for n, df in {**kept, "provider_jobs": ledger["provider_jobs"]}.items()]
    rows.append(left.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("provider_job_id").isNull()).alias("detached")).select(F.lit("job_refs").alias("table_name"), "kept", "detached"))
    res = rows[0]
    for r in rows[1:]:
        res = res.unionByName(r)
    return res


@query(
    "history_csv_rows",
    "E4",
    compose(
        """SELECT CAST(d.date AS VARCHAR) || ',' || d.platform || ',global,' || t.name || ',' || d.trend_state || ',' || printf('%.5f', floor(d.momentum * 100000 + 0.5) / 100000) || ',' || posts_seen || ',' || (viral_posts + breakout_posts) || ',' || breakout_posts || ',' || distinct_creators || ',' ||
 coalesce(printf('%.2f', median_vph), '') || ',' || scans AS line FROM daily d JOIN tags t USING (hashtag_id), nowc WHERE d.date >= CAST(now AS DATE) - 7"""
    ),
)
def history_csv(spark, sf):
    m = model(spark, sf)
    h = tag_history(m.daily, m.hashtags, "global", F.date_sub(S.utc_day(m.now), 7))
    h = h.withColumn("radar_momentum", F.col("radar_momentum").cast("decimal(6,5)"))
    rows = E.history_csv_rows(h)
    return rows.select(F.concat_ws(",", *[E.csv_field(F.col(c)) for c in rows.columns]).alias("line"))
