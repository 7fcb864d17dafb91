"""Payload files through ingest, analytics and the report on stored tables."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crestline.plans.analytics import run_analytics
from crestline.plans.daily_report import build_report
from crestline.plans.ingest_batch import ingest_batch
from crestline.sources.raw import read_landing
from crestline.sources.tables import TABLES, Store
from crestline.sources.taxonomy import seed_tracking

NOW = datetime(2026, 9, 10, 7, tzinfo=timezone.utc)
RAW = "provider string, platform string, provider_job_id long, payload string, observed_at timestamp, source string"


def payload(i, views, age):
    made = int((NOW - timedelta(hours=age)).timestamp())
    return json.dumps(
        {
            "id": str(7_000_000 + i), "text": f"clip {i} #gaming #pcbuild #extra{i % 3}", "createTime": made, "webVideoUrl": f"https://www.tiktok.com/@u{i % 7}/video/{7_000_000 + i}",
            "authorMeta": {"id": str(i % 7), "fans": 10}, "playCount": str(views), "diggCount": views // 10, "commentCount": 50, "shareCount": 20,
            "hashtags": ["cosplay", {"name": "Newtag"}],
        }
    )


def batch(spark, hours_before, growth, job):
    seen = NOW - timedelta(hours=hours_before)
    rows = [("apify", "tiktok", job, payload(i, 20_000 * (i + 1) * growth, 6 + i % 5), seen, "DISCOVERY") for i in range(25)]
    rows += [("apify", "tiktok", job, "{broken", seen, "DISCOVERY"), ("brightdata", "instagram", job, "{}", seen, "DISCOVERY")]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest_batch(batch(spark, 4, 1, 1), s)
    ingest_batch(batch(spark, 2, 3, 2), s)
    seeds = seed_tracking(spark, spark.createDataFrame([], "name string, platform string, market string"), "global")
    tracked = seeds.join(s.read("hashtags").select("hashtag_id", "name"), "name").select(
        F.xxhash64("hashtag_id", "platform", "market").alias("tracked_id"), "hashtag_id", "platform", "market", "tier", "source",
        F.lit("NEW").alias("trend_state"), F.lit(0).alias("probes_in_tier"), F.lit(0).alias("scans_total"), F.lit(0).alias("consecutive_empty_scans"),
    )
    s.rewrite("tracked_hashtags", tracked)
    return s


def counts(store):
    return {n: store.read(n).count() for n in TABLES}


def test_ingest_is_replay_safe(spark, store):
    before = counts(store)
    assert before["posts"] == 25 and before["post_snapshots"] == 50 and before["post_discoveries"] == 50
    assert before["quarantined_items"] == 4
    ingest_batch(batch(spark, 2, 3, 2), store)
    assert counts(store) == before
    p = store.read("posts").where("external_id = '7000000'").first()
    assert p.views == 60_000 and p.first_seen_at.hour == 3 and p.last_seen_at.hour == 5


def test_analytics_then_report(spark, store):
    run_analytics(store, NOW)
    posts = store.read("posts").collect()
    assert all(p.trend_score is not None and p.vph_kind == "OBSERVED" for p in posts)
    assert {p.tier for p in posts} >= {"VIRAL_QUALIFIED"}
    assert len(posts[0].score_components) == 12
    events = store.read("hashtag_tier_events").collect()
    assert {e.reason for e in events} >= {"candidate_generation"}
    state = {n: sorted(map(repr, store.read(n).collect())) for n in TABLES}
    run_analytics(store, NOW)
    for n in TABLES:
        assert sorted(map(repr, store.read(n).collect())) == state[n], n

    runs = spark.createDataFrame([(1, "PARTIAL", NOW - timedelta(hours=3)), (2, "RUNNING", NOW - timedelta(hours=1))], "run_id long, status string, planned_at timestamp")
    jobs = spark.createDataFrame(
        [(1, 1, "apify", "tiktok", "INGESTED", NOW - timedelta(hours=3), 25), (2, 2, "apify", "tiktok", "FAILED", NOW - timedelta(hours=1), None)],
        "job_id long, run_id long, provider string, platform string, status string, submitted_at timestamp, records_returned long",
    ).withColumn("cost_est_usd", F.lit("0.0575").cast("decimal(12,6)"))
    doc = build_report(store, runs, jobs, None, NOW)
    r = doc.first()
    assert r.status == "PARTIAL" and r.partial_reasons == ["tiktok:discovery_partial", "collection:unfinished_jobs"]
    assert all(len(i.score_components.trend) == len(i.score_components.rising) == 6 for i in r.items_today)
    assert all(isinstance(t.related_tags, list) for t in r.hashtags_top)
    assert 0 < len(r.items_today) <= 14 and [i["rank"] for i in r.items_today] == list(range(1, len(r.items_today) + 1))
    assert r.collection.unique_posts == 25 and r.clusters and r.clusters[0].sample_ranks
    assert all(x.previous is None and x.delta is None for x in r.vs_yesterday)
    nxt = build_report(store, runs, jobs, doc, NOW + timedelta(days=1)).first()
    assert all(x.previous is not None for x in nxt.vs_yesterday)
    assert all(i.in_yesterday_report for i in nxt.items_still_hot if i.post_id in {j.post_id for j in r.items_today})


def test_upkeep(spark, store):
    """Frozen once delivered, views once, and a dry run of the sweep counts what the sweep removes."""
    from crestline.operators.report import live_view
    from crestline.plans.upkeep import freeze, keep_view, sweep_store, table_sizes

    runs = spark.createDataFrame([(1, "COMPLETED", NOW - timedelta(hours=3))], "run_id long, status string, planned_at timestamp")
    jobs = spark.createDataFrame(
        [(1, 1, "apify", "tiktok", "INGESTED", NOW - timedelta(hours=3), 25)], "job_id long, run_id long, provider string, platform string, status string, submitted_at timestamp, records_returned long"
    ).withColumn("cost_est_usd", F.lit("0.0575").cast("decimal(12,6)"))
    doc = build_report(store, runs, jobs, None, NOW)
    assert freeze(store, doc) and freeze(store, doc, delivered_at=NOW) and not freeze(store, doc)
    assert store.read("daily_reports").count() == 1 and json.loads(store.read("daily_reports").first().document)["market"] == "global"
    view = live_view(store.read("posts"), NOW)
    assert keep_view(store, view, "v", "trend", NOW) and not keep_view(store, view, "v", "trend", NOW)

    late = NOW + timedelta(days=40)
    before = {r.table_name: r.n_rows for r in table_sizes(store).collect()}
    dry = {r.table_name: r.expired for r in sweep_store(store, late, dry_run=True).collect()}
    assert {r.table_name: r.n_rows for r in table_sizes(store).collect()} == before
    assert dry["result_views"] == before["result_views"] and dry["post_discoveries"] == before["post_discoveries"] and dry["quarantined_items"] == before["quarantined_items"]
    done = {r.table_name: r.expired for r in sweep_store(store, late).collect()}
    after = {r.table_name: r.n_rows for r in table_sizes(store).collect()}
    assert done == dry and all(after[n] == before[n] - dry.get(n, 0) for n in before if n != "post_folds")
    assert after["post_folds"] == after["posts"] and sweep_store(store, late).count() == 0


def test_landing_pages_are_concatenated(spark, tmp_path):
    folder = tmp_path / "provider=apify" / "platform=tiktok" / "job=7"
    folder.mkdir(parents=True)
    (folder / "page-0.json").write_text(payload(1, 5, 1) + "\n" + payload(2, 5, 1) + "\n\n")
    (folder / "page-1.json").write_text(payload(3, 5, 1) + "\n")
    rows = read_landing(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.provider_job_id for r in rows} == {7} and rows[0].provider == "apify"
