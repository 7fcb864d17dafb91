"""Late rows, ending state and ledger-attributed ingest of the streams."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from crestline.config import DEFAULT
from crestline.plans.ingest_batch import ingest_jobs
from crestline.session import materialize
from crestline.sources.tables import Store
from crestline.streaming import state, windows
from crestline.streaming.ingest import ingest_stream

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
US = int(T0.timestamp() * 1_000_000)
HOUR = 3_600_000_000


def test_state_ends(spark, tmp_path):
    """Every day other posts are live: what the stream remembers does not grow with the days."""
    schema = "post_id long, published_us long, observed_us long, views long"
    sizes = []
    for day in range(6):
        rows = [(100 * day + i, US + day * 24 * HOUR, US + day * 24 * HOUR + h * HOUR, 10 * h) for i in range(30) for h in (1, 2, 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.velocity_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), late="1 hour", keep_hours=24)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(max(op["numRowsTotal"] for p in q.recentProgress[-1:] for op in p["stateOperators"]))
    assert sizes[-1] <= sizes[1] + 5 and sizes[-1] < 30 * 3 * 6
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("post_id").distinct().count() == 180 and out.agg(F.max("intervals")).first()[0] == 3


class _Values:
    """A processor's value as a plain attribute, to run its step without a stream."""


def steps(processor, rows, waiting=(), value=None):
    rows, waiting = (np.array(list(x), np.int64).reshape(-1, len(processor.COLUMNS)) for x in (rows, waiting))
    return processor.advance((1,), value, rows, waiting)


def test_dedup_step_equals_walk():
    """Chunks of any size give what one walk over all rows gives."""
    rng = random.Random(1)
    p = state.SnapshotDedup(DEFAULT)
    for _ in range(50):
        t, rows = US, []
        for _ in range(rng.choice([1, 5, 60])):
            t += rng.choice([0, 1, 60, 120, 299, 300, 301, 900]) * 1_000_000
            rows.append((t, rng.choice([1, 1, 1, 2]), *[state.NONE] * 4))
        rows = sorted(set(rows))
        want, last = [], None
        for r in rows:
            if last and r[0] - last[0] <= p.gap and r[1:] == last[1:]:
                continue
            want.append(r[0])
            last = r
        got, value, at = [], None, 0
        while at < len(rows):
            n = rng.randrange(1, 20)
            value, out = steps(p, rows[at : at + n], value=value)
            got += [] if out is None else out["observed_us"].tolist()
            at += n
        assert got == want


def test_held_state_step_equals_walk():
    rng = random.Random(2)
    p = state.HeldState(DEFAULT)
    names = list(p.NAMES)
    for _ in range(50):
        t, rows = US, []
        for _ in range(rng.choice([1, 5, 60])):
            t += rng.choice([1, 30, 90, 200]) * 60_000_000
            rows.append((t, rng.randrange(len(names))))
        want, cur = [], None
        for at, c in rows:
            if cur is None:
                cur = (c, at)
            elif c != cur[0] and (at - cur[1] >= p.hold or state.STATE_RANK[names[c]] >= state.STATE_RANK[names[cur[0]]]):
                cur = (c, at)
            want.append((names[cur[0]], cur[1]))
        got, value, at = [], None, 0
        while at < len(rows):
            n = rng.randrange(1, 20)
            value, out = steps(p, rows[at : at + n], value=value)
            got += list(zip(out["trend_state"], out["since_us"]))
            at += n
        assert got == want


def test_provisional_rate_is_retracted():
    """A point that waits counts at once; one that comes late before it changes the rate."""
    p = state.LiveVelocity(DEFAULT)
    _, first = steps(p, [(US + 1 * HOUR, 100, US)], [(US + 3 * HOUR, 500, US)])
    assert first.vph[0] == 200.0 and first.kind[0] == "OBSERVED"
    _, second = steps(p, [(US + 1 * HOUR, 100, US)], [(US + 2 * HOUR, 400, US), (US + 3 * HOUR, 500, US)])
    assert second.vph[0] == 100.0 and second.vph_previous[0] == 300.0
    value, none = steps(p, [(US + 60_000_000, 7, US)])
    assert none.intervals[0] == 0 and none.last_views[0] == 7 and value[0] == 0


def test_rolling_counts_equal_brute_force(spark):
    rng = random.Random(3)
    tiers = ["VIRAL_QUALIFIED", "EARLY_BREAKOUT", "WATCH", "NOISE", None]
    seen = {}
    for _ in range(400):
        seen[rng.randrange(40), rng.randrange(25)] = rng.choice(tiers)
    rows = [(T0 + timedelta(minutes=30 * pane), "tiktok", post % 2, post, tier, f"c{post // 4}") for (pane, post), tier in seen.items()]
    panes = spark.createDataFrame(rows, "pane_start timestamp, platform string, hashtag_id long, post_id long, tier string, creator string")
    got = {(r.window_end, r.hashtag_id): (r.posts_seen, r.qualified, r.watch, r.c24) for r in windows.rolling_counts(panes, span=6).collect()}
    want = {}
    for end in range(46):
        for tag in (0, 1):
            last = {}
            for (pane, post), tier in sorted(seen.items(), key=lambda x: x[0]):
                if post % 2 == tag and end - 6 < pane <= end:
                    last[post] = tier
            if last:
                good = [p for p, t in last.items() if t in ("VIRAL_QUALIFIED", "EARLY_BREAKOUT")]
                want[T0 + timedelta(minutes=30 * (end + 1)), tag] = (len(last), len(good), sum(t == "WATCH" for t in last.values()), len({p // 4 for p in good}))
    naive = {(k[0].replace(tzinfo=timezone.utc) if k[0].tzinfo is None else k[0], k[1]): v for k, v in got.items()}
    assert naive == want


def record(i, views):
    made = int((T0 - timedelta(hours=5)).timestamp())
    return json.dumps({"id": str(7_000_000 + i), "text": f"clip #t{i}", "createTime": made, "webVideoUrl": f"https://www.tiktok.com/@u/video/{7_000_000 + i}", "authorMeta": {"id": "1", "fans": 1}, "playCount": str(views)})


def test_jobs_are_attributed_and_settled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    tracked = "tracked_id long, hashtag_id long, platform string, market string, tier string, source string, trend_state string, scans_total int, probes_in_tier int, consecutive_empty_scans int, next_due_at timestamp"
    store.rewrite("tracked_hashtags", spark.createDataFrame([(i, 10 + i, "tiktok", "global", "CORE", "SEED", "NEW", 0, 0, 0, T0) for i in (1, 2, 3)], tracked))
    job = "job_id long, provider string, platform string, market string, job_type string, status string, submitted_at timestamp, queries array<struct<tracked_id:long,hashtag_id:long,query:string>>, requested array<string>"
    one = (1, "apify", "tiktok", "global", "HASHTAG_DISCOVERY", "SUBMITTED", T0, [(1, 11, "q1")], None)
    refresh = (2, "apify", "tiktok", "global", "POST_REFRESH", "SUBMITTED", T0, None, ["7000001", "7000009"])
    lost = (3, "apify", "tiktok", "global", "HASHTAG_DISCOVERY", "FAILED", T0, [(3, 13, "q3")], None)
    store.upsert("provider_jobs", spark.createDataFrame([one, lost], job))
    item = "provider string, platform string, provider_job_id long, payload string, observed_at timestamp, rank_in_results int"
    late = T0 + timedelta(hours=2)
    items = [("apify", "tiktok", 1, record(k, 100), T0, k) for k in range(3)] + [("apify", "tiktok", 1, "{broken", T0, 3)] + [("apify", "tiktok", 2, record(1, 900), late, 0)]
    ingest_jobs(materialize(spark.createDataFrame(items, item), "items"), store, ("s", 0))
    assert store.read("held_items").count() == 1 and store.read("posts").count() == 3
    store.upsert("provider_jobs", spark.createDataFrame([refresh], job))
    again = materialize(spark.createDataFrame([], item), "items")
    ingest_jobs(again, store, ("s", 0))  # the same batch: nothing happens
    assert store.read("held_items").count() == 1
    ingest_jobs(again, store, ("s", 1))
    assert store.read("held_items").count() == 0
    found = sorted((r.query_text, r.hashtag_id, r.rank_in_results) for r in store.read("post_discoveries").collect())
    assert found == [("q1", 11, k) for k in range(3)]
    posts = {r.external_id: (r.views, r.paid_refresh_count, r.next_refresh_at) for r in store.read("posts").collect()}
    assert posts["7000001"][:2] == (900, 1) and posts["7000001"][2] is not None and posts["7000000"] == (100, 0, None)
    assert sorted(r.source for r in store.read("post_snapshots").collect()) == ["DISCOVERY"] * 3 + ["REFRESH"]
    jobs = {r.job_id: (r.status, r.records_returned, r.records_quarantined) for r in store.read("provider_jobs").collect()}
    assert jobs == {1: ("INGESTED", 3, 1), 2: ("INGESTED", 1, 0), 3: ("FAILED", None, None)}
    tags = {r.tracked_id: r for r in store.read("tracked_hashtags").collect()}
    assert tags[1].scans_total == 1 and tags[1].last_scanned_at is not None and tags[2].scans_total == 0
    assert tags[3].next_due_at - tags[2].next_due_at == timedelta(hours=DEFAULT.failed_scan_hours)


def test_landed_files_merge_once_per_drain(spark, tmp_path):
    """Micro-batches only hold their records; the tables see one merge per call, and unknown jobs wait for a later one."""
    store, root = Store(spark, str(tmp_path / "s")), str(tmp_path / "landing")
    job = "job_id long, provider string, platform string, market string, job_type string, status string, submitted_at timestamp, queries array<struct<tracked_id:long,hashtag_id:long,query:string>>, requested array<string>"

    def ledger(*ids):
        store.upsert("provider_jobs", spark.createDataFrame([(j, "apify", "tiktok", "global", "HASHTAG_DISCOVERY", "SUBMITTED", T0, [(1, 11, f"q{j}")], None) for j in ids], job))

    ledger(0, 1, 2, 3)
    lines = [("apify", "tiktok", j, US // 1000, record(10 * j + k, 100)) for j in range(5) for k in range(2)]
    df = spark.createDataFrame(lines, "provider string, platform string, job long, at long, value string").repartition("job")
    df.write.partitionBy("provider", "platform", "job", "at").text(root)
    before = store.manifest()["version"]
    assert not ingest_stream(spark, root, store, str(tmp_path / "cp"), max_files=1).isActive
    tables = store.manifest()["tables"]
    assert store.manifest()["version"] == before + 6  # five files, one merge
    assert all(len({f.split("/")[0] for k in ("base", "delta") for f in tables[n][k]}) == 1 for n in ("posts", "post_snapshots", "post_folds", "hashtags"))
    assert store.read("posts").count() == 8 and store.read("held_items").count() == 2
    ledger(4)
    ingest_stream(spark, root, store, str(tmp_path / "cp"), max_files=1)
    assert store.read("posts").count() == 10 and store.read("held_items").count() == 0
    found = store.read("post_discoveries").orderBy("provider_job_id", "rank_in_results").collect()
    assert [(r.query_text, r.rank_in_results) for r in found] == [(f"q{j}", k) for j in range(5) for k in range(2)]
    done = store.manifest()["version"]
    ingest_stream(spark, root, store, str(tmp_path / "cp"), max_files=1)
    assert store.manifest()["version"] == done  # nothing new, no commit
