"""One commit for several tables, upserts merged on read, pruned lookups, sweeping."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crestline.plans.ingest_batch import write_batch
from crestline.session import materialize
from crestline.sources.tables import BUCKETS, Conflict, Store, Transaction

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
OBS = (
    "post_id long, platform string, external_id string, canonical_url string, content_type string, caption string, views long, likes long, comments long, shares long, "
    "saves long, observed_at timestamp, published_at timestamp, hashtags array<string>, provider_job_id long, rank_in_results int, views_metric string, source string, query_text string, query_hashtag_id long"
)


def observation(i, hour, views):
    return (i, "tiktok", str(i), f"u{hour}", "video", None, views, 1, 1, 1, 1, T0 + timedelta(hours=hour), T0, ["a", f"t{i % 3}"], hour, 0, None, "DISCOVERY", None, None)


def batch(spark, ids, hour, views=100):
    return materialize(spark.createDataFrame([observation(i, hour, views * hour) for i in ids], OBS), "test-batch")


def state(store):
    names = ("posts", "post_snapshots", "post_folds", "hashtags", "post_hashtags", "post_discoveries")
    return {n: sorted(map(repr, store.read(n).collect())) for n in names}


@pytest.fixture()
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    with s.transaction() as tx:
        write_batch(tx, batch(spark, range(40), 1))
    return s


def test_failure_between_any_two_writes(spark, store, monkeypatch):
    before, new = state(store), batch(spark, range(20, 60), 3)
    write, calls = Transaction._write, []

    for fails_at in range(1, 8):
        calls.clear()

        def torn(self, name, df, fails_at=fails_at):
            calls.append(name)
            if len(calls) == fails_at:
                raise OSError("lost")
            return write(self, name, df)

        monkeypatch.setattr(Transaction, "_write", torn)
        try:
            with store.transaction() as tx:
                write_batch(tx, new)
        except OSError:
            assert state(store) == before
            continue
        break
    assert fails_at == 7 and len(calls) == 6  # all six writes failed once, then the batch went through
    after = state(store)
    assert len(after["posts"]) == 60 and len(after["post_snapshots"]) == 80 and len(after["post_folds"]) == 60
    # The folders of the failed batches are known as garbage, and only they.
    gone = store.sweep(older_than_s=0)
    assert gone and state(store) == after and store.unreferenced() == []


def test_two_writers(spark, store):
    a, b = Transaction(store), Transaction(store)
    a.append("post_categories", spark.createDataFrame([(1, "pc", 0.5, "TAG")], "post_id long, category string, confidence double, source string"))
    b.append("post_categories", spark.createDataFrame([(2, "pc", 0.5, "TAG")], "post_id long, category string, confidence double, source string"))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert [r.post_id for r in store.read("post_categories").collect()] == [1]


def test_pinned_reader(spark, store):
    pinned = store.pin()
    with store.transaction() as tx:
        write_batch(tx, batch(spark, range(100, 105), 2))
    store.compact("posts")
    assert pinned.read("posts").count() == 40 and store.read("posts").count() == 45


def folders(store, name, kind):
    return store.manifest()["tables"][name][kind]


def test_upsert_writes_only_the_batch(spark, store):
    store.compact("posts")
    base = folders(store, "posts", "base")
    with store.transaction() as tx:
        write_batch(tx, batch(spark, [3, 7, 500], 5))
    assert folders(store, "posts", "base") == base
    written = spark.read.option("basePath", f"{store.root}/posts").parquet(*[f"{store.root}/posts/{f}" for f in folders(store, "posts", "delta")])
    assert sorted(r.post_id for r in written.collect()) == [3, 7, 500]
    merged = {r.post_id: (r.views, r.canonical_url, r.first_seen_at.hour, r.last_seen_at.hour) for r in store.read("posts").collect()}
    assert len(merged) == 41 and merged[3] == (500, "u5", 1, 5) and merged[4] == (100, "u1", 1, 1) and merged[500] == (500, "u5", 5, 5)
    rows = state(store)
    store.compact("posts")
    assert folders(store, "posts", "delta") == [] and state(store) == rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_read_streams_the_base(spark, store):
    store.compact("posts")
    with store.transaction() as tx:
        write_batch(tx, batch(spark, [3, 7], 5))
    text = plan(store.read("posts"))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "SortMergeJoin" not in text


def test_lookup_reads_touched_buckets(spark, store):
    store.compact("posts")
    keys = materialize(spark.createDataFrame([(3,), (3 + BUCKETS,)], "post_id long"), "test-keys")
    found = store.lookup("posts", keys)
    assert sorted(r.post_id for r in found.collect()) == [3, 3 + BUCKETS]
    text = plan(found)
    assert "bucket" in text.split("PartitionFilters:")[1].split("]")[0]
    assert f"GreaterThanOrEqual(post_id,3), LessThanOrEqual(post_id,{3 + BUCKETS})" in text.replace("\n", "")


def test_partitions_are_dropped_without_reading(spark, store):
    days = [(1, T0 + timedelta(days=d), 5) for d in range(4)]
    store.append("post_snapshots", spark.createDataFrame(days, "post_id long, observed_at timestamp, views long"))
    with store.transaction() as tx:
        gone = tx.drop_partitions("post_snapshots", lambda p: p["observed_date"] < str(date(2026, 9, 3)))
    assert gone and {r.observed_date for r in store.read("post_snapshots").select("observed_date").distinct().collect()} == {date(2026, 9, 3), date(2026, 9, 4)}


def test_put_if_absent(spark, store):
    row = spark.createDataFrame([(1, "pc", 0.5, "TAG")], "post_id long, category string, confidence double, source string")
    with store.transaction() as tx:
        assert tx.put_if_absent("post_categories", row, ["post_id"])
    with store.transaction() as tx:
        assert not tx.put_if_absent("post_categories", row.withColumn("category", F.lit("gaming")), ["post_id"])
    assert [r.category for r in store.read("post_categories").collect()] == ["pc"]


def test_folds_follow_batches(spark, store):
    """In order, late and repeated batches leave the folds that the whole history gives."""
    from crestline.operators.velocity import post_velocity, velocity_of_folds

    for hour in (4, 2, 9, 2):
        with store.transaction() as tx:
            write_batch(tx, batch(spark, range(hour, 40), hour))
    now = T0 + timedelta(hours=10)
    posts = store.read("posts")
    want = sorted(map(repr, post_velocity(posts, store.read("post_snapshots"), now).collect()))
    assert sorted(map(repr, velocity_of_folds(posts, store.read("post_folds"), now).collect())) == want
    newest = {r.post_id: r.newest.observed_at.hour for r in store.read("post_folds").collect()}
    assert newest[39] == 9 and newest[0] == 1
