"""Cases of review findings that the small given tables do not hold."""

import json
import os
import re
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from crestline.operators import ingest as merge
from crestline.operators.normalize import normalize
from crestline.plans import ingest_batch as plan
from crestline.registry import QUERIES, SQL, ingest, streams
from crestline.registry.model import model
from crestline.sources import tables
from crestline.sources.raw import land_bundles, stream_bundles
from crestline.streaming import state
from crestline.streaming.ingest import ingest_stream
from tools.compare import compare

SF = "/root/testdata/sf0.001"


def given(spark, folder, **tables):
    """A folder of tables and a DuckDB connection over them; those not named are the given ones."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(SF)):
        if name[:-8] not in tables:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


def test_hidden_counts_of_zero_values(spark, tmp_path):
    at = datetime(2024, 1, 5, 12)
    rows = [(i, at, 10 + i, "view", v, '{"k": 1}') for i, v in enumerate([0.0, -0.0, -3.5, 49.99, 50.0, 560.21])]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    folder, con = given(spark, tmp_path, events=spark.createDataFrame(rows, schema))
    name = "parsed_numbers_and_dates"
    status, note, _ = compare(spark, con, name, QUERIES[name], SQL[name], folder)
    assert status == "ok", note


class _Kept:
    """Handle and value state of a processor, counting what is written."""

    def __init__(self):
        self.body, self.writes, self.timers = None, 0, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.body is not None

    def get(self):
        return self.body

    def update(self, body):
        self.body, self.writes = body, self.writes + 1

    def clear(self):
        self.body = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def __call__(self, mark):
        self.mark = mark
        return self

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_keys_of_a_bucket_share_one_state():
    """3000 posts cost one write of state per call, keep their own rates, and are cleared when silent."""
    hour = 3_600_000_000
    kept, p = _Kept(), state.LiveVelocity(keep_hours=24)
    p.init(kept)
    posts = np.arange(3000)
    day = [pd.DataFrame({"post_id": posts, "published_us": hour, "observed_us": h * hour, "views": posts * h}) for h in (2, 3)]
    (first,) = p.handleInputRows((0,), iter(day), kept(hour // 1000))
    assert kept.writes == 1 and len(first) == 3000 and kept.timers == {2 * hour // 1000}
    assert first["vph"].tolist() == posts.tolist() and first["post_id"].tolist() == posts.tolist()
    (second,) = p.handleExpiredTimer((0,), kept(3 * hour // 1000), None)
    assert second["vph"].tolist() == posts.tolist() and kept.timers == {27 * hour // 1000}
    assert list(p.handleExpiredTimer((0,), kept(27 * hour // 1000), None)) == []
    assert kept.body is None and not kept.timers


def test_order_items_cross_the_network_as_rows(spark, tmp_path):
    """Words unfold only inside an order; items of equal number are placed by slot and name, as the SQL does."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_linenumber", F.col("l_linenumber") % 2)
    folder, con = given(spark, tmp_path, lineitem=items)
    assert "Generate" not in model(spark, folder).order_lists._jdf.queryExecution().optimizedPlan().toString()
    for name in ("merged_tag_edges", "tag_totals"):
        status, note, _ = compare(spark, con, name, QUERIES[name], SQL[name], folder)
        assert status == "ok", note


def test_every_payload_source_is_spread(spark):
    """A table of one row group is one scan task: parsing does not stay in it."""
    m = model(spark, SF)
    for raw in (ingest.raw_p1, ingest.raw_p2, ingest.raw_b1):
        assert "RepartitionByExpression" in raw(m)._jdf.queryExecution().optimizedPlan().toString()


def test_per_post_sides_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """Keys beyond the bound, and stored rows per post, join by shuffle even where their size would let Spark broadcast them."""
    monkeypatch.setattr(tables, "DELTA_KEYS", 10)
    store = tables.Store(spark, f"{tmp_path}/store")
    ids = spark.range(60).select(F.col("id").alias("post_id"))
    store.upsert("post_folds", ids)
    found = store.lookup("post_folds", ids.where("post_id % 2 = 0"))
    links = ids.select("post_id", F.lit(1).alias("hashtag_id"))
    tags = links.select("*", F.lit(0).alias("position"), F.current_timestamp().alias("observed_at"))
    new = merge.new_post_tags(links.where("post_id < 20"), tags)
    for df, n in ((found, 30), (new, 40)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n


def test_payload_fields_are_read_once(spark):
    """No search by path per use, all row steps compiled, and a count of tasks that the adaptive shuffle keeps."""
    m = model(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # such plans show what is compiled before they run
    try:
        for raw in (ingest.raw_p1, ingest.raw_p2, ingest.raw_b1):
            plan = normalize(raw(m))._jdf.queryExecution().executedPlan().toString()
            steps = [line for line in plan.splitlines() if "Generate inline" in line]
            assert steps and all("*(" in line.split("Generate")[0] for line in steps)
            assert set(re.findall(r"\$\.\w+", plan)) <= {"$.k", "$.name"}
            assert "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_odd_payloads_keep_their_verdicts_and_values(spark):
    good = {"id": 7000001, "webVideoUrl": "https://www.tiktok.com/@h.x/video/7000001?q=1"}
    cases = [
        (good, None), ({**good, "playCount": 9007199254740993}, None), ({**good, "playCount": -1, "createTime": -5}, None),
        ({**good, "playCount": 5.9, "createTime": " 1700000000\n"}, None), ({**good, "ID": 5, "authorMeta": {"name": "n", "x": []}}, None),
        ({**good, "hashtags": ["#A", {"name": " B "}]}, None), ({**good, "hashtags": [{"name": None}]}, "INVALID"), ({**good, "hashtags": [None]}, "INVALID"),
        ({**good, "hashtags": {}}, "INVALID"), ({**good, "authorMeta": None}, "INVALID"), ({**good, "authorMeta": []}, "INVALID"),
        ({**good, "authorMeta": {"fans": "5"}}, "INVALID"), ({**good, "isSlideshow": "x"}, "INVALID"), ([good], "INVALID"), (None, "INVALID"),
        ({"webVideoUrl": good["webVideoUrl"]}, "MISSING_ID"), ({"id": "7000001"}, "INVALID_URL"),
    ]
    rows = [("apify", "tiktok", i, json.dumps(c)) for i, (c, _) in enumerate(cases)]
    got = normalize(spark.createDataFrame(rows, "provider string, platform string, n int, payload string")).withColumn("at", F.unix_seconds("published_at")).orderBy("n").collect()
    assert [r.reject_kind for r in got] == [k for _, k in cases]
    assert [r.metrics.views for r in got[:4]] == [None, 9007199254740993, None, 5]
    assert [r["at"] for r in got[2:4]] == [-5, 1700000000] and got[4].creator.username == "h.x" and got[5].hashtags == ["a", "b"]
    assert got[0].external_id == "7000001" and got[0].canonical_url == "https://www.tiktok.com/@h.x/video/7000001"


def _landed(spark, n):
    """``n`` records of each of 60 jobs, in one partition; every job asks one query."""
    good = {"id": 7000001, "webVideoUrl": "https://www.tiktok.com/@h.x/video/7000001"}
    rows = [("apify", "tiktok", j, 1_700_000_000_000 + j, i, json.dumps({**good, "id": 7_000_000 + n * j + i, "playCount": i})) for j in range(60) for i in range(n)]
    rows.append(("apify", "tiktok", 0, 1_700_000_000_000, n, None))
    jobs = [(j, "apify", "tiktok", "global", "HASHTAG_DISCOVERY", "SUBMITTED", [(1, 11, f"q{j}")]) for j in range(60)]
    job = "job_id long, provider string, platform string, market string, job_type string, status string, queries array<struct<tracked_id:long,hashtag_id:long,query:string>>"
    df = spark.createDataFrame(rows, "provider string, platform string, job long, at long, rank_in_results int, payload string").coalesce(1)
    return df, spark.createDataFrame(jobs, job)


def test_files_of_a_landing_do_not_grow_with_jobs(spark, tmp_path):
    """Bundles hold the records of many jobs, and each keeps its job, place and time."""
    rows, jobs = _landed(spark, 3)
    land_bundles(rows, f"{tmp_path}/landing")
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(f"{tmp_path}/landing") for f in files) == 1
    store = tables.Store(spark, f"{tmp_path}/store")
    store.upsert("provider_jobs", jobs)
    ingest_stream(spark, f"{tmp_path}/landing", store, f"{tmp_path}/cp", max_files=1, read=stream_bundles)
    found = store.read("post_discoveries").orderBy("provider_job_id", "rank_in_results").collect()
    assert [(r.query_text, r.rank_in_results) for r in found] == [(f"q{j}", i) for j in range(60) for i in range(3)]
    seen = store.read("posts").select("external_id", "views", F.unix_millis("last_seen_at").alias("at")).collect()
    assert {tuple(r) for r in seen} == {(str(7_000_000 + 3 * j + i), i, 1_700_000_000_000 + j) for j in range(60) for i in range(3)}


def test_stream_ingest_lands_few_files(spark, tmp_path, monkeypatch):
    """Five jobs in two landings: no file per job."""
    monkeypatch.setattr(streams, "shared_dir", lambda _: str(tmp_path))
    assert QUERIES["stream_ingest"](spark, SF).count()
    assert sum(f.startswith("part-") for d, _, files in os.walk(tmp_path) if "/landing/" in d for f in files) == 2


def test_held_records_are_parsed_in_many_tasks(spark, tmp_path):
    """A file of many records is small and would be one task; payloads are stored for rejects only."""
    rows, jobs = _landed(spark, 20)
    raw = rows.where("payload is not null").withColumnRenamed("job", "provider_job_id")
    raw = raw.unionByName(raw.limit(1).withColumn("payload", F.lit("{broken"))).coalesce(1)
    done = plan._normalized(raw.withColumn("observed_at", F.timestamp_millis("at")))
    assert len({f for f, in done.where("reject_kind is null").select(F.input_file_name()).distinct().collect()}) > 8
    assert [r.payload for r in done.where("payload is not null").collect()] == ["{broken"] and done.count() == 1201


def test_newest_rows_are_found_by_the_named_columns(spark, tmp_path):
    """A wide table does not cross the network whole for a few columns; a written batch reads back without a copy."""
    store = tables.Store(spark, f"{tmp_path}/store")
    at = F.timestamp_seconds("post_id")
    rows = spark.range(20).select(F.col("id").alias("post_id"), F.lit("tiktok").alias("platform"), F.lit("global").alias("market"), F.col("id").alias("views"))
    rows = rows.withColumn("known_at", F.create_map(F.lit("views"), at))
    with store.transaction() as tx:
        assert tx.upsert("posts", rows).count() == 20 and tx.upsert("posts", rows.where("post_id < 5").withColumn("views", F.lit(-1))).count() == 5
    few = store.read("posts", ["post_id", "views"])
    groups = [x for x in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert few.columns == ["post_id", "views"] and groups and not any("known_at" in x for x in groups)
    assert sorted(r.views for r in few.collect()) == [-1] * 5 + list(range(5, 20))


def test_a_field_and_its_time_come_from_one_maximum(spark):
    o = [("tiktok", "1", 1, datetime(2024, 1, d), u, v) for d, u, v in ((1, "a", 5), (2, None, 7), (2, None, 6))]
    df = spark.createDataFrame(o, "platform string, external_id string, post_id long, observed_at timestamp, canonical_url string, views long").withColumn("content_type", F.lit("video"))
    r = merge.fold_posts(df).first()
    assert (r.views, r.canonical_url, r.first_seen_at.day, r.last_seen_at.day) == (7, None, 1, 2)
    assert r.known_at["views"] == r.last_seen_at
    assert merge.fold_posts(df)._jdf.queryExecution().optimizedPlan().toString().count("max_by") == 0
