"""Streaming queries: the given tables replayed as a stream, run to completion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT
from crestline.functions import scalars as S
from crestline.registry.base import compose, cte, out, query, us
from crestline.registry.ingest import coarse_snapshots, raw_p1
from crestline.registry.model import model
from crestline.session import materialize, shared_dir
from crestline.streaming import state, windows

def replay(
    df: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], mode: str, parts: int = 3, jitter_us: int = 0, flush: str | None = None
) -> DataFrame:
    """Feed ``df`` to a streaming query and return what it wrote.

    The rows land part by part in time order, each up to ``jitter_us`` late;
    after each landing the query is restarted on its checkpoint and drains what
    is new, as a scheduled job would. ``flush`` names the key column of a last
    row, far in the future and under key -1, that moves the watermark past all
    others.
    """
    spark = df.sparkSession
    state.use_rocksdb(spark)
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    micros = dict(df.dtypes)[order] == "bigint"
    t = F.col(order) if micros else F.unix_micros(order)
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    landed = t + (F.pmod(F.xxhash64(*df.columns), F.lit(jitter_us)) if jitter_us else F.lit(0))
    part = F.least(F.lit(parts - 1), F.floor((landed - F.lit(lo)) / F.lit(max(hi - lo, 1)) * parts))
    staged = materialize(df.withColumn("_part", part), "replay")

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    lots = [staged.where(F.col("_part") == i).drop("_part") for i in range(parts)]
    if flush:
        end = F.lit(hi + 10_000 * 86_400_000_000)
        lots.append(staged.drop("_part").limit(1).withColumns({flush: F.lit(-1).cast(dict(df.dtypes)[flush]), order: end if micros else F.timestamp_micros(end)}))
    for lot in lots:
        lot.select(*df.columns).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/cp")
        q.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.where(F.col(flush) != -1) if flush else out


DAY_US = 86_400_000_000


@query(
    "stream_claim_once",
    "T2",
    compose("SELECT DISTINCT user_id * 10 + k % 10 AS update_id FROM ev"),
)
def claim_once(spark, sf):
    """Duplicates of an id never lie further apart than the 40-day memory used here."""
    e = model(spark, sf).events.select((F.col("user_id") * 10 + F.col("k") % 10).alias("update_id"), F.col("ts").alias("received_at"))
    return replay(e, "received_at", lambda x: windows.claim_once(x, memory="40 days"), "append").select("update_id")


@query("stream_snapshot_dedup", "T3", compose("SELECT post_id, t AS observed_us, m AS views FROM s12walk WHERE kept"))
def snapshot_dedup(spark, sf):
    """Rows arrive up to a day late; the twin walks them in time order."""
    from dataclasses import replace

    s = coarse_snapshots(model(spark, sf)).withColumn("observed_us", F.unix_micros("observed_at")).drop("observed_at")
    cfg = replace(DEFAULT, dedup_minutes=36 * 60)
    rows = replay(s, "observed_us", lambda x: state.dedup_stream(x, cfg, "2 days", 24.0 * 60), "append", jitter_us=DAY_US, flush="post_id")
    return rows.select("post_id", "observed_us", "views")


# A sighting of a post under a tag, with the tier it then had.
cte(
    "sight",
    """SELECT us, post_id, platform, k % 7 AS hashtag_id, CASE WHEN views >= 200000 THEN 'VIRAL_QUALIFIED' WHEN views >= 150000 THEN 'EARLY_BREAKOUT' WHEN views >= 5000 THEN 'WATCH' ELSE 'NOISE' END AS tier, 'u' || (user_id // 8) AS creator FROM obs WHERE k IS NOT NULL""",
)
_counted = """count(*) AS posts_seen, count(*) FILTER (WHERE tier IN ('VIRAL_QUALIFIED', 'EARLY_BREAKOUT')) AS qualified, count(*) FILTER (WHERE tier = 'WATCH') AS watch"""


def _sightings(spark, sf) -> DataFrame:
    v = F.col("views")
    tier = F.when(v >= 200000, "VIRAL_QUALIFIED").when(v >= 150000, "EARLY_BREAKOUT").when(v >= 5000, "WATCH").otherwise("NOISE")
    creator = F.concat(F.lit("u"), F.floor(F.col("user_id") / 8).cast("string"))
    o = model(spark, sf).observations.where("k is not null")
    return o.select("observed_at", "post_id", "platform", (F.col("k") % 7).alias("hashtag_id"), tier.alias("tier"), creator.alias("creator"))


@query(
    "stream_daily_counts",
    "T4",
    compose(
        f"""SELECT window_start, platform, hashtag_id, {_counted} FROM (
 SELECT epoch_us(date_trunc('day', make_timestamp(us))) AS window_start, platform, hashtag_id, post_id, arg_max(tier, us) AS tier FROM sight GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
    ),
)
def daily_counts(spark, sf):
    """Posts per UTC day, each once, from sightings that arrive up to a day late."""
    rows = replay(_sightings(spark, sf), "observed_at", lambda x: windows.pane_sightings(x, late="2 days", pane="1 day"), "update", jitter_us=DAY_US)
    return out(windows.daily_counts(windows.latest_panes(rows)))


@query(
    "stream_rolling_counts",
    "T4",
    compose(
        f"""SELECT s AS window_start, s + 86400000000 AS window_end, platform, hashtag_id, {_counted}, count(DISTINCT creator) FILTER (WHERE tier IN ('VIRAL_QUALIFIED', 'EARLY_BREAKOUT')) AS c24 FROM (
 SELECT s, platform, hashtag_id, post_id, arg_max(tier, us) AS tier, arg_max(creator, us) AS creator FROM (
  SELECT *, unnest(list_transform(range(0, 12), lambda i: us // 7200000000 * 7200000000 - i * 7200000000)) AS s FROM sight) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4"""
    ),
)
def rolling_counts(spark, sf):
    """A day that slides by two hours: posts and creators, each once per window."""
    rows = replay(_sightings(spark, sf), "observed_at", lambda x: windows.pane_sightings(x, late="2 days", pane="2 hours"), "update", jitter_us=DAY_US)
    return out(windows.rolling_counts(windows.latest_panes(rows), 7_200_000_000, 12))


CAND = "CASE k % 4 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'STABLE' WHEN 2 THEN 'ACTIVE' ELSE 'BREAKOUT' END"
RANK = "CASE {0} WHEN 'DEAD' THEN 0 WHEN 'STABLE' THEN 1 WHEN 'ACTIVE' THEN 2 ELSE 4 END"
cte("hin", f"SELECT user_id AS key, us AS at_us, {CAND} AS candidate, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM ev")
_take = f"(c.candidate <> w.trend_state AND (c.at_us - w.since_us >= 10800000000 OR {RANK.format('c.candidate')} >= {RANK.format('w.trend_state')}))"
cte(
    "hwalk",
    f"""SELECT key, at_us, candidate, i, candidate AS trend_state, at_us AS since_us FROM hin WHERE i = 1
UNION ALL SELECT c.key, c.at_us, c.candidate, c.i, CASE WHEN {_take} THEN c.candidate ELSE w.trend_state END, CASE WHEN {_take} THEN c.at_us ELSE w.since_us END FROM hwalk w JOIN hin c ON c.key = w.key AND c.i = w.i + 1""",
)


@query("stream_held_states", "T5", compose("SELECT key, at_us, candidate, trend_state, since_us FROM hwalk"))
def held_states(spark, sf):
    k = F.col("k") % 4
    cand = F.when(k == 0, "DEAD").when(k == 1, "STABLE").when(k == 2, "ACTIVE").otherwise("BREAKOUT")
    e = model(spark, sf).events.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at_us"), cand.alias("candidate"))
    rows = replay(e, "at_us", lambda x: state.held_state_stream(x, late="2 days"), "append", jitter_us=DAY_US, flush="key")
    return rows.select("key", "at_us", "candidate", "trend_state", "since_us")


@query(
    "stream_velocity",
    "T6, T7",
    compose(
        """SELECT post_id, vph_kind, round(vph, 4) AS vph, round(vph_previous, 4) AS vph_previous, velocity_confidence, had_negative_delta FROM vel WHERE vph_kind <> 'NONE'"""
    ),
)
def velocity(spark, sf):
    """Points arrive up to a day late; the last row of every post equals the velocity of its sorted history."""
    m = model(spark, sf)
    s = m.snapshots.join(m.posts.select("post_id", "published_at"), "post_id").select(
        "post_id", F.unix_micros("published_at").alias("published_us"), F.unix_micros("observed_at").alias("observed_us"), "views"
    )
    rows = replay(s, "observed_us", lambda x: state.velocity_stream(x, late="2 days"), "update", jitter_us=DAY_US)
    fields = [c for c in rows.columns if c not in ("post_id", "batch_id", "b")]
    last = rows.groupBy("post_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("r")).select("post_id", "r.*")
    v = state.with_estimate(last, m.now)
    return v.select(
        "post_id", F.col("kind").alias("vph_kind"), F.round("vph", 4).alias("vph"), F.round("vph_previous", 4).alias("vph_previous"),
        F.col("confidence").alias("velocity_confidence"), F.col("had_drop").alias("had_negative_delta"),
    )


# Jobs of the landed records: 200 events each; every fourth is a refresh job, every other discovery job asks one query.
cte(
    "landed",
    """SELECT r.*, r.event_id // 200 AS job, r.event_id // 200 % 4 <> 3 AS finds, r.event_id // 200 % 2 = 0 AS single,
 row_number() OVER (PARTITION BY r.event_id // 200 ORDER BY r.event_id) - 1 AS pos FROM rawn r""",
)


def job_ledger(m) -> DataFrame:
    """The stored form of the jobs behind the landed records."""
    j = F.col("job_id")

    def asked(i: int) -> Column:
        return F.struct(((j + i) % 5).alias("tracked_id"), ((j + i) % 7).alias("hashtag_id"), F.concat(F.lit("q"), j + i).alias("query"))

    wanted = F.collect_list(F.when(F.col("k") % 2 == 0, (F.col("event_id") + 7_000_000).cast("string")))
    jobs = m.events.groupBy(F.floor(F.col("event_id") / 200).cast("bigint").alias("job_id")).agg(wanted.alias("requested"), F.min("ts").alias("submitted_at"))
    finds = j % 4 != 3
    return jobs.select(
        "job_id", F.lit("apify").alias("provider"), F.lit("tiktok").alias("platform"), F.lit("global").alias("market"), "submitted_at", F.lit("SUBMITTED").alias("status"),
        F.when(finds, "HASHTAG_DISCOVERY").otherwise("POST_REFRESH").alias("job_type"), F.when(finds, F.when(j % 2 == 0, F.array(asked(0))).otherwise(F.array(asked(0), asked(1)))).alias("queries"),
        F.when(~finds, F.col("requested")).alias("requested"),
    )


@query(
    "stream_ingest",
    "T1, S4, I14, I16",
    compose(
        """SELECT vid AS external_id, views, us_at AS last_seen_at, hashtags AS tags, CASE WHEN finds THEN 'DISCOVERY' ELSE 'REFRESH' END AS source, l.job AS provider_job_id, CASE WHEN finds AND single THEN 'q' || l.job END AS query_text,
 CASE WHEN finds AND single THEN l.job % 7 END AS query_tag, CASE WHEN finds AND single THEN pos END AS rank_in_results, CAST(CASE WHEN NOT finds AND k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS refreshes, j.good AS job_returned, j.bad AS job_quarantined
FROM landed l JOIN (SELECT job, count(*) FILTER (WHERE reject_kind IS NULL) AS good, count(*) FILTER (WHERE reject_kind IS NOT NULL) AS bad, min(us) // 1000 * 1000 AS us_at FROM landed GROUP BY 1) j ON j.job = l.job
WHERE reject_kind IS NULL"""
    ),
)
def stream_ingest(spark, sf):
    """Land the derived payloads of all jobs in bundles, in two parts; a third of the jobs enter the ledger only after the first."""
    from crestline.sources.raw import land_bundles, stream_bundles
    from crestline.sources.tables import Store
    from crestline.streaming.ingest import ingest_stream

    m = model(spark, sf)
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/tables")
    ledger = materialize(job_ledger(m), "ledger")
    job = F.floor(F.col("event_id") / 200).cast("bigint")
    raw = raw_p1(m).select("event_id", "provider", "platform", job.alias("job"), "observed_at", "payload")
    of_job = Window.partitionBy("job")
    for part, jobs in ((F.col("job") % 5 < 3, F.col("job_id") % 3 != 0), (F.col("job") % 5 >= 3, F.col("job_id") % 3 == 0)):
        store.upsert("provider_jobs", ledger.where(jobs))
        rows = raw.where(part).withColumn("rank_in_results", F.row_number().over(of_job.orderBy("event_id")) - 1)
        # A job is observed when it is submitted, with its first record.
        land_bundles(rows.withColumn("at", F.unix_millis(F.min("observed_at").over(of_job))), f"{root}/landing")
        ingest_stream(spark, f"{root}/landing", store, f"{root}/cp", read=stream_bundles)
    tags = store.read("post_hashtags").join(store.read("hashtags", ["hashtag_id", "name"]), "hashtag_id").groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("t"))
    found = store.read("post_discoveries").select("post_id", "query_text", F.col("hashtag_id").alias("query_tag"), "rank_in_results")
    seen = store.read("post_snapshots").select("post_id", "source", "provider_job_id")
    jobs = store.read("provider_jobs", ["job_id", "records_returned", "records_quarantined"]).select(F.col("job_id").alias("provider_job_id"), F.col("records_returned").alias("job_returned"), F.col("records_quarantined").alias("job_quarantined"))
    posts = store.read("posts", ["post_id", "external_id", "views", "last_seen_at", "paid_refresh_count"])
    rows = posts.join(seen, "post_id").join(jobs, "provider_job_id").join(tags, "post_id").join(found, "post_id", "left")
    return out(
        rows, "external_id", "views", us("last_seen_at").alias("last_seen_at"), F.concat_ws("|", F.transform("t", lambda x: x["name"])).alias("tags"), "source", "provider_job_id", "query_text", "query_tag",
        "rank_in_results", F.col("paid_refresh_count").alias("refreshes"), "job_returned", "job_quarantined",
    )
