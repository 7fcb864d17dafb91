"""One observation batch from raw payloads to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.operators.ingest import flat_observations, merge_folds, observation_effects, touched
from crestline.operators.planning import back_off_failed, complete_refreshes, job_cost, record_scans
from crestline.operators.normalize import normalize, quarantine_rows, split_rejects
from crestline.session import materialize
from crestline.sources.tables import Store, Transaction

OPTIONAL = {"query_text": "string", "query_hashtag_id": "bigint", "rank_in_results": "int"}


def ingest_batch(raw: DataFrame, store: Store, cfg: Config = DEFAULT) -> None:
    """``raw``: provider, platform, provider_job_id, payload, observed_at, source.

    All tables of the batch become visible by one commit. Posts, tags and folds
    are upserts of as many rows as the batch touches, read back from the touched
    buckets; appends exclude rows already stored, so running the same batch
    again changes nothing.
    """
    extra = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in raw.columns}
    done = _normalized(raw.withColumns(extra) if extra else raw)
    good, bad = split_rejects(done)
    obs = flat_observations(good)
    with store.transaction() as tx:
        write_batch(tx, obs, cfg)
        tx.append("quarantined_items", quarantine_rows(tx.read("quarantined_items"), bad, F.col("observed_at")))


def _normalized(raw: DataFrame) -> DataFrame:
    """Normalised records, stored; only rejects keep their payload, nothing else reads it.

    Parsing is CPU-bound, so records are dealt by their number over several tasks per core: the tasks of a scan go by
    bytes, and a compressed file of many records is a small one. The count is given because an adaptive shuffle would
    merge the partitions by their bytes again.
    """
    n = 4 * raw.sparkSession.sparkContext.defaultParallelism
    done = normalize(raw.repartition(n, "provider_job_id", F.xxhash64("payload")))
    return materialize(done.withColumn("payload", F.when(F.col("reject_kind").isNotNull(), F.col("payload"))), "normalized")


def write_batch(tx: Transaction, observations: DataFrame, cfg: Config = DEFAULT, requested: DataFrame | None = None) -> None:
    """The changes of flat observations (rows of a stored table) to the six post and tag tables.

    ``requested`` (platform, external_id) are posts that refresh jobs asked for.
    """
    stored = touched(tx.read, tx.lookup, observations)
    effects = observation_effects(stored, observations, cfg)
    if requested is not None:
        seen = observations.where("source = 'REFRESH'").select("platform", "external_id", F.col("observed_at").alias("refreshed_at"))
        effects["posts"] = complete_refreshes(effects["posts"], seen, requested, None, cfg)
    # The folds read both as they are stored; the history they are judged by, read before, does not hold them.
    posts, fresh = tx.upsert("posts", effects["posts"]), tx.append("post_snapshots", effects["post_snapshots"])
    effects["post_folds"] = merge_folds(stored["post_folds"], posts, fresh, stored["post_snapshots"], cfg)
    for name in ("post_hashtags", "post_discoveries"):
        tx.append(name, effects[name])
    for name in ("hashtags", "post_folds"):
        tx.upsert(name, effects[name])


HELD = ["provider", "platform", "provider_job_id", "payload", "observed_at", "rank_in_results"]


def ingest_jobs(items: DataFrame, store: Store, batch: tuple[str, int] | None = None, cfg: Config = DEFAULT) -> None:
    """Landed records of collection jobs (as of ``sources.raw``) into all tables, attributed by the stored job ledger.

    Records of a discovery job become discoveries, with query, tag and rank if
    the job asked one query; records of a refresh job become snapshots, and the
    posts it asked for are completed. The job and the tags it scanned are marked
    in the same commit. Records whose job is not in the ledger yet are held back
    and join a later batch. ``batch`` (stream, number) makes a replay a no-op.
    """
    with store.transaction() as tx:
        if _held(tx, items, batch):
            _ingest_known(tx, cfg)


def hold_items(items: DataFrame, store: Store, batch: tuple[str, int] | None = None) -> None:
    """Only store landed records in ``held_items``, in one commit; ``ingest_held`` brings them into the other tables."""
    with store.transaction() as tx:
        if not _held(tx, items, batch):
            tx.drop()


def ingest_held(store: Store, cfg: Config = DEFAULT) -> None:
    """As ``ingest_jobs``, for all held records whose job the ledger knows by now; with nothing to do there is no commit."""
    with store.transaction() as tx:
        if not _ingest_known(tx, cfg):
            tx.drop()


def _held(tx: Transaction, items: DataFrame, batch: tuple[str, int] | None) -> bool:
    """Append records to the held ones, unless ``batch`` is stored already."""
    if batch is not None:
        done = tx.note(f"stream {batch[0]}")
        if done is not None and done["batch"] >= batch[1]:
            return False
        tx.note(f"stream {batch[0]}", {"batch": batch[1]})
    tx.append("held_items", items.select(*HELD))
    return True


def _ingest_known(tx: Transaction, cfg: Config) -> bool:
    """Whether there was anything to do: records of known jobs, or failed jobs to settle."""
    waiting = tx.read("held_items")
    jobs = materialize(tx.lookup("provider_jobs", waiting.select(F.col("provider_job_id").alias("job_id"))), "jobs")
    if jobs.isEmpty():
        if _unsettled(tx).isEmpty():
            return False
        _settle_jobs(tx, jobs, tx.spark.createDataFrame([], "job_id bigint, _good bigint, _bad bigint, _at timestamp"), cfg)
        return True
    tx.rewrite("held_items", waiting.join(jobs, waiting.provider_job_id == jobs.job_id, "left_anti"))
    raw = waiting.join(jobs.select(F.col("job_id").alias("provider_job_id"), "market", "job_type", "queries", "requested"), "provider_job_id")
    finds = F.col("job_type") == "HASHTAG_DISCOVERY"
    one = finds & (F.size("queries") == 1)
    raw = raw.select(
        "provider", "platform", "provider_job_id", "payload", "observed_at", F.when(finds, "DISCOVERY").otherwise("REFRESH").alias("source"),
        F.when(one, F.get("queries", F.lit(0))["query"]).alias("query_text"), F.when(one, F.get("queries", F.lit(0))["hashtag_id"]).alias("query_hashtag_id"),
        F.when(one, F.col("rank_in_results")).alias("rank_in_results"),
    )
    done = _normalized(raw)
    good, bad = split_rejects(done)
    obs = flat_observations(good)
    asked = jobs.where("job_type <> 'HASHTAG_DISCOVERY'").select("platform", F.explode("requested").alias("external_id"))
    write_batch(tx, obs, cfg, asked)
    tx.append("quarantined_items", quarantine_rows(tx.read("quarantined_items"), bad, F.col("observed_at")))
    n = done.groupBy(F.col("provider_job_id").alias("job_id")).agg(
        F.count_if(F.col("reject_kind").isNull()).alias("_good"), F.count_if(F.col("reject_kind").isNotNull()).alias("_bad"), F.max("observed_at").alias("_at")
    )
    n = materialize(n, "job-results")
    _settle_jobs(tx, jobs, n, cfg)
    return True


def _unsettled(tx: Transaction) -> DataFrame:
    """Failed jobs that nobody has dealt with."""
    return tx.read("provider_jobs").where("status = 'FAILED' and ingested_at is null")


def _settle_jobs(tx: Transaction, jobs: DataFrame, results: DataFrame, cfg: Config) -> None:
    """Mark ingested jobs and the tags they scanned; tags of failed jobs that nobody has dealt with become due again soon."""
    zero = F.lit(0).cast("bigint")
    # A job's records may come in several batches.
    now = jobs.join(results, "job_id").withColumns(
        {
            "records_returned": F.coalesce("records_returned", zero) + F.col("_good"), "records_quarantined": F.coalesce("records_quarantined", zero) + F.col("_bad"),
            "ingested_at": F.col("_at"), "status": F.lit("INGESTED"),
        }
    )
    now = materialize(job_cost(now, cfg), "ingested-jobs")
    failed = materialize(_unsettled(tx).join(now, "job_id", "left_anti"), "failed-jobs")
    tag = F.explode("queries").alias("q")
    finds = F.col("job_type") == "HASHTAG_DISCOVERY"
    scans = now.where(finds).select(F.col("_at").alias("scanned_at"), F.col("_good").alias("records"), tag).select(F.col("q.tracked_id").alias("tracked_id"), "scanned_at", "records")
    tracked = record_scans(tx.read("tracked_hashtags"), scans, cfg)
    lost = failed.where(finds).select(F.col("submitted_at").alias("at"), tag).select(F.col("q.tracked_id").alias("tracked_id"), "at")
    if not lost.isEmpty():
        at = lost.agg(F.max("at")).first()[0]
        tracked = back_off_failed(tracked, lost, F.lit(at), cfg.failed_scan_hours)
    tx.rewrite("tracked_hashtags", tracked)
    tx.upsert("provider_jobs", now.unionByName(failed.withColumn("ingested_at", F.col("submitted_at")), allowMissingColumns=True))
