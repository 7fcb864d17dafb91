"""Retention, frozen reports and frozen views over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators import report as R
from crestline.operators import retention as X
from crestline.session import materialize
from crestline.sources.exports import json_document
from crestline.sources.tables import TABLES, Store, Transaction

# Tables that the sweep may touch, parents before children.
SWEPT = (
    "posts", "collection_runs", "provider_jobs", "post_snapshots", "post_discoveries", "post_hashtags", "post_categories", "hashtag_cooccurrence_daily",
    "hashtag_daily_stats", "daily_reports", "result_views", "quarantined_items", "error_events",
)
# Date partitions, and the table's column of that date.
DATED = {"post_snapshots": "observed_date", "hashtag_cooccurrence_daily": "date", "hashtag_daily_stats": "date"}


def first_kept_day(store: Store | Transaction, name: str, now, cfg: Config = DEFAULT) -> str:
    """The first day that may hold a row within the table's lifetime."""
    last = S.plus_hours(S.as_time(now), -24.0 * float(cfg.table_ttl_days[name]))
    return store.spark.range(1).select(F.to_date(last).cast("string")).first()[0]


def sweep_store(store: Store, now, cfg: Config = DEFAULT, dry_run: bool = False) -> DataFrame:
    """(table_name, expired) of every table with expired rows; they are gone afterwards, all by one commit, unless ``dry_run``.

    Whole days of a dated table leave as partitions, without being read or
    moved. Of the rest only what holds an expired row is written anew: the
    partitions of a dated table, or the table. The posts' folds go with them.
    """
    with store.transaction() as tx:
        before = {n: tx.read(n) for n in SWEPT}
        posts_gone = materialize(before["posts"].where(X.post_expired(now, cfg)).select("post_id"), "expired-posts")
        after = X.sweep(before, now, cfg)
        counts = {n: _lost(before[n], after[n]) for n in SWEPT}
        counts = {n: c for n, c in counts.items() if c}
        if not dry_run:
            for name in counts:
                _replace(tx, name, after[name], now, cfg)
            if "posts" in counts:
                tx.rewrite("post_folds", tx.read("post_folds").join(posts_gone, "post_id", "left_anti"))
        else:
            tx.drop()
    return store.spark.createDataFrame(sorted(counts.items()), "table_name string, expired bigint")


def _lost(before: DataFrame, after: DataFrame) -> int:
    return before.count() - after.count()


def _replace(tx: Transaction, name: str, kept: DataFrame, now, cfg: Config) -> None:
    if name not in DATED:
        tx.rewrite(name, materialize(kept, f"kept-{name}"))
        return
    day = DATED[name]
    cut = first_kept_day(tx, name, now, cfg)
    tx.drop_partitions(name, lambda p: p[day] < cut)
    # Days that still hold an expired row, or one whose post or job is gone, are written anew.
    left = tx.read(name)
    old = left.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    new = kept.groupBy(day).agg(F.count(F.lit(1)).alias("m"))
    fewer = old.join(new, day, "left").where(F.coalesce("m", F.lit(0)) < F.col("n")).select(day)
    days = [r[0] for r in materialize(fewer, "changed-days").collect()]  # at most the days of a lifetime
    if days:
        tx.drop_partitions(name, lambda p: p[day] in {str(d) for d in days})
        tx.append(name, materialize(kept.where(F.col(day).isin(days)), f"kept-{name}"))


def freeze(store: Store, report: DataFrame, delivered_at=None) -> bool:
    """Store a report document unless one of its (date, market) was delivered; an undelivered one is replaced."""
    doc = report.select("market", "generated_at").crossJoin(json_document(report)).withColumn(  # single rows
        "delivered_at", F.lit(None).cast("timestamp") if delivered_at is None else S.as_time(delivered_at)
    )
    doc = materialize(doc.withColumn("report_date", F.col("report_date").cast("string")), "frozen")
    with store.transaction() as tx:
        stored = tx.read("daily_reports")
        fresh = R.freeze_report(stored, doc)
        if fresh.isEmpty():
            return False
        rest = stored.join(fresh.select("report_date", "market"), ["report_date", "market"], "left_anti")
        tx.rewrite("daily_reports", materialize(rest.unionByName(fresh.select(*rest.columns)), "reports"))
    return True


def keep_view(store: Store, items: DataFrame, view_id: str, kind: str, now, cfg: Config = DEFAULT) -> bool:
    """Store a frozen list under its id, once."""
    rows = materialize(R.freeze_view(items, view_id, kind, now, cfg), "view")
    with store.transaction() as tx:
        return tx.put_if_absent("result_views", rows, ["view_id"])


def table_sizes(store: Store) -> DataFrame:
    """(table_name, n_rows) of all stored tables."""
    parts = [store.read(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)
