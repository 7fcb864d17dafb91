"""Retention: tier-keyed post lifetimes, table lifetimes and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S

# Age column per table; dates compare as dates.
AGE_COLUMN = {
    "post_snapshots": "observed_at", "post_discoveries": "observed_at", "hashtag_cooccurrence_daily": "date",
    "hashtag_daily_stats": "date", "daily_reports": "generated_at", "collection_runs": "planned_at", "result_views": "created_at",
    "quarantined_items": "created_at", "telegram_updates": "received_at", "error_events": "at",
}


def post_expired(now, cfg: Config = DEFAULT) -> Column:
    """True once a post is older than its tier's lifetime (an exact hit stays)."""
    days = F.lit(cfg.post_ttl_unknown)
    for tier, ttl in cfg.post_ttl_days.items():
        days = F.when(F.col("tier") == tier, ttl).otherwise(days)
    known = F.col("tier").isNull() | F.col("tier").isin(*cfg.post_ttl_days)
    cutoff = S.plus_hours(S.as_time(now), -days.cast("double") * 24.0)
    return F.coalesce(known & (F.coalesce("published_at", "first_seen_at") < cutoff), F.lit(False))


def row_expired(table: str, now, cfg: Config = DEFAULT) -> Column:
    """True for rows of ``table`` beyond its lifetime; a pushable bound."""
    days = float(cfg.table_ttl_days[table])
    cutoff = S.plus_hours(S.as_time(now), -24.0 * days)
    c = AGE_COLUMN[table]
    if c == "date":
        return F.coalesce(F.col(c) < F.to_date(cutoff), F.lit(False))
    return F.coalesce(F.col(c) < cutoff, F.lit(False))


def keep(df: DataFrame, expired: Column) -> DataFrame:
    return df.where(~expired)


def cascade(children: DataFrame, parents: DataFrame, expired: Column, key: str) -> DataFrame:
    """Children without the rows of expired parents."""
    return children.join(parents.where(expired).select(key), key, "left_anti")


def detach(children: DataFrame, parents: DataFrame, expired: Column, key: str, column: str) -> DataFrame:
    """Children whose reference to an expired parent becomes null."""
    gone = parents.where(expired).select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    out = children.join(gone, column, "left")
    return out.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*children.columns)


def sweep(tables: dict[str, DataFrame], now, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """The surviving rows of every given table, cascades included."""
    out = dict(tables)
    if "posts" in tables:
        gone = post_expired(now, cfg)
        out["posts"] = keep(tables["posts"], gone)
        for child in ("post_snapshots", "post_discoveries", "post_hashtags", "post_categories"):
            if child in out:
                out[child] = cascade(out[child], tables["posts"], gone, "post_id")
    if "collection_runs" in tables and "provider_jobs" in tables:
        gone = row_expired("collection_runs", now, cfg)
        dead_jobs = tables["provider_jobs"].join(tables["collection_runs"].where(gone).select("run_id"), "run_id", "left_semi")
        out["provider_jobs"] = cascade(tables["provider_jobs"], tables["collection_runs"], gone, "run_id")
        for child in ("post_snapshots", "quarantined_items"):
            if child in out and "provider_job_id" in out[child].columns:
                out[child] = detach(out[child], dead_jobs, F.lit(True), "job_id", "provider_job_id")
        if "post_discoveries" in out:
            out["post_discoveries"] = out["post_discoveries"].join(
                dead_jobs.select(F.col("job_id").alias("provider_job_id")), "provider_job_id", "left_anti"
            ).select(*tables["post_discoveries"].columns)
    for name in AGE_COLUMN:
        if name in out:
            out[name] = keep(out[name], row_expired(name, now, cfg))
    return out


def sweep_counts(tables: dict[str, DataFrame], now, cfg: Config = DEFAULT) -> DataFrame:
    """(table_name, expired): what the sweep's own bounds would delete."""
    parts = []
    for name, df in tables.items():
        if name == "posts":
            hit = post_expired(now, cfg)
        elif name in AGE_COLUMN:
            hit = row_expired(name, now, cfg)
        elif name == "provider_jobs":
            dead = tables["collection_runs"].where(row_expired("collection_runs", now, cfg)).select("run_id")
            df, hit = df.join(dead, "run_id", "left_semi"), F.lit(True)
        else:
            continue
        parts.append(df.agg(F.count_if(hit).alias("expired")).select(F.lit(name).alias("table_name"), "expired"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
