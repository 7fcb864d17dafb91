"""Landed vendor payloads: pages of one response each (one JSON record per line), and bundles of the records of many jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Landing layout: <root>/provider=<p>/platform=<q>/job=<id>/at=<epoch ms>/page-<n>.json, where <n> is the number of
# records on the pages before it. A page is one response of a vendor, so it is read as a whole.
LANDING = "page string, provider string, platform string, job bigint"

# Bundle layout: <root>/provider=<p>/platform=<q>/*.parquet, one row per record, whose job is a column. A page costs a file
# and two folders, to write, to list and to open, however short it is; the number of bundles follows from the bytes.
BUNDLE = "job bigint, at bigint, rank_in_results int, payload string, provider string, platform string"


def read_landing(spark: SparkSession, root: str) -> DataFrame:
    """All records of all pages of all jobs; the folders give provider, platform, job and the time of the observation."""
    return _shaped(spark.read.schema(LANDING).text(root, wholetext=True))


def stream_landing(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    return _shaped(spark.readStream.schema(LANDING).option("maxFilesPerTrigger", max_files).text(root, wholetext=True))


def land_bundles(rows: DataFrame, root: str) -> None:
    """Land records (the columns of ``BUNDLE``; ``at`` in epoch ms) in as few files as their bytes need."""
    rows.select("job", "at", F.col("rank_in_results").cast("int").alias("rank_in_results"), "payload", "provider", "platform").write.mode("append").partitionBy(
        "provider", "platform"
    ).parquet(root)


def stream_bundles(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """The same rows as ``stream_landing``, from bundles; empty records are left out."""
    df = spark.readStream.schema(BUNDLE).option("maxFilesPerTrigger", max_files).parquet(root)
    return df.where(F.length(F.trim("payload")) > 0).select(
        "provider", "platform", F.col("job").alias("provider_job_id"), F.rtrim("payload").alias("payload"),
        F.coalesce(F.timestamp_millis("at"), F.col("_metadata.file_modification_time")).alias("observed_at"), "rank_in_results",
    )


def _shaped(df: DataFrame) -> DataFrame:
    """One row per record, ``rank_in_results`` being its place in the job's results.

    A folder without ``at`` was observed when its file was written.
    """
    path = F.col("_metadata.file_path")
    at = F.regexp_extract(path, r"/at=(\d+)/", 1).try_cast("bigint")
    first = F.coalesce(F.regexp_extract(path, r"/page-(\d+)[^/]*$", 1).try_cast("int"), F.lit(0))
    pages = df.select(
        "provider", "platform", F.col("job").alias("provider_job_id"), first.alias("first"),
        F.coalesce(F.timestamp_millis(at), F.col("_metadata.file_modification_time")).alias("observed_at"),
        F.filter(F.split("page", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("records"),
    )
    rows = pages.select("provider", "platform", "provider_job_id", "observed_at", "first", F.posexplode("records").alias("i", "payload"))
    return rows.select("provider", "platform", "provider_job_id", F.rtrim("payload").alias("payload"), "observed_at", (F.col("first") + F.col("i")).alias("rank_in_results"))
