"""Natural-key lookups, always as a set of wanted keys against a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posts_by_key(posts: DataFrame, keys: DataFrame) -> DataFrame:
    """Posts whose (platform, external_id) is wanted."""
    return posts.join(keys.select("platform", "external_id").distinct(), ["platform", "external_id"], "left_semi")


def tags_by_name(hashtags: DataFrame, names: DataFrame) -> DataFrame:
    return hashtags.join(names.select("name").distinct(), "name", "left_semi")


def tracked_by_key(tracked: DataFrame, keys: DataFrame) -> DataFrame:
    key = ["hashtag_id", "platform", "market"]
    return tracked.join(keys.select(*key).distinct(), key, "left_semi")


def categories_of_tags(hashtag_categories: DataFrame, hashtag_ids: DataFrame) -> DataFrame:
    return hashtag_categories.join(hashtag_ids.select("hashtag_id").distinct(), "hashtag_id", "left_semi")


def categories_of_posts(post_categories: DataFrame, post_ids: DataFrame) -> DataFrame:
    return post_categories.join(post_ids.select("post_id").distinct(), "post_id", "left_semi")


def previous_report(reports: DataFrame, report_date, market: str) -> DataFrame:
    """The newest frozen report strictly before a date (at most one row)."""
    d = F.col("report_date")
    return _newest(reports.where((d < report_date) & (F.col("market") == market)))


def latest_report(reports: DataFrame, market: str) -> DataFrame:
    return _newest(reports.where(F.col("market") == market))


def _newest(reports: DataFrame) -> DataFrame:
    row = F.max_by(F.struct(*reports.columns), "report_date").alias("r")
    return reports.agg(row).where("r is not null").select("r.*")
