"""CSV and JSON exports of the report and the tag history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOM = "﻿"


def _fixed(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


def csv_field(c: Column) -> Column:
    """RFC-4180 quoting; null is empty."""
    s = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[",\\r\\n]'), quoted).otherwise(s), F.lit(""))


def candidate_csv_rows(items: DataFrame) -> DataFrame:
    """The 20 export columns as strings, in file order."""
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return items.select(
        "rank", F.col("tier").alias("qualification"), "trend_state", "platform", F.col("creator_username").alias("creator"),
        iso.alias("published_at"), F.when(F.col("age_hours").isNotNull(), _fixed("age_hours", 2)).alias("age_hours"),
        "views", "likes", "comments", "shares", F.when(F.col("vph").isNotNull(), _fixed("vph", 2)).alias("vph"), "vph_kind",
        "velocity_confidence", "trend_score", "rising_score", F.concat_ws("|", "categories").alias("categories"),
        F.concat_ws("|", "hashtags").alias("hashtags"), F.col("caption_preview").alias("caption"), "canonical_url",
    )


def history_csv_rows(history: DataFrame) -> DataFrame:
    """The 12 history columns; momentum with five decimals, rate with two."""
    return history.select(
        "date", "platform", "market", "tag", "trend_state",
        F.when(F.col("radar_momentum").isNotNull(), _fixed("radar_momentum", 5)).alias("radar_momentum"),
        "radar_posts_seen", "qualified_posts", "breakout_posts", "distinct_creators",
        F.when(F.col("median_vph").isNotNull(), _fixed("median_vph", 2)).alias("median_vph"), "scans",
    )


def csv_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): a header row and one quoted line per row of a bounded list."""
    line = F.concat_ws(",", *[csv_field(F.col(c)) for c in rows.columns])
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("line_no"), line.alias("line"))
    head = rows.sparkSession.createDataFrame([(0, ",".join(rows.columns))], "line_no int, line string")
    return head.unionByName(numbered)


def write_csv(rows: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """CSV parts with CRLF line ends and a BOM in front of each part's header.

    Parts stay parallel; pass a bounded frame coalesced to one partition for a
    single download file.
    """
    names = rows.columns
    named = rows.select(F.col(names[0]).alias(BOM + names[0]), *names[1:])
    if order:
        named = rows.orderBy(*order).select(F.col(names[0]).alias(BOM + names[0]), *names[1:])
    named.write.mode("overwrite").options(
        header=True, lineSep="\r\n", nullValue="", emptyValue="", quote='"', escape='"', encoding="UTF-8"
    ).csv(path)


def json_document(report: DataFrame) -> DataFrame:
    """(report_date, document): the frozen row as one JSON text."""
    return report.select("report_date", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_json(report: DataFrame, path: str) -> None:
    json_document(report).select("document").write.mode("overwrite").text(path)
