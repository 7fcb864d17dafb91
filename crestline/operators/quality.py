"""Source-quality profiles of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.functions import text as T
from crestline.operators.quantiles import counted, percentiles
from crestline.session import materialize

PERCENTS = (25, 50, 75, 90)
THRESHOLDS = (6, 12, 24, 48, 72)
GOOD_PCT, PARTIAL_PCT = 40.0, 15.0


def tenth(c: Column) -> Column:
    """One decimal, halves upward."""
    return F.floor(c * 10 + 0.5) / 10


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, tenth(part / whole * 100)).otherwise(F.lit(0.0))


def freshness_profile(records: DataFrame, source: list[str], published: str, now, cfg: Config = DEFAULT) -> DataFrame:
    """Age statistics per source; records dated after ``now`` have no age.

    Percentiles interpolate linearly and are exact for sources of any size.
    """
    age = S.hours_between(F.col(published), S.as_time(now))
    rows = records.select(*source, F.when(age >= 0, age).alias("age"))
    n = F.count("age")
    aggs = [
        F.count(F.lit(1)).alias("sample_size"), n.alias("with_timestamp"),
        tenth(F.min("age")).alias("min_age_hours"), tenth(F.max("age")).alias("max_age_hours"),
        *[F.when(n > 0, percent(F.count_if(F.col("age") < h), n)).alias(f"pct_lt_{h}h") for h in THRESHOLDS],
    ]
    q = percentiles(counted(rows, source, "age"), source, {f"p{p}_age_hours": p / 100 for p in PERCENTS}).drop("n")
    out = rows.groupBy(*source).agg(*aggs).join(q, source, "left")
    out = out.withColumns({f"p{p}_age_hours": tenth(F.col(f"p{p}_age_hours")) for p in PERCENTS})
    return out.withColumn("p90_age_hours", F.when(F.col("with_timestamp") >= 5, F.col("p90_age_hours")))


def is_present(df: DataFrame, path: str) -> Column:
    """Not null, not blank text, not an empty array."""
    t = df.select(path).schema.fields[0].dataType.typeName()
    c = F.col(path)
    if t == "string":
        return F.coalesce(F.length(T.strip_space(c)) > 0, F.lit(False))
    if t == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def field_coverage(records: DataFrame, paths: list[str]) -> DataFrame:
    """(field, present, total, pct) for dotted paths, in one pass."""
    one = records.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_present(records, p)).alias(f"c{i}") for i, p in enumerate(paths)])
    rows = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"c{i}").alias("present")) for i, p in enumerate(paths)])
    out = one.select("total", F.inline(rows))
    return out.select("field", "present", "total", percent(F.col("present"), F.col("total")).alias("pct"))


def plain_term(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\A#", "")


def relevance(records: DataFrame, caption: Column, tags: Column, terms: list[str], source: list[str]) -> DataFrame:
    """Share of records whose caption contains a term or that carry it as a tag."""
    wanted = [t.lower().removeprefix("#") for t in terms]
    hit = F.lit(False)
    low = F.lower(F.coalesce(caption, F.lit("")))
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), plain_term)
    for t in (t for t in wanted if t):
        hit = hit | low.contains(t) | F.array_contains(named, t)
    out = records.select(*source, hit.alias("hit")).groupBy(*source).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("matched")
    )
    return out.withColumn("pct", percent(F.col("matched"), F.col("total")))


def first_present(df: DataFrame, candidates: list[str]) -> tuple[Column, Column]:
    """(field name, value as text) of the first candidate that is present."""
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(candidates):
        ok = is_present(df, p)
        field, value = F.when(ok, F.lit(p)).otherwise(field), F.when(ok, F.col(p).cast("string")).otherwise(value)
    return field, value


def field_consistency(records: DataFrame, candidates: list[str], source: list[str]) -> DataFrame:
    """Per source: which candidate fields occur and whether always the same one."""
    field, _ = first_present(records, candidates)
    g = records.select(*source, field.alias("f")).groupBy(*source).agg(F.sort_array(F.collect_set("f")).alias("fields"))
    n = F.size("fields")
    return g.select(
        *source, F.concat_ws(",", "fields").alias("fields"), F.when(n == 0, "ABSENT").when(n == 1, "CONSISTENT").otherwise("INCONSISTENT").alias("verdict")
    )


def edge_cases(records: DataFrame, record_id: Column, counts: list[Column], count_texts: list[Column], views: Column, tags: Column, source: list[str]) -> DataFrame:
    """Per source: duplicate ids, negative counts, numeric texts, missing views, untagged."""

    def any_of(cols: list[Column]) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | F.coalesce(c, F.lit(False))
        return out

    return records.groupBy(*source).agg(
        F.count(F.lit(1)).alias("records"),
        (F.count(record_id) - F.count_distinct(record_id)).alias("duplicate_ids"),
        F.count_if(any_of([c < 0 for c in counts])).alias("negative_counts"),
        F.count_if(any_of([c.rlike(r"\A\d+\z") for c in count_texts])).alias("numeric_texts"),
        F.count_if(views.isNull()).alias("missing_views"),
        F.count_if(tags.isNull() | (F.size(tags) == 0)).alias("untagged"),
    )


def attribution(records: DataFrame, explicit: list[str], tags: Column, queried: list[str], source: list[str]) -> DataFrame:
    """Can a record be tied to the query that found it?"""
    field, _ = first_present(records, explicit)
    wanted = [q.lower().removeprefix("#") for q in queried]
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), plain_term)
    infer = F.arrays_overlap(named, F.array(*[F.lit(w) for w in wanted]))
    g = records.select(*source, field.isNotNull().alias("e"), F.coalesce(infer, F.lit(False)).alias("i")).groupBy(*source).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("e").alias("explicit"), F.count_if("i").alias("inferable")
    )
    verdict = (
        F.when(F.col("records") == 0, "NOT_TESTED").when(F.col("explicit") == F.col("records"), "SUPPORTED")
        .when((F.col("explicit") > 0) | (F.col("inferable") > 0), "AMBIGUOUS").otherwise("NOT_SUPPORTED")
    )
    return g.withColumn("verdict", verdict)


def canonical_host(url: Column, expected: str) -> tuple[Column, Column]:
    """(host, whether it is the platform's own)."""
    host = T.url_host(url)
    return host, F.coalesce(host == expected, F.lit(False))


def freshness_rating(pct_lt_24h: Column, with_timestamp: Column) -> Column:
    return (
        F.when((with_timestamp == 0) | pct_lt_24h.isNull(), "UNKNOWN").when(pct_lt_24h >= GOOD_PCT, "GOOD")
        .when(pct_lt_24h >= PARTIAL_PCT, "PARTIAL").otherwise("POOR")
    )


def recommendations(profiles: DataFrame) -> DataFrame:
    """Per platform the primary and fallback source, refresh source, gate and fit.

    ``profiles``: platform, provider, outcome, pct_lt_24h, with_timestamp,
    refresh_supported; a handful of rows per platform.
    """
    rated = profiles.withColumn("rating", freshness_rating(F.col("pct_lt_24h"), F.coalesce("with_timestamp", F.lit(0))))
    rank = F.when(F.col("rating") == "GOOD", 3).when(F.col("rating") == "PARTIAL", 2).when(F.col("rating") == "POOR", 1).otherwise(0)
    tested = F.col("outcome") == "TESTED"
    w = Window.partitionBy("platform").orderBy(tested.desc(), rank.desc(), "provider")
    r = rated.withColumn("rn", F.row_number().over(w))

    def nth(i: int, c: str) -> Column:
        return F.max(F.when((F.col("rn") == i) & tested, F.col(c)))

    g = r.groupBy("platform").agg(
        nth(1, "provider").alias("p1"), nth(1, "rating").alias("r1"), nth(2, "provider").alias("p2"), nth(2, "rating").alias("r2"),
        F.count_if(~tested).alias("untested"), F.min_by("provider", F.when(tested & F.col("refresh_supported"), F.col("rn"))).alias("ref"),
    )
    none, poor = F.col("p1").isNull(), F.col("r1") == "POOR"
    fallback = F.when(F.col("p2").isNotNull() & (F.col("r2") != "POOR"), F.col("p2")).when(F.col("untested") > 0, "INCONCLUSIVE").otherwise("neither")
    return g.select(
        "platform",
        F.when(none, "INCONCLUSIVE").when(poor, "neither").otherwise(F.col("p1")).alias("primary_discovery"),
        F.when(none | poor, "INCONCLUSIVE").otherwise(fallback).alias("fallback"),
        F.when(none, "INCONCLUSIVE").when(poor, F.coalesce("ref", F.lit("INCONCLUSIVE"))).otherwise(F.coalesce("ref", F.lit("neither"))).alias("refresh"),
        F.when(none, "BLOCKED").when(poor, "FAILED").otherwise("PASSED").alias("gate"),
        F.when(none, "UNKNOWN").when(poor, "NO").when(F.col("r1") == "GOOD", "YES").otherwise("PARTIALLY").alias("product_fit"),
    )
