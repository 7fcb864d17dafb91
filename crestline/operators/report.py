"""Ranked report sections, live views and the frozen daily document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import CATEGORY_PARENT, DEFAULT, PLATFORMS, REPORT_SCHEMA_VERSION, SCORING_VERSION, Config
from crestline.functions import scalars as S
from crestline.operators.hashtags import TAG_KEY
from crestline.session import materialize

SECTION_ORDER = {"TODAY": 0, "STILL_HOT": 1, "RISING_NOW": 2}


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def ranking() -> list[Column]:
    """The six-key total order: scores, speed, reach, recency, then id."""
    return [
        _zero("trend_score").desc(), _zero("rising_score").desc(), _zero("vph").desc(), _zero("views").desc(),
        F.col("published_at").desc(), F.col("post_id").asc(),
    ]


def rising_ranking() -> list[Column]:
    return [_zero("rising_score").desc(), _zero("vph").desc(), F.col("published_at").desc(), F.col("post_id").asc()]


# --- pools --------------------------------------------------------------------------

def report_candidates(posts: DataFrame, market: str, now, cfg: Config = DEFAULT) -> DataFrame:
    since = S.plus_hours(S.as_time(now), -cfg.still_hot_hours)
    return posts.where((F.col("market") == market) & (F.col("published_at") >= since))


def rankable() -> Column:
    tier = F.col("tier")
    good = (tier == "VIRAL_QUALIFIED") | (
        (tier == "EARLY_BREAKOUT") & F.col("velocity_confidence").isin("MEDIUM", "HIGH")
    )
    return F.coalesce(
        (F.col("availability") == "ACTIVE")
        & F.col("content_type").isin("video", "reel")
        & F.coalesce(F.col("trend_state") != "DEAD", F.lit(True))
        & F.col("trend_score").isNotNull()
        & good,
        F.lit(False),
    )


def window_of(now, cfg: Config = DEFAULT) -> Column:
    """TODAY [now-24h, now], STILL_HOT [now-72h, now-24h), else null."""
    now = S.as_time(now)
    p = F.col("published_at")
    start = S.plus_hours(now, -cfg.today_hours)
    return F.when((p >= start) & (p <= now), "TODAY").when(
        (p >= S.plus_hours(now, -cfg.still_hot_hours)) & (p < start), "STILL_HOT"
    )


def pools(candidates: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    return candidates.where(rankable()).withColumn("window", window_of(now, cfg)).where("window is not null")


def creator_of() -> Column:
    """Platform-qualified creator; an unknown one stands for its post alone."""
    known = F.when(F.length("creator_username") > 0, F.col("creator_username"))
    return F.concat_ws(":", "platform", F.coalesce(known, F.concat(F.lit("anon:"), F.col("post_id").cast("string"))))


# --- sections -----------------------------------------------------------------------

def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top rows with their 1-based rank; the ranking window sees only the top."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def today_top(pool: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Best posts with a per-creator cap and a floor per platform.

    Equal to greedy selection because creators never span platforms: cap by
    creator rank, mark each platform's first rows as its floor, then take the
    floor rows and the best of the rest. Each rank filter prunes map-side.
    """
    if cfg.top_platform_floor * len(PLATFORMS) > cfg.top_max:
        raise ValueError("platform floors exceed the list size")
    by_creator = Window.partitionBy(creator_of()).orderBy(*ranking())
    by_platform = Window.partitionBy("platform").orderBy(*ranking())
    capped = pool.withColumn("_c", F.row_number().over(by_creator)).where(F.col("_c") <= cfg.top_per_creator)
    short = capped.withColumn("_p", F.row_number().over(by_platform)).where(F.col("_p") <= cfg.top_max)
    short = short.withColumn("_floor", F.col("_p") <= cfg.top_platform_floor)
    chosen = short.orderBy(F.col("_floor").desc(), *ranking()).limit(cfg.top_max).drop("_c", "_p", "_floor")
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*ranking())))


def still_hot(pool: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    order = [_zero("trend_score").desc(), _zero("rising_score").desc(), F.col("post_id")]
    return ranked(pool, order, cfg.still_hot_max)


def rising_now(pool: DataFrame, limit: int) -> DataFrame:
    """Chosen by the rising order, shown by (rising, id)."""
    top = pool.orderBy(*rising_ranking()).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(_zero("rising_score").desc(), F.col("post_id"))))


def sections(candidates: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """All three sections in one frame with ``section`` and ``rank``; the pool is staged, as each of them reads it."""
    pool = materialize(pools(candidates, now, cfg), "pool")
    today = today_top(pool.where("window = 'TODAY'"), cfg).withColumn("section", F.lit("TODAY"))
    hot = still_hot(pool.where("window = 'STILL_HOT'"), cfg).withColumn("section", F.lit("STILL_HOT"))
    rising = rising_now(pool, cfg.rising_max).withColumn("section", F.lit("RISING_NOW"))
    return today.unionByName(hot).unionByName(rising)


def export_pool(items: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Section rows, one per post (earlier section wins), re-ranked by trend."""
    order = F.create_map(*[F.lit(x) for kv in SECTION_ORDER.items() for x in kv])
    pick = items.groupBy("post_id").agg(
        F.min_by(F.struct(*[c for c in items.columns if c != "post_id"]), order[F.col("section")]).alias("r")
    )
    rows = pick.select("post_id", "r.*").drop("rank")
    out = ranked(rows, [_zero("trend_score").desc(), F.col("post_id")], cfg.export_max)
    return out.withColumn("section", F.lit("EXPORT_ONLY"))


def with_labels(items: DataFrame, post_tags: DataFrame, post_categories: DataFrame) -> DataFrame:
    """Attach tag and category arrays, gathered for the given rows only."""
    ids = items.select("post_id").distinct()
    tags = (
        post_tags.join(ids, "post_id", "left_semi")
        .groupBy("post_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("_t"))
        .select("post_id", F.transform("_t", lambda x: x["name"]).alias("hashtags"))
    )
    cats = post_categories.join(ids, "post_id", "left_semi").groupBy("post_id").agg(
        F.sort_array(F.collect_set("category")).alias("categories")
    )
    none = F.array().cast("array<string>")
    out = items.join(tags, "post_id", "left").join(cats, "post_id", "left")
    return out.withColumns({"hashtags": F.coalesce("hashtags", none), "categories": F.coalesce("categories", none)})


def caption_preview(caption: Column, limit: int) -> Column:
    return F.when(F.length(caption) > limit, F.concat(F.substring(caption, 1, limit), F.lit("…"))).otherwise(caption)


def report_items(items: DataFrame, yesterday_ids: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """The projected report row: caption preview, age, yesterday flag."""
    seen = yesterday_ids.select("post_id").distinct().withColumn("_y", F.lit(True))
    out = items.join(seen, "post_id", "left")
    return out.withColumns(
        {
            "caption_preview": caption_preview(F.col("caption"), cfg.caption_chars),
            "age_hours": S.age_hours(F.col("published_at"), now),
            "in_yesterday_report": F.coalesce("_y", F.lit(False)),
        }
    ).drop("_y")


# --- counts and distributions ---------------------------------------------------------

def report_counts(candidates: DataFrame, now, cfg: Config = DEFAULT) -> DataFrame:
    """One row: viral and early among rankable today posts, watch among all today posts."""
    today = window_of(now, cfg) == "TODAY"
    good = today & rankable()
    return candidates.agg(
        F.count_if(good & (F.col("tier") == "VIRAL_QUALIFIED")).alias("viral_qualified"),
        F.count_if(good & (F.col("tier") == "EARLY_BREAKOUT")).alias("early_breakout"),
        F.count_if(today & (F.col("tier") == "WATCH")).alias("watch"),
    )


def platform_distribution(today_pool: DataFrame) -> DataFrame:
    """Counts per platform, zero rows included."""
    names = today_pool.sparkSession.createDataFrame([(p,) for p in PLATFORMS], "platform string")
    got = today_pool.groupBy("platform").agg(F.count(F.lit(1)).alias("posts"))
    return names.join(got, "platform", "left").fillna(0, ["posts"])


def category_distribution(today_pool: DataFrame, post_categories: DataFrame) -> DataFrame:
    cats = post_categories.select("post_id", "category").distinct()
    return today_pool.select("post_id").join(cats, "post_id").groupBy("category").agg(F.count(F.lit(1)).alias("posts"))


def cluster_samples(clusters: DataFrame, items: DataFrame, cfg: Config = DEFAULT, limit: int = 5) -> DataFrame:
    """(cluster_rank, position, section, rank): first items sharing a shown tag.

    Clusters (<= 10 rows) and items (<= 45 rows) are both cut lists.
    """
    order = F.create_map(*[F.lit(x) for kv in SECTION_ORDER.items() for x in kv])
    shown = clusters.select("cluster_rank", F.explode("tags").alias("tag"))
    tagged = items.where("section <> 'RISING_NOW'").select("section", "rank", F.explode("hashtags").alias("tag"))
    hit = tagged.join(shown, "tag").select("cluster_rank", "section", "rank").distinct()
    w = Window.partitionBy("cluster_rank").orderBy(order[F.col("section")], "rank")
    return hit.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


# --- tags in the report ----------------------------------------------------------------

def tag_items(tracked: DataFrame, today_stats: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Tracked tags with today's stats (zeros when absent)."""
    stats = today_stats.select(*TAG_KEY, "posts_seen", "viral_posts", "breakout_posts", "distinct_creators", "median_vph")
    out = tracked.select("tracked_id", *TAG_KEY, F.col("name").alias("tag"), "trend_state", "momentum").join(stats, TAG_KEY, "left")
    zero = F.lit(0)
    out = out.select(
        "tracked_id", *TAG_KEY, "tag", "trend_state",
        F.coalesce("posts_seen", zero).alias("seen_posts"),
        (F.coalesce("viral_posts", zero) + F.coalesce("breakout_posts", zero)).alias("qualified_posts"),
        F.coalesce("distinct_creators", zero).alias("distinct_creators"),
        "median_vph", "momentum",
    )
    if related is None:
        return out
    return out.join(related, "hashtag_id", "left").withColumn(
        "related_tags", F.coalesce("related_tags", F.array().cast("array<string>"))
    )


def tag_sections(items: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """BREAKOUT, RISING and TOP sections with ranks."""
    order = [F.col("qualified_posts").desc(), F.col("seen_posts").desc(), F.col("tag"), F.col("platform")]
    parts = [
        ranked(src, order, cfg.section_max).withColumn("section", F.lit(name))
        for name, src in (
            ("BREAKOUT", items.where("trend_state = 'BREAKOUT'")),
            ("RISING", items.where("trend_state = 'RISING'")),
            ("TOP", items),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tier_event_tags(events: DataFrame, tracked: DataFrame, market: str, start: Column, end: Column) -> DataFrame:
    """(kind, tag): distinct newly tracked and demoted names in [start, end)."""
    rows = events.where((F.col("at") >= start) & (F.col("at") < end)).join(
        tracked.where(F.col("market") == market).select("tracked_id", "name"), "tracked_id"
    )
    kind = F.when(F.col("from_tier").isNull(), "NEW").when(F.col("to_tier") == "DORMANT", "DEMOTED")
    return rows.select(kind.alias("kind"), F.col("name").alias("tag")).where("kind is not null").distinct()


# --- collection facts --------------------------------------------------------------------

def collection_summary(
    runs: DataFrame, jobs: DataFrame, posts: DataFrame, snapshots: DataFrame, tracked: DataFrame, market: str, start: Column, end: Column
) -> DataFrame:
    """One row of collection facts for [start, end)."""

    def inside(c: str) -> Column:
        return (F.col(c) >= start) & (F.col(c) < end)

    in_runs = runs.where(inside("planned_at"))
    r = in_runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "FAILED").alias("runs_failed"),
        F.count_if(F.col("status") == "PARTIAL").alias("runs_partial"),
    )
    n = F.coalesce("records_returned", F.lit(0))
    j = jobs.join(in_runs.select("run_id"), "run_id", "left_semi").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("posts_scanned"),
        *[F.coalesce(F.sum(F.when(F.col("platform") == p, n)), F.lit(0)).alias(f"scanned_{p}") for p in PLATFORMS],
    )
    s = snapshots.where(inside("observed_at")).agg(
        F.count_distinct("post_id").alias("unique_posts"), F.count(F.lit(1)).alias("snapshots")
    )
    p = posts.where((F.col("market") == market) & inside("first_seen_at")).agg(F.count(F.lit(1)).alias("new_posts"))
    t = tracked.where((F.col("market") == market) & inside("last_scanned_at")).agg(
        F.count_distinct("tracked_id").alias("tags_scanned")
    )
    u = jobs.where(F.col("submitted_at") >= start).agg(
        F.coalesce(F.sum("records_returned"), F.lit(0)).alias("records_used"),
        F.coalesce(F.sum("cost_est_usd"), F.lit(0).cast("decimal(12,6)")).alias("est_cost_usd"),
    )
    out = r
    for one in (j, s, p, t, u):
        out = out.crossJoin(one)  # every side is a single row
    return out


def platform_outcomes(runs: DataFrame, jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    ids = runs.where((F.col("planned_at") >= start) & (F.col("planned_at") < end)).select("run_id")
    got = jobs.join(ids, "run_id", "left_semi").groupBy("platform").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin("FAILED", "TIMED_OUT")).alias("failed")
    )
    names = jobs.sparkSession.createDataFrame([(p,) for p in PLATFORMS], "platform string")
    return names.join(got, "platform", "left").fillna(0, ["jobs", "failed"])


def unfinished_runs(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: does any run of the window still wait or run?"""
    inside = (F.col("planned_at") >= start) & (F.col("planned_at") < end)
    return runs.where(inside).agg(
        F.coalesce(F.bool_or(F.col("status").isin("PLANNED", "RUNNING")), F.lit(False)).alias("unfinished")
    )


def partial_reasons(outcomes: DataFrame, unfinished: DataFrame, budget: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row: reasons array (distinct, in order) and COMPLETE/PARTIAL."""
    wide = outcomes.agg(
        *[F.max(F.when(F.col("platform") == p, F.col(c))).alias(f"{p}_{c}") for p in PLATFORMS for c in ("jobs", "failed")]
    )
    one = wide.crossJoin(unfinished).crossJoin(budget.select("monthly_usd_exceeded"))  # single rows
    reasons = [F.lit(x) for x in (extra or [])]
    for p in PLATFORMS:
        jobs, failed = F.col(f"{p}_jobs"), F.col(f"{p}_failed")
        reasons.append(
            F.when((jobs > 0) & (failed == jobs), f"{p}:discovery_failed").when(failed > 0, f"{p}:discovery_partial")
        )
    reasons.append(F.when(F.col("unfinished"), "collection:unfinished_jobs"))
    reasons.append(F.when(F.col("monthly_usd_exceeded"), "collection:budget_exhausted"))
    arr = F.array_distinct(F.array_compact(F.array(*reasons)))
    return one.select(arr.alias("partial_reasons"), F.when(F.size(arr) > 0, "PARTIAL").otherwise("COMPLETE").alias("status"))


def compare_metric(current: Column, previous: Column) -> tuple[Column, Column]:
    """(delta, percent); null without a previous value, percent null on zero."""
    delta = current - previous
    return delta, F.when(previous != 0, delta / previous * 100)


def versus_previous(counts: DataFrame, previous: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, current, previous, delta, pct) rows; ``previous`` has 0 or 1 row."""
    prev = previous.select(*[F.col(m).alias(f"p_{m}") for m in metrics])
    one = counts.select(*metrics).join(prev, F.lit(True), "left")  # single rows
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("current"), F.col(f"p_{m}").cast("bigint").alias("previous")) for m in metrics]
    )
    out = one.select(F.inline(rows))
    delta, pct = compare_metric(F.col("current"), F.col("previous"))
    return out.withColumns({"delta": delta, "pct": pct})


def report_date(now, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(S.as_time(now), zone), "yyyy-MM-dd")


# --- the frozen document -----------------------------------------------------------------

ITEM_FIELDS = [
    "rank", "post_id", "platform", "canonical_url", "external_id", "creator_username", "caption_preview", "hashtags",
    "categories", "published_at", "age_hours", "views", "likes", "comments", "shares", "vph", "vph_kind",
    "velocity_confidence", "trend_score", "rising_score", "trend_state", "tier", "in_yesterday_report", "score_components",
]
TAG_FIELDS = ["rank", "tag", "platform", "trend_state", "seen_posts", "qualified_posts", "distinct_creators", "median_vph", "momentum", "related_tags"]
_COMPONENT = "component:string,available:boolean,raw:double,z:double,normalized:double,weight_configured:double,weight_used:double"


def _explained(items: DataFrame) -> DataFrame:
    """``score_components`` as one list per score; null for posts that were not scored with them."""
    kind = f"struct<trend:array<struct<{_COMPONENT}>>,rising:array<struct<{_COMPONENT}>>>"
    if "score_components" not in items.columns:
        return items.withColumn("score_components", F.lit(None).cast(kind))
    names = [f.split(":")[0] for f in _COMPONENT.split(",")]

    def of(name: str) -> Column:
        own = F.filter("score_components", lambda x: x["score"] == name)
        return F.transform(own, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(name)

    return items.withColumn("score_components", F.when(F.col("score_components").isNotNull(), F.struct(of("trend"), of("rising"))).cast(kind))


def _gathered(df: DataFrame, fields: list[str], key: str, name: str, names: list[str]) -> DataFrame:
    """One row with an array per section; sections are already cut to size."""
    item = F.struct(*fields)
    return df.agg(*[F.sort_array(F.collect_list(F.when(F.col(key) == s, item))).alias(f"{name}_{s.lower()}") for s in names])


def assemble_report(
    *, now, zone: str, market: str, items: DataFrame, export: DataFrame, tags: DataFrame, tier_tags: DataFrame,
    clusters: DataFrame, samples: DataFrame, counts: DataFrame, platforms: DataFrame, categories: DataFrame,
    collection: DataFrame, reasons: DataFrame, comparison: DataFrame, cfg: Config = DEFAULT,
) -> DataFrame:
    """One nested row; every list in it is a section with a fixed maximum."""
    now = S.as_time(now)
    items, export = _explained(items), _explained(export)
    if "related_tags" not in tags.columns:
        tags = tags.withColumn("related_tags", F.array().cast("array<string>"))
    body = _gathered(items, ITEM_FIELDS, "section", "items", ["TODAY", "STILL_HOT", "RISING_NOW"])
    exp = export.agg(F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("export_candidates"))
    tag = _gathered(tags, TAG_FIELDS, "section", "hashtags", ["BREAKOUT", "RISING", "TOP"])
    moved = tier_tags.agg(
        *[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("tag")))).alias(n) for k, n in (("NEW", "newly_tracked"), ("DEMOTED", "demoted"))]
    )
    sample = samples.groupBy("cluster_rank").agg(F.sort_array(F.collect_list(F.struct("position", "rank"))).alias("s"))
    cl = clusters.join(sample, "cluster_rank", "left").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "cluster_rank", "label", "tags", "qualified_posts", "views_sum",
                    F.coalesce(F.transform("s", lambda x: x["rank"]), F.array().cast("array<int>")).alias("sample_ranks"),
                )
            )
        ).alias("clusters")
    )

    def as_map(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "posts")))).alias(name))

    comp = comparison.agg(F.sort_array(F.collect_list(F.struct("metric", "current", "previous", "delta"))).alias("vs_yesterday"))
    out = body
    for part in (
        exp, tag, moved, cl, counts.select(F.struct("*").alias("counts")), as_map(platforms, "platform", "by_platform"),
        as_map(categories, "category", "by_category"), collection.select(F.struct("*").alias("collection")), reasons, comp,
    ):
        out = out.crossJoin(part)  # single rows
    return out.select(
        F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"), F.lit(SCORING_VERSION).alias("scoring_version"),
        report_date(now, zone).alias("report_date"), F.lit(zone).alias("timezone"), F.lit(market).alias("market"),
        now.alias("generated_at"), S.plus_hours(now, -cfg.today_hours).alias("window_start"), now.alias("window_end"),
        "status", "partial_reasons", "collection", "counts", "by_platform", "by_category", "items_today", "items_still_hot",
        "items_rising_now", "hashtags_breakout", "hashtags_rising", "hashtags_top", "newly_tracked", "demoted", "clusters",
        "vs_yesterday", "export_candidates",
    )


def freeze_report(stored: DataFrame, report: DataFrame) -> DataFrame:
    """Rows to write: a delivered (date, market) is never replaced."""
    done = stored.where("delivered_at is not null").select("report_date", "market")
    return report.join(done, ["report_date", "market"], "left_anti")


# --- live views --------------------------------------------------------------------------

def live_view(
    candidates: DataFrame, now, mode: str = "trend", platform: str | None = None, category: str | None = None,
    post_categories: DataFrame | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """Top list over the rankable pool, filtered by platform and category (children roll up)."""
    pool = candidates.where(rankable())
    if platform:
        pool = pool.where(F.col("platform") == platform)
    if category:
        wanted = [category, *[c for c, parent in CATEGORY_PARENT.items() if parent == category]]
        ids = post_categories.where(F.col("category").isin(wanted)).select("post_id")
        pool = pool.join(ids, "post_id", "left_semi")
    if mode == "rising":
        age = S.hours_between(F.col("published_at"), S.as_time(now))
        return rising_now(pool.where(age <= cfg.live_rising_hours), cfg.live_max)
    return ranked(pool, ranking(), cfg.live_max)


def freeze_view(items: DataFrame, view_id: str, kind: str, now, cfg: Config = DEFAULT) -> DataFrame:
    now = S.as_time(now)
    return items.select(
        F.lit(view_id).alias("view_id"), F.lit(kind).alias("kind"), "rank", "post_id", now.alias("created_at"),
        S.plus_hours(now, 24.0 * cfg.view_ttl_days).alias("expires_at"),
    )


def view_page(views: DataFrame, view_id: str, page: int, now, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of one page (clamped to the last) of a view that has not expired."""
    live = views.where((F.col("view_id") == view_id) & (F.col("expires_at") > S.as_time(now)))
    total = live.agg(F.greatest(F.ceil(F.count(F.lit(1)) / cfg.page_size), F.lit(1)).alias("pages"))
    at = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages"))
    rows = live.crossJoin(total).withColumns({"page": at, "total_pages": F.col("pages")}).drop("pages")
    return rows.where((F.col("rank") > (F.col("page") - 1) * cfg.page_size) & (F.col("rank") <= F.col("page") * cfg.page_size))


def theme_summary(clusters: DataFrame, samples: DataFrame, tag_rows: DataFrame, top_clusters: int = 5, top_tags: int = 8) -> DataFrame:
    """(kind, position, label, detail): leading clusters with sample ranks, then leading tags."""
    s = samples.groupBy("cluster_rank").agg(F.sort_array(F.collect_list(F.struct("position", "rank"))).alias("s"))
    c = clusters.where(F.col("cluster_rank") <= top_clusters).join(s, "cluster_rank", "left").select(
        F.lit("cluster").alias("kind"), F.col("cluster_rank").alias("position"), "label",
        F.concat_ws(",", F.transform("s", lambda x: x["rank"].cast("string"))).alias("detail"),
    )
    order = [F.when(F.col("section") == "BREAKOUT", 0).otherwise(1), F.col("rank")]
    t = tag_rows.where("section in ('BREAKOUT', 'RISING')").orderBy(*order).limit(top_tags)
    t = t.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return c.unionByName(t.select(F.lit("tag").alias("kind"), "position", F.col("tag").alias("label"), F.col("platform").alias("detail")))
