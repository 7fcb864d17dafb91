"""The frozen daily report from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators import cooccurrence as X
from crestline.operators import report as R
from crestline.operators.planning import budget_status
from crestline.session import materialize
from crestline.sources.lookups import previous_report
from crestline.sources.tables import Store

METRICS = ["viral_qualified", "early_breakout", "posts_scanned"]


def build_report(
    store: Store, runs: DataFrame, jobs: DataFrame, reports: DataFrame | None, now, zone: str = "UTC", market: str = "global",
    profile: str = "LEAN", extra_reasons: list[str] | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """One nested row. ``reports``: frozen documents of earlier days, if any."""
    now = S.as_time(now)
    start, day = S.plus_hours(now, -cfg.today_hours), S.utc_day(now)
    posts, tags, bridge = store.read("posts"), store.read("hashtags"), store.read("post_hashtags")
    tracked = store.read("tracked_hashtags").join(tags.select("hashtag_id", "name"), "hashtag_id")
    named = bridge.join(tags.select("hashtag_id", "name"), "hashtag_id")
    cats = store.read("post_categories")
    # The 72-hour pool feeds every section: staged once, then cut lists only.
    cands = materialize(R.report_candidates(posts, market, now, cfg), "candidates")
    today = R.pools(cands, now, cfg).where("window = 'TODAY'")

    prev = None if reports is None else materialize(previous_report(reports, R.report_date(now, zone), market), "previous")
    seen = cands.select("post_id").limit(0) if prev is None else prev.select(
        F.explode(F.concat("items_today", "items_still_hot")).alias("i")
    ).select("i.post_id")
    items = R.report_items(R.with_labels(R.sections(cands, now, cfg), named, cats), seen, now, cfg)
    items = materialize(items, "items")

    pairs = store.read("hashtag_cooccurrence_daily").where((F.col("market") == market) & (F.col("date") == day))
    daily = store.read("hashtag_daily_stats").where((F.col("market") == market) & (F.col("date") == day))
    edges = X.merged_edges(pairs, tags)
    clusters = materialize(X.clusters(edges, X.tag_totals(daily), cfg), "clusters")
    tag_rows = R.tag_sections(
        R.tag_items(tracked.where(F.col("market") == market), daily, X.related_lists(edges, cfg)), cfg
    )
    collection = R.collection_summary(runs, jobs, posts, store.read("post_snapshots"), tracked, market, start, now)
    collection = materialize(collection, "collection")
    counts = R.report_counts(cands, now, cfg)
    current = counts.crossJoin(collection.select("posts_scanned"))  # single rows
    before = _previous_metrics(prev, current)
    reasons = R.partial_reasons(
        R.platform_outcomes(runs, jobs, start, now), R.unfinished_runs(runs, start, now), budget_status(jobs, now, profile, cfg), extra_reasons
    )
    return R.assemble_report(
        now=now, zone=zone, market=market, items=items, export=R.export_pool(items, cfg), tags=tag_rows,
        tier_tags=R.tier_event_tags(store.read("hashtag_tier_events"), tracked, market, start, now), clusters=clusters,
        samples=R.cluster_samples(clusters, items, cfg), counts=counts, platforms=R.platform_distribution(today),
        categories=R.category_distribution(today, cats), collection=collection, reasons=reasons,
        comparison=R.versus_previous(current, before, METRICS), cfg=cfg,
    )


def _previous_metrics(prev: DataFrame | None, like: DataFrame) -> DataFrame:
    if prev is None:
        return like.limit(0)
    return prev.select("counts.viral_qualified", "counts.early_breakout", "collection.posts_scanned")
