"""Every tunable in one frozen dataclass; pass a modified copy to override."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Names that stored data and other tools share.
PLATFORMS = ("tiktok", "instagram")
PROVIDERS = ("apify", "brightdata")
CONTENT_TYPES = ("video", "reel", "carousel", "image", "unknown")
CATEGORIES = ("cosplay", "streaming", "gaming", "pc", "playstation")
CATEGORY_PARENT = {"pc": "gaming", "playstation": "gaming"}
VIEWS_METRICS = (
    "tt_apify_play_count",
    "tt_brightdata_play_count",
    "ig_apify_video_play_count",
    "ig_apify_video_view_count",
)
BASELINE_METRICS = ("views", "vph", "like_ratio", "comment_ratio", "share_ratio")
COMPONENTS = ("velocity", "reach", "engagement", "freshness", "hashtagMomentum", "acceleration")
QUALIFIED_TIERS = ("VIRAL_QUALIFIED", "EARLY_BREAKOUT")
STATE_RANK = {"DEAD": 0, "NEW": 1, "STABLE": 1, "FALLING": 1, "ACTIVE": 2, "RISING": 3, "BREAKOUT": 4}
REPORT_SCHEMA_VERSION = 1
SCORING_VERSION = 1


def _default_baselines() -> dict[tuple[str, str], tuple[float, float]]:
    # Fixed values: (platform, metric) -> (centre before log1p, MAD on the log scale).
    centres = {
        ("tiktok", "views"): (30_000, 1.2),
        ("instagram", "views"): (15_000, 1.2),
        ("tiktok", "vph"): (2_000, 1.3),
        ("instagram", "vph"): (800, 1.3),
        ("tiktok", "like_ratio"): (0.05, 0.8),
        ("instagram", "like_ratio"): (0.03, 0.8),
        ("tiktok", "comment_ratio"): (0.005, 0.8),
        ("instagram", "comment_ratio"): (0.003, 0.8),
        ("tiktok", "share_ratio"): (0.01, 0.8),
        ("instagram", "share_ratio"): (0.002, 0.8),
    }
    return {k: (math.log1p(c), mad) for k, (c, mad) in centres.items()}


@dataclass(frozen=True)
class Config:
    # windows, hours
    primary_hours: float = 24
    ranking_hours: float = 72
    baseline_hours: float = 168

    # velocity
    min_interval_hours: float = 0.75
    min_estimation_age_hours: float = 1.0
    acceleration_clamp: float = 5.0

    # robust baselines
    cohort_days: int = 7
    cohort_min_views: int = 10_000
    baseline_min_n: int = 50
    z_min: float = -3.0
    z_max: float = 5.0
    mad_scale: float = 1.4826
    default_baselines: dict = field(default_factory=_default_baselines)

    # score components
    freshness_half_life: float = 18.0
    engagement_weights: dict = field(default_factory=lambda: {"like": 0.2, "comment": 0.35, "share": 0.45})
    shrink_hours: float = 48.0
    shrink_min: float = 0.3
    shrink_max: float = 1.0
    trend_weights: dict = field(
        default_factory=lambda: dict(zip(COMPONENTS, (0.35, 0.2, 0.15, 0.15, 0.1, 0.05)))
    )
    rising_weights: dict = field(
        default_factory=lambda: dict(zip(COMPONENTS, (0.5, 0.0, 0.1, 0.2, 0.0, 0.2)))
    )
    momentum_top_k: int = 3

    # post tiers
    early_min_age: float = 0.5
    early_max_age: float = 8.0
    early_min_views: int = 20_000
    early_min_vph: float = 10_000
    early_low_confidence_views: int = 50_000
    viral_min_views: int = 100_000
    viral_max_age: float = 72.0
    watch_max_age: float = 24.0
    watch_min_views: int = 5_000
    watch_min_vph: float = 1_500
    floor_comments: int = 5
    floor_shares: int = 10

    # post trend state
    breakout_max_age: float = 8.0
    breakout_min_rising: int = 70
    rising_min_rising: int = 45
    active_min_trend: int = 45
    stable_min_trend: int = 20
    falling_max_acceleration: float = -0.5
    dead_min_age: float = 72.0
    dead_max_vph: float = 50.0
    hysteresis_hours: float = 3.0
    boost_hours: float = 2.0

    # tag trend
    growth_prior: float = 2.0
    momentum_shrink: float = 2.0
    new_history_days: int = 2
    tag_breakout: tuple = (3, 3, 1.3)
    tag_rising: tuple = (2, 2, 0.5)
    tag_falling: tuple = (1.5, -0.6)
    tag_active_v24: int = 2
    tag_stable: tuple = (1, 3)

    # co-occurrence and clusters
    max_tags_per_post: int = 10
    cluster_max: int = 10
    cluster_min_viral: int = 2
    cluster_min_jaccard: float = 0.15
    cluster_tags: int = 8
    related_tags: int = 5

    # categories
    seed_confidence: float = 1.0
    keyword_confidence: float = 0.9
    query_confidence: float = 0.8
    tag_evidence_min: float = 0.5
    cooccurrence_min_posts: int = 5
    cooccurrence_min_share: float = 0.4

    # lifecycle
    cap_exploration: int = 8
    cap_active: int = 6
    cap_new_per_day: int = 3
    tier_hold_hours: float = 24.0
    candidate_hours: float = 48.0
    candidate_min_posts: int = 2
    candidate_min_creators: int = 2
    candidate_min_length: int = 3
    promote_min_posts: int = 2
    promote_min_creators: int = 2
    demote_min_probes: int = 2
    demote_min_days: float = 4.0
    demote_weak_evals: int = 2
    demote_empty_scans: int = 3
    revival_hours: float = 48.0
    revival_min_posts: int = 3

    # report
    today_hours: float = 24.0
    still_hot_hours: float = 72.0
    top_max: int = 30
    top_per_creator: int = 2
    top_platform_floor: int = 8
    still_hot_max: int = 15
    rising_max: int = 10
    export_max: int = 100
    section_max: int = 10
    caption_chars: int = 300
    live_max: int = 30
    live_rising_hours: float = 24.0
    view_ttl_days: int = 14
    page_size: int = 5

    # collection planning
    discovery_slots: tuple = (5, 13, 21)
    refresh_slots: tuple = (1, 9, 17)
    slot_core: int = 3
    slot_active: int = 2
    slot_rest: int = 1
    batch_headroom: int = 6
    refresh_batch: int = 20
    interval_hours: dict = field(
        default_factory=lambda: {
            "CORE": 48,
            "CORE_TIGHT": 24,
            "ACTIVE": 24,
            "EXPLORATION": 24,
            "DORMANT_SEED": 168,
            "DORMANT_OTHER": 336,
        }
    )
    refresh_max_age: float = 48.0
    refresh_min_views: int = 5_000
    refresh_max_count: int = 3
    refresh_step_hours: float = 6.0
    failed_scan_hours: float = 6.0
    job_max_minutes: dict = field(default_factory=lambda: {"apify": 90, "brightdata": 120})
    max_attempts: int = 2
    usd_per_1k: dict = field(default_factory=lambda: {"apify": "2.3", "brightdata": "1.5"})
    budget_profiles: dict = field(
        default_factory=lambda: {
            "FREE": (220, "1", "1"),
            "LEAN": (360, "10", "4.5"),
            "STANDARD": (1050, "40", "20"),
        }
    )
    stale_minutes: float = 90.0

    # snapshot dedup and retention
    dedup_minutes: float = 5.0
    post_ttl_days: dict = field(
        default_factory=lambda: {"NOISE": 14, "WATCH": 30, "VIRAL_QUALIFIED": 180, "EARLY_BREAKOUT": 180}
    )
    post_ttl_unknown: int = 180
    table_ttl_days: dict = field(
        default_factory=lambda: {
            "post_snapshots": 90,
            "post_discoveries": 30,
            "hashtag_cooccurrence_daily": 60,
            "hashtag_daily_stats": 365,
            "daily_reports": 365,
            "collection_runs": 90,
            "result_views": 14,
            "quarantined_items": 14,
            "telegram_updates": 7,
            "error_events": 30,
        }
    )

    # Groups larger than this leave the one-task path (arrays, exact percentile).
    max_group_rows: int = 200_000


DEFAULT = Config()
