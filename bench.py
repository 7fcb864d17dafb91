"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crestline import build_session  # noqa: E402
from crestline.registry import QUERIES  # noqa: E402

HEADLINE = [
    "post_velocity", "scoring_baselines", "scored_posts", "daily_tag_rollup", "daily_trend_backfill", "daily_tag_pairs",
    "merged_tag_edges", "tag_clusters", "post_categories", "lifecycle_decisions", "today_top", "live_views", "run_outcomes",
    "budget_status", "snapshot_dedup", "posts_merge", "normalize_vendor_a_first", "source_freshness", "text_categories_by_keyword",
    "retention_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false", "spark.log.level": "ERROR",
        },
    )
    # One untimed query pays for JVM start-up, as in a long-lived session.
    QUERIES["post_velocity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    scored = QUERIES["scored_posts"](spark, sf_dir).count() if "scored_posts" in times else 0
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if scored:
        line["scored_posts_per_sec"] = round(scored / times["scored_posts"], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
