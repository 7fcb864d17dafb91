"""Seed taxonomy and category keyword rules (reference data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.config import CATEGORY_PARENT, PLATFORMS

# Seed tag -> (categories, initial tier).
SEED_TAGS = {
    "cosplay": (["cosplay"], "CORE"),
    "cosplayer": (["cosplay"], "CORE"),
    "cosplaygirl": (["cosplay"], "DORMANT"),
    "cosplayvideo": (["cosplay"], "DORMANT"),
    "animecosplay": (["cosplay"], "DORMANT"),
    "gamingcosplay": (["cosplay", "gaming"], "DORMANT"),
    "streamer": (["streaming"], "CORE"),
    "streaming": (["streaming"], "DORMANT"),
    "twitch": (["streaming"], "DORMANT"),
    "twitchstreamer": (["streaming"], "CORE"),
    "gaming": (["gaming"], "CORE"),
    "gamer": (["gaming"], "DORMANT"),
    "videogames": (["gaming"], "DORMANT"),
    "gameplay": (["gaming"], "DORMANT"),
    "gamingcommunity": (["gaming"], "DORMANT"),
    "pcgaming": (["pc"], "CORE"),
    "pcgamer": (["pc"], "DORMANT"),
    "gamingpc": (["pc"], "DORMANT"),
    "pcbuild": (["pc"], "DORMANT"),
    "steam": (["pc"], "DORMANT"),
    "playstation": (["playstation"], "CORE"),
    "ps5": (["playstation"], "CORE"),
    "playstation5": (["playstation"], "DORMANT"),
    "ps5games": (["playstation"], "DORMANT"),
    "psgaming": (["playstation"], "DORMANT"),
}

# The keywords of each category, matched without case anywhere in a text.
KEYWORDS = {
    "cosplay": ("cosplay",),
    "streaming": ("stream", "twitch", "kick", "live"),
    "playstation": ("ps5", "playstation", "psn", "dualsense"),
    "pc": ("pcgaming", "pcgamer", "pcbuild", "pcsetup", "pcmaster", "steam", "rtx", "nvidia", "gamingpc"),
    "gaming": ("game", "gamer", "gaming", "gameplay", "videogame"),
}


def seed_tags(spark: SparkSession) -> DataFrame:
    """(name, categories, initial_tier): a fixed table of 25 rows."""
    rows = [(n, c, t) for n, (c, t) in SEED_TAGS.items()]
    return spark.createDataFrame(rows, "name string, categories array<string>, initial_tier string")


def seed_tracking(spark: SparkSession, existing: DataFrame, market: str) -> DataFrame:
    """Seed rows (name, platform, market, tier, source) still absent from ``existing``."""
    seeds = seed_tags(spark).select(
        "name", F.explode(F.array(*[F.lit(p) for p in PLATFORMS])).alias("platform"), F.lit(market).alias("market"),
        F.col("initial_tier").alias("tier"), F.lit("SEED").alias("source"),
    )
    return seeds.join(existing.select("name", "platform", "market"), ["name", "platform", "market"], "left_anti")


def with_parents(categories):
    """Array column extended by the parents of its members."""
    parents = F.create_map(*[F.lit(x) for kv in CATEGORY_PARENT.items() for x in kv])
    up = F.transform(categories, lambda c: F.try_element_at(parents, c))
    return F.array_distinct(F.concat(categories, F.array_compact(up)))
