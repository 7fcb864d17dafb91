"""Category evidence for tags and posts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.operators.skew import salted_join
from crestline.sources.taxonomy import KEYWORDS, seed_tags


def keyword_categories(text: Column) -> Column:
    """Array of the categories with a keyword in the text.

    The text is lower-cased once and searched for plain words, which is byte
    comparison; a word that holds another one of its category is not looked for.
    Only A-Z count as letters with case: the Kelvin sign is no k.
    """

    def found(low: Column) -> Column:
        hits = []
        for category, words in KEYWORDS.items():
            least = [w for w in words if not any(x != w and x in w for x in words)]
            hits.append(F.when(reduce(or_, [low.contains(w) for w in least]), F.lit(category)))
        return F.array_compact(F.array(*hits))

    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit(" ")))
    return F.when(text.isNotNull(), F.transform(F.array(low), found)[0])


def _evidence(df: DataFrame, key: list[str], category: Column, confidence: Column, source: str, rank: int) -> DataFrame:
    return df.select(
        *key, category.alias("category"), confidence.cast("double").alias("confidence"),
        F.lit(source).alias("source"), F.lit(rank).alias("_rank"),
    )


def best_evidence(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Highest confidence per (key, category); an earlier source wins ties."""
    best = F.max(F.struct("confidence", (-F.col("_rank")).alias("r"), "source")).alias("b")
    return evidence.groupBy(*key, "category").agg(best).select(*key, "category", "b.confidence", "b.source")


def seed_evidence(hashtags: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    # The seed table has 25 fixed rows.
    hit = hashtags.join(F.broadcast(seed_tags(hashtags.sparkSession)), "name")
    rows = hit.select("hashtag_id", F.explode("categories").alias("category"))
    return _evidence(rows, ["hashtag_id"], F.col("category"), F.lit(cfg.seed_confidence), "SEED", 0)


def keyword_evidence(hashtags: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    rows = hashtags.select("hashtag_id", F.explode(keyword_categories(F.col("name"))).alias("category"))
    return _evidence(rows, ["hashtag_id"], F.col("category"), F.lit(cfg.keyword_confidence), "KEYWORD", 1)


def cooccurrence_evidence(post_tags: DataFrame, known: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Categories a tag inherits from the posts it sits on.

    ``known`` is (hashtag_id, category). Share = posts of the tag with another
    tag of the category / posts of the tag. A post is reduced to at most two
    supporting tags per category (enough to tell "another tag" from "itself"),
    so no pair list is built.
    """
    bridge = post_tags.select("post_id", "hashtag_id")
    per_post = (
        salted_join(bridge, known.select("hashtag_id", "category"), "hashtag_id", "post_id")
        .groupBy("post_id", "category")
        .agg(F.min("hashtag_id").alias("lo"), F.max("hashtag_id").alias("hi"))
    )
    totals = bridge.groupBy("hashtag_id").agg(F.count(F.lit(1)).alias("total_posts"))
    other = (F.col("lo") != F.col("hashtag_id")) | (F.col("hi") != F.col("hashtag_id"))
    hits = bridge.join(per_post, "post_id").where(other).groupBy("hashtag_id", "category").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("total_posts")
    rows = hits.join(totals, "hashtag_id").where(
        (F.col("total_posts") >= cfg.cooccurrence_min_posts) & (share >= cfg.cooccurrence_min_share)
    )
    return _evidence(rows, ["hashtag_id"], F.col("category"), share, "COOCCURRENCE", 2)


def tag_categories(hashtags: DataFrame, post_tags: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(hashtag_id, category, confidence, source) from all evidence."""
    own = seed_evidence(hashtags, cfg).unionByName(keyword_evidence(hashtags, cfg))
    if post_tags is not None:
        known = own.select("hashtag_id", "category").distinct()
        own = own.unionByName(cooccurrence_evidence(post_tags, known, cfg))
    return best_evidence(own, ["hashtag_id"])


def add_missing_categories(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert-if-absent on (hashtag_id, category)."""
    new = fresh.join(stored, ["hashtag_id", "category"], "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def post_categories(
    posts: DataFrame,
    post_tags: DataFrame,
    hashtag_categories: DataFrame,
    discoveries: DataFrame | None = None,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """(post_id, category, confidence, source) from tags, discovery query and caption."""
    key = ["post_id"]
    own = post_tags.select("post_id", "hashtag_id").join(posts.select("post_id"), "post_id", "left_semi")
    strong = hashtag_categories.where(F.col("confidence") >= cfg.tag_evidence_min).select("hashtag_id", "category", "confidence")
    tag = salted_join(own, strong, "hashtag_id", "post_id").groupBy("post_id", "category").agg(F.max("confidence").alias("confidence"))
    ev = _evidence(tag, key, F.col("category"), F.col("confidence"), "TAG", 0)
    if discoveries is not None:
        w = Window.partitionBy("hashtag_id").orderBy(F.col("confidence").desc(), F.col("category"))
        main = hashtag_categories.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        q = discoveries.where("hashtag_id is not null").select("post_id", "hashtag_id").distinct().join(
            main.select("hashtag_id", "category"), "hashtag_id"
        )
        q = q.select("post_id", "category").distinct().join(posts.select("post_id"), "post_id", "left_semi")
        ev = ev.unionByName(_evidence(q, key, F.col("category"), F.lit(cfg.query_confidence), "QUERY", 1))
    caption = posts.select("post_id", F.explode(keyword_categories(F.col("caption"))).alias("category"))
    ev = ev.unionByName(_evidence(caption, key, F.col("category"), F.lit(cfg.keyword_confidence), "KEYWORD", 2))
    return best_evidence(ev, key)


def replace_post_categories(stored: DataFrame, scored_posts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Full replace for the scored posts; rows of other posts stay."""
    kept = stored.join(scored_posts.select("post_id").distinct(), "post_id", "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))
