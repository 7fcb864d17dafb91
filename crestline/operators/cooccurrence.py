"""Tag pairs, Jaccard edges, connected components and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.functions import scalars as S
from crestline.operators.hashtags import is_qualified
from crestline.session import materialize

PAIR_KEY = ["date", "platform", "market", "tag_a", "tag_b"]


def tag_lists(post_tags: DataFrame, hashtags: DataFrame, cfg: Config = DEFAULT, drop_blocked: bool = False) -> DataFrame:
    """(post_id, tags): a post's first plain tags as structs (n, i), sorted by name.

    Only the first ``max_tags_per_post`` distinct tags by (position, name)
    take part; that bound belongs to the operator and caps a post at 45 pairs.
    """
    keep = ~F.col("is_generic")
    if drop_blocked:
        keep = keep & ~F.col("is_blocked")
    named = post_tags.join(hashtags.where(keep).select("hashtag_id", "name"), "hashtag_id")
    w = Window.partitionBy("post_id").orderBy("position", "name")
    first = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cfg.max_tags_per_post)
    return first.groupBy("post_id").agg(
        F.sort_array(F.collect_set(F.struct(F.col("name").alias("n"), F.col("hashtag_id").alias("i")))).alias("tags")
    )


def _pairs(make, tags: str = "tags") -> Column:
    """All a < b pairs of a sorted array as ``make(a, b)``."""
    rest = F.transform(tags, lambda a, i: F.transform(F.slice(tags, i + 2, F.size(tags)), lambda b: make(a, b)))
    return F.flatten(rest)


def post_pairs(lists: DataFrame) -> DataFrame:
    """(post_id, tag_a, tag_b, name_a, name_b): unordered pairs, a < b by name."""
    return lists.select(
        "post_id",
        F.inline(
            _pairs(lambda a, b: F.struct(a["i"].alias("tag_a"), b["i"].alias("tag_b"), a["n"].alias("name_a"), b["n"].alias("name_b")))
        ),
    )


def daily_pairs(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """Pair rows per (date, platform, market): posts, qualified posts, their views.

    Posts join their lists one row each; pairs unfold just below the map-side
    aggregation, so the unfolded rows never cross the network.
    """
    facts = posts.select(
        "post_id", "platform", "market", S.utc_day(F.col("last_seen_at")).alias("date"),
        is_qualified().alias("q"), F.when(is_qualified(), F.col("views")).alias("qv"),
    )
    ids = _pairs(lambda a, b: F.struct(a["i"].alias("tag_a"), b["i"].alias("tag_b")))
    return (
        lists.join(facts, "post_id")
        .select("date", "platform", "market", "q", "qv", F.inline(ids))
        .groupBy(*PAIR_KEY)
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.count_if("q").alias("viral_posts"),
            S.null_if_zero(F.sum("qv")).alias("views_sum"),
        )
    )


def name_counts(posts: DataFrame, lists: DataFrame, pairs: bool = True) -> DataFrame:
    """Counts per (date, platform, market) of every tag (``name_b`` null) and, with ``pairs``, of every pair of plain tags.

    ``lists`` (post_id, tags, plain) has one row per post: all its tag names,
    and those that pair, as of ``plain_names``. Tags and pairs unfold together
    just below one map-side aggregation, so that a post crosses the network
    once, as a row, and what leaves is bounded by the vocabulary.
    """
    facts = posts.select(
        "post_id", "platform", "market", S.utc_day(F.col("last_seen_at")).alias("date"), is_qualified().alias("q"),
        F.coalesce(F.col("tier") == "VIRAL_QUALIFIED", F.lit(False)).alias("top"), F.when(is_qualified(), F.col("views")).alias("qv"),
    )
    made = F.transform("tags", lambda a: F.struct(a.alias("name_a"), F.lit(None).cast("string").alias("name_b")))
    if pairs:
        made = F.concat(made, _pairs(lambda a, b: F.struct(a.alias("name_a"), b.alias("name_b")), "plain"))
    rows = lists.join(facts, "post_id").select("date", "platform", "market", "q", "top", "qv", F.inline(made))
    return rows.groupBy("date", "platform", "market", "name_a", "name_b").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("q").alias("viral_posts"), F.count_if("top").alias("top_posts"), S.null_if_zero(F.sum("qv")).alias("views_sum")
    )


def plain_names(tags: Column, is_plain, cfg: Config = DEFAULT) -> Column:
    """The first plain names of an ordered array of distinct names, sorted: those that take part in pairs."""
    return F.sort_array(F.slice(F.filter(tags, is_plain), 1, cfg.max_tags_per_post))


def neighbours(pairs_daily: DataFrame, hashtag_id, date: Column | None = None) -> DataFrame:
    """Rows of the pair table touching one tag, seen from that tag."""
    src = pairs_daily if date is None else pairs_daily.where(F.col("date") == date)
    out = src.where(F.col("tag_a") == hashtag_id).withColumn("other", F.col("tag_b")).unionByName(
        src.where(F.col("tag_b") == hashtag_id).withColumn("other", F.col("tag_a"))
    )
    return out.drop("tag_a", "tag_b")


def merged_edges(pairs_daily: DataFrame, hashtags: DataFrame) -> DataFrame:
    """Edges summed over platforms, with both tag names."""
    e = pairs_daily.groupBy("market", "date", "tag_a", "tag_b").agg(
        F.sum("posts").alias("posts"), F.sum("viral_posts").alias("viral_posts"), F.sum("views_sum").alias("views_sum")
    )
    a = hashtags.select(F.col("hashtag_id").alias("tag_a"), F.col("name").alias("name_a"))
    b = hashtags.select(F.col("hashtag_id").alias("tag_b"), F.col("name").alias("name_b"))
    return e.join(a, "tag_a", "left").join(b, "tag_b", "left").fillna("", ["name_a", "name_b"])


def tag_totals(daily: DataFrame) -> DataFrame:
    """Per tag and day over platforms: total posts and qualified strength."""
    return daily.groupBy("market", "date", "hashtag_id").agg(
        F.sum("posts_seen").alias("total_posts"),
        F.sum(F.col("viral_posts") + F.col("breakout_posts")).alias("strength"),
    )


def strong_edges(edges: DataFrame, totals: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges that pass the viral and Jaccard bars, of one day or within each value of ``by``."""
    a = totals.select(*by, F.col("hashtag_id").alias("tag_a"), F.col("total_posts").alias("n_a"))
    b = totals.select(*by, F.col("hashtag_id").alias("tag_b"), F.col("total_posts").alias("n_b"))
    kept = edges.where(F.col("viral_posts") >= cfg.cluster_min_viral)
    kept = kept.join(a, [*by, "tag_a"], "left").join(b, [*by, "tag_b"], "left")
    union = F.coalesce("n_a", "posts") + F.coalesce("n_b", "posts") - F.col("posts")
    jac = F.when(union > 0, F.col("posts") / union).otherwise(F.lit(0.0))
    return kept.withColumn("jaccard", jac).where(F.col("jaccard") >= cfg.cluster_min_jaccard).drop("n_a", "n_b")


def _edge_sum(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "tag_a", b: str = "tag_b") -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    Alternating large-star / small-star rounds. A round is a minimum per node
    (combined map-side), stored, and a join back on the node. The edges of hubs,
    nodes that own more than a hundredth of all edges and so at most two hundred,
    take their minimum from a broadcast; only the others are dealt by node. Each
    round's edges are written to the shared folder; the edge set stops changing
    after O(log n) rounds.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    e = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "star",
    )
    last = _edge_sum(e)
    while True:
        e = materialize(_small_star(_large_star(e, last[0]), last[0]), "star")
        now = _edge_sum(e)
        if now == last:
            break
        last = now
    tops = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(tops, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


HUB_SHARE, HUB_LEAST = 100, 1_000


def with_minimum(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with the column m of ``low`` (u, m, degree; a stored table), hubs apart from the rest.

    ``edges`` bounds the sum of degrees to twice itself, and so the number of hubs.
    """
    hubs = F.broadcast(low.where(F.col("degree") > max(HUB_LEAST, edges // HUB_SHARE)).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(low.select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(rest)


def _low(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "low")


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both).withColumn("m", F.least("u", "m"))
    return with_minimum(both, low, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _low(down)
    out = with_minimum(down, low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()


def clusters(edges: DataFrame, totals: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Top clusters of one day's edges, or of each value of ``by``: rank, label, tags, qualified posts, views.

    Tags are ordered by strength then id, both descending; only the shown tags
    are gathered into the list.
    """
    e = strong_edges(edges, totals, cfg, by)
    # A node is a tag within its value of ``by``, so that all values are clustered by one pass.
    e = materialize(e.withColumns({x: F.struct(*by, F.col(x).alias("tag")) for x in ("tag_a", "tag_b")}), "strong-edges")
    comp = materialize(components(e), "components")
    named = e.select(F.col("tag_a").alias("node"), F.col("name_a").alias("name")).union(
        e.select("tag_b", "name_b")
    ).distinct()
    strength = totals.select(F.struct(*by, F.col("hashtag_id").alias("tag")).alias("node"), "strength")
    members = comp.join(named, "node").join(strength, "node", "left").fillna(0, ["strength"])
    w = Window.partitionBy("component").orderBy(F.col("strength").desc(), F.col("node.tag").desc())
    shown = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cfg.cluster_tags)
    lists = shown.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("rn", "name"))).alias("m"))
    sums = (
        e.join(comp.withColumnRenamed("node", "tag_a"), "tag_a")
        .groupBy("component")
        .agg(
            F.sum("viral_posts").alias("qualified_posts"),
            S.null_if_zero(F.coalesce(F.sum("views_sum"), F.lit(0))).alias("views_sum"),
        )
    )
    out = lists.join(sums, "component").select(
        F.element_at("m", 1)["name"].alias("label"),
        F.transform("m", lambda x: x["name"]).alias("tags"),
        "qualified_posts",
        "views_sum",
        F.col("component.tag").alias("component"),
        *[F.col(f"component.{c}").alias(c) for c in by],
    )
    best = (F.col("qualified_posts").desc(), F.col("label"))
    if by:
        ranked = out.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))
        return ranked.where(F.col("cluster_rank") <= cfg.cluster_max)
    top = out.orderBy(*best).limit(cfg.cluster_max)
    return top.withColumn("cluster_rank", F.row_number().over(Window.orderBy(*best)))  # at most cluster_max rows


def related_tags(edges: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Per tag (and ``by``) the strongest partners by shared posts: (hashtag_id, partner, posts, rn)."""
    both = edges.select(*by, F.col("tag_a").alias("hashtag_id"), F.col("name_b").alias("partner"), "posts").union(
        edges.select(*by, "tag_b", "name_a", "posts")
    )
    w = Window.partitionBy(*by, "hashtag_id").orderBy(F.col("posts").desc(), F.col("partner"))
    ranked = both.where("partner <> ''").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= cfg.related_tags)


def related_lists(edges: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return (
        related_tags(edges, cfg)
        .groupBy("hashtag_id")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "partner"))).alias("r"))
        .select("hashtag_id", F.transform("r", lambda x: x["partner"]).alias("related_tags"))
    )
