"""Merging normalised observations into posts, snapshots, tags and discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import DEFAULT, Config
from crestline.operators.anchors import fold_anchors, walk_anchors
from crestline.operators.skew import heavy_keys, running_max, with_previous
from crestline.operators.velocity import advance_folds
from crestline.session import materialize

POST_KEY = ["platform", "external_id"]
METRICS = ["views", "likes", "comments", "shares", "saves"]
# Latest wins outright / latest known value wins.
ALWAYS = ["canonical_url", "content_type"]
KNOWN = [
    "creator_username", "creator_external_id", "creator_followers", "creator_verified", "caption", "music_id", "music_title",
    "music_author", "published_at", "duration_sec", "views", "views_metric", "likes", "comments", "shares", "saves",
]


def flat_observations(normalized: DataFrame) -> DataFrame:
    """Accepted normalised rows with flat columns; post ids come from the natural key."""
    key = (F.col("post_platform"), F.col("external_id"))
    keep = [c for c in ("provider", "provider_job_id", "query_text", "query_hashtag_id", "rank_in_results", "market", "source") if c in normalized.columns]
    return normalized.select(
        F.xxhash64(*key).alias("post_id"), F.col("post_platform").alias("platform"), "external_id", "canonical_url", "content_type",
        F.col("creator.username").alias("creator_username"), F.col("creator.external_id").alias("creator_external_id"),
        F.col("creator.followers").alias("creator_followers"), F.col("creator.verified").alias("creator_verified"), "caption", "hashtags",
        F.col("music.id").alias("music_id"), F.col("music.title").alias("music_title"), F.col("music.author").alias("music_author"),
        "published_at", F.col("duration_sec").cast("decimal(10,3)").alias("duration_sec"), "metrics.*", "observed_at", *keep,
    )


def fold_posts(observations: DataFrame, tie: str = "observed_at") -> DataFrame:
    """One row per post from a batch of observations, by map-side-combined aggregates.

    A field and the time it was last known come from one maximum, so a post
    crosses the network with one time per field. At equal times the larger
    value counts.
    """
    at = list(dict.fromkeys(("observed_at", tie)))
    known = [c for c in KNOWN if c in observations.columns]
    newest = [F.max(F.when(F.col(c).isNotNull(), F.struct(*at, c))).alias(f"_{c}") for c in known]
    rows = observations.groupBy("post_id", *POST_KEY).agg(F.max(F.struct(*at, *ALWAYS)).alias("_last"), *newest, F.min("observed_at").alias("first_seen_at"))
    # When each field was last known, so that later merges can decide field by field.
    last = F.col("_last.observed_at")
    times = [F.col(f"_{c}.observed_at") for c in known] + [last for _ in ALWAYS]
    return rows.select(
        "post_id", *POST_KEY, *[F.col(f"_last.{c}").alias(c) for c in ALWAYS], *[F.col(f"_{c}.{c}").alias(c) for c in known],
        F.map_from_arrays(F.array(*[F.lit(c) for c in (*known, *ALWAYS)]), F.array(*times)).alias("known_at"), "first_seen_at", last.alias("last_seen_at"),
    )


def merge_posts(stored: DataFrame, batch: DataFrame, market: str = "global") -> DataFrame:
    """Posts after a folded batch: first_seen kept, known values never lost.

    Every field keeps the value that was known last, whatever the order of the
    batches: ``known_at`` holds the time of each. A stored row without that
    column, or without a time for a field, counts with its last_seen_at.
    """
    new = batch.select(*POST_KEY, *[F.col(c).alias(f"n_{c}") for c in batch.columns if c not in POST_KEY])
    j = stored.join(new, POST_KEY, "full_outer")
    timed = "known_at" in stored.columns

    def newer(c: str) -> Column:
        old = F.coalesce(F.col("known_at")[c], "last_seen_at") if timed else F.col("last_seen_at")
        return F.col("last_seen_at").isNull() | F.col(c).isNull() | (F.col("n_known_at")[c] >= old)

    cols = []
    for f in stored.schema.fields:
        c, n = f.name, f"n_{f.name}"
        if c in POST_KEY:
            cols.append(F.col(c))
        elif c == "first_seen_at":
            cols.append(F.least(c, n).alias(c))
        elif c == "last_seen_at":
            cols.append(F.greatest(c, n).alias(c))
        elif c == "known_at":
            none = F.create_map().cast("map<string,timestamp>")
            cols.append(F.map_zip_with(F.coalesce(c, none), F.coalesce(n, none), lambda _, x, y: F.greatest(x, y)).alias(c))
        elif c in ("market", "availability", "paid_refresh_count"):
            first = {"market": market, "availability": "ACTIVE", "paid_refresh_count": 0}[c]
            cols.append(F.coalesce(c, F.lit(first)).alias(c))
        elif c in KNOWN or c in ALWAYS:
            if n not in j.columns:
                cols.append(F.col(c))
            else:
                cols.append(F.when(newer(c), F.coalesce(n, c)).otherwise(F.coalesce(c, n)).cast(f.dataType).alias(c))
        elif n in j.columns:
            cols.append(F.coalesce(c, n).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


# --- snapshots ----------------------------------------------------------------------

def _same(a: str = "", b: str = "prev_") -> Column:
    out = F.lit(True)
    for m in METRICS:
        out = out & F.col(f"{a}{m}").eqNullSafe(F.col(f"{b}{m}"))
    return out


def dedup_snapshots(snapshots: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Drop a snapshot equal in all metrics to the newest kept one within the window.

    Rows are ordered by observed_at per post. A row that differs from its
    predecessor, or lies further from it than the window, is always kept, so it
    starts a stretch; inside a stretch the walk keeps a row once it is further
    than the window from the last kept row. Stretches shorter than the window
    keep only their first row and need no walk. Time-equal duplicates with the
    same metrics collapse.
    """
    gap = int(cfg.dedup_minutes * 60_000_000)
    cols = snapshots.columns
    rows = snapshots.withColumn("_t", F.unix_micros("observed_at"))
    tie = F.xxhash64(*[F.coalesce(F.col(m).cast("string"), F.lit("")) for m in METRICS])
    rows = rows.withColumn("_h", tie)
    order = ["_t", "_h"]
    if heavy_keys(rows, ["post_id"], cfg.max_group_rows) is None:
        w = Window.partitionBy("post_id").orderBy(*order)
        rows = rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("_t", *METRICS)})
        rows = rows.withColumn("_start", _starts(gap))
        rows = rows.withColumn("_from", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = rows.withColumn("_chunk", F.floor(F.col("_t") / 60_000_000))
        rows = with_previous(rows, ["post_id"], order, METRICS, "_chunk").drop("prev__h")
        rows = rows.withColumn("_start", _starts(gap))
        rows = running_max(rows, ["post_id"], order, "_start", "_from", "_chunk")
    # Read twice at least: the ordered rows are not sorted anew each time.
    rows = materialize(rows, "stretches")
    first = F.col("_start").isNotNull()
    far = (F.col("_t") - F.col("_from")) > gap
    kept = rows.where(first)
    maybe = rows.where(~first & far)
    stretch = ["post_id", "_from"]
    # Stretches that outlast the window: walk all their rows from the start.
    if maybe.isEmpty():
        return kept.select(*cols)
    long_ones = maybe.select(*stretch).distinct()
    inner = rows.where(~first).join(long_ones, stretch, "left_semi")
    keep_t = _walked(inner, stretch, gap, cfg)
    w = Window.partitionBy(*stretch, "_t").orderBy("_h")
    later = inner.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(keep_t, [*stretch, "_t"], "left_semi")
    return kept.select(*cols).unionByName(later.select(*cols))


def _starts(gap: int) -> Column:
    fresh = F.col("prev__t").isNull() | ~_same() | ((F.col("_t") - F.col("prev__t")) > gap)
    return F.when(fresh, F.col("_t"))


def _walked(inner: DataFrame, stretch: list[str], gap: int, cfg: Config) -> DataFrame:
    """(stretch, _t) of rows kept after each stretch's first row."""
    pts = inner.select(*stretch, F.col("_t").alias("t"), F.lit(0).cast("bigint").alias("v")).distinct()
    if heavy_keys(pts, stretch, cfg.max_group_rows) is None:
        arr = pts.groupBy(*stretch).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("pts"))
        start = F.struct(F.col("_from").alias("t"), F.lit(0).cast("bigint").alias("v"))
        kept = arr.select(*stretch, fold_anchors(F.col("pts"), start, gap, strict=True).alias("a"))
        kept = kept.select(*stretch, F.explode(F.slice("a", F.lit(2), F.size("a"))).alias("a"))
        return kept.select(*stretch, F.col("a.t").alias("_t"))
    starts = pts.select(*stretch).distinct().withColumn("t", F.col("_from"))
    return walk_anchors(pts, starts, stretch, gap, strict=True).select(*stretch, F.col("t").alias("_t"))


def newest_snapshots(snapshots: DataFrame) -> DataFrame:
    """(post_id, newest): the last snapshot of every post."""
    return snapshots.groupBy("post_id").agg(F.max_by(F.struct("observed_at", *METRICS), "observed_at").alias("newest"))


def new_snapshots(stored: DataFrame, batch: DataFrame, cfg: Config = DEFAULT, newest: DataFrame | None = None) -> DataFrame:
    """Batch snapshots to append, judged against each post's newest stored row.

    ``newest`` (post_id, newest) spares the search of the stored history.
    """
    if newest is None:
        newest = newest_snapshots(stored.join(batch.select("post_id").distinct(), "post_id", "left_semi"))
    old = newest.where("newest is not null").select("post_id", "newest.*").withColumn("_old", F.lit(True))
    both = batch.withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True)
    kept = dedup_snapshots(both, cfg).where("not _old").select(*batch.columns)
    # A row stored already (same instant, same metrics) is not appended again.
    at = ["post_id", "observed_at"]
    near = batch.select(*at).distinct()
    if "observed_date" in stored.columns:  # lets the join prune date partitions
        near = near.withColumn("observed_date", F.to_date("observed_at"))
    twins = stored.join(near, near.columns, "left_semi").select(*[F.col(c).alias(f"s_{c}") for c in (*at, *METRICS)])
    equal = (F.col("post_id") == F.col("s_post_id")) & (F.col("observed_at") == F.col("s_observed_at")) & _same("", "s_")
    return kept.join(twins.hint("merge"), equal, "left_anti")


# --- tags and discoveries -------------------------------------------------------------

def observed_tags(observations: DataFrame) -> DataFrame:
    return observations.select("post_id", "observed_at", F.posexplode("hashtags").alias("position", "name")).withColumn(
        "hashtag_id", F.xxhash64("name")
    )


def merge_hashtags(stored: DataFrame, batch_tags: DataFrame) -> DataFrame:
    """Tag dimension after a batch: first_seen kept, last_seen advanced."""
    new = batch_tags.groupBy("hashtag_id", "name").agg(F.min("observed_at").alias("n_first"), F.max("observed_at").alias("n_last"))
    j = stored.join(new.withColumnRenamed("hashtag_id", "n_id"), "name", "full_outer")
    no = F.lit(False)
    return j.select(
        F.coalesce("hashtag_id", "n_id").alias("hashtag_id"), "name", F.coalesce("is_generic", no).alias("is_generic"),
        F.coalesce("is_blocked", no).alias("is_blocked"), F.least("first_seen_at", "n_first").alias("first_seen_at"),
        F.greatest("last_seen_at", "n_last").alias("last_seen_at"),
    )


def new_post_tags(stored: DataFrame, batch_tags: DataFrame) -> DataFrame:
    """(post_id, hashtag_id, position) rows to append; stored links stay as they are."""
    key = ["post_id", "hashtag_id"]
    first = batch_tags.groupBy(*key).agg(F.min_by("position", F.struct("observed_at", "position")).alias("position"))
    return first.join(stored.select(*key).hint("merge"), key, "left_anti")


def new_discoveries(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """First row per (post, job) that is not stored yet."""
    key = ["post_id", "provider_job_id"]
    order = F.struct("observed_at", F.coalesce("rank_in_results", F.lit(2**31 - 1)))
    rest = [c for c in batch.columns if c not in key]
    first = batch.where("provider_job_id is not null").groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*key, "r.*").join(stored.select(*key).hint("merge"), key, "left_anti").select(*batch.columns)


def observation_effects(stored: dict[str, DataFrame], observations: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """All table changes of one batch but the folds: rows to append, and merged rows of ``posts`` and ``hashtags``.

    The merged rows are those of all keys that ``stored`` holds and of the
    batch's; with the touched rows only (``touched``) they are upserts.
    """
    tags = observed_tags(observations)
    snaps = observations.select("post_id", "observed_at", *METRICS, "views_metric", "source", "provider_job_id")
    disc = observations.where("source = 'DISCOVERY'").select(
        "post_id", "provider_job_id", F.col("query_hashtag_id").alias("hashtag_id"), "query_text", "rank_in_results", "observed_at"
    )
    folds = stored.get("post_folds")
    return {
        "posts": merge_posts(stored["posts"], fold_posts(observations)),
        "post_snapshots": new_snapshots(stored["post_snapshots"], snaps, cfg, None if folds is None else folds.select("post_id", "newest")),
        "hashtags": merge_hashtags(stored["hashtags"], tags),
        "post_hashtags": new_post_tags(stored["post_hashtags"], tags),
        "post_discoveries": new_discoveries(stored["post_discoveries"], disc),
    }


def touched(read, lookup, observations: DataFrame) -> dict[str, DataFrame]:
    """What a batch has to know of the stored tables: keyed tables by their touched buckets, the others as scans.

    ``read(name)`` and ``lookup(name, keys)`` are those of a store or a
    transaction; ``observations`` is a stored table.
    """
    ids = materialize(observations.select("post_id").distinct(), "touched-posts")
    tags = observations.select(F.explode("hashtags").alias("name")).select(F.xxhash64("name").alias("hashtag_id")).distinct()
    rows = {n: read(n) for n in ("post_snapshots", "post_hashtags", "post_discoveries")}
    # Several steps of a batch read the folds: they are looked up once.
    folds = materialize(lookup("post_folds", ids), "touched-folds")
    return {**rows, "posts": lookup("posts", ids), "post_folds": folds, "hashtags": lookup("hashtags", tags)}


def merge_folds(stored: DataFrame, posts: DataFrame, fresh: DataFrame, snapshots: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Velocity folds and newest snapshots of ``posts`` after the snapshots ``fresh``; ``snapshots`` is the stored history."""
    metrics = ["post_id", "observed_at", *METRICS]
    history = snapshots.select(*metrics).unionByName(fresh.select(*metrics))
    folds = advance_folds(stored, posts, fresh, history, cfg)
    last = newest_snapshots(fresh).withColumnRenamed("newest", "_new")
    old = stored.select("post_id", "newest")
    later = F.col("newest").isNull() | (F.col("_new.observed_at") >= F.col("newest.observed_at"))
    joined = folds.join(old.hint("merge"), "post_id", "left").join(last.hint("merge"), "post_id", "left")
    return joined.select("post_id", "published_at", "fold", F.when(F.col("_new").isNotNull() & later, F.col("_new")).otherwise(F.col("newest")).alias("newest"))
