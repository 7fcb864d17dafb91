"""Queries over posts: eligibility, velocity, baselines, scores, tiers, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.config import DEFAULT as CFG
from crestline.functions import scalars as S
from crestline.operators import baselines as B
from crestline.operators import posts as P
from crestline.operators.velocity import FOLD, advance_folds, post_velocity, velocity_of_folds
from crestline.registry.base import big, compose, cte, out, query, r6
from crestline.registry.model import RANK_SQL, held_sql, model
from crestline.session import materialize

cte("snap", "SELECT post_id, us AS t, min(views) AS v FROM obs WHERE views IS NOT NULL GROUP BY post_id, us")
cte("node", "SELECT post_id, pub_us AS t, true AS birth FROM posts WHERE pub_us IS NOT NULL UNION ALL SELECT post_id, t, false FROM snap")
cte(
    "hop",
    """SELECT n.post_id, n.t, n.birth, min(s.t) AS nt FROM node n JOIN snap s ON s.post_id = n.post_id AND s.t >= n.t + 2700000000
GROUP BY 1, 2, 3""",
)
cte(
    "walk",
    """SELECT post_id, 0 AS i, pub_us AS t, CAST(0 AS BIGINT) AS v, true AS birth FROM posts WHERE pub_us IS NOT NULL
UNION ALL
SELECT w.post_id, w.i + 1, s.t, s.v, false FROM walk w JOIN hop h ON h.post_id = w.post_id AND h.t = w.t AND h.birth = w.birth
JOIN snap s ON s.post_id = h.post_id AND s.t = h.nt""",
)
cte(
    "iv",
    """SELECT post_id, i, greatest(v - pv, 0) / ((t - pt) / 3600000000.0) AS rate, v < pv AS neg FROM (
 SELECT *, lag(v) OVER (PARTITION BY post_id ORDER BY i) AS pv, lag(t) OVER (PARTITION BY post_id ORDER BY i) AS pt FROM walk) WHERE i >= 1""",
)
cte(
    "vel",
    """SELECT p.post_id, CASE WHEN p.pub_us IS NULL OR l.v IS NULL THEN 'NONE' WHEN n >= 2 THEN 'OBSERVED' ELSE 'ESTIMATED' END AS vph_kind,
  CASE WHEN p.pub_us IS NULL OR l.v IS NULL THEN NULL WHEN n >= 1 THEN cur
    ELSE l.v / greatest((p.now_us - p.pub_us) / 3600000000.0, 1.0) END AS vph,
  CASE WHEN n >= 3 THEN prv END AS vph_previous,
  CASE WHEN p.pub_us IS NULL OR l.v IS NULL THEN NULL WHEN n >= 3 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS velocity_confidence,
  coalesce(p.pub_us IS NOT NULL AND l.v IS NOT NULL AND neg, false) AS had_negative_delta
FROM posts p LEFT JOIN (SELECT post_id, max(v) FILTER (WHERE true) AS vmax, arg_max(v, t) AS v FROM snap GROUP BY 1) l USING (post_id)
LEFT JOIN (SELECT post_id, max(i) AS n, arg_max(rate, i) AS cur, bool_or(neg) AS neg FROM iv GROUP BY 1) a USING (post_id)
LEFT JOIN (SELECT x.post_id, x.rate AS prv FROM iv x JOIN (SELECT post_id, max(i) AS m FROM iv GROUP BY 1) y ON x.post_id = y.post_id AND x.i = y.m - 1) b USING (post_id)""",
)
cte(
    "meas",
    """SELECT p.* EXCLUDE (vph), v.* EXCLUDE (post_id), coalesce(greatest(0.0, (now_us - pub_us) / 3600000000.0), 0.0) AS age,
  CASE WHEN velocity_confidence = 'HIGH' AND v.vph_previous > 0 THEN CASE WHEN v.vph = 0 THEN -5.0 ELSE least(5.0, greatest(-5.0, log2(v.vph / v.vph_previous))) END END AS accel,
  CASE WHEN views >= 0 THEN (likes + 1.0) / (views + 1.0) END AS like_ratio, CASE WHEN views >= 0 THEN (comments + 1.0) / (views + 1.0) END AS comment_ratio,
  CASE WHEN views >= 0 THEN (shares + 1.0) / (views + 1.0) END AS share_ratio
FROM posts p JOIN vel v USING (post_id) WHERE last_us >= now_us - 604800000000""",
)
cte(
    "samples",
    """SELECT platform, market, metric, ln(1.0 + greatest(0.0, x)) AS x FROM (
 SELECT platform, market, unnest(['views', 'vph', 'like_ratio', 'comment_ratio', 'share_ratio']) AS metric,
  unnest([CAST(views AS DOUBLE), vph, like_ratio, comment_ratio, share_ratio]) AS x FROM meas
 WHERE first_us >= now_us - 604800000000 AND views >= 10000) WHERE x IS NOT NULL""",
)
cte(
    "grid",
    """SELECT * FROM (VALUES ('tiktok', 'views', 30000.0, 1.2), ('instagram', 'views', 15000.0, 1.2), ('tiktok', 'vph', 2000.0, 1.3), ('instagram', 'vph', 800.0, 1.3),
 ('tiktok', 'like_ratio', 0.05, 0.8), ('instagram', 'like_ratio', 0.03, 0.8), ('tiktok', 'comment_ratio', 0.005, 0.8), ('instagram', 'comment_ratio', 0.003, 0.8),
 ('tiktok', 'share_ratio', 0.01, 0.8), ('instagram', 'share_ratio', 0.002, 0.8)) g(platform, metric, centre, d_mad)""",
)
cte(
    "medians",
    """SELECT platform, market, metric, count(*) AS n, any_value(m) AS median, median(abs(x - m)) AS mad FROM (
 SELECT *, median(x) OVER (PARTITION BY platform, market, metric) AS m FROM samples) GROUP BY 1, 2, 3""",
)
cte(
    "base",
    """SELECT g.platform, k.market, g.metric, coalesce(m.n, 0) AS n, CASE WHEN m.n >= 50 THEN m.median ELSE ln(1.0 + CAST(centre AS DOUBLE)) END AS median,
  CASE WHEN m.n >= 50 THEN m.mad ELSE CAST(d_mad AS DOUBLE) END AS mad, CASE WHEN m.n >= 50 THEN 'COMPUTED' ELSE 'DEFAULT' END AS origin
FROM grid g CROSS JOIN (SELECT DISTINCT market FROM meas) k LEFT JOIN medians m ON m.platform = g.platform AND m.metric = g.metric AND m.market = k.market""",
)
cte(
    "wide",
    "SELECT platform, market, "
    + ", ".join(
        f"max(median) FILTER (WHERE metric = '{m}') AS {m}_m, max(mad) FILTER (WHERE metric = '{m}') AS {m}_d"
        for m in ("views", "vph", "like_ratio", "comment_ratio", "share_ratio")
    )
    + " FROM base GROUP BY 1, 2",
)
cte(
    "tagmom",
    """SELECT post_id, avg(m) AS hashtag_momentum FROM (
 SELECT p.post_id, t.prev_momentum AS m, row_number() OVER (PARTITION BY p.post_id ORDER BY t.prev_momentum DESC, t.hashtag_id) AS rn
 FROM ptags x JOIN tags h ON h.hashtag_id = x.hashtag_id AND NOT h.is_generic AND NOT h.is_blocked
 JOIN posts p ON p.post_id = x.post_id AND p.last_us >= p.now_us - 604800000000
 JOIN tracked t ON t.hashtag_id = x.hashtag_id AND t.platform = p.platform AND t.prev_momentum IS NOT NULL) WHERE rn <= 3 GROUP BY 1""",
)


def z_sql(x: str, m: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {m}_d <= 0 THEN 0.0 ELSE least(5.0, greatest(-3.0, (ln(1.0 + greatest(0.0, {x})) - {m}_m) / (1.4826 * {m}_d))) END"


def weighted_sql(parts) -> str:
    num = " + ".join(f"coalesce({c} * {w}, 0.0)" for c, w in parts if w > 0)
    den = " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE {w} END" for c, w in parts if w > 0)
    return f"(CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END)"


def sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


_comps = [f"c_{k}" for k in ("velocity", "reach", "engagement", "freshness", "momentum", "acceleration")]
cte(
    "comp",
    f"""SELECT *, {sig('zv')} AS sv, CASE WHEN vph_kind = 'ESTIMATED' THEN 0.5 + ({sig('zv')} - 0.5) * least(1.0, greatest(0.3, 1.0 - age / 48.0)) ELSE {sig('zv')} END AS c_velocity,
  {sig('zr')} AS c_reach, {weighted_sql([(sig('zl'), 0.2), (sig('zc'), 0.35), (sig('zs'), 0.45)])} AS c_engagement,
  pow(0.5, age / 18.0) AS c_freshness, hashtag_momentum AS c_momentum, {sig('accel')} AS c_acceleration
FROM (SELECT m.*, t.hashtag_momentum, {z_sql('vph', 'vph')} AS zv, {z_sql('views', 'views')} AS zr, {z_sql('like_ratio', 'like_ratio')} AS zl,
  {z_sql('comment_ratio', 'comment_ratio')} AS zc, {z_sql('share_ratio', 'share_ratio')} AS zs
  FROM meas m JOIN wide USING (platform, market) LEFT JOIN tagmom t USING (post_id))""",
)
TREND = list(zip(_comps, (0.35, 0.2, 0.15, 0.15, 0.1, 0.05)))
RISING = list(zip(_comps, (0.5, 0.0, 0.1, 0.2, 0.0, 0.2)))


def score_sql(parts) -> str:
    return f"CAST(floor(100.0 * least(1.0, greatest(0.0, {weighted_sql(parts)})) + 0.5) AS BIGINT)"


cte("scored0", f"SELECT *, {score_sql(TREND)} AS trend_score, {score_sql(RISING)} AS rising_score FROM comp")
_floor = "(comments IS NULL AND shares IS NULL OR coalesce(comments >= 5, false) OR coalesce(shares >= 10, false))"
_early = f"(age BETWEEN 0.5 AND 8 AND views >= 20000 AND coalesce(vph, 0) >= 10000 AND (coalesce(velocity_confidence IN ('HIGH', 'MEDIUM'), false) OR views >= 50000) AND {_floor})"
_ok = "(views IS NOT NULL AND pub_us IS NOT NULL AND content_type IN ('video', 'reel', 'carousel') AND availability = 'ACTIVE')"
cte(
    "scored1",
    f"""SELECT * EXCLUDE (tier), CASE WHEN {_ok} THEN CASE WHEN views >= 100000 AND age <= 72 THEN 'VIRAL_QUALIFIED' WHEN {_early} THEN 'EARLY_BREAKOUT'
   WHEN age <= 24 AND views >= 5000 AND coalesce(vph, 0) >= 1500 THEN 'WATCH' ELSE 'NOISE' END END AS tier,
  coalesce({_ok} AND {_early}, false) AS is_early_breakout, CASE WHEN {_ok} AND comments IS NULL AND shares IS NULL THEN 'MEDIUM' END AS confidence_cap,
  CASE WHEN age <= 8 AND coalesce(rising_score, 0) >= 70 THEN 'BREAKOUT' WHEN coalesce(rising_score, 0) >= 45 THEN 'RISING'
   WHEN age > 72 AND coalesce(vph, 0) <= 50 THEN 'DEAD' WHEN accel <= -0.5 AND coalesce(trend_score, 0) >= 20 THEN 'FALLING'
   WHEN coalesce(trend_score, 0) >= 45 THEN 'ACTIVE' ELSE 'STABLE' END AS candidate_state
FROM scored0""",
)
cte(
    "scored",
    f"""SELECT *, CASE WHEN trend_state = prev_state THEN prev_since ELSE now_us END AS state_since,
 CASE WHEN platform <> 'tiktok' THEN refresh_us WHEN trend_state IN ('BREAKOUT', 'RISING') THEN least(coalesce(refresh_us, now_us + 7200000000), now_us + 7200000000)
  WHEN trend_state IN ('DEAD', 'FALLING') THEN NULL ELSE refresh_us END AS next_us
FROM (SELECT *, {held_sql('prev_state', 'prev_since', 'candidate_state')} AS trend_state FROM scored1)""",
)


def scored(spark, sf, **kw):
    m = model(spark, sf)
    return P.scored_posts(m.posts, m.snapshots, m.post_tags, m.hashtags, m.tracked, m.now, **kw)


def measured(spark, sf):
    m = model(spark, sf)
    return P.measured_posts(P.eligible_posts(m.posts, "global", m.now), m.snapshots, m.now)


@query("eligible_posts", "S5", compose("SELECT post_id, platform, views, last_us AS last_seen_at FROM posts WHERE last_us >= now_us - 604800000000"))
def eligible(spark, sf):
    m = model(spark, sf)
    return out(P.eligible_posts(m.posts, "global", m.now), "post_id", "platform", "views", "last_seen_at")


@query(
    "snapshots_of_posts",
    "S6",
    compose("SELECT o.post_id, o.us AS observed_at, o.views FROM obs o WHERE EXISTS (SELECT 1 FROM posts p WHERE p.post_id = o.post_id AND p.last_us >= p.now_us - 604800000000)"),
)
def snapshots_of(spark, sf):
    m = model(spark, sf)
    return out(P.snapshots_of(m.snapshots, P.eligible_posts(m.posts, "global", m.now)), "post_id", "observed_at", "views")


@query(
    "posts_seen_today",
    "S7",
    compose("SELECT post_id, platform, tier, views, creator FROM posts WHERE last_us >= now_us // 86400000000 * 86400000000 AND last_us < now_us // 86400000000 * 86400000000 + 86400000000"),
)
def seen_today(spark, sf):
    from crestline.operators.hashtags import creator_key

    m = model(spark, sf)
    start = F.date_trunc("day", m.now)
    return out(P.posts_seen_between(m.posts, start, S.plus_hours(start, 24)), "post_id", "platform", "tier", "views", creator_key().alias("creator"))


@query(
    "post_velocity",
    "A1, K2, K3",
    compose("SELECT post_id, vph_kind, round(vph, 4) AS vph, round(vph_previous, 4) AS vph_previous, velocity_confidence, had_negative_delta FROM vel"),
)
def velocity(spark, sf):
    m = model(spark, sf)
    v = post_velocity(m.posts, m.snapshots, m.now)
    return v.select("post_id", "vph_kind", r6("vph", 4).alias("vph"), r6("vph_previous", 4).alias("vph_previous"), "velocity_confidence", "had_negative_delta")


@query(
    "velocity_of_advanced_folds",
    "A1, A24",
    compose("SELECT post_id, vph_kind, round(vph, 4) AS vph, round(vph_previous, 4) AS vph_previous, velocity_confidence, had_negative_delta FROM vel"),
)
def velocity_of_advanced_folds(spark, sf):
    """Folds advanced by three batches: an early one, a later one, and a tenth of all points that come late."""
    m = model(spark, sf)
    snaps = m.observations.select("post_id", "observed_at", "views", "event_id")
    half = m.now - F.expr("interval 15 days")
    number = F.when(F.col("event_id") % 10 == 0, 2).when(F.col("observed_at") < half, 0).otherwise(1)
    snaps = materialize(snaps.withColumn("b", number), "batched-snapshots")
    posts = materialize(m.posts.select("post_id", "published_at"), "batched-posts")
    folds = spark.createDataFrame([], "post_id bigint, published_at timestamp, fold " + FOLD)
    for k in range(3):
        batch = snaps.where(F.col("b") == k)
        touched = posts.join(batch.select("post_id").distinct(), "post_id", "left_semi")
        now = advance_folds(folds.join(touched, "post_id", "left_semi"), touched, batch, snaps.where(F.col("b") <= k))
        folds = materialize(folds.join(touched, "post_id", "left_anti").unionByName(now), "folds")
    v = velocity_of_folds(posts, folds, m.now)
    return v.select("post_id", "vph_kind", r6("vph", 4).alias("vph"), r6("vph_previous", 4).alias("vph_previous"), "velocity_confidence", "had_negative_delta")


@query("post_acceleration", "A2", compose("SELECT post_id, round(accel, 6) AS acceleration FROM meas"))
def accel(spark, sf):
    return out(measured(spark, sf), "post_id", "acceleration")


@query(
    "age_and_freshness",
    "A3, A4",
    compose("SELECT post_id, round(greatest(0.0, (now_us - pub_us) / 3600000000.0), 6) AS age_hours, round(pow(0.5, greatest(0.0, (now_us - pub_us) / 3600000000.0) / 18.0), 6) AS freshness FROM posts WHERE pub_us IS NOT NULL"),
)
def age_freshness(spark, sf):
    m = model(spark, sf)
    age = S.age_hours(F.col("published_at"), m.now)
    return m.posts.where("published_at is not null").select("post_id", r6(age).alias("age_hours"), r6(S.freshness(age, CFG.freshness_half_life)).alias("freshness"))


@query(
    "engagement_ratios",
    "A5",
    compose("SELECT post_id, " + ", ".join(f"round(CASE WHEN views >= 0 THEN ({c} + 1.0) / (views + 1.0) END, 9) AS {c}_ratio" for c in ("likes", "comments", "shares")) + " FROM posts"),
)
def ratios(spark, sf):
    m = model(spark, sf)
    return m.posts.select("post_id", *[r6(S.engagement_ratio(F.col(c), F.col("views")), 9).alias(f"{c}_ratio") for c in ("likes", "comments", "shares")])


@query(
    "median_mad_by_event_type",
    "A6, A7",
    "SELECT event_type, count(*) AS n, round(any_value(m), 6) AS median, round(median(abs(x - m)), 6) AS mad FROM (SELECT event_type, value AS x, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type",
)
def median_mad(spark, sf):
    ev = model(spark, sf).table("events").select("event_type", F.col("value").alias("x"))
    return out(B.median_and_mad(ev, ["event_type"]), "event_type", "n", "median", "mad")


@query(
    "log_scale_helpers",
    "A8",
    "SELECT event_id, round(ln(1.0 + greatest(0.0, value - 20.0)), 6) AS log1p_floor, round(1.0 / (1.0 + exp(-(value - 50.0) / 10.0)), 6) AS squashed, round(least(80.0, greatest(10.0, value)), 6) AS clamped FROM events",
)
def log_helpers(spark, sf):
    ev, v = model(spark, sf).table("events"), F.col("value")
    return out(ev, "event_id", S.log1p_floor(v - 20).alias("log1p_floor"), S.sigmoid((v - 50) / 10).alias("squashed"), S.clamp(v, 10, 80).alias("clamped"))


@query(
    "scoring_baselines",
    "A9, K5",
    compose("SELECT platform, market, metric, n, round(median, 6) AS median, round(mad, 6) AS mad, origin FROM base"),
)
def baselines(spark, sf):
    return out(B.scoring_baselines(measured(spark, sf), None, model(spark, sf).now), *B.KEY, "n", "median", "mad", "origin")


@query(
    "baselines_with_previous",
    "A9, I12",
    compose(
        """SELECT b.platform, b.market, b.metric, CASE WHEN b.n2 < 50000000 AND p.n IS NOT NULL THEN p.n ELSE b.n2 END AS n,
 CAST(round(coalesce(p.median, ln(1.0 + CAST(g.centre AS DOUBLE))), 4) AS DOUBLE) AS median, CAST(round(coalesce(p.mad, CAST(g.d_mad AS DOUBLE)), 4) AS DOUBLE) AS mad
FROM (SELECT platform, market, metric, n AS n2 FROM base) b JOIN grid g USING (platform, metric)
LEFT JOIN (SELECT platform, market, metric, 60 AS n, 9.5 AS median, 1.5 AS mad FROM base WHERE metric = 'views') p USING (platform, market, metric)"""
    ),
)
def baselines_previous(spark, sf):
    """A cohort too small for its own baseline falls back to the stored one, then to defaults."""
    from dataclasses import replace

    m = model(spark, sf)
    cfg = replace(CFG, baseline_min_n=50_000_000)
    prev = m.posts.select("platform", "market").distinct().select(
        "platform", "market", F.lit("views").alias("metric"), F.lit(60).alias("n"), F.lit(9.5).alias("median"), F.lit(1.5).alias("mad")
    )
    trusted = prev.withColumn("n", F.col("n") + 50_000_000)
    got = B.scoring_baselines(measured(spark, sf), trusted, m.now, cfg)
    got = got.withColumn("n", F.when(F.col("origin") == "PREVIOUS", F.col("n") - 50_000_000).otherwise(F.col("n")))
    return out(B.stored_baselines(got, m.now), *B.KEY, "n", "median", "mad")


@query("robust_z", "A10", compose("SELECT post_id, round(zv, 6) AS z_velocity, round(zr, 6) AS z_reach FROM comp"))
def robust_z(spark, sf):
    return out(scored(spark, sf), "post_id", "z_velocity", "z_reach")


@query(
    "weighted_mean_renormalised",
    "A11",
    "SELECT event_id, round(CASE WHEN event_type IN ('view', 'click') THEN (CAST(value AS DOUBLE) * 0.2 + event_id * 0.35) / 0.55 WHEN event_type = 'error' THEN CAST(event_id AS DOUBLE) WHEN event_type = 'signup' THEN value END, 6) AS combined FROM events",
)
def weighted(spark, sf):
    ev = model(spark, sf).table("events")
    a = F.when(F.col("event_type").isin("view", "click", "signup"), F.col("value"))
    b = F.when(F.col("event_type").isin("view", "click", "error"), F.col("event_id").cast("double"))
    unused = F.col("value")
    return out(ev, "event_id", S.weighted_mean([(a, 0.2), (b, 0.35), (unused, 0.0)]).alias("combined"))


@query(
    "score_components",
    "A12, A13, A14, A15",
    compose("SELECT post_id, round(c_velocity, 6) AS velocity, round(c_reach, 6) AS reach, round(c_engagement, 6) AS engagement, round(c_freshness, 6) AS freshness, round(c_momentum, 6) AS hashtag_momentum, round(c_acceleration, 6) AS acceleration FROM comp"),
)
def components(spark, sf):
    s = scored(spark, sf)
    return out(
        s, "post_id", F.col("c_velocity").alias("velocity"), F.col("c_reach").alias("reach"), F.col("c_engagement").alias("engagement"),
        F.col("c_freshness").alias("freshness"), F.col("c_hashtagMomentum").alias("hashtag_momentum"), F.col("c_acceleration").alias("acceleration"),
    )


@query("trend_and_rising_scores", "A16", compose("SELECT post_id, trend_score, rising_score FROM scored0"))
def scores(spark, sf):
    return out(scored(spark, sf), "post_id", "trend_score", "rising_score")


def _explain_sql() -> str:
    names = ("velocity", "reach", "engagement", "freshness", "hashtagMomentum", "acceleration")
    raws = ("vph", "CAST(views AS DOUBLE)", "NULL", "age", "hashtag_momentum", "accel")
    zs = ("zv", "zr", "NULL", "NULL", "NULL", "NULL")
    rows = []
    for label, parts in (("trend", TREND), ("rising", RISING)):
        den = " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE {w} END" for c, w in parts if w > 0)
        for (c, w), n, raw, z in zip(parts, names, raws, zs):
            live = f"({c} IS NOT NULL AND {w} > 0)"
            rows.append(
                f"SELECT post_id, '{label}' AS score, '{n}' AS component, {live} AS available, round(CAST({raw} AS DOUBLE), 4) AS raw, round(CAST({z} AS DOUBLE), 6) AS z, "
                f"round({c}, 6) AS normalized, CAST({w} AS DOUBLE) AS weight_configured, round(CASE WHEN {live} THEN {w} / ({den}) END, 6) AS weight_used FROM comp"
            )
    return compose("\nUNION ALL ".join(rows))


@query("score_explanation", "A17", _explain_sql())
def explain(spark, sf):
    rows = P.explain_rows(scored(spark, sf, keep_components=True))
    return rows.select(
        "post_id", "score", "component", "available", r6("raw", 4).alias("raw"), r6("z").alias("z"), r6("normalized").alias("normalized"),
        "weight_configured", r6("weight_used").alias("weight_used"),
    )


@query("post_tag_momentum", "A18, K4", compose("SELECT post_id, round(hashtag_momentum, 6) AS hashtag_momentum FROM tagmom"))
def tag_momentum(spark, sf):
    m = model(spark, sf)
    return out(P.post_tag_momentum(m.post_tags, m.hashtags, m.tracked, P.eligible_posts(m.posts, "global", m.now)), "post_id", "hashtag_momentum")


@query("post_tiers", "A19, A20, K6", compose("SELECT post_id, tier, is_early_breakout, confidence_cap FROM scored1"))
def tiers(spark, sf):
    return out(scored(spark, sf), "post_id", "tier", "is_early_breakout", "confidence_cap")


@query("post_trend_states", "A21", compose("SELECT post_id, candidate_state FROM scored1"))
def states(spark, sf):
    return out(scored(spark, sf), "post_id", "candidate_state")


@query(
    "post_state_hysteresis",
    "A22, K10",
    compose("SELECT post_id, prev_state AS previous_state, candidate_state, trend_state, state_since AS trend_state_since FROM scored"),
)
def hysteresis(spark, sf):
    return out(scored(spark, sf), "post_id", "previous_state", "candidate_state", "trend_state", "trend_state_since")


@query("refresh_priority", "A23", compose("SELECT post_id, platform, trend_state, next_us AS next_refresh_at FROM scored"))
def refresh(spark, sf):
    return out(scored(spark, sf), "post_id", "platform", "trend_state", "next_refresh_at")


SCORED_SQL = compose(
    """SELECT post_id, platform, round(age, 6) AS age_hours, round(vph, 4) AS vph, vph_kind, velocity_confidence, trend_score, rising_score, tier, trend_state,
 state_since AS trend_state_since, next_us AS next_refresh_at FROM scored"""
)


@query("scored_posts", "A24", SCORED_SQL)
def scored_rows(spark, sf):
    s = scored(spark, sf)
    return out(
        s.withColumn("vph", F.round("vph", 4)),
        "post_id", "platform", "age_hours", "vph", "vph_kind", "velocity_confidence", "trend_score", "rising_score", "tier", "trend_state",
        "trend_state_since", "next_refresh_at",
    )


@query(
    "posts_after_scoring",
    "I9, K25",
    compose(
        """SELECT p.post_id, CASE WHEN s.post_id IS NULL THEN p.tier ELSE s.tier END AS tier, CASE WHEN s.post_id IS NULL THEN 'OBSERVED' ELSE nullif(s.vph_kind, 'NONE') END AS vph_kind,
 CASE WHEN s.post_id IS NULL THEN p.trend_score0 ELSE s.trend_score END AS trend_score, CASE WHEN s.post_id IS NULL THEN p.prev_state ELSE s.trend_state END AS trend_state,
 coalesce(s.post_id IS NOT NULL, false) AS fresh FROM posts p LEFT JOIN scored s USING (post_id)"""
    ),
)
def after_scoring(spark, sf):
    m = model(spark, sf)
    res = P.write_back_scores(m.posts, scored(spark, sf))
    return out(res, "post_id", "tier", "vph_kind", big("trend_score").alias("trend_score"), "trend_state", F.col("scored_at").isNotNull().alias("fresh"))


@query(
    "post_by_natural_key",
    "S11",
    compose("SELECT DISTINCT p.post_id, p.platform, p.external_id FROM posts p JOIN ev e ON p.external_id = CAST(e.post_id + 7000000000 AS VARCHAR) AND p.platform = e.platform WHERE e.event_type = 'purchase'"),
)
def by_natural_key(spark, sf):
    from crestline.sources.lookups import posts_by_key

    m = model(spark, sf)
    keys = m.events.where("event_type = 'purchase'").select("platform", (F.col("post_id") + 7_000_000_000).cast("string").alias("external_id"))
    return posts_by_key(m.posts, keys).select("post_id", "platform", "external_id")
