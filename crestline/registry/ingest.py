"""Queries over raw payloads, normalisation, ingest merges, redaction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crestline.functions import scalars as S
from crestline.functions import text as T
from crestline.operators import ingest as I
from crestline.operators import normalize as N
from crestline.operators.redact import redact
from crestline.registry.base import big, compose, cte, out, query, us
from crestline.registry.model import model
from crestline.session import materialize

# Raw payloads are written from the events so that every parser branch occurs:
# k % 10 decides the defect, the user's parity the source.

def spread_events(m):
    """Events over several tasks per core: parsing is CPU-bound, and a small table is a single scan task.

    The count is given because an adaptive shuffle merges partitions by their bytes, into about one task per core and one more.
    """
    return m.events.repartition(4 * m.spark.sparkContext.defaultParallelism, "event_id")


def raw_p1(m):
    """Vendor A, first platform: numbers, numeric texts, hidden counts, odd tags, broken records."""
    e, k = spread_events(m), F.col("k")
    vid = (F.col("event_id") + 7_000_000).cast("string")
    views = F.when(k % 10 == 1, F.concat(F.lit('"'), F.col("cents"), F.lit('"'))).when(k % 10 == 2, "-1").when(
        k % 10 == 3, F.concat(F.lit('"'), F.col("cents"), F.lit('.5"'))
    ).when(k % 10 == 4, F.concat(F.col("cents").cast("string"), F.lit(".9"))).otherwise(F.col("cents").cast("string"))
    made = F.when(k % 3 == 0, F.concat(F.lit('"createTime":'), F.floor(F.unix_micros("ts") / 1_000_000))).when(
        k % 3 == 1, F.concat(F.lit('"createTime":"'), F.floor(F.unix_micros("ts") / 1000), F.lit('"'))
    ).otherwise(F.concat(F.lit('"createTimeISO":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
    url = F.when(k % 7 != 0, F.concat(F.lit('"webVideoUrl":"https://www.tiktok.com/@h'), F.col("user_id"), F.lit("/video/"), vid, F.lit('?q=1",'))).otherwise(F.lit(""))
    name = F.when(k % 14 == 0, "bad handle!").otherwise(F.concat(F.lit("n"), F.col("user_id")))
    pid = F.when(k % 10 == 5, '"12"').when(k % 10 == 6, vid).otherwise(F.concat(F.lit('"'), vid, F.lit('"')))
    text = F.when(k % 10 == 7, "5").when(k % 10 == 8, "null").otherwise(F.concat(F.lit('"look #'), F.col("event_type"), F.lit(' #Topic_'), k % 4, F.lit(' now"')))
    payload = F.concat(
        F.lit('{"id":'), pid, F.lit(',"text":'), text, F.lit(","), made, F.lit(","), url, F.lit('"authorMeta":{"name":"'), name,
        F.lit('","fans":'), F.col("cents"), F.lit('},"playCount":'), views, F.lit(',"diggCount":"'), k,
        F.lit('","videoMeta":{"duration":12.5},"hashtags":["#'), F.upper("event_type"), F.lit('",{"name":" Tag'), k % 5, F.lit(' "},"no good"],"isSlideshow":'),
        F.when(k % 6 == 0, "true").otherwise("false"), F.lit("}"),
    )
    return e.select(
        "event_id", F.when(k % 10 == 9, F.lit("{broken")).otherwise(payload).alias("payload"), F.lit("apify").alias("provider"),
        F.lit("tiktok").alias("platform"), F.floor(F.col("event_id") / 50).cast("bigint").alias("provider_job_id"), F.col("ts").alias("observed_at"),
    )


cte(
    "rawn",
    """SELECT event_id, user_id, us, ts, k, cents, event_type, CAST(event_id + 7000000 AS VARCHAR) AS vid,
 CASE WHEN k % 10 IN (9, 7) THEN 'INVALID' WHEN k % 10 = 5 THEN 'MISSING_ID' WHEN k % 14 = 0 THEN 'INVALID_URL' END AS reject_kind,
 CASE WHEN k % 7 <> 0 THEN 'h' || user_id ELSE 'n' || user_id END AS handle,
 CASE WHEN k % 10 IN (2, 3) THEN NULL ELSE cents END AS views,
 CASE WHEN k % 3 = 0 THEN us // 1000000 * 1000000 WHEN k % 3 = 1 THEN us // 1000 * 1000 ELSE us // 1000000 * 1000000 END AS pub_us,
 CASE WHEN k % 10 = 8 THEN event_type || '|tag' || (k % 5) ELSE event_type || '|tag' || (k % 5) || '|topic_' || (k % 4) END AS hashtags
FROM ev""",
)


@query(
    "normalize_vendor_a_first",
    "S1, N1, N2, N7, N8, N9, N11, N12, N13, N15, N17, N18, K28",
    compose(
        """SELECT event_id, vid AS external_id, 'https://www.tiktok.com/@' || handle || '/video/' || vid AS canonical_url, CASE WHEN k % 6 = 0 THEN 'carousel' ELSE 'video' END AS content_type, handle AS creator_username,
 cents AS creator_followers, CASE WHEN k % 10 <> 8 THEN 'look #' || event_type || ' #Topic_' || (k % 4) || ' now' END AS caption, hashtags, pub_us AS published_at, CAST(12.5 AS DOUBLE) AS duration_sec, views,
 CASE WHEN views IS NOT NULL THEN 'tt_apify_play_count' END AS views_metric, k AS likes FROM rawn WHERE reject_kind IS NULL"""
    ),
)
def norm_a1(spark, sf):
    good, _ = N.split_rejects(N.normalize(raw_p1(model(spark, sf))))
    return good.select(
        "event_id", "external_id", "canonical_url", "content_type", F.col("creator.username").alias("creator_username"), F.col("creator.followers").alias("creator_followers"),
        "caption", F.concat_ws("|", "hashtags").alias("hashtags"), us("published_at").alias("published_at"), "duration_sec", "metrics.views", "metrics.views_metric", "metrics.likes",
    )


def raw_p2(m):
    """Vendor A, second platform: shortcode or URL, hidden likes, both view fields."""
    e, k = spread_events(m), F.col("k")
    code = F.concat(F.lit("S_-"), F.col("event_id") + 100000)
    ident = F.when(k % 10 < 4, F.concat(F.lit('"shortCode":"'), code, F.lit('",'))).when(
        k % 10 < 7, F.concat(F.lit('"url":"https://instagram.com/reel/'), code, F.lit('/?x=1",'))
    ).when(k % 10 == 7, F.lit('"shortCode":"ab",')).when(k % 10 == 8, F.lit('"url":"https://cdn.example.com/p/abcdef/",')).otherwise(F.lit(""))
    views = F.when(k % 3 == 0, F.concat(F.lit('"videoPlayCount":'), F.col("cents"), F.lit(',"videoViewCount":5,'))).when(
        k % 3 == 1, F.concat(F.lit('"videoViewCount":'), F.col("cents"), F.lit(","))
    ).otherwise(F.lit(""))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Image", "Sidecar", "Video", "Other")]), (k % 4 + 1).cast("int"))
    payload = F.concat(
        F.lit("{"), ident, views, F.lit('"type":"'), kind, F.lit('",'), F.when(k % 5 == 0, F.lit('"productType":"clips",')).otherwise(F.lit("")),
        F.lit('"likesCount":'), F.when(k % 2 == 0, "-1").otherwise(F.col("cents").cast("string")), F.lit(',"hashtags":["'), F.col("event_type"), F.lit('"],"caption":null,"ownerUsername":"o'),
        F.col("user_id"), F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('","commentsCount":'), F.when(k % 11 == 0, '"9"').otherwise("9"), F.lit("}"),
    )
    return e.select(payload.alias("payload"), F.lit("apify").alias("provider"), F.lit("instagram").alias("platform"), F.col("ts").alias("observed_at"))


@query(
    "normalize_vendor_a_second",
    "S2, N3, N16, N17, N18",
    compose(
        """SELECT 'S_-' || (event_id + 100000) AS external_id, 'https://www.instagram.com/p/S_-' || (event_id + 100000) || '/' AS canonical_url,
 CASE WHEN k % 5 = 0 THEN 'reel' ELSE CASE k % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'carousel' WHEN 2 THEN 'video' ELSE 'unknown' END END AS content_type, 'o' || user_id AS creator_username,
 us // 1000 * 1000 AS published_at, CASE WHEN k % 3 < 2 THEN cents END AS views, CASE k % 3 WHEN 0 THEN 'ig_apify_video_play_count' WHEN 1 THEN 'ig_apify_video_view_count' END AS views_metric,
 CASE WHEN k % 2 = 1 THEN cents END AS likes FROM ev WHERE k % 10 < 7 AND k % 11 <> 0"""
    ),
)
def norm_a2(spark, sf):
    good, _ = N.split_rejects(N.normalize(raw_p2(model(spark, sf))))
    return good.select(
        "external_id", "canonical_url", "content_type", F.col("creator.username").alias("creator_username"), us("published_at").alias("published_at"),
        "metrics.views", "metrics.views_metric", "metrics.likes",
    )


def raw_b1(m):
    """Vendor B, first platform: handle only from URLs, share counts as text."""
    e, k = spread_events(m), F.col("k")
    vid = (F.col("event_id") + 8_000_000).cast("string")
    link = F.when(k % 4 == 0, F.concat(F.lit('"url":"https://tiktok.com/@b'), F.col("user_id"), F.lit("/video/"), vid, F.lit('",'))).when(
        k % 4 == 1, F.concat(F.lit('"url":"https://v16.cdn.example.com/x.mp4","profile_url":"https://www.tiktok.com/@b'), F.col("user_id"), F.lit('",'))
    ).when(k % 4 == 2, F.lit('"profile_url":"https://example.com/@zz",')).otherwise(F.lit('"profile_username":"zz",'))
    payload = F.concat(
        F.lit('{"post_id":"'), vid, F.lit('",'), link, F.lit('"description":"a #B_'), k % 3, F.lit('","create_time":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('","play_count":'), F.col("cents"), F.lit(',"share_count":"'), k, F.lit('","video_duration":"'), k, F.lit('.25","post_type":"'),
        F.when(k % 2 == 0, "video").otherwise("photo"), F.lit('","is_verified":true,"hashtags":["x"]}'),
    )
    return e.select("event_id", payload.alias("payload"), F.lit("brightdata").alias("provider"), F.lit("tiktok").alias("platform"), F.col("ts").alias("observed_at"))


@query(
    "normalize_vendor_b_first",
    "S3, N4",
    compose(
        """SELECT event_id, CAST(event_id + 8000000 AS VARCHAR) AS external_id, 'https://www.tiktok.com/@b' || user_id || '/video/' || (event_id + 8000000) AS canonical_url, CASE WHEN k % 2 = 0 THEN 'video' ELSE 'unknown' END AS content_type,
 'x|b_' || (k % 3) AS hashtags, us // 1000000 * 1000000 AS published_at, CAST(k + 0.25 AS DOUBLE) AS duration_sec, cents AS views, k AS shares, true AS verified FROM ev WHERE k % 4 < 2"""
    ),
)
def norm_b1(spark, sf):
    good, _ = N.split_rejects(N.normalize(raw_b1(model(spark, sf))))
    return good.select(
        "event_id", "external_id", "canonical_url", "content_type", F.concat_ws("|", "hashtags").alias("hashtags"), us("published_at").alias("published_at"),
        "duration_sec", "metrics.views", "metrics.shares", "creator.verified",
    )


def raw_all(m):
    other = raw_b1(m).withColumn("platform", F.lit("instagram"))
    return raw_p1(m).drop("provider_job_id").unionByName(raw_b1(m)).unionByName(other)


@query(
    "rejects_by_kind",
    "N1, N5",
    compose(
        """SELECT provider, platform, reject_kind, count(*) AS n FROM (SELECT 'apify' AS provider, 'tiktok' AS platform, reject_kind FROM rawn UNION ALL SELECT 'brightdata', 'tiktok', CASE WHEN k % 4 >= 2 THEN 'INVALID_URL' END FROM ev
UNION ALL SELECT 'brightdata', 'instagram', 'UNSUPPORTED' FROM ev) WHERE reject_kind IS NOT NULL GROUP BY 1, 2, 3"""
    ),
)
def rejects(spark, sf):
    _, bad = N.split_rejects(N.normalize(raw_all(model(spark, sf))))
    return bad.groupBy("provider", "platform", "reject_kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quarantine_rows",
    "N6",
    compose(
        """SELECT provider_job_id, count(*) AS n FROM (SELECT DISTINCT event_id // 50 AS provider_job_id, CASE WHEN k % 10 = 9 THEN 'broken' ELSE CAST(event_id AS VARCHAR) END AS p FROM rawn WHERE reject_kind IS NOT NULL AND event_id // 50 % 4 <> 0) GROUP BY 1"""
    ),
)
def quarantine(spark, sf):
    m = model(spark, sf)
    _, bad = N.split_rejects(N.normalize(raw_p1(m)))
    stored = bad.where("provider_job_id % 4 = 0").select("provider_job_id", "payload")
    return N.quarantine_rows(stored, bad, m.now).groupBy("provider_job_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parsed_numbers_and_dates",
    "N7, N8, N9",
    """SELECT event_id, CASE WHEN value >= 50 THEN CAST(floor(value) AS BIGINT) END AS count_number, CASE WHEN event_type = 'view' THEN user_id END AS count_text, CASE WHEN event_type IN ('view', 'click') THEN CAST(user_id AS DOUBLE) + CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END END AS duration_text,
 CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000000 * 1000000 WHEN event_type = 'click' THEN epoch_us(ts) // 1000 * 1000 WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000000 * 1000000 END AS parsed_us FROM events""",
)
def parsed(spark, sf):
    ev, u = model(spark, sf).table("events"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    # Small values become hidden counts: below zero also for a value of zero, whose negative is still a count of zero.
    number = F.when(F.col("value") >= 50, F.col("value")).otherwise(-F.abs("value") - 1)
    txt = F.when(kind == "view", F.concat(F.lit("  "), u, F.lit("\n"))).when(kind == "click", F.concat(u, F.lit(".5"))).when(kind == "purchase", F.concat(F.lit("-"), u)).when(kind == "signup", "N/A").otherwise("")
    date = F.when(kind == "view", F.floor(F.unix_micros("ts") / 1_000_000).cast("string")).when(kind == "click", F.floor(F.unix_micros("ts") / 1000).cast("string")).when(
        kind == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise("yesterday")
    return ev.select(
        "event_id", T.count_from_number(number).alias("count_number"), T.count_from_text(txt).alias("count_text"), T.duration_from_text(txt).alias("duration_text"), us(T.time_from_text(date)).alias("parsed_us"),
    )


@query(
    "caption_tags_of_documents",
    "N10, N12, N13, N14",
    """SELECT doc_id, string_agg(tag, '|' ORDER BY i) AS tags FROM (SELECT doc_id, tag, min(i) AS i FROM (SELECT doc_id, unnest(list_transform(w, lambda x: lower(nfc_normalize(x)))) AS tag, generate_subscripts(w, 1) AS i
 FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, ' (\\p{L})', ' #\\1', 'g'), '#([\\p{L}\\p{N}_]+)', 1) AS w FROM documents))
 WHERE length(tag) <= 100 GROUP BY 1, 2) GROUP BY 1""",
)
def caption_tags(spark, sf):
    """Whole texts as captions in which every word after a blank is marked as a tag."""
    docs = model(spark, sf).table("documents").where("text is not null")
    marked = F.regexp_replace("text", r" (\p{L})", " #$1")
    tags = docs.select("doc_id", T.merge_tags(T.caption_tags(marked)).alias("t")).where(F.size("t") > 0)
    return tags.select("doc_id", F.concat_ws("|", "t").alias("tags"))


@query(
    "query_terms",
    "N14",
    """SELECT DISTINCT lang, lower(nfc_normalize(regexp_replace(w0, '^#', ''))) AS term FROM (SELECT lang, unnest(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+')) AS w0 FROM documents) WHERE regexp_full_match(nfc_normalize(regexp_replace(w0, '^#', '')), '[\\p{L}\\p{N}_]{1,100}')""",
)
def query_terms(spark, sf):
    """Distinct valid terms among all words of every text, per language; words are made distinct before they are cleaned."""
    words = model(spark, sf).table("documents").select("lang", F.explode(F.split("text", "[ \\t\\n\\r\\x0B\\f]+")).alias("w")).distinct()
    return words.select("lang", F.explode(T.clean_tags(F.array("w"))).alias("term")).distinct()


@query(
    "url_parts",
    "N15, N16, N17, Q7",
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, 'h' || page_id AS handle, CAST(page_id + 10000 AS VARCHAR) AS video_id, NULL AS off_site, 'c_' || (page_id + 1000) AS shortcode,
 'https://www.tiktok.com/@h' || page_id || '/video/' || (page_id + 10000) AS rebuilt FROM pages""",
)
def url_parts(spark, sf):
    p = model(spark, sf).table("pages")
    n = F.col("page_id").cast("string")
    video = F.concat(F.lit("https://WWW.tiktok.com/@h"), n, F.lit("/video/"), F.col("page_id") + 10000, F.lit("/?lang=en#top"))
    reel = F.concat(F.lit("https://www.instagram.com/reels/c_"), F.col("page_id") + 1000, F.lit("/extra/path"))
    return p.select(
        "page_id", T.url_host(F.col("url")).alias("host"), T.video_handle(video).alias("handle"), T.video_id(video).alias("video_id"),
        F.coalesce(T.video_id(F.col("url")), T.post_shortcode(F.col("url")), T.profile_handle(video)).alias("off_site"),
        T.post_shortcode(reel).alias("shortcode"), T.video_url(T.video_handle(video), T.video_id(video)).alias("rebuilt"),
    )


@query(
    "domain_checks",
    "N19",
    compose(
        "SELECT post_id, CASE WHEN user_id % 9 = 0 THEN 'platform,' ELSE '' END || CASE WHEN user_id % 4 = 0 THEN 'market' ELSE '' END AS errors FROM posts"
    ),
)
def domain(spark, sf):
    p = model(spark, sf).posts
    u = F.floor(F.col("post_id") / 100000)
    bad = p.select("post_id", F.when(u % 9 == 0, "myspace").otherwise(F.col("platform")).alias("platform"), "content_type", F.when(u % 4 == 0, "9x").otherwise("uk_2").alias("market"))
    e = N.domain_errors(bad).select("post_id", "domain_errors")
    return e.select("post_id", F.concat(F.when(F.array_contains("domain_errors", "platform"), "platform,").otherwise(""), F.when(F.array_contains("domain_errors", "market"), "market").otherwise("")).alias("errors"))


@query(
    "redacted_conversations",
    "N20",
    """SELECT conv_id, turn, '[REDACTED]' AS token, replace(replace(text, 'assistant', '[REDACTED]'), 'please', '[REDACTED]') AS text, replace(role, 'assistant', '[REDACTED]') AS kept FROM conversations""",
)
def redacted(spark, sf):
    c = model(spark, sf).table("conversations")
    nested = c.select("conv_id", "turn", F.struct(F.struct(F.col("text").alias("api_token"), F.array("text").alias("body")).alias("inner"), "role").alias("rec"))
    r = redact(nested, ["assistant", "please", "the"])
    return r.select("conv_id", "turn", F.col("rec.inner.api_token").alias("token"), F.col("rec.inner.body")[0].alias("text"), F.col("rec.role").alias("kept"))


# --- ingest -----------------------------------------------------------------------

def observations(m):
    """Flat observations of the model's posts: the same post again and again, with gaps."""
    o, u, k = m.observations, F.col("user_id"), F.col("k")
    return o.select(
        "post_id", "platform", (F.col("post_id") + 7_000_000_000).cast("string").alias("external_id"), F.concat(F.lit("url"), F.col("event_id")).alias("canonical_url"),
        F.when(k % 2 == 0, "video").otherwise("reel").alias("content_type"), F.when(k % 4 == 0, F.concat(F.lit("u"), u.cast("string"))).alias("creator_username"),
        F.when(k % 3 == 0, F.col("event_type")).alias("caption"), "views", "likes", "comments", "shares", "saves", "observed_at", "event_id",
        F.array(F.col("event_type"), F.concat(F.lit("t"), (k % 5).cast("string"))).alias("hashtags"), F.floor(F.col("event_id") / 40).cast("bigint").alias("provider_job_id"),
        (k % 20).cast("int").alias("rank_in_results"),
    )


_fold = ", ".join(
    f"arg_max({c}, us) AS {c}" for c in ("creator_username", "caption", "views", "shares")
)
cte(
    "oin",
    """SELECT *, 'url' || event_id AS canonical_url, CASE WHEN k % 2 = 0 THEN 'video' ELSE 'reel' END AS content_type, CASE WHEN k % 4 = 0 THEN 'u' || user_id END AS creator_username, CASE WHEN k % 3 = 0 THEN event_type END AS caption FROM obs""",
)


@query(
    "posts_merge",
    "I1, K21, K27",
    compose(
        f"""SELECT post_id, arg_max(canonical_url, us) AS canonical_url, arg_max(content_type, us) AS content_type, {_fold}, min(us) AS first_seen_at, max(us) AS last_seen_at, 'global' AS market FROM oin GROUP BY 1"""
    ),
)
def posts_merge(spark, sf):
    """The table after two batches, split by event parity; its twin folds all observations at once."""
    m = model(spark, sf)
    o = observations(m)
    empty = I.fold_posts(o, "event_id").limit(0).withColumn("market", F.lit(""))
    one = I.merge_posts(empty, I.fold_posts(o.where("event_id % 2 = 0"), "event_id"))
    two = I.merge_posts(one, I.fold_posts(o.where("event_id % 2 = 1"), "event_id"))
    cols = ["post_id", "canonical_url", "content_type", "creator_username", "caption", "views", "shares", us("first_seen_at").alias("first_seen_at"), us("last_seen_at").alias("last_seen_at"), "market"]
    return two.select(*cols)


cte(
    "s12",
    "SELECT user_id AS post_id, us AS t, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, k // 34 AS m FROM ev",
)
cte(
    "s12walk",
    """SELECT post_id, i, t, m, t AS kt, m AS km, true AS kept FROM s12 WHERE i = 1
UNION ALL SELECT s.post_id, s.i, s.t, s.m, CASE WHEN s.t - w.kt <= 129600000000 AND s.m = w.km THEN w.kt ELSE s.t END, CASE WHEN s.t - w.kt <= 129600000000 AND s.m = w.km THEN w.km ELSE s.m END, NOT (s.t - w.kt <= 129600000000 AND s.m = w.km)
FROM s12walk w JOIN s12 s ON s.post_id = w.post_id AND s.i = w.i + 1""",
)


def coarse_snapshots(m):
    """Snapshots per user with few distinct metric values, so that repeats occur."""
    null = F.lit(None).cast("bigint")
    return m.events.select(
        F.col("user_id").alias("post_id"), F.col("ts").alias("observed_at"), F.floor(F.col("k") / 34).cast("bigint").alias("views"),
        null.alias("likes"), null.alias("comments"), null.alias("shares"), null.alias("saves"),
    )


@query("snapshot_dedup", "I2, K1", compose("SELECT post_id, t AS observed_at, m AS views FROM s12walk WHERE kept"))
def snapshot_dedup(spark, sf):
    """A 36-hour window over sparse observations exercises keep, drop and keep again."""
    from dataclasses import replace

    from crestline.config import DEFAULT

    kept = I.dedup_snapshots(coarse_snapshots(model(spark, sf)), replace(DEFAULT, dedup_minutes=36 * 60))
    return out(kept, "post_id", "observed_at", "views")


@query(
    "hashtags_merge",
    "I3",
    compose("SELECT name, min(us) AS first_seen_at, max(us) AS last_seen_at FROM (SELECT event_type AS name, us FROM ev UNION ALL SELECT 't' || (k % 5), us FROM ev) GROUP BY 1"),
)
def hashtags_merge(spark, sf):
    m = model(spark, sf)
    tags = I.observed_tags(observations(m))
    none = m.hashtags.limit(0)
    late = I.merge_hashtags(none, tags.where("post_id % 2 = 0"))
    return out(I.merge_hashtags(late, tags.where("post_id % 2 = 1")), "name", "first_seen_at", "last_seen_at")


@query(
    "post_tags_union",
    "I4",
    compose(
        """SELECT post_id, name, CAST(arg_min(position, us * 2 + position) AS BIGINT) AS position FROM (SELECT post_id, event_type AS name, 0 AS position, us FROM ev UNION ALL SELECT post_id, 't' || (k % 5), 1, us FROM ev)
WHERE post_id % 3 <> 0 GROUP BY 1, 2"""
    ),
)
def post_tags_union(spark, sf):
    m = model(spark, sf)
    tags = I.observed_tags(observations(m))
    stored = tags.where("post_id % 3 = 0").select("post_id", "hashtag_id").distinct()
    new = I.new_post_tags(stored, tags)
    names = tags.select("hashtag_id", "name").distinct()
    return out(new.join(names, "hashtag_id"), "post_id", "name", "position")


@query(
    "discoveries_first_per_job",
    "I5",
    compose("SELECT post_id, event_id // 40 AS provider_job_id, arg_min(k % 20, us) AS rank_in_results, min(us) AS observed_at FROM ev WHERE event_id // 40 % 5 <> 0 GROUP BY 1, 2"),
)
def discoveries(spark, sf):
    m = model(spark, sf)
    o = observations(m).select("post_id", "provider_job_id", "rank_in_results", "observed_at")
    stored = o.where("provider_job_id % 5 = 0").select("post_id", "provider_job_id")
    return out(I.new_discoveries(stored, o), "post_id", "provider_job_id", "rank_in_results", "observed_at")


@query(
    "batch_effects",
    "I6, S4",
    compose(
        """SELECT 'posts' AS table_name, count(DISTINCT vid) AS n FROM rawn WHERE reject_kind IS NULL UNION ALL SELECT 'post_snapshots', count(*) FROM rawn WHERE reject_kind IS NULL
UNION ALL SELECT 'hashtags', count(DISTINCT h) FROM (SELECT unnest(string_split(hashtags, '|')) AS h FROM rawn WHERE reject_kind IS NULL)
UNION ALL SELECT 'post_hashtags', count(*) FROM (SELECT DISTINCT vid, unnest(string_split(hashtags, '|')) AS h FROM rawn WHERE reject_kind IS NULL)
UNION ALL SELECT 'post_discoveries', count(*) FROM rawn WHERE reject_kind IS NULL"""
    ),
)
def batch_effects(spark, sf):
    """Normalise, then all table changes of one observation batch on empty tables."""
    from crestline.sources.tables import empty_tables

    m = model(spark, sf)
    good, _ = N.split_rejects(N.normalize(raw_p1(m)))
    good = good.withColumns(
        {"source": F.lit("DISCOVERY"), "query_text": F.lit(None).cast("string"), "query_hashtag_id": F.lit(None).cast("bigint"), "rank_in_results": F.lit(0)}
    )
    # Five tables derive from the batch: normalise once, then read it back.
    eff = I.observation_effects(empty_tables(spark), materialize(I.flat_observations(good), "observations"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(n)) for n, df in eff.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# --- commits of several tables, upserts, folds ------------------------------------------

def whole_observations(m):
    """The model's observations with all columns that ingest reads."""
    none = F.lit(None)
    return observations(m).withColumns(
        {"views_metric": none.cast("string"), "source": F.lit("DISCOVERY"), "query_text": none.cast("string"), "query_hashtag_id": none.cast("bigint"),
         "market": F.lit("global"), "hashtags": F.transform("hashtags", F.lower)}
    )


_stored_posts = """SELECT p.post_id, p.canonical_url, p.views, p.caption, p.last_seen_at, t.n_tags, d.n_discoveries FROM
(SELECT post_id, arg_max(canonical_url, us) AS canonical_url, arg_max(views, us) AS views, arg_max(caption, us) AS caption, max(us) AS last_seen_at FROM oin WHERE {0} GROUP BY 1) p
JOIN (SELECT post_id, count(DISTINCT h) AS n_tags FROM (SELECT post_id, event_type AS h FROM oin WHERE {0} UNION ALL SELECT post_id, 't' || (k % 5) FROM oin WHERE {0}) GROUP BY 1) t USING (post_id)
JOIN (SELECT post_id, count(DISTINCT event_id // 40) AS n_discoveries FROM oin WHERE {0} GROUP BY 1) d USING (post_id)"""


def stored_state(store):
    """One row per stored post with what the other tables hold of it."""
    tags = store.read("post_hashtags").groupBy("post_id").agg(F.count(F.lit(1)).alias("n_tags"))
    found = store.read("post_discoveries").groupBy("post_id").agg(F.count(F.lit(1)).alias("n_discoveries"))
    p = store.read("posts").join(tags.hint("merge"), "post_id").join(found.hint("merge"), "post_id")
    return out(p, "post_id", "canonical_url", "views", "caption", us("last_seen_at").alias("last_seen_at"), "n_tags", "n_discoveries")


def fresh_store(spark):
    from crestline.session import shared_dir
    from crestline.sources.tables import Store

    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("stored_after_batches", "I1, I3, I6", compose(_stored_posts.format("true")))
def stored_after_batches(spark, sf):
    """Three batches in shuffled order, each one commit of all tables; posts are upserts merged on read, and compacted in between."""
    from crestline.plans.ingest_batch import write_batch

    m, store = model(spark, sf), fresh_store(spark)
    obs = whole_observations(m)
    for k in range(3):
        with store.transaction() as tx:
            write_batch(tx, materialize(obs.where(F.col("event_id") % 3 == (k + 1) % 3), "batch"))
        if k == 1:
            store.compact("posts")
    return stored_state(store)


@query("stored_after_torn_batch", "I6", compose(_stored_posts.format("event_id % 2 = 0")))
def stored_after_torn_batch(spark, sf):
    """The second batch writes all its tables and dies before its commit: the first one is what is stored."""
    from crestline.plans.ingest_batch import write_batch

    m, store = model(spark, sf), fresh_store(spark)
    obs = whole_observations(m)
    with store.transaction() as tx:
        write_batch(tx, materialize(obs.where("event_id % 2 = 0"), "batch"))
    try:
        with store.transaction() as tx:
            write_batch(tx, materialize(obs.where("event_id % 2 = 1"), "batch"))
            raise InterruptedError("the driver is lost")
    except InterruptedError:
        pass
    return stored_state(store)
