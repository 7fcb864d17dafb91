"""Raw vendor payloads to one normalised record shape.

A payload is one JSON text per row. Declared fields are type-checked, unknown
ones ignored; a bad record becomes a reject row and never fails the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import CATEGORIES, CONTENT_TYPES, PLATFORMS, PROVIDERS, VIEWS_METRICS
from crestline.functions import text as T

# Declared fields and the JSON kinds each may have.
# s string, n number, b boolean, o object, z null, l list of s, m list of s or named o.
A_P1 = {
    "id": "sn", "text": "sz", "createTime": "sn", "createTimeISO": "s", "webVideoUrl": "s", "authorMeta": "o",
    "authorMeta.id": "s", "authorMeta.name": "s", "authorMeta.uniqueId": "s", "authorMeta.verified": "b",
    "authorMeta.fans": "n", "musicMeta": "o", "musicMeta.musicId": "s", "musicMeta.musicName": "s",
    "musicMeta.musicAuthor": "s", "videoMeta": "o", "videoMeta.duration": "n", "diggCount": "sn", "shareCount": "sn",
    "playCount": "sn", "commentCount": "sn", "collectCount": "sn", "hashtags": "m", "isSlideshow": "b", "searchQuery": "s",
}
A_P2 = {
    "id": "s", "shortCode": "s", "type": "s", "productType": "s", "url": "s", "caption": "sz", "hashtags": "l",
    "likesCount": "n", "videoPlayCount": "n", "videoViewCount": "n", "commentsCount": "n", "reshareCount": "n",
    "timestamp": "s", "ownerUsername": "s", "ownerId": "s", "videoDuration": "n", "musicInfo": "o",
    "musicInfo.audio_id": "s", "musicInfo.song_name": "s", "musicInfo.artist_name": "s",
}
B_P1 = {
    "post_id": "sn", "url": "s", "description": "sz", "create_time": "sn", "digg_count": "sn", "share_count": "sn",
    "comment_count": "sn", "play_count": "sn", "collect_count": "sn", "video_duration": "sn", "hashtags": "l",
    "profile_id": "s", "profile_username": "s", "profile_url": "s", "profile_followers": "sn", "is_verified": "b",
    "post_type": "s", "music": "o", "music.id": "s", "music.title": "s", "music.authorname": "s", "discovery_input": "o",
    "discovery_input.search_keyword": "s", "input": "o", "input.discovery_input": "o",
    "input.discovery_input.search_keyword": "s",
}
# First three letters of the JSON value's type name.
STRING, BOOLEAN, OBJECT, VOID, ARRAY, WHOLE = "STR", "BOO", "OBJ", "VOI", "ARR", "BIG"
NUMBERS = (WHOLE, "DEC", "DOU")  # all that a parsed JSON number can be
KINDS = {"s": STRING, "b": BOOLEAN, "o": OBJECT, "z": VOID, "l": ARRAY, "m": ARRAY}
V = "_v"
# Columns of one step: a step is one generated method, and the JVM compiles none above 8,000 bytes of code.
STEP = 14


def _get(v: str | Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _word(v: Column) -> Column:
    """Type of a JSON value by its first three letters: STR, BIG, VOI, ARR, ..."""
    return F.substring(F.schema_of_variant(v), 1, 3)


def _name(prefix: str, path: str) -> str:
    return f"{prefix}_{path.replace('.', '__')}"


def _once(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections above it read the finished values: Catalyst would
    otherwise push a reject filter down by copying the whole parse into it.
    The outer form, because the inner one gets an inferred size filter that
    repeats the row expression. Functions with lambdas stay out of ``cols``: they
    would have the whole row evaluated by the interpreter.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*(keep or df.columns), F.inline_outer(F.array(row)))


class Fields:
    """Declared fields of a payload, by path, as columns that are computed once per row.

    The methods name the columns an output needs; ``parse`` then adds them all
    and ``_bad``. Every object is taken apart in one pass over its fields: a
    search by path passes over all of them again for each path and each use.
    """

    def __init__(self, spec: dict[str, str]):
        self.spec, self.values = spec, {}

    def _value(self, prefix: str, path: str, kinds, get: Column) -> Column:
        self.values[_name(prefix, path)] = F.when(F.col(_name("_k", path)).isin(*kinds), get)
        return F.col(_name(prefix, path))

    def has(self, path: str) -> Column:
        self.values[_name("_has", path)] = self._at(path).isNotNull()
        return F.col(_name("_has", path))

    def text(self, path: str) -> Column:
        return self._value("_s", path, [STRING], _get(self._at(path), "string"))

    def id(self, path: str) -> Column:
        """A string as is, a whole number as its digits."""
        return self._value("_i", path, [STRING, *NUMBERS], _get(self._at(path), "string"))

    def _bare(self, path: str) -> Column:
        return self._value("_t", path, [STRING], T.strip_space(_get(self._at(path), "string")))

    def _whole(self, path: str) -> Column:
        return self._value("_w", path, [WHOLE], _get(self._at(path), "bigint"))

    def _fraction(self, path: str) -> Column:
        return self._value("_n", path, [k for k in NUMBERS if k != WHOLE], _get(self._at(path), "double"))

    def _number(self, path: str) -> Column:
        return F.coalesce(self._whole(path).cast("double"), self._fraction(path))

    def count(self, path: str) -> Column:
        whole, fraction, bare = self._whole(path), self._fraction(path), self._bare(path)
        return F.when(whole.isNotNull(), F.when(whole >= 0, whole)).when(fraction.isNotNull(), T.count_from_number(fraction)).otherwise(T.count_from_bare(bare))

    def duration(self, path: str) -> Column:
        number, bare = self._number(path), self._bare(path)
        return F.when(number.isNotNull(), T.duration_from_number(number)).otherwise(T.duration_from_bare(bare))

    def time(self, path: str) -> Column:
        number, bare = self._number(path), self._bare(path)
        return F.when(number.isNotNull(), T.time_from_number(number)).otherwise(T.time_from_bare(bare))

    def flag(self, path: str) -> Column:
        return self._value("_b", path, [BOOLEAN], _get(self._at(path), "boolean"))

    def names(self, path: str) -> Column:
        """Names out of an array of strings and of objects carrying a name; null for any other item."""
        return F.col(_name("_names", path))

    def _at(self, path: str) -> Column:
        return F.col(_name("_v", path))

    def _apart(self, df: DataFrame, parent: str, keep: list[str]) -> DataFrame:
        """Add ``_f_<parent>``, null for anything but an object, and every declared field of it as a column."""
        own = [p for p in self.spec if p.rpartition(".")[0] == parent]
        shape = f"struct<{','.join(p.rpartition('.')[2] + ':variant' for p in own)}>"
        df = _once(df, {_name("_f", parent): _get(_name("_v", parent) if parent else V, shape)}, keep)
        return df.select("*", F.inline_outer(F.array(_name("_f", parent))).alias(*[_name("_v", p) for p in own]))

    def parse(self, raw: DataFrame) -> DataFrame:
        df = self._apart(raw.withColumn(V, F.try_parse_json("payload")), "", raw.columns)
        for p in [p for p, a in self.spec.items() if a == "o"]:
            df = self._apart(df, p, df.columns)
        lists = [p for p, a in self.spec.items() if a in ("l", "m")]
        plain = [p for p, a in self.spec.items() if a not in ("o", "l", "m")]
        kinds = {_name("_k", p): _word(self._at(p)) for p in plain}
        df = _once(df, {**kinds, **{_name("_l", p): _get(self._at(p), "array<variant>") for p in lists}})
        # Only an object can be taken apart, and only an array cast to one.
        bad = F.col("_f_").isNull()
        for p, allowed in self.spec.items():
            if p in plain:
                bad = bad | F.coalesce(~F.col(_name("_k", p)).isin(*_words(allowed)), F.lit(False))
            else:
                bad = bad | (self._at(p).isNotNull() & F.col(_name("_f" if allowed == "o" else "_l", p)).isNull())
        df = _once(df, {"_bad": bad})
        values = list(self.values.items())
        for i in range(0, len(values), STEP):
            df = _once(df, dict(values[i : i + STEP]))
        df = df.select(*raw.columns, "_bad", *self.values, *[_name("_l", p) for p in lists])
        df = df.withColumns({_name("_names", p): _tag_names(F.col(_name("_l", p)), self.spec[p] == "m") for p in lists})
        for p in lists:
            df = df.withColumn("_bad", F.col("_bad") | F.coalesce(F.exists(_name("_names", p), F.isnull), F.lit(False)))
        return df


def _words(allowed: str) -> list[str]:
    return sorted({w for a in allowed for w in (NUMBERS if a == "n" else (KINDS[a],))})


def _tag_names(items: Column, objects: bool) -> Column:
    def name(x: Column) -> Column:
        own = F.when(_word(x) == STRING, _get(x, "string"))
        return own.when(_word(_get(x, "variant", "$.name")) == STRING, _get(x, "string", "$.name")) if objects else own

    return F.transform(items, name)


def _music(*parts: Column) -> Column:
    some = None
    for p in parts:
        full = F.coalesce(F.length(p) > 0, F.lit(False))
        some = full if some is None else some | full
    return F.when(some, F.struct(parts[0].alias("id"), parts[1].alias("title"), parts[2].alias("author")))


def _views_metric(name: str) -> Column:
    return F.when(F.col("_views").isNotNull(), name)


def _shape(
    df: DataFrame, keep: list[str], *, external_id, id_ok, url, platform, content_type, username, creator_id, followers, verified,
    caption, tags, music, published, duration, views, views_metric, likes, comments, shares, saves,
) -> DataFrame:
    none = F.array().cast("array<string>")
    # The URL feeds several outputs, so it becomes a column before the rest.
    df = _once(df, {"_bad_id": ~F.coalesce(id_ok, F.lit(False)), "_url": url})
    kind = F.when(F.col("_bad"), "INVALID").when(F.col("_bad_id"), "MISSING_ID").when(F.col("_url").isNull(), "INVALID_URL")
    df = _once(df, {"_reject": kind, "_published": published, "_duration": duration})
    counts = {"_followers": followers.cast("bigint"), "_likes": likes, "_comments": comments, "_shares": shares, "_saves": saves.cast("bigint")}
    df = _once(df, counts)
    # One sentence per failure kind.
    reason = (
        F.when(F.col("_reject") == "INVALID", "payload failed field validation")
        .when(F.col("_reject") == "MISSING_ID", "no usable post id")
        .when(F.col("_reject") == "INVALID_URL", "no canonical URL can be built")
    )
    out = {
        "post_platform": F.lit(platform),
        "external_id": external_id,
        "canonical_url": F.col("_url"),
        "content_type": content_type,
        "creator": F.struct(
            username.alias("username"), creator_id.alias("external_id"), F.col("_followers").alias("followers"),
            verified.alias("verified"),
        ),
        "caption": caption,
        "hashtags": F.concat(*[F.coalesce(F.when(F.col("_reject").isNull(), t), none) for t in tags]),
        "music": music,
        "published_at": F.col("_published"),
        "duration_sec": F.col("_duration"),
        "metrics": F.struct(
            views.alias("views"), views_metric.alias("views_metric"), F.col("_likes").alias("likes"), F.col("_comments").alias("comments"),
            F.col("_shares").alias("shares"), F.col("_saves").alias("saves"),
        ),
        "reject_kind": F.col("_reject"),
        "reject_reason": reason,
    }
    done = _once(df, out, keep).withColumn("hashtags", T.bare_tags(F.col("hashtags")))
    return done.withColumn("hashtags", T.clean_bare_tags(F.col("hashtags")))


def normalize_a_p1(raw: DataFrame) -> DataFrame:
    f = Fields(A_P1)
    caption, url, names = f.text("text"), f.text("webVideoUrl"), [f.text("authorMeta.uniqueId"), f.text("authorMeta.name")]
    pid, views, handle = f.id("id"), F.col("_views"), F.col("_handle")
    first = {"_views": f.count("playCount"), "_handle": F.coalesce(T.video_handle(url), *names)}
    out = dict(
        external_id=pid, id_ok=pid.rlike(T.VIDEO_ID), url=T.video_url(handle, pid), platform="tiktok",
        content_type=F.when(f.flag("isSlideshow"), "carousel").otherwise("video"), username=handle, creator_id=f.text("authorMeta.id"),
        followers=f.count("authorMeta.fans"), verified=f.flag("authorMeta.verified"), caption=caption,
        tags=[f.names("hashtags"), T.caption_tags(caption)],
        music=_music(f.text("musicMeta.musicId"), f.text("musicMeta.musicName"), f.text("musicMeta.musicAuthor")),
        published=F.when(f.has("createTimeISO"), f.time("createTimeISO")).otherwise(f.time("createTime")),
        duration=f.duration("videoMeta.duration"), views=views, views_metric=_views_metric("tt_apify_play_count"),
        likes=f.count("diggCount"), comments=f.count("commentCount"), shares=f.count("shareCount"), saves=f.count("collectCount"),
    )
    return _shape(_once(f.parse(raw), first), raw.columns, **out)


def normalize_a_p2(raw: DataFrame) -> DataFrame:
    f = Fields(A_P2)
    code, plays, seen, caption = F.col("_code"), F.col("_plays"), F.col("_seen"), f.text("caption")
    first = {
        "_code": F.coalesce(f.text("shortCode"), T.post_shortcode(f.text("url"))),
        "_plays": f.count("videoPlayCount"), "_seen": f.count("videoViewCount"),
    }
    kind = (
        F.when(f.text("productType") == "clips", "reel").when(f.text("type") == "Image", "image")
        .when(f.text("type") == "Sidecar", "carousel").when(f.text("type") == "Video", "video").otherwise("unknown")
    )
    out = dict(
        external_id=code, id_ok=F.length(code) > 0, url=T.post_url(code), platform="instagram",
        content_type=kind, username=f.text("ownerUsername"), creator_id=f.text("ownerId"), followers=F.lit(None), verified=F.lit(None).cast("boolean"),
        caption=caption, tags=[f.names("hashtags"), T.caption_tags(caption)],
        music=_music(f.text("musicInfo.audio_id"), f.text("musicInfo.song_name"), f.text("musicInfo.artist_name")), published=f.time("timestamp"),
        duration=f.duration("videoDuration"), views=F.coalesce(plays, seen),
        views_metric=F.when(plays.isNotNull(), "ig_apify_video_play_count").when(seen.isNotNull(), "ig_apify_video_view_count"),
        likes=f.count("likesCount"), comments=f.count("commentsCount"), shares=f.count("reshareCount"), saves=F.lit(None),
    )
    return _shape(_once(f.parse(raw), first), raw.columns, **out)


def normalize_b_p1(raw: DataFrame) -> DataFrame:
    f = Fields(B_P1)
    pid, views, caption, handle = f.id("post_id"), F.col("_views"), f.text("description"), F.col("_handle")
    first = {
        "_views": f.count("play_count"), "_handle": F.coalesce(T.video_handle(f.text("url")), T.profile_handle(f.text("profile_url"))),
    }
    out = dict(
        external_id=pid, id_ok=pid.rlike(T.VIDEO_ID), url=T.video_url(handle, pid), platform="tiktok",
        content_type=F.when(f.text("post_type") == "video", "video").otherwise("unknown"), username=handle, creator_id=f.text("profile_id"),
        followers=f.count("profile_followers"), verified=f.flag("is_verified"), caption=caption,
        tags=[f.names("hashtags"), T.caption_tags(caption)], music=_music(f.text("music.id"), f.text("music.title"), f.text("music.authorname")),
        published=f.time("create_time"), duration=f.duration("video_duration"), views=views,
        views_metric=_views_metric("tt_brightdata_play_count"), likes=f.count("digg_count"), comments=f.count("comment_count"),
        shares=f.count("share_count"), saves=f.count("collect_count"),
    )
    return _shape(_once(f.parse(raw), first), raw.columns, **out)


NORMALIZERS = {
    ("apify", "tiktok"): normalize_a_p1,
    ("apify", "instagram"): normalize_a_p2,
    ("brightdata", "tiktok"): normalize_b_p1,
}


def _unsupported(raw: DataFrame, like: DataFrame) -> DataFrame:
    extra = [f for f in like.schema.fields if f.name not in raw.columns and not f.name.startswith("reject")]
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    return raw.select(
        "*", *nulls, F.lit("UNSUPPORTED").alias("reject_kind"), F.lit("no normaliser for this source").alias("reject_reason")
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Normalise rows (provider, platform, payload, ...) of any mix of sources.

    One projection per supported source; anything else is rejected.
    """
    parts, other = [], F.lit(True)
    for (provider, platform), fn in NORMALIZERS.items():
        hit = (F.col("provider") == provider) & (F.col("platform") == platform)
        parts.append(fn(raw.where(hit)))
        other = other & ~F.coalesce(hit, F.lit(False))
    parts.append(_unsupported(raw.where(other), parts[0]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = normalized.where("reject_kind is null").drop("reject_kind", "reject_reason", "payload")
    bad = normalized.where("reject_kind is not null")
    return good, bad


def quarantine_rows(stored: DataFrame | None, rejects: DataFrame, now) -> DataFrame:
    """Rejects to append: one row per (job, payload), none that is stored already.

    Rows without a job are always kept. Matching goes by a digest, so the
    payload text itself does not travel as a join key.
    """
    key = ["provider_job_id", "digest"]
    rows = rejects.select(
        "provider", "platform", "provider_job_id", "payload", F.sha2("payload", 256).alias("digest"),
        F.concat_ws(": ", "reject_kind", "reject_reason").alias("error"), now.alias("created_at"),
    )
    keyed = rows.where("provider_job_id is not null").dropDuplicates(key)
    if stored is not None:
        old = stored.where("provider_job_id is not null").select("provider_job_id", F.sha2("payload", 256).alias("digest")).distinct()
        keyed = keyed.join(old, key, "left_anti").select(*rows.columns)
    return keyed.unionByName(rows.where("provider_job_id is null")).drop("digest")


def domain_errors(df: DataFrame) -> DataFrame:
    """Array column ``domain_errors`` naming every column outside its allowed values."""
    allowed = {
        "platform": PLATFORMS, "provider": PROVIDERS, "content_type": CONTENT_TYPES, "category": CATEGORIES,
        "views_metric": VIEWS_METRICS,
    }
    checks = []
    for c in df.columns:
        if c in allowed:
            checks.append(F.when(~F.coalesce(F.col(c).isin(*allowed[c]), F.lit(False)), c))
        elif c == "market":
            checks.append(F.when(~F.coalesce(F.col(c).rlike(T.MARKET), F.lit(False)), c))
    return df.withColumn("domain_errors", F.array_compact(F.array(*checks)))
