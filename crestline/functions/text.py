"""Parsers for tags, counts, dates and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TAG = 100
# Accepted shapes of tags, handles, ids and permalinks.
TAG = r"\A[\p{L}\p{N}_]+\z"
CAPTION_TAG = r"#([\p{L}\p{N}_]+)"
HANDLE = r"\A[\w.-]{1,80}\z"
VIDEO_ID = r"\A\d{5,25}\z"
SHORTCODE = r"\A[A-Za-z0-9_-]{5,20}\z"
VIDEO_PATH = r"/@([\w.-]{1,80})/video/(\d{5,25})/?"
PROFILE_PATH = r"/@([\w.-]{1,80})/?"
POST_PATH = r"/(?:p|reel|reels|tv)/([A-Za-z0-9_-]{5,20})(?:/[^?#]*)?"
MARKET = r"\A[a-z][a-z0-9_-]{1,31}\z"


SPACES = "".join(map(chr, (*range(9, 14), 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)))


def strip_space(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


# --- numbers -----------------------------------------------------------------------

def count_from_text(c: Column) -> Column:
    """Digits only; signs, decimals and words give null."""
    return count_from_bare(strip_space(c))


def count_from_bare(s: Column) -> Column:
    """As ``count_from_text``, of a text without outer white space."""
    return F.when(s.rlike(r"\A\d+\z"), s.try_cast("bigint"))


def count_from_number(c: Column) -> Column:
    """Truncated; negatives (hidden counts) and non-finite values give null."""
    d = c.cast("double")
    return F.when((d >= 0) & ~F.isnan(d) & (d < 9.2e18), F.floor(d).cast("bigint"))


def duration_from_text(c: Column) -> Column:
    return duration_from_bare(strip_space(c))


def duration_from_bare(s: Column) -> Column:
    return F.when(s.rlike(r"\A\d+(\.\d+)?\z"), s.try_cast("double"))


def duration_from_number(c: Column) -> Column:
    d = c.cast("double")
    return F.when((d >= 0) & ~F.isnan(d) & (d < float("inf")), d)


# --- dates -------------------------------------------------------------------------

def time_from_number(c: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e12 in size."""
    d = c.cast("double")
    ms = F.when(F.abs(d) > 1e12, d).otherwise(d * 1000)
    return F.when(~F.isnan(d) & (F.abs(ms) <= 8.64e15), F.timestamp_millis(ms.cast("bigint")))


def time_from_text(c: Column) -> Column:
    return time_from_bare(strip_space(c))


def time_from_bare(s: Column) -> Column:
    return F.when(s.rlike(r"\A\d+\z"), time_from_number(s.try_cast("double"))).when(s != "", F.try_to_timestamp(s))


# --- tags --------------------------------------------------------------------------

_JOINT = "\u0001"


def nfkc(tokens: Column) -> Column:
    """Compatibility-normalise an array of tokens on the JVM; pure ASCII rows skip the work.

    The Unicode library that Spark ships (for its collations) has a static
    method for it. Tokens are joined by a control character, which normalises
    to itself and never combines; null tokens, and tokens that hold that
    character, become empty.
    """
    joined = F.coalesce(F.array_join(F.transform(tokens, lambda t: F.when(t.contains(_JOINT), "").otherwise(F.coalesce(t, F.lit("")))), _JOINT), F.lit(""))
    done = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), joined, F.lit(True))
    return F.when(joined.rlike(r"\A\p{ASCII}*\z"), tokens).otherwise(F.split(done, _JOINT))


def clean_tags(raw: Column) -> Column:
    """Normalised tags of an array of raw names, first-seen order, no duplicates."""
    return clean_bare_tags(bare_tags(raw))


def bare_tags(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.regexp_replace(strip_space(t), r"\A#", ""))


def clean_bare_tags(bare: Column) -> Column:
    """Second half of ``clean_tags``; it reads ``bare`` in several places, so a stored column spares work."""
    low = F.transform(nfkc(bare), lambda t: F.lower(strip_space(t)))
    ok = F.filter(low, lambda t: t.rlike(TAG) & (F.length(t) <= MAX_TAG))
    return F.array_distinct(ok)


def caption_tags(caption: Column) -> Column:
    return F.when(caption.isNotNull(), F.regexp_extract_all(caption, F.lit(CAPTION_TAG), F.lit(1))).otherwise(
        F.array().cast("array<string>")
    )


def merge_tags(*lists: Column) -> Column:
    none = F.array().cast("array<string>")
    return clean_tags(F.concat(*[F.coalesce(x, none) for x in lists]))


# --- URLs --------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\Awww\.", "")


def _path_part(url: Column, host: str, path: str, group: int) -> Column:
    """A path group of a URL on the given host; one pass over the text."""
    own = host.replace(".", r"\.")
    pattern = rf"\A(?i:[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?{own})(?::\d+)?{path}(?:[?#].*)?\z"
    part = F.regexp_extract(url, pattern, group)
    return F.when(part != "", part)


def video_handle(url: Column) -> Column:
    return _path_part(url, "tiktok.com", VIDEO_PATH, 1)


def video_id(url: Column) -> Column:
    return _path_part(url, "tiktok.com", VIDEO_PATH, 2)


def profile_handle(url: Column) -> Column:
    return _path_part(url, "tiktok.com", PROFILE_PATH, 1)


def post_shortcode(url: Column) -> Column:
    return _path_part(url, "instagram.com", POST_PATH, 1)


def video_url(handle: Column, external_id: Column) -> Column:
    ok = handle.rlike(HANDLE) & external_id.rlike(VIDEO_ID)
    return F.when(ok, F.concat(F.lit("https://www.tiktok.com/@"), handle, F.lit("/video/"), external_id))


def post_url(shortcode: Column) -> Column:
    return F.when(shortcode.rlike(SHORTCODE), F.concat(F.lit("https://www.instagram.com/p/"), shortcode, F.lit("/")))
