from pyspark.sql import functions as F

from crestline.functions import text as T
from crestline.operators.redact import redact


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tags_keep_order_and_unicode(spark):
    raw = F.array(*[F.lit(x) for x in (" #Gaming ", "ｆｕｌｌ", "коСПЛЕЙ", "日本", "no good", "", "gaming", "##x", "a" * 101, "под_черк1\n", "①")])
    assert one(spark, T.clean_tags(raw)) == ["gaming", "full", "косплей", "日本", "под_черк1", "1"]
    assert one(spark, T.merge_tags(F.array(F.lit("B")), T.caption_tags(F.lit("x #b #Año, #c!")))) == ["b", "año", "c"]
    assert one(spark, T.caption_tags(F.lit(None).cast("string"))) == []


def test_numbers_and_dates(spark):
    assert one(spark, T.count_from_text(F.lit(" 12 "))) == 12
    for bad in ("-1", "1.5", "", "N/A", "+3"):
        assert one(spark, T.count_from_text(F.lit(bad))) is None
    assert one(spark, T.count_from_number(F.lit(10.9))) == 10 and one(spark, T.count_from_number(F.lit(-1.0))) is None
    assert one(spark, T.duration_from_text(F.lit("1.5"))) == 1.5
    secs = one(spark, F.unix_micros(T.time_from_text(F.lit("1757000000"))))
    assert secs == one(spark, F.unix_micros(T.time_from_number(F.lit(1757000000000.0)))) == 1757000000 * 10**6
    assert one(spark, T.time_from_text(F.lit("nonsense"))) is None


def test_urls(spark):
    u = lambda s: F.lit(s)
    assert one(spark, T.video_handle(u("https://www.tiktok.com/@a.b-c/video/12345?x=1#y"))) == "a.b-c"
    assert one(spark, T.video_id(u("https://TIKTOK.com/@a/video/12345/"))) == "12345"
    for bad in ("https://tiktok.com.evil.net/@a/video/12345", "https://m.tiktok.com/@a/video/12345", "https://www.tiktok.com/@a", "x", "https://www.tiktok.com/@a/video/12345\n"):
        assert one(spark, T.video_id(u(bad))) is None
    assert one(spark, T.profile_handle(u("https://www.tiktok.com/@who/"))) == "who"
    for kind in ("p", "reel", "reels", "tv"):
        assert one(spark, T.post_shortcode(u(f"https://instagram.com/{kind}/Ab_-12/more?x"))) == "Ab_-12"
    assert one(spark, T.post_shortcode(u("https://www.instagram.com/someone/"))) is None
    assert one(spark, T.video_url(u("a b"), u("12345"))) is None and one(spark, T.post_url(u("abcde"))) == "https://www.instagram.com/p/abcde/"


def test_redaction_reaches_nested_values(spark):
    df = spark.sql("SELECT named_struct('api_key', 'k', 'list', array(named_struct('t', 'has hunter2x inside', 'n', 5)), 'cookies', map('a', 'b')) AS r, 'hunter2x' AS note, 'abc' AS short")
    r = redact(df, ["hunter2x", "abc"]).first()
    assert r.r.api_key == "[REDACTED]" and r.r.list[0].t == "has [REDACTED] inside" and r.r.list[0].n == 5
    assert r.note == "[REDACTED]" and r.short == "abc"


def test_compatibility_forms_equal_unicodedata(spark):
    """All assigned code points, and sequences that combine; no Python worker in the plan."""
    import unicodedata

    rnd = __import__("random").Random(1)
    points = [chr(c) for c in range(2, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in points if unicodedata.combining(c)]
    words = ["".join(points[i : i + 1]) for i in range(len(points))]
    words += ["".join([rnd.choice(points), *rnd.choices(marks, k=rnd.randrange(1, 4)), rnd.choice(points)]) for _ in range(20_000)]
    lists = [words[i : i + 500] for i in range(0, len(words), 500)]
    df = spark.createDataFrame([(x,) for x in lists], "t array<string>").select("t", T.nfkc(F.col("t")).alias("n"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        for a, b in zip(r.t, r.n):
            assert b == unicodedata.normalize("NFKC", a), [hex(ord(c)) for c in a]
    odd = spark.createDataFrame([(["a\u0001b", None, "ﬁ"],)], "t array<string>").select(T.nfkc(F.col("t")).alias("n")).first().n
    assert odd == ["", "", "fi"]
