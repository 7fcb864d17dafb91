"""A tag or hub that owns a third of the rows does not fill one task."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from crestline.operators import categories, cooccurrence
from crestline.operators.skew import salted_join
from crestline.session import materialize


@pytest.fixture()
def dealt(spark):
    """Plain shuffles: no coalescing, no splitting, no automatic broadcast."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def balanced(df, times=3):
    n = [r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(n) <= times * statistics.median(n), n


def test_hot_tag_is_dealt_over_salts(dealt):
    rnd = random.Random(1)
    rows = [(p, 0 if p % 3 == 0 else rnd.randrange(1, 400)) for p in range(30_000)]
    bridge = materialize(dealt.createDataFrame(rows, "post_id long, hashtag_id long"), "bridge")
    known = materialize(dealt.createDataFrame([(t, f"c{t % 3}") for t in range(400)], "hashtag_id long, category string"), "known")
    joined = salted_join(bridge, known, "hashtag_id", "post_id")
    assert joined.count() == 30_000
    balanced(joined)
    with pytest.raises(AssertionError):
        balanced(bridge.join(known, "hashtag_id"))


def test_hub_is_joined_by_broadcast(dealt):
    rnd = random.Random(2)
    edges = [(0, i) for i in range(1, 10_000)] + [(rnd.randrange(10_000, 30_000), rnd.randrange(10_000, 30_000)) for _ in range(20_000)]
    e = materialize(dealt.createDataFrame([(max(a, b), min(a, b)) for a, b in edges if a != b], "u long, v long").distinct(), "edges")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cooccurrence._low(both)
    joined = cooccurrence.with_minimum(both, low, e.count())
    assert joined.count() == both.count()
    assert sorted(map(tuple, joined.select("u", "v", "m").collect())) == sorted(map(tuple, both.join(low, "u").select("u", "v", "m").collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    balanced(joined.where("u <> 0"))  # the hub's own rows keep the even layout of the scan


def test_components_with_a_hub(spark):
    rnd = random.Random(3)
    edges = [(5, i) for i in range(100, 2_200)] + [(rnd.randrange(3_000, 6_000), rnd.randrange(3_000, 6_000)) for _ in range(2_500)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    low = {}
    for x in up:
        low.setdefault(root(x), []).append(x)
    want = {x: min(g) for g in low.values() for x in g}
    got = cooccurrence.components(spark.createDataFrame(edges, "tag_a long, tag_b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_keywords_equal_patterns(spark):
    import re

    from crestline.sources.taxonomy import KEYWORDS

    texts = ["GamingPC build", "livestream", "kicK", "KICK it", "steamer", "gam", "videoGame", "", None, "PSN dualSense", "LİVE", "x" * 1000 + "twitch"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", categories.keyword_categories(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else [c for c, words in KEYWORDS.items() if re.search("|".join(words), t, re.I | re.A)]
        assert got[i] == want, t
