"""Skew-safe paths give the same rows as the plain ones and as brute force."""

import random
import statistics
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crestline.config import DEFAULT
from crestline.operators import baselines, cooccurrence, ingest, quality
from crestline.operators.quantiles import counted, percentiles

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("p", [0.5, 0.25, 0.9])
def test_percentiles_equal_the_builtin(spark, p):
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([rnd.random() * 1e6, 5.0, 0.0, -rnd.random()])) for _ in range(3000)] + [("same", 2.5)] * 500
    rows += [("even", float(x)) for x in range(300)] + [("small", 1.0), ("small", 4.0), ("one", -7.25), ("near", 1e15), ("near", 1e15 + 1), ("none", None)]
    rows += [("tiny", rnd.random() * 1e-7) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, x double")
    plain = {r.k: (r.n, r.q) for r in df.where("x is not null").groupBy("k").agg(F.count("x").alias("n"), F.percentile("x", p).alias("q")).collect()}
    got = {r.k: (r.n, r.q) for r in percentiles(counted(df, ["k"], "x"), ["k"], {"q": p}).collect()}
    assert got.keys() == plain.keys()
    for k in got:
        assert got[k] == (plain[k][0], pytest.approx(plain[k][1]))


def test_percentiles_spread_a_hot_group(spark):
    """A group that owns nearly all rows: no task after the counting takes more than a few of its values' chunks."""
    rnd = random.Random(6)
    df = spark.createDataFrame([("hot", rnd.random() * 1000) for _ in range(20_000)] + [("cold", 1.0)], "k string, x double")
    text = percentiles(counted(df, ["k"], "x"), ["k"], {"q": 0.5})._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in text.splitlines() if "Window [" in x]
    assert len(windows) >= 2 and "ObjectHashAggregate" not in text and "percentile" not in text
    got = percentiles(counted(df, ["k"], "x"), ["k"], {"lo": 0.01, "hi": 0.99}).where("k = 'hot'").first()
    want = df.where("k = 'hot'").select(F.percentile("x", 0.01).alias("a"), F.percentile("x", 0.99).alias("b")).first()
    assert (got.lo, got.hi) == (pytest.approx(want.a), pytest.approx(want.b))


def test_median_and_mad(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.gauss(0, 1)) for k in ("a", "b") for _ in range(400)] + [("c", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in baselines.median_and_mad(df, ["k"]).collect()}
    for k in ("a", "b", "c"):
        xs = [x for kk, x in rows if kk == k and x is not None]
        m = statistics.median(xs)
        assert got[k].n == len(xs) and got[k].median == pytest.approx(m)
        assert got[k].mad == pytest.approx(statistics.median(abs(x - m) for x in xs))


def test_freshness_percentiles(spark):
    rows = [(s, T0 - timedelta(minutes=i * i % 6000)) for s in ("x", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "source string, at timestamp")
    ages = sorted((i * i % 6000) / 60 for i in range(300))
    for r in quality.freshness_profile(df, ["source"], "at", T0).collect():
        pos = 299 * 0.9
        want = ages[int(pos)] + (ages[int(pos) + 1] - ages[int(pos)]) * (pos - int(pos))
        assert abs(r.p90_age_hours - want) <= 0.051


def brute_dedup(rows, minutes):
    out, last = [], {}
    for post, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        k = last.get(post)
        if k and t - k[0] <= timedelta(minutes=minutes) and v == k[1]:
            continue
        last[post] = (t, v)
        out.append((post, t, v))
    return out


@pytest.mark.parametrize("limit", [200_000, 10])
def test_snapshot_dedup(spark, limit):
    rnd = random.Random(3)
    rows = []
    for post in range(12):
        t = T0
        for _ in range(rnd.choice([3, 30, 120])):
            t += timedelta(seconds=rnd.choice([1, 60, 120, 240, 299, 300, 301, 900]))
            rows.append((post, t, rnd.choice([None, 1, 1, 1, 1, 2])))
    df = spark.createDataFrame(rows, "post_id long, observed_at timestamp, views long")
    df = df.withColumns({m: F.lit(None).cast("long") for m in ("likes", "comments", "shares", "saves")})
    got = ingest.dedup_snapshots(df, replace(DEFAULT, max_group_rows=limit)).select("post_id", F.unix_micros("observed_at"), "views").collect()
    want = [(p, int(t.timestamp() * 1e6), v) for p, t, v in brute_dedup(rows, 5)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_zero_four_eight_minutes(spark):
    df = spark.createDataFrame([(1, T0 + timedelta(minutes=m), 5) for m in (0, 4, 8)], "post_id long, observed_at timestamp, views long")
    df = df.withColumns({m: F.lit(None).cast("long") for m in ("likes", "comments", "shares", "saves")})
    kept = ingest.dedup_snapshots(df).select((F.minute("observed_at"))).collect()
    assert sorted(r[0] for r in kept) == [0, 8]
    assert ingest.new_snapshots(ingest.dedup_snapshots(df), df).isEmpty()


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(12)] + [(300, 300 + i) for i in range(1, 20)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    low = {}
    for x in parent:
        low.setdefault(root(x), []).append(x)
    want = {x: min(g) for g in low.values() for x in g}
    got = cooccurrence.components(spark.createDataFrame(edges, "tag_a long, tag_b long"))
    assert {r.node: r.component for r in got.collect()} == want
