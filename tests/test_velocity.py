import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest

from crestline.config import DEFAULT
from crestline.operators.velocity import post_velocity

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
SNAP = "post_id long, observed_at timestamp, views long"


def at(hours):
    return T0 + timedelta(hours=hours)


def run(spark, cases, now, cfg=DEFAULT):
    """cases: {id: (published hour or None, [(hour, views)])}"""
    posts = spark.createDataFrame([(i, None if p is None else at(p)) for i, (p, _) in cases.items()], "post_id long, published_at timestamp")
    snaps = spark.createDataFrame([(i, at(h), v) for i, (_, s) in cases.items() for h, v in s], SNAP)
    return {r.post_id: r for r in post_velocity(posts, snaps, at(now), cfg).collect()}


def brute(published, snaps, now, gap=0.75):
    pts = sorted(((h, v) for h, v in snaps if v is not None))
    if published is None or not pts:
        return ("NONE", None, None, None, False)
    anchor, ivs = (published, 0, True), []
    for h, v in pts:
        if round((h - anchor[0]) * 3600, 6) < gap * 3600:
            continue
        ivs.append((max(v - anchor[1], 0) / (h - anchor[0]), v < anchor[1], anchor[2]))
        anchor = (h, v, False)
    drop = any(d for _, d, _ in ivs)
    real = [r for r, _, b in ivs if not b]
    if real:
        return ("OBSERVED", real[-1], real[-2] if len(real) > 1 else None, "HIGH" if len(real) > 1 else "MEDIUM", drop)
    if ivs:
        return ("ESTIMATED", ivs[0][0], None, "LOW", drop)
    return ("ESTIMATED", pts[-1][1] / max(now - published, 1), None, "LOW", drop)


def check(row, want):
    assert (row.vph_kind, row.velocity_confidence, row.had_negative_delta) == (want[0], want[3], want[4])
    assert row.vph == pytest.approx(want[1]) if want[1] is not None else row.vph is None
    assert row.vph_previous == pytest.approx(want[2]) if want[2] is not None else row.vph_previous is None


def test_known_vectors(spark):
    got = run(
        spark,
        {
            1: (0, [(2, 10_000), (5, 25_000)]),
            2: (0, [(2, 5_000), (5, 20_000), (9, 60_000)]),
            3: (0, [(2, 10_000), (2 + 1 / 3, 10_500), (5, 25_000)]),
            4: (0, [(2, 10_000), (5, 8_000)]),
            5: (9.5, [(9.5 + 1 / 6, 50_000)]),
            6: (None, [(2, 1)]),
            7: (0, [(3, None)]),
        },
        10,
    )
    assert (got[1].vph_kind, got[1].velocity_confidence) == ("OBSERVED", "MEDIUM") and got[1].vph == pytest.approx(5000)
    assert got[2].vph == pytest.approx(10_000) and got[2].vph_previous == pytest.approx(5000) and got[2].velocity_confidence == "HIGH"
    assert got[3].vph == pytest.approx(5000)
    assert got[4].vph == 0 and got[4].had_negative_delta
    assert got[5].vph == pytest.approx(50_000) and got[5].velocity_confidence == "LOW"
    assert got[6].vph_kind == got[7].vph_kind == "NONE" and got[6].vph is None


def cases(n, seed):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        k = rnd.choice([0, 1, 3, 12, 60])
        pub = None if rnd.random() < 0.1 else rnd.randrange(0, 20)
        times = rnd.sample(range(0, 40 * 60), k)
        out[i] = (pub, [(t / 60, None if rnd.random() < 0.1 else rnd.randrange(0, 10_000)) for t in times])
    return out


@pytest.mark.parametrize("limit", [200_000, 5])
def test_random_histories_and_heavy_path(spark, limit):
    """With a limit of 5 rows most posts take the pointer-doubling path."""
    data = cases(60, 7)
    got = run(spark, data, 45, replace(DEFAULT, max_group_rows=limit))
    for i, (p, s) in data.items():
        check(got[i], brute(p, s, 45))
