import random
from datetime import datetime, timedelta, timezone

from crestline.operators import report as R
from crestline.sources import exports

T0 = datetime(2026, 9, 1, tzinfo=timezone.utc)
DDL = "post_id long, platform string, creator_username string, trend_score int, rising_score int, vph double, views long, published_at timestamp"


def greedy(rows, top=30, per=2, floor=8):
    key = lambda r: (-(r[3] or 0), -(r[4] or 0), -(r[5] or 0), -(r[6] or 0), -r[7].timestamp(), r[0])
    srt, chosen, used = sorted(rows, key=key), [], {}
    who = lambda r: (r[1], r[2] or f"anon:{r[0]}")

    def add(r):
        if r in chosen or len(chosen) >= top or used.get(who(r), 0) >= per:
            return False
        chosen.append(r)
        used[who(r)] = used.get(who(r), 0) + 1
        return True

    for p in dict.fromkeys(r[1] for r in srt):
        n = 0
        for r in (x for x in srt if x[1] == p):
            if n >= floor:
                break
            n += add(r)
    for r in srt:
        add(r)
    return [r[0] for r in sorted(chosen, key=key)]


def test_today_top_equals_greedy(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        rows = [
            (i, "tiktok" if rnd.random() < 0.85 else "instagram", rnd.choice([None, *(f"c{j}" for j in range(12))]), rnd.randrange(5), rnd.randrange(3),
             float(rnd.randrange(3)), rnd.choice([None, 1, 2]), T0 + timedelta(hours=rnd.randrange(3)))
            for i in range(rnd.choice([5, 40, 120]))
        ]
        got = [r.post_id for r in R.today_top(spark.createDataFrame(rows, DDL)).orderBy("rank").collect()]
        assert got == greedy(rows)


def test_window_edges(spark):
    ages = {1: 24 * 3600, 2: 24 * 3600 + 0.001, 3: 72 * 3600, 4: 72 * 3600 + 0.001, 5: -1, 6: 0}
    df = spark.createDataFrame([(i, T0 - timedelta(seconds=s)) for i, s in ages.items()], "post_id long, published_at timestamp")
    got = {r.post_id: r.w for r in df.select("post_id", R.window_of(T0).alias("w")).collect()}
    assert got == {1: "TODAY", 2: "STILL_HOT", 3: "STILL_HOT", 4: None, 5: None, 6: "TODAY"}


def test_csv_file_has_bom_crlf_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "line\nbreak", "x")], "rank int, caption string, tag string")
    exports.write_csv(df.coalesce(1), str(tmp_path / "out"))
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿rank,caption,tag\r\n".encode()) and b'1,"a,""b""",\r\n' in raw


def test_document_reads_staged_tables(spark):
    """The document's sections read posts and tags that were derived from the events once, not the events again each."""
    from crestline.registry.model import model
    from crestline.registry.report import document

    assert not [f for f in document(model(spark, "/root/testdata/sf0.001")).inputFiles() if f.endswith("events.parquet")]
