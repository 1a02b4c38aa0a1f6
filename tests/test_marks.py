"""Marks that expire: plain loops for the batch, and a stream with replays and late rows against the batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarryline.streaming.marks import live_marks, mark_changes

START = datetime(2024, 1, 1)
SCHEMA = "key long, at timestamp, action string, value string"


def made(rng, n):
    return [(rng.choice([None, *range(30)]), rng.choice([None, *[START + timedelta(seconds=rng.randrange(9000)) for _ in range(20)]]), rng.choice(["set", "set", "clear", None]), rng.choice(["a", "b", None])) for _ in range(n)]


def plain(rows, now, ttl):
    latest = {}
    for key, at, action, value in rows:
        if key is not None and at is not None and action is not None:
            latest[key] = max(latest.get(key, (datetime.min, "", "")), (at, action, value or ""))
    return {(k, at, v) for k, (at, action, v) in latest.items() if action == "set" and at >= now - timedelta(seconds=ttl)}


def test_live_marks_like_plain_loops(spark):
    rows = made(random.Random(1), 120)
    now = START + timedelta(seconds=6000)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in live_marks(frame, F.lit(now), 1800).collect()} == plain(rows, now, 1800)
    assert live_marks(frame.filter("false"), F.lit(now), 60).count() == 0


def test_stream_equals_batch_after_replays_and_late_rows(spark, tmp_path):
    rng, ttl = random.Random(2), 1200
    parts = [made(rng, 60) for _ in range(4)]
    parts += [parts[0], [(99, START, "set", "very late"), (98, START + timedelta(seconds=9000), "set", "last")]]
    folder = str(tmp_path / "marks")
    seen, changes = [], None
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        seen += rows
        changes = mark_changes(spark, folder, "marks", ttl, str(tmp_path))
    now = START + timedelta(seconds=9000)
    assert {tuple(r) for r in live_marks(changes, F.lit(now), ttl).collect()} == plain(seen, now, ttl)
    # a run without new files changes nothing
    assert mark_changes(spark, folder, "marks", ttl, str(tmp_path)).count() == changes.count()
    assert changes.filter("action = 'expired'").count() > 0 or changes.filter("key = 99").count() == 0
