"""A stream over files ends in the same state as the batch aggregation."""

import pytest

from quarryline.operators.state import observations, target_health
from quarryline.streaming.health import health_stream, hourly_counts


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    events.filter("event_id % 2 = 0").repartition(3).write.parquet(folder)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            health_stream(spark, folder, "health_test")
    for batch in (events.filter("event_id % 2 = 0"), events):  # the second call adds the files that have come since
        streamed = health_stream(spark, folder, "health_test", str(tmp_path / "shared"))
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, target_health(observations(batch)).collect()))
        events.filter("event_id % 2 = 1").repartition(2).write.mode("append").parquet(folder)


def test_hourly_counts_cover_all(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert hourly_counts(events).agg({"n": "sum"}).first()[0] == events.count()
