"""Streaming forms give the rows of the batch forms."""

import pytest

from weftlight.streaming import streams

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, make, mode, marked=True):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "coalesce(value, 0.0) as value").orderBy("ts")
    for i, part in enumerate(events.randomSplit([1.0, 1.0, 1.0], 7)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    batch = spark.read.parquet(*[str(tmp_path / f"in/{i}") for i in range(3)])
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in/*"))
    name = "out" + tmp_path.name.replace("-", "_")
    q = make(source.withWatermark("ts", "60 days") if marked else source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, make(batch).collect()))


@pytest.mark.parametrize("make", [lambda e: streams.tumbling(e, "user_id", "ts", "1 day", "value").drop("total"), lambda e: streams.sliding(e, "event_type", "ts", "2 hours", "1 hour")])
def test_windows(spark, tmp_path, make):
    a, b = streamed(spark, tmp_path, make, "complete")
    assert a == b


def test_deduplication(spark, tmp_path):
    a, b = streamed(spark, tmp_path, lambda e: streams.deduplicated(e, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append", False)
    assert a == b


def test_stateful_quota(spark, tmp_path):
    a, b = streamed(spark, tmp_path, lambda e: streams.quota(e, "user_id", "ts", "value", "event_id", 86400.0, 100.0), "append")
    assert len(a) == len(b) and {r[:2] for r in a} == {r[:2] for r in b}


def test_steps():
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    s, ok = streams.quota_step(None, t, 6, 60, 10)
    assert ok
    s, ok = streams.quota_step(s, t + timedelta(seconds=30), 5, 60, 10)
    assert not ok and s[1] == 6
    s, ok = streams.quota_step(s, t + timedelta(seconds=60), 5, 60, 10)
    assert ok and s == (t + timedelta(seconds=60), 5)
    times, allowed = [], []
    for x in (0, 1, 2, 3, 61):
        times, ok = streams.limit_step(times, x * 1_000_000, (60, 3), (5, 10))
        allowed.append(ok)
    assert allowed == [True, True, True, False, True]
