"""Streams give what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from facetry.streaming import drift_state, windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    """Events in four files, in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling(spark, folder):
    got = run(spark, windows.tumbling(windows.read_folder(spark, folder, EVENTS, 4), "1 hour", "40 days"), "tumbling", "complete")
    want = windows.tumbling(spark.read.parquet(folder), "1 hour")
    cols = ["start", "event_type", "n"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_sessions(spark, folder):
    got = run(spark, windows.sessions(windows.read_folder(spark, folder, EVENTS, 4), "4 hours", "40 days"), "sessions", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.sessions(spark.read.parquet(folder), "4 hours").collect()))


def test_dedup(spark, folder):
    doubled = windows.read_folder(spark, folder, EVENTS, 4)
    both = doubled.unionByName(windows.read_folder(spark, folder, EVENTS, 4))
    got = run(spark, windows.deduplicated(both, ["event_id"], "40 days"), "dedup", "append")
    assert got.count() == spark.read.parquet(folder).count()


def test_running_metrics(spark, folder):
    scores = lambda e: e.select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("seq"), (F.col("value") % 1).alias("score"))
    got = run(spark, drift_state.stream_metrics(scores(windows.read_folder(spark, folder, EVENTS, 4))), "metrics", "update")
    last = got.groupBy("kind").agg(F.max_by("average", "n").alias("average"), F.max("highest").alias("highest"), F.max("n").alias("n"))
    want = {r.kind: r for r in drift_state.batch_metrics(scores(spark.read.parquet(folder))).collect()}
    for r in last.collect():
        assert r.n == want[r.kind].n and r.highest == pytest.approx(want[r.kind].highest) and r.average == pytest.approx(want[r.kind].average)


def test_alert_stream(spark, folder):
    e = lambda df: df.select(F.col("event_type").alias("kind"), (F.col("value") % 1).alias("score"))
    got = run(spark, drift_state.alerts(e(windows.read_folder(spark, folder, EVENTS)), F.lit(0.9)), "alerts", "append")
    assert got.count() == e(spark.read.parquet(folder)).where("score > 0.9").count()
