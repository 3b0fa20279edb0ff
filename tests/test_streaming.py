"""Streams give what batches give."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from kumikata.operators.sequences import segments
from kumikata.streaming import segmenter, snapshots

T0 = datetime.datetime(2020, 1, 6)
SCHEMA = "user_id long, ts timestamp, value double, event_type string"


def _drain(frame, path, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


@pytest.fixture
def source(spark, tmp_path):
    rows = [(u, T0 + datetime.timedelta(hours=7 * i + u), float(i), f"t{i % 2}") for u in (1, 2) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(str(tmp_path / "in"))
    # what comes much later lets every window close
    spark.createDataFrame([(9, T0 + datetime.timedelta(days=60), 0.0, "t0")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_snapshots_of_a_stream_are_the_batch(spark, source, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    got = _drain(snapshots.snapshots(stream, "daily", "user_id", "ts", "value"), tmp_path / "c", "daily_out").where("user_id <> 9").select("user_id", "start", "events", "total").collect()
    want = snapshots.snapshots(spark.read.parquet(source), "daily", "user_id", "ts", "value").where("user_id <> 9").select("user_id", "start", "events", "total").collect()
    assert sorted(got) == sorted(want) and want


def test_sessions_of_a_stream_are_the_batch(spark, source, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    got = _drain(snapshots.sessions(stream, "user_id", "ts", "8 hours"), tmp_path / "c", "session_out").where("user_id <> 9").collect()
    assert sorted(got) == sorted(snapshots.sessions(spark.read.parquet(source), "user_id", "ts", "8 hours").where("user_id <> 9").collect())
    assert len(got) == 2


def test_only_completed_periods(spark, source):
    told = snapshots.snapshots(spark.read.parquet(source), "weekly", "user_id", "ts", "value")
    assert {r.start for r in told.where("user_id = 1").collect()} == {T0}
    assert snapshots.completed(told, "2020-01-12 00:00:00").count() == 0 and snapshots.completed(told, "2020-01-13 00:00:00").count() == 2


def test_upserts_done_twice_change_nothing(spark, tmp_path):
    merge = snapshots.upserting(str(tmp_path / "t"), ["id"], "at")
    day = lambda d: datetime.datetime(2020, 1, d)
    one = spark.createDataFrame([(1, day(1), "a"), (2, day(3), "b")], "id int, at timestamp, v string")
    two = spark.createDataFrame([(1, day(2), "A"), (2, day(1), "B"), (3, day(1), "C")], one.schema)
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        merge(batch, number)
    assert sorted((r.id, r.v) for r in snapshots.current(spark, str(tmp_path / "t")).collect()) == [(1, "A"), (2, "b"), (3, "C")]


def test_segments_of_a_stream_are_the_batch(spark, tmp_path):
    labels = "aaabbcccca"
    rows = [(s, i, x, 0.5, T0 + datetime.timedelta(seconds=i)) for s in ("u", "v") for i, x in enumerate(labels)]
    frames = spark.createDataFrame(rows, "stream string, o long, label string, confidence double, ts timestamp")
    for part in ("o < 4", "o >= 4 AND o < 7", "o >= 7"):
        frames.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", 0, "q", 1.0, T0 + datetime.timedelta(days=1))], frames.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = _drain(segmenter.segment_stream(stream, "stream", "o", "label", "confidence", "ts"), tmp_path / "c", "segments_out").where("stream <> 'z'")
    want = segments(frames, "stream", "o", "label", 1, "confidence").select("stream", "label", "first", "last", "frames")
    assert sorted(out.select("stream", "label", "first", "last", "frames").collect()) == sorted(want.collect())


def test_identities_and_cuts(spark):
    rows = [("s", f, b, x, 0.0) for f in range(6) for b, x in ((0, 10.0 + f), (1, 200.0 - f))] + [("s", 40, 0, 12.0, 0.0)]
    got = {(r.frame, r.box): r.identity for r in segmenter.identities(spark.createDataFrame(rows, "s string, f long, box int, x double, y double"), "s", "f").collect()}
    assert {got[(f, 0)] for f in range(6)} == {0} and {got[(f, 1)] for f in range(6)} == {1} and got[(40, 0)] == 2
    frames = spark.createDataFrame([("s", 0, [1.0, 2.0, 3.0]), ("s", 1, [1.0, 2.0, 3.1]), ("s", 2, [3.0, 2.0, 1.0])], "s string, f int, h array<double>")
    assert [r.cut for r in segmenter.shot_changes(frames, "s", "f", "h").orderBy("f").select(F.col("cut")).collect()] == [False, False, True]
