"""Period snapshots, sessions and upserts, as batch or stream: the frame decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumikata.operators.joins import latest, prune

PERIODS = {"daily": ("1 day", None), "weekly": ("7 days", "4 days")}  # weeks begin on a Monday: the epoch was a Thursday


def snapshots(events: DataFrame, cadence: str, owner: str, ts: str, value: str, late: str = "2 days") -> DataFrame:
    """(owner, cadence, start, end, events, total, kinds): what each owner did in each completed day or week, in UTC.

    On a stream, `late` is the watermark: a period comes out once, when nothing of it can arrive any more. In a batch, the last
    period of the data may be unfinished; `completed` leaves it out.
    """
    span, offset = PERIODS[cadence]
    window = F.window(ts, span, startTime=offset) if offset else F.window(ts, span)
    frame = events.withWatermark(ts, late) if events.isStreaming else events
    told = frame.groupBy(owner, window.alias("w")).agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.approx_count_distinct("event_type", 0.01).alias("kinds") if events.isStreaming else F.count_distinct("event_type").alias("kinds"))
    return told.select(owner, F.lit(cadence).alias("cadence"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total", "kinds")


def completed(told: DataFrame, now: str) -> DataFrame:
    """Only periods that end no later than `now`."""
    return told.where(F.col("end") <= F.to_timestamp(F.lit(now)))


def sessions(events: DataFrame, owner: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(owner, start, end, events): stretches of activity without a pause of `gap`; `end` is the last event's time plus the gap."""
    frame = events.withWatermark(ts, late) if events.isStreaming else events
    told = frame.groupBy(owner, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return told.select(owner, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def keep_newest(told: DataFrame, owner: str, keep: int) -> DataFrame:
    """The newest `keep` periods of each owner."""
    return prune(told, owner, "start", keep)


def upserting(path: str, keys: list[str], stamp: str) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: merges each batch into the Parquet table at `path`, the latest `stamp` of a key wins, so that a batch done twice changes nothing.

    The table is kept in versions of their own; `current` reads the last that is whole.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [-F.unix_micros(stamp)])
        old = current(spark, path, number)
        if old is not None:
            new = latest(old.unionByName(new), keys, [-F.unix_micros(stamp)])
        new.write.mode("overwrite").parquet(f"{path}/version={number:09d}")

    return merge


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The last whole version of a table that `upserting` keeps, below version `before` if given."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    whole = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and (before is None or int(p.getName().split("=")[1]) < before)]
    return spark.read.parquet(str(max(whole, key=lambda p: p.getName()).toString())) if whole else None
