"""Runs of equal labels over a stream of frames, with the open run as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream string, label string, first long, last long, frames long, confidence double"
STATE = "label string, first long, last long, frames long, total double"


def segment_stream(frames: DataFrame, stream: str, order: str, label: str, confidence: str, ts: str, least: int = 1, idle: str = "1 minute") -> DataFrame:
    """(stream, label, first, last, frames, confidence): each run of equal labels once it has ended, or once its stream is idle.

    Frames of a batch are sorted by `order` before they are read; a frame that comes later than its successors in an earlier batch begins a
    run of its own. The state of a stream is its open run. Null labels end a run and begin none; runs below `least` frames are left out.
    """
    seconds = int(pd.Timedelta(idle).total_seconds())

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None
        out = []

        def close() -> None:
            if open_ and open_[3] >= least:
                out.append((key[0], open_[0], open_[1], open_[2], open_[3], open_[4] / open_[3]))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("o")
            newest = 0
            for o, x, c, at in zip(rows["o"], rows["label"], rows["confidence"], rows["at"], strict=True):
                newest = max(newest, int(at))
                if open_ and x == open_[0]:
                    open_ = [x, open_[1], int(o), open_[3] + 1, open_[4] + float(c)]
                else:
                    close()
                    open_ = [x, int(o), int(o), 1, float(c)] if isinstance(x, str) else None
            if open_:
                state.update(tuple(open_))
                state.setTimeoutTimestamp(max(newest + seconds * 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        if out:
            yield pd.DataFrame(out, columns=["stream", "label", "first", "last", "frames", "confidence"])

    told = frames.withWatermark(ts, idle).select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("o"), F.col(label).alias("label"), F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).alias("confidence"), ts, F.unix_millis(F.col(ts)).alias("at"))
    return told.groupBy("stream").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track(boxes: pd.DataFrame, before: list[tuple[float, float]], reach: float) -> list[int]:
    """Which of the known places each box of a frame belongs to, nearest first, -1 for none within reach."""
    pairs = sorted(((b.x - p[0]) ** 2 + (b.y - p[1]) ** 2, i, j) for i, b in enumerate(boxes.itertuples()) for j, p in enumerate(before))
    out, taken = [-1] * len(boxes), set()
    for far, i, j in pairs:
        if far <= reach**2 and out[i] < 0 and j not in taken:
            out[i] = j
            taken.add(j)
    return out


def identities(frames: DataFrame, stream: str, order: str, reach: float = 80.0, most_missing: int = 12) -> DataFrame:
    """(stream, frame, box, identity): boxes (x, y) of each frame told apart over time; an identity not seen for `most_missing` frames ends.

    Streams are clustered and read in order; the open identities are all that is held.
    """
    rows = frames.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("frame"), "box", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).repartition("stream").sortWithinPartitions("stream", "frame", "box")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {"stream": None, "known": {}, "new": 0}
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part])
            last = (part["stream"].iloc[-1], part["frame"].iloc[-1])
            held = (part["stream"] == last[0]) & (part["frame"] == last[1])
            rest, done = part[held], part[~held]
            yield from step(done, memory)
        if rest is not None:
            yield from step(rest, memory)

    def step(rows_: pd.DataFrame, memory: dict) -> Iterator[pd.DataFrame]:
        out = []
        for (name, frame), group in rows_.groupby(["stream", "frame"], sort=False):
            if name != memory["stream"]:
                memory.update(stream=name, known={}, new=0)
            live = {i: k for i, k in memory["known"].items() if frame - k[2] <= most_missing}
            ids = list(live)
            for box, at, (x, y) in zip(group["box"], track(group, [live[i][:2] for i in ids], reach), zip(group["x"], group["y"], strict=True), strict=True):
                if at < 0:
                    ident, memory["new"] = memory["new"], memory["new"] + 1
                else:
                    ident = ids[at]
                live[ident] = (x, y, frame)
                out.append((name, frame, box, ident))
            memory["known"] = live
        if out:
            yield pd.DataFrame(out, columns=["stream", "frame", "box", "identity"])

    box = frames.schema["box"].dataType.simpleString()
    return rows.mapInPandas(run, f"stream string, frame long, box {box}, identity long")


def shot_changes(frames: DataFrame, stream: str, order: str, histogram: str, threshold: float = 0.5) -> DataFrame:
    """`cut`: whether a frame's histogram is too far from the one before (1 less their correlation)."""
    from pyspark.sql import Window

    w = Window.partitionBy(stream).orderBy(order)
    told = frames.withColumn("_p", F.lag(histogram).over(w))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    centred = lambda c: F.transform(F.col(c), lambda x: x - mean(F.col(c)))
    told = told.withColumns({"_a": centred(histogram), "_b": centred("_p")})
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = F.try_divide(dot(F.col("_a"), F.col("_b")), F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b"))))
    return told.withColumn("cut", F.coalesce(1 - r > threshold, F.lit(False))).drop("_p", "_a", "_b")
