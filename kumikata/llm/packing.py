"""Problem 8: fixed-capacity containers, by patterns of lengths and non-negative least squares."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import cut


#: Parts of the items by key, within which pieces of one length are ranked.
PARTS = 1024


@dataclass
class Plan:
    """Which container the n-th piece of each length goes to: runs of equal containers, by length."""

    containers: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # length: (first rank, first container, copies in each)
    used: dict[int, int] = field(default_factory=dict)

    def add(self, pattern: dict[int, int], repeats: int) -> None:
        for length, copies in pattern.items():
            start = self.used.get(length, 0)
            self.runs.setdefault(length, []).append((start, self.containers, copies))
            self.used[length] = start + copies * repeats
        self.containers += repeats


def patterns(lengths: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each length and number of copies that fit: the copies, and the largest lengths that fill what is left, a few at most."""
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right") - 1  # the largest length within a space
    out: dict[tuple[tuple[int, int], ...], dict[int, int]] = {}
    for length in lengths[::-1]:
        length = int(length)
        for copies in range(1, capacity // length + 1):
            pattern, left = {length: copies}, capacity - copies * length
            for _ in range(5):
                if left <= 0 or fits[left] < 0:
                    break
                best = int(lengths[fits[left]])
                take = left // best
                pattern[best] = pattern.get(best, 0) + take
                left -= take * best
            out.setdefault(tuple(sorted(pattern.items())), pattern)
            # halves of what is left, where two documents fill it together
            left = capacity - copies * length
            for share in (0.5, 0.35):
                one = int(left * share)
                if one > 0 and fits[one] >= 0:
                    a = int(lengths[fits[one]])
                    if left - a > 0 and fits[left - a] >= 0:
                        pattern = {length: copies}
                        for x in (a, int(lengths[fits[left - a]])):
                            pattern[x] = pattern.get(x, 0) + 1
                        out.setdefault(tuple(sorted(pattern.items())), pattern)
    return list(out.values())


def repeats(found: list[dict[int, int]], lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often to repeat each pattern so that the patterns' lengths come near the histogram.

    Accelerated projected gradients on the scaled problem; patterns that leave space pay for it.
    """
    place = {int(x): i for i, x in enumerate(lengths)}
    rows = np.array([place[x] for p in found for x in p])
    columns = np.repeat(np.arange(len(found)), [len(p) for p in found])
    values = np.array([float(n) for p in found for n in p.values()])
    waste = np.array([capacity - sum(x * n for x, n in p.items()) for p in found]) / capacity
    scale = np.sqrt(np.bincount(columns, values**2, len(found)))
    values = values / scale[columns]
    forward = lambda x: np.bincount(rows, values * x[columns], len(lengths))
    backward = lambda r: np.bincount(columns, values * r[rows], len(found))
    probe = np.random.default_rng(0).random(len(found))
    for _ in range(30):  # the largest eigenvalue, for the step
        probe = backward(forward(probe))
        top = np.linalg.norm(probe)
        probe /= top or 1
    x = y = np.zeros(len(found))
    t = 1.0
    price = 0.05 * waste * counts.max()
    for _ in range(rounds):
        new = np.maximum(0, y - (backward(forward(y) - counts) + price) / (1.05 * top))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x / scale


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack a histogram of lengths (1 to `capacity`): patterns by least squares, rounded down, and the rest largest first."""
    out = Plan()
    left = {int(x): int(n) for x, n in histogram.items() if n > 0 and x > 0}
    if not left:
        return out
    lengths = np.array(sorted(left))
    found = patterns(lengths, capacity)
    times = repeats(found, lengths, np.array([left[x] for x in lengths], float), capacity)
    for i in np.argsort(-times, kind="stable"):
        n = min([int(times[i]), *(left[x] // k for x, k in found[i].items())])
        if n > 0:
            out.add(found[i], n)
            for x, k in found[i].items():
                left[x] -= n * k
    # what rounding leaves: the largest, then the largest that fit, in runs of equal containers
    while left := {x: n for x, n in left.items() if n}:
        pattern: dict[int, int] = {}
        space = capacity
        for x in sorted(left, reverse=True):
            if take := min(space // x, left[x]):
                pattern[x] = take
                space -= take * x
        n = min(left[x] // k for x, k in pattern.items())
        out.add(pattern, n)
        for x, k in pattern.items():
            left[x] -= n * k
    return out


def packed(documents: DataFrame, size: str, capacity: int, key: str) -> DataFrame:
    """Put items whole into containers of `capacity`: (key, piece, size, container); only larger items are cut, into pieces.

    `size` is an integer column (null or below 1: takes no room and goes to container 0). A piece of `capacity` fills a container; what is over goes with the others.
    The driver sees the histogram of lengths alone, at most `capacity` numbers whatever the data, and plans by it: length patterns of few
    documents, repeat counts by non-negative least squares, rounded down, the rest largest first. Each piece then finds its
    container from its rank among the pieces of its length; ranks come from counts by part and length, so that one length may hold any share of the rows. Parts come
    from the keys, so that equal items are packed in the same way on any cluster.

    Every item is packed once. Repeated rows are packed each; equal keys stand in any order; an empty table gives no row; other columns are dropped.
    """
    sizes = documents.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).alias("size"))
    pieces = sizes.select("key", F.posexplode(F.when(F.col("size") <= capacity, F.array("size")).otherwise(F.expr(f"transform(sequence(0, cast((size - 1) div {capacity} as int)), i -> least({capacity}, size - i * {capacity}))"))).alias("piece", "size"))
    kept = cut(pieces.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")))
    counts = cut(kept.where("size > 0").groupBy("part", "size").count())
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    made = plan(histogram, capacity)
    runs = {x: tuple(np.array(c) for c in zip(*rows, strict=True)) for x, rows in made.runs.items()}
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "size", "offset")
    placed = kept.where("size > 0").withColumn("row", F.row_number().over(Window.partitionBy("part", "size").orderBy("key", "piece")) - 1).join(offsets, ["part", "size"])
    shared = documents.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        for length, rank in batches:
            out = np.zeros(len(length), "int64")
            for x in length.unique():
                here = (length == x).to_numpy()
                starts, firsts, copies = table[int(x)]
                r = rank[here].to_numpy()
                at = np.searchsorted(starts, r, side="right") - 1
                out[here] = firsts[at] + (r - starts[at]) // copies[at]
            yield pd.Series(out)

    full = placed.select("key", "piece", "size", container("size", F.col("offset") + F.col("row")).alias("container"))
    return full.unionByName(kept.where("size = 0").select("key", "piece", "size", F.lit(0).cast("long").alias("container"))).withColumnRenamed("key", key)
