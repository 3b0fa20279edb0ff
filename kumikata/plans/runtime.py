"""Helpers that every operator shares: tables, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast, whatever its content; checked by `small`.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the checkpoint folder that the cluster shares and read it from there.

    The folder is the session's `spark.checkpoint.dir`. Where a session has none, a local one, as in tests, takes a folder of the
    machine; on a cluster, whose executors do not share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager)


def cut_and_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """`cut`, with aggregates of the rows that are taken while they are written: a round of an iteration is one job."""
    seen = Observation()
    written = cut(df.observe(seen, *[measure.alias(name) for name, measure in measures.items()]))
    return written, seen.get


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for `df` if it has at most `rows` rows, else one that forbids it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else spread(df)


def spread(df: DataFrame) -> DataFrame:
    """A hint that `df` grows with the data: it is joined by a shuffle, never broadcast on an estimate.

    Estimates know nothing of what a generator or a Python step adds, so that a side of many millions of rows can pass for a few megabytes.
    """
    return df.hint("merge")


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """With `out`, the sum of `amount` over all rows up to each by `order`, which must be unique: no task sorts more than its range.

    Ranges are sorted where they lie; only their sums come to the driver.
    """
    ranged = cut(df.orderBy(order)).withColumn("_part", F.spark_partition_id())
    before, total = {}, 0
    for part, s in sorted(ranged.groupBy("_part").agg(F.sum(amount)).collect()):
        before[part], total = total, total + (s or 0)
    if not before:
        return df.withColumn(out, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part"))
    w = Window.partitionBy("_part").orderBy(order)
    return ranged.withColumn(out, F.sum(amount).over(w) + start).drop("_part")
