"""Problem 1: the best representative of each duplicate group, by skyline layers and a lexicographic policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classes(records: DataFrame, group: str, record: str, trust: Column, recency: str, usable: dict[str, Column]) -> DataFrame:
    """One row per group with the records that any layer's choice can come from, and the group's size and least record.

    Records of a group that agree in trust and in which fields are usable differ in recency alone: the latest (then the least
    record id) stands for them, for the others can fill nothing that it cannot. So a group has at most
    (trust levels) x 2^(fields) candidates, however many records it has, and they are found before the shuffle ends.
    """
    fields = list(usable)
    mask = reduce(lambda a, b: a + b, (F.when(F.coalesce(usable[f], F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(fields)), F.lit(0))
    told = records.select(F.col(group).alias("group"), F.col(record).alias("record"), F.coalesce(trust, F.lit(1 << 20)).cast("int").alias("trust"), mask.alias("mask"), F.coalesce(F.unix_micros(F.col(recency)), F.lit(-(1 << 62))).alias("recency"))
    best = told.groupBy("group", "trust", "mask").agg(F.max(F.struct("recency", (-F.col("record")).alias("minus"))).alias("top"), F.count("*").alias("n"), F.min("record").alias("least"))
    one = F.struct("trust", (-F.col("top.recency")).alias("age"), (-F.bit_count("mask")).alias("lacks"), (-F.col("top.minus")).alias("record"), "mask")
    return best.groupBy("group").agg(F.sum("n").alias("size"), F.min("least").alias("first_id"), F.array_sort(F.collect_list(one)).alias("candidates"))


def layered(candidates: DataFrame) -> DataFrame:
    """The candidates of each group with their dominance layer: 0 is the skyline, 1 the skyline of the rest, and so on.

    One record dominates another if it is no worse in trust, recency and each field's being usable, and better in one. Candidates
    stand in order of trust, recency and fewest gaps, in which a record can only be dominated by one before it: its layer is one more than the deepest
    layer among its dominators.
    """
    above = lambda done, c: F.transform(F.filter(done, lambda d: (d["trust"] <= c["trust"]) & (d["age"] <= c["age"]) & (d["mask"].bitwiseAND(c["mask"]) == c["mask"])), lambda d: d["layer"])
    grown = F.aggregate(
        "candidates",
        F.array().cast("array<struct<layer:int,trust:int,age:bigint,record:bigint,mask:int>>"),
        lambda done, c: F.array_append(done, F.struct((F.coalesce(F.array_max(above(done, c)), F.lit(-1)) + 1).alias("layer"), c["trust"].alias("trust"), c["age"].alias("age"), c["record"].alias("record"), c["mask"].alias("mask"))),
    )
    return candidates.withColumn("candidates", grown)


def survivors(records: DataFrame, group: str, record: str, trust: Column, recency: str, usable: dict[str, Column], least: int = 1) -> DataFrame:
    """For each group of at least `least` records the one from which each field is best taken: (group, size, first_id, layers, <field>_id ...).

    `trust` is a number, lower is better (null: least trusted); `recency` a timestamp (null: oldest); `usable` says for each field whether a record's value
    can be used. Skyline selection: the Pareto-undominated records across trust, recency and completeness are the first layer, those undominated without them the
    next, and so on; a field is taken from the first layer that has it, there by the lexicographic policy trust, recency, record id, so that
    what the skyline lacks is filled from successive dominance layers. `<field>_id` is null if no record of the group has a usable value.

    Of records alike in trust and recency the more complete one stands first, then the least record id. Nulls as said; a group of one gives its own record;
    an empty table no row; other columns are ignored.
    """
    told = classes(records.where(F.col(group).isNotNull()), group, record, trust, recency, usable).where(F.col("size") >= least)
    layers = F.array_max(F.transform("candidates", lambda c: c["layer"])) + 1

    def source(i: int) -> Column:
        return F.array_min(F.filter("candidates", lambda c: c["mask"].bitwiseAND(1 << i) > 0))["record"]

    return layered(told).select("group", "size", "first_id", layers.alias("layers"), *[source(i).alias(f"{f}_id") for i, f in enumerate(usable)])
