"""Joins beyond equality: participants, ranges, as-of, mirrors, ordinals, upserts, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import cut


def participants(bouts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each bout once per side, with `athlete`, `opponent` and `side`: looked up by equality instead of `a = x OR b = x`."""
    sides = F.explode(F.array(F.struct(F.col(a).alias("athlete"), F.col(b).alias("opponent"), F.lit("a").alias("side")), F.struct(F.col(b).alias("athlete"), F.col(a).alias("opponent"), F.lit("b").alias("side"))))
    return bouts.withColumn("s", sides).select("*", "s.*").drop("s")


def unlike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose keys `right` does not hold; a null key is like none."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def range_join(points: DataFrame, windows: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Points joined with the half-open windows [start, end) of their key; an open window has no end.

    Closed windows are cut into cells of `width` and met by equality on key and cell; open ones, one set a key, are compared with the points of
    their key after their start. No point meets the windows of another key.
    """
    spread = windows.where("end IS NOT NULL AND end > start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1e-9) / width))))
    placed = points.withColumn("cell", F.floor(F.col(at) / width))
    closed = placed.join(spread, [key, "cell"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("cell")
    ends = placed.drop("cell").join(windows.where("end IS NULL"), key).where(F.col(at) >= F.col("start"))
    return closed.unionByName(ends.select(closed.columns))


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one union and one window, no range join."""
    empty = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    both = left.select("*", *empty, F.lit(1).alias("is_left")).unionByName(right.select(key, order, *values, F.lit(0).alias("is_left")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "is_left").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_left") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("found", last).where("is_left = 1").select(*left.columns, *[F.col(f"found.{v}").alias(v) for v in values])


def ordinal_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, take: list[str]) -> DataFrame:
    """One to one: the n-th left row of a key meets the n-th right row of it, in order; left rows beyond those stay without."""
    a = left.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order))).select(*keys, "nth", *take)
    return a.join(b, [*keys, "nth"], "left").drop("nth")


def mirrors(records: DataFrame, keys: list[str], order: str, outcome: str, won: str, lost: str) -> DataFrame:
    """Records without the second view of one bout: of each key the n-th win and the n-th loss are a pair, of which the win stays."""
    told = records.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, outcome).orderBy(order)))
    wins = told.where(F.col(outcome) == won).select(*keys, "nth", F.lit(True).alias("seen"))
    return told.join(wins, [*keys, "nth"], "left").where(~((F.col(outcome) == lost) & F.coalesce("seen", F.lit(False))) | F.col(outcome).isNull()).drop("nth", "seen")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in `order`; by aggregation, so that it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], stamp: str, deleted: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The target after the changes: per key the latest `stamp` wins, a change wins a tie, then the least of `ties`; rows marked deleted leave."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    out = latest(both, keys, [-F.unix_micros(stamp), -F.col("_new"), *map(F.col, ties)]).drop("_new")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def prune(rows: DataFrame, owner: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each owner."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def reconcile_years(ours: DataFrame, theirs: DataFrame, pair: str = "pair", year: str = "year") -> DataFrame:
    """(pair, ours, theirs, suggested): pairs whose years differ; a year is suggested only where both sides know exactly one."""
    a = ours.groupBy(pair).agg(F.array_sort(F.collect_set(year)).alias("ours"))
    b = theirs.groupBy(pair).agg(F.array_sort(F.collect_set(year)).alias("theirs"))
    told = a.join(b, pair).where(~F.col("ours").eqNullSafe(F.col("theirs")))
    return told.withColumn("suggested", F.when((F.size("ours") == 1) & (F.size("theirs") == 1), F.col("theirs")[0]))


def pair_key(a: str, b: str) -> Column:
    """The same key for a pair in either order."""
    return F.concat_ws(" | ", F.least(a, b), F.greatest(a, b))


def suspects(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(a, b): names of either frame with the same last word whose first words begin with the same two letters, but which are not equal.

    The last word and the two letters are joined by equality; nothing is compared with everything.
    """

    def told(frame: DataFrame, tag: str) -> DataFrame:
        words = F.split(F.col(name), " ")
        return frame.where(F.col(name).isNotNull()).select(F.col(name).alias(tag), F.element_at(words, -1).alias("last"), F.substring(words[0], 1, 2).alias("begin")).where("last <> begin").distinct()

    return told(left, "a").join(told(right, "b"), ["last", "begin"]).where("a <> b").select("a", "b")


def merge_identities(rows: DataFrame, key: list[str], ident: str, score: list[Column]) -> DataFrame:
    """(ident, canonical): every identity of a key mapped to the one with the best score; alone it maps to itself."""
    best = rows.groupBy(*key).agg(F.min_by(ident, F.struct(*score)).alias("canonical"))
    return rows.select(*key, ident).join(best, key).select(ident, "canonical").distinct()


def remap_edges(edges: DataFrame, mapping: DataFrame, sums: list[str]) -> DataFrame:
    """Edges with mapped ends, counts of those that fall together added up, loops left out."""
    out = edges
    for end in ("source", "target"):
        out = out.join(mapping.select(F.col("key").alias(end), F.col("canonical").alias(f"{end}_new")), end, "left").withColumn(end, F.coalesce(f"{end}_new", end)).drop(f"{end}_new")
    return out.where("source <> target").groupBy("source", "target").agg(*[F.sum(c).alias(c) for c in sums])


def by_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key from several sources of equal columns, the first source that has it; within one source the least row."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    rest = [c for c in frames[0].columns if c not in keys]
    return latest(reduce(DataFrame.unionByName, tagged), keys, [F.col("_source"), *map(F.col, rest)]).drop("_source")


def changed(inputs: DataFrame, cache: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Inputs with `hash` (of the JSON of `columns`) and `hit`: whether the cache (key, hash) has them already."""
    hashed = inputs.withColumn("hash", F.sha1(F.to_json(F.struct(*columns))))
    return hashed.join(cache.select(key, "hash", F.lit(True).alias("hit")), [key, "hash"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def merge_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that each can reach over (a, b), by label passing with checkpoints until nothing changes."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = nodes.select("node", F.col("node").alias("component"))
    while True:
        heard = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        new = cut(state.join(heard, "node", "left").withColumn("new", F.least("component", "heard")))
        if new.where("new < component").isEmpty():
            return new.select("node", "component")
        # a node takes its leader's leader, which halves the way
        step = new.select("node", F.col("new").alias("component"))
        lead = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        state = step.join(lead, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
