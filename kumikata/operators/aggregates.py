"""Shares, pivots, trends, concentration, lift, cubes and cards over flat frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import running_total

TYPES = ("submission", "control", "pass", "takedown", "sweep", "transition", "guard", "escape")

# Words that tell a family of submissions, in this order; the first that fits counts.
FAMILIES = (("strangle", "choke|strangle|guillotine|triangle"), ("leglock", "foot|heel|knee|leg|ankle|toe|calf"), ("armlock", "arm|kimura|americana|wrist|omoplata"))


def crosstab(frame: DataFrame, rows: str, columns: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of `rows` by `columns` with a column per value, zero-filled; the values are given, so no job looks for them."""
    return frame.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def shares(frame: DataFrame, group: str | tuple[str, ...], item: str) -> DataFrame:
    """(group, item, n, share): how often each item occurs, and its share of the group."""
    keys = [group] if isinstance(group, str) else list(group)
    counts = frame.groupBy(*keys, item).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def top_items(frame: DataFrame, item: str, n: int) -> DataFrame:
    """The `n` most frequent items; ties by name."""
    return frame.groupBy(item).agg(F.count("*").alias("k")).orderBy(F.desc("k"), item).limit(n).select(item)


def baseline(frame: DataFrame, group: str, item: str) -> DataFrame:
    """(item, baseline): the mean over all groups of an item's share; a group without it counts as 0."""
    told = shares(frame, group, item)
    groups = frame.groupBy(group).agg(F.count("*").alias("k")).agg(F.count("*").alias("groups")).withColumn("one", F.lit(0))
    sums = told.groupBy(item).agg(F.sum("share").alias("sum")).withColumn("one", F.lit(0))
    return sums.join(F.broadcast(groups), "one").select(item, (F.col("sum") / F.col("groups")).alias("baseline"))


def against(own: DataFrame, base: DataFrame, item: str, high: float = 1.5, low: float = 0.5) -> DataFrame:
    """Own shares beside a baseline: `ratio` and `flag` (high, low, normal, no_data)."""
    told = own.join(base, item, "left").withColumn("ratio", F.try_divide(F.col("share"), F.col("baseline")))
    flag = F.when(F.col("baseline").isNull(), "no_data").when(F.col("ratio") >= high, "high").when(F.col("ratio") <= low, "low").otherwise("normal")
    return told.withColumn("flag", flag)


def family(label: Column) -> Column:
    """The family of a submission by the words of its label."""
    return F.coalesce(*[F.when(label.rlike(p), F.lit(name)) for name, p in FAMILIES])


def concentration(events: DataFrame, item: str, who: str) -> DataFrame:
    """(item, n, people, top_share, hhi, effective): how much of an item is one person's."""
    each = shares(events, item, who)
    return each.groupBy(item).agg(F.sum("n").alias("n"), F.count("*").alias("people"), F.max("share").alias("top_share"), F.sum(F.col("share") * F.col("share")).alias("hhi")).withColumn("effective", 1 / F.col("hhi"))


def readings(events: DataFrame, item: str, who: str) -> DataFrame:
    """(item, balanced, weighted, without_top): mean of the people's shares, share of all events, and that without the busiest person."""
    each = shares(events.where(F.col(who).isNotNull()), who, item)
    people = each.groupBy(who).agg(F.sum("n").alias("k"))
    top = people.orderBy(F.desc("k"), who).limit(1).select(F.col(who).alias("top"), F.lit(0).alias("one"))
    totals = people.agg(F.count("*").alias("people"), F.sum("k").alias("all")).withColumn("one", F.lit(0))
    told = each.withColumn("one", F.lit(0)).join(F.broadcast(top), "one")
    sums = told.groupBy(item).agg(F.sum("share").alias("s"), F.sum("n").alias("n"), F.sum(F.when(F.col(who) != F.col("top"), F.col("n")).otherwise(0)).alias("rest"))
    rest = told.where(F.col(who) != F.col("top")).agg(F.sum("n").alias("rest_all")).withColumn("one", F.lit(0))
    out = sums.withColumn("one", F.lit(0)).join(F.broadcast(totals), "one").join(F.broadcast(rest), "one")
    return out.select(item, (F.col("s") / F.col("people")).alias("balanced"), (F.col("n") / F.col("all")).alias("weighted"), F.try_divide(F.col("rest"), F.col("rest_all")).alias("without_top"))


def lift(category: DataFrame, base: DataFrame, item: str, least: int = 5) -> DataFrame:
    """(item, n, n_base, lift, bucket): log2 of the share in the category over that in the baseline; small and unseen items are told apart."""

    def told(frame: DataFrame, tag: str) -> DataFrame:
        return shares(frame.withColumn("one", F.lit(0)), "one", item).select(item, F.col("n").alias(f"n{tag}"), F.col("share").alias(f"p{tag}"))

    both = told(category, "").join(told(base, "_base"), item, "left")
    bucket = F.when(F.col("p_base").isNull(), "unseen").when(F.col("n") < least, "too_small").otherwise("ranked")
    return both.select(item, "n", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.when(F.col("p_base").isNotNull(), F.log2(F.col("p") / F.col("p_base"))).alias("lift"), bucket.alias("bucket"))


def effectiveness(events: DataFrame, item: str) -> DataFrame:
    """(item, n, resolved, ok, rate, resolved_share): success among the events whose outcome is known."""
    told = events.groupBy(item).agg(F.count("*").alias("n"), F.count("ok").alias("resolved"), F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("ok"))
    return told.withColumns({"rate": F.try_divide(F.col("ok").cast("double"), F.col("resolved")), "resolved_share": F.col("resolved") / F.col("n")})


def cuts(frame: DataFrame, axes: tuple[str, ...], measures: list[Column], since: str | None = None, years: tuple[int, ...] = ()) -> DataFrame:
    """All points of the cut cube: each axis or 'all', and nested windows `since` a year or 'all'; empty cuts do not appear."""
    if since:
        windows = F.array(F.lit("all"), *[F.when(F.col(since) >= y, F.lit(str(y))) for y in years])
        frame = frame.withColumn("since", F.explode(F.filter(windows, lambda w: w.isNotNull())))
    for a in axes:
        frame = frame.withColumn(a, F.explode(F.array(F.coalesce(F.col(a).cast("string"), F.lit("unknown")), F.lit("all"))))
    return frame.groupBy(*["since"] * bool(since), *axes).agg(*measures)


def quartiles(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p25, median, p75) with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return frame.groupBy(group).agg(p.alias("p")).select(group, F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"))


def density(frame: DataFrame, who: str, item: str, items: tuple[str, ...]) -> DataFrame:
    """(who, item, share): each person's share of every item of a given list, zeros included."""
    counts = frame.where(F.col(item).isin(*items)).groupBy(who).agg(F.count("*").alias("all"), *[F.count_if(F.col(item) == x).alias(x) for x in items])
    return counts.select(who, F.explode(F.array(*[F.struct(F.lit(x).alias("item"), (F.col(x) / F.col("all")).alias("share")) for x in items])).alias("x")).select(who, F.col("x.item").alias(item), F.col("x.share").alias("share"))


def mix_deviance(events: DataFrame, who: str, bout: str, item: str, items: tuple[str, ...], least: int = 1) -> DataFrame:
    """(who, bout, events, others, js, shift): divergence (Jensen-Shannon, bits) of a bout's mix from the person's other bouts.

    The others are the person's totals less the bout's own, so nothing is joined with itself. `shift` is the item whose share moves most.
    """
    cells = events.where(F.col(who).isNotNull() & F.col(item).isin(*items)).groupBy(who, bout).agg(F.count("*").alias("events"), *[F.count_if(F.col(item) == x).alias(x) for x in items])
    w = Window.partitionBy(who)
    told = cells.withColumns({"others": F.sum("events").over(w) - F.col("events"), **{f"o_{x}": F.sum(x).over(w) - F.col(x) for x in items}}).where(F.col("others") >= least)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    js = F.lit(0.0)
    for x in items:
        p, q = F.col(x) / F.col("events"), F.col(f"o_{x}") / F.col("others")
        m = (p + q) / 2
        js = js + 0.5 * term(p, m) + 0.5 * term(q, m)
    gaps = F.array(*[F.struct((-F.abs(F.col(x) / F.col("events") - F.col(f"o_{x}") / F.col("others"))).alias("gap"), F.lit(x).alias("item")) for x in items])
    return told.select(who, bout, "events", "others", F.greatest(F.lit(0.0), F.least(F.lit(1.0), js)).alias("js"), F.array_min(F.transform(gaps, lambda g: F.struct(F.round(g["gap"], 9).alias("gap"), g["item"].alias("item"))))["item"].alias("shift"))


def clamped_z(frame: DataFrame, key: str, fallback: str, value: str, least: int = 3, most: float = 3.0) -> DataFrame:
    """`z` of each row's value against the population of its key, or of its fallback where the key has too few or does not vary."""

    def stats(by: str, tag: str) -> DataFrame:
        return frame.groupBy(by).agg(F.avg(value).alias(f"mean_{tag}"), F.stddev_pop(value).alias(f"std_{tag}"), F.count(value).alias(f"n_{tag}"))

    told = frame.join(stats(key, "k"), key, "left").join(stats(fallback, "f"), fallback, "left")
    good = (F.col("n_k") >= least) & (F.col("std_k") > 1e-9)
    z = F.when(good, (F.col(value) - F.col("mean_k")) / F.col("std_k")).when(F.col("std_f") > 1e-9, (F.col(value) - F.col("mean_f")) / F.col("std_f")).otherwise(0.0)
    return told.withColumn("z", F.greatest(F.lit(-most), F.least(F.lit(most), z))).select(*frame.columns, "z")


def percentiles(frame: DataFrame, value: str) -> DataFrame:
    """With `percentile` (share of rows not above) and `ratio` to the mean."""
    counts = frame.groupBy(value).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean")).withColumn("one", F.lit(0))
    rank = running_total(counts, value, "n", "upto").withColumn("one", F.lit(0)).join(F.broadcast(totals), "one")
    return frame.join(rank.select(value, (F.col("upto") / F.col("all")).alias("percentile"), F.try_divide(F.col(value).cast("double"), F.col("mean")).alias("ratio")), value)


def majority(frame: DataFrame, who: str, item: str, order: tuple[str, ...]) -> DataFrame:
    """(who, item, n): each one's most frequent item; ties by the given order, then by name."""
    counts = frame.groupBy(who, item).agg(F.count("*").alias("n"))
    place = F.coalesce(*[F.when(F.col(item) == x, F.lit(i)) for i, x in enumerate(order)], F.lit(len(order)))
    return counts.groupBy(who).agg(F.min_by(F.struct(item, "n"), F.struct(-F.col("n"), place, F.col(item))).alias("m")).select(who, f"m.{item}", "m.n")


def leaders(frame: DataFrame, who: str, score: str, top: int) -> DataFrame:
    """(rank, who, score, relative): the `top` best and their score relative to the first's."""
    best = frame.orderBy(F.desc(score), who).limit(top)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), who)
    return best.withColumn("rank", F.row_number().over(w)).withColumn("relative", F.col(score) / F.first(score).over(w)).select("rank", who, score, "relative")
