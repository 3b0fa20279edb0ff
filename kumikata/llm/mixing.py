"""Problem 9: sources mixed to target weights, by iterative proportional fitting and systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import cut, small

#: Documents that one step of the sampling may hold in one task, about.
BLOCK = 50_000
#: Stands for null in a cell's key.
NONE = "\u0000"


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 8, last: int = 4) -> DataFrame:
    """Iterative proportional fitting: `repeats` for each cell so that the sums of repeats x tokens meet the marginal targets.

    `cells` has a column per key of `targets`, `tokens` and `cap` (most repeats). Each step multiplies the repeats of a value's cells by target over present sum, up to the
    cap; where a cell is at its cap, the others of its value take up the rest. The first key of `targets` is fitted last, alone, so that its
    sums come out as nearly as the caps allow. Windows over the cells, which are few; the documents are not read again.
    """
    for name, target in targets.items():
        cells = cells.join(small(target.select(name, F.col("target").alias(f"target_{name}"))), name, "left")
    state = cut(cells.withColumn("repeats", F.least(F.lit(1.0), F.col("cap").cast("double"))))

    def step(frame: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(name)
        capped = F.col("repeats") >= F.col("cap") - 1e-12
        held = F.sum(F.when(capped, F.col("repeats") * F.col("tokens")).otherwise(0.0)).over(w)
        free = F.sum(F.when(capped, 0.0).otherwise(F.col("repeats") * F.col("tokens"))).over(w)
        target = F.coalesce(F.col(f"target_{name}"), F.lit(0.0))
        over = held >= target  # the capped cells alone are too much: all shrink
        factor = F.when(over, target / F.greatest(held + free, F.lit(1e-9))).when(free > 0, (target - held) / free).otherwise(1.0)
        new = F.when(capped & ~over, F.col("repeats")).otherwise(F.least(F.col("repeats") * factor, F.col("cap").cast("double")))
        return frame.withColumn("repeats", new)

    names = list(targets)
    for _ in range(rounds):
        for name in reversed(names):
            state = step(state, name)
        state = cut(state)
    for _ in range(last):
        state = step(state, names[0])
    return cut(state.drop(*[f"target_{n}" for n in names]))


def systematic(rows: DataFrame, stratum: str, key: str, size: str, expected: str, documents: int, seed: int) -> DataFrame:
    """`copies` of each row: whole numbers beside `expected` whose sums within a stratum follow the expected ones in order of size.

    Running sums of the expected copies are cut at whole numbers, so that copies are the floor or the ceiling of what is expected.
    Rows of a stratum are ordered by size class and spread over blocks of bounded length: a sum within each block, and
    one over the blocks, give the running sum without bringing a stratum into one task.
    """
    blocks = max(1, -(-documents // BLOCK))
    spread = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    told = rows.withColumn("class", F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) * 4).cast("int")).withColumn("spread", spread).withColumn("block", F.pmod("spread", F.lit(blocks)).cast("int"))
    told = cut(told)
    sums = cut(told.groupBy(stratum, "class", "block").agg(F.sum(expected).alias("sum")))
    start = F.xxhash64(F.lit(seed), F.col(stratum)).bitwiseAND((1 << 20) - 1) / float(1 << 20)
    # first over the classes of a stratum, some hundred at most, then over the blocks of a class
    earlier = lambda w: F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    classes = sums.groupBy(stratum, "class").agg(F.sum("sum").alias("sum"))
    classes = classes.select(stratum, "class", (start + earlier(Window.partitionBy(stratum).orderBy("class"))).alias("start"))
    offsets = sums.join(classes, [stratum, "class"]).select(stratum, "class", "block", (F.col("start") + earlier(Window.partitionBy(stratum, "class").orderBy("block"))).alias("offset"))
    inside = Window.partitionBy(stratum, "class", "block").orderBy(size, "spread", key)
    here = F.sum(expected).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(expected).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    summed = told.withColumns({"here": here, "before": before}).join(offsets, [stratum, "class", "block"])
    whole = lambda c: F.floor(F.round(F.col("offset") + F.col(c), 6))
    return summed.withColumn("copies", (whole("here") - whole("before")).cast("int")).drop("class", "spread", "block", "offset", "here", "before")


def marginals(documents: DataFrame, chosen: DataFrame, key: str, size: str, source: str, others: tuple[str, ...]) -> DataFrame:
    """(marginal, value, present_share, reached_share): the shares of the total size by source and by each of `others` among the documents that could be
    chosen (those of the sources in `chosen`), and among the chosen with their copies."""
    names = (source, *others)
    able = documents.where(F.col(size) > 0).select(key, size, *names).join(F.broadcast(chosen.select(source).distinct()), source)
    told = able.join(chosen.select(key, "copies"), key, "left").withColumn("chosen", F.col(size) * F.coalesce("copies", F.lit(0)))
    by = told.select(F.explode(F.array(*[F.struct(F.lit(n).alias("marginal"), F.coalesce(F.col(n), F.lit("")).alias("value")) for n in names])).alias("m"), size, "chosen")
    sums = cut(by.groupBy("m.marginal", "m.value").agg(F.sum(size).alias("present"), F.sum("chosen").alias("chosen")))
    totals = sums.groupBy("marginal").agg(F.sum("present").alias("all_present"), F.sum("chosen").alias("all_chosen"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return sums.join(F.broadcast(totals), "marginal").select("marginal", "value", share("present", "all_present").alias("present_share"), share("chosen", "all_chosen").alias("reached_share"))


def mixed(documents: DataFrame, targets: DataFrame, key: str, size: str, source: str, others: tuple[str, ...], total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Choose documents so that each source gives its target share of the total size.

    `targets` is a curated table (source, target_share, max_repeats). `total` is the size aimed at; None: that of all documents whose source has a target. First result:
    (key, source, size, repeats, copies), the chosen documents; second: (source, target_share, max_repeats, available, wanted, chosen,
    reached_share, of_total, reached), one row per source of either table.

    Iterative proportional fitting rakes the size to the marginals of source, then of each column in `others` (whose target is the present share among
    the documents that can be chosen), with at most `max_repeats` expected copies each; systematic sampling turns the calibrated
    probabilities into whole copies, never more than `max_repeats`. A source that cannot reach its target gives all it may, and is reported with what it reached; the
    shares of what is chosen then lie above target for the others.

    Cases: a null source, or one without target, is never chosen; null values in `others` are a value of their own; documents of size 0 or
    null give nothing and are not chosen; a target without documents is reported with 0; repeated rows each count; a source's hot share of the rows is
    spread over blocks; empty tables give empty results.
    """
    names = [source, *others]
    one = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = small(one)
    rows = documents.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size), F.col(source), *[F.coalesce(F.col(c), F.lit(NONE)).alias(c) for c in others])
    rows = cut(rows)
    usable = rows.where(F.col(size) > 0).join(known, source)
    cells = cut(usable.groupBy(*names).agg(F.sum(size).cast("double").alias("tokens"), F.count("*").alias("documents"), F.max("max_repeats").alias("cap"), F.max("target_share").alias("share")))
    sums = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents")).first()
    aim = float(sums["tokens"] if total is None else total)
    by_source = cells.groupBy(source).agg(F.least(F.sum(F.col("tokens") * F.col("cap")), F.max("share") * F.lit(aim)).alias("target"))
    goals = {source: cut(by_source)}
    reachable = goals[source].agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    for c in others:
        goals[c] = cells.groupBy(c).agg((F.sum("tokens") / F.lit(sums["tokens"] or 1.0) * F.lit(reachable)).alias("target"))
    fitted = raked(cells.select(*names, "tokens", "cap"), goals).select(*names, "repeats")
    calibrated = usable.join(small(fitted), names)
    chosen = systematic(calibrated.select(key, size, source, "repeats"), source, key, size, "repeats", int(sums["documents"]), seed).where("copies > 0").select(key, source, size, F.round("repeats", 6).alias("repeats"), "copies")
    chosen = cut(chosen)
    per = chosen.groupBy(source).agg(F.sum(F.col(size) * F.col("copies")).alias("chosen"))
    have = rows.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum(size).alias("available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    report = one.join(have, source, "full_outer").join(per, source, "left").withColumns({"available": zero("available"), "chosen": zero("chosen"), "wanted": F.round(zero("target_share") * aim).cast("long")})
    all_chosen = chosen.agg(F.coalesce(F.sum(F.col(size) * F.col("copies")), F.lit(0))).first()[0]
    share: Column = F.round(F.col("chosen") / F.lit(float(all_chosen or 1)), 6)
    report = report.select(source, "target_share", "max_repeats", "available", "wanted", "chosen", share.alias("reached_share"), F.round(F.col("chosen") / F.lit(aim or 1.0), 6).alias("of_total"), (zero("available") * zero("max_repeats") >= F.col("wanted")).alias("reached"))
    return chosen, report
