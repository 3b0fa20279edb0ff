"""Statistics of counts with gates: intervals, contrasts, tests, false discovery, ranks, resampling.

What arithmetic can do stays in columns; p-values come from pandas functions over small result rows; resampling makes rows of draws,
each drawn from the counts of its group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumikata.functions.special import beta_quantile, chi2_p, fisher_p
from kumikata.plans.runtime import cut, running_total

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> dict[str, Column]:
    """p, lo, hi, half and grade of a proportion; all null (grade 'none') without trials."""
    n, k = n.cast("double"), k.cast("double")
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = F.lit(z) / d * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    grade = F.when(half.isNull(), "none").when(n < 5, "insufficient").when(half <= 0.08, "adequate").when(half <= 0.15, "moderate").otherwise("low")
    return {"p": p, "lo": F.when(half.isNotNull(), F.greatest(F.lit(0.0), centre - half)), "hi": F.when(half.isNotNull(), F.least(F.lit(1.0), centre + half)), "half": half, "grade": grade}


def contrast(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z95) -> dict[str, Column]:
    """Difference (Agresti-Caffo) and ratio (log scale) of two proportions with their intervals; the ratio's decides significance."""
    k1, n1, k2, n2 = (c.cast("double") for c in (k1, n1, k2, n2))
    p1, p2 = F.try_divide(k1, n1), F.try_divide(k2, n2)
    q1, q2 = (k1 + 1) / (n1 + 2), (k2 + 1) / (n2 + 2)
    se = F.sqrt(q1 * (1 - q1) / (n1 + 2) + q2 * (1 - q2) / (n2 + 2))
    both = (k1 > 0) & (k2 > 0)
    log = F.when(both, F.ln(p1 / p2))
    spread = F.when(both, F.sqrt(1 / k1 - 1 / n1 + 1 / k2 - 1 / n2))
    lo, hi = F.exp(log - z * spread), F.exp(log + z * spread)
    return {"diff": p1 - p2, "diff_lo": q1 - q2 - z * se, "diff_hi": q1 - q2 + z * se, "ratio": F.exp(log), "ratio_lo": lo, "ratio_hi": hi, "significant": F.coalesce((lo > 1) | (hi < 1), F.lit(False))}


@F.pandas_udf(T.DoubleType())
def contrast_p(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    """Fisher's exact p where an expected count is below 5, else chi-square with continuity correction."""

    def one(a: float, n: float, c: float, m: float) -> float | None:
        if not n or not m:
            return None
        b, d, t = n - a, m - c, n + m
        if min((a + c) * n, (a + c) * m, (b + d) * n, (b + d) * m) / t < 5:
            return fisher_p(int(a), int(b), int(c), int(d))
        return chi2_p(t * max(0.0, abs(a * d - b * c) - t / 2) ** 2 / (n * m * (a + c) * (b + d)), 1)

    return pd.Series([one(*x) for x in zip(k1, n1, k2, n2, strict=True)], dtype="float64")


def chi_square(cells: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """(chi2, dof, total, cramers_v) of a table of counts, absent cells being zero.

    Sum of o^2/e less the total: only cells that occur are needed.
    """
    rows = cells.groupBy(row).agg(F.sum(n).alias("r"))
    columns = cells.groupBy(column).agg(F.sum(n).alias("c"))
    told = cells.join(rows, row).join(columns, column)
    sums = told.agg(F.sum(F.col(n) * F.col(n) / (F.col("r") * F.col("c"))).alias("s"), F.sum(n).alias("total"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"))
    chi2 = F.col("total") * (F.col("s") - 1)
    least = F.least("rows", "columns") - 1
    return sums.select(chi2.alias("chi2"), ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("dof"), "total", F.when(least > 0, F.sqrt(F.greatest(F.lit(0.0), chi2) / (F.col("total") * least))).alias("cramers_v"))


@F.pandas_udf(T.DoubleType())
def chi_square_p(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """Chance of a chi-square as large."""
    return pd.Series([chi2_p(float(x), int(d)) for x, d in zip(chi2, dof, strict=True)], dtype="float64")


def benjamini_hochberg(tests: DataFrame, p: str, ident: str) -> DataFrame:
    """`q` of each test: the false discovery rate at which it is found; null p stay out.

    Tests are sorted by ranges; ranks and the running minimum from the largest p down are worked out within a range, and go on to the next by one count and one
    minimum a range, which alone come to the driver: no task holds the family.
    """
    known = tests.where(F.col(p).isNotNull())
    ranged = cut(known.orderBy(p, ident)).withColumn("_part", F.spark_partition_id())
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}
    if not sizes:
        return known.withColumn("q", F.lit(None).cast("double"))
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("_part"))
    ranked = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(p, ident)) + of(before)).withColumn("_v", F.col(p) * total / F.col("_r"))
    least = {r[0]: r[1] for r in ranked.groupBy("_part").agg(F.min("_v")).collect()}
    after, low = {}, float("inf")
    for part in sorted(least, reverse=True):
        after[part], low = low, min(low, least[part])
    down = Window.partitionBy("_part").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min("_v").over(down), of(after))).drop("_r", "_v", "_part")


def ranks(frame: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks of `value`: equal values share the mean of their places. Places come from the counts of the values."""
    counts = frame.groupBy(value).agg(F.count("*").alias("_n"))
    upto = running_total(counts, value, "_n", "_u")
    return frame.join(upto.select(value, (F.col("_u") - (F.col("_n") - 1) / 2.0).alias(out)), value)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where one of both does not vary."""
    known = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1))
    a, b = F.when(known.isNotNull(), F.col(x).cast("double")), F.when(known.isNotNull(), F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(frame: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho, lo, hi): rank correlation with Fisher's interval; none for fewer than 4 pairs."""
    known = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    told = ranks(ranks(known, x, "_rx"), y, "_ry").agg(F.count("*").alias("n"), correlation("_rx", "_ry").alias("rho"))
    rho = F.when(F.col("n") >= 4, F.col("rho"))
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), rho)))
    se = Z95 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)).cast("double"))
    return told.select("n", rho.alias("rho"), F.tanh(z - se).alias("lo"), F.tanh(z + se).alias("hi"))


def auc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """(n, positives, auc): chance that a positive scores above a negative, ties a half, by rank sums."""
    told = ranks(frame.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "_r")
    sums = told.agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("positives"), F.sum(F.when(F.col(label), F.col("_r")).otherwise(0.0)).alias("s"))
    pos = F.col("positives").cast("double")
    return sums.select("n", "positives", F.try_divide(F.col("s") - pos * (pos + 1) / 2, pos * (F.col("n") - pos)).alias("auc"))


def mutual_information(cells: DataFrame, given: str, x: str, y: str, n: str = "n") -> DataFrame:
    """(given, n, bits): what x tells of y within each value of `given`, in bits."""
    w = lambda *keys: Window.partitionBy(*keys)
    told = cells.withColumns({"_x": F.sum(n).over(w(given, x)), "_y": F.sum(n).over(w(given, y)), "_t": F.sum(n).over(w(given))})
    bits = F.col(n) / F.col("_t") * F.log2(F.col(n) * F.col("_t") / (F.col("_x") * F.col("_y")).cast("double"))
    return told.groupBy(given).agg(F.sum(n).alias("n"), F.greatest(F.lit(0.0), F.sum(bits)).alias("bits"))


def posterior_effects(cells: DataFrame, context: str, condition: str, response: str, n: str = "n") -> DataFrame:
    """(context, condition, response, effect): chance of a response with the condition less without it, one of each added."""
    total = Window.partitionBy(context)
    per = cells.withColumns({"_c": F.sum(n).over(Window.partitionBy(context, condition)), "_r": F.sum(n).over(Window.partitionBy(context, response)), "_t": F.sum(n).over(total)})
    with_ = (F.col(n) + 1.0) / (F.col("_c") + 2.0)
    without = (F.col("_r") - F.col(n) + 1.0) / (F.col("_t") - F.col("_c") + 2.0)
    return per.select(context, condition, response, n, (with_ - without).alias("effect"))


def partial_correlation(frame: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(n, rxy, rxz, ryz, partial): correlation of x and y with z held."""
    told = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).agg(F.count("*").alias("n"), correlation(x, y).alias("rxy"), correlation(x, z).alias("rxz"), correlation(y, z).alias("ryz"))
    down = F.sqrt((1 - F.col("rxz") ** 2) * (1 - F.col("ryz") ** 2))
    return told.withColumn("partial", F.try_divide(F.col("rxy") - F.col("rxz") * F.col("ryz"), down))


def redundancy(frame: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, sibling, r): for each metric the one that it goes with most; one pass gives all correlations."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    row = frame.agg(*[correlation(a, b).alias(f"{a}~{b}") for a, b in pairs])
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("sibling"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs for m, o in ((a, b), (b, a))])
    told = row.select(F.explode(both).alias("p")).select("p.*")
    return told.groupBy("metric").agg(F.min_by(F.struct("sibling", "r"), F.struct(-F.abs("r"), F.col("sibling"))).alias("b")).select("metric", "b.sibling", "b.r")


def coverage(counts: DataFrame, group: str, who: str, n: str = "n") -> DataFrame:
    """(group, clusters, effective, top_share, grade, reason): whether evidence comes from enough sources to speak for the group."""
    share = counts.withColumn("_s", F.col(n) / F.sum(n).over(Window.partitionBy(group)))
    told = share.groupBy(group).agg(F.count("*").alias("clusters"), (1 / F.sum(F.col("_s") * F.col("_s"))).alias("effective"), F.max("_s").alias("top_share"))
    few, even = F.col("clusters") < 5, F.col("effective") < 2.0
    grade = F.when(few | even, "withheld").when(F.col("effective") >= 5, "adequate").when(F.col("effective") >= 3, "moderate").otherwise("low")
    return told.withColumns({"grade": grade, "reason": F.when(few, "too few sources").when(even, "one source dominates")})


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean", "lo", "hi")]))
def beta_interval(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
    """Mean and central 95 % of Beta(successes + 1, failures + 1)."""
    rows = [((s + 1) / (t + 2), beta_quantile(0.025, s + 1, t - s + 1), beta_quantile(0.975, s + 1, t - s + 1)) for s, t in zip(successes, trials, strict=True)]
    return pd.DataFrame(rows, columns=["mean", "lo", "hi"])


def bootstrap(counts: DataFrame, group: str, who: str, k: str, n: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """(group, rate, lo, hi): the pooled rate of each group, its interval from drawing the group's people again with replacement.

    `counts` has a row per group and person (k of n). A person's number in a draw is Poisson(1) by hash, the usual stand-in for drawing
    with replacement, so each row makes its draws by itself and nothing is gathered by group but sums.
    """
    spread = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.xxhash64(F.lit(seed), F.col(group).cast("string"), F.col(who).cast("string"), "draw").bitwiseAND((1 << 40) - 1) + 0.5) / float(1 << 40)
    cumulative, steps = math.exp(-1), []
    term = math.exp(-1)
    for i in range(1, 9):
        steps.append(F.when(u > cumulative, 1).otherwise(0))
        term /= i
        cumulative += term
    times = sum(steps[1:], steps[0])
    sums = spread.withColumn("_w", times).groupBy(group, "draw").agg(F.sum(F.col("_w") * F.col(k)).alias("_k"), F.sum(F.col("_w") * F.col(n)).alias("_n")).where("_n > 0")
    ends = sums.groupBy(group).agg(F.percentile(F.col("_k") / F.col("_n"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = counts.groupBy(group).agg((F.sum(k) / F.sum(n)).alias("rate"))
    return whole.join(ends, group, "left").select(group, "rate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def lift_stability(category: DataFrame, base: DataFrame, who: str, item: str, balanced: bool = False, least: int = 3, draws: int = 200, high: float = 0.7, seed: int = 42) -> DataFrame:
    """(item, n, lift, stable_share, grade): log2 of an item's share in the category over that in the baseline, and the share of draws of the category's people that keep its sign.

    Shares are of all events or, `balanced`, means of the people's own shares. A draw keeps the sign only with at least `least` events of the item; 'alta' from
    `high` on, else 'baixa', also where the lift is unknown or rests on fewer events. People are drawn with Poisson(1) weights as in `bootstrap`.
    """

    def counted(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        each = frame.groupBy(who, item).agg(F.count("*").alias("k"))
        own = each.groupBy(who).agg(F.sum("k").alias("n"))
        return each.join(own, who).select(who, item, "k", (F.col("k") / F.col("n") if balanced else F.col("k")).alias("m")), own.select(who, (F.lit(1) if balanced else F.col("n")).alias("of"))

    def shares(each: DataFrame, own: DataFrame) -> DataFrame:
        total = own.agg(F.sum("of").alias("of"))
        return each.groupBy(item).agg(F.sum("k").alias("n"), F.sum("m").alias("m")).crossJoin(F.broadcast(total)).select(item, "n", (F.col("m") / F.col("of")).alias("p"))

    each, own = counted(category)
    each, own = cut(each), cut(own)
    seen = shares(each, own).join(shares(*counted(base)).select(item, F.col("p").alias("p_base")), item, "left").withColumn("lift", F.log2(F.col("p") / F.col("p_base")))
    seen = cut(seen)
    ranked = seen.where(F.col("lift").isNotNull() & (F.col("n") >= least))

    def drawn(frame: DataFrame) -> DataFrame:
        u = (F.xxhash64(F.lit(seed), F.col(who).cast("string"), "draw").bitwiseAND((1 << 40) - 1) + 0.5) / float(1 << 40)
        upto = term = math.exp(-1)
        times = F.lit(0)
        for i in range(1, 9):
            times = times + F.when(u > upto, 1).otherwise(0)
            term /= i
            upto += term
        return frame.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", times).where("w > 0")

    whole = drawn(own).groupBy("draw").agg(F.sum(F.col("w") * F.col("of")).alias("of"))
    again = drawn(each.join(ranked.select(item), item, "left_semi")).groupBy(item, "draw").agg(F.sum(F.col("w") * F.col("k")).alias("k"), F.sum(F.col("w") * F.col("m")).alias("m"))
    held = again.join(F.broadcast(whole), "draw").join(ranked, item).where((F.col("k") >= least) & ((F.log2(F.col("m") / F.col("of") / F.col("p_base")) >= 0) == (F.col("lift") >= 0)))
    kept = held.groupBy(item).agg((F.count("*") / draws).alias("stable_share"))
    told = seen.join(kept, item, "left").withColumn("stable_share", F.coalesce("stable_share", F.lit(0.0)))
    return told.select(item, "n", "lift", "stable_share", F.when(F.col("stable_share") >= high, "alta").otherwise("baixa").alias("grade"))


def permutation(cells: DataFrame, group: str, row: str, column: str, n: str = "n", draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(group, chi2, p): a Monte-Carlo exact test of each group's table, with one added.

    Only the table of counts goes to a task; random tables with its margins are drawn row by row (multivariate hypergeometric), which is what
    shuffling all cases would give.
    """

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=row, columns=column, values=n, aggfunc="sum", fill_value=0).to_numpy().astype("int64")
        rows, columns, total = table.sum(1), table.sum(0), table.sum()
        expected = np.outer(rows, columns) / total
        score = lambda t: float((np.square(t - expected) / expected).sum())
        seen, rng, hits = score(table), np.random.default_rng(seed), 0
        for _ in range(draws):
            left, drawn = columns.copy(), []
            for r in rows[:-1]:
                drawn.append(rng.multivariate_hypergeometric(left, r, method="marginals"))
                left = left - drawn[-1]
            drawn.append(left)
            hits += score(np.array(drawn)) >= seen - 1e-9
        return pd.DataFrame({"group": [str(key[0])], "chi2": [round(seen, 6)], "p": [(hits + 1) / (draws + 1)]})

    return cells.select(F.col(group).cast("string").alias("group"), row, column, n).groupBy("group").applyInPandas(solve, "group string, chi2 double, p double").withColumnRenamed("group", group)
