"""Problem 5: one ranking from pairwise comparisons, by spring energy and Jacobi-preconditioned iterations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumikata.llm.stripes import numbered
from kumikata.plans.runtime import cut, cut_and_measured, spread


def strengths(comparisons: DataFrame, winner: str = "winner", loser: str = "loser", tie: str | None = None, ridge: float = 3.0, tolerance: float = 1e-7, rounds: int = 1000) -> DataFrame:
    """A strength for every item of pairwise comparisons: (item, strength, comparisons, won, lost).

    Each comparison is a spring that would place its winner one unit above its loser (at the same height where the boolean column `tie` is true); `ridge` ties each item to
    the middle by as many springs of length 0, which holds back items with few comparisons and makes the strengths of
    unconnected groups definite. The energy's minimum is the solution of one sparse, symmetric, positive definite linear system with
    an entry per compared pair. It is solved by conjugate gradients with the Jacobi (diagonal) preconditioner, in the form with one product and one sum a round: one join of the pairs with the
    items, one sum by item, and two numbers that reach the driver, which stops at the relative `tolerance`. Strengths that have not settled after `rounds` are an error, never a result.

    Comparisons are added up by pair before the first round, so that repeated pairs cost one entry. Cases: a null item or an item against
    itself is left out, ties in strength are equal strengths, an empty table gives no row, other columns are ignored.
    """
    draw = F.coalesce(F.col(tie), F.lit(False)) if tie else F.lit(False)
    bouts = comparisons.where(F.col(winner).isNotNull() & F.col(loser).isNotNull() & (F.col(winner) != F.col(loser))).select(F.col(winner).alias("a"), F.col(loser).alias("b"), draw.alias("draw"))
    sums = bouts.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("draw"), 0).otherwise(1)).alias("won"))
    both = sums.select("a", "b", "n", "won", F.lit(0).cast("long").alias("lost")).unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.lit(0).cast("long").alias("won"), F.col("won").alias("lost")))
    pairs = cut(both.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "won", "lost")]))
    items = pairs.groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("comparisons"), F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    parts = int(comparisons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # laid by the item they pull from and sorted, once for all rounds; lost parts are read from `pairs` again
    links = pairs.select("a", "b", F.col("n").cast("double").alias("n")).repartition(parts, "b").sortWithinPartitions("b").persist()

    def told(state: DataFrame) -> tuple[DataFrame, float, float]:
        """The state with w, what the system gives for u, and the round's two numbers."""
        pulled = links.join(spread(state.select(F.col("item").alias("b"), F.col("u").alias("ub"))), "b").groupBy(F.col("a").alias("item")).agg(F.sum(F.col("n") * F.col("ub")).alias("pull"))
        new = state.join(spread(pulled), "item", "left").withColumn("w", F.col("d") * F.col("u") - F.coalesce("pull", F.lit(0.0))).drop("pull")
        written, seen = cut_and_measured(new, left=F.sum(F.col("r") * F.col("u")), bent=F.sum(F.col("w") * F.col("u")))
        return written, seen["left"] or 0.0, seen["bent"] or 0.0

    def numbers(beta: float, step: float) -> tuple[Column, Column]:
        """The round's numbers, looked up in a constant array by the column `one`, which is 0: as plain constants they would give every round code of its own to compile."""
        both = F.lit([beta, step])
        return F.get(both, F.col("one")), F.get(both, F.col("one") + 1)

    try:
        diagonal = F.col("comparisons") + F.lit(float(ridge))
        state = items.withColumns({"d": diagonal, "x": F.lit(0.0), "r": (F.col("won") - F.col("lost")).cast("double")}).withColumn("u", F.col("r") / F.col("d"))
        state, now, bent = told(state.withColumns({"p": F.lit(0.0), "s": F.lit(0.0), "one": F.lit(0)}))
        first, beta, step, done = now, 0.0, now / bent if bent else 0.0, 0
        while now > tolerance**2 * first:
            if done == rounds:
                raise RuntimeError(f"strengths have not settled after {rounds} rounds: residual {math.sqrt(now / first):.1e} of the first")
            along, far = numbers(beta, step)
            moved = state.withColumns({"p": F.col("u") + along * F.col("p"), "s": F.col("w") + along * F.col("s")}).drop("w")
            moved = moved.withColumns({"x": F.col("x") + far * F.col("p"), "r": F.col("r") - far * F.col("s")})
            before = now
            state, now, bent = told(moved.withColumn("u", F.col("r") / F.col("d")))
            done, beta = done + 1, now / before
            step = now / (bent - beta * now / step) if now else 0.0
    finally:
        links.unpersist()
    return state.select("item", F.col("x").alias("strength"), "comparisons", "won", "lost")


def ranked(strength: DataFrame, by: str = "strength", then: str = "item") -> DataFrame:
    """With `rank` from 1 on by falling `by`, then `then`: range partitions are sorted where they lie and numbered from their sizes."""
    return numbered(strength.orderBy(F.desc(by), then)).withColumn("rank", F.col("number") + 1).drop("number")
