"""Ratings: order-dependent Elo folds by pool, Glicko-2 by period, graph ratings by athlete, and what judges them.

A fold reads each pool's bouts in order and keeps one state per athlete: partitions are clustered by pool and sorted, and streamed, so
that a pool is never held as a whole. Glicko-2 needs no order within a period: each period is a join with the states before it and sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kumikata.plans.runtime import cut

INITIAL = 1000.0
# How much more a bout moves ratings by its kind of win and its stage.
WIN_MULT = {"SUBMISSION": 1.15, "DECISION": 0.85, "POINTS": 1.0, "DQ": 1.0, "INJURY": 1.0}
STAGE_MULT = {"SPF": 1.4, "F": 1.3, "SF": 1.2, "3RD": 1.15, "3PLC": 1.15, "R2": 1.0, "R1": 1.0, "E1": 1.0, "8F": 1.0, "4F": 1.0}
DRAW_SCALE = 100.0
# Glicko-2's scale, its centre, and the state of an athlete not yet seen.
SCALE, CENTRE, SEED, DEVIATION, VOLATILITY, TAU = 173.7178, 1500.0, 1750.0, 250.0, 0.06, 0.5


def expected(a: Column, b: Column) -> Column:
    """Chance that a rating of `a` beats `b`."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400.0))


def draw_probability(a: Column, b: Column) -> Column:
    """Chance of a draw by the gap between two ratings."""
    return DRAW_SCALE / (DRAW_SCALE + F.abs(a - b))


def opponent_rating(rows: DataFrame, ratings: DataFrame, opponent: str = "opponent", default: float = 800.0) -> DataFrame:
    """Rows with `opponent_rating`, of (athlete, rating); `default` for somebody not yet rated."""
    return rows.join(ratings.select(F.col("athlete").alias(opponent), F.col("rating").alias("opponent_rating")), opponent, "left").withColumn("opponent_rating", F.coalesce("opponent_rating", F.lit(default)))


def match_score(won: Column, kind: Column, own_points: Column, other_points: Column) -> Column:
    """A bout's score in [0, 1] for one side: a draw, a submission, else half the result (0.75 or 0.25) and half the share of points, which stays on the result's side of 0.5. Fixed values."""
    result = F.when(won, 0.75).otherwise(0.25)
    share = F.try_divide(own_points.cast("double"), own_points + other_points)
    mixed = F.coalesce(0.5 * result + 0.5 * share, result)
    held = F.when(won, F.greatest(F.lit(0.5), mixed)).otherwise(F.least(F.lit(0.5), mixed))
    return F.when(kind == "DRAW", 0.5).when(kind == "SUBMISSION", F.when(won, 1.0).otherwise(0.0)).otherwise(held)


def precision_weight(deviation: Column) -> Column:
    return 1 / deviation**2


def bounded_weight(deviation: Column, reference: float = 200.0) -> Column:
    """A weight in (0, 1] that halves where the deviation is `reference`."""
    return 1 / (1 + (deviation / reference) ** 2)


def describe(rating: Column, deviation: Column) -> Column:
    return F.concat(F.round(rating).cast("int").cast("string"), F.lit(" · "), tier(deviation))


def bouts_hash(bouts: DataFrame, columns: list[str]) -> DataFrame:
    """(bouts, hash): one hash of all rows whatever their order and place: sums of two hashes of each row, so that no list is gathered."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    halves = [F.coalesce(F.sum(F.conv(F.substring(F.sha2(text, 256), start, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for start in (1, 13, 25, 37)]
    return bouts.agg(F.count("*").alias("bouts"), F.substring(F.sha2(F.concat_ws("|", *[h.cast("string") for h in halves]), 256), 1, 16).alias("hash"))


def compare_states(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, field, first, second): where two runs differ by more than `tolerance`, or one lacks what the other has."""
    both = a.select(*key, F.struct(*values).alias("_a")).join(b.select(*key, F.struct(*values).alias("_b")), key, "full_outer")
    fields = F.array(*[F.struct(F.lit(v).alias("field"), F.col("_a")[v].cast("double").alias("first"), F.col("_b")[v].cast("double").alias("second")) for v in values])
    told = both.select(*key, F.explode(fields).alias("f")).select(*key, "f.*")
    return told.where((F.col("first").isNull() != F.col("second").isNull()) | (F.abs(F.col("first") - F.col("second")) > tolerance))


def ranked_pools(ratings: DataFrame, pool: str, top: int) -> DataFrame:
    """(pool, place, athlete, rating): the best of each pool."""
    w = Window.partitionBy(pool).orderBy(F.desc("rating"), "athlete")
    return ratings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(pool, "place", "athlete", "rating")


def _expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / 400))


def elo(bouts: DataFrame, pool: str, order: list[str], base_k: float | str = 40.0, draws: bool = False, finish_bump: float = 0.0, digits: int | None = None) -> DataFrame:
    """(pool, athlete, elo, peak, matches, wins, losses, draws, last_year) after all bouts of each pool in `order`.

    `bouts` has winner, loser, method, stage, year, and `draw` if `draws`. `base_k` is a number or a column, so that a grid of them is so many pools. `finish_bump`
    adds to K for a submission; `digits` rounds after each bout. A draw moves both by the gap to what was expected with draws reckoned in; the
    sum of a pool's ratings stays. Bouts without winner, loser or year are left out.
    """
    k_column = isinstance(base_k, str)
    used = bouts.where("winner IS NOT NULL AND loser IS NOT NULL AND winner <> loser AND year IS NOT NULL")
    told = used.select(F.col(pool).cast("string").alias("pool"), "winner", "loser", "method", "stage", F.col("year").cast("int").alias("year"), (F.col("draw") if draws else F.lit(False)).alias("draw"), (F.col(base_k) if k_column else F.lit(float(base_k))).cast("double").alias("k"), F.struct(*order).alias("o"))
    sorted_ = told.repartition("pool").sortWithinPartitions("pool", "o").drop("o")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}

        def done() -> pd.DataFrame:
            return pd.DataFrame([(now, name, *s) for name, s in state.items()], columns=["pool", "athlete", "elo", "peak", "matches", "wins", "losses", "draws", "last_year"])

        for frame in frames:
            for pool_, w, l, method, stage, year, draw, k in frame.itertuples(index=False):  # noqa: E741
                if pool_ != now:
                    if state:
                        yield done()
                    now, state = pool_, {}
                a = state.setdefault(w, [INITIAL, INITIAL, 0, 0, 0, 0, 0])
                b = state.setdefault(l, [INITIAL, INITIAL, 0, 0, 0, 0, 0])
                factor = (k + finish_bump * (method == "SUBMISSION")) * WIN_MULT.get(method, 1.0) * STAGE_MULT.get(stage, 1.0)
                chance = _expected(a[0], b[0])
                if draw:
                    p_draw = DRAW_SCALE / (DRAW_SCALE + abs(a[0] - b[0]))
                    delta = factor * (0.5 - chance * (1 - p_draw) - 0.5 * p_draw)
                else:
                    delta = factor * (1 - chance)
                a[0], b[0] = a[0] + delta, b[0] - delta
                if digits is not None:
                    a[0], b[0] = round(a[0], digits), round(b[0], digits)
                for x, at in ((a, 5 if draw else 3), (b, 5 if draw else 4)):
                    x[1] = max(x[1], x[0])
                    x[2] += 1
                    x[at] += 1
                    x[6] = max(x[6], year)
        if state:
            yield done()

    return sorted_.mapInPandas(fold, "pool string, athlete string, elo double, peak double, matches long, wins long, losses long, draws long, last_year int")


def calibrate_k(bouts: DataFrame, pool: str, order: list[str], grid: tuple[float, ...], target_std: float) -> DataFrame:
    """(pool, k, std): the K of the grid whose ratings spread most nearly as wanted; every K is a pool of its own, so all run side by side."""
    spread = bouts.withColumn("k", F.explode(F.array(*map(F.lit, grid)))).withColumn("_pool", F.concat_ws("\u0001", F.col(pool).cast("string"), F.col("k").cast("string")))
    rated = elo(spread, "_pool", order, "k")
    std = rated.groupBy("pool").agg(F.stddev_samp("elo").alias("std"))
    told = std.select(F.substring_index("pool", "\u0001", 1).alias(pool), F.substring_index("pool", "\u0001", -1).cast("double").alias("k"), "std").where("std IS NOT NULL")
    return told.groupBy(pool).agg(F.min_by(F.struct("k", "std"), F.struct(F.abs(F.col("std") - target_std), F.col("k"))).alias("b")).select(pool, "b.k", "b.std")


def waterfall(bouts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`reason`: the first rule that a bout breaks, else 'eligible'; a rule that is null counts as broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules], F.lit("eligible"))
    return bouts.withColumn("reason", reason)


# Glicko-2


def observations(bouts: DataFrame) -> DataFrame:
    """(period, athlete, opponent, score, weight): each bout (period, a, b, score_a[, weight]) from both sides."""
    w = F.col("weight") if "weight" in bouts.columns else F.lit(1.0)
    return bouts.select("period", F.col("a").alias("athlete"), F.col("b").alias("opponent"), F.col("score_a").cast("double").alias("score"), w.alias("weight")).unionByName(bouts.select("period", F.col("b").alias("athlete"), F.col("a").alias("opponent"), (1.0 - F.col("score_a")).alias("score"), w.alias("weight")))


def period_sums(observed: DataFrame, states: DataFrame) -> DataFrame:
    """(athlete, inv_v, score_sum): what one period's bouts say, against the states (athlete, rating, deviation, volatility) before it."""
    mine = states.select("athlete", ((F.col("rating") - CENTRE) / SCALE).alias("mu"))
    theirs = states.select(F.col("athlete").alias("opponent"), ((F.col("rating") - CENTRE) / SCALE).alias("muj"), (F.col("deviation") / SCALE).alias("phij"))
    told = observed.join(mine, "athlete").join(theirs, "opponent")
    g = 1 / F.sqrt(1 + 3 * F.col("phij") ** 2 / math.pi**2)
    e = 1 / (1 + F.exp(-g * (F.col("mu") - F.col("muj"))))
    return told.groupBy("athlete").agg(F.sum(F.col("weight") * g * g * e * (1 - e)).alias("inv_v"), F.sum(F.col("weight") * g * (F.col("score") - e)).alias("score_sum"))


def glicko_update(rating: np.ndarray, deviation: np.ndarray, volatility: np.ndarray, inv_v: np.ndarray, score_sum: np.ndarray, tau: float | np.ndarray = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New rating, deviation and volatility of many athletes; who has no bout (inv_v 0 or nan) only widens."""
    mu, phi, sigma = (rating - CENTRE) / SCALE, deviation / SCALE, volatility.copy()
    idle = ~(inv_v > 0)
    v = 1 / np.where(idle, 1.0, inv_v)
    delta = v * np.where(idle, 0.0, score_sum)
    a = np.log(sigma**2)

    def f(x: np.ndarray) -> np.ndarray:
        ex = np.exp(x)
        return ex * (delta**2 - phi**2 - v - ex) / (2 * (phi**2 + v + ex) ** 2) - (x - a) / tau**2

    gap = delta**2 - phi**2 - v
    low, high = a.copy(), np.where(gap > 0, np.log(np.where(gap > 0, gap, 1.0)), a - tau)
    for k in range(2, 200):
        down = (gap <= 0) & (f(high) < 0)
        if not down.any():
            break
        high = np.where(down, a - k * tau, high)
    f_low, f_high = f(low), f(high)
    for _ in range(100):
        open_ = np.abs(high - low) > 1e-6
        if not open_.any():
            break
        flat = np.where(f_high - f_low == 0, 1.0, f_high - f_low)
        mid = low + (low - high) * f_low / flat
        f_mid = f(mid)
        crossed = f_mid * f_high <= 0
        low, f_low = np.where(open_ & crossed, high, low), np.where(open_ & crossed, f_high, np.where(open_, f_low / 2, f_low))
        high, f_high = np.where(open_, mid, high), np.where(open_, f_mid, f_high)
    new = np.where(idle, sigma, np.exp(low / 2))
    star = np.sqrt(phi**2 + new**2)
    phi_new = np.where(idle, star, 1 / np.sqrt(1 / star**2 + 1 / v))
    mu_new = np.where(idle, mu, mu + phi_new**2 * np.where(idle, 0.0, score_sum))
    return CENTRE + SCALE * mu_new, SCALE * phi_new, new


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rating", "deviation", "volatility")]))
def _update(rating: pd.Series, deviation: pd.Series, volatility: pd.Series, inv_v: pd.Series, score_sum: pd.Series) -> pd.DataFrame:
    out = glicko_update(*(x.to_numpy(float) for x in (rating, deviation, volatility, inv_v.fillna(0), score_sum.fillna(0))))
    return pd.DataFrame(dict(zip(("rating", "deviation", "volatility"), out, strict=True)))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rating", "deviation", "volatility")]))
def _update_by(rating: pd.Series, deviation: pd.Series, volatility: pd.Series, inv_v: pd.Series, score_sum: pd.Series, tau: pd.Series) -> pd.DataFrame:
    out = glicko_update(*(x.to_numpy(float) for x in (rating, deviation, volatility, inv_v.fillna(0), score_sum.fillna(0))), tau.to_numpy(float))
    return pd.DataFrame(dict(zip(("rating", "deviation", "volatility"), out, strict=True)))


def seeds(bouts: DataFrame) -> DataFrame:
    """The state before the first period of everybody in the bouts (a, b)."""
    names = bouts.select(F.explode(F.array("a", "b")).alias("athlete")).distinct()
    return names.select("athlete", F.lit(SEED).alias("rating"), F.lit(DEVIATION).alias("deviation"), F.lit(VOLATILITY).alias("volatility"))


def glicko2(bouts: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(athlete, rating, deviation, volatility) after all periods of `bouts` (period, a, b, score_a[, weight]).

    All of a period's bouts see the states before it, so their order is of no account; who is idle widens. Periods (years) are few: they alone
    come to the driver, each is one join and one sum, its states are checkpointed.
    """
    bouts = cut(bouts)
    states = seeds(bouts) if states is None else states
    seen = observations(bouts)
    for row in bouts.select("period").distinct().orderBy("period").collect():
        sums = period_sums(seen.where(F.col("period") == row[0]), states)
        states = cut(states.join(sums, "athlete", "left").select("athlete", _update("rating", "deviation", "volatility", "inv_v", "score_sum").alias("s")).select("athlete", "s.*"))
    return states


#: One cell of the node track's grid: how much a bout weighs, the deviation of a new node, its tau and volatility. Fixed values.
NODE_CELL = ("0.25/350", 0.25, 350.0, 0.5, 0.06)


def node_track(bouts: DataFrame, nodes: DataFrame, grid: list[tuple[str, float, float, float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Global and node states after all periods: (athlete, rating, deviation, volatility) and (cell, athlete, node, rating, deviation, volatility, seed, bouts, occurrences).

    `bouts` has (match, period, a, b, score_a), `nodes` (match, athlete, node, occurrences), what each side showed, once a bout. A node begins at its athlete's
    global rating before the period in which it is first seen, with the deviation of its cell, and is rated against the opponents' global states before the period;
    repeats in a bout do not add weight. All cells of `grid` (cell, weight, deviation, tau, volatility) run side by side. Per period: a join
    with the states before it and sums; a node that is not seen only widens.
    """
    spark = bouts.sparkSession
    cells = F.broadcast(spark.createDataFrame(grid or [NODE_CELL], "cell string, weight double, start double, tau double, first_volatility double"))
    bouts = cut(bouts.select("match", "period", "a", "b", F.col("score_a").cast("double").alias("score_a")))
    sides = bouts.select("match", "period", F.col("a").alias("athlete"), F.col("b").alias("opponent"), F.col("score_a").alias("score")).unionByName(bouts.select("match", "period", F.col("b").alias("athlete"), F.col("a").alias("opponent"), (1 - F.col("score_a")).alias("score")))
    shown = cut(sides.join(nodes.groupBy("match", "athlete", "node").agg(F.sum("occurrences").alias("occurrences")), ["match", "athlete"]))
    seen, states, track, key = observations(bouts), seeds(bouts), None, ["cell", "athlete", "node"]
    for row in bouts.select("period").distinct().orderBy("period").collect():
        now = shown.where(F.col("period") == row[0]).join(states.select(F.col("athlete").alias("opponent"), ((F.col("rating") - CENTRE) / SCALE).alias("muj"), (F.col("deviation") / SCALE).alias("phij")), "opponent")
        counts = now.groupBy("athlete", "node").agg(F.count("*").alias("more"), F.sum("occurrences").alias("more_occurrences"))
        fresh = counts.join(states.select("athlete", F.col("rating").alias("own")), "athlete").withColumn("_one", F.lit(0)).join(cells.withColumn("_one", F.lit(0)), "_one").drop("_one")
        if track is None:
            before = fresh.select(*key, F.col("own").alias("rating"), F.col("start").alias("deviation"), F.col("first_volatility").alias("volatility"), F.col("own").alias("seed"), F.lit(0).cast("long").alias("bouts"), F.lit(0).cast("long").alias("occurrences"), "more", "more_occurrences")
        else:
            both = track.join(fresh.select(*key, "own", "start", "first_volatility", "more", "more_occurrences"), key, "full_outer")
            before = both.select(*key, F.coalesce("rating", "own").alias("rating"), F.coalesce("deviation", "start").alias("deviation"), F.coalesce("volatility", "first_volatility").alias("volatility"), F.coalesce("seed", "own").alias("seed"), F.coalesce("bouts", F.lit(0)).alias("bouts"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "more", "more_occurrences")
        before = cut(before)
        told = now.select("athlete", "node", "score", "muj", "phij").join(before.select(*key, ((F.col("rating") - CENTRE) / SCALE).alias("mu")), ["athlete", "node"])
        g = 1 / F.sqrt(1 + 3 * F.col("phij") ** 2 / math.pi**2)
        e = 1 / (1 + F.exp(-g * (F.col("mu") - F.col("muj"))))
        sums = told.groupBy(*key).agg(F.sum(g * g * e * (1 - e)).alias("inv_v"), F.sum(g * (F.col("score") - e)).alias("score_sum"))
        weighed = before.join(sums, key, "left").join(cells.select("cell", "weight", "tau"), "cell")
        update = _update_by("rating", "deviation", "volatility", F.col("weight") * F.col("inv_v"), F.col("weight") * F.col("score_sum"), "tau").alias("s")
        track = cut(weighed.select(*key, update, "seed", (F.col("bouts") + F.coalesce("more", F.lit(0))).alias("bouts"), (F.col("occurrences") + F.coalesce("more_occurrences", F.lit(0))).alias("occurrences")).select(*key, "s.*", "seed", "bouts", "occurrences"))
        states = cut(states.join(period_sums(seen.where(F.col("period") == row[0]), states), "athlete", "left").select("athlete", _update("rating", "deviation", "volatility", "inv_v", "score_sum").alias("s")).select("athlete", "s.*"))
    return states, track


def node_criteria(states: DataFrame, track: DataFrame, holdout: DataFrame, nodes: DataFrame, low: float = 200.0, still: float = 5.0) -> DataFrame:
    """(cell, nodes, at_prior, single_bout, median_bouts, holdout, base_loss, loss, calibrated, predicted, observed) per cell of a node track, judged on the bouts after it.

    `base_loss` is the log loss of the global states alone, `loss` that of each side's states combined by precision with those of its nodes; `predicted` and `observed` are means over
    nodes surer than `low` against the opponents' global states; a node is at its prior if it is within `still` of its seed.
    """
    clamp = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    loss = lambda p: F.avg(-(F.col("score_a") * F.ln(p) + (1 - F.col("score_a")) * F.ln(1 - p)))
    about = track.groupBy("cell").agg(F.count("*").alias("nodes"), F.avg((F.abs(F.col("rating") - F.col("seed")) < still).cast("double")).alias("at_prior"), F.avg((F.col("bouts") <= 1).cast("double")).alias("single_bout"), F.percentile("bouts", F.lit(0.5)).alias("median_bouts"))
    cells = track.select("cell").distinct()
    whole = states.withColumn("_one", F.lit(0)).join(F.broadcast(cells.withColumn("_one", F.lit(0))), "_one").select("cell", "athlete", "rating", "deviation")
    mixed = cut(blend(whole.unionByName(track.select("cell", "athlete", "rating", "deviation")), ["cell", "athlete"]))
    side = lambda x: states.select(F.col("athlete").alias(x), F.col("rating").alias(f"r{x}"), F.col("deviation").alias(f"d{x}"))
    known = holdout.join(side("a"), "a").join(side("b"), "b")
    blended = lambda x: mixed.select("cell", F.col("athlete").alias(x), F.col("rating").alias(f"m{x}"), F.col("deviation").alias(f"e{x}"))
    judged = known.join(blended("a"), "a").join(blended("b"), ["cell", "b"])
    base, own = (clamp(win_chance(*map(F.col, names))) for names in (("ra", "da", "rb", "db"), ("ma", "ea", "mb", "eb")))
    losses = judged.groupBy("cell").agg(F.count("*").alias("holdout"), loss(base).alias("base_loss"), loss(own).alias("loss"))
    sides = known.select("match", F.col("a").alias("athlete"), "rb", "db", F.col("score_a").alias("score")).unionByName(known.select("match", F.col("b").alias("athlete"), F.col("ra").alias("rb"), F.col("da").alias("db"), (1 - F.col("score_a")).alias("score")))
    sure = track.where(F.col("deviation") < low).select("cell", "athlete", "node", "rating", "deviation")
    told = sides.join(nodes.select("match", "athlete", "node").distinct(), ["match", "athlete"]).join(sure, ["athlete", "node"])
    calibration = told.groupBy("cell").agg(F.count("*").alias("calibrated"), F.avg(win_chance(*map(F.col, ("rating", "deviation", "rb", "db")))).alias("predicted"), F.avg("score").alias("observed"))
    return about.join(losses, "cell", "left").join(calibration, "cell", "left").na.fill(0, ["holdout", "calibrated"])


def win_chance(a: Column, da: Column, b: Column, db: Column) -> Column:
    """Chance that a beats b by their ratings and the uncertainty of both."""
    phi = F.sqrt(da**2 + db**2) / SCALE
    g = 1 / F.sqrt(1 + 3 * phi**2 / math.pi**2)
    return 1 / (1 + F.exp(-g * (a - b) / SCALE))


def log_loss(bouts: DataFrame, split: int) -> DataFrame:
    """(train, holdout, loss, accuracy): ratings from the periods up to `split`, judged on the bouts after it whose sides both have one."""
    train, test = bouts.where(F.col("period") <= split), bouts.where(F.col("period") > split)
    states = glicko2(train)
    a, b = (states.select(F.col("athlete").alias(x), F.col("rating").alias(f"r{x}"), F.col("deviation").alias(f"d{x}")) for x in "ab")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), win_chance(*map(F.col, ("ra", "da", "rb", "db")))))
    told = test.join(a, "a").join(b, "b").withColumn("p", p)
    return told.agg(F.lit(train.count()).alias("train"), F.count("*").alias("holdout"), F.avg(-(F.col("score_a") * F.ln("p") + (1 - F.col("score_a")) * F.ln(1 - F.col("p")))).alias("loss"), F.avg(((F.col("p") > 0.5) == (F.col("score_a") > 0.5)).cast("double")).alias("accuracy"))


def summary(frame: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, median, p10, p90, most) of a rating."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    return frame.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"), F.max(value).alias("most")).select(group, "n", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"), "most")


def base_k(played: int) -> float:
    """How far a bout moves a graph after so many bouts: 40, from the 11th 32, from the 31st falling to 10."""
    return 40.0 if played <= 10 else 32.0 if played <= 30 else max(10.0, 32.0 - 8.0 * math.log10(played - 29))


def graph_elo(entries: DataFrame, base: float = 800.0, mult: float = 2.5, half_life: float = 36.0) -> DataFrame:
    """(athlete, label, elo, uses): each athlete's own graph rated bout by bout.

    `entries` has (athlete, seq, label, score, opponent[, months]): an athlete's moves with the bout's order, score in [0, 1], the opponent's rating and
    how many months ago it was. A new move starts at the graph's mean; all moves of a bout go by K (from the bouts before, the gap, `mult`, and
    halved every `half_life` months) towards the score; a win (score above
    0.5) never lowers. Athletes are independent: their rows are clustered and streamed in order, one bout at a time.
    """
    rows = entries.select("athlete", "seq", "label", F.col("score").cast("double").alias("score"), F.col("opponent").cast("double").alias("opponent"), (F.col("months").cast("double") if "months" in entries.columns else F.lit(0.0)).alias("months")).repartition("athlete").sortWithinPartitions("athlete", "seq", "label")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, graph, uses, bout, played = None, {}, {}, [], 0

        def close() -> None:
            nonlocal bout, played
            if not bout:
                return
            mean = sum(graph.values()) / len(graph) if graph else base
            for _, label, *_ in bout:
                graph.setdefault(label, mean)
                uses[label] = uses.get(label, 0) + 1
            _, _, score, opponent, months = bout[0]
            decay = 2.0 ** (-months / half_life)
            mean = sum(graph.values()) / len(graph)
            gap = min(1.0, max(0.1, abs(opponent - mean) / 400))
            delta = base_k(played) * gap * mult * decay * (score - _expected(mean, opponent))
            if score > 0.5:
                delta = max(0.0, delta)
            for label in {b[1] for b in bout}:
                graph[label] += delta
            played += 1
            bout = []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(who, x, round(r, 4), uses[x]) for x, r in graph.items()], columns=["athlete", "label", "elo", "uses"])

        for frame in frames:
            for athlete, seq, label, score, opponent, months in frame.itertuples(index=False):
                if athlete != who:
                    close()
                    if graph:
                        yield done()
                    who, graph, uses, bout, played = athlete, {}, {}, [], 0
                if bout and bout[0][0] != seq:
                    close()
                bout.append((seq, label, score, opponent, months))
        close()
        if graph:
            yield done()

    return rows.mapInPandas(fold, "athlete string, label string, elo double, uses long")


def blend(states: DataFrame, group: str | list[str]) -> DataFrame:
    """(group, rating, deviation): states combined by their precision."""
    p = 1 / F.col("deviation") ** 2
    return states.groupBy(*([group] if isinstance(group, str) else group)).agg((F.sum(F.col("rating") * p) / F.sum(p)).alias("rating"), (1 / F.sqrt(F.sum(p))).alias("deviation"))


def tier(deviation: Column) -> Column:
    """How sure a rating is; the bounds belong to the surer side."""
    return F.when(deviation <= 100, "high").when(deviation <= 200, "medium").otherwise("low")


def interval(rating: Column, deviation: Column) -> tuple[Column, Column]:
    """The rating's 95 % interval."""
    return rating - 1.96 * deviation, rating + 1.96 * deviation
