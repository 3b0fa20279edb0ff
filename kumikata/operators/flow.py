"""Decision flow: what an athlete does, what the opponent answers, and what comes of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.functions.special import beta_quantile
from kumikata.operators import stats
from kumikata.operators.sequences import whole
from kumikata.plans.runtime import cut

# opponents' conditions by the first word found in label and type, in this order.
CONDITIONS = (("choke", "strangle-threat"), ("arm", "arm-threat"), ("foot", "leg-threat"), ("leg", "leg-threat"), ("escape", "escaping"), ("guard", "guard-retained"), ("pass", "passing"), ("sweep", "sweeping"), ("takedown", "standing-attack"), ("submission", "submission-threat"), ("control", "controlling"))


def condition(label: Column, kind: Column) -> Column:
    """What an opponent's event amounts to."""
    text = F.concat_ws(" ", label, kind)
    return F.coalesce(*[F.when(text.contains(w), F.lit(c)) for w, c in CONDITIONS], F.lit("other"))


def bundle(conditions: Column) -> Column:
    """Up to two different conditions of a moment, in their order, as one key."""
    return F.array_join(F.slice(F.array_distinct(conditions), 1, 2), "-and-")


def normal_key(key: Column) -> Column:
    """A composite condition key with its parts in order."""
    return F.array_join(F.array_sort(F.split(key, "-and-")), "-and-")


def chains(events: DataFrame, bout: str = "match_id", opponents: bool = False) -> DataFrame:
    """(bout, actor, position, action, condition, response, success): an athlete's action, the opponent's events until the athlete's next own action, and that action.

    The opponent's events between are those from the next place to the one before the response; they are taken from the bout's events
    by place, so that only neighbouring own actions are spanned. `position` is the athlete's own action before. With `opponents` also who acted first in between.
    """
    w = Window.partitionBy(bout, "actor").orderBy("i")
    own = events.where("actor IS NOT NULL").select(bout, "actor", "i", F.lag("label").over(w).alias("position"), F.col("label").alias("action"), F.lead("label").over(w).alias("response"), F.lead("ok").over(w).alias("success"), F.lead("i").over(w).alias("j")).where("response IS NOT NULL")
    between = own.where("j - i > 1").select(bout, "actor", "i", F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)).alias("k"))
    seen = between.join(events.where("actor IS NOT NULL").select(bout, F.col("i").alias("k"), condition(F.col("label"), F.col("type")).alias("c"), F.col("actor").alias("other")), [bout, "k"])
    told = seen.groupBy(bout, "actor", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cs"), *[F.min_by("other", "k").alias("opponent")] * opponents)
    return own.join(told, [bout, "actor", "i"], "left").select(bout, "actor", "i", "position", "action", F.nullif(normal_key(bundle(F.coalesce("cs", F.array().cast("array<string>")))), F.lit("")).alias("condition"), "response", "success", *["opponent"] * opponents)


def aggregate(patterns: DataFrame, keys: tuple[str, ...] = ("action", "condition", "response"), bout: str = "match_id", evidence: int = 8) -> DataFrame:
    """(keys, n, bouts, resolved, successes, rate, evidence): patterns added up, with the mean of Beta(1 + successes, 1 + failures) and some bouts as evidence.

    Patterns are added up by bout once; the sums and the bouts shown, the least by name, come from that. The bouts of a hot pattern are ranked in
    buckets first, of which each sends on its least alone.
    """
    each = cut(patterns.groupBy(*keys, bout).agg(F.count("*").alias("n"), F.count("success").alias("resolved"), F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("successes")))
    sums = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("bouts"), F.sum("resolved").alias("resolved"), F.sum("successes").alias("successes"))
    least = lambda frame, *by: frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *by).orderBy(bout))).where(F.col("_r") <= evidence).drop("_r")
    some = least(least(each.select(*keys, bout).withColumn("_b", F.pmod(F.xxhash64(bout), F.lit(32))), "_b")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(bout)), ",").alias("evidence"))
    same = [sums[k].eqNullSafe(some[k]) for k in keys]
    joined = sums.join(some, same).select(*[sums[k] for k in keys], "n", "bouts", "resolved", "successes", "evidence")
    return joined.withColumn("rate", (F.col("successes") + 1.0) / (F.col("resolved") + 2.0))


def windows(events: DataFrame, span: int = 3, bout: str = "match_id") -> DataFrame:
    """(bout, actor, position, action, conditions, response, success): the window machine, one pass per bout in order.

    An own action opens a window; opponents' events within `span` places become its conditions; the next own action is the response and opens the next
    window. A neutral event closes all. Bouts are clustered and streamed, one bout's open windows are the only state.
    """
    rows = events.select(bout, "i", "actor", "label", condition(F.col("label"), F.col("type")).alias("c"), "ok").repartition(bout).sortWithinPartitions(bout, "i")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_, last = None, {}, {}
        for frame in frames:
            out = []
            for match, i, actor, label, c, ok in frame.itertuples(index=False):
                if match != now:
                    now, open_, last = match, {}, {}
                if actor is None or actor != actor:  # noqa: PLR0124
                    open_, last = {}, {}
                    continue
                for other, window in open_.items():
                    if other != actor and i - window[0] <= span and c not in window[3] and len(window[3]) < 2:
                        window[3].append(c)
                if window := open_.get(actor):
                    out.append((match, actor, window[1], window[2], "-and-".join(sorted(window[3])) or None, label, None if ok is None else bool(ok)))
                open_[actor] = [i, last.get(actor), label, []]
                last[actor] = label
            if out:
                yield pd.DataFrame(out, columns=["match_id", "actor", "position", "action", "condition", "response", "success"])

    return rows.mapInPandas(run, "match_id string, actor string, position string, action string, condition string, response string, success boolean").withColumnRenamed("match_id", bout)


def criteria(patterns: DataFrame, bout: str = "match_id", permutations: int = 1000, resamples: int = 500, seed: int = 20260810, context_n: int = 8, triad_n: int = 3, triad_bouts: int = 2, triad_opponents: int = 2, rate: float = 0.10, stable: float = 0.70) -> DataFrame:
    """(position, action, condition, response, n_with, n_condition, n_without, n_no_condition, p_with, p_without, effect, effect_lo, effect_hi, lift, p, q, stability, bouts, success_rate, blocked, survives): which conditions decide the response.

    `patterns` are `chains` with opponents. A context is a position with an action; no condition is a value of its own, the contrast, not a criterion.
    Per triad: the chance of the response with the condition less that without it (means of Beta(1 + k, 1 + n - k)), its worst and best case from both
    central 95 % intervals, p from conditions shuffled within bouts (the bouts with one chain shuffle together), and the share of resamples of whole bouts that
    have the triad with a positive effect. Triads below the floors are not tested. One false-discovery control over all triads; what survives has
    effect_lo > 0, q <= `rate` and stability >= `stable`. Shuffling keeps all margins, so that an effect is reached where the triad's count is.
    Only contexts with enough chains and a triad seen often enough go to a task, each as a whole.
    """
    context = ["position", "action"]
    told = patterns.where("response IS NOT NULL").select(F.coalesce("position", F.lit("-")).alias("position"), "action", F.coalesce("condition", F.lit("")).alias("condition"), "response", F.col(bout).alias("bout"), "actor", "i", "success", "opponent")
    # by windows over one clustering by context, so that the chains are made once; bouts and opponents are counted where the context is whole
    of, triad = Window.partitionBy(*context), Window.partitionBy(*context, "condition", "response")
    sized = told.withColumns({"_n": F.count("*").over(of), "_t": F.when(F.col("condition") != "", F.count("*").over(triad))}).withColumn("_most", F.max("_t").over(of))
    rows = sized.where((F.col("_n") >= context_n) & (F.col("_most") >= triad_n) & (F.col("_most") < F.col("_n"))).drop("_n", "_t", "_most")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bout", "i", "actor"])
        (c, conditions), (r, responses), (m, bouts) = (pd.factorize(pdf[x], sort=True) for x in ("condition", "response", "bout"))
        table = np.zeros((len(conditions), len(responses)), dtype="int64")
        np.add.at(table, (c, r), 1)
        cells = []
        for (x, y), own in pdf.assign(c=c, r=r)[table[c, r] >= triad_n].groupby(["c", "r"]):
            opponents = own["opponent"].dropna().nunique()
            if conditions[x] and own["bout"].nunique() >= triad_bouts and (not opponents or opponents >= triad_opponents):
                known = own["success"].dropna().astype(bool)
                cells.append((x, y, own["bout"].nunique(), float(known.mean()) if len(known) else None))
        if not cells or len(conditions) < 2:
            return pd.DataFrame(columns=names)
        cx, cy = (np.array([cell[k] for cell in cells]) for k in (0, 1))
        seen, rng, n = table[cx, cy], np.random.default_rng(seed), len(pdf)

        size = np.bincount(m)
        block = np.where(size[m] >= 2, m, len(bouts))
        by_block = np.argsort(block, kind="stable")
        block, cond, resp = block[by_block], c[by_block], r[by_block]
        reached, chunk = np.zeros(len(cells)), max(1, 1_000_000 // n)
        for begin in range(0, permutations, chunk):
            take = min(chunk, permutations - begin)
            shuffled = cond[np.argsort(block + rng.random((take, n)), axis=1)]
            for k in range(len(cells)):
                reached[k] += ((shuffled[:, resp == cy[k]] == cx[k]).sum(1) >= seen[k]).sum()

        per_bout = lambda at, width, keep: np.bincount(m[keep] * width + at[keep], minlength=len(bouts) * width).reshape(len(bouts), width)
        number = {(x, y): k for k, (x, y) in enumerate(zip(cx, cy, strict=True))}
        cell = np.array([number.get(pair, -1) for pair in zip(c, r, strict=True)])
        with_b, cond_b, resp_b = per_bout(cell, len(cells), cell >= 0), per_bout(c, len(conditions), cell > -2), per_bout(r, len(responses), cell > -2)
        cond_b, resp_b = cond_b[:, cx], resp_b[:, cy]
        kept = np.zeros(len(cells))
        for begin in range(0, resamples, 100):
            take = min(100, resamples - begin)
            pick = rng.integers(0, len(bouts), (take, len(bouts)))
            times = np.bincount((pick + np.arange(take)[:, None] * len(bouts)).ravel(), minlength=take * len(bouts)).reshape(take, len(bouts)).astype("float64")
            w, nc, nr, total = times @ with_b, times @ cond_b, times @ resp_b, (times @ size)[:, None]
            kept += (((w + 1) / (nc + 2) - (nr - w + 1) / (total - nc + 2) > 0) & (w > 0)).sum(0)

        out = []
        for k, (x, y, in_bouts, success) in enumerate(cells):
            w, nc = int(table[x, y]), int(table[x].sum())
            wo, no = int(table[:, y].sum()) - w, n - nc
            pw, po = (w + 1) / (nc + 2), (wo + 1) / (no + 2)
            (low_w, high_w), (low_o, high_o) = ([beta_quantile(z, a + 1, b - a + 1) for z in (0.025, 0.975)] for a, b in ((w, nc), (wo, no)))
            out.append((*key, conditions[x], responses[y], w, nc, wo, no, pw, po, pw - po, low_w - high_o, high_w - low_o, pw / po, (reached[k] + 1) / (permutations + 1), kept[k] / resamples, in_bouts, success, bool((size >= 2).any())))
        return pd.DataFrame(out, columns=names)

    schema = "position string, action string, condition string, response string, n_with long, n_condition long, n_without long, n_no_condition long, p_with double, p_without double, effect double, effect_lo double, effect_hi double, lift double, p double, stability double, bouts long, success_rate double, blocked boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    tests = rows.groupBy(*context).applyInPandas(solve, schema).withColumn("_id", F.concat_ws("|", *context, "condition", "response"))
    q = stats.benjamini_hochberg(cut(tests), "p", "_id").drop("_id")
    return q.withColumn("survives", (F.col("effect_lo") > 0) & (F.col("q") <= rate) & (F.col("stability") >= stable))


def tree(aggregated: DataFrame, branches: int = 3, answers: int = 2) -> DataFrame:
    """(action, condition, response, branch, answer, n): of each action the most frequent conditions, of each of those the most frequent responses."""
    known = aggregated.where("condition IS NOT NULL")
    first = known.groupBy("action", "condition").agg(F.sum("n").alias("cn")).withColumn("branch", F.row_number().over(Window.partitionBy("action").orderBy(F.desc("cn"), "condition"))).where(F.col("branch") <= branches)
    ranked = known.join(first, ["action", "condition"]).withColumn("answer", F.row_number().over(Window.partitionBy("action", "condition").orderBy(F.desc("n"), "response"))).where(F.col("answer") <= answers)
    return ranked.select("action", "condition", "response", "branch", "answer", "n")


def positions(events: DataFrame, bout: str = "match_id") -> DataFrame:
    """Events with `held`, the last control or guard of the bout before or at each."""
    return events.withColumn("held", F.last(F.when(F.col("type").isin("control", "guard"), F.col("label")), ignorenulls=True).over(whole(bout).rowsBetween(Window.unboundedPreceding, 0)))
