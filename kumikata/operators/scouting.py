"""Scouting facts of athletes: actions, openings, sections with graded tendencies, answers to an opponent, layers of a bracket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.functions.keys import grade
from kumikata.operators import stats

# The labels of a control that count as mount and as back.
MOUNTS, BACKS = ("mount", "threequarter mount", "smount", "technical mount"), ("back control", "body triangle", "seatbelt control", "hooks in", "back take")
# Words that put a control or transition into a section.
STANDING = ("arm drag", "body lock", "bodylock", "collar tie", "clinch", "front headlock", "grip", "mercy", "overhook", "snap down", "two on one", "underhook", "wrist control", "2 on 1")
PASSING = ("headquarters", "knee cut", "passing", "pressure pass", "split squat")
# Two pulls so many seconds apart are one.
PULL_SECONDS = 15


def action(kind: Column, label: Column) -> Column:
    """The sheet's action for an event, null beside the seven that it counts."""
    named = {"submission": "finish", "sweep": "sweep", "pass": "pass", "takedown": "takedown"}
    held = (kind == "control") & label.isin(*MOUNTS)
    back = (kind == "control") & label.isin(*BACKS)
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in named.items()], F.when(held, "mount"), F.when(back, "back"))


def openings(events: DataFrame, pull: Column, bout: str = "match_id", seconds: float = PULL_SECONDS) -> DataFrame:
    """(bout, agent, opening): how a bout left the feet: a double pull, a pull or a takedown that did not fail; bouts that show none have no row.

    Two pulls of different athletes within `seconds` are a double pull of 'both'. If any two are that near, two neighbouring ones are. An unknown time counts as 0.
    """
    down = (F.col("type") == "takedown") & F.coalesce(F.col("ok"), F.lit(True))
    kind = F.when(pull, 0).when(down, 1)
    told = events.where("actor IS NOT NULL").select(bout, "actor", F.coalesce("ts", F.lit(0.0)).alias("ts"), kind.alias("kind")).where("kind IS NOT NULL")
    w = Window.partitionBy(bout, "kind").orderBy("ts", "actor")
    double = (F.col("kind") == 0) & (F.lag("actor").over(w) != F.col("actor")) & (F.col("ts") - F.lag("ts").over(w) <= seconds)
    first = told.withColumn("double", F.coalesce(double, F.lit(False))).groupBy(bout).agg(F.bool_or("double").alias("double"), F.min(F.struct("ts", "kind", "actor")).alias("f"))
    return first.select(bout, F.when(F.col("double"), "both").otherwise(F.col("f.actor")).alias("agent"), F.when(F.col("double"), "double pull").when(F.col("f.kind") == 0, "pull").otherwise("takedown").alias("opening"))


def result_for(athlete: Column, winner: Column, a: Column, b: Column) -> Column:
    """won, lost or no result; a winner who is neither of the two is nobody's defeat."""
    return F.when(winner.isNull() | ~(winner.eqNullSafe(a) | winner.eqNullSafe(b)), "no result").when(winner == athlete, "won").otherwise("lost")


def points_by_event(events: DataFrame, scores: DataFrame, bout: str = "match_id") -> DataFrame:
    """Events with `points` of the official score (bout, actor, ts, points, order) of the same actor at exactly the same second; the last entry counts."""
    last = scores.where("actor IS NOT NULL AND ts IS NOT NULL AND points IS NOT NULL").groupBy(bout, "actor", "ts").agg(F.max_by("points", "order").alias("points"))
    return events.join(last, [bout, "actor", "ts"], "left")


def complete_scores(bouts: DataFrame, scores: DataFrame, bout: str = "match_id") -> DataFrame:
    """(bout, complete): whether a bout's official score (duration, a, b, score_a, score_b) is the sum of its valid entries, none of them invalid."""
    side = F.when(F.col("actor") == F.col("a"), 0).when(F.col("actor") == F.col("b"), 1)
    told = bouts.join(scores.select(bout, "actor", "ts", "points", F.lit(True).alias("entry")), bout, "left")
    valid = side.isNotNull() & (F.col("points") >= 0) & F.col("ts").between(0, F.col("duration"))
    sums = told.groupBy(bout, "duration", "a", "b", "score_a", "score_b").agg(
        F.count("entry").alias("n"), F.count_if(F.col("entry") & ~F.coalesce(valid, F.lit(False))).alias("bad"), *[F.sum(F.when(side == i, F.col("points")).otherwise(0)).alias(f"sum_{x}") for i, x in enumerate("ab")],
    )
    ok = (F.col("duration") > 0) & (F.col("a") != F.col("b")) & (F.col("n") > 0) & (F.col("bad") == 0) & (F.col("score_a") == F.col("sum_a")) & (F.col("score_b") == F.col("sum_b")) & (F.col("score_a") >= 0) & (F.col("score_b") >= 0)
    return sums.select(bout, F.coalesce(ok, F.lit(False)).alias("complete"))


def valid_overtime(start: Column, duration: Column) -> Column:
    """Whether an overtime begins within its bout; a bout of unknown length bounds nothing."""
    return F.coalesce((start >= 0) & (duration.isNull() | ((duration > 0) & (start <= duration))), F.lit(False))


def sections(kind: Column, label: Column) -> Column:
    """The sections of a report that an event belongs to, none or several."""
    loose = kind.isin("control", "transition")
    has = lambda words: F.coalesce(*[F.when(label.contains(w), F.lit(True)) for w in words], F.lit(False))
    tests = (("standing", (kind == "takedown") | loose & has(STANDING)), ("guard", kind == "guard"), ("passing", (kind == "pass") | loose & has(PASSING)), ("back_and_finishing", (kind == "submission") | loose & label.contains("back")))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def tendencies(events: DataFrame, who: str = "actor", bout: str = "match_id") -> DataFrame:
    """(who, section, label, count, bouts, known, ok, grade, rate_grade): what an athlete does in each section, how often it works, and how well either is supported."""
    told = events.where(F.col(who).isNotNull()).withColumn("section", F.explode(sections(F.col("type"), F.col("label"))))
    sums = told.groupBy(who, "section", "label").agg(F.count("*").alias("count"), F.count_distinct(bout).alias("bouts"), F.count("ok").alias("known"), F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("ok"), F.count_distinct(F.when(F.col("ok").isNotNull(), F.col(bout))).alias("_known_bouts"))
    return sums.withColumns({"grade": grade(F.col("count"), F.col("bouts")), "rate_grade": grade(F.col("known"), F.col("_known_bouts"))}).drop("_known_bouts")


def weakest(*grades: Column) -> Column:
    """The weakest of several grades; null if one is missing."""
    rank = lambda g: F.when(g == "limited", 0).when(g == "sustained", 1).when(g == "strong", 2)
    least = F.when(F.array_size(F.array_compact(F.array(*map(rank, grades)))) == len(grades), F.array_min(F.array(*map(rank, grades))))
    return F.get(F.array(*map(F.lit, ("limited", "sustained", "strong"))), least)


def section_summary(facts: DataFrame, events: DataFrame, who: str = "actor", bout: str = "match_id", least_bouts: int = 3) -> DataFrame:
    """(who, section, bouts, events, labels, predominant, share, absent) for every section of every athlete of `least_bouts` bouts or more.

    `predominant` is the most frequent graded label with its `share` of the section; `absent` a section without an event.
    """
    names = F.explode(F.array(*[F.lit(s) for s in ("standing", "guard", "passing", "back_and_finishing")])).alias("section")
    people = events.where(F.col(who).isNotNull()).groupBy(who).agg(F.count_distinct(bout).alias("bouts")).where(F.col("bouts") >= least_bouts).select(who, "bouts", names)
    sums = facts.groupBy(who, "section").agg(F.sum("count").alias("events"), F.count("*").alias("labels"), F.min(F.when(F.col("grade").isNotNull(), F.struct((-F.col("count")).alias("minus"), "label"))).alias("top"))
    told = people.join(sums, [who, "section"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return told.select(who, "section", "bouts", zero("events").alias("events"), zero("labels").alias("labels"), F.col("top.label").alias("predominant"), (-F.col("top.minus") / F.col("events")).alias("share"), F.col("events").isNull().alias("absent"))


def matchup(facts: DataFrame, answers: DataFrame, pairs: DataFrame, top: int = 3) -> DataFrame:
    """(athlete, opponent, threat, threat_count, threat_grade, answer, answer_count, kind): an opponent's graded tendencies with the athlete's own documented answer.

    `facts` as `tendencies` gives with `actor`; `answers` (actor, label, answer, n, bouts): what someone does next after an opponent's label; `pairs` (athlete, opponent).
    The `top` tendencies of an opponent are shown; `kind` is 'documented' or 'gap'.
    """
    ranked = facts.where("grade IS NOT NULL").groupBy("actor", "label").agg(F.max("count").alias("threat_count"), F.max_by("grade", "count").alias("threat_grade"))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("actor").orderBy(F.desc("threat_count"), "label"))).where(F.col("_r") <= top)
    threats = pairs.join(ranked.select(F.col("actor").alias("opponent"), F.col("label").alias("threat"), "threat_count", "threat_grade"), "opponent")
    best = answers.groupBy("actor", "label").agg(F.min(F.struct((-F.col("n")).alias("minus"), "answer")).alias("b")).select(F.col("actor").alias("athlete"), F.col("label").alias("threat"), F.col("b.answer").alias("answer"), (-F.col("b.minus")).alias("answer_count"))
    told = threats.join(best, ["athlete", "threat"], "left")
    return told.select("athlete", "opponent", "threat", "threat_count", "threat_grade", "answer", "answer_count", F.when(F.col("answer").isNull(), "gap").otherwise("documented").alias("kind"))


def answers_to(events: DataFrame, bout: str = "match_id") -> DataFrame:
    """(actor, label, answer, n, bouts): the next event of a bout after someone else's `label`, by who made it."""
    w = Window.partitionBy(bout).orderBy("i")
    told = events.where("actor IS NOT NULL").withColumns({"_before": F.lag("label").over(w), "_by": F.lag("actor").over(w)}).where("_by <> actor")
    return told.groupBy("actor", F.col("_before").alias("label"), F.col("label").alias("answer")).agg(F.count("*").alias("n"), F.count_distinct(bout).alias("bouts"))


def node_rows(attributed: DataFrame, group: list[str], top: int = 12) -> DataFrame:
    """(group, category, label, role, k, share): the most frequent (label, role) of each category; a role that cannot be used is 'unknown'."""
    sums = attributed.groupBy(*group, "category", "label", F.col("subject_role").alias("role")).agg(F.count("*").alias("k"))
    of = Window.partitionBy(*group, "category")
    told = sums.withColumns({"share": F.col("k") / F.sum("k").over(of), "_r": F.row_number().over(of.orderBy(F.desc("k"), "label", "role"))})
    return told.where(F.col("_r") <= top).drop("_r")


def gated_rate(frame: DataFrame, group: list[str], who: str, k: str, n: str) -> DataFrame:
    """(group, k, n, p, lo, hi, clusters, effective, estimable): a rate with its Wilson interval, estimable only if enough people bear it (five, of an effective two)."""
    per = frame.groupBy(*group, who).agg(F.sum(k).alias("_k"), F.sum(n).alias("_n"))
    sums = per.groupBy(*group).agg(F.sum("_k").alias("k"), F.sum("_n").alias("n"), F.count_if(F.col("_n") > 0).alias("clusters"), F.try_divide(F.sum("_n") ** 2, F.sum(F.col("_n") ** 2)).alias("effective"))
    told = sums.withColumns({c: e for c, e in stats.wilson(F.col("k"), F.col("n")).items() if c in ("p", "lo", "hi")})
    return told.withColumn("estimable", F.coalesce((F.col("clusters") >= 5) & (F.col("effective") >= 2), F.lit(False)))


def recency(rates: DataFrame, group: list[str]) -> DataFrame:
    """(group, estimable_windows, stable): whether the intervals of all estimable windows (`gated_rate` by group and window) overlap each other; null with fewer than two.

    All pairs of intervals overlap if the highest low end is not above the lowest high end.
    """
    told = rates.groupBy(*group).agg(F.count_if("estimable").alias("estimable_windows"), F.max(F.when(F.col("estimable"), F.col("lo"))).alias("_lo"), F.min(F.when(F.col("estimable"), F.col("hi"))).alias("_hi"))
    return told.withColumn("stable", F.when(F.col("estimable_windows") > 1, F.col("_lo") <= F.col("_hi"))).drop("_lo", "_hi")


def beside_baseline(inside: DataFrame, outside: DataFrame, item: str) -> DataFrame:
    """(item, k1, n1, k2, n2, diff, diff_lo, diff_hi, p, q): the share of each item in a category against a pool without it, with false-discovery control over the items."""
    one = F.lit(0).alias("one")
    totals = F.broadcast(inside.agg(F.count("*").alias("n1")).select(one, "n1").join(outside.agg(F.count("*").alias("n2")).select(one, "n2"), "one"))
    mine = inside.groupBy(item).agg(F.count("*").alias("k1")).join(outside.groupBy(item).agg(F.count("*").alias("k2")), item, "left")
    both = mine.select(one, item, "k1", F.coalesce("k2", F.lit(0)).alias("k2")).join(totals, "one").drop("one")
    told = both.withColumns({c: e for c, e in stats.contrast(*map(F.col, ("k1", "n1", "k2", "n2"))).items() if c in ("diff", "diff_lo", "diff_hi")})
    return stats.benjamini_hochberg(told.withColumn("p", stats.contrast_p("k1", "n1", "k2", "n2")), "p", item)


def two_arms(won: DataFrame, lost: DataFrame, group: list[str], who: str, hit: Column) -> DataFrame:
    """(group, applied, of_wins, conceded, of_losses, diff, diff_lo, diff_hi, available, blocked): what is conceded against what is applied, refused where either arm rests on too few people."""
    def arm(frame: DataFrame, tag: str) -> DataFrame:
        told = gated_rate(frame.withColumns({"_hit": hit.cast("int"), "_one": F.lit(1)}), group, who, "_hit", "_one")
        return told.select(*group, F.col("k").alias(f"k_{tag}"), F.col("n").alias(f"n_{tag}"), F.col("estimable").alias(f"ok_{tag}"))

    both = arm(won, "w").join(arm(lost, "l"), group, "full_outer").na.fill(0, [f"{c}_{x}" for c in "kn" for x in "wl"]).na.fill(False, ["ok_w", "ok_l"])
    blocked = F.array_join(F.array_compact(F.array(F.when(~F.col("ok_w"), "win"), F.when(~F.col("ok_l"), "loss"))), ",")
    told = both.withColumns({"available": F.col("ok_w") & F.col("ok_l"), "blocked": blocked, **{c: e for c, e in stats.contrast(*map(F.col, ("k_l", "n_l", "k_w", "n_w"))).items() if c in ("diff", "diff_lo", "diff_hi")}})
    shown = lambda c: F.when(F.col("available"), F.col(c)).alias(c)
    return told.select(*group, F.col("k_w").alias("applied"), F.col("n_w").alias("of_wins"), F.col("k_l").alias("conceded"), F.col("n_l").alias("of_losses"), *map(shown, ("diff", "diff_lo", "diff_hi")), "available", "blocked")
