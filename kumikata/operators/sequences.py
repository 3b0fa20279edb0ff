"""Actor-tagged event sequences: transitions, runs, exchanges, revisits, chains, momentum, decision space.

Frames have one row per event with the bout, its order `i`, `label`, `type`, `actor` and the three-valued `ok`, unless said otherwise.
Every window is within a bout, so that nothing crosses from one bout to the next.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import spread

BOUT = "match_id"
PARTICLES = ("da", "das", "de", "del", "di", "do", "dos", "du", "la", "le", "van", "von", "der", "den", "e", "y")

# How much room a move of each type leaves to the acting side and to the other.
DECISION_SPACE = {
    "submission": (0.85, 0.10), "control": (0.80, 0.25), "pass": (0.75, 0.30), "takedown": (0.70, 0.35),
    "sweep": (0.65, 0.40), "transition": (0.60, 0.45), "guard": (0.50, 0.60), "escape": (0.45, 0.70),
}
NEUTRAL, MAJOR = (0.50, 0.50), 0.12


def whole(bout: str = BOUT) -> Window:
    """All events of a bout, in order."""
    return Window.partitionBy(bout).orderBy("i")


def own(bout: str = BOUT) -> Window:
    """The events of one actor in a bout, in order."""
    return Window.partitionBy(bout, "actor").orderBy("i")


def transitions(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """An actor's own consecutive actions: one row per step from `source` to a different `target`; `i` and `i_to` are their places."""
    steps = events.where(F.col("actor").isNotNull()).withColumns({"target": F.lead("label").over(own(bout)), "target_ok": F.lead("ok").over(own(bout)), "target_type": F.lead("type").over(own(bout)), "i_to": F.lead("i").over(own(bout))})
    return steps.where(F.col("target").isNotNull() & (F.col("target") != F.col("label"))).withColumnRenamed("label", "source")


def transition_edges(events: DataFrame, bout: str = BOUT, weight: Column | None = None) -> DataFrame:
    """(source, target, weight, ok): how often actors go from one to the other, and how often that succeeds."""
    w = F.lit(1) if weight is None else weight
    steps = transitions(events, bout).withColumn("w", w)
    return steps.groupBy("source", "target").agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("target_ok") == True, F.col("w")).otherwise(0)).alias("ok"))  # noqa: E712


def transition_nodes(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """(label, type, occ, ok_count, denom, reward, risk, reward_risk) per node of the transition graph.

    Reward: the actor's own next action is a finished submission. Risk: else the very next event is the opponent's. Appearances
    that end a bout are in `occ` but not in `denom`.
    """
    w = whole(bout)
    done = lambda kind, ok: (kind == "submission") & F.coalesce(ok, F.lit(False))
    seen = events.withColumns(
        {
            "own_type": F.when(F.col("actor").isNotNull(), F.lead("type").over(own(bout))), "own_ok": F.when(F.col("actor").isNotNull(), F.lead("ok").over(own(bout))),
            "next_type": F.lead("type").over(w), "next_ok": F.lead("ok").over(w), "next_actor": F.lead("actor").over(w), "followed": F.lead("i").over(w).isNotNull(),
        }
    )
    reward = F.col("followed") & F.coalesce(done(F.col("own_type"), F.col("own_ok")), F.lit(False))
    risk = F.col("followed") & ~reward & F.coalesce(done(F.col("next_type"), F.col("next_ok")) & (F.col("next_actor") != F.col("actor")), F.lit(False))
    count = lambda c: F.sum(c.cast("int"))
    nodes = seen.groupBy("label").agg(F.min("type").alias("type"), F.count("*").alias("occ"), count(F.coalesce(F.col("ok"), F.lit(False))).alias("ok_count"), count(F.col("followed")).alias("denom"), count(reward).alias("reward"), count(risk).alias("risk"))
    return nodes.withColumn("reward_risk", F.coalesce(F.try_divide((F.col("reward") - F.col("risk")).cast("double"), F.col("denom")), F.lit(0.0)))


def reactions(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """(source, target, reaction, n): what the others did between an actor's two consecutive actions.

    The events between are found from each event's own side: those of another actor see the last action before and the next after them of
    each actor of the bout, so the join is by bout and actor, and ranges are between two neighbouring own actions only.
    """
    steps = transitions(events, bout).select(bout, "source", "target", F.explode(F.when(F.col("i_to") - F.col("i") > 1, F.sequence(F.col("i") + 1, F.col("i_to") - 1))).alias("i"))
    return steps.join(events.select(bout, "i", F.col("label").alias("reaction")), [bout, "i"]).groupBy("source", "target", "reaction").agg(F.count("*").alias("n"))


def balanced_edges(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """(source, target, weight): each athlete's edges as shares of the athlete's total, added up, so that nobody counts by volume."""
    each = transitions(events, bout).groupBy("actor", "source", "target").agg(F.count("*").alias("n"))
    shares = each.join(each.groupBy("actor").agg(F.sum("n").alias("total")), "actor")
    return shares.groupBy("source", "target").agg(F.sum(F.col("n") / F.col("total")).alias("weight"), F.count("*").alias("athletes"))


def ngrams(events: DataFrame, n: int, item: str = "label", within: tuple[str, ...] = (BOUT, "actor")) -> DataFrame:
    """(step1 .. stepN, count, share): consecutive items of one sequence; the share is among n-grams with the same first item."""
    w = Window.partitionBy(*within).orderBy("i")
    steps = events.where(F.col("actor").isNotNull()).select(*[F.lead(item, k).over(w).alias(f"step{k + 1}") for k in range(n)]).where(F.col(f"step{n}").isNotNull())
    counts = steps.groupBy(*steps.columns).agg(F.count("*").alias("count"))
    return counts.join(counts.groupBy("step1").agg(F.sum("count").alias("total")), "step1").withColumn("share", F.col("count") / F.col("total")).drop("total")


def runs(events: DataFrame, key: tuple[str, ...] = ("actor",), bout: str = BOUT) -> DataFrame:
    """Maximal stretches of equal `key` in a bout: (bout, run, key..., start, end, length). Nulls are equal to nulls."""
    same = F.lit(True)
    for k in key:
        same = same & F.lag(k).over(whole(bout)).eqNullSafe(F.col(k))
    first = F.row_number().over(whole(bout)) == 1
    cut = events.withColumn("run", F.sum(F.when(same & ~first, 0).otherwise(1)).over(whole(bout)))
    return cut.groupBy(bout, "run", *key).agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length"))


def exchanges(events: DataFrame, gap: float = 120.0, bout: str = BOUT) -> DataFrame:
    """Events of known actors with `exchange`, numbered within the bout: neutral events and pauses of more than `gap` seconds cut.

    A pause is measured between neighbouring timed events; an event without time hides the pause on either side.
    """
    late = F.coalesce(F.col("ts") - F.lag("ts").over(whole(bout)) > gap, F.lit(False))
    told = events.withColumn("neutral", F.col("actor").isNull()).withColumn("cut", late)
    starts = F.lag("neutral").over(whole(bout)).isNull() | F.lag("neutral").over(whole(bout)) | F.col("cut")
    return told.withColumn("exchange", F.sum(F.when(~F.col("neutral") & starts, 1).otherwise(0)).over(whole(bout))).where("NOT neutral").drop("neutral", "cut")


def revisits(split: DataFrame, bout: str = BOUT) -> DataFrame:
    """(label, revisits): returns to a label already seen in the exchange; the same label twice in a row is no return."""
    inside = Window.partitionBy(bout, "exchange").orderBy("i")
    seen = F.row_number().over(Window.partitionBy(bout, "exchange", "label").orderBy("i")) > 1
    return split.withColumn("back", seen & (F.lag("label").over(inside) != F.col("label"))).groupBy("label").agg(F.sum(F.coalesce(F.col("back"), F.lit(False)).cast("int")).alias("revisits")).where("revisits > 0")


def cycle_profile(events: DataFrame, gap: float = 120.0, bout: str = BOUT) -> DataFrame:
    """(actor, runs, mean_run, longest, sustained, events): how long an athlete keeps acting within exchanges."""
    split = exchanges(events, gap, bout)
    inside = Window.partitionBy(bout, "exchange").orderBy("i")
    start = F.coalesce(F.lag("actor").over(inside) != F.col("actor"), F.lit(True))
    numbered = split.withColumn("run", F.sum(start.cast("int")).over(inside))
    each = numbered.groupBy(bout, "exchange", "run", "actor").agg(F.count("*").alias("length"))
    return each.groupBy("actor").agg(F.count("*").alias("runs"), F.avg("length").alias("mean_run"), F.max("length").alias("longest"), F.count_if(F.col("length") >= 2).alias("sustained"), F.sum("length").alias("events"))


def normalize_chain(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """Consecutive identical (type, label) of a bout folded into the first, with `folded`, how many went into it."""
    same = F.lag("type").over(whole(bout)).eqNullSafe(F.col("type")) & F.lag("label").over(whole(bout)).eqNullSafe(F.col("label"))
    cut = events.withColumn("fold", F.sum(F.when(same, 0).otherwise(1)).over(whole(bout)))
    return cut.groupBy(bout, "fold").agg(F.min("i").alias("i"), F.first("type").alias("type"), F.first("label").alias("label"), (F.count("*") - 1).alias("folded")).drop("fold")


def heatmap(events: DataFrame, top: int = 10, bout: str = BOUT) -> DataFrame:
    """(source, target, n) over all pairs of the `top` most frequent labels, zeros filled in."""
    best = events.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top).select("label")
    grid = best.agg(F.collect_list("label").alias("s")).select(F.explode("s").alias("source"), "s").select("source", F.explode("s").alias("target"))
    counts = transitions(events, bout).groupBy("source", "target").agg(F.count("*").alias("n"))
    return grid.join(counts, ["source", "target"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sides(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """Events with `side`: 'a' for the actor seen first in the bout, 'b' for the second; others have none."""
    order = events.where("actor IS NOT NULL").groupBy(bout, "actor").agg(F.min("i").alias("seen")).withColumn("rank", F.row_number().over(Window.partitionBy(bout).orderBy("seen")))
    side = order.where("rank <= 2").select(bout, "actor", F.when(F.col("rank") == 1, "a").otherwise("b").alias("side"))
    return events.join(side, [bout, "actor"], "left")


def _name(text: str) -> tuple[str, str]:
    """First and last word of a name without accents, quoted nicknames, particles and signs; 'last, first' is turned."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", re.sub(r"[\"“(].*?[\"”)]", " ", text.lower())) if not unicodedata.combining(c))
    if "," in plain:
        last, _, first = plain.partition(",")
        plain = f"{first} {last}"
    words = [w for w in re.findall(r"[^\W_]+", plain) if w not in PARTICLES] or [plain]
    return words[0], words[-1]


def _slips(a: str, b: str) -> int:
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def athletes_of(actors: list[str]) -> list[int]:
    """The number of the athlete that each of a bout's spellings names, in the order given.

    Spellings are one athlete's if their last words are at most two slips apart (none below four letters) and their first words agree: an initial, two
    equal first letters, one within the other, or two slips. While more than two athletes are left, those whose last words agree are one, for nicknames.
    """
    near = lambda x, y: x == y or min(len(x), len(y)) >= 4 and _slips(x, y) <= 2
    names = [_name(a) for a in actors]
    group = list(range(len(names)))
    for strict in (True, False):
        for i, (first, last) in enumerate(names):
            for j, (other, family) in enumerate(names[:i]):
                same = near(last, family) and (first[:2] == other[:2] or first[0] == other[0] and 1 in (len(first), len(other)) or min(len(first), len(other)) > 2 and (first in other or other in first) or near(first, other))
                if group[i] != group[j] and (same if strict else near(last, family) and len(set(group)) > 2):
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
    return [sorted(set(group)).index(g) for g in group]


def resolved_sides(events: DataFrame, bout: str = BOUT) -> DataFrame:
    """Events with `side` as in `sides`, but by athlete: a bout's spellings are brought together before the first two are taken.

    A step has a row per bout with its different spellings. An event of a third athlete still has no side; `sideless` tells which.
    """
    seen = events.where("actor IS NOT NULL").groupBy(bout, "actor").agg(F.min("i").alias("seen"))
    listed = seen.groupBy(bout).agg(F.array_sort(F.collect_list(F.struct("seen", "actor"))).alias("a")).select(F.col(bout).alias("bout"), F.transform("a", lambda a: a["actor"]).alias("actors"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [(b, actor, "ab"[k]) for b, actors in frame.itertuples(index=False) for actor, k in zip(actors, athletes_of(list(actors)), strict=True) if k < 2]
            yield pd.DataFrame(told, columns=["bout", "actor", "side"])

    side = listed.mapInPandas(run, "bout string, actor string, side string").withColumnRenamed("bout", bout)
    return events.join(spread(side), [bout, "actor"], "left")


def sideless(tagged: DataFrame, bout: str = BOUT) -> DataFrame:
    """(bout, actor, events): acting events that have no side."""
    return tagged.where("actor IS NOT NULL AND side IS NULL").groupBy(bout, "actor").agg(F.count("*").alias("events"))


def decision_space(tagged: DataFrame, bout: str = BOUT) -> DataFrame:
    """Each sided event with the room of both sides after it and what changed: (…, own, other, reduction, reduces, recovers, turns).

    After a step both sides' room depends on that event alone, so what it was before is the row before it.
    """
    value = lambda at: F.coalesce(*[F.when(F.col("type") == k, F.lit(v[at])) for k, v in DECISION_SPACE.items()], F.lit(NEUTRAL[at]))
    rows = tagged.where("side IS NOT NULL").withColumns({"own": value(0), "other": value(1)})
    a = F.when(F.col("side") == "a", F.col("own")).otherwise(F.col("other"))
    b = F.when(F.col("side") == "a", F.col("other")).otherwise(F.col("own"))
    rows = rows.withColumns({"a": a, "b": b})
    w = whole(bout)
    rows = rows.withColumns({"a0": F.coalesce(F.lag("a").over(w), F.lit(0.5)), "b0": F.coalesce(F.lag("b").over(w), F.lit(0.5)), "lead0": F.signum(F.lag("a").over(w) - F.lag("b").over(w))})
    mine = F.when(F.col("side") == "a", F.col("a0")).otherwise(F.col("b0"))
    theirs = F.when(F.col("side") == "a", F.col("b0")).otherwise(F.col("a0"))
    rows = rows.withColumns({"gain": F.round(F.col("own") - mine, 4), "reduction": F.round(theirs - F.col("other"), 4), "mine0": mine})
    lead = F.signum(F.col("a") - F.col("b"))
    return rows.withColumns({"reduces": F.col("reduction") >= MAJOR, "recovers": (F.col("gain") >= MAJOR) & (F.col("mine0") < 0.5), "turns": F.coalesce((lead != F.col("lead0")) & (lead != 0), F.lit(False))}).drop("a0", "b0", "lead0", "mine0", "a", "b")


def momentum(tagged: DataFrame, value: DataFrame, bout: str = BOUT) -> DataFrame:
    """(bout, i, momentum): the running signed value of the sides' moves, scaled by its peak to 0..1; 0.5 is even."""
    rows = tagged.where("side IS NOT NULL").join(value.select("label", "value"), "label", "left")
    step = F.coalesce(F.col("value"), F.lit(0.0)) * F.when(F.col("side") == "a", 1).otherwise(-1)
    run = rows.withColumn("sum", F.sum(step).over(whole(bout).rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.greatest(F.lit(1e-9), F.max(F.abs("sum")).over(Window.partitionBy(bout)))
    return run.withColumn("momentum", 0.5 + 0.5 * F.col("sum") / peak).select(bout, "i", "momentum")


def countering(spaces: DataFrame) -> DataFrame:
    """(label, flips, occ, rate): how often a move turns the lead, per appearance."""
    return spaces.groupBy("label").agg(F.count_if("turns").alias("flips"), F.count("*").alias("occ")).where("flips > 0").withColumn("rate", F.col("flips") / F.col("occ"))


def smooth(frames: DataFrame, stream: str, order: str, label: str, window: int = 5) -> DataFrame:
    """`smoothed`: the most frequent label among the `window` frames around each; where two or more are, the frame's own."""
    half = window // 2
    around = F.collect_list(label).over(Window.partitionBy(stream).orderBy(order).rowsBetween(-half, half))
    told = frames.withColumn("around", around)
    counts = F.transform(F.array_distinct("around"), lambda x: F.struct(F.size(F.filter("around", lambda y: y == x)).alias("n"), x.alias("label")))
    told = told.withColumn("counts", counts).withColumn("best", F.filter("counts", lambda c: c["n"] == F.array_max(F.transform("counts", lambda d: d["n"]))))
    return told.withColumn("smoothed", F.when(F.size("best") == 1, F.col("best")[0]["label"]).otherwise(F.col(label))).drop("around", "counts", "best")


def segments(frames: DataFrame, stream: str, order: str, label: str, least: int = 1, confidence: str | None = None) -> DataFrame:
    """Runs of equal `label` of at least `least` frames: (stream, segment, label, first, last, frames[, confidence])."""
    w = Window.partitionBy(stream).orderBy(order)
    new = F.coalesce(F.lag(label).over(w) != F.col(label), F.lit(True))
    cut = frames.withColumn("segment", F.sum(new.cast("int")).over(w))
    extra = [F.avg(confidence).alias("confidence")] if confidence else []
    return cut.groupBy(stream, "segment", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("frames"), *extra).where(F.col("frames") >= least)


def flips_per_minute(frames: DataFrame, stream: str, order: str, label: str, seconds: str, unknown: tuple[str, ...] = ("unknown", "none")) -> DataFrame:
    """(stream, flips, per_minute): label changes between neighbouring frames of which neither is unknown, by the stream's span."""
    w = Window.partitionBy(stream).orderBy(order)
    before = F.lag(label).over(w)
    flip = (before != F.col(label)) & ~before.isin(*unknown) & ~F.col(label).isin(*unknown)
    told = frames.withColumn("flip", F.coalesce(flip, F.lit(False)))
    return told.groupBy(stream).agg(F.count_if("flip").alias("flips"), (F.max(seconds) - F.min(seconds)).alias("span")).withColumn("per_minute", F.try_divide(F.col("flips") * 60.0, F.col("span"))).drop("span")


def match_stats(tagged: DataFrame, bout: str = BOUT) -> DataFrame:
    """(bout, side, events, landed, failed, subs, controls, labels): what each side did in a bout."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = tagged.where("side IS NOT NULL").groupBy(bout, "side")
    return rows.agg(F.count("*").alias("events"), F.count_if(ok).alias("landed"), F.count_if(~F.coalesce(F.col("ok"), F.lit(True))).alias("failed"), F.count_if(F.col("type") == "submission").alias("subs"), F.count_if(F.col("type") == "control").alias("controls"), F.count_distinct("label").alias("labels"))


def bout_graph(tagged: DataFrame, bout: str = BOUT) -> DataFrame:
    """(bout, source, target, n, owner): steps between neighbouring events of a bout, whoever acts, and the side that takes most of them; ties to 'a'."""
    w = whole(bout)
    steps = tagged.where("side IS NOT NULL").withColumns({"source": F.lag("label").over(w)}).where(F.col("source").isNotNull() & (F.col("source") != F.col("label")))
    sums = steps.groupBy(bout, "source", F.col("label").alias("target")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "a").alias("_a"))
    return sums.withColumn("owner", F.when(F.col("_a") * 2 >= F.col("n"), "a").otherwise("b")).drop("_a")


def perspective(events: DataFrame, bouts: DataFrame, bout: str = BOUT) -> DataFrame:
    """Every event once per athlete of its bout (bout, athlete, opponent), with `who`: you, opponent or neutral."""
    told = events.join(bouts.select(bout, "athlete", "opponent"), bout)
    return told.withColumn("who", F.when(F.col("actor").isNull(), "neutral").when(F.col("actor") == F.col("athlete"), "you").otherwise("opponent"))


def fold_lines(lines: DataFrame, stream: str, order: str, text: str, start: str, duration: str, most_chars: int = 1100, most_seconds: float = 120.0) -> DataFrame:
    """(stream, segment, text, start, end, lines): lines of a stream put together until one more would be too long or too late.

    Where a segment ends depends on where it began, so lines are clustered by stream, sorted and read in one pass; the open segment is all
    that is held.
    """
    from collections.abc import Iterator

    import pandas as pd

    rows = lines.select(F.col(stream).cast("string").alias("stream"), F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(start).cast("double").alias("start"), F.col(duration).cast("double").alias("duration"))
    rows = rows.where("start IS NOT NULL AND duration IS NOT NULL").repartition("stream").sortWithinPartitions("stream", "o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, kept, size, began, ended = None, 0, [], 0, 0.0, 0.0
        for frame in frames:
            out = []
            for name, _, words, at, lasts in frame.itertuples(index=False):
                full = kept and (size + 1 + len(words) > most_chars or at + lasts - began > most_seconds)
                if kept and (name != now or full):
                    out.append((now, number, " ".join(kept), began, ended, len(kept)))
                    kept, number = [], number + 1
                if name != now:
                    now, number, kept = name, 0, []
                if not kept:
                    began, size = at, -1
                kept.append(words)
                size += 1 + len(words)
                ended = at + lasts
            if out:
                yield pd.DataFrame(out, columns=["stream", "segment", "text", "start", "end", "lines"])
        if kept:
            yield pd.DataFrame([(now, number, " ".join(kept), began, ended, len(kept))], columns=["stream", "segment", "text", "start", "end", "lines"])

    return rows.mapInPandas(run, "stream string, segment int, text string, start double, end double, lines long")
