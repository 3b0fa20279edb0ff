"""Graphs of transitions: centralities, value iteration, forks, routes, communities, closures.

Nodes and edges are DataFrames: nodes (label, type, occ, ok_count, denom, reward, risk, reward_risk), edges (source, target, weight, ok). Fixed points
run as joins and sums; a graph of at most SMALL edges, which is counted, is solved in one task instead. Transition graphs grow
with the vocabulary, not with the events.
"""

from __future__ import annotations

import itertools
import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.operators.sequences import DECISION_SPACE, NEUTRAL
from kumikata.plans.runtime import cut, spread

#: Edges up to which one task solves a fixed point.
SMALL = 200_000
GAMMA, FORK = 0.8, 0.15

# Points of a move by the first word found in its label and type, in this order.
POINTS = (("takedown", 2), ("sweep", 2), ("pass", 3), ("mount", 4), ("back", 4), ("knee on belly", 2), ("kob", 2))


def in_one_task(frames: tuple[DataFrame, ...], names: tuple[str, ...], solve: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Run `solve` on whole small frames, given by name, in one executor task."""
    tagged = None
    for name, frame in zip(names, frames, strict=True):
        packed = frame.select(F.lit(name).alias("frame"), F.to_json(F.struct(*frame.columns)).alias("row"))
        tagged = packed if tagged is None else tagged.unionByName(packed)
    columns = {name: frame.columns for name, frame in zip(names, frames, strict=True)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        out = {name: pd.DataFrame([json.loads(r) for r in pdf.loc[pdf["frame"] == name, "row"]], columns=columns[name]) for name in names}
        return solve(**out)

    return tagged.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: run(pdf), schema)


def is_small(edges: DataFrame) -> bool:
    """Whether a graph may be solved in one task."""
    return edges.limit(SMALL + 1).count() <= SMALL


# degrees and links


def strengths(edges: DataFrame) -> DataFrame:
    """(label, in_weight, out_weight, in_degree, out_degree)."""
    sides = edges.select(F.col("source").alias("label"), F.lit(0).alias("wi"), F.col("weight").alias("wo"), F.lit(0).alias("di"), F.lit(1).alias("do")).unionByName(edges.select(F.col("target").alias("label"), F.col("weight").alias("wi"), F.lit(0).alias("wo"), F.lit(1).alias("di"), F.lit(0).alias("do")))
    return sides.groupBy("label").agg(F.sum("wi").alias("in_weight"), F.sum("wo").alias("out_weight"), F.sum("di").alias("in_degree"), F.sum("do").alias("out_degree"))


def pair_links(edges: DataFrame, least: int = 2, two_way: float = 0.34) -> DataFrame:
    """(a, b, forward, backward, arrow): one row per unordered pair; an arrow only where one way is frequent and the other is not."""
    first = F.col("source") < F.col("target")
    pairs = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(F.when(first, F.col("weight")).otherwise(0)).alias("forward"), F.sum(F.when(first, 0).otherwise(F.col("weight"))).alias("backward"))
    low, high = F.least("forward", "backward"), F.greatest("forward", "backward")
    return pairs.withColumn("arrow", (high >= least) & ~((low >= least) & (low >= two_way * high)))


def dashed(edges: DataFrame, nodes: DataFrame, least: int = 5, most: float = 0.40, gated: tuple[str, ...] = ("submission", "takedown", "sweep", "pass", "escape")) -> DataFrame:
    """Edges with `dashed`: seen often enough, into a type that can fail, and mostly failing."""
    typed = edges.join(nodes.select(F.col("label").alias("target"), F.col("type").alias("target_type")), "target", "left")
    return typed.withColumn("dashed", (F.col("weight") >= least) & F.col("target_type").isin(*gated) & (F.col("ok") / F.col("weight") < most)).drop("target_type")


def kernel(edges: DataFrame) -> DataFrame:
    """Edges with `p`, their share of the source's weight."""
    return edges.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("source")))


# fixed points


def weighted_pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tradeoff: float = 0.5, tolerance: float = 1e-8, small: bool | None = None) -> DataFrame:
    """(label, rank): power iteration over a blend of weight shares and equal shares; nodes without a way out spread evenly."""
    w = Window.partitionBy("source")
    shares = edges.select("source", "target", (tradeoff * F.col("weight") / F.sum("weight").over(w) + (1 - tradeoff) / F.count("*").over(w)).alias("p"))
    if is_small(edges) if small is None else small:

        def solve(nodes: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
            at = {x: i for i, x in enumerate(sorted(nodes["label"]))}
            s, t, p, n = shares["source"].map(at).to_numpy(int), shares["target"].map(at).to_numpy(int), shares["p"].to_numpy(float), len(at)
            sink = np.ones(n, bool)
            sink[s] = False
            rank = np.full(n, 1 / n)
            for _ in range(rounds):
                new = alpha * (np.bincount(t, p * rank[s], n) + rank[sink].sum() / n) + (1 - alpha) / n
                if (moved := np.abs(new - rank).sum()) < tolerance:
                    rank = new
                    break
                rank = new
            del moved
            return pd.DataFrame({"label": list(at), "rank": rank})

        return in_one_task((nodes.select("label"), shares), ("nodes", "shares"), solve, "label string, rank double")
    nodes = cut(nodes.select("label"))
    shares = cut(shares)
    n = nodes.count()
    sinks = cut(nodes.join(shares.select(F.col("source").alias("label")).distinct(), "label", "left_anti").withColumn("sink", F.lit(True)))
    rank = cut(nodes.join(sinks, "label", "left").select("label", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / max(1, n)).alias("rank")))
    for _ in range(rounds):
        lost = rank.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        into = shares.join(rank.select(F.col("label").alias("source"), "rank"), "source").groupBy(F.col("target").alias("label")).agg(F.sum(F.col("p") * F.col("rank")).alias("into"))
        new = cut(rank.join(into, "label", "left").withColumn("new", alpha * (F.coalesce("into", F.lit(0.0)) + lost / n) + (1 - alpha) / n))
        moved = new.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("rank"))), F.lit(0.0))).first()[0]
        rank = new.select("label", "sink", F.col("new").alias("rank"))
        if moved < tolerance:
            break
    return rank.select("label", "rank")


def shaping(label: Column, kind: Column) -> Column:
    """A small prior value of a position from its points and from the room that its type gives."""
    text = F.concat_ws(" ", label, kind)
    points = F.coalesce(*[F.when(text.contains(word), F.lit(float(n))) for word, n in POINTS], F.lit(0.0))
    room = F.coalesce(*[F.when(kind == k, F.lit(a - b)) for k, (a, b) in DECISION_SPACE.items()], F.lit(NEUTRAL[0] - NEUTRAL[1]))
    return 0.1 * points / 4.0 + 0.1 * room


def victory_terms(nodes: DataFrame) -> DataFrame:
    """(label, base, stay, risk_rate): what a node is worth at once, and how likely the way goes on from it."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    end = F.when(F.col("type") == "submission", rate("ok_count", "occ")).otherwise(0.0)
    told = nodes.withColumns({"r": rate("reward", "denom"), "k": rate("risk", "denom"), "t": end})
    return told.select("label", (shaping(F.col("label"), F.col("type")) + F.col("r") + F.col("t") - F.col("k")).alias("base"), F.greatest(F.lit(0.0), 1 - F.col("r") - F.col("k") - F.col("t")).alias("stay"), F.col("k").alias("risk_rate"))


def path_to_victory(nodes: DataFrame, edges: DataFrame, rounds: int = 200, gamma: float = GAMMA, tolerance: float = 1e-6, small: bool | None = None) -> DataFrame:
    """(label, value): value iteration in [-1, 1], all nodes at once from the round before."""
    terms, ways = victory_terms(nodes), kernel(edges).select("source", "target", "p")
    if is_small(edges) if small is None else small:

        def solve(terms: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
            at = {x: i for i, x in enumerate(terms["label"])}
            s, t, p = ways["source"].map(at).to_numpy(int), ways["target"].map(at).to_numpy(int), ways["p"].to_numpy(float)
            base, stay, value = terms["base"].to_numpy(float), terms["stay"].to_numpy(float), np.zeros(len(at))
            for _ in range(rounds):
                new = np.clip(base + gamma * stay * np.bincount(s, p * value[t], len(at)), -1, 1)
                done = np.abs(new - value).max(initial=0) < tolerance
                value = new
                if done:
                    break
            return pd.DataFrame({"label": list(at), "value": value})

        return in_one_task((terms, ways), ("terms", "ways"), solve, "label string, value double")
    terms, ways = cut(terms), cut(ways)
    state = terms.withColumn("value", F.lit(0.0))
    for _ in range(rounds):
        ahead = ways.join(state.select(F.col("label").alias("target"), "value"), "target").groupBy(F.col("source").alias("label")).agg(F.sum(F.col("p") * F.col("value")).alias("ahead"))
        new = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("base") + gamma * F.col("stay") * F.coalesce("ahead", F.lit(0.0))))
        told = cut(state.join(ahead, "label", "left").withColumn("new", new))
        moved = told.agg(F.coalesce(F.max(F.abs(F.col("new") - F.col("value"))), F.lit(0.0))).first()[0]
        state = told.select("label", "base", "stay", F.col("new").alias("value"))
        if moved < tolerance:
            break
    return state.select("label", "value")


# what follows from the values


def edge_value(edges: DataFrame, value: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Edges with `edge_value`, the discounted value of where they lead."""
    return edges.join(value.select(F.col("label").alias("target"), F.round(gamma * F.round("value", 4), 4).alias("edge_value")), "target")


def continuity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, continuity): how safely an athlete's own chain goes on from here, one step ahead."""
    risk = victory_terms(nodes).select("label", "risk_rate")
    ahead = kernel(edges).join(risk.select(F.col("label").alias("target"), F.col("risk_rate").alias("then")), "target").groupBy(F.col("source").alias("label")).agg(F.sum(F.col("p") * (1 - F.col("then"))).alias("safe"))
    return risk.join(ahead, "label", "left").select("label", ((1 - F.col("risk_rate")) * F.coalesce("safe", F.lit(0.0))).alias("continuity"))


def decision_funnel(edges: DataFrame, value: DataFrame, threshold: float = FORK) -> DataFrame:
    """(label, funnel): the share of what leaves a node that goes through branches worth taking."""
    return edge_value(kernel(edges), value).groupBy(F.col("source").alias("label")).agg(F.sum(F.when(F.col("edge_value") >= threshold, F.col("p")).otherwise(0.0)).alias("funnel"))


def control_score(edges: DataFrame, value: DataFrame) -> DataFrame:
    """(label, control): mean less population deviation of the values of a node's ways out."""
    return edge_value(edges, value).groupBy(F.col("source").alias("label")).agg((F.avg("edge_value") - F.stddev_pop("edge_value")).alias("control"))


def node_deviance(nodes: DataFrame, value: DataFrame, scale: float = 200.0, clamp: int = 150) -> DataFrame:
    """(label, deviance): a rating offset from the value, centred by occurrences. The mean is one row, joined by a constant."""
    told = nodes.select("label", "occ").join(value.select("label", F.round("value", 4).alias("value")), "label")
    mean = told.agg(F.sum(F.col("value") * F.col("occ")).alias("s"), F.sum("occ").alias("n")).select(F.lit(0).alias("one"), (F.col("s") / F.col("n")).alias("mean"))
    return told.withColumn("one", F.lit(0)).join(F.broadcast(mean), "one").select("label", F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.bround((F.col("value") - F.col("mean")) * scale).cast("int"))).alias("deviance"))


def dilemmas(edges: DataFrame, value: DataFrame, threshold: float = FORK, depth: int = 3) -> DataFrame:
    """(node, branches, best, reach): nodes with two ways or more worth taking, and how many positions lie within `depth` such steps."""
    good = cut(edge_value(edges, value).where(F.col("edge_value") >= threshold).select("source", "target", "edge_value"))
    forks = good.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("branches"), F.max("edge_value").alias("best")).where("branches >= 2")
    return forks.join(reached(good, depth), "node")


def reached(edges: DataFrame, depth: int, width: int = 4096) -> DataFrame:
    """(node, reach): how many other nodes lie within `depth` steps of each that has any; exact.

    What is reached is a bit a node, in blocks of at most `width` nodes: a block is one task's nodes x width / 8 bytes, and no pair of nodes is ever a row. The graph, 8 bytes an edge, is handed to every task.
    """
    session = edges.sparkSession
    labels = sorted(r[0] for r in edges.select(F.explode(F.array("source", "target")).alias("label")).where("label IS NOT NULL").distinct().collect())
    places = spread(session.createDataFrame(pd.DataFrame({"label": labels, "place": range(len(labels))}), "label string, place int"))
    known = edges.select("source", "target").join(places.toDF("source", "s"), "source").join(places.toDF("target", "t"), "target").select("s", "t").toArrow()
    source, target = (known.column(c).to_numpy().astype(np.int32) for c in ("s", "t"))
    order = np.argsort(source, kind="stable")
    target, n = target[order], len(labels)
    starts, first = np.unique(source[order], return_index=True)
    upto = np.append(first[1:], len(target))
    width = 64 * max(1, min(width // 64, -(-n // 768)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = max(1, (1 << 25) // (width // 8))
        for frame in frames:
            for low in frame["low"]:
                own = np.arange(low, min(low + width, n))
                bit = np.left_shift(np.uint64(1), ((own - low) % 64).astype(np.uint64))
                front, seen = np.zeros((n, width // 64), np.uint64), np.zeros((n, width // 64), np.uint64)
                front[own, (own - low) // 64] = bit
                for _ in range(depth):
                    new, at = np.zeros_like(front), 0
                    while at < len(starts):
                        end = max(at + 1, int(np.searchsorted(upto, first[at] + rows, side="right")))
                        new[starts[at:end]] = np.bitwise_or.reduceat(front[target[first[at] : upto[end - 1]]], first[at:end] - first[at])
                        at = end
                    front = new
                    seen |= front
                seen[own, (own - low) // 64] &= ~bit
                many = np.bitwise_count(seen).sum(1, dtype=np.int64)
                yield pd.DataFrame({"place": np.flatnonzero(many).astype(np.int32), "reach": many[many > 0]})

    found = session.range(0, n, width, max(1, -(-n // width))).select(F.col("id").alias("low")).mapInPandas(run, "place int, reach long")
    return found.groupBy("place").agg(F.sum("reach").alias("reach")).join(places, "place").select(F.col("label").alias("node"), "reach")


def counter_moves(nodes: DataFrame, edges: DataFrame, value: DataFrame, top: int = 3, least: int = 1) -> DataFrame:
    """(node, rank, counter, value, count, success, leads_to): the best answers to each node, and their own best way on."""
    valued = edge_value(edges, value)
    best = valued.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("edge_value"), "target"))).where("r = 1").select(F.col("source").alias("counter"), F.col("target").alias("leads_to"))
    ranked = valued.where(F.col("weight") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("edge_value"), "target"))).where(F.col("rank") <= top)
    told = ranked.select(F.col("source").alias("node"), "rank", F.col("target").alias("counter"), F.col("edge_value").alias("value"), F.col("weight").alias("count"))
    return told.join(nodes.select(F.col("label").alias("counter"), F.col("reward_risk").alias("success")), "counter", "left").join(best, "counter", "left").select("node", "rank", "counter", "value", "count", "success", "leads_to")


def routes(nodes: DataFrame, edges: DataFrame, steps: int = 6) -> DataFrame:
    """(start, path): from every node the heaviest unseen edge, step by step, until a submission, a dead end or `steps` steps."""
    kind = nodes.select(F.col("label").alias("target"), F.col("type").alias("next_type"))
    ways = cut(edges.join(kind, "target", "left").select("source", "target", "weight", "next_type"))
    state = nodes.select(F.col("label").alias("start"), F.array("label").alias("path"), F.lit(False).alias("done"))
    for _ in range(steps):
        last = F.element_at("path", -1)
        open_ = state.where("NOT done").withColumn("source", last).join(ways, "source").where(~F.array_contains("path", F.col("target")))
        # the heaviest; of equal ones the least label
        best = open_.groupBy("start").agg(F.min_by(F.struct("target", "next_type"), F.struct(-F.col("weight"), "target")).alias("n"))
        state = state.join(best, "start", "left").select("start", F.when(F.col("n").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("n.target"))).alias("path"), (F.col("done") | F.col("n").isNull() | F.coalesce(F.col("n.next_type") == "submission", F.lit(False))).alias("done"))
        state = cut(state)
    return state.select("start", "path")


# closures


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all nodes reachable over (child, parent) with their least distance, step by step until nothing new is reached, however deep; loops end there too."""
    front = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    step = front
    found = cut(front.withColumn("depth", F.lit(1)))
    last = found
    for depth in itertools.count(2):
        new = last.select("node", F.col("ancestor").alias("mid")).join(step.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor").distinct().join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        last = cut(new.withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        found = cut(found.unionByName(last))
    return found


def siblings(edges: DataFrame) -> DataFrame:
    """(node, sibling, shared): nodes that share a parent, with the number of those."""
    a, b = edges.select(F.col("child").alias("node"), "parent"), edges.select(F.col("child").alias("sibling"), "parent")
    return a.join(b, "parent").where("node <> sibling").groupBy("node", "sibling").agg(F.count("*").alias("shared"))


# per graph, in Python


def _linked(sources: Iterable, targets: Iterable, weights: Iterable) -> tuple[list[str], dict[str, dict[str, float]]]:
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for s, t, w in zip(sources, targets, weights, strict=True):
        if s != t:
            near[s][t] = near[s].get(t, 0.0) + float(w)
            near[t][s] = near[t].get(s, 0.0) + float(w)
    return sorted(near), near


def _undirected(edges: pd.DataFrame) -> tuple[list[str], dict[str, dict[str, float]]]:
    return _linked(edges["source"], edges["target"], edges["weight"])


def modularity(parts: list[list[str]], near: dict[str, dict[str, float]], resolution: float = 1.0) -> float:
    """Newman's modularity of a partition of a weighted undirected graph."""
    total = sum(sum(x.values()) for x in near.values())
    if not total:
        return 0.0
    inside = {n: i for i, part in enumerate(parts) for n in part}
    held = sum(w for n, x in near.items() for m, w in x.items() if inside[n] == inside[m])
    degree = [sum(sum(near[n].values()) for n in part) for part in parts]
    return held / total - resolution * sum((d / total) ** 2 for d in degree)


def greedy_parts(nodes: list[str], near: dict[str, dict[str, float]], resolution: float = 1.0) -> list[list[str]]:
    """Greedy agglomeration: always the merge that raises modularity most; of equal ones the least labels.

    Gains are compared times total^2 / 2, exact where weights are whole numbers. Of a pair the community of more degree keeps the gain, in its row of neighbours, which is an array; a row is
    seen again when its own community grows, or when it comes to the top of the heap and its best neighbour has grown. Until then what the heap has of it is a bound: a pair gains only by merging two neighbours of a third, and those are told.
    """
    if not any(near[n] for n in nodes):
        return [[n] for n in nodes]
    names = sorted(nodes)
    at = {n: i for i, n in enumerate(names)}
    ids = [np.fromiter((at[m] for m in near[n]), np.int64, len(near[n])) for n in names]
    weights = [np.fromiter(near[n].values(), float, len(near[n])) for n in names]
    degree = np.array([w.sum() for w in weights])
    total = degree.sum()
    whole = float(resolution).is_integer() and total < 2**30 and all((w == np.rint(w)).all() for w in weights)
    if whole:
        weights, degree, total, resolution = [w.astype(np.int64) for w in weights], degree.astype(np.int64), int(total), int(resolution)
    least = 0 if whole else 0.5e-12 * total**2
    home = np.arange(len(names))  # of each node its community, named by one of its nodes
    label, grown, told = home.copy(), np.zeros(len(names), int), np.zeros(len(names), int)
    members = {i: [i] for i in range(len(names))}
    heap: list[tuple] = []

    def compact(i: int) -> None:
        """Bring a row's neighbours to their communities of now."""
        now = home[ids[i]]
        order = np.argsort(now, kind="stable")
        now, w = now[order], weights[i][order]
        first = np.flatnonzero(np.r_[True, now[1:] != now[:-1]]) if len(now) else np.zeros(0, int)
        ids[i], weights[i] = now[first], np.add.reduceat(w, first) if len(w) else w

    def tell(i: int, js: np.ndarray, w: np.ndarray) -> None:
        """The best of a community's pairs comes on the heap."""
        if not len(js):
            return
        gain = w * total - resolution * (degree[i] * degree[js])
        best = gain.max()
        js = js[gain == best]
        low, high = np.minimum(label[i], label[js]), np.maximum(label[i], label[js])
        k = np.lexsort((high, low))[0]
        if best > least:
            heapq.heappush(heap, (-best.item(), low[k].item(), high[k].item(), i, js[k].item(), told[i].item(), grown[js[k]].item()))

    def seen(i: int) -> None:
        compact(i)
        told[i] += 1
        js = ids[i]
        own = (degree[js] < degree[i]) | ((degree[js] == degree[i]) & (js < i))
        tell(i, js[own], weights[i][own])

    for i in range(len(names)):
        seen(i)
    while heap:
        _, _, _, a, b, row, was = heapq.heappop(heap)
        if home[a] != a or told[a] != row:
            continue
        if home[b] != b or grown[b] != was:
            seen(a)
            continue
        compact(a)
        compact(b)
        if len(members[b]) > len(members[a]):
            a, b = b, a
        both = np.intersect1d(ids[a], ids[b], assume_unique=True)
        home[members[b]] = a
        members[a] += members.pop(b)
        label[a] = min(label[a], label[b])
        degree[a] += degree[b]
        grown[a] += 1
        ids[a], weights[a] = np.r_[ids[a], ids[b]], np.r_[weights[a], weights[b]]
        ids[b], weights[b] = ids[b][:0], weights[b][:0]
        kept = home[ids[a]] != a
        ids[a], weights[a] = ids[a][kept], weights[a][kept]
        seen(a)
        # the larger neighbours of both keep their pairs with the two in one, which gains more than with either
        for c in both[(degree[both] > degree[a]) | ((degree[both] == degree[a]) & (both > a))]:
            j = np.searchsorted(ids[a], c)
            tell(int(c), np.array([a]), weights[a][j : j + 1])
    return sorted((sorted(names[i] for i in m) for m in members.values()), key=lambda m: (-len(m), m[0]))


def louvain_parts(nodes: list[str], near: dict[str, dict[str, float]], resolution: float = 1.0, seed: int = 42) -> list[list[str]]:
    """Louvain: nodes move to the neighbouring community that raises modularity most, then communities become nodes, until nothing moves.

    Nodes are numbers in order of name, so that ties by number are ties by name. A node is seen again only when its own or a neighbouring community has changed since: else it would stay.
    """
    rng = np.random.default_rng(seed)
    names = sorted(nodes)
    number = {n: i for i, n in enumerate(names)}
    groups = [[n] for n in names]
    graph = [[(number[m], w) for m, w in near[n].items()] for n in names]
    loops = [0.0] * len(names)
    total = sum(sum(x.values()) for x in near.values())
    while total:
        degree = [sum([w for _, w in x]) + loop for x, loop in zip(graph, loops, strict=True)]
        home = list(range(len(graph)))
        weight = degree.copy()
        changed, seen, clock = [0] * len(graph), [-1] * len(graph), 0
        moved_any, moving = False, True
        while moving:
            moving = False
            for n in rng.permutation(len(graph)).tolist():
                since, old, links = seen[n], home[n], graph[n]
                # nor does it move that has no other community beside it
                if changed[old] > since:
                    for m, _ in links:
                        if home[m] != old:
                            break
                    else:
                        continue
                else:
                    for m, _ in links:
                        if changed[home[m]] > since:
                            break
                    else:
                        continue
                to: dict[int, float] = {}
                for m, w in links:
                    c = home[m]
                    to[c] = to.get(c, 0.0) + w
                own = degree[n]
                weight[old] -= own
                best, top = old, to.get(old, 0.0) - resolution * weight[old] * own / total
                least = top + 1e-12
                for c, w in to.items():
                    score = w - resolution * weight[c] * own / total
                    if score > top or (score == top and c < best != old):
                        best, top = c, score
                if best != old and top <= least:
                    best = old
                weight[best] += own
                if best != old:
                    home[n] = best
                    moving = moved_any = True
                    clock += 1
                    changed[old] = changed[best] = clock
                seen[n] = clock
        if not moved_any:
            break
        place = {c: k for k, c in enumerate(sorted(set(home)))}
        home = [place[c] for c in home]
        new: list[list[str]] = [[] for _ in place]
        merged: list[dict[int, float]] = [{} for _ in place]
        held = [0.0] * len(place)
        for n, c in enumerate(home):
            new[c] += groups[n]
            held[c] += loops[n]
            into = merged[c]
            for m, w in graph[n]:
                k = home[m]
                if k == c:
                    held[c] += w
                else:
                    into[k] = into.get(k, 0.0) + w
        groups, graph, loops = new, [list(x.items()) for x in merged], held
    return sorted((sorted(m) for m in groups), key=lambda m: (-len(m), m[0]))


def connected_parts(parts: list[list[str]], near: dict[str, dict[str, float]]) -> tuple[list[list[str]], int]:
    """Communities that hang together, those that do not split into the parts that do; and how many did not."""
    out, split = [], 0
    for part in parts:
        left, pieces = set(part), []
        while left:
            piece, front = set(), [min(left)]
            while front:
                n = front.pop()
                if n in left:
                    left.remove(n)
                    piece.add(n)
                    front += [m for m in near[n] if m in left]
            pieces.append(sorted(piece))
        split += len(pieces) > 1
        out += pieces
    return sorted(out, key=lambda m: (-len(m), m[0])), split


def fingerprint(members: Column) -> Column:
    """Sixteen hexadecimal digits for a set of members, whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "\u001f"), 256), 1, 16)


def communities(edges: DataFrame, graph: str, method: str = "louvain", resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(graph, community, size, hub, support, modularity, members, fingerprint) of each graph of `edges` (graph, source, target, weight).

    Weights of both directions are added. Each graph is one task's; graphs are of athletes, divisions or a vocabulary, which are bounded.
    """
    find = louvain_parts if method == "louvain" else greedy_parts

    def solve(key: str | None, sources: list[str], targets: list[str], weights: list[float]) -> Iterator[tuple]:
        nodes, near = _linked(sources, targets, weights)
        parts = find(nodes, near, resolution, seed) if method == "louvain" else find(nodes, near, resolution)
        parts, _ = connected_parts(parts, near)
        score = modularity(parts, near)
        for i, part in enumerate(parts):
            own = set(part)
            support = sum(w for n in part for m, w in near[n].items() if m in own) / 2
            hub = min(part, key=lambda n: (-sum(near[n].values()), n))
            yield str(key), i, len(part), hub, round(support, 3), round(score, 5), part

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows come sorted by graph: one graph is held at a time."""
        key, held, rows = None, ([], [], []), []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = [batch.column(k).to_pylist() for k in (1, 2)] + [batch.column(3).to_numpy(zero_copy_only=False).tolist()]
            at = 0
            while at < len(keys):
                if held[0] and keys[at] != key:
                    rows += solve(key, *held)
                    held = ([], [], [])
                    if len(rows) >= 2_000:
                        yield packed(rows)
                        rows = []
                key, end = keys[at], at + 1
                while end < len(keys) and keys[end] == key:
                    end += 1
                for into, column in zip(held, values, strict=True):
                    into += column[at:end]
                at = end
        if held[0]:
            rows += solve(key, *held)
        if rows:
            yield packed(rows)

    columns, kinds = ["graph", "community", "size", "hub", "support", "modularity", "members"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())]
    schema = "graph string, community int, size int, hub string, support double, modularity double, members array<string>"
    laid = edges.select(F.col(graph).cast("string").alias("graph"), "source", "target", F.col("weight").cast("double").alias("weight")).repartition("graph").sortWithinPartitions("graph")
    return laid.mapInArrow(run, schema).withColumn("fingerprint", fingerprint(F.col("members")))


def betweenness(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, label, betweenness): share of shortest ways (length 1/weight) that pass a node, each graph in one task."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for s, t, w in zip(pdf["source"], pdf["target"], pdf["weight"], strict=True):
            out[s].append((t, 1.0 / w))
        nodes = sorted(set(pdf["source"]) | set(pdf["target"]))
        score = dict.fromkeys(nodes, 0.0)
        for start in nodes:
            far, ways, before, order = {start: 0.0}, defaultdict(float, {start: 1.0}), defaultdict(list), []
            heap, done = [(0.0, start)], set()
            while heap:
                d, n = heapq.heappop(heap)
                if n in done:
                    continue
                done.add(n)
                order.append(n)
                for m, length in out[n]:
                    to = d + length
                    if m not in far or to < far[m] - 1e-12:
                        far[m], ways[m], before[m] = to, ways[n], [n]
                        heapq.heappush(heap, (to, m))
                    elif abs(to - far[m]) <= 1e-12 and m not in done:
                        ways[m] += ways[n]
                        before[m].append(n)
            share = defaultdict(float)
            for n in reversed(order):
                for b in before[n]:
                    share[b] += ways[b] / ways[n] * (1 + share[n])
                if n != start:
                    score[n] += share[n]
        scale = 1 / ((len(nodes) - 1) * (len(nodes) - 2)) if len(nodes) > 2 else 1
        return pd.DataFrame({"graph": str(key[0]), "label": nodes, "betweenness": [round(score[n] * scale, 5) for n in nodes]})

    return edges.select(F.col(graph).cast("string").alias("graph"), "source", "target", "weight").groupBy("graph").applyInPandas(solve, "graph string, label string, betweenness double")


def eigenvector(edges: DataFrame, graph: str, rounds: int = 200) -> DataFrame:
    """(graph, label, eigenvector): power iteration on each graph's in-weights."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["source"]) | set(pdf["target"]))
        at = {n: i for i, n in enumerate(nodes)}
        s, t, w = pdf["source"].map(at).to_numpy(int), pdf["target"].map(at).to_numpy(int), pdf["weight"].to_numpy(float)
        x = np.full(len(nodes), 1 / np.sqrt(len(nodes)))
        for _ in range(rounds):
            new = np.bincount(t, w * x[s], len(nodes)) + x
            new /= np.linalg.norm(new)
            if np.abs(new - x).max() < 1e-9:
                break
            x = new
        return pd.DataFrame({"graph": str(key[0]), "label": nodes, "eigenvector": np.round(x, 5)})

    return edges.select(F.col(graph).cast("string").alias("graph"), "source", "target", "weight").groupBy("graph").applyInPandas(solve, "graph string, label string, eigenvector double")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def compare_partitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(community, best, jaccard): each community of `a` (community, members) and the most similar of `b`; only those that share a member meet."""
    left = a.select("community", "members", F.explode("members").alias("m"))
    right = b.select(F.col("community").alias("other"), F.col("members").alias("others"), F.explode("members").alias("m"))
    pairs = left.join(right, "m").select("community", "members", "other", "others").distinct().withColumn("jaccard", jaccard(F.col("members"), F.col("others")))
    best = pairs.groupBy("community").agg(F.max_by("other", F.struct("jaccard", -F.col("other"))).alias("best"), F.max("jaccard").alias("jaccard"))
    return a.select("community").join(best, "community", "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))


def bootstrap_stability(units: DataFrame, unit: str, draws: int = 20, seed: int = 42) -> DataFrame:
    """(members, mean_jaccard, p10): how well each community of the pooled graph comes back when units are drawn again with replacement.

    `units` has (unit, source, target, weight), a graph's evidence by unit. How often a draw has a unit is Poisson(1) by hash, so that evidence is added
    up to one graph per draw before any of it is gathered; draws then run side by side, each beside the pooled graph.
    """
    u = (F.xxhash64(F.lit(seed), F.col(unit).cast("string"), "draw").bitwiseAND((1 << 40) - 1) + 0.5) / float(1 << 40)
    upto, term, times = math.exp(-1), math.exp(-1), F.lit(0)
    for i in range(1, 9):
        times = times + F.when(u > upto, 1).otherwise(0)
        term /= i
        upto += term
    spread = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", times)
    drawn = spread.groupBy("draw", "source", "target").agg(F.sum(F.col("weight") * F.col("times")).cast("double").alias("weight"), F.sum("weight").cast("double").alias("pooled"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "target"])
        whole, near = _undirected(pdf.assign(weight=pdf["pooled"]))
        base, _ = connected_parts(louvain_parts(whole, near, seed=seed), near)
        again, near2 = _undirected(pdf[pdf["weight"] > 0])
        parts, _ = connected_parts(louvain_parts(again, near2, seed=seed), near2)
        best = [max((len(set(p) & set(q)) / len(set(p) | set(q)) for q in parts), default=0.0) for p in base]
        return pd.DataFrame({"members": base, "jaccard": best})

    found = drawn.groupBy("draw").applyInPandas(solve, "members array<string>, jaccard double")
    return found.groupBy("members").agg(F.round(F.avg("jaccard"), 4).alias("mean_jaccard"), F.round(F.percentile("jaccard", F.lit(0.1)), 4).alias("p10"))


def walk_sets(edges: DataFrame, length: int = 40, per_node: int = 50, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """((nodes), labels): the different nodes of each seeded random walk along edge weights, as ascending places in `labels`, all nodes of the graph by name.

    `per_node` walks start at every node with a way out; one ends after `length` nodes or where no way leads on. The graph is handed to every task,
    some 20 bytes an edge; tasks divide the walks.
    """
    edges, session = cut(edges.select("source", "target", F.col("weight").cast("double").alias("weight"))), edges.sparkSession
    labels = sorted(r[0] for r in edges.select(F.explode(F.array("source", "target")).alias("label")).distinct().collect())
    places = session.createDataFrame(pd.DataFrame({"label": labels, "place": range(len(labels))}), "label string, place int")
    known = edges.join(places.toDF("source", "s"), "source").join(places.toDF("target", "t"), "target").select("s", "t", "weight").toArrow()
    source, target, weight = (known.column(c).to_numpy() for c in ("s", "t", "weight"))
    order = np.lexsort((target, source))
    source, target, upto = source[order], target[order], np.cumsum(weight[order])
    first, last = (np.searchsorted(source, np.arange(len(labels)), side=x) for x in ("left", "right"))
    before = np.concatenate([[0.0], upto])
    starts = np.flatnonzero(last > first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dice = np.stack(frame["dice"].to_numpy())
            at = starts[frame["id"].to_numpy() // per_node]
            seen = [at]
            for step in range(length - 1):
                low, high = before[first[at]], before[last[at]]
                way = np.searchsorted(upto, low + dice[:, step] * (high - low), side="right")
                at = np.where((at >= 0) & (high > low), target[np.clip(way, first[at], np.maximum(last[at] - 1, 0))], -1)
                seen.append(at)
            nodes = np.sort(np.stack(seen, 1), axis=1)
            new = nodes >= 0
            new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
            yield pd.DataFrame({"nodes": [row[keep] for row, keep in zip(nodes, new, strict=True)]})

    parts = min(32, int(session.conf.get("spark.sql.shuffle.partitions")))
    dice = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda step: (F.xxhash64("id", step, F.lit(seed)).bitwiseAND((1 << 30) - 1) + 0.5) / float(1 << 30))
    return cut(session.range(0, len(starts) * per_node, 1, parts).select("id", dice.alias("dice")).mapInPandas(run, "nodes array<int>")), labels


def cooccurrence_product(sets: DataFrame, size: int, block: np.ndarray) -> np.ndarray:
    """The product of a block of columns with the matrix of how many walks two different nodes share.

    With M, a row per walk and a one per node of it, that matrix is M'M less its diagonal: each task adds up its walks' rows, one block
    a task comes to the driver, and no pair of nodes is ever a row.
    """
    width = block.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((width, size))
        for frame in frames:
            nodes = np.concatenate(frame["nodes"].to_numpy())
            long = np.array([len(x) for x in frame["nodes"]])
            rows = block[nodes]
            sums = (np.repeat(np.add.reduceat(rows, np.cumsum(long) - long, axis=0), long, axis=0) - rows).T
            for c in range(width):
                out[c] += np.bincount(nodes, weights=sums[c], minlength=size)
        yield pd.DataFrame({"x": [out.tobytes()]})

    # summed in the order of the parts, so that the same walks give the same last digits
    parts = sets.mapInPandas(run, "x binary").withColumn("part", F.spark_partition_id()).collect()
    return sum((np.frombuffer(r["x"]).reshape(width, size) for r in sorted(parts, key=lambda r: r["part"])), np.zeros((width, size))).T


def walk_embedding(edges: DataFrame, dim: int = 16, length: int = 40, per_node: int = 50, seed: int = 7, rounds: int = 40, tolerance: float = 1e-5) -> DataFrame:
    """(label, vector): weighted random walks, how many of them two nodes share, and that matrix's truncated singular value decomposition (U S).

    The matrix is symmetric: block Lanczos with full orthogonalisation, until the `dim` largest pairs stand within `tolerance` of the largest value.
    The driver holds blocks of nodes x (dim + 8). A vector's sign is such that the largest entry of each dimension is positive; a graph of fewer than
    `dim` dimensions gets zeros in the rest.
    """
    sets, labels = walk_sets(edges, length, per_node, seed)
    n = len(labels)
    schema = "label string, vector array<double>"
    if not n:
        return edges.sparkSession.createDataFrame([], schema)
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, dim + 8))))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(rounds):
        basis, image = np.hstack([basis, new]), np.hstack([image, cooccurrence_product(sets, n, new)])
        small_ = basis.T @ image
        values, turns = np.linalg.eigh((small_ + small_.T) / 2)
        best = np.argsort(-np.abs(values), kind="stable")[:dim]
        values, turns = values[best], turns[:, best]
        vectors = basis @ turns
        off = np.linalg.norm(image @ turns - vectors * values, axis=0)
        rest = image[:, -new.shape[1] :]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        left, sizes, _ = np.linalg.svd(rest, full_matrices=False)
        new = left[:, sizes > 1e-9 * max(1.0, np.abs(values).max())][:, : n - basis.shape[1]]
        if off.max() <= tolerance * max(1e-300, np.abs(values).max()) or not new.shape[1]:
            break
    else:
        raise ValueError(f"the decomposition has not settled in {rounds} rounds")
    vectors = vectors * np.abs(values)
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    vectors = np.hstack([vectors, np.zeros((n, dim - vectors.shape[1]))])
    return edges.sparkSession.createDataFrame(list(zip(labels, vectors.tolist(), strict=True)), schema)
