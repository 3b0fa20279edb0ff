"""Communities as systems of play: their state, who drives them, how two athletes' systems match, what a weighting changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.operators import graphs, profiles, stats
from kumikata.plans.runtime import cut


def reward_risk_interval(nodes: DataFrame, least: int = 5) -> DataFrame:
    """(label, occ, balance, lo, hi): reward less risk of positions seen `least` times (Beta means), from its worst to its best case."""
    told = nodes.where(F.col("occ") >= least).withColumns({"_r": stats.beta_interval("reward", "occ"), "_k": stats.beta_interval("risk", "occ")})
    return told.select("label", "occ", (F.col("_r.mean") - F.col("_k.mean")).alias("balance"), (F.col("_r.lo") - F.col("_k.hi")).alias("lo"), (F.col("_r.hi") - F.col("_k.lo")).alias("hi"))


def classify_nodes(communities: DataFrame, nodes: DataFrame, least_size: int = 2, least_support: float = 0.0) -> DataFrame:
    """(graph, label, state): detected, singleton, low_support or, of `nodes` (graph, label), unassigned: each node is in one state."""
    state = F.when(F.col("size") == 1, "singleton").when((F.col("size") < least_size) | (F.col("support") < least_support), "low_support").otherwise("detected")
    members = communities.select("graph", F.explode("members").alias("label"), state.alias("state"))
    return nodes.select("graph", "label").distinct().join(members, ["graph", "label"], "full_outer").select("graph", "label", F.coalesce("state", F.lit("unassigned")).alias("state"))


def busiest(nodes: DataFrame, edges: DataFrame, n: int, by: str = "occ") -> tuple[DataFrame, DataFrame]:
    """The `n` busiest nodes of a graph, ties by name, and the edges among them."""
    kept = cut(nodes.orderBy(F.desc(by), "label").limit(n))
    for end in ("source", "target"):
        edges = edges.join(F.broadcast(kept.select(F.col("label").alias(end))), end, "left_semi")
    return kept, edges


def inner_edges(communities: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(graph, community, place, source, target, weight): the heaviest transitions within each community."""
    of = communities.select("graph", "community", F.explode("members").alias("label"))
    a, b = (of.select("graph", F.col("community").alias(f"c_{x}"), F.col("label").alias(x)) for x in ("source", "target"))
    inside = edges.join(a, ["graph", "source"]).join(b, ["graph", "target"]).where("c_source = c_target")
    w = Window.partitionBy("graph", "c_source").orderBy(F.desc("weight"), "source", "target")
    return inside.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("graph", F.col("c_source").alias("community"), "place", "source", "target", "weight")


def regions(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, region, name, count): communities by size, named after their most used member (`nodes`: label, occ)."""
    members = communities.select("graph", "community", "size", F.explode("members").alias("label")).join(nodes.select("label", "occ"), "label", "left")
    top = members.groupBy("graph", "community", "size").agg(F.min(F.struct((-F.coalesce("occ", F.lit(0))).alias("minus"), "label")).alias("t"))
    return top.select("graph", (F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("size"), "community")) - 1).alias("region"), F.concat(F.col("t.label"), F.lit(" system")).alias("name"), F.col("size").alias("count"))


def proposals(communities: DataFrame, rank: DataFrame, forks: DataFrame, least: int = 2) -> DataFrame:
    """(graph, community, name, entries, members, forks): a system for each community of `least` members or more: its most central members and the dilemmas within.

    `rank` is (label, rank), `forks` (label, value).
    """
    members = communities.where(F.col("size") >= least).select("graph", "community", F.explode("members").alias("label")).join(rank.select("label", "rank"), "label", "left").join(forks.select("label", "value"), "label", "left")
    order = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("minus"), "label"))))
    told = members.withColumn("rank", F.coalesce("rank", F.lit(0.0))).groupBy("graph", "community").agg(F.transform(order("rank"), lambda x: x["label"]).alias("members"), F.transform(order("value"), lambda x: x["label"]).alias("forks"))
    return told.select("graph", "community", F.concat(F.initcap(F.get("members", F.lit(0))), F.lit(" System")).alias("name"), F.slice("members", 1, 3).alias("entries"), "members", F.slice("forks", 1, 3).alias("forks"))


def drivers(units: DataFrame, communities: DataFrame, vanish: float = 0.2, carries: float = 0.2, seed: int = 42) -> DataFrame:
    """(graph, community, driver): whose leaving makes a community vanish: without that unit no community is as alike as `vanish`; the first by name, else null.

    `units` has (graph, unit, source, target, weight). Asked about are the units that carry a share of `carries` or more of a community's inner weight, at most 1 / `carries` of each; each is
    one detection over its graph less its own evidence, one task.
    """
    totals = cut(units.groupBy("graph", "source", "target").agg(F.sum("weight").alias("weight")))
    own = cut(units.groupBy("graph", "unit", "source", "target").agg(F.sum("weight").alias("own")))
    of = communities.select("graph", "community", F.explode("members").alias("label"))
    a, b = (of.select("graph", F.col("community").alias(f"c_{x}"), F.col("label").alias(x)) for x in ("source", "target"))
    inside = lambda frame: frame.join(a, ["graph", "source"]).join(b, ["graph", "target"]).where("c_source = c_target")
    whole = inside(totals).groupBy("graph", "c_source").agg(F.sum("weight").alias("all"))
    asked = inside(own).groupBy("graph", "unit", "c_source").agg(F.sum("own").alias("own")).join(whole, ["graph", "c_source"]).where(F.col("own") >= carries * F.col("all")).select("graph", "unit").distinct()
    without = asked.join(totals, "graph").join(own, ["graph", "unit", "source", "target"], "left").select("graph", "unit", "source", "target", (F.col("weight") - F.coalesce("own", F.lit(0))).alias("weight")).where("weight > 0")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, near = graphs._undirected(pdf.sort_values(["source", "target"]))
        parts, _ = graphs.connected_parts(graphs.louvain_parts(nodes, near, seed=seed), near)
        return pd.DataFrame([(key[0], key[1], p) for p in parts], columns=["graph", "unit", "part"])

    again = without.groupBy("graph", "unit").applyInPandas(solve, "graph string, unit string, part array<string>")
    pairs = communities.select("graph", "community", "members").join(asked, "graph").join(again, ["graph", "unit"], "left")
    best = pairs.groupBy("graph", "community", "unit").agg(F.max(F.coalesce(graphs.jaccard(F.col("members"), F.col("part")), F.lit(0.0))).alias("best")).where(F.col("best") < vanish)
    return communities.select("graph", "community").join(best.groupBy("graph", "community").agg(F.min("unit").alias("driver")), ["graph", "community"], "left")


def matching(scores: Column) -> Column:
    """The one-to-one matching of an array of (system_a, minus, system_b), `minus` the score below zero: each system of `a` in order with its most alike that is still free, ties by number."""
    met = lambda done, x: F.exists(done, lambda m: (m["system_a"] == x["system_a"]) | (m["system_b"] == x["system_b"]))
    return F.aggregate(F.array_sort(scores), F.array().cast("array<struct<system_a:int,minus:double,system_b:int>>"), lambda done, x: F.when(met(done, x), done).otherwise(F.array_append(done, x)))


def match_systems(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """(a, b, system_a, system_b, score): systems of two athletes matched one to one, each of `a` in order with its most alike that is still free.

    `pairs` has (a, b), `similarity` (a, b, system_a, system_b, score) of all their systems.
    """
    told = similarity.where("score IS NOT NULL").join(pairs, ["a", "b"], "left_semi").groupBy("a", "b")
    row = F.struct(F.col("system_a").cast("int").alias("system_a"), (-F.col("score").cast("double")).alias("minus"), F.col("system_b").cast("int").alias("system_b"))
    found = told.agg(matching(F.collect_list(row)).alias("m"))
    return found.select("a", "b", F.explode("m").alias("m")).select("a", "b", "m.system_a", "m.system_b", (-F.col("m.minus")).alias("score"))


#: Comparisons of systems that are held at once.
CELLS = 500_000


def _padded(at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the systems of each list, a row a list, and which of them there are."""
    step = np.arange(width)
    there = step < n[:, None]
    return np.where(there, at[:, None] + step, at[:, None]), there


def _match_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`match_system_lists` for blocks of pairs: all their systems are compared in arrays, and each step of the matching is one for all pairs of a block."""
    for batch in batches:
        lists = [batch.column(2), batch.column(3)]
        firsts, lengths = ([f(x) for x in lists] for f in (lambda x: x.offsets.to_numpy()[:-1] - x.offsets[0].as_py(), lambda x: np.diff(x.offsets.to_numpy())))
        flat = [dict(zip([f.name for f in x.type.value_type], x.flatten().flatten(), strict=True)) for x in lists]
        codes = {}
        for c in ("dominant", "hub_type"):
            # a null is like nothing, not like another null
            both = pa.chunked_array([x[c] for x in flat]).combine_chunks().dictionary_encode().indices
            cut_at = len(flat[0][c])
            codes[c] = [part.fill_null(null).to_numpy(zero_copy_only=False) for part, null in ((both[:cut_at], -1), (both[cut_at:], -2))]
        values = {c: [x[c].to_numpy(zero_copy_only=False).astype(float) for x in flat] for c in ("share", "size", "support")}
        numbers = [x["community"].to_numpy(zero_copy_only=False) for x in flat]
        order, start = np.lexsort((lengths[1], lengths[0])), 0
        rows, counts, found = [], [], ([], [], [])
        while start < len(order):
            some = order[start : start + max(1, CELLS // max(1, int(lengths[0].max()) * int(lengths[1].max())))]
            start += len(some)
            n_a, n_b = lengths[0][some], lengths[1][some]
            at_a, is_a = _padded(firsts[0][some], n_a, int(n_a.max()))
            at_b, is_b = _padded(firsts[1][some], n_b, int(n_b.max()))
            side = lambda v: (v[0][at_a][:, :, None], v[1][at_b][:, None, :])  # noqa: B023, E731
            kind, hub, share = side(codes["dominant"]), side(codes["hub_type"]), side(values["share"])
            score = profiles.system_score(np.where(kind[0] == kind[1], np.minimum(*share), 0.0), hub[0] == hub[1], side(values["size"]), side(values["support"]))
            score = np.where(is_b[:, None, :], score, -np.inf)
            each, mine, yours, best = np.arange(len(some)), [], [], []
            free = np.zeros((len(some), score.shape[2]))
            for i in range(score.shape[1]):
                row = score[:, i, :] + free
                j = row.argmax(axis=1)
                top = np.where(is_a[:, i], row[each, j], -np.inf)
                free[each[top > -np.inf], j[top > -np.inf]] = -np.inf
                mine.append(numbers[0][at_a[:, i]])
                yours.append(numbers[1][at_b[each, j]])
                best.append(top)
            score = np.stack(best, axis=1)
            kept = score > -np.inf
            rows.append(some)
            counts.append(kept.sum(axis=1))
            for into, part in zip(found, (np.stack(mine, axis=1), np.stack(yours, axis=1), score), strict=True):
                into.append(part[kept])
        if not rows:
            continue
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
        parts = [pa.array(np.concatenate(x)).cast(kind) for x, kind in zip(found, (pa.int32(), pa.int32(), pa.float64()), strict=True)]
        places = pa.array(np.concatenate(rows))
        told = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["system_a", "system_b", "score"]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), told], ["a", "b", "matched"])


def match_system_lists(pairs: DataFrame) -> DataFrame:
    """(a, b, matched): `match_systems` of pairs whose systems are at hand: (a, b, systems_a, systems_b), lists that are not empty of (community, dominant, share, hub_type, size, support) in order of community."""
    return pairs.select("a", "b", "systems_a", "systems_b").mapInArrow(_match_lists, "a string, b string, matched array<struct<system_a:int,system_b:int,score:double>>")


def list_similarity(lists: DataFrame) -> DataFrame:
    """(a, b, matched, similarity): `profile_similarity` of `match_system_lists`, by a sum over each list."""
    total = F.aggregate("matched", F.lit(0.0), lambda s, m: s + m["score"])
    return lists.select("a", "b", F.size("matched").cast("long").alias("matched"), (total / F.size("matched")).alias("similarity"))


def profile_similarity(matches: DataFrame) -> DataFrame:
    """(a, b, matched, similarity): the mean of two athletes' matched systems: a cell of the matrix of comparisons."""
    return matches.groupBy("a", "b").agg(F.count("*").alias("matched"), F.avg("score").alias("similarity"))


def nearest_profiles(cells: DataFrame, k: int = 5) -> DataFrame:
    """(a, place, b, similarity): the `k` most alike of each."""
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return cells.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("a", "place", "b", "similarity")


def blended_neighbours(lists: list[DataFrame], edges: DataFrame, k: int = 6, suggest: float = 0.6) -> DataFrame:
    """(node, place, neighbour, score, suggested): several lists of neighbours (node, neighbour, score) in one, the highest score of each; `suggested` where no edge joins the two yet and the score is high enough."""
    told = lists[0]
    for other in lists[1:]:
        told = told.unionByName(other)
    best = told.where("node <> neighbour").groupBy("node", "neighbour").agg(F.max(F.round("score", 3)).alias("score"))
    kept = best.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "neighbour"))).where(F.col("place") <= k)
    known = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))).distinct().withColumn("_known", F.lit(True))
    return kept.join(known, ["node", "neighbour"], "left").select("node", "place", "neighbour", "score", ((F.col("score") >= suggest) & F.col("_known").isNull()).alias("suggested"))


def weighting_effect(a: DataFrame, b: DataFrame, key: str, value: str, top: int = 20) -> DataFrame:
    """(nodes, rho, kept): how alike a measure (key, value) is under two weightings: Spearman's rho, and the share of the `top` that stays."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    first = lambda c: both.orderBy(F.desc(c), key).limit(top).select(key)
    kept = first("x").join(first("y"), key).agg((F.count("*") / F.lit(float(top))).alias("kept"))
    rho = stats.spearman(both, "x", "y").select("n", "rho")
    return rho.withColumn("_one", F.lit(0)).join(F.broadcast(kept.withColumn("_one", F.lit(0))), "_one").select(F.col("n").alias("nodes"), "rho", "kept")


def community_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nodes, changed, share): members of the communities of `a` (community, members) that are not in the most alike community of `b`."""
    best = graphs.compare_partitions(a, b).select("community", "best")
    told = a.select("community", F.explode("members").alias("label")).join(best, "community").join(b.select(F.col("community").alias("now"), F.explode("members").alias("label")), "label", "left")
    moved = F.count_if(~F.col("now").eqNullSafe(F.col("best")))
    return told.agg(F.count("*").alias("nodes"), moved.alias("changed"), (moved / F.greatest(F.count("*"), F.lit(1))).alias("share"))


# Conditions on ladders


def sibling_contrasts(observed: DataFrame, ladder: DataFrame, least: int = 4) -> DataFrame:
    """(response, condition, depth, level, effect, effect_lo, n_level, n_siblings): P(response | level) less P(response | the parent's other members), per level of each condition.

    `observed` has (condition, response, n); `ladder` (condition, depth, level), depth 0 the condition itself. The last level has no siblings and no row. Contrasts are of
    sums by (level, response): no observation is joined with another.
    """
    sums = observed.groupBy("condition", "response").agg(F.sum("n").alias("n"))
    rolled = cut(ladder.join(sums, "condition").groupBy("level", "response").agg(F.sum("n").alias("hits")))
    size = rolled.groupBy("level").agg(F.sum("hits").alias("size"))
    up = ladder.select("condition", "depth", "level").join(ladder.select("condition", (F.col("depth") - 1).alias("depth"), F.col("level").alias("parent")), ["condition", "depth"])
    asked = sums.select("condition", "response").join(up, "condition").join(size, "level").join(size.select(F.col("level").alias("parent"), F.col("size").alias("p_size")), "parent")
    hits = lambda level, name: rolled.select(F.col("level").alias(level), "response", F.col("hits").alias(name))
    told = asked.join(hits("level", "hits"), ["level", "response"], "left").join(hits("parent", "p_hits"), ["parent", "response"], "left").na.fill(0, ["hits", "p_hits"])
    told = told.withColumns({"n_siblings": F.col("p_size") - F.col("size"), "_out": F.col("p_hits") - F.col("hits")}).withColumns({"_i": stats.beta_interval("hits", "size"), "_o": stats.beta_interval("_out", "n_siblings")})
    some = F.col("n_siblings") > 0
    effect, low = (F.when(some, e).otherwise(0.0) for e in (F.col("_i.mean") - F.col("_o.mean"), F.col("_i.lo") - F.col("_o.hi")))
    return told.select("response", "condition", "depth", "level", effect.alias("effect"), low.alias("effect_lo"), F.col("size").alias("n_level"), "n_siblings", ((F.col("size") < least) | (F.col("n_siblings") < least)).alias("thin"))


def select_level(contrasts: DataFrame, ladder: DataFrame) -> DataFrame:
    """(response, condition, chosen, reason, effect_lo): the most specific level that differs from its siblings, else the last: specific, insufficient, generalized or no-hierarchy."""
    last = ladder.groupBy("condition").agg(F.max_by("level", "depth").alias("top"), F.max("depth").alias("steps"))
    best = contrasts.groupBy("response", "condition").agg(F.min(F.when(~F.col("thin") & (F.col("effect_lo") > 0), F.struct("depth", "level", "effect_lo"))).alias("b"), F.bool_or("thin").alias("thin"))
    told = best.join(last, "condition")
    reason = F.when(F.col("b").isNotNull(), "specific").when(F.col("thin"), "insufficient").otherwise("generalized")
    return told.select("response", "condition", F.coalesce(F.col("b.level"), "top").alias("chosen"), reason.alias("reason"), F.col("b.effect_lo").alias("effect_lo"))


def condition_family(key: Column, families: dict[str, str]) -> Column:
    """The family of a condition; a bundle has one only if all its parts agree."""
    table = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    found = F.array_distinct(F.transform(F.split(key, "-and-"), lambda p: F.coalesce(F.element_at(table, p), F.lit(""))))
    return F.when((F.size(found) == 1) & (F.get(found, F.lit(0)) != ""), F.get(found, F.lit(0)))


def branch_score(count: Column, successes: Column, failures: Column, outcome: Column, relevance: float = 0.3) -> Column:
    """How much a branch of a decision tree counts: support up to ten, success where three are known, the kind of outcome, relevance. Fixed values."""
    known = successes + failures
    sure = F.when(known >= 3, (successes + 1.0) / (known + 2.0)).otherwise(0.0)
    worth = F.when(outcome == "submission", 1.0).when(outcome.isin("sweep", "pass", "takedown"), 0.7).otherwise(0.4)
    return F.round(0.35 * F.least(count.cast("double"), F.lit(10.0)) / 10 + 0.25 * sure + 0.20 * worth + 0.10 * 0.5 + 0.10 * relevance, 4)


def leads_to(patterns: DataFrame, root: str, response: str, n: str, limit: int = 3) -> DataFrame:
    """(root, leads_to): the most frequent responses of each root as one text."""
    ranked = patterns.withColumn("_r", F.row_number().over(Window.partitionBy(root).orderBy(F.desc(n), response))).where(F.col("_r") <= limit)
    return ranked.groupBy(root).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", response))), lambda x: x[response]), " / ").alias("leads_to"))
