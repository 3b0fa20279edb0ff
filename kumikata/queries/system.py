"""Queries over systems of play, weightings and ladders of conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import flow, graphs as g, profiles, sequences as s, systems as y
from kumikata.operators.joins import participants
from kumikata.operators.vectors import sparse_neighbours
from kumikata.plans.runtime import cut, small, spread
from kumikata.queries.graph import _graph, _valued
from kumikata.sources.views import EV, bouts, events

# Families of conditions.
FAMILIES = {"strangle-threat": "attack", "arm-threat": "attack", "leg-threat": "attack", "submission-threat": "attack", "escaping": "defence", "guard-retained": "defence", "passing": "advance", "sweeping": "advance", "standing-attack": "advance", "controlling": "hold"}


def _r(frame, *columns, digits=4):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _division_edges(spark, d):
    """(graph, unit, source, target, weight): each athlete's transitions by division."""
    of = bouts(spark, d).where("division IS NOT NULL").select("match_id", F.col("division").alias("graph"))
    steps = s.transitions(events(spark, d)).select("match_id", F.col("actor").alias("unit"), "source", "target").join(of, "match_id")
    return cut(steps.groupBy("graph", "unit", "source", "target").agg(F.count("*").cast("double").alias("weight")))


def _division_communities(units):
    return cut(g.communities(units.groupBy("graph", "source", "target").agg(F.sum("weight").alias("weight")), "graph"))


def _drivers(spark, d):
    units = _division_edges(spark, d)
    return y.drivers(units, _division_communities(units))


def _states(spark, d):
    units = _division_edges(spark, d)
    nodes = events(spark, d).join(bouts(spark, d).where("division IS NOT NULL").select("match_id", F.col("division").alias("graph")), "match_id").select("graph", "label")
    return y.classify_nodes(_division_communities(units), nodes, 3, 2.0).groupBy("graph", "state").agg(F.count("*").alias("nodes"))


def _inner(spark, d):
    units = _division_edges(spark, d)
    return y.inner_edges(_division_communities(units), units.groupBy("graph", "source", "target").agg(F.sum("weight").alias("weight")))


def _regions(spark, d):
    nodes, edges = _graph(spark, d)
    return y.regions(g.communities(edges.withColumn("graph", F.lit("all")), "graph"), nodes)


def _proposals(spark, d):
    nodes, edges, value = _valued(spark, d)
    rank = g.weighted_pagerank(nodes, edges, 20, tolerance=0)
    forks = g.dilemmas(edges, value)
    fork = forks.select(F.col(forks.columns[0]).alias("label")).distinct().join(value, "label").select("label", "value")
    told = y.proposals(g.communities(edges.withColumn("graph", F.lit("all")), "graph"), rank, fork)
    return told.select("graph", "community", "name", *[F.array_join(c, " > ").alias(c) for c in ("entries", "members", "forks")])


def _matches(spark, d):
    """Systems of athletes who have met, matched by size, hub and leading type: (a, b, matched), a row a pair."""
    ev = events(spark, d, by_bout=True, of=("label", "type", "actor")).drop("i").withColumnRenamed("idx", "i")  # the order of both is the same
    # what both kinds of labels and steps need, once: a bout's rows are not needed again; an event without an actor has a kind only
    seen = ev.select("actor", "label", "type", F.when(F.col("actor").isNotNull(), F.lead("label").over(s.own())).alias("target")).persist()
    kinds = small(cut(seen.select("label", "type").distinct().groupBy("label").agg(F.min("type").alias("type"))))
    steps = seen.where("target <> label").select("actor", F.col("label").alias("source"), "target", F.lit(1.0).alias("weight"))
    found = profiles.systems(steps, kinds, "actor").where("size >= 2").join(kinds.select(F.col("label").alias("hub"), F.col("type").alias("hub_type")), "hub", "left")
    listed = cut(found.groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("community", "dominant", "share", "hub_type", "size", "support"))).alias("systems")))
    seen.unpersist()
    side = lambda x: spread(listed.select(F.col("actor").alias(x), F.col("systems").alias(f"systems_{x}")))
    met = participants(bouts(spark, d).where("a <> b").select("match_id", "a", "b")).select(F.col("athlete").alias("a"), F.col("opponent").alias("b"))
    return y.match_system_lists(met.repartition("a").distinct().join(side("a"), "a").join(side("b"), "b"))


def _matched(spark, d):
    return _matches(spark, d).select("a", "b", F.explode("matched").alias("m")).select("a", "b", "m.*")


def _neighbours(spark, d):
    edges = _graph(spark, d)[1]
    out = sparse_neighbours(edges, "source", "target", "weight", 6)
    back = sparse_neighbours(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"), "source", "target", "weight", 6)
    names = out.columns
    lists = [x.select(F.col(names[0]).alias("node"), F.col(names[1]).alias("neighbour"), F.col("cosine").alias("score")) for x in (out, back)]
    return y.blended_neighbours(lists, edges)


def _weightings(spark, d):
    """PageRank over all transitions against PageRank over the athletes' shares."""
    ev = cut(events(spark, d))
    nodes = cut(s.transition_nodes(ev))
    plain, fair = cut(s.transition_edges(ev)), cut(s.balanced_edges(ev).withColumn("ok", F.lit(0)))
    ranks = [g.weighted_pagerank(nodes, e, 20, tolerance=0) for e in (plain, fair)]
    return _r(y.weighting_effect(*ranks, "label", "rank"), "rho", "kept")


def _changes(spark, d):
    ev = cut(events(spark, d))
    found = [g.communities(e.withColumn("graph", F.lit("all")), "graph").select("community", "members") for e in (s.transition_edges(ev), s.balanced_edges(ev))]
    return _r(y.community_change(*found), "share")


def _observed(spark, d):
    return flow.chains(events(spark, d)).where("condition IS NOT NULL AND response IS NOT NULL").join(events(spark, d).groupBy(F.col("label").alias("response")).agg(F.min("type").alias("kind")), "response").groupBy("condition", F.col("kind").alias("response")).agg(F.count("*").alias("n"))


def _ladder(observed):
    """Each condition below its family, each family below all; a bundle of two families stands alone."""
    keys = observed.select("condition").distinct().withColumn("family", y.condition_family(F.col("condition"), FAMILIES))
    steps = F.when(F.col("family").isNull(), F.array("condition")).otherwise(F.array("condition", F.concat(F.lit("fam:"), "family"), F.lit("all")))
    return keys.select("condition", F.posexplode(steps).alias("depth", "level"))


def _contrasts(spark, d):
    observed = cut(_observed(spark, d))
    return _r(y.sibling_contrasts(observed, _ladder(observed)), "effect", "effect_lo", digits=5)


def _levels(spark, d):
    observed = cut(_observed(spark, d))
    ladder = cut(_ladder(observed))
    return _r(y.select_level(y.sibling_contrasts(observed, ladder), ladder), "effect_lo", digits=5)


def _families(spark, d):
    told = flow.chains(events(spark, d)).where("condition IS NOT NULL").groupBy("condition").agg(F.count("*").alias("n"))
    return told.withColumn("family", y.condition_family(F.col("condition"), FAMILIES))


def _branches(spark, d):
    """Each action's answers with their score."""
    ev = events(spark, d)
    kind = ev.groupBy(F.col("label").alias("response")).agg(F.min("type").alias("kind"))
    told = flow.chains(ev).groupBy("action", "response").agg(F.count("*").alias("n"), F.count_if(F.coalesce("success", F.lit(False))).alias("ok"), F.count_if(~F.coalesce("success", F.lit(True))).alias("failed")).where("n >= 3").join(kind, "response")
    return told.select("action", "response", "n", y.branch_score(*map(F.col, ("n", "ok", "failed", "kind"))).alias("score"))


def _leads(spark, d):
    told = flow.chains(events(spark, d)).groupBy("action", "response").agg(F.count("*").alias("n"))
    return y.leads_to(told, "action", "response", "n")


def _top(spark, d):
    nodes, edges = _graph(spark, d)
    return y.busiest(nodes, edges, 40)[1].select("source", "target", "weight")


QUERIES = {
    "reward_risk_intervals": lambda spark, d: _r(y.reward_risk_interval(s.transition_nodes(events(spark, d))), "balance", "lo", "hi"),
    "division_drivers": _drivers,
    "division_node_states": _states,
    "division_inner_edges": _inner,
    "map_regions": _regions,
    "system_proposals": _proposals,
    "matched_systems": lambda spark, d: _r(_matched(spark, d), "score", digits=6),
    "profile_matrix": lambda spark, d: _r(y.list_similarity(_matches(spark, d)), "similarity"),
    "nearest_profiles": lambda spark, d: _r(y.nearest_profiles(y.list_similarity(_matches(spark, d))), "similarity"),
    "map_neighbours": _neighbours,
    "weighting_effect": _weightings,
    "weighting_communities": _changes,
    "sibling_contrasts": _contrasts,
    "selected_levels": _levels,
    "condition_families": _families,
    "branch_scores": _branches,
    "leads_to": _leads,
    "busiest_graph": _top,
}

_WITH = f"WITH {EV}"
_COND = "CASE " + " ".join(f"WHEN contains(concat_ws(' ', o.label, o.type), '{w}') THEN '{c}'" for w, c in flow.CONDITIONS) + " ELSE 'other' END"
_OWN = "ow AS (SELECT match_id, actor, i, label AS action, lead(label) OVER w AS response, lead(ok) OVER w AS success, lead(i) OVER w AS j FROM ev WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY match_id, actor ORDER BY i)), ch AS (SELECT * FROM ow WHERE response IS NOT NULL)"
_CHAIN = f"{_OWN}, cs AS (SELECT ch.match_id, ch.actor, ch.i, {_COND} AS c, min(o.i) AS k FROM ch JOIN ev o ON o.match_id = ch.match_id AND o.i > ch.i AND o.i < ch.j AND o.actor IS NOT NULL GROUP BY ALL), c2 AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY match_id, actor, i ORDER BY k) <= 2), cn AS (SELECT match_id, actor, i, string_agg(c, '-and-' ORDER BY c) AS condition FROM c2 GROUP BY ALL)"
_FAMV = ", ".join(f"('{k}', '{v}')" for k, v in FAMILIES.items())
_KIND = "kd AS (SELECT label, min(type) AS kind FROM ev GROUP BY 1)"
ORACLES = {
    "condition_families": f"{_WITH}, {_CHAIN}, fm(p, f) AS (VALUES {_FAMV}), n AS (SELECT condition, count(*) AS n FROM cn GROUP BY 1), x AS (SELECT condition, unnest(string_split(condition, '-and-')) AS p FROM n), y AS (SELECT condition, CASE WHEN count(DISTINCT coalesce(f, '')) = 1 THEN max(f) END AS family FROM x LEFT JOIN fm USING (p) GROUP BY 1) SELECT condition, n, family FROM n JOIN y USING (condition)",
    "branch_scores": f"{_WITH}, {_OWN}, {_KIND}, t AS (SELECT action, response, count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed FROM ch GROUP BY 1, 2 HAVING count(*) >= 3) SELECT action, response, n, round(0.35::DOUBLE * least(n, 10) / 10.0 + 0.25::DOUBLE * CASE WHEN ok + failed >= 3 THEN (ok + 1.0::DOUBLE) / (ok + failed + 2.0) ELSE 0 END + 0.20::DOUBLE * CASE WHEN kind = 'submission' THEN 1.0 WHEN kind IN ('sweep', 'pass', 'takedown') THEN 0.7 ELSE 0.4 END + 0.05::DOUBLE + 0.03::DOUBLE, 4) AS score FROM t JOIN kd ON kd.label = t.response",
    "leads_to": f"{_WITH}, {_OWN}, t AS (SELECT action, response, count(*) AS n FROM ch GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY n DESC, response) AS r FROM t) SELECT action, string_agg(response, ' / ' ORDER BY r) AS leads_to FROM r WHERE r <= 3 GROUP BY 1",
    "busiest_graph": f"{_WITH}, oc AS (SELECT label, count(*) AS occ FROM ev GROUP BY 1 ORDER BY occ DESC, label LIMIT 40), bg AS (SELECT action AS source, response AS target, count(*) AS weight FROM (SELECT label AS action, lead(label) OVER (PARTITION BY match_id, actor ORDER BY i) AS response FROM ev WHERE actor IS NOT NULL) WHERE response <> action GROUP BY 1, 2) SELECT source, target, weight FROM bg WHERE source IN (SELECT label FROM oc) AND target IN (SELECT label FROM oc)",
}
