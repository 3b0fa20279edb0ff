"""Queries over the transition graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import graphs as g
from kumikata.operators import sequences as s
from kumikata.plans.runtime import cut, table
from kumikata.queries.seq import _OWN, ORACLES as SEQ
from kumikata.sources.views import EV, events, node_key


def _graph(spark, d):
    ev = cut(events(spark, d))
    return cut(s.transition_nodes(ev)), cut(s.transition_edges(ev))


def _valued(spark, d, rounds=15):
    nodes, edges = _graph(spark, d)
    return nodes, edges, cut(g.path_to_victory(nodes, edges, rounds, tolerance=0))


def _pagerank(spark, d):
    nodes, edges = _graph(spark, d)
    return g.weighted_pagerank(nodes, edges, 20, tolerance=0).withColumn("rank", F.round("rank", 9))


def _ptv(spark, d):
    return _valued(spark, d)[2].withColumn("value", F.round("value", 6))


def _with(f, column, digits=5):
    def run(spark, d):
        nodes, edges, value = _valued(spark, d)
        out = f(nodes, edges, value)
        return out.withColumn(column, F.round(column, digits)) if column else out

    return run


def _keys(spark, d):
    """Graph edges of the stored graphs, keys cleaned."""
    e = table(spark, d, "graph_edges").where("target_key IS NOT NULL AND source_key IS NOT NULL")
    return e.select("graph_id", "owner_kind", node_key(F.col("source_key")).alias("source"), node_key(F.col("target_key")).alias("target")).where("source <> target").groupBy("graph_id", "owner_kind", "source", "target").agg(F.count("*").alias("weight"))


def _taxonomy(spark, d):
    """Each library entry below its type and family, each entry with a modifier below the plain one."""
    t = table(spark, d, "technique_nodes")
    up = t.select(F.col("node_key").alias("child"), F.concat(F.lit("type:"), "type").alias("parent")).unionByName(t.where("node_type IS NOT NULL").select(F.col("node_key").alias("child"), F.concat(F.lit("family:"), "node_type").alias("parent")))
    plain = t.select(F.col("node_key").alias("parent"))
    bare = t.withColumn("parent", F.expr("substring(node_key, instr(node_key, ' ') + 1)")).join(plain, "parent", "left_semi").select(F.col("node_key").alias("child"), "parent")
    return up.unionByName(bare).unionByName(t.where("node_type IS NOT NULL").select(F.concat(F.lit("family:"), "node_type").alias("child"), F.lit("root").alias("parent")).distinct())


def _stability(spark, d):
    return g.bootstrap_stability(_keys(spark, d).where("owner_kind = 'athlete'"), "graph_id", 10)


QUERIES = {
    "weighted_pagerank_k20": _pagerank,
    "path_to_victory_k15": _ptv,
    "edge_value": _with(lambda n, e, v: g.edge_value(e, v).select("source", "target", "edge_value"), "edge_value", 4),
    "continuity": _with(lambda n, e, v: g.continuity(n, e), "continuity"),
    "control_score": _with(lambda n, e, v: g.control_score(e, v), "control"),
    "decision_funnel": _with(lambda n, e, v: g.decision_funnel(e, v), "funnel"),
    "dilemmas": _with(lambda n, e, v: g.dilemmas(e, v), None),
    "counter_moves": _with(lambda n, e, v: g.counter_moves(n, e, v).withColumn("success", F.round("success", 6)), "value", 4),
    "node_elo_deviance": _with(lambda n, e, v: g.node_deviance(n, v), None),
    "route_to_submission": lambda spark, d: g.routes(*_graph(spark, d)).select("start", F.array_join("path", " > ").alias("path")),
    "degree_strengths": lambda spark, d: g.strengths(_graph(spark, d)[1]),
    "reciprocal_links": lambda spark, d: g.pair_links(_graph(spark, d)[1]),
    "dashed_edges": lambda spark, d: g.dashed(_graph(spark, d)[1], _graph(spark, d)[0]),
    "taxonomy_closure": lambda spark, d: g.closure(_taxonomy(spark, d)),
    "taxonomy_siblings": lambda spark, d: g.siblings(_taxonomy(spark, d)),
    "communities_louvain": lambda spark, d: g.communities(_keys(spark, d), "owner_kind"),
    "communities_greedy": lambda spark, d: g.communities(_keys(spark, d), "owner_kind", "greedy"),
    "communities_per_graph": lambda spark, d: g.communities(_keys(spark, d), "graph_id"),
    "community_stability": _stability,
    "betweenness": lambda spark, d: g.betweenness(_keys(spark, d), "graph_id"),
    "eigenvector": lambda spark, d: g.eigenvector(_keys(spark, d), "graph_id"),
}

_NODES = "nd AS MATERIALIZED (" + SEQ["transition_nodes_reward_risk"].split("FROM ev WINDOW", 1)[0].split("n1 AS", 1)[0][:0]
_N = SEQ["transition_nodes_reward_risk"]
_BODY = _N[_N.index("n1 AS") : _N.index("SELECT label, min(type)")].rstrip()
_SELECT = _N[_N.index("SELECT label, min(type)") :]
_G = f"WITH RECURSIVE {EV}, {_OWN}, ed AS MATERIALIZED (SELECT source, target, count(*) AS weight, count(*) FILTER (target_ok) AS ok FROM st GROUP BY 1, 2), {_BODY}, nd AS MATERIALIZED ({_SELECT})"
_K = f"{_G}, k AS MATERIALIZED (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS p FROM ed)"
_POINTS = "CASE " + " ".join(f"WHEN contains(label || ' ' || type, '{w}') THEN {float(n)}" for w, n in g.POINTS) + " ELSE 0.0 END"
_ROOM = "CASE type " + " ".join(f"WHEN '{k}' THEN {a - b!r}" for k, (a, b) in s.DECISION_SPACE.items()) + " ELSE 0.0 END"
_TERMS = f"""tm AS MATERIALIZED (SELECT label, 0.1::DOUBLE * ({_POINTS})::DOUBLE / 4.0::DOUBLE + 0.1::DOUBLE * ({_ROOM})::DOUBLE + r + t - kk AS base, greatest(0::DOUBLE, 1::DOUBLE - r - kk - t) AS stay, kk AS risk_rate FROM
(SELECT *, coalesce(reward::DOUBLE / nullif(denom, 0), 0) AS r, coalesce(risk::DOUBLE / nullif(denom, 0), 0) AS kk, CASE WHEN type = 'submission' THEN ok_count::DOUBLE / occ ELSE 0 END AS t FROM nd))"""


def _unrolled(rounds: int = 15) -> str:
    steps = ["v0 AS (SELECT label, 0::DOUBLE AS value FROM tm)"]
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS (SELECT source AS label, sum(p * value) AS ahead FROM k JOIN v{i - 1} ON target = label GROUP BY 1), v{i} AS MATERIALIZED (SELECT tm.label, greatest(-1::DOUBLE, least(1::DOUBLE, base + 0.8::DOUBLE * stay * coalesce(ahead, 0))) AS value FROM tm LEFT JOIN a{i} ON tm.label = a{i}.label)")
    return f"{_K}, {_TERMS}, {', '.join(steps)}, val AS (SELECT label, value FROM v{rounds})"


def _ranks(rounds: int = 20) -> str:
    steps = ["n AS (SELECT count(*)::DOUBLE AS n FROM nd), pk AS MATERIALIZED (SELECT source, target, 0.5::DOUBLE * weight / sum(weight) OVER (PARTITION BY source) + 0.5::DOUBLE / count(*) OVER (PARTITION BY source) AS p FROM ed), sk AS MATERIALIZED (SELECT label FROM nd WHERE label NOT IN (SELECT source FROM ed)), r0 AS (SELECT label, 1 / n AS rank FROM nd, n)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        steps.append(f"i{i} AS (SELECT target AS label, sum(p * rank) AS into_ FROM pk JOIN {p} ON source = label GROUP BY 1), l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM {p} WHERE label IN (SELECT label FROM sk)), r{i} AS MATERIALIZED (SELECT nd.label, 0.85::DOUBLE * (coalesce(into_, 0) + lost / n) + 0.15::DOUBLE / n AS rank FROM nd LEFT JOIN i{i} ON nd.label = i{i}.label, n, l{i})")
    return f"{_G}, {', '.join(steps)} SELECT label, round(rank, 9) AS rank FROM r{rounds}"


_EV = f"{_unrolled()}, ev4 AS MATERIALIZED (SELECT source, target, weight, round(0.8::DOUBLE * round(value, 4), 4) AS edge_value FROM ed JOIN val ON target = label)"
_KEYS = r"WITH c AS (SELECT graph_id, owner_kind, trim(regexp_replace(regexp_replace(lower(trim(source_key)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS source, trim(regexp_replace(regexp_replace(lower(trim(target_key)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS target FROM graph_edges WHERE source_key IS NOT NULL AND target_key IS NOT NULL)"
_TAX = """tx AS (SELECT node_key AS child, 'type:' || type AS parent FROM technique_nodes UNION ALL SELECT node_key, 'family:' || node_type FROM technique_nodes WHERE node_type IS NOT NULL
UNION ALL SELECT a.node_key, b.node_key FROM technique_nodes a JOIN technique_nodes b ON substr(a.node_key, instr(a.node_key, ' ') + 1) = b.node_key UNION ALL SELECT DISTINCT 'family:' || node_type, 'root' FROM technique_nodes WHERE node_type IS NOT NULL)"""
_ROUTE = """rt AS (SELECT label AS start, [label] AS path, false AS done, 0 AS step FROM nd UNION ALL
SELECT start, CASE WHEN b.target IS NULL THEN path ELSE list_append(path, b.target) END, b.target IS NULL OR coalesce(b.type = 'submission', false), step + 1 FROM rt LEFT JOIN LATERAL (SELECT ed.target, nd.type FROM ed JOIN nd ON nd.label = ed.target WHERE ed.source = path[-1] AND NOT list_contains(path, ed.target) ORDER BY weight DESC, ed.target LIMIT 1) b ON true WHERE NOT done AND step < 6)"""
ORACLES = {
    "weighted_pagerank_k20": _ranks(),
    "path_to_victory_k15": f"{_unrolled()} SELECT label, round(value, 6) AS value FROM val",
    "edge_value": f"{_EV} SELECT source, target, edge_value FROM ev4",
    "continuity": f"{_K}, {_TERMS}, sf AS (SELECT k.source AS label, sum(p * (1 - risk_rate)) AS safe FROM k JOIN tm ON k.target = tm.label GROUP BY 1) SELECT tm.label, round((1 - risk_rate) * coalesce(safe, 0), 5) AS continuity FROM tm LEFT JOIN sf ON sf.label = tm.label",
    "control_score": f"{_EV} SELECT source AS label, round(avg(edge_value) - stddev_pop(edge_value), 5) AS control FROM ev4 GROUP BY 1",
    "decision_funnel": f"{_EV} SELECT k.source AS label, round(sum(CASE WHEN edge_value >= 0.15 THEN p ELSE 0 END), 5) AS funnel FROM k JOIN ev4 ON k.source = ev4.source AND k.target = ev4.target GROUP BY 1",
    "dilemmas": f"""{_EV}, gd AS MATERIALIZED (SELECT * FROM ev4 WHERE edge_value >= 0.15), fk AS (SELECT source AS node, count(*) AS branches, max(edge_value) AS best FROM gd GROUP BY 1 HAVING count(*) >= 2),
        f1 AS (SELECT DISTINCT node, target AS at_ FROM fk JOIN gd ON node = source), f2 AS (SELECT DISTINCT node, target AS at_ FROM f1 JOIN gd ON at_ = source), f3 AS (SELECT DISTINCT node, target AS at_ FROM f2 JOIN gd ON at_ = source),
        al AS (SELECT * FROM f1 UNION SELECT * FROM f2 UNION SELECT * FROM f3) SELECT fk.node, branches, best, count(*) AS reach FROM fk JOIN al ON al.node = fk.node AND al.at_ <> fk.node GROUP BY 1, 2, 3""",
    "counter_moves": f"""{_EV}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY edge_value DESC, target) AS r FROM ev4), b AS (SELECT source, target FROM rk WHERE r = 1)
        SELECT rk.source AS node, r AS rank, rk.target AS counter, edge_value AS value, weight AS count, reward_risk AS success, b.target AS leads_to FROM rk LEFT JOIN nd ON nd.label = rk.target LEFT JOIN b ON b.source = rk.target WHERE r <= 3""",
    "node_elo_deviance": f"{_unrolled()}, m AS (SELECT sum(round(value, 4) * occ) / sum(occ) AS mean FROM val JOIN nd USING (label)) SELECT label, greatest(-150, least(150, round((round(value, 4) - mean) * 200)))::INT AS deviance FROM val, m",
    "route_to_submission": f"{_G}, {_ROUTE} SELECT start, array_to_string(arg_max(path, step), ' > ') AS path FROM rt GROUP BY 1",
    "degree_strengths": f"{_G}, b AS (SELECT source AS label, 0 AS wi, weight AS wo, 0 AS di, 1 AS do_ FROM ed UNION ALL SELECT target, weight, 0, 1, 0 FROM ed) SELECT label, sum(wi)::BIGINT AS in_weight, sum(wo)::BIGINT AS out_weight, sum(di)::BIGINT AS in_degree, sum(do_)::BIGINT AS out_degree FROM b GROUP BY 1",
    "reciprocal_links": f"{_G}, q AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(CASE WHEN source < target THEN weight ELSE 0 END)::BIGINT AS forward, sum(CASE WHEN source < target THEN 0 ELSE weight END)::BIGINT AS backward FROM ed GROUP BY 1, 2) SELECT *, greatest(forward, backward) >= 2 AND NOT (least(forward, backward) >= 2 AND least(forward, backward) >= 0.34::DOUBLE * greatest(forward, backward)) AS arrow FROM q",
    "dashed_edges": f"{_G} SELECT source, target, weight, ed.ok, weight >= 5 AND nd.type IN ('submission', 'takedown', 'sweep', 'pass', 'escape') AND ed.ok / weight < 0.4::DOUBLE AS dashed FROM ed LEFT JOIN nd ON nd.label = target",
    "taxonomy_closure": f"WITH RECURSIVE {_TAX}, cl AS (SELECT DISTINCT child AS node, parent AS ancestor, 1 AS depth FROM tx UNION SELECT node, parent, depth + 1 FROM cl JOIN tx ON ancestor = child WHERE depth < 20) SELECT node, ancestor, min(depth) AS depth FROM cl GROUP BY 1, 2",
    "taxonomy_siblings": f"WITH {_TAX} SELECT a.child AS node, b.child AS sibling, count(*) AS shared FROM tx a JOIN tx b ON a.parent = b.parent AND a.child <> b.child GROUP BY 1, 2",
}
del _NODES, _KEYS
