"""Vectors, words and decision flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import aggregates as a
from kumikata.operators import flow
from kumikata.operators import graphs as g
from kumikata.operators import sequences as s
from kumikata.operators import vectors as v
from kumikata.plans.runtime import table
from kumikata.queries.seq import _OWN
from kumikata.queries.stat import _activity
from kumikata.sources.views import EV, events

_W = f"WITH {EV}"
_T = a.TYPES
QUERY = ["submission", "guard", "pass", "choke"]


def _r(frame, *columns, digits=5):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _knn(spark, d):
    e = _vectors(spark, d)
    return _r(v.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5), "cosine")


def _masked(spark, d):
    e = _vectors(spark, d).select("vec_id", v.masked(F.col("embedding"), 1, 32).alias("part"))
    return _r(v.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "part", 3), "cosine")


def _nearest(spark, d):
    e = _vectors(spark, d).where("embedding IS NOT NULL").withColumn("w", F.lit(1.0))
    centres = v.weighted_mean(e, "label", "embedding", "w").withColumnRenamed("label", "centre")
    return _r(v.nearest(e, "vec_id", "embedding", centres, "centre", "mean"), "distance", digits=4)


def _means(spark, d):
    e = _vectors(spark, d).withColumn("w", F.col("vec_id") % 7 + 1)
    m = v.weighted_mean(e, "label", "embedding", "w")
    return m.select("label", F.posexplode("mean").alias("dim", "x")).withColumn("x", F.round("x", 5))


def _features(spark, d):
    u = v.unit_shares(events(spark, d).where("actor IS NOT NULL"), "actor", "type", _T)
    return u.select("actor", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


def _archetypes(spark, d):
    return v.archetypes(v.unit_shares(events(spark, d).where("actor IS NOT NULL"), "actor", "type", _T), "actor", "vector")


def _structural(spark, d):
    e = s.transition_edges(events(spark, d)).where("weight >= 2")
    return _r(v.sparse_cosine(e, "source", "target", "weight", 0.5), "cosine")


def _blend(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL")
    own = a.shares(ev, "actor", "type").select("actor", "type", F.col("share").alias("p"))
    everyone = a.shares(ev.withColumn("one", F.lit(0)), "one", "type").select("type", F.col("share").alias("p"))
    base = own.select("actor").distinct().withColumn("one", F.lit(0)).join(F.broadcast(everyone.withColumn("one", F.lit(0))), "one").select("actor", "type", "p")
    return _r(v.blend(own, base, ["actor"], "type", "p"), "p", digits=6)


def _walks(spark, d):
    e = g.walk_embedding(s.transition_edges(events(spark, d)))
    return e.select("label", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 3))


def _aggregate(spark, d):
    return _r(flow.aggregate(flow.chains(events(spark, d))), "rate", digits=6)


QUERIES = {
    "knn_cosine": _knn,
    "masked_cosine": _masked,
    "cross_type_neardups": lambda spark, d: _r(v.similar_pairs(_vectors(spark, d), "vec_id", "embedding", "label", 0.3, False), "cosine"),
    "same_type_neardups": lambda spark, d: _r(v.similar_pairs(_vectors(spark, d), "vec_id", "embedding", "label", 0.3, True), "cosine"),
    "centroid_loo_cosine": lambda spark, d: _r(v.centroid_cosine(_vectors(spark, d), "vec_id", "label", "embedding"), "cosine"),
    "weighted_mean_vector": _means,
    "nearest_archetype": _nearest,
    "archetype_features": _features,
    "archetype_kmeans": _archetypes,
    "rf_importance": lambda spark, d: v.importances(_activity(spark, d), ["n", "bouts", "labels", "subs", "rate"], "wins"),
    "structural_neighbours": _structural,
    "structural_nearest": lambda spark, d: _r(v.sparse_neighbours(s.transition_edges(events(spark, d)), "source", "target", "weight"), "cosine"),
    "distribution_blend": _blend,
    "tfidf_search": lambda spark, d: _r(v.search(v.tfidf(table(spark, d, "documents"), "doc_id", "text"), "doc_id", QUERY, 20), "score"),
    "walk_embedding": _walks,
    "chain_patterns": lambda spark, d: flow.chains(events(spark, d)),
    "aggregate_patterns": _aggregate,
    "window_patterns": lambda spark, d: flow.windows(events(spark, d)).groupBy("action", "condition", "response").agg(F.count("*").alias("n")),
    "decision_criteria": lambda spark, d: _r(flow.criteria(flow.chains(events(spark, d), opponents=True)), "p_with", "p_without", "effect", "effect_lo", "effect_hi", "lift", "p", "q", "success_rate", digits=6),
    "flowchart_tree": lambda spark, d: flow.tree(flow.aggregate(flow.chains(events(spark, d)))),
    "condition_bundles": lambda spark, d: flow.chains(events(spark, d)).groupBy("condition").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors")),
    "density_clusters": lambda spark, d: v.density_clusters(_vectors(spark, d), "vec_id", "embedding", 0.3),
    "next_move_prior": lambda spark, d: _r(v.next_moves(s.transitions(events(spark, d, by_bout=True)), "actor"), "p", digits=8),
    "held_positions": lambda spark, d: flow.positions(events(spark, d)).groupBy("held", "type").agg(F.count("*").alias("n")),
}
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
_U = f"{_W}, c AS (SELECT actor, {', '.join(f'count(*) FILTER (type = {chr(39)}{x}{chr(39)})::DOUBLE AS c{i}' for i, x in enumerate(_T))} FROM ev WHERE actor IS NOT NULL AND type IN ({', '.join(repr(x) for x in _T)}) GROUP BY 1), l AS (SELECT actor, [{', '.join(f'c{i}' for i in range(len(_T)))}] AS v, sqrt({' + '.join(f'c{i} * c{i}' for i in range(len(_T)))}) AS n FROM c)"
_C = "CASE " + " ".join(f"WHEN contains(label || ' ' || type, '{w}') THEN '{c}'" for w, c in flow.CONDITIONS) + " ELSE 'other' END"
_CH = f"""ow AS (SELECT match_id, actor, i, lag(label) OVER w AS position, label AS action, lead(label) OVER w AS response, lead(ok) OVER w AS success, lead(i) OVER w AS j FROM ev WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY match_id, actor ORDER BY i)),
bt AS (SELECT ow.match_id, ow.actor, ow.i, {_C} AS c, min(ev.i) AS k FROM ow JOIN ev ON ev.match_id = ow.match_id AND ev.i > ow.i AND ev.i < ow.j AND ev.actor IS NOT NULL WHERE response IS NOT NULL GROUP BY 1, 2, 3, 4),
b2 AS (SELECT match_id, actor, i, array_to_string(list_sort(list(c)), '-and-') AS condition FROM (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY match_id, actor, i ORDER BY k) <= 2) GROUP BY 1, 2, 3),
ch AS (SELECT ow.match_id, ow.actor, ow.i::INT AS i, position, action, condition, response, success FROM ow LEFT JOIN b2 USING (match_id, actor, i) WHERE response IS NOT NULL)"""
_CH = _CH.replace("contains(label ||", "contains(ev.label ||").replace("|| type,", "|| ev.type,")
_AG = "ag AS (SELECT action, condition, response, count(*) AS n, count(DISTINCT match_id) AS bouts, count(success) AS resolved, count(*) FILTER (success) AS successes, array_to_string(list_sort(list(DISTINCT match_id))[1:8], ',') AS evidence FROM ch GROUP BY 1, 2, 3)"
_TF = r"tm AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2), df AS (SELECT term, ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1), ti AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term)), nn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM ti GROUP BY 1)"
_CONDITION = "CASE " + " ".join(f"WHEN contains(concat_ws(' ', o.label, o.type), '{w}') THEN '{c}'" for w, c in flow.CONDITIONS) + " ELSE 'other' END"
ORACLES = {
    "knn_cosine": f"WITH {_E}, p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query, neighbour, round(c, 5) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour)::INT AS rank FROM p QUALIFY rank <= 5",
    "masked_cosine": f"WITH {_E}, p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.x[1:32], b.x[1:32]) AS c FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query, neighbour, round(c, 5) AS cosine, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, neighbour)::INT AS rank FROM p QUALIFY rank <= 3",
    "cross_type_neardups": f"WITH {_E} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.x, b.x), 5) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label AND list_cosine_similarity(a.x, b.x) >= 0.3",
    "same_type_neardups": f"WITH {_E} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.x, b.x), 5) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label = b.label AND list_cosine_similarity(a.x, b.x) >= 0.3",
    "centroid_loo_cosine": f"WITH {_E}, d AS (SELECT label, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM e), s AS (SELECT label, list(s ORDER BY k) AS s FROM (SELECT label, k, sum(x) AS s FROM d GROUP BY 1, 2) GROUP BY 1), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1) SELECT vec_id, label, CASE WHEN n > 1 THEN round(list_cosine_similarity(x, list_transform(list_zip(s, x), lambda z: z[1] - z[2])), 5) END AS cosine FROM e JOIN s USING (label) JOIN n USING (label)",
    "weighted_mean_vector": f"WITH {_E}, d AS (SELECT label, vec_id % 7 + 1 AS w, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS dim FROM e) SELECT label, dim::INT AS dim, round(sum(w * x) / sum(w), 5) AS x FROM d GROUP BY 1, 2",
    "nearest_archetype": f"WITH {_E}, d AS (SELECT label, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM e), m AS (SELECT label AS centre, list(m ORDER BY k) AS m FROM (SELECT label, k, avg(x) AS m FROM d GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, centre, round(list_distance(x, m), 4) AS distance FROM e CROSS JOIN m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(x, m), 9), centre) = 1",
    "archetype_features": f"{_U} SELECT actor, (generate_subscripts(v, 1) - 1)::INT AS dim, round(unnest(v) / n, 6) AS x FROM l",
    "structural_neighbours": f"{_W}, {_OWN}, ed AS (SELECT source, target, count(*)::DOUBLE AS w FROM st GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT source, target, w / sqrt(sum(w * w) OVER (PARTITION BY source)) AS u FROM ed) SELECT x.source AS a, y.source AS b, round(sum(x.u * y.u), 5) AS cosine FROM u x JOIN u y ON x.target = y.target AND x.source < y.source GROUP BY 1, 2 HAVING sum(x.u * y.u) >= 0.5",
    "distribution_blend": f"{_W}, o AS (SELECT actor, type, count(*) / sum(count(*)) OVER (PARTITION BY actor) AS p FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), w AS (SELECT type, count(*) / sum(count(*)) OVER () AS p FROM ev WHERE actor IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT actor FROM o), r AS (SELECT k.actor, w.type, sqrt(greatest(coalesce(o.p, 0), 1e-6)) * sqrt(greatest(w.p, 1e-6)) AS raw FROM k CROSS JOIN w LEFT JOIN o ON o.actor = k.actor AND o.type = w.type) SELECT actor, type, round(raw / sum(raw) OVER (PARTITION BY actor), 6) AS p FROM r",
    "tfidf_search": f"WITH {_TF} SELECT doc_id, round(sum(w / n) / sqrt(4), 5) AS score FROM ti JOIN nn USING (doc_id) WHERE term IN ({', '.join(repr(q) for q in QUERY)}) GROUP BY 1 ORDER BY round(sum(w / n) / sqrt(4), 9) DESC, doc_id LIMIT 20",
    "chain_patterns": f"{_W}, {_CH} SELECT * FROM ch",
    "aggregate_patterns": f"{_W}, {_CH}, {_AG} SELECT *, round((successes + 1) / (resolved + 2), 6) AS rate FROM ag",
    "flowchart_tree": f"{_W}, {_CH}, {_AG}, f AS (SELECT action, condition, sum(n) AS cn FROM ag WHERE condition IS NOT NULL GROUP BY 1, 2), f2 AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY cn DESC, condition) AS branch FROM f) SELECT action, condition, response, branch::INT AS branch, row_number() OVER (PARTITION BY action, condition ORDER BY n DESC, response)::INT AS answer, n FROM ag JOIN f2 USING (action, condition) WHERE branch <= 3 QUALIFY answer <= 2",
    "condition_bundles": f"{_W}, {_CH} SELECT condition, count(*) AS n, count(DISTINCT actor) AS actors FROM ch GROUP BY 1",
    "next_move_prior": f"{_W}, {_OWN}, o AS (SELECT actor, source, target, count(*) / sum(count(*)) OVER (PARTITION BY actor, source) AS p FROM st GROUP BY 1, 2, 3), q AS (SELECT source, target, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM st GROUP BY 1, 2), k AS (SELECT DISTINCT actor, source FROM o), r AS (SELECT k.actor, k.source, q.target, sqrt(greatest(coalesce(o.p, 0), 1e-6)) * sqrt(greatest(q.p, 1e-6)) AS raw FROM k JOIN q ON q.source = k.source LEFT JOIN o ON o.actor = k.actor AND o.source = k.source AND o.target = q.target), n AS (SELECT actor, source, target, raw / sum(raw) OVER (PARTITION BY actor, source) AS p FROM r) SELECT actor, source, row_number() OVER (PARTITION BY actor, source ORDER BY round(p, 9) DESC, target)::INT AS rank, target, round(p, 8) AS p FROM n QUALIFY rank <= 3",
    "held_positions": f"{_W}, h AS (SELECT type, last_value(CASE WHEN type IN ('control', 'guard') THEN label END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY i) AS held FROM ev) SELECT held, type, count(*) AS n FROM h GROUP BY 1, 2",
    "window_patterns": f"""{_W}, nt AS (SELECT *, count(*) FILTER (actor IS NULL) OVER (PARTITION BY match_id ORDER BY i) AS part FROM ev),
w AS (SELECT match_id, part, actor, i, label AS action, lead(label) OVER o AS response, lead(i) OVER o AS j FROM nt WHERE actor IS NOT NULL WINDOW o AS (PARTITION BY match_id, part, actor ORDER BY i)),
cs AS (SELECT w.match_id, w.actor, w.i, {_CONDITION} AS c, min(o.i) AS k FROM w JOIN nt o ON o.match_id = w.match_id AND o.part = w.part AND o.actor <> w.actor AND o.i > w.i AND o.i < w.j AND o.i <= w.i + 3 GROUP BY ALL),
c2 AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY match_id, actor, i ORDER BY k) <= 2), cn AS (SELECT match_id, actor, i, string_agg(c, '-and-' ORDER BY c) AS condition FROM c2 GROUP BY ALL)
SELECT action, condition, response, count(*) AS n FROM w LEFT JOIN cn USING (match_id, actor, i) WHERE response IS NOT NULL GROUP BY 1, 2, 3""",
}
