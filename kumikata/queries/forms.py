"""Queries over written forms, classifiers' shares, signatures and names of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.functions import keys as k
from kumikata.operators import aggregates as a, ratings as r, sequences as s, vectors as v
from kumikata.operators.joins import participants
from kumikata.plans.runtime import table
from kumikata.queries.scout import QUERIES as SCOUT, ORACLES as SCOUT_SQL
from kumikata.sources.views import BOUTS, EV, bouts, events, node_key, person_key

_T = a.TYPES


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _labels(spark, d):
    return events(spark, d).groupBy(k.without_attempt(F.col("label")).alias("form")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


def _clean(spark, d):
    library = table(spark, d, "technique_nodes").select(node_key(F.col("label")).alias("form"), F.col("node_key").alias("name"), "type")
    return k.clean_labels(events(spark, d), library).groupBy("label", "type", "clean").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


def _clock(spark, d):
    """Times written as a clock, read again."""
    ev = events(spark, d).where("ts IS NOT NULL AND ts >= 0").withColumn("_s", F.floor("ts").cast("int"))
    text = F.format_string("%d:%02d", (F.col("_s") / 60).cast("int"), F.col("_s") % 60)
    return ev.groupBy("match_id").agg(F.min(k.clock_seconds(text)).alias("first"), F.max(k.clock_seconds(text)).alias("last"))


def _classes(spark, d):
    """Detector classes made of type and place, with position, side and whom they mean."""
    raw = k.detector_class(F.concat("type", F.lit(" "), (F.col("idx") % 4).cast("string")))
    position, side = k.class_parts(F.col("cls"))
    told = events(spark, d).select(raw.alias("cls"), "idx").withColumns({"position": position, "side": side})
    return told.groupBy("cls", "position", "side", k.role_actor(F.coalesce("side", F.lit("")), F.lit("top")).alias("actor"), k.frame_actor((F.col("idx") * 37) % 100, F.lit(100), F.lit("left")).alias("half")).agg(F.count("*").alias("n"))


def _aliases(spark, d):
    pairs = table(spark, d, "lutas").select(person_key(F.col("nome_no_banco")).alias("alias"), person_key(F.col("atleta")).alias("key")).where("alias IS NOT NULL AND key IS NOT NULL AND alias <> key").distinct()
    return k.aliases_of(pairs, table(spark, d, "athletes").select(person_key(F.col("name")).alias("key")))


def _variations(spark, d):
    t = table(spark, d, "technique_nodes")
    return t.select("node_key", F.explode(k.variations(F.col("label"), F.get("aliases", F.lit(0)))).alias("form"))


def _z(spark, d):
    e = table(spark, d, "graph_edges").where("source_key IS NOT NULL").select("edge_id", "graph_id", F.lower(F.trim("source_key")).alias("key"), "owner_kind", "elo")
    return a.clamped_z(e, "key", "owner_kind", "elo")


def _signatures(spark, d):
    """A graph's positions at one deviation or more above all graphs."""
    return _r(_z(spark, d).where("z >= 1").groupBy("graph_id", "key").agg(F.max("z").alias("z")), "z", digits=4)


def _kinds(spark, d):
    return _r(_z(spark, d).groupBy("owner_kind").agg(F.avg("z").alias("z"), F.count("*").alias("n")), "z")


def _centres(spark, d):
    """Each division's shares of types and how far they are from all divisions' mean."""
    ev = events(spark, d).where(F.col("actor").isNotNull() & F.col("type").isin(*_T)).join(bouts(spark, d).where("division IS NOT NULL").select("match_id", "division"), "match_id")
    u = a.shares(ev, "division", "type").groupBy("division").pivot("type", list(_T)).agg(F.first("share")).na.fill(0.0)
    means = u.agg(*[F.avg(t).alias(f"m_{t}") for t in _T]).withColumn("one", F.lit(0))
    return u.withColumn("one", F.lit(0)).join(F.broadcast(means), "one").select("division", F.array(*_T).alias("shares"), F.array(*[F.col(f"m_{t}") for t in _T]).alias("mean"), F.array(*[F.round(F.col(t) - F.col(f"m_{t}"), 9) for t in _T]).alias("deviance"))


def _next_types(spark, d):
    steps = s.transitions(events(spark, d)).groupBy("source", "target").agg(F.count("*").cast("double").alias("n"))
    kind = events(spark, d).groupBy("label").agg(F.min("type").alias("type"))
    return steps, kind


def _class_shares(spark, d):
    steps, kind = _next_types(spark, d)
    return _r(v.class_shares(steps, kind.select(F.col("label").alias("class"), F.col("type").alias("node")), "source", "target", "n"), "p")


def _reranked(spark, d):
    steps, kind = _next_types(spark, d)
    own = v.class_shares(steps, kind.select(F.col("label").alias("class"), F.col("type").alias("node")), "source", "target", "n").join(kind.select(F.col("label").alias("source"), F.col("type").alias("given")), "source")
    prior = own.groupBy("given", "node").agg(F.avg("p").alias("p"))
    return _r(v.reranked(own, prior, "source", "given"), "p", "prior", "score")


def _pooled(spark, d):
    """The win types of an athlete's opponents, weighed by bouts."""
    met = participants(bouts(spark, d).where("a <> b").select("match_id", "a", "b")).groupBy("athlete", "opponent").agg(F.count("*").alias("n"))
    mixes = SCOUT["win_type_mix"](spark, d).withColumnRenamed("winner", "opponent")
    return _r(v.pooled_mix(met, mixes, "athlete", "opponent", "n", ("submission", "points", "decision")), "submission", "points", "decision", digits=4)


def _two_runs(spark, d):
    """Ratings of the two halves of a graph's edges as two runs: where they differ by more than 100."""
    half = lambda n: table(spark, d, "graph_edges").where(F.col("edge_id") % 2 == n).groupBy("graph_id").agg(F.round(F.avg("elo"), 4).alias("elo"), F.count("elo").cast("double").alias("edges"))
    return r.compare_states(half(0), half(1), ["graph_id"], ["elo", "edges"], 100.0)


QUERIES = {
    "label_forms": _labels,
    "cleaned_labels": _clean,
    "clock_times": _clock,
    "detector_classes": _classes,
    "roster_aliases": _aliases,
    "search_variations": _variations,
    "signature_nodes": _signatures,
    "kind_deviance": _kinds,
    "archetype_names": lambda spark, d: v.archetype_names(_centres(spark, d), "division", "shares", "deviance", _T),
    "compared_vectors": lambda spark, d: _r(v.compared(_centres(spark, d), "division", "shares", "mean", _T, 0.02, 0.03), "delta"),
    "class_shares": _class_shares,
    "reranked_types": _reranked,
    "pooled_win_mix": _pooled,
    "compared_runs": _two_runs,
    "bouts_hash": lambda spark, d: r.bouts_hash(bouts(spark, d), ["match_id", "a", "b", "result", "year"]),
}
_W = f"WITH {EV}"
_KEY = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_PER = lambda c: f"nullif(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '')"
_BARE = f"trim(regexp_replace(label, '{k.ATTEMPTS}', '', 'g'))"
_ZZ = "e AS (SELECT edge_id, graph_id, lower(trim(source_key)) AS key, owner_kind, elo FROM graph_edges WHERE source_key IS NOT NULL), kk AS (SELECT key, avg(elo) AS m, stddev_pop(elo) AS s, count(elo) AS n FROM e GROUP BY 1), ff AS (SELECT owner_kind, avg(elo) AS fm, stddev_pop(elo) AS fs FROM e GROUP BY 1), z AS (SELECT e.*, greatest(-3, least(3, CASE WHEN n >= 3 AND s > 1e-9 THEN (elo - m) / s WHEN fs > 1e-9 THEN (elo - fm) / fs ELSE 0 END)) AS z FROM e LEFT JOIN kk USING (key) LEFT JOIN ff USING (owner_kind))"
_STEP = "st AS (SELECT label AS source, lead(label) OVER (PARTITION BY match_id, actor ORDER BY i) AS target FROM ev WHERE actor IS NOT NULL), kd AS (SELECT label, min(type) AS node FROM ev GROUP BY 1), pn AS (SELECT source, node, count(*)::DOUBLE AS n FROM st JOIN kd ON kd.label = target WHERE target <> source GROUP BY 1, 2), cs AS (SELECT source, node, n / sum(n) OVER (PARTITION BY source) AS p FROM pn)"
_TL = ", ".join(f"'{t}'" for t in _T)
_CEN = f"{EV}, {BOUTS}, c AS (SELECT division, type, count(*) AS n FROM ev JOIN bouts USING (match_id) WHERE actor IS NOT NULL AND division IS NOT NULL AND type IN ({_TL}) GROUP BY 1, 2), sh AS (SELECT dv.division, t.type, t.i, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY dv.division) AS share FROM (SELECT DISTINCT division FROM c) dv CROSS JOIN (SELECT unnest([{_TL}]) AS type, generate_subscripts([{_TL}], 1) AS i) t LEFT JOIN c ON c.division = dv.division AND c.type = t.type), mn AS (SELECT *, avg(share) OVER (PARTITION BY type) AS mean, round(share - avg(share) OVER (PARTITION BY type), 9) AS dev FROM sh)"
_CAP = lambda c: f"(upper({c}[1]) || {c}[2:])"
_MIX = SCOUT_SQL["win_type_mix"].split("SELECT winner, count(*)", 1)
ORACLES = {
    "label_forms": f"{_W} SELECT {_BARE} AS form, count(*) AS n, count(DISTINCT label) AS labels FROM ev GROUP BY 1",
    "cleaned_labels": f"{_W}, lb AS (SELECT {_KEY('label')} AS form, min(node_key) AS name, min(type) AS kind FROM technique_nodes GROUP BY 1), x AS (SELECT ev.label, ev.type, CASE WHEN name IS NOT NULL AND (kind IS NULL OR kind = ev.type) THEN name ELSE ev.label END AS clean FROM ev LEFT JOIN lb ON lb.form = trim(regexp_replace(ev.label, '{k.ATTEMPTS}', '', 'g'))) SELECT label, type, clean, count(*) AS n, count(*) FILTER (clean <> label) AS changed FROM x GROUP BY 1, 2, 3",
    "clock_times": f"{_W} SELECT match_id, min(floor(ts)::INT) AS first, max(floor(ts)::INT) AS last FROM ev WHERE ts >= 0 GROUP BY 1",
    "detector_classes": f"{_W}, x AS (SELECT idx % 4 AS m, type, idx FROM ev), y AS (SELECT CASE m WHEN 1 THEN type || '_top' WHEN 2 THEN type || '_bottom' ELSE type END AS cls, type AS position, CASE m WHEN 1 THEN 'top' WHEN 2 THEN 'bottom' END AS side, CASE m WHEN 1 THEN 'you' WHEN 2 THEN 'opponent' ELSE 'neutral' END AS actor, CASE WHEN idx * 37 % 100 < 50 THEN 'you' ELSE 'opponent' END AS half FROM x) SELECT cls, position, side, actor, half, count(*) AS n FROM y GROUP BY ALL",
    "roster_aliases": f"WITH p AS (SELECT DISTINCT {_PER('nome_no_banco')} AS alias, {_PER('atleta')} AS key FROM lutas) SELECT alias, key FROM p WHERE alias <> key AND key IN (SELECT {_PER('name')} FROM athletes)",
    "search_variations": "SELECT DISTINCT node_key, form FROM (SELECT node_key, unnest([lower(trim(label)), lower(trim(aliases[1]))]) AS form FROM technique_nodes) WHERE form <> ''",
    "signature_nodes": f"WITH {_ZZ} SELECT graph_id, key, round(max(z), 4) AS z FROM z WHERE z >= 1 GROUP BY 1, 2",
    "kind_deviance": f"WITH {_ZZ} SELECT owner_kind, round(avg(z), 6) AS z, count(*) AS n FROM z GROUP BY 1",
    "archetype_names": f"WITH {_CEN}, tp AS (SELECT division, string_agg({_CAP('type')}, ' / ' ORDER BY dev DESC, i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY division ORDER BY dev DESC, i) AS r FROM mn) WHERE r <= 2 AND dev > 0.001 GROUP BY 1), bs AS (SELECT division, {_CAP('type')} || '-Based' AS b FROM mn QUALIFY row_number() OVER (PARTITION BY division ORDER BY share DESC, i) = 1), nm AS (SELECT division, coalesce(t || ' Specialist', b) AS p, b FROM bs LEFT JOIN tp USING (division)), n2 AS (SELECT division, CASE WHEN count(*) OVER (PARTITION BY p) > 1 THEN p || ' · ' || b ELSE p END AS n FROM nm), n3 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY division) AS r FROM n2) SELECT division, CASE WHEN r > 1 THEN n || ' ' || r ELSE n END AS name FROM n3",
    "compared_vectors": f"WITH {_CEN}, x AS (SELECT division, type AS aspect, share - mean AS delta, greatest(share, mean) AS u FROM mn), y AS (SELECT *, CASE WHEN abs(delta) >= 0.03 THEN CASE WHEN delta > 0 THEN 'more' ELSE 'less' END WHEN abs(delta) < 0.02 AND u > 0.12 THEN 'alike' END AS verdict FROM x) SELECT division, aspect, verdict, round(delta, 6) AS delta, row_number() OVER (PARTITION BY division ORDER BY abs(delta) DESC, aspect) AS place FROM y WHERE verdict IS NOT NULL",
    "class_shares": f"{_W}, {_STEP} SELECT source, node, round(p, 6) AS p FROM cs",
    "reranked_types": f"{_W}, {_STEP}, ow AS (SELECT cs.*, kd.node AS given FROM cs JOIN kd ON kd.label = source), pr AS (SELECT given, node, avg(p) AS prior FROM ow GROUP BY 1, 2), sc AS (SELECT ow.*, prior, pow(p, 0.7::DOUBLE) * pow(prior, 0.3::DOUBLE) AS raw FROM ow JOIN pr USING (given, node)), s2 AS (SELECT *, raw / sum(raw) OVER (PARTITION BY source) AS score FROM sc) SELECT source, given, node, round(p, 6) AS p, round(prior, 6) AS prior, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY score DESC, node) AS place FROM s2",
    "pooled_win_mix": f"{_MIX[0]}, mx AS (SELECT winner AS opponent, count(*){_MIX[1]}), b2 AS (SELECT * FROM bouts WHERE a <> b), pa AS (SELECT a AS athlete, b AS opponent FROM b2 UNION ALL SELECT b, a FROM b2), mt AS (SELECT athlete, opponent, count(*)::DOUBLE AS n FROM pa GROUP BY 1, 2), g AS (SELECT athlete, sum(n * submission) / sum(n) AS submission, sum(n * points) / sum(n) AS points, sum(n * decision) / sum(n) AS decision FROM mt JOIN mx USING (opponent) GROUP BY 1) SELECT athlete, round(submission, 4) AS submission, round(points, 4) AS points, round(decision, 4) AS decision, CASE greatest(submission, points, decision) WHEN submission THEN 'submission' WHEN points THEN 'points' ELSE 'decision' END AS leading FROM g",
    "compared_runs": "WITH h AS (SELECT graph_id, edge_id % 2 AS m, round(avg(elo), 4) AS elo, count(elo)::DOUBLE AS edges FROM graph_edges GROUP BY 1, 2), j AS (SELECT coalesce(a.graph_id, b.graph_id) AS graph_id, a.elo AS e0, b.elo AS e1, a.edges AS n0, b.edges AS n1 FROM (SELECT * FROM h WHERE m = 0) a FULL JOIN (SELECT * FROM h WHERE m = 1) b USING (graph_id)), u AS (SELECT graph_id, 'elo' AS field, e0 AS first, e1 AS second FROM j UNION ALL SELECT graph_id, 'edges', n0, n1 FROM j) SELECT graph_id, field, first, second FROM u WHERE (first IS NULL) <> (second IS NULL) OR abs(first - second) > 100",
}
