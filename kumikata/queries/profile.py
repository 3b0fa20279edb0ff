"""Athletes beside each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import aggregates as a
from kumikata.operators import flow, graphs, profiles
from kumikata.operators import sequences as s
from kumikata.operators import vectors as v
from kumikata.functions.text import fold
from kumikata.plans.runtime import table
from kumikata.queries.graph import _keys
from kumikata.queries.seq import _OWN
from kumikata.queries.vec import _CH
from kumikata.sources.views import BOUTS, EV, bouts, decided, events, node_key, person_key

_W = f"WITH {EV}"
_T = a.TYPES
AXES = {"takedown": "standing", "guard": "guard", "sweep": "guard", "pass": "passing", "control": "top", "submission": "finish", "escape": "escape"}
_AXES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in AXES.items()) + " END"


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _acting(spark, d):
    return events(spark, d).where("actor IS NOT NULL")


def _counts(spark, d):
    return _acting(spark, d).groupBy("actor", "label").agg(F.count("*").alias("n"))


def _met(spark, d):
    return bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _positions(spark, d):
    return _r(profiles.overlaps(_met(spark, d), profiles.top_sets(_counts(spark, d), "actor", "label", "n", 8), "actor"), "jaccard")


def _transitions(spark, d):
    steps = s.transitions(_acting(spark, d)).select("actor", F.concat_ws(" > ", "source", "target").alias("step")).distinct()
    sets = steps.groupBy("actor").agg(F.collect_list("step").alias("items"))
    return _r(profiles.overlaps(_met(spark, d), sets, "actor"), "jaccard")


def _systems(spark, d):
    edges = s.transitions(_acting(spark, d)).groupBy("actor", "source", "target").agg(F.count("*").alias("weight"))
    kinds = _acting(spark, d).groupBy("label").agg(F.min("type").alias("type"))
    return _r(profiles.systems(edges, kinds, "actor"), "share")


def _lineage(spark, d):
    keys = _keys(spark, d)
    old, new = (graphs.communities(keys.where(F.col("owner_kind") == kind), "owner_kind").select("community", "members") for kind in ("user", "athlete"))
    return _r(profiles.lineage(old, new, 0.05), "jaccard")


def _dossier(spark, d):
    won = decided(spark, d)
    sides = won.select(F.col("winner").alias("athlete"), F.lit(1).alias("won"), (F.col("method") == "SUBMISSION").cast("int").alias("finish"), "year").unionByName(won.select(F.col("loser").alias("athlete"), F.lit(0).alias("won"), F.lit(0).alias("finish"), "year"))
    record = sides.groupBy("athlete").agg(F.count("*").alias("bouts"), F.sum("won").alias("wins"), F.sum("finish").alias("finishes"), F.min("year").alias("since"))
    best = profiles.top_sets(_counts(spark, d), "actor", "label", "n", 3).select(F.col("actor").alias("athlete"), F.array_join("items", ", ").alias("signatures"))
    return record.join(best, "athlete", "left")


def _duplicates(spark, d):
    names = table(spark, d, "lutas").select(F.nullif(node_key(fold(F.col("atleta"))), F.lit("")).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    return profiles.duplicates(names, "name", "n", 3)


def _cache(spark, d):
    b = bouts(spark, d)
    return b.select("match_id", F.substring(F.sha2(F.concat_ws("|", "match_id", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("method", F.lit("")), F.lit("v1")), 256), 1, 16).alias("cache_key"))


def _classifier(spark, d):
    vectors = v.unit_shares(_acting(spark, d), "actor", "type", _T)
    main = a.majority(decided(spark, d).select(F.col("winner").alias("actor"), "method"), "actor", "method", ("SUBMISSION", "POINTS"))
    return _r(profiles.cross_validated(vectors.join(main, "actor"), "vector", "method", "actor"), "accuracy")


QUERIES = {
    "type_benchmark": lambda spark, d: _r(profiles.type_benchmark(a.density(_acting(spark, d), "actor", "type", _T), "actor", "type"), "share", "mean", "gap"),
    "technique_benchmark": lambda spark, d: profiles.technique_benchmark(_counts(spark, d), "actor", "label"),
    "compare_positions": _positions,
    "compare_transitions": _transitions,
    "athlete_systems": _systems,
    "community_lineage": _lineage,
    "decision_eligibility": lambda spark, d: profiles.eligible(flow.chains(events(spark, d)), "actor"),
    "athlete_dossier": _dossier,
    "duplicate_candidates": _duplicates,
    "radar_rings": lambda spark, d: _r(profiles.rings(_acting(spark, d), AXES), "share", "rate"),
    "cache_keys": _cache,
    "grouped_validation": _classifier,
}
_MET = "mt AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"
_OVER = "SELECT mt.a, mt.b, len(list_intersect(coalesce(x.items, []), coalesce(y.items, [])))::INT AS shared, round(CASE WHEN len(list_distinct(list_concat(coalesce(x.items, []), coalesce(y.items, [])))) = 0 THEN 1 ELSE len(list_intersect(coalesce(x.items, []), coalesce(y.items, []))) / len(list_distinct(list_concat(coalesce(x.items, []), coalesce(y.items, [])))) END, 6) AS jaccard FROM mt LEFT JOIN st2 x ON x.actor = mt.a LEFT JOIN st2 y ON y.actor = mt.b"
_TOP = "c8 AS (SELECT actor, label, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), t8 AS (SELECT * FROM c8 QUALIFY row_number() OVER (PARTITION BY actor ORDER BY n DESC, label) <= {k}), st2 AS (SELECT actor, list(label ORDER BY label) AS items FROM t8 GROUP BY 1)"
_TYPES = ", ".join(f"'{x}'" for x in _T)
ORACLES = {
    "type_benchmark": f"{_W}, k AS (SELECT DISTINCT actor FROM ev WHERE actor IS NOT NULL AND type IN ({_TYPES})), t AS (SELECT unnest([{_TYPES}]) AS type), c AS (SELECT actor, type, count(*) AS n FROM ev WHERE actor IS NOT NULL AND type IN ({_TYPES}) GROUP BY 1, 2), h AS (SELECT k.actor, t.type, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.actor) AS share FROM k CROSS JOIN t LEFT JOIN c ON c.actor = k.actor AND c.type = t.type) SELECT actor, type, round(share, 6) AS share, round(avg(share) OVER (PARTITION BY type), 6) AS mean, round(share - avg(share) OVER (PARTITION BY type), 6) AS gap FROM h",
    "technique_benchmark": f"{_W}, c AS (SELECT actor, label, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), r AS (SELECT actor, label, n / sum(n) OVER (PARTITION BY actor) AS own, sum(n) OVER (PARTITION BY label) AS t, sum(n) OVER () AS al FROM c), q AS (SELECT actor, label, round(own / (t / al), 6) AS ratio FROM r WHERE t >= 5), m AS (SELECT actor, first(label ORDER BY ratio DESC, label) AS most, max(ratio) AS most_ratio, first(label ORDER BY ratio, label) AS least, min(ratio) AS least_ratio FROM q GROUP BY 1) SELECT * FROM m",
    "compare_positions": f"WITH {EV}, {BOUTS}, {_MET}, {_TOP.format(k=8)} {_OVER}",
    "compare_transitions": f"WITH {EV}, {BOUTS}, {_OWN}, {_MET}, st2 AS (SELECT actor, list(DISTINCT source || ' > ' || target) AS items FROM st GROUP BY 1) {_OVER}",
    "decision_eligibility": f"{_W}, {_CH}, g AS (SELECT actor, count(DISTINCT match_id) AS bouts, count(*) AS patterns, count(DISTINCT condition) AS conditions, count(DISTINCT action) AS branches FROM ch WHERE condition IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN bouts < 3 THEN 'too few bouts' WHEN patterns < 5 THEN 'too few patterns' WHEN conditions < 2 THEN 'too few conditions' WHEN branches < 2 THEN 'too few branches' ELSE 'eligible' END AS reason FROM g",
    "athlete_dossier": f"WITH {EV}, {BOUTS}, {_TOP.format(k=3)}, s AS (SELECT winner AS athlete, 1 AS won, (method = 'SUBMISSION')::INT AS finish, year FROM won UNION ALL SELECT loser, 0, 0, year FROM won), g AS (SELECT athlete, count(*) AS bouts, sum(won)::BIGINT AS wins, sum(finish)::BIGINT AS finishes, min(year) AS since FROM s GROUP BY 1) SELECT g.*, array_to_string(items, ', ') AS signatures FROM g LEFT JOIN st2 ON st2.actor = athlete",
    "duplicate_candidates": r"WITH n AS (SELECT nullif(trim(regexp_replace(regexp_replace(lower(trim(strip_accents(atleta))), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '') AS name, count(*) AS n FROM lutas GROUP BY 1), w AS (SELECT name, n, unnest(list_distinct(string_split(name, ' '))) AS w FROM n WHERE name IS NOT NULL) SELECT DISTINCT x.name AS a, y.name AS b, x.n AS n_a, y.n AS n_b, levenshtein(x.name, y.name)::INT AS edits FROM w x JOIN w y ON x.w = y.w AND length(x.w) >= 3 AND x.name < y.name AND levenshtein(x.name, y.name) <= 3",
    "radar_rings": f"{_W}, x AS (SELECT {_AXES} AS axis, actor, ok FROM ev WHERE actor IS NOT NULL) SELECT axis, count(*) AS events, count(DISTINCT actor) AS contributors, round(avg(ok::INT), 6) AS rate, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x WHERE axis IS NOT NULL GROUP BY 1",
    "cache_keys": f"WITH {BOUTS} SELECT match_id, substr(sha256(concat_ws('|', match_id, coalesce(a, ''), coalesce(b, ''), coalesce(year::VARCHAR, ''), coalesce(method, ''), 'v1')), 1, 16) AS cache_key FROM bouts",
}
