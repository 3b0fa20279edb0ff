"""Joins, upserts and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import joins as j
from kumikata.plans.runtime import small, table
from kumikata.sources.views import BOUTS, EV, bouts, decided, events, person_key

_W, _B = f"WITH {EV}", f"WITH {BOUTS}"
#: Rule windows by division: when points for and against count; the last has no end.
RULES = [("ABS", 0.0, 300.0, "first"), ("ABS", 300.0, None, "rest"), ("-60 kg", 0.0, 120.0, "first"), ("-60 kg", 120.0, 240.0, "second"), ("-60 kg", 240.0, None, "rest"), ("65 kg", 60.0, 180.0, "middle")]
_RULES = "ru(division, start, stop, name) AS (VALUES " + ", ".join(f"('{d}', {s}::DOUBLE, {'NULL' if e is None else e}, '{n}')" for d, s, e, n in RULES) + ")"


def _windows(spark, d):
    rules = small(spark.createDataFrame(RULES, "division string, start double, end double, name string"))
    timed = events(spark, d).where("ts IS NOT NULL").join(bouts(spark, d).select("match_id", "division"), "match_id").select("match_id", "i", "division", "ts")
    return j.range_join(timed, rules, "division", "ts", 60.0).groupBy("division", "name").agg(F.count("*").alias("events"), F.count_distinct("match_id").alias("bouts"))


def _asof(spark, d):
    ev = events(spark, d)
    subs = ev.where("type = 'submission'").select("match_id", "i", "label")
    return j.as_of(subs, ev.where("type IN ('control', 'guard')").select("match_id", "i", F.col("label").alias("position")), "match_id", "i", ["position"])


def _roster(spark, d):
    return table(spark, d, "roster_records").select("record_id", person_key(F.col("athlete")).alias("athlete"), person_key(F.col("opp")).alias("opp"), "year", "method", F.upper(F.trim("wl")).alias("wl"), "source", "updated_at")


def _years(spark, d):
    ours = bouts(spark, d).where("year IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select(j.pair_key("a", "b").alias("pair"), "year")
    theirs = _roster(spark, d).where("year >= 1990 AND opp IS NOT NULL").select(j.pair_key("athlete", "opp").alias("pair"), "year")
    told = j.reconcile_years(ours, theirs)
    return told.select("pair", F.array_join("ours", ",").alias("ours"), F.array_join("theirs", ",").alias("theirs"), "suggested")


def _timeline(spark, d):
    ev = events(spark, d)
    left = ev.where("actor IS NOT NULL").select("match_id", "i", "label", "actor")
    right = ev.where("actor IS NOT NULL AND ts IS NOT NULL").select("match_id", F.col("i").alias("j"), "label", "actor", "ts")
    return j.ordinal_match(left, right, ["match_id", "label", "actor"], "i", "j", ["ts"]).select("match_id", "i", "ts")


def _upsert(spark, d):
    r = table(spark, d, "roster_records").select("athlete", "opp", "source", "updated_at", "record_id")
    return j.upsert(r.where("source <> 'manual'"), r.where("source = 'manual'"), ["athlete", "opp"], "updated_at", ties=("record_id",)).select("athlete", "opp", "source")


def _identities(spark, d):
    names = table(spark, d, "match_events").where("actor IS NOT NULL").groupBy("actor").agg(F.count("*").alias("n"))
    return j.merge_identities(names.withColumn("key", person_key(F.col("actor"))).where("key IS NOT NULL"), ["key"], "actor", [-F.col("n"), F.col("actor")])


def _remap(spark, d):
    e = table(spark, d, "graph_edges").where("source_key IS NOT NULL AND target_key IS NOT NULL").select(F.col("source_key").alias("source"), F.col("target_key").alias("target"), F.lit(1).cast("long").alias("n"))
    keys = e.select(F.col("source").alias("key")).union(e.select("target")).distinct()
    return j.remap_edges(e, keys.select("key", F.trim(F.lower("key")).alias("canonical")), ["n"])


def _clusters(spark, d):
    """Library entries whose keys are one edit apart, as components; candidates share a word."""
    t = table(spark, d, "technique_nodes").select(F.col("node_key").alias("node"))
    words = t.select("node", F.explode(F.split("node", " ")).alias("w"))
    pairs = words.alias("x").join(words.alias("y"), F.expr("x.w = y.w AND x.node < y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().where(F.levenshtein("a", "b") <= 4)
    return j.merge_components(pairs, t)


def _opponents(spark, d):
    known = table(spark, d, "athletes").select(person_key(F.col("name")).alias("athlete"))
    b = j.participants(bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL").select("match_id", "a", "b", "year"))
    return j.unlike(b, known, ["athlete"]).groupBy("athlete").agg(F.count("*").alias("bouts"))


QUERIES = {
    "participant_explode_join": lambda spark, d: j.participants(bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL").select("match_id", "a", "b")).join(table(spark, d, "athletes").select(person_key(F.col("name")).alias("athlete"), "athlete_id"), "athlete").groupBy("athlete_id").agg(F.count("*").alias("bouts"), F.count_distinct("opponent").alias("opponents")),
    "belt_left_join": lambda spark, d: decided(spark, d).join(table(spark, d, "athletes").select(person_key(F.col("name")).alias("winner"), "belt"), "winner", "left").groupBy("belt").agg(F.count("*").alias("wins"), F.count_distinct("winner").alias("winners")),
    "roster_anti_join": _opponents,
    "rule_window_range_join": _windows,
    "mirror_bout_dedupe": lambda spark, d: j.mirrors(_roster(spark, d).where("year >= 1990 AND opp IS NOT NULL").withColumn("pair", j.pair_key("athlete", "opp")), ["pair", "year"], "record_id", "wl", "W", "L").select("record_id", "pair", "year", "wl"),
    "asof_last_position": lambda spark, d: _asof(spark, d).select("match_id", "i", "label", "position"),
    "pair_year_reconcile": _years,
    "fuzzy_name_theta": lambda spark, d: j.suspects(bouts(spark, d).select(F.col("a").alias("name")), table(spark, d, "athletes").select(person_key(F.col("name")).alias("name")), "name"),
    "timeline_greedy_match": _timeline,
    "neardup_components": _clusters,
    "latest_wins_upsert": _upsert,
    "keyed_identity_merge": _identities,
    "remap_map_edges": _remap,
}
_R = r"r AS (SELECT record_id, nullif(trim(regexp_replace(lower(athlete), '\s+', ' ', 'g')), '') AS athlete, nullif(trim(regexp_replace(lower(opp), '\s+', ' ', 'g')), '') AS opp, year, upper(trim(wl)) AS wl FROM roster_records)"
_A = r"ka AS (SELECT *, nullif(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '') AS athlete FROM athletes)"
ORACLES = {
    "participant_explode_join": f"{_B}, {_A}, s AS (SELECT a AS athlete, b AS opponent FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b, a FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL) SELECT athlete_id, count(*) AS bouts, count(DISTINCT opponent) AS opponents FROM s JOIN ka USING (athlete) GROUP BY 1",
    "belt_left_join": f"{_B}, {_A} SELECT belt, count(*) AS wins, count(DISTINCT winner) AS winners FROM won LEFT JOIN ka ON athlete = winner GROUP BY 1",
    "roster_anti_join": f"{_B}, {_A}, s AS (SELECT a AS athlete FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL) SELECT athlete, count(*) AS bouts FROM s WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.athlete = s.athlete) GROUP BY 1",
    "rule_window_range_join": f"WITH {EV}, {BOUTS}, {_RULES} SELECT ru.division, name, count(*) AS events, count(DISTINCT ev.match_id) AS bouts FROM ev JOIN bouts ON bouts.match_id = ev.match_id JOIN ru ON ru.division = bouts.division AND ts >= start AND (stop IS NULL OR ts < stop) GROUP BY 1, 2",
    "mirror_bout_dedupe": f"WITH {_R}, p AS (SELECT *, least(athlete, opp) || ' | ' || greatest(athlete, opp) AS pair FROM r WHERE year >= 1990 AND opp IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY pair, year, wl ORDER BY record_id) AS k FROM p) SELECT record_id, pair, year, wl FROM n WHERE NOT coalesce(wl = 'L' AND EXISTS (SELECT 1 FROM n w WHERE w.pair = n.pair AND w.year = n.year AND w.wl = 'W' AND w.k = n.k), false)",
    "asof_last_position": f"{_W}, s AS (SELECT match_id, i, label FROM ev WHERE type = 'submission'), p AS (SELECT match_id, i, label AS position FROM ev WHERE type IN ('control', 'guard')) SELECT s.match_id, s.i::INT AS i, label, position FROM s ASOF LEFT JOIN p ON s.match_id = p.match_id AND s.i >= p.i",
    "pair_year_reconcile": f"WITH {BOUTS}, {_R}, o AS (SELECT least(a, b) || ' | ' || greatest(a, b) AS pair, list_sort(list(DISTINCT year)) AS ours FROM bouts WHERE year IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1), t AS (SELECT least(athlete, opp) || ' | ' || greatest(athlete, opp) AS pair, list_sort(list(DISTINCT year)) AS theirs FROM r WHERE year >= 1990 AND opp IS NOT NULL GROUP BY 1) SELECT pair, array_to_string(ours, ',') AS ours, array_to_string(theirs, ',') AS theirs, CASE WHEN len(ours) = 1 AND len(theirs) = 1 THEN theirs[1] END AS suggested FROM o JOIN t USING (pair) WHERE ours <> theirs",
    "fuzzy_name_theta": f"{_B}, {_A}, x AS (SELECT DISTINCT a FROM bouts WHERE a IS NOT NULL), y AS (SELECT DISTINCT athlete AS b FROM ka WHERE athlete IS NOT NULL) SELECT a, b FROM x JOIN y ON string_split(a, ' ')[-1] = string_split(b, ' ')[-1] AND substr(string_split(a, ' ')[1], 1, 2) = substr(string_split(b, ' ')[1], 1, 2) AND a <> b",
    "timeline_greedy_match": f"{_W}, l AS (SELECT match_id, i, label, actor, row_number() OVER (PARTITION BY match_id, label, actor ORDER BY i) AS k FROM ev WHERE actor IS NOT NULL), t AS (SELECT match_id, label, actor, ts, row_number() OVER (PARTITION BY match_id, label, actor ORDER BY i) AS k FROM ev WHERE actor IS NOT NULL AND ts IS NOT NULL) SELECT l.match_id, l.i::INT AS i, ts FROM l LEFT JOIN t USING (match_id, label, actor, k)",
    "neardup_components": "WITH RECURSIVE e AS (SELECT a.node_key AS a, b.node_key AS b FROM technique_nodes a JOIN technique_nodes b ON a.node_key <> b.node_key AND levenshtein(a.node_key, b.node_key) <= 4 AND len(list_intersect(string_split(a.node_key, ' '), string_split(b.node_key, ' '))) > 0), c AS (SELECT node_key AS node, node_key AS component FROM technique_nodes UNION SELECT e.b, c.component FROM c JOIN e ON e.a = c.node) SELECT node, min(component) AS component FROM c GROUP BY 1",
    "latest_wins_upsert": "SELECT athlete, opp, source FROM roster_records QUALIFY row_number() OVER (PARTITION BY athlete, opp ORDER BY updated_at DESC, (source = 'manual') DESC, record_id) = 1",
    "keyed_identity_merge": r"WITH n AS (SELECT actor, nullif(trim(regexp_replace(lower(actor), '\s+', ' ', 'g')), '') AS key, count(*) AS n FROM match_events WHERE actor IS NOT NULL GROUP BY 1) SELECT actor, first_value(actor) OVER (PARTITION BY key ORDER BY n DESC, actor) AS canonical FROM n WHERE key IS NOT NULL",
    "remap_map_edges": "SELECT trim(lower(source_key)) AS source, trim(lower(target_key)) AS target, count(*) AS n FROM graph_edges WHERE source_key IS NOT NULL AND target_key IS NOT NULL AND trim(lower(source_key)) <> trim(lower(target_key)) GROUP BY 1, 2",
}
