"""Aggregations, pivots, cubes and cards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumikata.operators import aggregates as a
from kumikata.plans.runtime import table
from kumikata.sources.views import BOUTS, EV, bouts, decided, events, person_key

_W, _B = f"WITH {EV}", f"WITH {BOUTS}"
_T = a.TYPES
STAGES = {"R1": 1, "8F": 2, "4F": 3, "SF": 4, "3RD": 4, "F": 5}
_DEPTH = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STAGES.items()) + " ELSE 1 END"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN '{n}'" for n, p in a.FAMILIES) + " END"


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _subs(spark, d):
    return bouts(spark, d).where("submission <> '' AND year IS NOT NULL").select("year", "submission")


def _trend(spark, d):
    subs = _subs(spark, d)
    return _r(a.shares(subs.join(a.top_items(subs, "submission", 10), "submission", "left_semi"), "year", "submission"), "share")


def _own_subs(spark, d):
    return events(spark, d).where("type = 'submission' AND actor IS NOT NULL").select("actor", F.col("label").alias("submission"))


def _user_vs_pro(spark, d):
    own = a.shares(_own_subs(spark, d), "actor", "submission")
    return _r(a.against(own, a.baseline(_subs(spark, d), "year", "submission"), "submission"), "share", "baseline", "ratio")


def _teams(spark, d):
    team = table(spark, d, "athletes").select(person_key(F.col("name")).alias("winner"), "team", "division", "belt")
    return decided(spark, d).drop("division").join(team, "winner", "left")


def _effect(spark, d):
    rows = bouts(spark, d).where("submission <> '' AND year IS NOT NULL")
    depth = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in STAGES.items()], F.lit(1))
    told = rows.groupBy("submission").agg(F.count("*").alias("n"), F.avg(depth).alias("depth"), F.count_distinct("division").alias("divisions"), F.avg((F.coalesce(F.col("stage"), F.lit("")) == "F").cast("double")).alias("finals"), (F.max("year") - F.min("year") + 1).alias("span"))
    most = told.agg(*[F.max(c).alias(f"_{c}") for c in ("n", "depth", "divisions", "span")]).withColumn("_one", F.lit(0))
    told = told.withColumn("_one", F.lit(0)).join(F.broadcast(most), "_one")
    part = lambda c: F.col(c) / F.col(f"_{c}")
    return _r(told.withColumn("score", 0.4 * part("n") + 0.25 * part("depth") + 0.15 * part("divisions") + 0.1 * F.col("finals") + 0.1 * part("span")), "depth", "finals", "score").select("submission", "n", "depth", "divisions", "finals", "span", "score")


def _style(spark, d):
    return a.density(events(spark, d).where("actor IS NOT NULL"), "actor", "type", _T)


def _style_quartiles(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL")
    many = ev.groupBy("actor").agg(F.count_distinct("match_id").alias("b")).where("b >= 3").select("actor")
    return _r(a.quartiles(a.density(ev.join(many, "actor", "left_semi"), "actor", "type", _T), "type", "share"), "p25", "median", "p75")


def _responses(spark, d):
    w = Window.partitionBy("match_id").orderBy("i")
    told = events(spark, d).where("actor IS NOT NULL").withColumns({"then": F.lead("type").over(w), "label_then": F.lead("label").over(w), "who": F.lead("actor").over(w)})
    return a.shares(told.where("ok = true AND who <> actor").select(F.col("type").alias("situation"), F.col("then").alias("response")), "situation", "response").transform(lambda f: _r(f, "share"))


def _defense(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL AND ok IS NOT NULL")
    weight = decided(spark, d).groupBy(F.col("winner").alias("actor")).agg((F.count("*") + 1).alias("w"))
    told = ev.join(weight, "actor", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    return _r(told.groupBy("type").agg(F.count("*").alias("attempted"), F.sum((~F.col("ok")).cast("int")).alias("failed"), (F.sum(F.when(~F.col("ok"), F.col("w")).otherwise(0)) / F.sum("w")).alias("defended")), "defended")


def _lift(spark, d):
    ev = events(spark, d)
    absolute = bouts(spark, d).where("division = 'ABS'").select("match_id")
    return _r(a.lift(ev.join(absolute, "match_id", "left_semi"), ev.join(absolute, "match_id", "left_anti"), "label"), "lift")


def _cuts(spark, d):
    rows = bouts(spark, d).select("division", "method", "year", F.when(F.lower("event").contains("nogi"), "no-gi").when(F.col("event").isNull(), "unknown").otherwise("gi").alias("uniform"), (F.col("method") == "SUBMISSION").alias("finish"))
    return _r(a.cuts(rows, ("uniform", "division"), [F.count("*").alias("bouts"), F.count_if("finish").alias("finishes"), F.avg(F.col("finish").cast("double")).alias("rate")], "year", (2018, 2021, 2024)), "rate")


def _years(spark, d):
    rows = bouts(spark, d).where("year IS NOT NULL AND division IS NOT NULL")
    sets = rows.groupingSets([[F.col("year"), F.col("division")], [F.col("year")], []], F.col("year"), F.col("division")) if hasattr(rows, "groupingSets") else rows.rollup("year", "division")
    return _r(sets.agg(F.count("*").alias("bouts"), F.avg((F.col("method") == "SUBMISSION").cast("double")).alias("finish")), "finish")


def _cards(spark, d):
    rows = bouts(spark, d).where("event IS NOT NULL")
    top = a.shares(rows.where("submission <> ''"), "event", "submission").groupBy("event").agg(F.min_by("submission", F.struct(-F.col("n"), F.col("submission"))).alias("top_submission"))
    cards = rows.groupBy("event").agg(F.count("*").alias("bouts"), F.avg((F.col("method") == "SUBMISSION").cast("double")).alias("finish"), F.count_distinct("division").alias("divisions"), F.min("year").alias("first_year")).where("bouts >= 3")
    return _r(cards.join(top, "event", "left"), "finish")


def _log(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL AND ts IS NOT NULL")
    w = Window.partitionBy("match_id")
    minute = F.floor((F.col("ts") - F.min("ts").over(w)) / 60).cast("int")
    outcome = F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "effective").otherwise("failed")
    return ev.select("match_id", F.col("i").cast("int").alias("i"), "actor", "label", "type", outcome.alias("outcome"), minute.alias("minute"))


def _pivots(spark, d):
    told = _log(spark, d).withColumn("bucket", F.when(F.col("minute") >= 5, "5+").otherwise(F.col("minute").cast("string")))
    return a.crosstab(told, "type", "bucket", ("0", "1", "2", "3", "4", "5+"))


def _coverage(spark, d):
    rows = table(spark, d, "roster_records")
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    return rows.groupBy("source").agg(F.count("*").alias("records"), *[missing(c).alias(f"no_{c}") for c in ("opp", "year", "method", "wl", "comp")], F.count_if(F.col("year") < 1990).alias("odd_years"))


def _deviance(spark, d):
    e = table(spark, d, "graph_edges").where("source_key IS NOT NULL").select("edge_id", F.lower(F.trim("source_key")).alias("key"), "owner_kind", "elo")
    return _r(a.clamped_z(e, "key", "owner_kind", "elo").select("edge_id", "z"), "z", digits=4)


def _ocean(spark, d):
    ev = events(spark, d).groupBy("label").agg(F.count("*").alias("occ"))
    return _r(a.percentiles(ev, "occ"), "percentile", "ratio")


def _disciplines(spark, d):
    b = decided(spark, d)
    sides = b.select(F.col("winner").alias("who"), "method").unionByName(b.select(F.col("loser").alias("who"), "method"))
    return a.majority(sides, "who", "method", ("SUBMISSION", "POINTS", "DECISION"))


QUERIES = {
    "position_distribution": lambda spark, d: a.crosstab(table(spark, d, "technique_nodes").where("node_type IS NOT NULL"), "node_type", "type", _T),
    "submission_frequency": lambda spark, d: _r(a.shares(_subs(spark, d), "year", "submission"), "share"),
    "submission_trend": _trend,
    "pro_baseline": lambda spark, d: _r(a.baseline(_subs(spark, d), "year", "submission"), "baseline"),
    "user_vs_pro": _user_vs_pro,
    "team_dominance": lambda spark, d: _teams(spark, d).where("team IS NOT NULL").groupBy("year", "team").agg(F.count("*").alias("wins"), F.count_if(F.coalesce(F.col("stage").isin("F", "3RD"), F.lit(False))).alias("medals")),
    "win_type_by_team": lambda spark, d: _teams(spark, d).where("team IS NOT NULL").groupBy("team", "method").agg(F.count("*").alias("n")),
    "effectiveness_score": _effect,
    "style_mix": lambda spark, d: _r(_style(spark, d), "share"),
    "style_quartiles": _style_quartiles,
    "responses_to_situations": _responses,
    "submission_families": lambda spark, d: events(spark, d).where("type = 'submission'").groupBy(a.family(F.col("label")).alias("family")).agg(F.count("*").alias("attempts"), F.count_if(F.coalesce(F.col("ok"), F.lit(True))).alias("not_failed")),
    "defense_rate": _defense,
    "concentration_hhi": lambda spark, d: _r(a.concentration(events(spark, d).where("actor IS NOT NULL"), "label", "actor"), "top_share", "hhi", "effective", digits=5),
    "profile_three_readings": lambda spark, d: _r(a.readings(events(spark, d), "type", "actor"), "balanced", "weighted", "without_top"),
    "lift_table": _lift,
    "resolved_effectiveness": lambda spark, d: _r(a.effectiveness(events(spark, d), "label"), "rate", "resolved_share"),
    "cut_cube": _cuts,
    "year_series": _years,
    "event_card": _cards,
    "scouting_log": _log,
    "scouting_pivots": _pivots,
    "coverage_matrix": _coverage,
    "deviance_z": _deviance,
    "match_deviance_js": lambda spark, d: _r(a.mix_deviance(events(spark, d), "actor", "match_id", "type", _T), "js"),
    "ocean_percentiles": _ocean,
    "majority_discipline": _disciplines,
    "leaderboard_relative": lambda spark, d: _r(a.leaders(decided(spark, d).groupBy(F.col("winner").alias("athlete")).agg(F.count("*").alias("wins")), "athlete", "wins", 8), "relative"),
}
_SUBS = f"{_B}, s AS (SELECT year, submission FROM bouts WHERE submission <> '' AND year IS NOT NULL)"
_TYPES = ", ".join(f"'{x}'" for x in _T)
_MIX = f"c AS (SELECT actor, match_id, count(*) AS events, {', '.join(f'count(*) FILTER (type = {chr(39)}{x}{chr(39)}) AS t_{x}' for x in _T)} FROM ev WHERE actor IS NOT NULL AND type IN ({_TYPES}) GROUP BY 1, 2)"
_JS = " + ".join(f"coalesce(CASE WHEN p_{x} > 0 THEN 0.5 * p_{x} * log2(p_{x} / ((p_{x} + q_{x}) / 2)) END, 0) + coalesce(CASE WHEN q_{x} > 0 THEN 0.5 * q_{x} * log2(q_{x} / ((p_{x} + q_{x}) / 2)) END, 0)" for x in _T)
ORACLES = {
    "position_distribution": f"SELECT node_type, {', '.join(f'count(*) FILTER (type = {chr(39)}{x}{chr(39)}) AS {x}' for x in _T)} FROM technique_nodes WHERE node_type IS NOT NULL GROUP BY 1",
    "submission_frequency": f"{_SUBS}, c AS (SELECT year, submission, count(*) AS n FROM s GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM c",
    "submission_trend": f"{_SUBS}, t AS (SELECT submission FROM s GROUP BY 1 ORDER BY count(*) DESC, submission LIMIT 10), c AS (SELECT year, submission, count(*) AS n FROM s WHERE submission IN (SELECT submission FROM t) GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM c",
    "pro_baseline": f"{_SUBS}, c AS (SELECT year, submission, count(*) AS n FROM s GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM c) SELECT submission, round(sum(share) / (SELECT count(DISTINCT year) FROM s), 6) AS baseline FROM h GROUP BY 1",
    "user_vs_pro": f"WITH {EV}, {BOUTS}, s AS (SELECT year, submission FROM bouts WHERE submission <> '' AND year IS NOT NULL), c AS (SELECT year, submission, count(*) AS n FROM s GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM c), bl AS (SELECT submission, sum(share) / (SELECT count(DISTINCT year) FROM s) AS baseline FROM h GROUP BY 1), o AS (SELECT actor, label AS submission, count(*) AS n FROM ev WHERE type = 'submission' AND actor IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY actor) AS share FROM o) SELECT actor, submission, n, round(share, 6) AS share, round(baseline, 6) AS baseline, round(share / baseline, 6) AS ratio, CASE WHEN baseline IS NULL THEN 'no_data' WHEN share / baseline >= 1.5 THEN 'high' WHEN share / baseline <= 0.5 THEN 'low' ELSE 'normal' END AS flag FROM p LEFT JOIN bl USING (submission)",
    "team_dominance": rf"{_B}, tm AS (SELECT nullif(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '') AS w, team FROM athletes) SELECT year, team, count(*) AS wins, count(*) FILTER (stage IN ('F', '3RD')) AS medals FROM won JOIN tm ON w = winner WHERE team IS NOT NULL GROUP BY 1, 2",
    "win_type_by_team": rf"{_B}, tm AS (SELECT nullif(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '') AS w, team FROM athletes) SELECT team, method, count(*) AS n FROM won JOIN tm ON w = winner WHERE team IS NOT NULL GROUP BY 1, 2",
    "effectiveness_score": f"{_B}, t AS (SELECT submission, count(*) AS n, avg({_DEPTH}) AS depth, count(DISTINCT division) AS divisions, avg(CASE WHEN stage = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS finals, max(year) - min(year) + 1 AS span FROM bouts WHERE submission <> '' AND year IS NOT NULL GROUP BY 1) SELECT submission, n, round(depth, 6) AS depth, divisions, round(finals, 6) AS finals, span, round(0.4::DOUBLE * n / max(n) OVER () + 0.25::DOUBLE * depth / max(depth) OVER () + 0.15::DOUBLE * divisions / max(divisions) OVER () + 0.1::DOUBLE * finals + 0.1::DOUBLE * span / max(span) OVER (), 6) AS score FROM t",
    "style_mix": f"{_W}, k AS (SELECT DISTINCT actor FROM ev WHERE actor IS NOT NULL AND type IN ({_TYPES})), t AS (SELECT unnest([{_TYPES}]) AS type), c AS (SELECT actor, type, count(*) AS n FROM ev WHERE actor IS NOT NULL AND type IN ({_TYPES}) GROUP BY 1, 2) SELECT k.actor, t.type, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.actor), 6) AS share FROM k CROSS JOIN t LEFT JOIN c ON c.actor = k.actor AND c.type = t.type",
    "style_quartiles": f"{_W}, m AS (SELECT actor FROM ev WHERE actor IS NOT NULL GROUP BY 1 HAVING count(DISTINCT match_id) >= 3), k AS (SELECT DISTINCT actor FROM ev JOIN m USING (actor) WHERE type IN ({_TYPES})), t AS (SELECT unnest([{_TYPES}]) AS type), c AS (SELECT actor, type, count(*) AS n FROM ev WHERE type IN ({_TYPES}) GROUP BY 1, 2), h AS (SELECT k.actor, t.type, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.actor) AS share FROM k CROSS JOIN t LEFT JOIN c ON c.actor = k.actor AND c.type = t.type) SELECT type, round(quantile_cont(share, 0.25), 6) AS p25, round(quantile_cont(share, 0.5), 6) AS median, round(quantile_cont(share, 0.75), 6) AS p75 FROM h GROUP BY 1",
    "responses_to_situations": f"{_W}, t AS (SELECT *, lead(type) OVER w AS response, lead(actor) OVER w AS who FROM ev WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY i)), c AS (SELECT type AS situation, response, count(*) AS n FROM t WHERE ok AND who <> actor GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY situation), 6) AS share FROM c",
    "submission_families": f"{_W} SELECT {_FAMILY} AS family, count(*) AS attempts, count(*) FILTER (coalesce(ok, true)) AS not_failed FROM ev WHERE type = 'submission' GROUP BY 1",
    "defense_rate": f"WITH {EV}, {BOUTS}, w AS (SELECT winner, count(*) + 1 AS w FROM won GROUP BY 1) SELECT type, count(*) AS attempted, count(*) FILTER (NOT ok) AS failed, round(coalesce(sum(coalesce(w, 1)) FILTER (NOT ok), 0) / sum(coalesce(w, 1)), 6) AS defended FROM ev LEFT JOIN w ON winner = actor WHERE actor IS NOT NULL AND ok IS NOT NULL GROUP BY 1",
    "concentration_hhi": f"{_W}, c AS (SELECT label, actor, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS s FROM c) SELECT label, sum(n)::BIGINT AS n, count(*) AS people, round(max(s), 5) AS top_share, round(sum(s * s), 5) AS hhi, round(1 / sum(s * s), 5) AS effective FROM h GROUP BY 1",
    "profile_three_readings": f"{_W}, c AS (SELECT actor, type, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), h AS (SELECT *, n / sum(n) OVER (PARTITION BY actor) AS s FROM c), top AS (SELECT actor FROM c GROUP BY 1 ORDER BY sum(n) DESC, actor LIMIT 1) SELECT type, round(sum(s) / (SELECT count(DISTINCT actor) FROM c), 6) AS balanced, round(sum(n) / (SELECT sum(n) FROM c), 6) AS weighted, round(coalesce(sum(n) FILTER (actor NOT IN (SELECT actor FROM top)), 0) / (SELECT sum(n) FROM c WHERE actor NOT IN (SELECT actor FROM top)), 6) AS without_top FROM h GROUP BY 1",
    "lift_table": f"WITH {EV}, {BOUTS}, ab AS (SELECT match_id FROM bouts WHERE division = 'ABS'), x AS (SELECT label, match_id IN (SELECT match_id FROM ab) AS c FROM ev), g AS (SELECT label, count(*) FILTER (c) AS n, count(*) FILTER (NOT c) AS n_base FROM x GROUP BY 1), q AS (SELECT *, sum(n) OVER () AS tn, sum(n_base) OVER () AS tb FROM g) SELECT label, n, n_base, round(CASE WHEN n_base > 0 THEN log2((n / tn) / (n_base / tb)) END, 6) AS lift, CASE WHEN n_base = 0 THEN 'unseen' WHEN n < 5 THEN 'too_small' ELSE 'ranked' END AS bucket FROM q WHERE n > 0",
    "resolved_effectiveness": f"{_W} SELECT label, count(*) AS n, count(ok) AS resolved, count(*) FILTER (ok) AS ok, round(count(*) FILTER (ok) / nullif(count(ok), 0), 6) AS rate, round(count(ok) / count(*), 6) AS resolved_share FROM ev GROUP BY 1",
    "cut_cube": f"{_B}, r AS (SELECT coalesce(division, 'unknown') AS division, year, CASE WHEN contains(lower(event), 'nogi') THEN 'no-gi' WHEN event IS NULL THEN 'unknown' ELSE 'gi' END AS uniform, method = 'SUBMISSION' AS finish FROM bouts), w AS (SELECT *, unnest(list_filter(['all', CASE WHEN year >= 2018 THEN '2018' END, CASE WHEN year >= 2021 THEN '2021' END, CASE WHEN year >= 2024 THEN '2024' END], lambda x: x IS NOT NULL)) AS since FROM r) SELECT since, coalesce(uniform, 'all') AS uniform, coalesce(division, 'all') AS division, count(*) AS bouts, count(*) FILTER (finish) AS finishes, round(avg(finish::INT), 6) AS rate FROM w GROUP BY GROUPING SETS ((since, uniform, division), (since, uniform), (since, division), (since))",
    "year_series": f"{_B} SELECT year, division, count(*) AS bouts, round(avg((method = 'SUBMISSION')::INT), 6) AS finish FROM bouts WHERE year IS NOT NULL AND division IS NOT NULL GROUP BY GROUPING SETS ((year, division), (year), ())",
    "event_card": f"{_B}, c AS (SELECT event, submission, count(*) AS n FROM bouts WHERE event IS NOT NULL AND submission <> '' GROUP BY 1, 2), t AS (SELECT event, submission AS top_submission FROM c QUALIFY row_number() OVER (PARTITION BY event ORDER BY n DESC, submission) = 1), e AS (SELECT event, count(*) AS bouts, round(avg((method = 'SUBMISSION')::INT), 6) AS finish, count(DISTINCT division) AS divisions, min(year) AS first_year FROM bouts WHERE event IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT e.*, top_submission FROM e LEFT JOIN t USING (event)",
    "scouting_log": f"{_W} SELECT match_id, i::INT AS i, actor, label, type, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'effective' ELSE 'failed' END AS outcome, floor((ts - min(ts) OVER (PARTITION BY match_id)) / 60)::INT AS minute FROM ev WHERE actor IS NOT NULL AND ts IS NOT NULL",
    "scouting_pivots": f"{_W}, m AS (SELECT type, floor((ts - min(ts) OVER (PARTITION BY match_id)) / 60)::INT AS minute FROM ev WHERE actor IS NOT NULL AND ts IS NOT NULL) SELECT type, " + ", ".join(f'count(*) FILTER (minute = {k}) AS "{k}"' for k in range(5)) + ', count(*) FILTER (minute >= 5) AS "5+" FROM m GROUP BY 1',
    "coverage_matrix": "SELECT source, count(*) AS records, " + ", ".join(f"count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS no_{c}" for c in ("opp", "year", "method", "wl", "comp")) + ", count(*) FILTER (year < 1990) AS odd_years FROM roster_records GROUP BY 1",
    "deviance_z": "WITH e AS (SELECT edge_id, lower(trim(source_key)) AS key, owner_kind, elo FROM graph_edges WHERE source_key IS NOT NULL), k AS (SELECT key, avg(elo) AS m, stddev_pop(elo) AS s, count(elo) AS n FROM e GROUP BY 1), f AS (SELECT owner_kind, avg(elo) AS fm, stddev_pop(elo) AS fs FROM e GROUP BY 1) SELECT edge_id, round(greatest(-3, least(3, CASE WHEN n >= 3 AND s > 1e-9 THEN (elo - m) / s WHEN fs > 1e-9 THEN (elo - fm) / fs ELSE 0 END)), 4) AS z FROM e LEFT JOIN k USING (key) LEFT JOIN f USING (owner_kind)",
    "match_deviance_js": f"{_W}, {_MIX}, o AS (SELECT *, sum(events) OVER (PARTITION BY actor) - events AS others, {', '.join(f'(sum(t_{x}) OVER (PARTITION BY actor) - t_{x}) AS o_{x}' for x in _T)} FROM c), p AS (SELECT *, {', '.join(f't_{x} / events AS p_{x}, o_{x} / others AS q_{x}' for x in _T)} FROM o WHERE others >= 1) SELECT actor, match_id, events, others::BIGINT AS others, round(greatest(0, least(1, {_JS})), 6) AS js, list_sort([{', '.join(f'{{g: round(-abs(p_{x} - q_{x}), 9), x: {chr(39)}{x}{chr(39)}}}' for x in _T)}])[1].x AS shift FROM p",
    "ocean_percentiles": f"{_W}, c AS (SELECT label, count(*) AS occ FROM ev GROUP BY 1) SELECT label, occ, round(cume_dist() OVER (ORDER BY occ), 6) AS percentile, round(occ / avg(occ) OVER (), 6) AS ratio FROM c",
    "majority_discipline": f"{_B}, s AS (SELECT winner AS who, method FROM won UNION ALL SELECT loser, method FROM won), c AS (SELECT who, method, count(*) AS n FROM s GROUP BY 1, 2) SELECT who, method, n FROM c QUALIFY row_number() OVER (PARTITION BY who ORDER BY n DESC, CASE method WHEN 'SUBMISSION' THEN 0 WHEN 'POINTS' THEN 1 WHEN 'DECISION' THEN 2 ELSE 3 END, method) = 1",
    "leaderboard_relative": f"{_B}, c AS (SELECT winner AS athlete, count(*) AS wins FROM won GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) SELECT row_number() OVER (ORDER BY wins DESC, athlete)::INT AS rank, athlete, wins, round(wins / max(wins) OVER (), 6) AS relative FROM c",
}
