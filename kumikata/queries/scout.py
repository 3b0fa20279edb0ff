"""Queries over attribution, scouting facts and the layers of a bracket."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.functions import keys
from kumikata.operators import attribution as at
from kumikata.operators import scouting as sc
from kumikata.operators.joins import participants
from kumikata.operators.stats import Z95
from kumikata.plans.runtime import cut
from kumikata.sources.views import BOUTS, EV, bouts, decided, events

SINCE = (2018, 2021, 2024)
#: Families of methods that end a bout by submission.
SUBMISSIONS = ("leg", "strangle", "joint", "slicer", "sub_other")


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _classified(spark, d):
    return at.classify(events(spark, d))


def _sides(spark, d):
    return participants(bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("match_id", "a", "b"))


def _attributed(spark, d):
    told = cut(_classified(spark, d))  # flags and events are read from it
    return at.attribute(told, _sides(spark, d), at.bout_flags(told))


def _attribution(spark, d):
    return _attributed(spark, d).groupBy("perspective", "type", "category", "relation", "subject_role", "status", "confidence", "source").agg(F.count("*").alias("n"))


def _directional(spark, d):
    told = _attributed(spark, d)
    count = lambda test: F.count_if(test)
    return told.groupBy("athlete").agg(F.count("*").alias("events"), count(at.is_event(F.col("type"))).alias("known_types"), count(at.usable_perspective(F.col("confidence"))).alias("with_perspective"), count(at.usable_role(F.col("status"))).alias("with_role"), count(at.directional(F.col("confidence"), F.col("status"))).alias("directional"))


def _actions(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL").withColumn("action", sc.action(F.col("type"), F.col("label"))).where("action IS NOT NULL")
    return ev.groupBy("actor", "action", keys.outcome(F.col("type"), F.col("ok"), F.lit(None).cast("int")).alias("effect")).agg(F.count("*").alias("n"))


def _openings(spark, d):
    return sc.openings(events(spark, d), F.col("type") == "guard")


def _results(spark, d):
    b = bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    winner = F.when(F.col("result") > 0, F.col("a")).when(F.col("result") < 0, F.col("b"))
    told = b.select("match_id", "a", "b", winner.alias("winner"), F.explode(F.array("a", "b")).alias("athlete"))
    return told.groupBy("athlete", sc.result_for(*map(F.col, ("athlete", "winner", "a", "b"))).alias("outcome")).agg(F.count("*").alias("bouts"))


def _summary(spark, d):
    ev = events(spark, d)
    return _r(sc.section_summary(sc.tendencies(ev), ev), "share")


def _matchup(spark, d):
    ev = events(spark, d)
    pairs = _sides(spark, d).select("athlete", "opponent").distinct()
    return sc.matchup(sc.tendencies(ev), sc.answers_to(ev), pairs)


def _nodes(spark, d):
    """Top labels with the athletes' own role, by division."""
    told = _attributed(spark, d).where("perspective = 'favor'")
    return _r(sc.node_rows(told.join(bouts(spark, d).where("division IS NOT NULL").select("match_id", "division"), "match_id"), ["division"]), "share")


def _won(spark, d):
    return decided(spark, d).select("match_id", "winner", "loser", "year", F.coalesce("division", F.lit("unknown")).alias("division"), keys.uniform(F.col("event")).alias("uniform"), F.coalesce(F.col("submission") != "", F.lit(False)).alias("finish"))


def _layer(spark, d, who):
    """Wins in every cut with finish rate, interval and whether enough people bear it."""
    frame = _won(spark, d).withColumns({"_k": F.col("finish").cast("int"), "_n": F.lit(1)})
    cube = frame.withColumn("since", F.explode(F.filter(F.array(F.lit("all"), *[F.when(F.col("year") >= y, F.lit(str(y))) for y in SINCE]), lambda x: x.isNotNull()))).withColumn("uniform", F.explode(F.array("uniform", F.lit("all"))))
    group = ["division", "uniform", "since"] if who == "division" else ["winner", "uniform", "since"]
    return _r(sc.gated_rate(cube, group, "winner" if who == "division" else "loser", "_k", "_n"), "p", "lo", "hi", "effective")


def _recency(spark, d):
    frame = _won(spark, d).withColumns({"_k": F.col("finish").cast("int"), "_n": F.lit(1)})
    windows = frame.withColumn("window", F.explode(F.filter(F.array(F.lit("career"), *[F.when(F.col("year") >= y, F.lit(f"{y}+")) for y in SINCE]), lambda x: x.isNotNull())))
    return sc.recency(sc.gated_rate(windows, ["division", "window"], "winner", "_k", "_n"), ["division"])


def _baseline(spark, d):
    """Types of events in the open class against the bouts of everybody who does not stand in it."""
    ev = events(spark, d).where("actor IS NOT NULL")
    b = bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL")
    roster = b.where("division = 'ABS'").select(F.explode(F.array("a", "b")).alias("actor")).distinct()
    inside = ev.join(b.where("division = 'ABS'").select("match_id"), "match_id", "left_semi").select("type")
    outside = ev.join(roster, "actor", "left_anti").select("type")
    return _r(sc.beside_baseline(inside, outside, "type"), "diff", "diff_lo", "diff_hi", "p", "q", digits=5)


def _arms(spark, d):
    b = _won(spark, d)
    return _r(sc.two_arms(b.select("division", F.col("winner").alias("who"), "finish"), b.select("division", F.col("loser").alias("who"), "finish"), ["division"], "who", F.col("finish")), "diff", "diff_lo", "diff_hi")


def _marginal(spark, d):
    """Every registered or fighting athlete with the number of own events, none included."""
    own = events(spark, d).where("actor IS NOT NULL").groupBy(F.col("actor").alias("athlete")).agg(F.count("*").alias("events"), F.count("ts").alias("timed"))
    roster = _sides(spark, d).select("athlete").distinct()
    told = roster.join(own, "athlete", "left").na.fill(0, ["events", "timed"])
    return told.select("athlete", "events", F.coalesce(F.col("timed") >= 0.3 * F.nullif("events", F.lit(0)), F.lit(False)).alias("time_available"))


def _win_mix(spark, d):
    won = decided(spark, d).withColumn("family", keys.method_family(F.col("method")))
    kinds = (("submission", F.col("family").isin(*SUBMISSIONS)), ("points", F.col("family") == "points"), ("decision", F.col("family") == "decision"))
    told = won.groupBy("winner").agg(F.count("*").alias("wins"), *[F.round(F.avg(test.cast("double")), 6).alias(n) for n, test in kinds])
    return told.where("wins >= 3")


QUERIES = {
    "event_roles": lambda spark, d: _classified(spark, d).groupBy("type", "category", "relation", "actor_role", "target_role", "status", "source").agg(F.count("*").alias("n")),
    "bout_flags": lambda spark, d: at.bout_flags(_classified(spark, d)),
    "attribution_events": _attribution,
    "directional_events": _directional,
    "scouting_actions": _actions,
    "bout_openings": _openings,
    "athlete_results": _results,
    "section_tendencies": lambda spark, d: sc.tendencies(events(spark, d)),
    "section_summary": _summary,
    "answers_to_labels": lambda spark, d: sc.answers_to(events(spark, d)),
    "matchup": _matchup,
    "division_nodes": _nodes,
    "method_layer": lambda spark, d: _layer(spark, d, "division"),
    "athlete_layer": lambda spark, d: _layer(spark, d, "athlete"),
    "recency_windows": _recency,
    "category_against_pool": lambda spark, d: _baseline(spark, d).drop("p", "q"),
    "category_against_pool_fdr": lambda spark, d: _baseline(spark, d).select("type", "p", "q"),
    "conceded_against_applied": _arms,
    "roster_coverage": _marginal,
    "win_type_mix": _win_mix,
}

_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in at.rule_rows())
_CL = f"""ru(type, label, category, relation, actor_role, target_role) AS (VALUES {_RULES}),
c0 AS (SELECT ev.*, n.category IS NOT NULL AS named, coalesce(n.category, t.category, 'transition') AS category, coalesce(n.relation, t.relation, 'initiates') AS relation, coalesce(n.actor_role, t.actor_role, 'unknown') AS actor_role, coalesce(n.target_role, t.target_role, 'unknown') AS target_role
    FROM ev LEFT JOIN ru n ON n.label = ev.label AND n.type = ev.type LEFT JOIN ru t ON t.label IS NULL AND t.type = ev.type),
cl AS (SELECT *, CASE WHEN named THEN 'table' ELSE 'type_default' END AS source, CASE WHEN actor_role = 'unknown' OR target_role = 'unknown' THEN 'unknown' WHEN actor_role = 'neutral' THEN 'symmetric' ELSE 'resolved' END AS status FROM c0)"""
_FL = """px AS (SELECT *, CASE WHEN actor_role IN ('top', 'bottom') THEN 1 WHEN actor_role IN ('controlling', 'controlled') THEN 2 END AS axis, actor_role IN ('bottom', 'controlled') AS low, trunc(ts)::BIGINT AS s FROM cl WHERE actor IS NOT NULL),
cx AS (SELECT a.match_id, count(*) AS n FROM px a JOIN px b ON a.match_id = b.match_id AND a.actor = b.actor AND a.axis = b.axis AND NOT a.low AND b.low AND abs(a.s - b.s) <= 10 GROUP BY 1),
f0 AS (SELECT match_id, count(*) AS events, count(DISTINCT actor) AS actors FROM px GROUP BY 1),
fl AS (SELECT f0.*, coalesce(n, 0) AS contradictions, events >= 6 AND actors <= 1 AS one_sided, NOT (events >= 6 AND actors <= 1) AND n IS NULL AS role_reliable, NOT (events >= 6 AND actors <= 1) AS perspective_reliable, CASE WHEN events >= 6 AND actors <= 1 THEN 'one_sided' WHEN n > 0 THEN 'self_contradictory' END AS reason FROM f0 LEFT JOIN cx USING (match_id))"""
_PA = "b2 AS (SELECT * FROM bouts WHERE a <> b), pa AS (SELECT match_id, a AS athlete, b AS opponent FROM b2 UNION ALL SELECT match_id, b, a FROM b2)"
_AT = f"""{EV}, {BOUTS}, {_CL}, {_FL}, {_PA},
a0 AS (SELECT cl.*, athlete, actor = athlete AS favor, role_reliable, perspective_reliable, CASE WHEN actor = athlete THEN actor_role ELSE target_role END AS role FROM cl JOIN pa USING (match_id) JOIN fl USING (match_id) WHERE actor IS NOT NULL),
a1 AS (SELECT * EXCLUDE (status), CASE WHEN favor THEN 'favor' ELSE 'contra' END AS perspective, CASE WHEN NOT role_reliable OR role = 'unknown' THEN 'unknown' ELSE status END AS status, CASE WHEN perspective_reliable THEN 'high' ELSE 'low' END AS confidence FROM a0),
att AS (SELECT *, CASE WHEN status = 'unknown' THEN 'unknown' ELSE role END AS subject_role FROM a1)"""
_like = lambda words: "(" + " OR ".join(f"contains(label, '{w}')" for w in words) + ")"
_LOOSE = "type IN ('control', 'transition')"
_SEC = f"""sx AS (SELECT *, unnest(list_filter([CASE WHEN type = 'takedown' OR {_LOOSE} AND {_like(sc.STANDING)} THEN 'standing' END, CASE WHEN type = 'guard' THEN 'guard' END, CASE WHEN type = 'pass' OR {_LOOSE} AND {_like(sc.PASSING)} THEN 'passing' END, CASE WHEN type = 'submission' OR {_LOOSE} AND contains(label, 'back') THEN 'back_and_finishing' END], lambda x: x IS NOT NULL)) AS section FROM ev WHERE actor IS NOT NULL),
t0 AS (SELECT actor, section, label, count(*) AS count, count(DISTINCT match_id) AS bouts, count(ok) AS known, count(*) FILTER (ok) AS ok, count(DISTINCT match_id) FILTER (ok IS NOT NULL) AS kb FROM sx GROUP BY 1, 2, 3),
td AS (SELECT actor, section, label, count, bouts, known, ok, CASE WHEN count >= 8 AND bouts >= 4 THEN 'strong' WHEN count >= 5 AND bouts >= 3 THEN 'sustained' WHEN count >= 3 AND bouts >= 2 THEN 'limited' END AS grade, CASE WHEN known >= 8 AND kb >= 4 THEN 'strong' WHEN known >= 5 AND kb >= 3 THEN 'sustained' WHEN known >= 3 AND kb >= 2 THEN 'limited' END AS rate_grade FROM t0)"""
_AN = "nx AS (SELECT *, lag(label) OVER w AS before, lag(actor) OVER w AS made FROM (SELECT * FROM ev WHERE actor IS NOT NULL) WINDOW w AS (PARTITION BY match_id ORDER BY i)), an AS (SELECT actor, before AS label, label AS answer, count(*) AS n, count(DISTINCT match_id) AS bouts FROM nx WHERE made <> actor GROUP BY 1, 2, 3)"
_rule = lambda col, rules, default: "CASE " + " ".join(f"WHEN regexp_matches(strip_accents(lower({col})), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"
_UNI, _FAM = _rule("event", keys.UNIFORMS, "unknown"), _rule("method", keys.METHOD_FAMILIES, "sub_other")
_Z = f"{Z95!r}::DOUBLE"
_GR = f"""gp AS (SELECT {{g}}, {{w}} AS who, sum(k) AS k, count(*) AS n FROM cu GROUP BY ALL), gs AS (SELECT {{g}}, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, count(*) AS clusters, sum(n) ** 2 / sum(n * n)::DOUBLE AS effective FROM gp GROUP BY ALL),
gx AS (SELECT *, k / n::DOUBLE AS p0, 1 + {_Z} * {_Z} / n AS dd FROM gs), gr AS (SELECT *, (p0 + {_Z} * {_Z} / (2.0::DOUBLE * n)) / dd AS mid, {_Z} / dd * sqrt(p0 * (1 - p0) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n)) AS half, clusters >= 5 AND effective >= 2 AS estimable FROM gx)"""
_WON = f"wn AS (SELECT match_id, winner, loser, year, coalesce(division, 'unknown') AS division, {_UNI} AS uniform, coalesce(submission <> '', false)::INT AS k FROM won)"
_ALL = ", ".join(f"CASE WHEN year >= {y} THEN '{y}' END" for y in SINCE)
_CUT = f"cu AS (SELECT * EXCLUDE (uniform), unnest([uniform, 'all']) AS uniform FROM (SELECT *, unnest(list_filter(['all', {_ALL}], lambda x: x IS NOT NULL)) AS since FROM wn))"
_GATE = "k, n, round(p0, 6) AS p, round(greatest(0, mid - half), 6) AS lo, round(least(1, mid + half), 6) AS hi, clusters, round(effective, 6) AS effective, estimable"
_CAREER = ", ".join(f"CASE WHEN year >= {y} THEN '{y}+' END" for y in SINCE)
_E, _EB = f"WITH {EV}", f"WITH {EV}, {BOUTS}"
ORACLES = {
    "event_roles": f"{_E}, {_CL} SELECT type, category, relation, actor_role, target_role, status, source, count(*) AS n FROM cl GROUP BY ALL",
    "bout_flags": f"{_E}, {_CL}, {_FL} SELECT match_id, events, actors, contradictions, one_sided, role_reliable, perspective_reliable, reason FROM fl",
    "attribution_events": f"WITH {_AT} SELECT perspective, type, category, relation, subject_role, status, confidence, source, count(*) AS n FROM att GROUP BY ALL",
    "directional_events": f"WITH {_AT} SELECT athlete, count(*) AS events, count(*) FILTER (type IN {at.EVENT_TYPES}) AS known_types, count(*) FILTER (confidence = 'high') AS with_perspective, count(*) FILTER (status <> 'unknown') AS with_role, count(*) FILTER (confidence = 'high' AND status <> 'unknown') AS directional FROM att GROUP BY 1",
    "scouting_actions": f"{_E}, x AS (SELECT actor, CASE type WHEN 'submission' THEN 'finish' WHEN 'sweep' THEN 'sweep' WHEN 'pass' THEN 'pass' WHEN 'takedown' THEN 'takedown' WHEN 'control' THEN CASE WHEN label IN {sc.MOUNTS} THEN 'mount' WHEN label IN {sc.BACKS} THEN 'back' END END AS action, CASE WHEN ok AND type = 'submission' THEN 'finish' WHEN ok THEN 'done' WHEN NOT ok THEN 'no effect' ELSE 'not known' END AS effect FROM ev WHERE actor IS NOT NULL) SELECT actor, action, effect, count(*) AS n FROM x WHERE action IS NOT NULL GROUP BY ALL",
    "bout_openings": f"{_E}, o AS (SELECT match_id, actor, coalesce(ts, 0) AS ts, CASE WHEN type = 'guard' THEN 0 ELSE 1 END AS kind FROM ev WHERE actor IS NOT NULL AND (type = 'guard' OR type = 'takedown' AND coalesce(ok, true))), dp AS (SELECT DISTINCT x.match_id FROM o x JOIN o y ON x.match_id = y.match_id AND x.kind = 0 AND y.kind = 0 AND x.actor <> y.actor AND abs(x.ts - y.ts) <= 15), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts, kind, actor) = 1) SELECT f.match_id, CASE WHEN dp.match_id IS NOT NULL THEN 'both' ELSE actor END AS agent, CASE WHEN dp.match_id IS NOT NULL THEN 'double pull' WHEN kind = 0 THEN 'pull' ELSE 'takedown' END AS opening FROM f LEFT JOIN dp USING (match_id)",
    "athlete_results": f"WITH {BOUTS}, {_PA}, r AS (SELECT pa.athlete, CASE WHEN result IS NULL OR result = 0 THEN 'no result' WHEN (CASE WHEN result > 0 THEN a ELSE b END) = athlete THEN 'won' ELSE 'lost' END AS outcome FROM b2 JOIN pa USING (match_id)) SELECT athlete, outcome, count(*) AS bouts FROM r GROUP BY ALL",
    "section_tendencies": f"{_E}, {_SEC} SELECT * FROM td",
    "section_summary": f"{_E}, {_SEC}, pe AS (SELECT actor, count(DISTINCT match_id) AS bouts, unnest(['standing', 'guard', 'passing', 'back_and_finishing']) AS section FROM ev WHERE actor IS NOT NULL GROUP BY 1 HAVING count(DISTINCT match_id) >= 3), su AS (SELECT actor, section, sum(count)::BIGINT AS events, count(*) AS labels FROM td GROUP BY 1, 2), tp AS (SELECT actor, section, label, count FROM td WHERE grade IS NOT NULL QUALIFY row_number() OVER (PARTITION BY actor, section ORDER BY count DESC, label) = 1) SELECT actor, section, bouts, coalesce(events, 0) AS events, coalesce(labels, 0) AS labels, tp.label AS predominant, round(tp.count / events::DOUBLE, 6) AS share, events IS NULL AS absent FROM pe LEFT JOIN su USING (actor, section) LEFT JOIN tp USING (actor, section)",
    "answers_to_labels": f"{_E}, {_AN} SELECT * FROM an",
    "matchup": f"{_EB}, {_PA}, {_SEC}, {_AN}, rk AS (SELECT actor, label, max(count) AS threat_count, max_by(grade, count) AS threat_grade FROM td WHERE grade IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY actor ORDER BY max(count) DESC, label) <= 3), be AS (SELECT actor, label, answer, n FROM an QUALIFY row_number() OVER (PARTITION BY actor, label ORDER BY n DESC, answer) = 1) SELECT p.athlete, p.opponent, rk.label AS threat, threat_count, threat_grade, be.answer, be.n AS answer_count, CASE WHEN be.answer IS NULL THEN 'gap' ELSE 'documented' END AS kind FROM (SELECT DISTINCT athlete, opponent FROM pa) p JOIN rk ON rk.actor = p.opponent LEFT JOIN be ON be.actor = p.athlete AND be.label = rk.label",
    "division_nodes": f"WITH {_AT}, k AS (SELECT division, category, label, subject_role AS role, count(*) AS k FROM att JOIN bouts USING (match_id) WHERE perspective = 'favor' AND division IS NOT NULL GROUP BY ALL), s AS (SELECT *, k / sum(k) OVER (PARTITION BY division, category) AS share FROM k) SELECT division, category, label, role, k, round(share, 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY division, category ORDER BY k DESC, label, role) <= 12",
    "method_layer": f"WITH {BOUTS}, {_WON}, {_CUT}, {_GR.format(g='division, uniform, since', w='winner')} SELECT division, uniform, since, {_GATE} FROM gr",
    "athlete_layer": f"WITH {BOUTS}, {_WON}, {_CUT}, {_GR.format(g='winner, uniform, since', w='loser')} SELECT winner, uniform, since, {_GATE} FROM gr",
    "recency_windows": f"WITH {BOUTS}, {_WON}, cu AS (SELECT *, unnest(list_filter(['career', {_CAREER}], lambda x: x IS NOT NULL)) AS w FROM wn), {_GR.format(g='division, w', w='winner')}, bd AS (SELECT division, greatest(0, mid - half) AS lo, least(1, mid + half) AS hi, w FROM gr WHERE estimable), ov AS (SELECT x.division, bool_and(x.lo <= y.hi AND y.lo <= x.hi) AS stable FROM bd x JOIN bd y ON x.division = y.division AND x.w < y.w GROUP BY 1), wc AS (SELECT division, count(*) AS c FROM bd GROUP BY 1) SELECT division, coalesce(c, 0) AS estimable_windows, stable FROM (SELECT DISTINCT division FROM gr) LEFT JOIN wc USING (division) LEFT JOIN ov USING (division)",
    "roster_coverage": f"{_EB}, {_PA}, o AS (SELECT actor AS athlete, count(*) AS events, count(ts) AS timed FROM ev WHERE actor IS NOT NULL GROUP BY 1) SELECT athlete, coalesce(events, 0) AS events, coalesce(events > 0 AND timed >= 0.3::DOUBLE * events, false) AS time_available FROM (SELECT DISTINCT athlete FROM pa) LEFT JOIN o USING (athlete)",
    "win_type_mix": f"WITH {BOUTS}, m AS (SELECT winner, {_FAM} AS family FROM won) SELECT winner, count(*) AS wins, round(avg((family IN {SUBMISSIONS})::INT), 6) AS submission, round(avg((family = 'points')::INT), 6) AS points, round(avg((family = 'decision')::INT), 6) AS decision FROM m GROUP BY 1 HAVING count(*) >= 3",
    "category_against_pool": f"{_EB}, b1 AS (SELECT * FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL), ro AS (SELECT DISTINCT unnest([a, b]) AS actor FROM b1 WHERE division = 'ABS'), i AS (SELECT type FROM ev WHERE actor IS NOT NULL AND match_id IN (SELECT match_id FROM b1 WHERE division = 'ABS')), o AS (SELECT type FROM ev WHERE actor IS NOT NULL AND actor NOT IN (SELECT actor FROM ro)), x AS (SELECT type, count(*)::DOUBLE AS k1 FROM i GROUP BY 1), y AS (SELECT type, count(*)::DOUBLE AS k2 FROM o GROUP BY 1), z AS (SELECT type, k1, coalesce(k2, 0) AS k2, (SELECT count(*) FROM i)::DOUBLE AS n1, (SELECT count(*) FROM o)::DOUBLE AS n2 FROM x LEFT JOIN y USING (type)), q AS (SELECT *, (k1 + 1) / (n1 + 2) AS q1, (k2 + 1) / (n2 + 2) AS q2 FROM z), s AS (SELECT *, sqrt(q1 * (1 - q1) / (n1 + 2) + q2 * (1 - q2) / (n2 + 2)) AS se FROM q) SELECT type, k1::BIGINT AS k1, k2::BIGINT AS k2, n1::BIGINT AS n1, n2::BIGINT AS n2, round(k1 / n1 - k2 / n2, 5) AS diff, round(q1 - q2 - {_Z} * se, 5) AS diff_lo, round(q1 - q2 + {_Z} * se, 5) AS diff_hi FROM s",
    "conceded_against_applied": f"WITH {BOUTS}, {_WON}, ar AS (SELECT division, 'w' AS arm, winner AS who, k FROM wn UNION ALL SELECT division, 'l', loser, k FROM wn), p AS (SELECT division, arm, who, sum(k) AS k, count(*) AS n FROM ar GROUP BY ALL), g AS (SELECT division, arm, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n, count(*) >= 5 AND sum(n) ** 2 / sum(n * n)::DOUBLE >= 2 AS ok FROM p GROUP BY ALL), q AS (SELECT w.division, w.k AS kw, w.n AS nw, l.k AS kl, l.n AS nl, w.ok AS okw, l.ok AS okl, (l.k + 1) / (l.n + 2) AS q1, (w.k + 1) / (w.n + 2) AS q2 FROM g w JOIN g l ON w.division = l.division AND w.arm = 'w' AND l.arm = 'l'), s AS (SELECT *, okw AND okl AS available, sqrt(q1 * (1 - q1) / (nl + 2) + q2 * (1 - q2) / (nw + 2)) AS se FROM q) SELECT division, kw::BIGINT AS applied, nw::BIGINT AS of_wins, kl::BIGINT AS conceded, nl::BIGINT AS of_losses, CASE WHEN available THEN round(kl / nl - kw / nw, 6) END AS diff, CASE WHEN available THEN round(q1 - q2 - {_Z} * se, 6) END AS diff_lo, CASE WHEN available THEN round(q1 - q2 + {_Z} * se, 6) END AS diff_hi, available, concat_ws(',', CASE WHEN NOT okw THEN 'win' END, CASE WHEN NOT okl THEN 'loss' END) AS blocked FROM s",
}
