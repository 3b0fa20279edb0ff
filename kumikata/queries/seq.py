"""Queries over event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import sequences as s
from kumikata.operators.joins import participants
from kumikata.sources.views import BOUTS, EV, bouts, events

_OWN = "own AS (SELECT *, lead(label) OVER o AS target, lead(ok) OVER o AS target_ok, lead(type) OVER o AS target_type, lead(i) OVER o AS i_to FROM ev WHERE actor IS NOT NULL WINDOW o AS (PARTITION BY match_id, actor ORDER BY i)), st AS (SELECT *, label AS source FROM own WHERE target <> label)"
_SIDES = """fs AS (SELECT match_id, actor, min(i) AS seen FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY seen) AS r FROM fs),
tg AS (SELECT ev.*, CASE r WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS side FROM ev LEFT JOIN rk ON ev.match_id = rk.match_id AND ev.actor = rk.actor AND r <= 2)"""
_VALUES = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in s.DECISION_SPACE.items())
_SPACE = f"""{_SIDES}, v(type, own, other) AS (VALUES {_VALUES}),
r1 AS (SELECT tg.*, coalesce(v.own, 0.5)::DOUBLE AS own, coalesce(v.other, 0.5)::DOUBLE AS other FROM tg LEFT JOIN v ON v.type = tg.type WHERE side IS NOT NULL),
r2 AS (SELECT *, CASE side WHEN 'a' THEN own ELSE other END AS a, CASE side WHEN 'a' THEN other ELSE own END AS b FROM r1),
r3 AS (SELECT *, coalesce(lag(a) OVER w, 0.5) AS a0, coalesce(lag(b) OVER w, 0.5) AS b0, sign(lag(a) OVER w - lag(b) OVER w) AS lead0 FROM r2 WINDOW w AS (PARTITION BY match_id ORDER BY i)),
sp AS (SELECT *, round(own - CASE side WHEN 'a' THEN a0 ELSE b0 END, 4) AS gain, round(CASE side WHEN 'a' THEN b0 ELSE a0 END - other, 4) AS reduction, CASE side WHEN 'a' THEN a0 ELSE b0 END AS mine0, coalesce(sign(a - b) <> lead0 AND sign(a - b) <> 0, false) AS turns FROM r3)"""
_EX = """x1 AS (SELECT *, actor IS NULL AS neutral, coalesce(ts - lag(ts) OVER w > 120, false) AS late, lag(actor) OVER w AS pa, lag(i) OVER w AS pi FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY i)),
x2 AS (SELECT *, sum(CASE WHEN NOT neutral AND (pi IS NULL OR pa IS NULL OR late) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY i) AS exchange FROM x1), ex AS (SELECT * FROM x2 WHERE NOT neutral)"""


def _type_value() -> F.Column:
    return F.coalesce(*[F.when(F.col("type") == k, F.lit(round((a - b) * 100))) for k, (a, b) in s.DECISION_SPACE.items()], F.lit(0))


def _momentum(spark, d, sides=s.sides):
    ev = events(spark, d)
    value = ev.groupBy("label").agg(F.min("type").alias("type")).select("label", _type_value().alias("value"))
    return s.momentum(sides(ev), value).select("match_id", "i", F.round("momentum", 7).alias("momentum"))


def _resolved(spark, d):
    return s.resolved_sides(events(spark, d))


def _perspective(spark, d):
    sides = participants(bouts(spark, d).where("a IS NOT NULL AND b IS NOT NULL").select("match_id", "a", "b"))
    return s.perspective(events(spark, d), sides).groupBy("athlete", "who", "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("ok"))


def _weighted(spark, d):
    """Edges weighted by how sure an athlete's record is: bouts over bouts plus 5."""
    ev = events(spark, d)
    sure = ev.where("actor IS NOT NULL").groupBy("actor").agg(F.count_distinct("match_id").alias("b")).select("actor", (F.col("b") / (F.col("b") + 5.0)).alias("w"))
    told = s.transition_edges(ev.join(sure, "actor", "left"), weight=F.col("w"))
    return told.withColumns({"weight": F.round("weight", 5), "ok": F.round("ok", 5)})


QUERIES = {
    "transition_edges": lambda spark, d: s.transition_edges(events(spark, d)),
    "transition_nodes_reward_risk": lambda spark, d: s.transition_nodes(events(spark, d)).withColumn("reward_risk", F.round("reward_risk", 6)),
    "transition_reactions": lambda spark, d: s.reactions(events(spark, d)),
    "athlete_balanced_edges": lambda spark, d: s.balanced_edges(events(spark, d)).withColumn("weight", F.round("weight", 6)),
    "trigram_paths": lambda spark, d: s.ngrams(events(spark, d), 3).withColumn("share", F.round("share", 6)),
    "type_bigrams": lambda spark, d: s.ngrams(events(spark, d), 2, "type").withColumn("share", F.round("share", 6)),
    "transition_heatmap": lambda spark, d: s.heatmap(events(spark, d)),
    "actor_runs": lambda spark, d: s.runs(events(spark, d)),
    "exchange_split": lambda spark, d: s.exchanges(events(spark, d)).groupBy("match_id", "exchange").agg(F.count("*").alias("events"), F.min("i").alias("first_i"), F.max("i").alias("last_i")),
    "revisit_counts": lambda spark, d: s.revisits(s.exchanges(events(spark, d))),
    "cycle_profile": lambda spark, d: s.cycle_profile(events(spark, d)).withColumn("mean_run", F.round("mean_run", 6)),
    "normalize_chain": lambda spark, d: s.normalize_chain(events(spark, d)),
    "decision_space_turns": lambda spark, d: s.decision_space(s.sides(events(spark, d))).select("match_id", "i", "side", "own", "other", "gain", "reduction", "reduces", "recovers", "turns"),
    "countering_nodes": lambda spark, d: s.countering(s.decision_space(s.sides(events(spark, d)))).withColumn("rate", F.round("rate", 6)),
    "momentum_series": _momentum,
    "smooth_labels": lambda spark, d: s.smooth(events(spark, d), "match_id", "i", "type").select("match_id", "i", "smoothed"),
    "segment_runs": lambda spark, d: s.segments(s.smooth(events(spark, d), "match_id", "i", "type"), "match_id", "i", "smoothed", 2).drop("segment"),
    "match_stats": lambda spark, d: s.match_stats(s.sides(events(spark, d))),
    "bout_transition_graph": lambda spark, d: s.bout_graph(s.sides(events(spark, d))),
    "decision_space_turns_resolved": lambda spark, d: s.decision_space(_resolved(spark, d)).select("match_id", "i", "side", "own", "other", "gain", "reduction", "reduces", "recovers", "turns"),
    "countering_nodes_resolved": lambda spark, d: s.countering(s.decision_space(_resolved(spark, d))).withColumn("rate", F.round("rate", 6)),
    "momentum_series_resolved": lambda spark, d: _momentum(spark, d, s.resolved_sides),
    "match_stats_resolved": lambda spark, d: s.match_stats(_resolved(spark, d)),
    "bout_transition_graph_resolved": lambda spark, d: s.bout_graph(_resolved(spark, d)),
    "sideless_events": lambda spark, d: s.sideless(_resolved(spark, d)),
    "perspective_events": _perspective,
    "confidence_weighted_edges": _weighted,
    "caption_grouping": lambda spark, d: s.fold_lines(events(spark, d).where("ts IS NOT NULL").withColumn("long", F.lit(4.0)), "match_id", "i", "label", "ts", "long"),
    "label_flips": lambda spark, d: s.flips_per_minute(events(spark, d).where("ts IS NOT NULL"), "match_id", "i", "type", "ts", ("reset", "referee")).withColumn("per_minute", F.round("per_minute", 5)),
}
_W = f"WITH {EV}"
_SMOOTH = """nb AS (SELECT a.match_id, a.i, a.type AS own, b.type AS x, count(*) AS n FROM ev a JOIN ev b ON a.match_id = b.match_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL),
sm AS (SELECT match_id, i, CASE WHEN count(*) = 1 THEN min(x) ELSE min(own) END AS smoothed FROM (SELECT *, rank() OVER (PARTITION BY match_id, i ORDER BY n DESC) AS r FROM nb) WHERE r = 1 GROUP BY 1, 2)"""
ORACLES = {
    "transition_edges": f"{_W}, {_OWN} SELECT source, target, count(*) AS weight, count(*) FILTER (target_ok) AS ok FROM st GROUP BY 1, 2",
    "transition_nodes_reward_risk": f"""{_W}, n1 AS (SELECT *, CASE WHEN actor IS NOT NULL THEN lead(type) OVER o END AS own_type, CASE WHEN actor IS NOT NULL THEN lead(ok) OVER o END AS own_ok, lead(type) OVER w AS nt, lead(ok) OVER w AS nok, lead(actor) OVER w AS na, lead(i) OVER w IS NOT NULL AS fol
        FROM ev WINDOW o AS (PARTITION BY match_id, actor ORDER BY i), w AS (PARTITION BY match_id ORDER BY i)),
        n2 AS (SELECT *, fol AND coalesce(own_type = 'submission' AND own_ok, false) AS rew FROM n1), n3 AS (SELECT *, fol AND NOT rew AND coalesce(nt = 'submission' AND nok AND na <> actor, false) AS rsk FROM n2)
        SELECT label, min(type) AS type, count(*) AS occ, count(*) FILTER (ok) AS ok_count, count(*) FILTER (fol) AS denom, count(*) FILTER (rew) AS reward, count(*) FILTER (rsk) AS risk,
        round(coalesce((count(*) FILTER (rew) - count(*) FILTER (rsk))::DOUBLE / nullif(count(*) FILTER (fol), 0), 0), 6) AS reward_risk FROM n3 GROUP BY label""",
    "transition_reactions": f"{_W}, {_OWN} SELECT source, target, ev.label AS reaction, count(*) AS n FROM st JOIN ev ON ev.match_id = st.match_id AND ev.i > st.i AND ev.i < st.i_to GROUP BY 1, 2, 3",
    "athlete_balanced_edges": f"{_W}, {_OWN}, c AS (SELECT actor, source, target, count(*) AS n FROM st GROUP BY 1, 2, 3), t AS (SELECT *, n / sum(n) OVER (PARTITION BY actor) AS sh FROM c) SELECT source, target, round(sum(sh), 6) AS weight, count(*) AS athletes FROM t GROUP BY 1, 2",
    "trigram_paths": f"{_W}, g AS (SELECT label AS step1, lead(label) OVER o AS step2, lead(label, 2) OVER o AS step3 FROM ev WHERE actor IS NOT NULL WINDOW o AS (PARTITION BY match_id, actor ORDER BY i)), c AS (SELECT step1, step2, step3, count(*) AS count FROM g WHERE step3 IS NOT NULL GROUP BY 1, 2, 3) SELECT *, round(count / sum(count) OVER (PARTITION BY step1), 6) AS share FROM c",
    "type_bigrams": f"{_W}, g AS (SELECT type AS step1, lead(type) OVER o AS step2 FROM ev WHERE actor IS NOT NULL WINDOW o AS (PARTITION BY match_id, actor ORDER BY i)), c AS (SELECT step1, step2, count(*) AS count FROM g WHERE step2 IS NOT NULL GROUP BY 1, 2) SELECT *, round(count / sum(count) OVER (PARTITION BY step1), 6) AS share FROM c",
    "transition_heatmap": f"{_W}, {_OWN}, top AS (SELECT label FROM ev GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 10) SELECT a.label AS source, b.label AS target, count(st.i) AS n FROM top a CROSS JOIN top b LEFT JOIN st ON st.source = a.label AND st.target = b.label GROUP BY 1, 2",
    "actor_runs": f"{_W}, r AS (SELECT *, sum(CASE WHEN lag IS NOT NULL AND same THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER w AS lag, lag(actor) OVER w IS NOT DISTINCT FROM actor AS same FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY i))) SELECT match_id, run::BIGINT AS run, actor, min(i)::INT AS start, max(i)::INT AS end, count(*) AS length FROM r GROUP BY 1, 2, 3",
    "exchange_split": f"{_W}, {_EX} SELECT match_id, exchange::BIGINT AS exchange, count(*) AS events, min(i)::INT AS first_i, max(i)::INT AS last_i FROM ex GROUP BY 1, 2",
    "revisit_counts": f"{_W}, {_EX}, v AS (SELECT *, row_number() OVER (PARTITION BY match_id, exchange, label ORDER BY i) AS k, lag(label) OVER (PARTITION BY match_id, exchange ORDER BY i) AS p FROM ex) SELECT label, count(*) AS revisits FROM v WHERE k > 1 AND p <> label GROUP BY 1",
    "cycle_profile": f"{_W}, {_EX}, c AS (SELECT *, sum(CASE WHEN pr = actor THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, exchange ORDER BY i) AS run FROM (SELECT *, lag(actor) OVER (PARTITION BY match_id, exchange ORDER BY i) AS pr FROM ex)), l AS (SELECT actor, count(*) AS len FROM c GROUP BY match_id, exchange, run, actor) SELECT actor, count(*) AS runs, round(avg(len), 6) AS mean_run, max(len) AS longest, count(*) FILTER (len >= 2) AS sustained, sum(len)::BIGINT AS events FROM l GROUP BY 1",
    "normalize_chain": f"{_W}, c AS (SELECT *, sum(CASE WHEN pl = label AND pt = type THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY i) AS fold FROM (SELECT *, lag(label) OVER w AS pl, lag(type) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY match_id ORDER BY i))) SELECT match_id, min(i)::INT AS i, type, label, count(*) - 1 AS folded FROM c GROUP BY match_id, fold, type, label",
    "decision_space_turns": f"{_W}, {_SPACE} SELECT match_id, i::INT AS i, side, own, other, gain, reduction, reduction >= 0.12 AS reduces, gain >= 0.12 AND mine0 < 0.5 AS recovers, turns FROM sp",
    "countering_nodes": f"{_W}, {_SPACE} SELECT label, count(*) FILTER (turns) AS flips, count(*) AS occ, round(count(*) FILTER (turns) / count(*), 6) AS rate FROM sp GROUP BY 1 HAVING count(*) FILTER (turns) > 0",
    "momentum_series": f"{_W}, {_SIDES}, v(type, val) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {round((a - b) * 100)})' for k, (a, b) in s.DECISION_SPACE.items())}), lt AS (SELECT label, min(type) AS type FROM ev GROUP BY 1), lv AS (SELECT label, coalesce(val, 0) AS val FROM lt LEFT JOIN v USING (type)), m AS (SELECT match_id, i, sum(coalesce(val, 0) * CASE side WHEN 'a' THEN 1 ELSE -1 END) OVER (PARTITION BY match_id ORDER BY i) AS c FROM tg LEFT JOIN lv ON lv.label = tg.label WHERE side IS NOT NULL) SELECT match_id, i::INT AS i, round(0.5 + 0.5 * c / greatest(1e-9, max(abs(c)) OVER (PARTITION BY match_id)), 7) AS momentum FROM m",
    "smooth_labels": f"{_W}, {_SMOOTH} SELECT match_id, i::INT AS i, smoothed FROM sm",
    "segment_runs": f"{_W}, {_SMOOTH}, g AS (SELECT *, sum(CASE WHEN p = smoothed THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY i) AS seg FROM (SELECT *, lag(smoothed) OVER (PARTITION BY match_id ORDER BY i) AS p FROM sm)) SELECT match_id, smoothed, min(i)::INT AS first, max(i)::INT AS last, count(*) AS frames FROM g GROUP BY match_id, seg, smoothed HAVING count(*) >= 2",
    "label_flips": f"{_W}, g AS (SELECT *, lag(type) OVER (PARTITION BY match_id ORDER BY i) AS p FROM ev WHERE ts IS NOT NULL) SELECT match_id, count(*) FILTER (p <> type AND p NOT IN ('reset', 'referee') AND type NOT IN ('reset', 'referee')) AS flips, round(count(*) FILTER (p <> type AND p NOT IN ('reset', 'referee') AND type NOT IN ('reset', 'referee')) * 60.0 / nullif(max(ts) - min(ts), 0), 5) AS per_minute FROM g GROUP BY 1",
    "match_stats": f"{_W}, {_SIDES} SELECT match_id, side, count(*) AS events, count(*) FILTER (ok) AS landed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (type = 'submission') AS subs, count(*) FILTER (type = 'control') AS controls, count(DISTINCT label) AS labels FROM tg WHERE side IS NOT NULL GROUP BY 1, 2",
    "bout_transition_graph": f"{_W}, {_SIDES}, p AS (SELECT *, lag(label) OVER (PARTITION BY match_id ORDER BY i) AS source FROM tg WHERE side IS NOT NULL) SELECT match_id, source, label AS target, count(*) AS n, CASE WHEN count(*) FILTER (side = 'a') * 2 >= count(*) THEN 'a' ELSE 'b' END AS owner FROM p WHERE source <> label GROUP BY 1, 2, 3",
    "perspective_events": f"WITH {EV}, {BOUTS}, sd AS (SELECT match_id, a AS athlete FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT match_id, b FROM bouts WHERE a IS NOT NULL AND b IS NOT NULL) SELECT athlete, CASE WHEN actor IS NULL THEN 'neutral' WHEN actor = athlete THEN 'you' ELSE 'opponent' END AS who, type, count(*) AS n, count(*) FILTER (ok) AS ok FROM ev JOIN sd USING (match_id) GROUP BY 1, 2, 3",
    "confidence_weighted_edges": f"{_W}, {_OWN}, sr AS (SELECT actor, count(DISTINCT match_id) AS b FROM ev WHERE actor IS NOT NULL GROUP BY 1) SELECT source, target, round(sum(b / (b + 5.0::DOUBLE)), 5) AS weight, round(sum(CASE WHEN target_ok THEN b / (b + 5.0::DOUBLE) ELSE 0 END), 5) AS ok FROM st JOIN sr USING (actor) GROUP BY 1, 2",
}
