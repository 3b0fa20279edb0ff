"""Ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import ratings as r
from kumikata.plans.runtime import cut, table
from kumikata.sources.views import BOUTS, EV, bouts, decided, events

_B = f"WITH {BOUTS}"
RULES = ("result known", "has a winner", "both sides named", "two people", "year known")


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _pool(spark, d):
    return decided(spark, d).withColumn("pool", F.lit("all"))


def _drawn(spark, d):
    b = bouts(spark, d).where("result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL")
    won = F.col("result") >= 0
    return b.select("match_id", "year", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(won, F.col("b")).otherwise(F.col("a")).alias("loser"), "method", "stage", (F.col("result") == 0).alias("draw"), F.lit("all").alias("pool"))


def _periods(spark, d):
    b = bouts(spark, d).where("result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL")
    return b.select(F.col("year").alias("period"), "a", "b", ((F.col("result") + 1) / 2).alias("score_a"))


def _waterfall(spark, d):
    rules = zip(RULES, (F.col("result").isNotNull(), F.col("result") != 0, F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") != F.col("b"), F.col("year").isNotNull()), strict=True)
    return r.waterfall(bouts(spark, d), list(rules)).groupBy("reason").agg(F.count("*").alias("bouts"))


def _first_sums(spark, d):
    p = _periods(spark, d)
    first = p.agg(F.min("period").alias("period"))
    return _r(r.period_sums(r.observations(p.join(F.broadcast(first), "period")), r.seeds(p)), "inv_v", "score_sum")


def _graph(spark, d):
    b = bouts(spark, d).where("result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL")
    side = lambda x, y, score: b.select("match_id", "year", F.col(x).alias("actor"), F.col(y).alias("opponent"), score.alias("score"))
    sides = side("a", "b", (F.col("result") + 1) / 2).unionByName(side("b", "a", (1 - F.col("result")) / 2))
    sides = r.opponent_rating(sides, r.elo(_pool(spark, d), "pool", ["year", "match_id"]).select("athlete", F.col("elo").alias("rating")))
    last = b.agg(F.max("year").alias("last")).withColumn("one", F.lit(0))
    sides = sides.withColumn("one", F.lit(0)).join(F.broadcast(last), "one").withColumn("months", 12.0 * (F.col("last") - F.col("year")))
    rows = events(spark, d).where("actor IS NOT NULL").select("match_id", "actor", "label").distinct().join(sides, ["match_id", "actor"])
    seq = F.concat_ws("|", F.col("year").cast("string"), "match_id")
    return r.graph_elo(rows.select(F.col("actor").alias("athlete"), seq.alias("seq"), "label", "score", F.col("opponent_rating").alias("opponent"), "months"))


def _node_rows(spark, d):
    """(match, period, a, b, score_a) and what each side showed."""
    b = bouts(spark, d).where("result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL")
    shown = events(spark, d).where("actor IS NOT NULL AND type <> 'transition'").groupBy(F.col("match_id").alias("match"), F.col("actor").alias("athlete"), F.col("label").alias("node")).agg(F.count("*").alias("occurrences"))
    return b.select(F.col("match_id").alias("match"), F.col("year").alias("period"), "a", "b", ((F.col("result") + 1) / 2).alias("score_a")), cut(shown)


def _nodes(spark, d):
    """Athletes' techniques on a track of their own, against the opponents' general ratings."""
    rows, shown = _node_rows(spark, d)
    track = r.node_track(rows, shown)[1]
    return _r(track.drop("cell"), "rating", "deviation", "seed", digits=4).withColumns({"volatility": F.round("volatility", 8), "tier": r.tier(F.col("deviation"))})


def _sweep(spark, d):
    """The node track's grid, each cell judged on the bouts after 2023."""
    rows, shown = _node_rows(spark, d)
    grid = [(f"{w}/{rd:.0f}/{tau}", w, rd, tau, 0.06) for w in (0.1, 0.25, 0.5, 1.0) for rd in (220.0, 280.0, 350.0) for tau in (0.3, 0.5, 0.7)]
    states, track = r.node_track(rows.where("period <= 2023"), shown, grid)
    told = r.node_criteria(states, track, rows.where("period > 2023"), shown)
    return _r(told, *[c for c in told.columns if c not in ("cell", "nodes", "holdout", "calibrated")])


def _submissions_blend(spark, d):
    """Each submission with the combined state of those whom it has beaten."""
    states = r.glicko2(_periods(spark, d))
    won = decided(spark, d).where("submission <> ''").select("loser", "submission")
    told = r.blend(won.join(states.select(F.col("athlete").alias("loser"), "rating", "deviation"), "loser"), "submission")
    return told.select("submission", F.round("rating", 4).alias("rating"), F.round("deviation", 4).alias("deviation"), r.tier(F.col("deviation")).alias("tier"))


def _scores(spark, d):
    """Each side's score of a bout from its result, its kind and the points of its events."""
    b = bouts(spark, d).where("result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b")
    points = events(spark, d).where("actor IS NOT NULL").groupBy("match_id", "actor").agg(F.sum(_points()).alias("points"))
    told = b.select("match_id", "a", "b", "result", F.when(F.col("result") == 0, "DRAW").when(F.col("submission") != "", "SUBMISSION").alias("kind"))
    for x in "ab":
        told = told.join(points.select("match_id", F.col("actor").alias(x), F.col("points").alias(f"p{x}")), ["match_id", x], "left")
    return told.select("match_id", F.round(r.match_score(F.col("result") > 0, F.coalesce("kind", F.lit("")), F.coalesce("pa", F.lit(0)), F.coalesce("pb", F.lit(0))), 6).alias("score_a"), F.round(r.match_score(F.col("result") < 0, F.coalesce("kind", F.lit("")), F.coalesce("pb", F.lit(0)), F.coalesce("pa", F.lit(0))), 6).alias("score_b"))


def _points():
    return F.coalesce(*[F.when(F.coalesce(F.col("ok"), F.lit(True)) & (F.col("type") == k), v) for k, v in POINTS.items()], F.lit(0))


def _weights(spark, d):
    """What an athlete's events weigh under three ways of counting: each event, by precision, bounded; as shares of all."""
    n = events(spark, d).where("actor IS NOT NULL").groupBy("actor").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("bouts"))
    deviation = F.lit(350.0) / F.sqrt(F.col("bouts") + 0.0)
    told = n.withColumns({"flat": F.col("n") + 0.0, "precise": F.col("n") * r.precision_weight(deviation), "bounded": F.col("n") * r.bounded_weight(deviation)}).withColumn("one", F.lit(0))
    total = told.groupBy("one").agg(*[F.sum(c).alias(f"_{c}") for c in ("flat", "precise", "bounded")])
    return told.join(F.broadcast(total), "one").select("actor", "bouts", *[F.round(F.col(c) / F.col(f"_{c}"), 8).alias(c) for c in ("flat", "precise", "bounded")])


def _pools(spark, d):
    """The ten best edges' mean ratings of each kind of owner, by source."""
    rated = table(spark, d, "graph_edges").where("owner_kind IS NOT NULL").groupBy(F.col("owner_kind").alias("pool"), F.col("graph_id").alias("athlete")).agg(F.round(F.avg("elo"), 6).alias("rating"))
    return r.ranked_pools(rated, "pool", 10)


#: What an event is worth on the score.
POINTS = {"takedown": 2, "sweep": 2, "pass": 3, "control": 4}

QUERIES = {
    "elo_full": lambda spark, d: _r(r.elo(_pool(spark, d), "pool", ["year", "match_id"]), "elo", "peak", digits=4),
    "elo_by_division": lambda spark, d: _r(r.elo(_pool(spark, d), "division", ["year", "match_id"]), "elo", "peak", digits=4),
    "elo_with_draws": lambda spark, d: _r(r.elo(_drawn(spark, d), "pool", ["year", "match_id"], draws=True), "elo", "peak", digits=4),
    "finish_elo_peak": lambda spark, d: r.elo(_pool(spark, d), "pool", ["year", "match_id"], 32.0, finish_bump=8.0, digits=2),
    "calibrate_k": lambda spark, d: _r(r.calibrate_k(_pool(spark, d), "pool", ["year", "match_id"], tuple(float(k) for k in range(10, 81, 5)), 120.0), "std", digits=4),
    "eligibility_waterfall": _waterfall,
    "glicko2_first_period_sums": _first_sums,
    "glicko2_replay": lambda spark, d: _r(r.glicko2(_periods(spark, d)), "rating", "deviation", digits=4).withColumn("volatility", F.round("volatility", 8)),
    "node_ratings": _nodes,
    "node_sweep": _sweep,
    "submissions_blend": _submissions_blend,
    "bout_scores": _scores,
    "confidence_weights": _weights,
    "ranked_pools": _pools,
    "graph_elo_replay": _graph,
    "rating_summary": lambda spark, d: _r(r.summary(table(spark, d, "graph_edges"), "owner_kind", "elo"), "mean", "median", "p10", "p90", "most", digits=4),
    "log_loss_holdout": lambda spark, d: _r(r.log_loss(_periods(spark, d), 2023), "loss", "accuracy"),
}
_mult = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END::DOUBLE"


def _elo_sql(rows: str, pool: str, k: str, drawn: str = "false", digits: int | None = None) -> str:
    """The fold as a recursion: one step a bout and pool, the ratings in a map."""
    whole = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    shown = lambda x: f"round({x}, 4)" if digits is None else x
    return f"""WITH RECURSIVE {BOUTS}, src AS ({rows}),
rw AS (SELECT {pool} AS pool, row_number() OVER (PARTITION BY {pool} ORDER BY year, match_id) AS n, winner AS w, loser AS l, year, {drawn} AS drawn, ({k})::DOUBLE * ({_mult('method', r.WIN_MULT)}) * ({_mult('stage', r.STAGE_MULT)}) AS f FROM src),
e(pool, n, m, w, l, wr, lr) AS (SELECT DISTINCT pool, 0::BIGINT, MAP([]::VARCHAR[], []::DOUBLE[]), NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE FROM rw
    UNION ALL SELECT pool, n, map_concat(m, MAP([w, l], [{whole('a + d')}, {whole('b - d')}])), w, l, {whole('a + d')}, {whole('b - d')} FROM (SELECT *, f * CASE WHEN drawn THEN 0.5 - c * (1 - q) - 0.5 * q ELSE 1 - c END AS d FROM (
        SELECT *, 1 / (1 + pow(10.0::DOUBLE, (b - a) / 400)) AS c, {r.DRAW_SCALE} / ({r.DRAW_SCALE} + abs(a - b)) AS q FROM (SELECT rw.*, e.m, coalesce(e.m[rw.w], {r.INITIAL})::DOUBLE AS a, coalesce(e.m[rw.l], {r.INITIAL})::DOUBLE AS b FROM e JOIN rw ON rw.pool IS NOT DISTINCT FROM e.pool AND rw.n = e.n + 1)))),
o AS (SELECT e.pool, e.n, e.w AS athlete, e.wr AS x, year, CASE WHEN drawn THEN 0 ELSE 1 END AS won, 0 AS lost, drawn::INT AS dr FROM e JOIN rw ON rw.pool IS NOT DISTINCT FROM e.pool AND rw.n = e.n UNION ALL SELECT e.pool, e.n, e.l, e.lr, year, 0, CASE WHEN drawn THEN 0 ELSE 1 END, drawn::INT FROM e JOIN rw ON rw.pool IS NOT DISTINCT FROM e.pool AND rw.n = e.n)
SELECT pool, athlete, {shown('arg_max(x, n)')} AS elo, {shown(f'greatest({r.INITIAL}::DOUBLE, max(x))')} AS peak, count(*) AS matches, sum(won)::BIGINT AS wins, sum(lost)::BIGINT AS losses, sum(dr)::BIGINT AS draws, max(year) AS last_year FROM o GROUP BY 1, 2"""


_G = "(1 / sqrt(1 + 3 * pow(250.0::DOUBLE / 173.7178, 2) / pow(pi(), 2)))"
ORACLES = {
    "eligibility_waterfall": f"{_B}, w AS (SELECT CASE WHEN result IS NULL THEN '{RULES[0]}' WHEN result = 0 THEN '{RULES[1]}' WHEN a IS NULL OR b IS NULL THEN '{RULES[2]}' WHEN a = b THEN '{RULES[3]}' WHEN year IS NULL THEN '{RULES[4]}' ELSE 'eligible' END AS reason FROM bouts) SELECT reason, count(*) AS bouts FROM w GROUP BY 1",
    "glicko2_first_period_sums": f"{_B}, p AS (SELECT year, a, b, (result + 1) / 2.0::DOUBLE AS s FROM bouts WHERE result IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL), fp AS (SELECT * FROM p WHERE year = (SELECT min(year) FROM p)), o AS (SELECT a AS athlete, s FROM fp UNION ALL SELECT b, 1 - s FROM fp) SELECT athlete, round(sum({_G} * {_G} * 0.25), 6) AS inv_v, round(sum({_G} * (s - 0.5)), 6) AS score_sum FROM o GROUP BY 1",
    "rating_summary": "SELECT owner_kind, count(elo) AS n, round(avg(elo), 4) AS mean, round(quantile_cont(elo, 0.5), 4) AS median, round(quantile_cont(elo, 0.1), 4) AS p10, round(quantile_cont(elo, 0.9), 4) AS p90, round(max(elo), 4) AS most FROM graph_edges GROUP BY 1",
    "bout_scores": f"WITH {EV}, {BOUTS}, b2 AS (SELECT * FROM bouts WHERE result IS NOT NULL AND a <> b), pt AS (SELECT match_id, actor, sum(CASE WHEN coalesce(ok, true) THEN CASE type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in POINTS.items())} ELSE 0 END ELSE 0 END) AS p FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), x AS (SELECT b2.match_id, result, submission, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb FROM b2 LEFT JOIN pt x ON x.match_id = b2.match_id AND x.actor = a LEFT JOIN pt y ON y.match_id = b2.match_id AND y.actor = b), s AS (SELECT *, CASE WHEN pa + pb = 0 THEN NULL ELSE pa / (pa + pb)::DOUBLE END AS sh FROM x) SELECT match_id, round(CASE WHEN result = 0 THEN 0.5 WHEN submission <> '' THEN CASE WHEN result > 0 THEN 1.0 ELSE 0.0 END WHEN result > 0 THEN greatest(0.5::DOUBLE, coalesce(0.375::DOUBLE + 0.5 * sh, 0.75)) ELSE least(0.5::DOUBLE, coalesce(0.125::DOUBLE + 0.5 * sh, 0.25)) END, 6)::DOUBLE AS score_a, round(CASE WHEN result = 0 THEN 0.5 WHEN submission <> '' THEN CASE WHEN result < 0 THEN 1.0 ELSE 0.0 END WHEN result < 0 THEN greatest(0.5::DOUBLE, coalesce(0.375::DOUBLE + 0.5 * (1 - sh), 0.75)) ELSE least(0.5::DOUBLE, coalesce(0.125::DOUBLE + 0.5 * (1 - sh), 0.25)) END, 6)::DOUBLE AS score_b FROM s",
    "confidence_weights": f"WITH {EV}, n AS (SELECT actor, count(*)::DOUBLE AS n, count(DISTINCT match_id) AS bouts FROM ev WHERE actor IS NOT NULL GROUP BY 1), w AS (SELECT *, 350.0::DOUBLE / sqrt(bouts) AS rd FROM n), v AS (SELECT actor, bouts, n AS f, n / (rd * rd) AS p, n / (1 + (rd / 200.0) * (rd / 200.0)) AS b FROM w) SELECT actor, bouts, round(f / sum(f) OVER (), 8) AS flat, round(p / sum(p) OVER (), 8) AS precise, round(b / sum(b) OVER (), 8) AS bounded FROM v",
    "ranked_pools": "WITH m AS (SELECT owner_kind AS pool, graph_id AS athlete, round(avg(elo), 6) AS rating FROM graph_edges WHERE owner_kind IS NOT NULL GROUP BY 1, 2) SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY rating DESC, athlete) AS place, athlete, rating FROM m QUALIFY place <= 10",
    "elo_full": _elo_sql("SELECT * FROM won", "'all'", "40"),
    "elo_by_division": _elo_sql("SELECT * FROM won", "division", "40"),
    "elo_with_draws": _elo_sql("SELECT match_id, year, CASE WHEN result >= 0 THEN a ELSE b END AS winner, CASE WHEN result >= 0 THEN b ELSE a END AS loser, method, stage, result = 0 AS dw FROM bouts WHERE result IS NOT NULL AND a <> b AND year IS NOT NULL", "'all'", "40", "dw"),
    "finish_elo_peak": _elo_sql("SELECT * FROM won", "'all'", "CASE WHEN method = 'SUBMISSION' THEN 40 ELSE 32 END", digits=2),
}
