"""Statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumikata.operators import stats as t
from kumikata.sources.views import BOUTS, EV, bouts, decided, events

_W, _B = f"WITH {EV}", f"WITH {BOUTS}"
Z = t.Z95


def _r(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _rates(spark, d):
    return events(spark, d).where("actor IS NOT NULL").groupBy("type").agg(F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("k"), F.count("ok").alias("n"))


def _wilson(spark, d):
    rates = events(spark, d).groupBy("label").agg(F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("k"), F.count("ok").alias("n"))
    return _r(rates.withColumns(t.wilson(F.col("k"), F.col("n"))), "p", "lo", "hi", "half")


def _pairs(spark, d):
    rates = _rates(spark, d)
    x, y = rates.select(F.col("type").alias("a"), F.col("k").alias("k1"), F.col("n").alias("n1")), rates.select(F.col("type").alias("b"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    return x.join(y, F.col("a") < F.col("b"))


def _contrast(spark, d):
    told = _pairs(spark, d).withColumns(t.contrast(*map(F.col, ("k1", "n1", "k2", "n2"))))
    return _r(told, "diff", "diff_lo", "diff_hi", "ratio", "ratio_lo", "ratio_hi")


def _bh(spark, d):
    tests = _pairs(spark, d).withColumn("p", t.contrast_p("k1", "n1", "k2", "n2")).withColumn("test", F.concat_ws(" / ", "a", "b"))
    return _r(t.benjamini_hochberg(tests.select("test", "p"), "p", "test"), "p", "q", digits=5)


def _q(spark, d):
    """A family of stated numbers in (0, 1) for the step-up alone."""
    e = events(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("ok"), F.lit(False))).alias("k"))
    return _r(t.benjamini_hochberg(e.select("label", ((F.col("k") + 1.0) / (F.col("n") * 3 + 2)).alias("p")), "p", "label"), "p", "q")


def _counts(spark, d, *keys):
    return events(spark, d).where("actor IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))


def _activity(spark, d):
    ev = events(spark, d).where("actor IS NOT NULL")
    own = ev.groupBy("actor").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("bouts"), F.count_distinct("label").alias("labels"), F.count_if(F.col("type") == "submission").alias("subs"), F.avg(F.col("ok").cast("double")).alias("rate"))
    won = decided(spark, d).groupBy(F.col("winner").alias("actor")).agg(F.count("*").alias("wins"))
    return own.join(won, "actor", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def _auc(spark, d):
    per = events(spark, d).where("actor IS NOT NULL").groupBy("match_id", "actor").agg(F.count("*").alias("n"))
    b = decided(spark, d)
    sides = b.select("match_id", F.col("winner").alias("actor"), F.lit(True).alias("won")).unionByName(b.select("match_id", F.col("loser").alias("actor"), F.lit(False).alias("won")))
    return _r(t.auc(per.join(sides, ["match_id", "actor"]), "n", "won"), "auc")


def _lift_stability(spark, d):
    """The open class against all other bouts, as in lift_table, in both weightings."""
    ev = events(spark, d).where("actor IS NOT NULL").select("match_id", "actor", "label")
    absolute = bouts(spark, d).where("division = 'ABS'").select("match_id")
    inside, outside = ev.join(absolute, "match_id", "left_semi"), ev.join(absolute, "match_id", "left_anti")
    both = [t.lift_stability(inside, outside, "actor", "label", balanced).withColumn("weighting", F.lit("balanced" if balanced else "pooled")) for balanced in (False, True)]
    return _r(both[0].unionByName(both[1]), "lift", "stable_share")


QUERIES = {
    "wilson_by_group": _wilson,
    "proportion_contrast": _contrast,
    "contrast_fdr": _bh,
    "chi_square_cramers_v": lambda spark, d: _r(t.chi_square(bouts(spark, d).where("division IS NOT NULL").groupBy("division", "method").agg(F.count("*").alias("n")), "division", "method"), "chi2", "cramers_v", digits=5),
    "bh_qvalues": _q,
    "spearman_rank": lambda spark, d: _r(t.spearman(_activity(spark, d), "n", "wins"), "rho", "lo", "hi"),
    "auc_mann_whitney": _auc,
    "cmi_bits": lambda spark, d: _r(t.mutual_information(_counts(spark, d, "actor", "type", "ok").withColumn("ok", F.coalesce(F.col("ok").cast("string"), F.lit("unknown"))), "actor", "type", "ok"), "bits"),
    "posterior_effects": lambda spark, d: _r(t.posterior_effects(bouts(spark, d).where("division IS NOT NULL AND stage IS NOT NULL").groupBy("division", "stage", "method").agg(F.count("*").alias("n")), "division", "stage", "method"), "effect"),
    "partial_correlation": lambda spark, d: _r(t.partial_correlation(_activity(spark, d), "labels", "subs", "n"), "rxy", "rxz", "ryz", "partial", digits=5),
    "metric_redundancy": lambda spark, d: _r(t.redundancy(_activity(spark, d), ["n", "bouts", "labels", "subs", "rate", "wins"]), "r", digits=5),
    "cluster_coverage": lambda spark, d: _r(t.coverage(_counts(spark, d, "type", "actor"), "type", "actor"), "effective", "top_share", digits=5),
    "beta_intervals": lambda spark, d: _rates(spark, d).withColumn("b", t.beta_interval("k", "n")).select("type", "k", "n", *[F.round(f"b.{c}", 6).alias(c) for c in ("mean", "lo", "hi")]),
    "bootstrap_ci": lambda spark, d: _r(t.bootstrap(events(spark, d).where("actor IS NOT NULL AND ok IS NOT NULL").groupBy("type", "actor").agg(F.sum(F.col("ok").cast("int")).alias("k"), F.count("*").alias("n")), "type", "actor", "k", "n"), "rate", "lo", "hi"),
    "permutation_p": lambda spark, d: t.permutation(bouts(spark, d).where("division IS NOT NULL AND stage IS NOT NULL").groupBy("division", "stage", "method").agg(F.count("*").alias("n")), "division", "stage", "method"),
    "lift_stability": _lift_stability,
}
_P = f"(k / n::DOUBLE)"
_D = f"(1 + {Z * Z!r}::DOUBLE / n)"
_HALF = f"({Z!r}::DOUBLE / {_D} * sqrt({_P} * (1 - {_P}) / n + {Z * Z!r}::DOUBLE / (4.0::DOUBLE * n * n)))"
_MID = f"(({_P} + {Z * Z!r}::DOUBLE / (2.0::DOUBLE * n)) / {_D})"
_RATES = "rates AS (SELECT type, count(*) FILTER (ok)::DOUBLE AS k, count(ok)::DOUBLE AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1), pr AS (SELECT a.type AS a, a.k AS k1, a.n AS n1, b.type AS b, b.k AS k2, b.n AS n2, (a.k + 1) / (a.n + 2) AS q1, (b.k + 1) / (b.n + 2) AS q2 FROM rates a JOIN rates b ON a.type < b.type)"
_ACT = "own AS (SELECT actor, count(*) AS n, count(DISTINCT match_id) AS bouts, count(DISTINCT label) AS labels, count(*) FILTER (type = 'submission') AS subs, avg(ok::INT) AS rate FROM ev WHERE actor IS NOT NULL GROUP BY 1), ww AS (SELECT winner AS actor, count(*) AS wins FROM won GROUP BY 1), act AS (SELECT own.*, coalesce(wins, 0) AS wins FROM own LEFT JOIN ww USING (actor))"
_M = ["n", "bouts", "labels", "subs", "rate", "wins"]
ORACLES = {
    "wilson_by_group": f"{_W}, c AS (SELECT label, count(*) FILTER (ok) AS k, count(ok) AS n FROM ev GROUP BY 1) SELECT label, k, n, CASE WHEN n > 0 THEN round({_P}, 6) END AS p, CASE WHEN n > 0 THEN round(greatest(0, {_MID} - {_HALF}), 6) END AS lo, CASE WHEN n > 0 THEN round(least(1, {_MID} + {_HALF}), 6) END AS hi, CASE WHEN n > 0 THEN round({_HALF}, 6) END AS half, CASE WHEN n = 0 THEN 'none' WHEN n < 5 THEN 'insufficient' WHEN {_HALF} <= 0.08 THEN 'adequate' WHEN {_HALF} <= 0.15 THEN 'moderate' ELSE 'low' END AS grade FROM c",
    "proportion_contrast": f"{_W}, {_RATES}, s AS (SELECT *, sqrt(q1 * (1 - q1) / (n1 + 2) + q2 * (1 - q2) / (n2 + 2)) AS se, ln((k1 / n1) / (k2 / n2)) AS lg, sqrt(1 / k1 - 1 / n1 + 1 / k2 - 1 / n2) AS sp FROM pr) SELECT a, b, k1::BIGINT AS k1, n1::BIGINT AS n1, k2::BIGINT AS k2, n2::BIGINT AS n2, round(k1 / n1 - k2 / n2, 6) AS diff, round(q1 - q2 - {Z!r}::DOUBLE * se, 6) AS diff_lo, round(q1 - q2 + {Z!r}::DOUBLE * se, 6) AS diff_hi, round(exp(lg), 6) AS ratio, round(exp(lg - {Z!r}::DOUBLE * sp), 6) AS ratio_lo, round(exp(lg + {Z!r}::DOUBLE * sp), 6) AS ratio_hi, exp(lg - {Z!r}::DOUBLE * sp) > 1 OR exp(lg + {Z!r}::DOUBLE * sp) < 1 AS significant FROM s",
    "chi_square_cramers_v": f"{_B}, c AS (SELECT division, method, count(*) AS n FROM bouts WHERE division IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY division) AS r, sum(n) OVER (PARTITION BY method) AS k, sum(n) OVER () AS t FROM c), s AS (SELECT max(t) * (sum(n * n / (r * k)::DOUBLE) - 1) AS chi2, (count(DISTINCT division) - 1) * (count(DISTINCT method) - 1) AS dof, max(t)::BIGINT AS total, least(count(DISTINCT division), count(DISTINCT method)) - 1 AS l FROM m) SELECT round(chi2, 5) AS chi2, dof, total, round(sqrt(chi2 / (total * l)), 5) AS cramers_v FROM s",
    "bh_qvalues": f"{_W}, c AS (SELECT label, (count(*) FILTER (ok) + 1.0::DOUBLE) / (count(*) * 3 + 2) AS p FROM ev GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, label) AS rk, count(*) OVER () AS m FROM c) SELECT label, round(p, 6) AS p, round(least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r",
    "spearman_rank": f"WITH {EV}, {BOUTS}, {_ACT}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS x, rank() OVER (ORDER BY wins) + (count(*) OVER (PARTITION BY wins) - 1) / 2 AS y FROM act), s AS (SELECT count(*) AS n, corr(x, y) AS rho FROM r) SELECT n, round(rho, 6) AS rho, round((exp(2 * (atanh(rho) - {Z!r}::DOUBLE / sqrt(n - 3))) - 1) / (exp(2 * (atanh(rho) - {Z!r}::DOUBLE / sqrt(n - 3))) + 1), 6) AS lo, round((exp(2 * (atanh(rho) + {Z!r}::DOUBLE / sqrt(n - 3))) - 1) / (exp(2 * (atanh(rho) + {Z!r}::DOUBLE / sqrt(n - 3))) + 1), 6) AS hi FROM s",
    "auc_mann_whitney": f"WITH {EV}, {BOUTS}, p AS (SELECT match_id, actor, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), s AS (SELECT match_id, winner AS actor, true AS won FROM won UNION ALL SELECT match_id, loser, false FROM won), x AS (SELECT n, s.won AS won FROM p JOIN s USING (match_id, actor)), g AS (SELECT n, count(*) FILTER (won) AS pos, count(*) FILTER (NOT won) AS neg FROM x GROUP BY 1), u AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS positives, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM u",
    "cmi_bits": f"{_W}, c AS (SELECT actor, type, coalesce(ok::VARCHAR, 'unknown') AS ok, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY actor, type) AS x, sum(n) OVER (PARTITION BY actor, ok) AS y, sum(n) OVER (PARTITION BY actor) AS t FROM c) SELECT actor, sum(n)::BIGINT AS n, round(greatest(0, sum(n / t * log2(n * t / (x * y)::DOUBLE))), 6) AS bits FROM m GROUP BY 1",
    "posterior_effects": f"{_B}, c AS (SELECT division, stage, method, count(*) AS n FROM bouts WHERE division IS NOT NULL AND stage IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY division, stage) AS c, sum(n) OVER (PARTITION BY division, method) AS r, sum(n) OVER (PARTITION BY division) AS t FROM c) SELECT division, stage, method, n, round((n + 1.0::DOUBLE) / (c + 2) - (r - n + 1.0::DOUBLE) / (t - c + 2), 6) AS effect FROM m",
    "partial_correlation": f"WITH {EV}, {BOUTS}, {_ACT}, s AS (SELECT count(*) AS n, corr(labels, subs) AS rxy, corr(labels, n) AS rxz, corr(subs, n) AS ryz FROM act) SELECT n, round(rxy, 5) AS rxy, round(rxz, 5) AS rxz, round(ryz, 5) AS ryz, round((rxy - rxz * ryz) / sqrt((1 - rxz * rxz) * (1 - ryz * ryz)), 5) AS partial FROM s",
    "metric_redundancy": f"WITH {EV}, {BOUTS}, {_ACT}, p AS (" + " UNION ALL ".join(f"SELECT '{x}' AS metric, '{y}' AS sibling, corr({x}, {y}) AS r FROM act" for x in _M for y in _M if x != y) + ") SELECT metric, sibling, round(r, 5) AS r FROM p QUALIFY row_number() OVER (PARTITION BY metric ORDER BY abs(r) DESC, sibling) = 1",
    "cluster_coverage": f"{_W}, c AS (SELECT type, actor, count(*) AS n FROM ev WHERE actor IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY type) AS s FROM c), g AS (SELECT type, count(*) AS clusters, 1 / sum(s * s) AS effective, max(s) AS top_share FROM s GROUP BY 1) SELECT type, clusters, round(effective, 5) AS effective, round(top_share, 5) AS top_share, CASE WHEN clusters < 5 OR effective < 2 THEN 'withheld' WHEN effective >= 5 THEN 'adequate' WHEN effective >= 3 THEN 'moderate' ELSE 'low' END AS grade, CASE WHEN clusters < 5 THEN 'too few sources' WHEN effective < 2 THEN 'one source dominates' END AS reason FROM g",
}
