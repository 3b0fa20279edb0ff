"""The data model over stored tables: events of bouts, bouts with a winner, athletes' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kumikata.plans.runtime import table


def node_key(col: Column) -> Column:
    """Lower case, trimmed, nothing but a-z, 0-9 and single blanks: the key form of a label. Accented letters are dropped."""
    # what else a label holds is told by taking the allowed letters out: several times as fast as a regular expression
    low = F.lower(F.trim(col))
    other = F.translate(low, "abcdefghijklmnopqrstuvwxyz0123456789 ", "")
    return F.trim(F.regexp_replace(F.when(other == "", low).otherwise(F.call_function("translate", low, other, F.lit(""))), "  +", " "))


def person_key(col: Column) -> Column:
    """Lower case with single blanks; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(col), r"\s+", " ")), F.lit(""))


def events(spark: SparkSession, sf_dir: str, by_bout: bool = False, of: tuple[str, ...] = ("meet_id", "label", "type", "actor", "ok", "ts")) -> DataFrame:
    """(match_id, meet_id, idx, i, label, type, actor, ok, ts): each bout's events once, with a label, numbered from 1.

    An `idx` delivered twice counts once, the first arrival stands. `ok` is three-valued: null is neither success nor failure. `by_bout` brings bouts together before
    duplicates go: one exchange for both and for what follows by bout. `of`, which must name the label, are the columns that are carried besides match_id, idx and i.
    """
    raw = table(spark, sf_dir, "match_events").where("match_id IS NOT NULL AND idx IS NOT NULL")
    stored = [{"ok": "successful"}.get(c, c) for c in of]
    told = {
        "meet_id": F.col("e.meet_id"), "label": node_key(F.col("e.label")), "type": F.coalesce(F.nullif(F.lower(F.trim("e.type")), F.lit("")), F.lit("transition")),
        "actor": person_key(F.col("e.actor")), "ok": F.col("e.successful"), "ts": F.col("e.ts"),
    }
    named = lambda frame, *rest: frame.select("match_id", "idx", *rest, *[told[c].alias(c) for c in of])
    if by_bout:
        # named before the window, which no condition on the label passes: it would be worked out once more there
        laid = named(raw.select("event_id", "match_id", "idx", *stored).repartition("match_id").select("event_id", "match_id", "idx", F.struct(*stored).alias("e")), "event_id")
        before = F.lag("idx").over(Window.partitionBy("match_id").orderBy("idx", F.asc_nulls_last("event_id")))
        kept = laid.withColumn("_before", before).where("NOT (idx <=> _before)").drop("_before", "event_id")
    else:
        kept = named(raw.groupBy("match_id", "idx").agg(F.min_by(F.struct(*stored), "event_id").alias("e")))
    return kept.where("label <> ''").withColumn("i", F.row_number().over(Window.partitionBy("match_id").orderBy("idx")))


def result(col: Column) -> Column:
    """1 won, -1 lost, 0 no winner, null unknown, from the writings of a result column."""
    word = F.lower(F.trim(col))
    return F.when(word.isin("v", "w", "vitória"), 1).when(word.isin("d", "l", "derrota"), -1).when(word.isin("e", "empate", "nulo", "empate/nulo"), 0)


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, linha_id, a, b, result, year, event, stage, method, submission, division): the sheet's first row of each bout."""
    raw = table(spark, sf_dir, "lutas").where("match_id IS NOT NULL")
    columns = ("linha_id", "atleta", "adversario", "resultado", "ano", "evento", "fase", "metodo", "finalizacao", "divisao")
    first = raw.groupBy("match_id").agg(F.min_by(F.struct(*columns), "linha_id").alias("r")).select("match_id", "r.*")
    return first.select(
        "match_id", "linha_id", person_key(F.col("atleta")).alias("a"), person_key(F.col("adversario")).alias("b"), result(F.col("resultado")).alias("result"), F.col("ano").alias("year"), F.col("evento").alias("event"),
        F.col("fase").alias("stage"), F.col("metodo").alias("method"), node_key(F.col("finalizacao")).alias("submission"), F.col("divisao").alias("division"),
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, linha_id, year, winner, loser, method, stage, submission, division, event): bouts with a winner, a year and two sides."""
    frame = bouts(spark, sf_dir).where("result <> 0 AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL")
    won = F.col("result") > 0
    return frame.select("match_id", "linha_id", "year", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(won, F.col("b")).otherwise(F.col("a")).alias("loser"), "method", "stage", "submission", "division", "event")


#: The same views for DuckDB.
EV = r"""
d AS (SELECT *, row_number() OVER (PARTITION BY match_id, idx ORDER BY event_id) AS rn FROM match_events WHERE match_id IS NOT NULL AND idx IS NOT NULL),
e AS (SELECT match_id, meet_id, idx, trim(regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS label,
    coalesce(nullif(lower(trim(type)), ''), 'transition') AS type, nullif(trim(regexp_replace(lower(actor), '\s+', ' ', 'g')), '') AS actor, successful AS ok, ts FROM d WHERE rn = 1),
ev AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY idx) AS i FROM e WHERE label <> '')"""
BOUTS = r"""
f AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY linha_id) AS rn FROM lutas WHERE match_id IS NOT NULL),
bouts AS (SELECT match_id, linha_id, nullif(trim(regexp_replace(lower(atleta), '\s+', ' ', 'g')), '') AS a, nullif(trim(regexp_replace(lower(adversario), '\s+', ' ', 'g')), '') AS b,
    CASE WHEN lower(trim(resultado)) IN ('v', 'w', 'vitória') THEN 1 WHEN lower(trim(resultado)) IN ('d', 'l', 'derrota') THEN -1 WHEN lower(trim(resultado)) IN ('e', 'empate', 'nulo', 'empate/nulo') THEN 0 END AS result,
    ano AS year, evento AS event, fase AS stage, metodo AS method, trim(regexp_replace(regexp_replace(lower(trim(finalizacao)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS submission, divisao AS division FROM f WHERE rn = 1),
won AS (SELECT match_id, linha_id, year, CASE WHEN result > 0 THEN a ELSE b END AS winner, CASE WHEN result > 0 THEN b ELSE a END AS loser, method, stage, submission, division, event
    FROM bouts WHERE result <> 0 AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND year IS NOT NULL)"""
