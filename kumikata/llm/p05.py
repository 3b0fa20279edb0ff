"""Queries of problem 5: one ranking of all athletes of the bout sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.functions.text import blanks, fold
from kumikata.llm.names import link
from kumikata.llm.springs import ranked, strengths
from kumikata.plans.runtime import cut, table

# How the sheet writes the result of the athlete in the first column.
WON = ("v", "w", "vitoria", "won", "win", "venceu", "ganhou")
LOST = ("d", "l", "derrota", "lost", "loss", "perdeu")
NO_WINNER = ("e", "empate", "nulo", "empate/nulo", "draw", "no contest", "nc")


def bouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(winner, loser, draw), one row per bout, and (person, name) of all names in the sheet and the registry.

    A bout that stands in the sheet from both corners or twice counts once: its rows are brought to one corner and the majority of
    their known results holds; a bout without a known result, or with as many wins as losses, counts not at all.
    """
    sheet = table(spark, sf_dir, "lutas").where("atleta IS NOT NULL AND adversario IS NOT NULL").select("linha_id", "match_id", "atleta", "adversario", "resultado")
    names = sheet.select(F.explode(F.array("atleta", "adversario")).alias("name")).unionByName(table(spark, sf_dir, "athletes").select("name"))
    persons = cut(link(names))
    word = blanks(fold(F.col("resultado")))
    result = F.when(word.isin(*WON), 1).when(word.isin(*LOST), -1).when(word.isin(*NO_WINNER), 0)
    told = sheet.withColumn("result", result).where("result IS NOT NULL")
    for side in ("atleta", "adversario"):
        told = told.join(persons.select(F.col("name").alias(side), F.col("person").alias(f"{side}_person")), side)
    first = F.col("atleta_person") < F.col("adversario_person")
    sides = told.where("atleta_person <> adversario_person").select(
        F.coalesce("match_id", F.concat(F.lit("row "), F.col("linha_id").cast("string"))).alias("bout"),
        F.least("atleta_person", "adversario_person").alias("a"), F.greatest("atleta_person", "adversario_person").alias("b"), F.when(first, F.col("result")).otherwise(-F.col("result")).alias("result"),
    )
    votes = sides.groupBy("bout", "a", "b").agg(F.sum(F.signum("result")).alias("balance"), F.count("*").alias("rows"), F.sum(F.when(F.col("result") == 0, 1).otherwise(0)).alias("draws"))
    one = votes.groupBy("bout").agg(F.max_by(F.struct("a", "b", "balance", "draws", "rows"), F.struct("rows", "a", "b")).alias("v")).select("v.*").where("balance <> 0 OR draws > 0")
    up = F.col("balance") > 0
    return one.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("loser"), (F.col("balance") == 0).alias("draw")), persons


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, person, athlete_id, strength, comparisons): all people of the sheet; athlete_id is null for the unregistered."""
    comparisons, persons = bouts(spark, sf_dir)
    found = strengths(comparisons, tie="draw")
    registered = table(spark, sf_dir, "athletes").where("athlete_id IS NOT NULL").join(persons, "name").groupBy("person").agg(F.min("athlete_id").alias("athlete_id"))
    return ranked(found).select("rank", F.col("item").alias("person"), "strength", "comparisons").join(registered, "person", "left").select("rank", "person", "athlete_id", F.round("strength", 4).alias("strength"), "comparisons")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(athlete_id): the strongest tenth of the registered athletes."""
    comparisons, persons = bouts(spark, sf_dir)
    found = strengths(comparisons, tie="draw")
    athletes = table(spark, sf_dir, "athletes").where("athlete_id IS NOT NULL")
    registered = found.join(persons, found["item"] == persons["person"]).join(athletes.select("athlete_id", "name"), "name").select("athlete_id", "strength")
    return ranked(registered, then="athlete_id").where(F.col("rank") <= athletes.count() // 10).select("athlete_id")


QUERIES = {"p5_found": p5_found, "p5_ranking": p5_ranking}
ORACLES: dict[str, str] = {}
