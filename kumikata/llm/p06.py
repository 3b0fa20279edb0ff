"""Queries of problem 6: spellings of one person in the bout sheet and the events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.names import link
from kumikata.plans.runtime import spread, table


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different names in lutas.atleta, lutas.nome_no_banco and match_events.actor."""
    columns = (("lutas", "atleta"), ("lutas", "nome_no_banco"), ("match_events", "actor"))
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, t).select(F.col(c).alias("name")).where("name IS NOT NULL").distinct() for t, c in columns)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b): two different strings that name one person, name_a < name_b by code point."""
    persons = link(spellings(spark, sf_dir))
    a, b = (persons.select("person", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(spread(b), "person").where("name_a < name_b").select("name_a", "name_b")


def p6_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, person): each spelling with the least spelling of its person."""
    return link(spellings(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_persons": p6_persons}
ORACLES: dict[str, str] = {}
