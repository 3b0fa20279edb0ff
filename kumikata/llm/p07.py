"""Queries of problem 7: techniques that athletes show one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.bouts import ordered
from kumikata.llm.sequences import frequent
from kumikata.plans.runtime import cut, table


def sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(match_id, side, codes): the library techniques of each athlete in each bout, in order; and the keys by code."""
    bouts, codes = ordered(table(spark, sf_dir, "match_events"), table(spark, sf_dir, "technique_nodes"), library_only=True)
    real = bouts.select("match_id", "chunk", F.filter("events", lambda e: e["side"].isNotNull() & e["code"].isNotNull()).alias("events"))
    by_side = real.select("match_id", "chunk", "events", F.explode(F.array_distinct(F.transform("events", lambda e: e["side"]))).alias("side"))
    parts = by_side.select("match_id", "side", "chunk", F.transform(F.filter("events", lambda e: e["side"] == F.col("side")), lambda e: e["code"]).alias("codes"))
    whole = parts.groupBy("match_id", "side").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "codes"))), lambda c: c["codes"])).alias("codes"))
    keys = {r["code"]: r["node_key"] for r in codes.collect()}  # of the curated library
    return cut(whole), [keys[i] for i in range(len(keys))]


def p7_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step1, step2, step3, support, sequences): three different techniques in this order, in 5 and 1 % of all sequences."""
    found, keys = sequences(spark, sf_dir)
    names = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    patterns = frequent(found, len(keys))
    return patterns.select(*[F.get(names, F.col("pattern")[i]).alias(f"step{i + 1}") for i in range(3)], "support", "sequences")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step1, step2, step3) of the same patterns."""
    return p7_patterns(spark, sf_dir).select("step1", "step2", "step3")


QUERIES = {"p7_found": p7_found, "p7_patterns": p7_patterns}
ORACLES: dict[str, str] = {}
