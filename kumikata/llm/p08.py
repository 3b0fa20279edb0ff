"""Queries of problem 8: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.packing import packed
from kumikata.llm.tokens import token_count
from kumikata.plans.runtime import table

CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, size, container): the container of each document or piece of a longer one."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("size"))
    return packed(sizes, "size", CAPACITY, "doc_id")


def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, capacity, unused_share, fullest): the share of unused space over all containers."""
    filled = p8_containers(spark, sf_dir).where("size > 0").groupBy("container").agg(F.sum("size").alias("tokens"))
    return filled.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.lit(CAPACITY).alias("capacity"), F.round(1 - F.sum("tokens") / (F.count("*") * CAPACITY), 6).alias("unused_share"), F.max("tokens").alias("fullest"))


QUERIES = {"p8_containers": p8_containers, "p8_unused": p8_unused}
ORACLES: dict[str, str] = {}
