"""Queries of problem 9: documents mixed to the target shares of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.mixing import marginals, mixed
from kumikata.llm.tokens import token_count
from kumikata.plans.runtime import cut, table


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("event_name").alias("topic"), token_count(F.col("text")).alias("tokens"))


def _mixed(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return mixed(documents or sized(spark, sf_dir), table(spark, sf_dir, "source_targets"), "doc_id", "tokens", "source", ("lang", "topic"))


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, repeats, copies): the chosen documents with their copies."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and reached share of the total tokens."""
    return _mixed(spark, sf_dir)[1]


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present and reached shares by source, language and topic: what raking holds to and what whole documents and caps leave of it."""
    documents = cut(sized(spark, sf_dir))
    return marginals(documents, _mixed(spark, sf_dir, documents)[0], "doc_id", "tokens", "source", ("lang", "topic"))


QUERIES = {"p9_marginals": p9_marginals, "p9_chosen": p9_chosen, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
