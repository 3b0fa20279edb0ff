"""Queries of problem 4: an athlete logged several times in a row with one technique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.bouts import ordered
from kumikata.llm.runs import runs
from kumikata.plans.runtime import small, table


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bouts, codes = ordered(table(spark, sf_dir, "match_events"), table(spark, sf_dir, "technique_nodes"), library_only=False)
    return runs(bouts), codes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, first_idx, last_idx): runs of two or more events of one athlete and one technique."""
    return _runs(spark, sf_dir)[0].select("match_id", "first_idx", "last_idx")


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs with technique, count and duration."""
    found, codes = _runs(spark, sf_dir)
    return found.join(small(codes), "code").select("match_id", "first_idx", "last_idx", F.regexp_replace("node_key", r"^\?", "").alias("technique"), "count", "duration")


QUERIES = {"p4_found": p4_found, "p4_runs": p4_runs}
ORACLES: dict[str, str] = {}
