"""Queries of problem 2: node keys that graphs hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.functions.text import blanks
from kumikata.llm.stripes import together
from kumikata.plans.runtime import table


def graph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, node_key): the source and target keys of each graph, in lower case, blanks trimmed and single."""
    edges = table(spark, sf_dir, "graph_edges")
    return edges.select("graph_id", F.explode(F.array("source_key", "target_key")).alias("key")).select("graph_id", blanks(F.lower("key")).alias("node_key"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least 4 graphs and 0.2 % of all, with counts, lift and log-likelihood ratio."""
    pairs = together(graph_keys(spark, sf_dir), "graph_id", "node_key", 4, 0.002)
    return pairs.select(F.col("item_a").alias("key_a"), F.col("item_b").alias("key_b"), "both", "count_a", "count_b", "baskets", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_a, key_b): those pairs that at least three times as many graphs hold as independence would give."""
    pairs = together(graph_keys(spark, sf_dir), "graph_id", "node_key", 4, 0.002)
    return pairs.where(F.col("both") * F.col("baskets") >= 3 * F.col("count_a") * F.col("count_b")).select(F.col("item_a").alias("key_a"), F.col("item_b").alias("key_b"))


_KEYS = """
WITH k AS (SELECT graph_id, unnest([source_key, target_key]) AS raw FROM graph_edges WHERE graph_id IS NOT NULL),
m AS (SELECT DISTINCT graph_id, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS node_key FROM k WHERE raw IS NOT NULL),
n AS (SELECT count(DISTINCT graph_id)::DOUBLE AS n FROM graph_edges),
c AS (SELECT node_key, count(*)::DOUBLE AS c FROM m GROUP BY 1),
p AS (SELECT a.node_key AS key_a, b.node_key AS key_b, count(*)::DOUBLE AS o FROM m a JOIN m b ON a.graph_id = b.graph_id AND a.node_key < b.node_key GROUP BY 1, 2),
t AS (SELECT key_a, key_b, o, ca.c AS a, cb.c AS b, n FROM p JOIN c ca ON ca.node_key = key_a JOIN c cb ON cb.node_key = key_b, n WHERE o >= 4 AND o >= 0.002 * n)
"""
_G = "CASE WHEN {o} > 0 THEN {o} * ln({o} * n / ({r} * {c})) ELSE 0 END"
_LLR = " + ".join(_G.format(o=o, r=r, c=c) for o, r, c in (("o", "a", "b"), ("(a - o)", "a", "(n - b)"), ("(b - o)", "(n - a)", "b"), ("(n - a - b + o)", "(n - a)", "(n - b)")))
QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
ORACLES = {
    "p2_found": _KEYS + "SELECT key_a, key_b FROM t WHERE o * n >= 3 * a * b",
    "p2_pairs": _KEYS + f'SELECT key_a, key_b, o::BIGINT AS "both", a::BIGINT AS count_a, b::BIGINT AS count_b, n::BIGINT AS baskets, round(o * n / (a * b), 6) AS lift, round(2 * ({_LLR}), 4) AS llr FROM t',
}
