"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kumikata.queries import agg, forms, graph, join, profile, rating, scout, seq, stat, stream, system, text, vec

_MODULES = (seq, graph, agg, join, stat, rating, vec, text, stream, profile, scout, system, forms)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between the actions of one athlete within a bout."""
    return QUERIES["transition_edges"](spark, sf_dir)
