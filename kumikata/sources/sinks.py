"""Sinks: long tables, documents, partition overwrites, immutable runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(frame: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that `frame` holds and leaves the others."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_run(states: DataFrame, path: str, run_id: str) -> None:
    """Adds one immutable run; a run that is there is refused."""
    states.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")


def documents(frame: DataFrame, path: str, key: str) -> None:
    """One JSON document per row, below a folder per key."""
    rest = [c for c in frame.columns if c != key]
    frame.select(key, F.to_json(F.struct(*rest)).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def script(frame: DataFrame, name: str) -> DataFrame:
    """(value): rows as one assignment each, for a page to load."""
    return frame.select(F.concat(F.lit(f"window.{name} = "), F.to_json(F.struct(*frame.columns)), F.lit(";")).alias("value"))


def long_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, row, column, value): tables of any shape as one, for a single file."""
    parts = [t.select(F.lit(name).alias("section"), F.xxhash64(*t.columns).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in t.columns])).alias("c")).select("section", "row", "c.*") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str, name: str) -> DataFrame:
    """(rule, value): references that nothing answers."""
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().join(known.select(key), key, "left_anti").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("value"))


def anonymised(athletes: DataFrame, ident: str, who: list, names: list[str]) -> DataFrame:
    """Athletes with the names of some removed; their rows and graphs stay."""
    gone = F.col(ident).isin(who)
    return athletes.withColumns({n: F.when(gone, F.concat(F.lit("removed-"), F.substring(F.sha1(F.col(ident).cast("string")), 1, 8))).otherwise(F.col(n)) for n in names})


def nested_graph(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, nodes, edges): a graph's rows as one document."""
    n = nodes.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != graph]))).alias("nodes"))
    e = edges.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != graph]))).alias("edges"))
    return n.join(e, graph, "left")
