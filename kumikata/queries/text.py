"""Keys, names, labels and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumikata.functions import keys as k
from kumikata.plans.runtime import small, table
from kumikata.sources.views import BOUTS, bouts, node_key

_B = f"WITH {BOUTS}"


def _labels(spark, d):
    """Labels of graph nodes by exact key or alias of the library, first by key."""
    t = table(spark, d, "technique_nodes")
    names = t.select(F.col("node_key").alias("key"), F.col("node_key").alias("canonical"), F.lit(0).alias("rank")).unionByName(t.select("node_key", F.explode("aliases").alias("a")).select(node_key(F.col("a")).alias("key"), F.col("node_key").alias("canonical"), F.lit(1).alias("rank")))
    best = names.groupBy("key").agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("canonical"))
    nodes = table(spark, d, "graph_nodes").select("node_id", node_key(F.col("label")).alias("key"))
    return nodes.join(small(best), "key", "left").select("node_id", "key", "canonical")


def _docs(spark, d):
    text = F.col("text")
    a, b = k.versus(text)
    return table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"), k.first_year(text).alias("year"), F.length(k.clean_transcript(text)).alias("chars"))


def _taxonomy(spark, d):
    """The stored graphs with the ends of their edges, and how many of these no node of the graph has."""
    e = table(spark, d, "graph_edges")
    ends = e.select("edge_id", "graph_id", F.explode(F.array(F.trim(F.lower("source_key")), F.trim(F.lower("target_key")))).alias("node_key")).where("node_key IS NOT NULL")
    known = table(spark, d, "graph_nodes").select("graph_id", "node_key", F.lit(1).alias("known"))
    return ends.join(known, ["graph_id", "node_key"], "left").groupBy("graph_id").agg(F.count("*").alias("ends"), F.count_if(F.col("known").isNull()).alias("dangling"))


QUERIES = {
    "normalize_names": lambda spark, d: table(spark, d, "lutas").select("linha_id", k.athlete_key(F.col("atleta")).alias("key"), k.slug(F.col("atleta")).alias("slug")),
    "canonical_labels": _labels,
    "method_families": lambda spark, d: table(spark, d, "roster_records").groupBy(k.method_family(F.col("method")).alias("family"), k.win_type(F.coalesce(F.col("method"), F.lit(""))).alias("win_type")).agg(F.count("*").alias("n")),
    "event_rules": lambda spark, d: table(spark, d, "roster_records").groupBy(k.uniform(F.col("comp")).alias("uniform"), k.ruleset(F.col("comp")).alias("ruleset"), k.discipline(F.col("comp")).alias("discipline")).agg(F.count("*").alias("n")),
    "bout_slugs": lambda spark, d: bouts(spark, d).select("match_id", k.bout_slug(F.col("a"), F.col("b"), F.col("year")).alias("slug"), k.method_text(F.col("method"), F.col("submission")).alias("result")),
    "document_titles": _docs,
    "graph_integrity": _taxonomy,
    "belt_ratings": lambda spark, d: table(spark, d, "athletes").select("athlete_id", k.belt_rating(F.col("belt")).alias("rating"), F.round(k.months_between(F.to_date("created_at"), F.to_date(F.lit("2026-01-01"))), 4).alias("months")),
    "item_hashes": lambda spark, d: table(spark, d, "technique_nodes").select("node_key", F.sha1(F.concat_ws("|", "node_key", "label", "type", "source")).alias("hash")),
    "latest_documents": lambda spark, d: table(spark, d, "documents").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("published_at"), "doc_id"))).where("n <= 5").select("source", "n", "doc_id"),
}
_KEY = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_FOLD = "lower(trim(strip_accents(coalesce({0}, ''))))"


def _rules(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


_METHOD, _COMP = _FOLD.format("method"), _FOLD.format("comp")
ORACLES = {
    "normalize_names": r"WITH c AS (SELECT linha_id, atleta, trim(regexp_replace(regexp_replace(split_part(atleta, ':', 1), '\s+\d+$', ''), '\s+', ' ', 'g')) AS n FROM lutas) SELECT linha_id, " + _KEY.format("strip_accents(n)") + " AS key, replace(" + _KEY.format("atleta") + ", ' ', '-') AS slug FROM c",
    "canonical_labels": f"WITH n AS (SELECT node_key AS key, node_key AS canonical, 0 AS r FROM technique_nodes UNION ALL SELECT {_KEY.format('a')}, node_key, 1 FROM (SELECT node_key, unnest(aliases) AS a FROM technique_nodes)), b AS (SELECT key, canonical FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, canonical) = 1) SELECT node_id, x.key, canonical FROM (SELECT node_id, {_KEY.format('label')} AS key FROM graph_nodes) x LEFT JOIN b ON b.key = x.key",
    "method_families": f"SELECT {_rules(_METHOD, k.METHOD_FAMILIES, 'sub_other')} AS family, CASE WHEN upper(trim(m)) LIKE '%SUB%' THEN 'SUBMISSION' WHEN upper(trim(m)) LIKE '%DEC%' OR upper(trim(m)) LIKE '%REF%' THEN 'DECISION' WHEN upper(trim(m)) LIKE '%DQ%' OR upper(trim(m)) LIKE '%DESQ%' THEN 'DQ' WHEN upper(trim(m)) LIKE '%INJ%' THEN 'INJURY' ELSE 'POINTS' END AS win_type, count(*) AS n FROM (SELECT method, coalesce(method, '') AS m FROM roster_records) GROUP BY 1, 2",
    "event_rules": f"SELECT {_rules(_COMP, k.UNIFORMS, 'unknown')} AS uniform, {_rules(_COMP, k.RULESETS, 'other')} AS ruleset, CASE WHEN comp IS NULL OR comp LIKE 'UFC%' THEN 'mma' WHEN comp LIKE 'NCAA%' THEN 'wrestling' ELSE 'grappling' END AS discipline, count(*) AS n FROM roster_records GROUP BY 1, 2, 3",
    "bout_slugs": f"{_B} SELECT match_id, replace({_KEY.format('a')}, ' ', '-') || '-vs-' || replace({_KEY.format('b')}, ' ', '-') || '-' || coalesce(year::VARCHAR, 'tbd') AS slug, CASE WHEN method IS NULL OR method = '' THEN 'No contest / draw' WHEN method = 'SUBMISSION' AND submission <> '' THEN 'Submission (' || submission || ')' ELSE upper(method[1]) || lower(method[2:]) END AS result FROM bouts",
    "graph_integrity": "WITH x AS (SELECT graph_id, unnest([trim(lower(source_key)), trim(lower(target_key))]) AS node_key FROM graph_edges), n AS (SELECT graph_id, node_key, 1 AS known FROM graph_nodes) SELECT graph_id, count(*) AS ends, count(*) FILTER (known IS NULL) AS dangling FROM x LEFT JOIN n USING (graph_id, node_key) WHERE node_key IS NOT NULL GROUP BY 1",
    "belt_ratings": "SELECT athlete_id, CASE lower(trim(belt)) WHEN 'white' THEN 200.0::DOUBLE WHEN 'blue' THEN 350 WHEN 'purple' THEN 500 WHEN 'brown' THEN 650 ELSE 800 END AS rating, round(greatest(0, date_diff('day', created_at::DATE, DATE '2026-01-01') / 30.44::DOUBLE), 4) AS months FROM athletes",
    "item_hashes": "SELECT node_key, sha1(concat_ws('|', node_key, label, type, source)) AS hash FROM technique_nodes",
    "latest_documents": "SELECT source, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, doc_id)::INT AS n, doc_id FROM documents QUALIFY n <= 5",
}
