"""Queries of problem 3: typed technique labels to the curated library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.labels import EDITS, REMARKS, canonical
from kumikata.plans.runtime import spread, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, node_key): each graph node without a library key; `''` where its label means no entry or is null."""
    nodes = table(spark, sf_dir, "graph_nodes").where("canonical_node_key IS NULL").select("node_id", "label")
    keys = canonical(nodes, table(spark, sf_dir, "technique_nodes"))
    return nodes.join(spread(keys), "label", "left").select("node_id", F.coalesce("node_key", F.lit("")).alias("node_key"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, events): labels of match_events that mean no entry of the library, with the number of their events."""
    events = table(spark, sf_dir, "match_events").where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("events"))
    keys = canonical(events, table(spark, sf_dir, "technique_nodes"))
    return events.join(keys.where("node_key IS NULL").select("label"), "label", "left_semi")


#: Characters that are no part of a word, with and without the dot of an abbreviation.
_APART, _APART_DOT = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}.]+"
_SHORT = r"\p{L}{3,}\."


def _typed(col: str) -> str:
    """SQL of `labels.typed`."""
    out = f"lower(strip_accents({col}))"
    for remark in REMARKS:
        kept = r"\1 " if remark.startswith("(") else " "
        out = f"regexp_replace({out}, '{remark}', '{kept}', 'g')"
    return f"trim(regexp_replace(replace({out}, chr(39), ''), '{_APART_DOT}', ' ', 'g'))"


def _words(col: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(replace({col}, '.', ''), '{_APART}', ' ', 'g')), ' '), lambda w: w <> '')"


def _sql(labels: str) -> str:
    """Brute force: every typed form against every spelling by levenshtein; ends with `keys` (label, node_key)."""
    k = "CASE " + " ".join(f"WHEN length(ref) >= {least} THEN {n}" for least, n in EDITS) + " END"
    short, bare = f"regexp_full_match(x, '{_SHORT}')", "replace(x, '.', '')"
    return f"""WITH nm AS (SELECT node_key, unnest(list_append(coalesce(aliases, []), node_key)) AS name FROM technique_nodes WHERE node_key IS NOT NULL),
sp AS (SELECT DISTINCT node_key, w FROM (SELECT node_key, {_words(_typed('name'))} AS w FROM nm) WHERE len(w) > 0),
ro AS (SELECT node_key, list_concat(w[i:], w[1:i - 1]) AS rw FROM (SELECT node_key, w, unnest(range(1, len(w) + 1)) AS i FROM sp) UNION SELECT node_key, list_reverse(w) FROM sp),
rg AS (SELECT array_to_string(rw, '') AS ref, min(node_key) AS node_key, max(node_key) AS other, min(rw) AS rw FROM ro GROUP BY 1),
rf AS (SELECT ref, node_key, rw, {k} AS k FROM rg WHERE node_key = other),
lb AS (SELECT label, {_typed('label')} AS typed FROM ({labels})),
ty AS (SELECT DISTINCT typed FROM lb),
tk AS (SELECT typed, string_split(typed, ' ') AS t, list_filter(string_split(typed, ' '), lambda x: {short}) AS sh FROM ty),
t2 AS (SELECT typed, t, replace(sh[1], '.', '') AS stem FROM tk WHERE len(sh) > 0),
en AS (SELECT w, unnest(w) AS word FROM sp),
cm AS (SELECT DISTINCT typed, array_to_string(list_transform(t, lambda x: CASE WHEN {short} THEN coalesce(CASE WHEN {bare} = stem THEN word END, list_filter(w, lambda y: starts_with(y, {bare}))[1], x) ELSE x END), ' ') AS text
    FROM t2 JOIN en ON starts_with(word, stem) AND length(word) > length(stem)),
fm AS (SELECT typed, text FROM cm UNION SELECT typed, typed FROM ty),
sl AS (SELECT typed, w, array_to_string(w, '') AS sq FROM (SELECT typed, {_words('text')} AS w FROM fm)),
ex AS (SELECT typed, min(node_key) AS node_key FROM sl JOIN rf ON sq = ref GROUP BY 1 HAVING min(node_key) = max(node_key)),
rs AS (SELECT * FROM sl WHERE typed NOT IN (SELECT typed FROM ex)),
pr AS (SELECT sq, ref, levenshtein(sq, ref) AS edits FROM (SELECT DISTINCT sq FROM rs) JOIN rf ON abs(length(sq) - length(ref)) <= k AND k > 0 WHERE levenshtein(sq, ref) <= k),
ju AS (SELECT DISTINCT typed, w, rw, node_key, edits FROM rs JOIN pr USING (sq) JOIN rf USING (ref)),
pl AS (SELECT DISTINCT w[i] AS word, side, w[i + side] AS beside FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM sp WHERE len(w) > 1), (VALUES (-1), (1)) s(side) WHERE i + side BETWEEN 1 AND len(w)),
rv AS (SELECT DISTINCT x.word AS meant, y.word AS rival FROM pl x JOIN pl y ON x.side = y.side AND x.beside = y.beside AND x.word <> y.word AND abs(length(x.word) - length(y.word)) <= 4),
al AS (SELECT typed, w, rw, w[i] AS word, rw[i] AS meant FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ju WHERE len(w) = len(rw)) WHERE w[i] <> rw[i]),
mr AS (SELECT DISTINCT word, meant FROM (SELECT DISTINCT word, meant FROM al) JOIN rv USING (meant) WHERE levenshtein(word, rival) < levenshtein(word, meant)),
wr AS (SELECT DISTINCT typed, w, rw FROM al JOIN mr USING (word, meant)),
fi AS (SELECT ju.* FROM ju LEFT JOIN wr ON wr.typed = ju.typed AND wr.w = ju.w AND wr.rw = ju.rw WHERE wr.typed IS NULL AND (len(ju.w) = len(ju.rw) OR edits <= 2)),
bs AS (SELECT typed, node_key, min(edits) AS edits FROM fi GROUP BY 1, 2),
fo AS (SELECT typed, min(node_key) AS node_key FROM (SELECT *, min(edits) OVER (PARTITION BY typed) AS least FROM bs) WHERE edits = least GROUP BY 1 HAVING count(*) = 1),
keys AS (SELECT label, coalesce(ex.node_key, fo.node_key) AS node_key FROM lb LEFT JOIN ex USING (typed) LEFT JOIN fo USING (typed))
"""


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
ORACLES = {
    "p3_found": _sql("SELECT DISTINCT label FROM graph_nodes WHERE canonical_node_key IS NULL AND label IS NOT NULL") + "SELECT node_id, coalesce(keys.node_key, '') AS node_key FROM graph_nodes g LEFT JOIN keys ON keys.label = g.label WHERE canonical_node_key IS NULL",
    "p3_unmatched": _sql("SELECT DISTINCT label FROM match_events WHERE label IS NOT NULL") + "SELECT match_events.label, count(*) AS events FROM match_events JOIN keys ON keys.label = match_events.label WHERE keys.node_key IS NULL GROUP BY 1",
}
