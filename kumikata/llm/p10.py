"""Queries of problem 10: documents that look the same."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.llm.lookalike import _CLASSES, one_form, plain, replaced
from kumikata.plans.runtime import cut, spread, table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts look the same but are stored as different strings.

    Only fingerprints are joined: first the different strings of one form with each other, then either string with its documents. So copies of one
    string, however many, never meet each other, and a form that is stored in one way only has no pair.
    """
    forms = one_form(table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    prints = cut(forms.select("doc_id", F.sha2("canonical", 256).alias("form"), F.sha2("text", 256).alias("stored")))
    strings = prints.groupBy("form", "stored").agg(F.count("*").alias("copies"))
    several = strings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    kept = cut(strings.join(spread(several), "form", "left_semi").select("form", "stored"))
    pairs = kept.select("form", F.col("stored").alias("stored_a")).join(spread(kept.select("form", F.col("stored").alias("stored_b"))), "form").where("stored_a <> stored_b").drop("form")
    a, b = (prints.select(F.col("stored").alias(f"stored_{x}"), F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    return pairs.join(spread(a), "stored_a").join(spread(b), "stored_b").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, changed, form): each document, whether its one form differs from what is stored, and the form's fingerprint."""
    forms = one_form(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return forms.select("doc_id", (F.col("canonical") != F.col("text")).alias("changed"), F.sha2("canonical", 256).alias("form"))


def _shapes() -> list[tuple[str, str]]:
    """Each character that does not stand for itself, with its shape: the letters of all scripts by their class."""
    out = []
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x20000)):
        char = chr(code)
        shape = unicodedata.normalize("NFC", replaced(plain(char), _CLASSES))
        if shape != unicodedata.normalize("NFC", char):
            out.append((char, shape.replace("'", "''")))
    return out


_SHAPES = f"""WITH sh(c, shape) AS (VALUES {", ".join(f"('{c}', '{x}')" for c, x in _shapes())}),
ch AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS c FROM (SELECT doc_id, string_split(nfc_normalize(text), '') AS p FROM documents WHERE text <> '')),
sk AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(shape, c), '' ORDER BY i)) AS form FROM ch LEFT JOIN sh USING (c) GROUP BY 1),
al AS (SELECT documents.doc_id, text, coalesce(form, '') AS form FROM documents LEFT JOIN sk ON sk.doc_id = documents.doc_id WHERE text IS NOT NULL)
"""
QUERIES = {"p10_found": p10_found, "p10_forms": p10_forms}
ORACLES = {"p10_found": _SHAPES + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM al a JOIN al b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"}
