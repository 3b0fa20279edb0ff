"""Queries of problem 1: competition records that tell of one bout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.functions.text import fold
from kumikata.llm.labels import canonical
from kumikata.llm.names import link
from kumikata.llm.survivors import survivors
from kumikata.plans.runtime import cut, spread, table

# The sources, the most trusted first.
SOURCES = ("own_record", "opponent_record", "corpus", "manual")
# What stands for a method that is not known.
PLACEHOLDERS = ("", "?", "??", "-", "--", "n/a", "na", "unknown", "none", "null", "nan", "tbd", "x", "desconhecido", "nao informado", "sem informacao")
# Endings other than by a technique, in the writings that occur.
ENDINGS = {
    "decision": r"decis|judge|\bref",
    "injury": r"\binj|lesao|\blesion",
    "disqualified": r"^\W*dq\b|disqual|desclass|descalif",
    "draw": r"^\W*(draw|empate)\W*$",
}


def bare(col: Column) -> Column:
    """A method in lower case without accents and outer blanks."""
    return F.trim(F.regexp_replace(fold(col), r"[\s\p{Z}]+", " "))


def usable_method(col: Column) -> Column:
    """Whether a method says anything."""
    return col.isNotNull() & ~F.regexp_replace(bare(col), r"[.!]+$", "").isin(*PLACEHOLDERS)


def usable_name(col: Column) -> Column:
    """Whether the first name is written out: two words or more, the first ("Last, First": the first after the comma) not an initial."""
    text = F.trim(F.regexp_replace(col, r"[\s\p{Z}]+", " "))
    given = F.when(text.contains(","), F.trim(F.substring_index(text, ",", -1))).otherwise(text)
    # "Last F." has its initial at the end
    return col.isNotNull() & given.rlike(r"^\p{L}{2}") & text.rlike(r"\p{L}[ ,\-_].*\p{L}") & ~text.rlike(r" \p{L}\.?$")


def usable_year(col: Column) -> Column:
    """Whether a year can be one: 1990 or later."""
    return F.coalesce(col >= 1990, F.lit(False))


def endings(records: DataFrame, library: DataFrame) -> DataFrame:
    """(method, ending): each usable writing of a method with what it means: points with their score, a decision, or a technique."""
    writings = records.where(usable_method(F.col("method"))).select("method").distinct()
    text = bare(F.col("method"))
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    plain = F.when((F.size(numbers) == 2) & text.rlike(r"^\W*(pts|pontos|points|placar)|\b(pts|pontos|points)\W*$|^\d+\s*[-x]\s*\d+$"), F.concat(F.lit("points "), F.array_join(numbers, "-")))
    for ending, pattern in ENDINGS.items():
        plain = F.coalesce(plain, F.when(text.rlike(pattern), F.lit(ending)))
    known = cut(writings.withColumn("ending", plain))
    techniques = canonical(known.where("ending IS NULL"), library, label="method")
    named = techniques.select(F.col("label").alias("method"), F.coalesce(F.concat(F.lit("by "), F.col("node_key")), F.concat(F.lit("? "), F.regexp_replace(bare(F.col("label")), r"[^\p{L}\p{N}]", ""))).alias("ending"))
    return known.where("ending IS NOT NULL").unionByName(named)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with `bout`, which is equal for those that tell of one bout of one athlete, and null for those that tell of none.

    Opponents are linked among the records of one athlete, where two slips do not lead to somebody else. Records of a pair with at most one year and one ending are one bout; those of a pair with
    several are told apart by year and ending, and there a record that lacks either joins none. An initial that can mean several opponents
    of the athlete goes to the one with a record of the same year and ending, if that is one alone.
    """
    records = table(spark, sf_dir, "roster_records").where("athlete IS NOT NULL AND record_id IS NOT NULL")
    told = records.select("record_id", "athlete", "opp", "year", "method", "source", "updated_at").join(endings(records, table(spark, sf_dir, "technique_nodes")), "method", "left")
    persons = link(records, "opp", "athlete", most=2).select(F.col("scope").alias("athlete"), F.col("name").alias("opp"), "person")
    told = told.join(spread(persons), ["athlete", "opp"], "left").withColumn("known_year", F.when(usable_year(F.col("year")), F.col("year")))
    told = cut(told)
    # initials that name several of the athlete's opponents
    unclear = told.where((F.col("opp") == F.col("person")) & ~usable_name(F.col("opp")) & F.col("known_year").isNotNull() & F.col("ending").isNotNull())
    surname = lambda c: F.element_at(F.filter(F.split(F.regexp_replace(fold(c), r"[^\p{L}]+", " "), " "), lambda w: F.length(w) > 1), -1)
    letter = lambda c: F.element_at(F.filter(F.split(F.trim(F.regexp_replace(fold(c), r"[^\p{L}]+", " ")), " "), lambda w: F.length(w) == 1), 1)
    asked = unclear.select("athlete", "known_year", "ending", "opp", surname(F.col("opp")).alias("surname"), letter(F.col("opp")).alias("letter")).where("surname IS NOT NULL AND letter IS NOT NULL").distinct()
    full = told.where(usable_name(F.col("opp")) & ~F.col("opp").contains(",")).select("athlete", "known_year", "ending", F.col("person").alias("other"), fold(F.trim("opp")).alias("written"))
    met = asked.join(spread(full), ["athlete", "known_year", "ending"]).where(F.col("written").startswith(F.col("letter")) & (F.levenshtein(F.element_at(F.split("written", " "), -1), F.col("surname")) <= 1))
    one = met.groupBy("athlete", "known_year", "ending", "opp").agg(F.min("other").alias("other"), F.max("other").alias("last")).where("other = last").drop("last")
    told = told.join(spread(one), ["athlete", "known_year", "ending", "opp"], "left").withColumn("person", F.coalesce("other", "person")).drop("other")
    told = cut(told)
    # how many bouts the pair has
    pairs = told.groupBy("athlete", "person").agg(F.min("known_year").alias("y0"), F.max("known_year").alias("y1"), F.min("ending").alias("e0"), F.max("ending").alias("e1"))
    single = F.coalesce(F.col("y0") == F.col("y1"), F.lit(True)) & F.coalesce(F.col("e0") == F.col("e1"), F.lit(True))
    told = told.join(spread(pairs.withColumn("single", single).select("athlete", "person", "single")), ["athlete", "person"], "left")
    bout = F.when(F.col("single"), F.array("athlete", "person")).when(F.col("known_year").isNotNull() & F.col("ending").isNotNull(), F.array("athlete", "person", F.col("known_year").cast("string"), "ending"))
    return told.withColumn("bout", F.to_json(bout))


def _chosen(told: DataFrame, least: int) -> DataFrame:
    trust = F.when(F.col("source").isin(*SOURCES), F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")))
    usable = {"opp": usable_name(F.col("opp")), "year": usable_year(F.col("year")), "method": usable_method(F.col("method"))}
    return survivors(told, "bout", "record_id", trust, "updated_at", usable, least)


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bout's group of records with its size, dominance layers, and the record of each field."""
    return _chosen(reports(spark, sf_dir), 1)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_id, opp_id, year_id, method_id) for each group of two or more records of one bout."""
    return _chosen(reports(spark, sf_dir), 2).select("first_id", "opp_id", "year_id", "method_id")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per bout of an athlete, each field from its best record; records of no group stand for themselves."""
    told = reports(spark, sf_dir).withColumn("bout", F.coalesce("bout", F.concat(F.lit("record "), F.col("record_id").cast("string"))))
    told = cut(told)
    out = _chosen(told, 1).select("first_id", "size", "opp_id", "year_id", "method_id")
    for field in ("opp", "year", "method"):
        out = out.join(told.select(F.col("record_id").alias(f"{field}_id"), F.col(field)), f"{field}_id", "left")
    return out.join(told.select(F.col("record_id").alias("first_id"), "athlete"), "first_id").select("first_id", "athlete", "opp", "year", "method", "size")


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p1_records": p1_records}
ORACLES: dict[str, str] = {}
