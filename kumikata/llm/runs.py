"""Problem 4: repeated consecutive events, by a regular expression over strings of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.llm.bouts import CHUNK
from kumikata.plans.runtime import cut

#: A place without an event to repeat, and a stop between two places too far apart, have their own symbols; the others follow from 0x100 on.
NOTHING, STOP = "\u0001", "\u0002"
#: As many symbols as a chunk can have different events; the n-th event seen takes the n-th, so that low places are the usual ones.
SYMBOLS = "".join(map(chr, range(0x100, 0x100 + CHUNK)))


def symbol(number: Column) -> Column:
    """The character of a number from 1 to CHUNK."""
    return F.substring(F.lit(SYMBOLS), number.cast("int"), F.lit(1))


def pieces(bouts: DataFrame, gap: float) -> DataFrame:
    """Each chunk's runs of equal symbols with (start, size), in order, by a regular expression with a back-reference."""
    key = F.transform("events", lambda e: e["side"].cast("long") * (1 << 32) + e["code"])
    coded = bouts.withColumn("keys", key).withColumn("known", F.array_distinct("keys"))
    late = lambda i: (i > 0) & (F.get("events", i)["ts"] - F.get("events", i - 1)["ts"] > gap)
    marks = F.transform("keys", lambda k, i: F.concat(F.when(late(i), F.lit(STOP)).otherwise(F.lit("")), F.when(k.isNull(), F.lit(NOTHING)).otherwise(symbol(F.array_position("known", k)))))
    found = F.regexp_extract_all(F.array_join(marks, ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    real = F.filter(found, lambda p: ~p.startswith(STOP))
    # pieces at either end of a chunk stay, even where nothing repeats: they part what lies before them from what follows
    outer = lambda acc, p: (acc["at"] == 0) | (acc["at"] + F.length(p) == F.size("events"))
    # where each piece begins: the sizes of those before it
    places = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("done")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(outer(acc, p) | ((F.length(p) > 1) & ~p.startswith(NOTHING)), F.array_append(acc["done"], F.struct(acc["at"].alias("start"), F.length(p).alias("size")))).otherwise(acc["done"]).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    return coded.withColumn("pieces", real).select("match_id", "chunk", "events", F.inline(places))


def runs(bouts: DataFrame, gap: float = 30.0) -> DataFrame:
    """Collapse each run of identical consecutive events: (match_id, first_idx, last_idx, side, code, count, duration).

    `bouts` is what `bouts.ordered` gives: events of (idx, side, code, ts) by place, in chunks of bounded length. Each different (side, code)
    of a chunk becomes one Unicode code point and each chunk a string; `(.)\\1*` with its back-reference cuts the string into runs,
    whose spans map back to places and times. A `ts` more than `gap` after the one before puts a stop into the string. Runs that touch a
    chunk's end are joined to the next chunk's by the same rules, from the two outer runs of each chunk only, so that a bout of any
    length is never in one task.

    Runs have two events or more. `duration` is last `ts` less first, null where either is unknown. A null side or code is in no run and
    ends one; a null `ts` ends none; an empty table gives no row.
    """
    at = lambda i: F.get("events", i)
    end = F.col("start") + F.col("size") - 1
    # written once: the inner runs and the outer ones are read from it, not worked out twice
    cut_up = cut(pieces(bouts, gap).select(
        "match_id", "chunk", at(F.col("start"))["idx"].alias("first_idx"), at(end)["idx"].alias("last_idx"), at(end)["side"].alias("side"), at(end)["code"].alias("code"), F.col("size").alias("count"),
        at(F.col("start"))["ts"].alias("first_ts"), at(end)["ts"].alias("last_ts"), (F.col("start") == 0).alias("opens"), (end == F.size("events") - 1).alias("closes"),
    ))
    outer = cut_up.where("opens OR closes")
    # over the outer runs alone: two a chunk
    w = Window.partitionBy("match_id").orderBy("chunk", "first_idx")
    same = F.lag("side").over(w).eqNullSafe(F.col("side")) & F.lag("code").over(w).eqNullSafe(F.col("code"))
    follows = F.col("opens") & F.lag("closes").over(w) & (F.lag("chunk").over(w) < F.col("chunk")) & same & ~F.coalesce(F.col("first_ts") - F.lag("last_ts").over(w) > gap, F.lit(False))
    islands = outer.withColumn("island", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w))
    joined = islands.groupBy("match_id", "island").agg(
        F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.first("side").alias("side"), F.first("code").alias("code"), F.sum("count").cast("int").alias("count"),
        F.min_by("first_ts", "first_idx").alias("first_ts"), F.max_by("last_ts", "last_idx").alias("last_ts"),
    )
    columns = ["match_id", "first_idx", "last_idx", "side", "code", "count", "first_ts", "last_ts"]
    every = cut_up.where("NOT opens AND NOT closes").select(columns).unionByName(joined.select(columns)).where((F.col("count") > 1) & F.col("side").isNotNull() & F.col("code").isNotNull())
    return every.withColumn("duration", F.col("last_ts") - F.col("first_ts")).drop("first_ts", "last_ts")
