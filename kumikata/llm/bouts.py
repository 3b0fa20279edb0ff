"""Events of bouts with techniques and athletes in one writing, for problems 4 and 7."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumikata.llm.labels import canonical, typed, words
from kumikata.llm.names import parse, same_person
from kumikata.llm.stripes import numbered
from kumikata.plans.runtime import cut, small, spread

#: Places of a bout that are kept together in one row; a longer bout is several rows.
CHUNK = 1024


def _sides(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Actors of each bout, the most frequent first, to the number of the athlete that they name."""
    for frame in frames:
        out = []
        for actors in frame["actors"]:
            sides: list[list[tuple[str, str, str] | None]] = []
            found = {}
            counts: dict[str, int] = {}
            for actor in actors:
                counts[actor["actor"]] = counts.get(actor["actor"], 0) + actor["n"]
            for name in sorted(counts, key=lambda a: (-counts[a], a)):
                parsed = parse(name)
                fits = [i for i, side in enumerate(sides) if any(p == parsed or same_person(p, parsed) for p in side)] or [i for i, side in enumerate(sides) if any(same_person(p, parsed, most=2) for p in side)]
                if fits:
                    sides[fits[0]].append(parsed)
                else:
                    fits = [len(sides)]
                    sides.append([parsed])
                found[name] = fits[0]
            out.append(found)
        yield pd.DataFrame({"match_id": frame["match_id"], "sides": out})


def ordered(events: DataFrame, library: DataFrame, library_only: bool) -> tuple[DataFrame, DataFrame]:
    """The events of each bout by `idx`, in rows of at most CHUNK places, and the names of the technique codes.

    First (match_id, chunk, events) with events of (idx, side, code, ts). `side` numbers the athlete within the bout, `code` the technique: the
    library entry or, unless `library_only`, the label's own words where the library has none. It is null where label, actor or (if
    `library_only`) entry is missing. An `idx` delivered twice counts once, the first arrival (least event_id) stands. Events without match
    or place are left out. Second (code, node_key).

    Spellings of a bout's actors are compared with each other, the most frequent first, so that an initial or a slip need only be told
    from the other athlete of the bout; that step has a row per bout with its different spellings, not its events.
    """
    used = events.where("match_id IS NOT NULL AND idx IS NOT NULL")
    key = F.col("node_key") if library_only else F.coalesce("node_key", F.concat(F.lit("?"), F.array_join(words(typed(F.col("label"))), "")))
    named = cut(canonical(used.where("actor IS NOT NULL"), library).select("label", key.alias("node_key")).where("node_key IS NOT NULL"))
    codes = numbered(named.select("node_key").distinct()).select("node_key", F.col("number").cast("int").alias("code"))
    labels = small(named.join(small(codes), "node_key").select("label", "code"))
    told = used.select("match_id", "idx", "event_id", "actor", "ts", "label", F.floor(F.col("idx") / CHUNK).cast("int").alias("chunk")).join(labels, "label", "left").drop("label")
    once = told.repartition("match_id", "chunk").groupBy("match_id", "chunk", "idx").agg(F.min_by(F.struct("actor", "code", "ts"), "event_id").alias("e"))
    listed = once.groupBy("match_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("e.actor").alias("actor"), F.col("e.code").alias("code"), F.col("e.ts").alias("ts")))).alias("events"))
    actors = F.filter(F.array_distinct(F.transform("events", lambda e: e["actor"])), lambda a: a.isNotNull())
    packed = listed.withColumn("actors", actors).select(
        "match_id", "chunk",
        F.transform("actors", lambda a: F.struct(a.alias("actor"), F.size(F.filter("events", lambda e: e["actor"] == a)).alias("n"))).alias("spellings"),
        F.transform("events", lambda e: F.struct(e["idx"].alias("idx"), F.coalesce(F.array_position("actors", e["actor"]), F.lit(0)).cast("int").alias("spelling"), e["code"].alias("code"), e["ts"].alias("ts"))).alias("events"),
    )
    lists = cut(packed)
    spelled = lists.where("size(spellings) > 0").groupBy("match_id").agg(F.flatten(F.collect_list("spellings")).alias("actors"))
    alone = spelled.where("size(actors) = 1").select("match_id", F.create_map(F.col("actors")[0]["actor"], F.lit(0)).alias("sides"))
    sides = alone.unionByName(spelled.where("size(actors) > 1").mapInPandas(_sides, "match_id string, sides map<string,int>"))
    numbers = lists.join(spread(sides), "match_id", "left").withColumn("numbers", F.transform("spellings", lambda a: F.element_at("sides", a["actor"])))
    side = lambda e: F.get("numbers", e["spelling"] - 1)
    return numbers.select("match_id", "chunk", F.transform("events", lambda e: F.struct(e["idx"].alias("idx"), side(e).alias("side"), e["code"].alias("code"), e["ts"].alias("ts"))).alias("events")), codes
