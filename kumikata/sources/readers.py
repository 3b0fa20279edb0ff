"""Readers of the files that the data comes in: delimited tables, documents, pages, captions, poses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kumikata.functions import keys
from kumikata.sources import schemas


@dataclass(frozen=True)
class Dataset:
    """A delimited dataset: where it lies below a folder, how it is written, what it holds."""

    name: str
    pattern: str
    schema: str
    delimiter: str = ","
    encoding: str = "UTF-8"


DATASETS = {
    d.name: d
    for d in (Dataset("matches", "*historical*.csv", schemas.MATCHES, ";"), Dataset("techniques", "*technique*.csv", schemas.TECHNIQUES))
}


def delimited(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A registered dataset with its declared schema; a row that does not fit stays, with what could be read."""
    d = DATASETS[name]
    return spark.read.csv(folder, schema=d.schema, sep=d.delimiter, encoding=d.encoding, header=True, mode="PERMISSIVE", pathGlobFilter=d.pattern, enforceSchema=True)


def cached(frame: DataFrame, path: str) -> DataFrame:
    """Written as Parquet and read again."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.parquet(path)


def matches(raw: DataFrame) -> DataFrame:
    """(match_id, year, winner, loser, win_type, stage, submission, weight_class, sex): bouts with both names and a year; empty texts become null."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    told = raw.select("match_id", F.expr("try_cast(year AS int)").alias("year"), clean("winner_name").alias("winner"), clean("loser_name").alias("loser"), keys.win_type(F.coalesce("win_type", F.lit(""))).alias("win_type"), F.upper(clean("stage")).alias("stage"), F.lower(clean("submission")).alias("submission"), clean("weight_class").alias("weight_class"), F.upper(clean("sex")).alias("sex"))
    return told.where("winner IS NOT NULL AND loser IS NOT NULL AND year IS NOT NULL")


def techniques(raw: DataFrame) -> DataFrame:
    """(technique_name, bjj_position, technique_type, martial_art) of rows with a name and a position."""
    told = raw.where("Name IS NOT NULL AND Position IS NOT NULL")
    return told.select(F.trim("Name").alias("technique_name"), F.trim("Position").alias("bjj_position"), F.lower(F.trim("Type")).alias("technique_type"), F.trim("Origin").alias("martial_art"))


def snake(frame: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return frame.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in frame.columns])


def fighters(raw: DataFrame) -> DataFrame:
    """(fighter_name, wins, losses, sub_ratio, win_ratio, favorite_target) from whichever of the usual columns exist."""
    frame = snake(raw)
    has = set(frame.columns)

    def take(*names: str, default: object = None, kind: str = "double") -> Column:
        found = [F.expr(f"try_cast(`{n}` AS {kind})") for n in names if n in has]
        return F.coalesce(*found, F.lit(default).cast(kind))

    wins, fights = take("n_wins", "wins", default=0, kind="int"), take("total_fights", "fights", kind="int")
    losses = F.greatest(F.lit(0), F.coalesce(take("n_losses", "losses", kind="int"), fights - wins, F.lit(0)))
    ratio = F.coalesce(take("win_ratio"), F.round(F.try_divide(wins.cast("double"), fights), 3), F.lit(0.0))
    return frame.select(take("fighter_name", "name", "fighter", kind="string").alias("fighter_name"), wins.alias("wins"), losses.alias("losses"), take("sub_win_ratio", "sub_ratio", default=0.0).alias("sub_ratio"), ratio.alias("win_ratio"), take("favorite_target", kind="string", default="").alias("favorite_target"), *[F.col(c) for c in ("champion", "custom_score", "n_different_subs") if c in has])


def documents(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Whole JSON documents, one row each; `strict` fails on the first that does not fit, else `_corrupt_record` holds it."""
    if strict:
        return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def session_entries(bundles: DataFrame) -> DataFrame:
    """(session, created_at, round, i, label, type, actor, ok, outcome): the entries of user bundles; sessions without a time are malformed and left out."""
    s = bundles.select(F.explode("sessions").alias("s")).select("s.id", F.to_timestamp("s.createdAt").alias("created_at"), F.posexplode("s.rounds").alias("round", "r")).where("created_at IS NOT NULL")
    return s.select(F.col("id").alias("session"), "created_at", "round", "r.outcome", F.posexplode("r.entries").alias("i", "e")).select("session", "created_at", "round", "i", "e.label", "e.type", "e.actor", F.col("e.successful").alias("ok"), "outcome")


def bout_events(bouts: DataFrame, final: bool = True) -> DataFrame:
    """(match_id, i, label, type, actor, ok, ts) of stored bouts; only final ones unless said otherwise."""
    told = bouts.where("status = 'final'") if final else bouts
    return told.select(F.col("id").alias("match_id"), F.posexplode("sequence").alias("i", "e")).select("match_id", "i", "e.label", "e.type", F.col("e.actor_id").alias("actor"), F.col("e.successful").alias("ok"), "e.ts").where("trim(label) <> ''")


def rule_windows(registry: DataFrame) -> DataFrame:
    """(ruleset, uniform, profile, start, end, positive, negative) of a registry of rules."""
    r = registry.select(F.explode("rulesets").alias("r")).select("r.id", "r.uniform", F.explode("r.profiles").alias("profile", "p"))
    return r.select(F.col("id").alias("ruleset"), "uniform", "profile", F.explode("p.windows").alias("w")).select("ruleset", "uniform", "profile", F.col("w.start_s").alias("start"), F.col("w.end_s").alias("end"), "w.positive", "w.negative")


def rule_faults(windows: DataFrame) -> DataFrame:
    """(ruleset, profile, fault): windows without start, that end before they begin, or that overlap the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("ruleset", "profile").orderBy("start")
    before = F.lag("end").over(w)
    fault = F.when(F.col("start").isNull(), "no start").when(F.col("end") <= F.col("start"), "ends before it begins").when(F.lag("start").over(w).isNotNull() & (before.isNull() | (before > F.col("start"))), "overlaps")
    return windows.withColumn("fault", fault).where("fault IS NOT NULL").select("ruleset", "profile", "fault")


def taxonomy_faults(nodes: DataFrame) -> DataFrame:
    """(id, fault): repeated ids, unknown kinds, unknown parents, concepts without parent."""
    up = nodes.select("id", F.explode("parents").alias("parent"))
    repeated = nodes.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("fault"))
    kinds = nodes.where("kind NOT IN ('category', 'subcategory', 'concept') OR kind IS NULL").select("id", F.lit("unknown kind").alias("fault"))
    lost = up.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("unknown parent").alias("fault"))
    orphans = nodes.where("kind <> 'category' AND size(coalesce(parents, array())) = 0").select("id", F.lit("no parent").alias("fault"))
    return repeated.unionByName(kinds).unionByName(lost).unionByName(orphans).distinct()


def poses(annotations: DataFrame) -> DataFrame:
    """(image_id, file_name, athlete, position, role, keypoints): one row per image and athlete."""
    images = annotations.select(F.explode("images").alias("m")).select(F.col("m.id").alias("image_id"), "m.file_name")
    rows = annotations.select(F.explode("annotations").alias("a")).select("a.image_id", F.col("a.athlete_idx").alias("athlete"), "a.position", "a.role", "a.keypoints")
    return rows.join(images, "image_id", "left")


def pose_pairs(rows: DataFrame) -> DataFrame:
    """(image_id, position, features): both athletes of an image as offsets from their common middle, scaled by their spread, with confidences."""
    a, b = (rows.where(F.col("athlete") == i).select("image_id", "position", F.col("keypoints").alias(f"k{i}")) for i in (0, 1))
    both = a.join(b.drop("position"), "image_id").withColumn("all", F.concat("k0", "k1"))
    mean = lambda d: F.aggregate("all", F.lit(0.0), lambda s, p: s + p[d]) / F.size("all")
    both = both.withColumns({"mx": mean(0), "my": mean(1)})
    spread = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, p: s + (p[0] - F.col("mx")) * (p[0] - F.col("mx")) + (p[1] - F.col("my")) * (p[1] - F.col("my"))) / F.size("all"))
    both = both.withColumn("spread", F.greatest(spread, F.lit(1e-9)))
    return both.select("image_id", "position", F.flatten(F.transform("all", lambda p: F.array((p[0] - F.col("mx")) / F.col("spread"), (p[1] - F.col("my")) / F.col("spread")))).alias("features"))


class _Table(HTMLParser):
    """The cells of the first table of a page, each with its text and the text of its first link."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.depth = self.done = 0
        self.cell: list[str] | None = None
        self.linked = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th") and self.rows:
            self.cell = ["", "", ""]
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None and not self.cell[2]:
            self.linked, self.cell[2] = True, dict(attrs).get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth
        elif tag in ("td", "th"):
            self.cell = None
        elif tag == "a":
            self.linked = False

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data
            if self.linked:
                self.cell[1] += data


def table_cells(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, row, cells array<struct<text, link_text, href>>): the first table of each page."""
    kind = pages.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, text in zip(frame["id"], frame["html"], strict=True):
                parser = _Table()
                parser.feed(text)
                out += [(page, i, [{"text": c[0].strip(), "link_text": c[1].strip(), "href": c[2]} for c in row]) for i, row in enumerate(parser.rows)]
            if out:
                yield pd.DataFrame(out, columns=["id", "row", "cells"])

    told = pages.where(F.col(html).isNotNull()).select(F.col(ident).alias("id"), F.col(html).alias("html"))
    return told.mapInPandas(run, f"id {kind}, row int, cells array<struct<text:string,link_text:string,href:string>>").withColumnRenamed("id", ident)


def match_history(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, opponent, wl, method, competition, weight, stage, year) from pages with a table of at least eight cells a row."""
    cells = table_cells(pages, ident, html).where("row > 0 AND size(cells) >= 8")
    text = lambda i: F.col("cells")[i]["text"]
    half = (F.length(text(1)) / 2).cast("int")
    single = F.when((F.length(text(1)) % 2 == 0) & (F.substring(text(1), F.lit(1), half) == F.substring(text(1), half + 1, half)), F.substring(text(1), F.lit(1), half)).otherwise(text(1))
    opponent = F.coalesce(F.nullif(F.col("cells")[1]["link_text"], F.lit("")), single)
    return cells.select(ident, opponent.alias("opponent"), text(2).alias("wl"), text(3).alias("method"), text(4).alias("competition"), text(5).alias("weight"), text(6).alias("stage"), keys.first_year(text(7)).alias("year"))


def fighter_list(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(key, href): names of a list page (first and last name in the first two cells) with their address, first wins."""
    cells = table_cells(pages, ident, html).where("row > 0 AND size(cells) >= 2")
    told = cells.select(keys.athlete_key(F.concat_ws(" ", F.col("cells")[0]["text"], F.col("cells")[1]["text"])).alias("key"), F.try_element_at(F.filter(F.transform("cells", lambda c: c["href"]), lambda h: h != ""), F.lit(1)).alias("href"), "row")
    return told.where("href IS NOT NULL AND key <> ''").groupBy("key").agg(F.min_by("href", "row").alias("href"))


def titles_and_links(pages: DataFrame, html: str) -> DataFrame:
    """The pages with `title` and `links`, by patterns alone."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumns({"title": F.nullif(title, F.lit("")), "links": F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]+)"""), F.lit(1)))})


def captions(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, i, start, end, text) of WebVTT texts; a caption that repeats the one before is left out."""
    from pyspark.sql import Window

    pattern = r"(?m)^((?:\d+:)?\d\d:\d\d\.\d{3} --> (?:\d+:)?\d\d:\d\d\.\d{3}[^\n]*\n(?:[^\n]+(?:\n|$))*)"
    blocks = texts.select(ident, F.posexplode(F.regexp_extract_all(F.replace(F.col(text), F.lit("\r"), F.lit("")), F.lit(pattern), F.lit(1))).alias("p", "b"))
    stamp = lambda n: F.regexp_extract("b", r"^((?:\d+:)?\d\d:\d\d\.\d{3}) --> ((?:\d+:)?\d\d:\d\d\.\d{3})", n)
    seconds = lambda c: F.aggregate(F.split(c, ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("b", r"^[^\n]*\n", ""), r"<[^>]*>", ""), r"\s+", " "))
    told = blocks.select(ident, "p", seconds(stamp(1)).alias("start"), seconds(stamp(2)).alias("end"), words.alias("text")).where("text <> ''")
    again = F.lag("text").over(Window.partitionBy(ident).orderBy("p")).eqNullSafe(F.col("text"))
    return told.withColumn("again", again).where("NOT again").withColumn("i", F.row_number().over(Window.partitionBy(ident).orderBy("p"))).select(ident, "i", "start", "end", "text")


#: The digits of the skeleton format.
BASE62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def decode_pose(lines: str, players: int = 2, joints: int = 23) -> list[float]:
    """The coordinates of a pose written as pairs of base-62 digits, thousandths each; x and z are shifted by two."""
    raw = "".join(lines.split())
    value = lambda i: (BASE62.index(raw[2 * i]) * 62 + BASE62.index(raw[2 * i + 1])) / 1000.0
    return [round(value(i) - (0.0 if i % 3 == 1 else 2.0), 3) for i in range(players * joints * 3)]


def skeletons(texts: DataFrame, text: str) -> DataFrame:
    """(name, tags, frames array<array<double>>) of a text database: entries with a name, tags and indented poses of four lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for whole in frame["text"]:
                name: list[str] = []
                tags: list[str] = []
                pose: list[str] = []
                for line in [*whole.splitlines(), ""]:
                    if line.startswith("    "):
                        pose.append(line)
                        continue
                    if pose:
                        out.append((" ".join(name).replace("\\n", " "), tags, [decode_pose("".join(pose[i : i + 4])) for i in range(0, len(pose) - 3, 4)]))
                        name, tags, pose = [], [], []
                    if line.startswith("tags:"):
                        tags = line[5:].split()
                    elif line.strip() and not line.startswith(("#", "properties:", "ref:")):
                        name.append(line.strip())
            if out:
                yield pd.DataFrame(out, columns=["name", "tags", "frames"])

    return texts.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(run, "name string, tags array<string>, frames array<array<double>>")


def positions_and_moves(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions (name, tags, pose) are entries of one pose; moves (name, source, target, frames) of several, their ends the nearest positions.

    Positions are a curated library, some hundreds; they are joined as one row.
    """
    positions = entries.where("size(frames) = 1").select("name", "tags", F.col("frames")[0].alias("pose"))
    packed = positions.agg(F.collect_list(F.struct("name", "pose")).alias("all")).withColumn("one", F.lit(0))
    moves = entries.where("size(frames) > 1").withColumn("one", F.lit(0)).join(F.broadcast(packed), "one")
    far = lambda pose: F.array_min(F.transform("all", lambda p: F.struct(F.aggregate(F.zip_with(pose, p["pose"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), p["name"].alias("name"))))["name"]
    return positions, moves.select("name", "tags", far(F.element_at("frames", 1)).alias("source"), far(F.element_at("frames", -1)).alias("target"), F.size("frames").alias("frames"))
