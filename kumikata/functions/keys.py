"""Keys, names, labels and rules as columns: everything here stays inside the JVM."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumikata.functions.text import MARKED, PLAIN
from kumikata.sources.views import node_key

# Method families by the words of the folded method, in this order.
METHOD_FAMILIES = (
    ("void", r"^$|no contest|nulo|walkover|forfeit"), ("points", r"\bpts?\b|points?|pontos?|\d+\s*[x-]\s*\d+"), ("decision", r"decis|judge|referee|\bref\b"), ("injury", r"injur|\binj|lesao"), ("dq", r"\bdq\b|disqual|desclass"),
    ("leg", r"heel|knee|foot|leg|ankle|toe|calf"), ("strangle", r"choke|strangle|guillotine|triangle|rnc"), ("joint", r"arm|kimura|americana|wrist|omoplata|lock|crank"), ("slicer", r"slicer"),
)
# What events' names say about the uniform and the rules; no-gi is looked for first, and the first ruleset counts.
UNIFORMS = (("no_gi", r"no-?\s?gi|adcc|sub only|submission only|grappling"), ("gi", r"\bgi\b|pans|mundial|worlds|european"))
RULESETS = (("ajp", r"\bajp\b|abu dhabi"), ("adcc", r"\badcc\b"), ("ibjjf", r"ibjjf|pans|mundial|european"), ("league", r"^liga|league"), ("cup", r"^copa|^taca|cup$"))
# Other writings of a belt, and the rating it starts with.
BELTS = {"white": 200.0, "blue": 350.0, "purple": 500.0, "brown": 650.0, "black": 800.0}


def deaccent(col: Column) -> Column:
    """Latin letters without accents, composed or not; case stays."""
    return F.translate(F.regexp_replace(col, r"\p{M}+", ""), MARKED, PLAIN)


def fold(col: Column) -> Column:
    """Without accents, lower case, trimmed; null becomes empty."""
    return F.lower(F.trim(deaccent(F.coalesce(col, F.lit("")))))


def display_name(col: Column) -> Column:
    """A name without timestamps, spaced nicknames, clauses after a colon, leaked brackets, annotations and trailing numbers; case and accents stay."""
    out = F.regexp_replace(col, r"\[[0-9:]+\]", "")
    out = F.regexp_replace(out, r"(?<=\s)'[^']+'(?=\s|$)", "")
    out = F.substring_index(out, ":", 1)
    opened = F.length(F.regexp_replace(out, r"[^(]", "")) > F.length(F.regexp_replace(out, r"[^)]", ""))
    out = F.when(opened, F.substring_index(out, "(", -1)).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s*\([^()]*\)", ""), r"\)", ""), r"\s+\d+$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def athlete_key(col: Column) -> Column:
    """The identity key of a name: cleaned, unaccented, in key form."""
    return node_key(deaccent(display_name(col)))


def resolved(frame: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """`key` replaced by its canonical form where `aliases` (key, canonical) has one."""
    names = aliases.select(F.col("key").alias(key), F.col("canonical").alias("_canonical"))
    return frame.join(names, key, "left").withColumn(key, F.coalesce("_canonical", key)).drop("_canonical")


def slug(col: Column) -> Column:
    """A name for an address."""
    return F.replace(node_key(col), F.lit(" "), F.lit("-"))


def bout_slug(a: Column, b: Column, year: Column) -> Column:
    """`<a>-vs-<b>-<year or tbd>`."""
    return F.concat(slug(a), F.lit("-vs-"), slug(b), F.lit("-"), F.coalesce(year.cast("string"), F.lit("tbd")))


def first_of(col: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The first rule whose pattern occurs."""
    return F.coalesce(*[F.when(col.rlike(p), F.lit(name)) for name, p in rules], F.lit(default))


def method_family(method: Column) -> Column:
    """What kind of ending a method is; null and empty are void, what nothing fits is another submission."""
    return first_of(fold(method), METHOD_FAMILIES, "sub_other")


def uniform(event: Column) -> Column:
    """no_gi, gi or unknown, from the event's name."""
    return first_of(fold(event), UNIFORMS, "unknown")


def ruleset(event: Column) -> Column:
    """The rules of an event by its name."""
    return first_of(fold(event), RULESETS, "other")


def method_text(kind: Column, submission: Column) -> Column:
    """A result for people."""
    return F.when(kind.isNull() | (kind == ""), "No contest / draw").when((kind == "SUBMISSION") & submission.isNotNull() & (submission != ""), F.concat(F.lit("Submission ("), submission, F.lit(")"))).otherwise(F.initcap(F.lower(kind)))


def win_type(raw: Column) -> Column:
    """One of six kinds of win; the order of the rules matters."""
    up = F.upper(F.trim(raw))
    return F.when(up.contains("SUB"), "SUBMISSION").when(up.contains("DEC") | up.contains("REF"), "DECISION").when(up.contains("DQ") | up.contains("DESQ"), "DQ").when(up.contains("INJ"), "INJURY").otherwise("POINTS")


def discipline(event: Column) -> Column:
    """mma, wrestling or grappling, from the event's tag; without one mma."""
    return F.when(event.isNull() | event.startswith("UFC"), "mma").when(event.startswith("NCAA"), "wrestling").otherwise("grappling")


def outcome(kind: Column, ok: Column, points: Column) -> Column:
    """How effective an event was: official points first, else its flag, three-valued."""
    return F.when(points == 1, "advantage").when(points.isNotNull(), "points").when(ok & (kind == "submission"), "finish").when(ok, "done").when(~ok, "no effect").otherwise("not known")


def minute_left(ts: Column, duration: Column, start: Column, absolute: Column) -> Column:
    """The minute remaining, as `6-5`; 'no time' where the time within the bout is unknown."""
    at = F.when(absolute, ts - start).otherwise(ts)
    minute = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.0), duration - at) / 60).cast("int"))
    return F.coalesce(F.when((duration > 0) & at.isNotNull(), F.concat(minute.cast("string"), F.lit("-"), (minute - 1).cast("string"))), F.lit("no time"))


def belt_rating(belt: Column) -> Column:
    """The rating that a belt starts with; black where unknown."""
    return F.coalesce(*[F.when(F.lower(F.trim(belt)) == b, F.lit(v)) for b, v in BELTS.items()], F.lit(BELTS["black"]))


def months_between(match: Column, reference: Column) -> Column:
    """Months of 30.44 days from one date to the other, at least 0."""
    return F.greatest(F.lit(0.0), F.datediff(reference, match) / 30.44)


def video_id(url: Column) -> Column:
    """The eleven characters that name a video, alone or in any of the usual addresses."""
    alone = F.when(F.trim(url).rlike(r"^[A-Za-z0-9_-]{11}$"), F.trim(url))
    found = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/(?:embed|shorts|live|v)/)([A-Za-z0-9_-]{11})", 1)
    return F.coalesce(alone, F.nullif(found, F.lit("")))


def clean_transcript(text: Column) -> Column:
    """Without bracketed cues, blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", " "), r"\s+", " "))


def versus(title: Column) -> tuple[Column, Column]:
    """Both names of 'A vs B'; null where there is none."""
    pattern = r"^(.*?)\s+(?:vs\.?|versus|contra|frente a|против)\s+([^,.\n]+)"
    return F.nullif(F.trim(F.regexp_extract(title, pattern, 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(title, pattern, 2)), F.lit(""))


def first_year(title: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def fact_id(*parts: Column) -> Column:
    """The same key for the same parts."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def grade(count: Column, bouts: Column) -> Column:
    """How well a fact is supported by its events and bouts; null where it is not. Fixed values."""
    return F.when((count >= 8) & (bouts >= 4), "strong").when((count >= 5) & (bouts >= 3), "sustained").when((count >= 3) & (bouts >= 2), "limited")


def vector(text: Column) -> Column:
    """Numbers from a text such as [1, 2.5]."""
    return F.from_json(text, "array<double>")


# Words of an attempt or an outcome at the end of a label.
ATTEMPTS = r"\s+(attempts?|attempted|defen[cs]e|escaped|failed|finish(ed)?|success(ful)?)$"
# How a frame's classes name the side of a position.
SIDES = ("top", "bottom", "neutral")


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS, M:SS or plain seconds; null where it is none of them."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(p.rlike(r"^[0-9]{1,6}$"), p.cast("int")))
    known = (F.size(parts) <= 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(known, F.aggregate(parts, F.lit(0), lambda acc, p: acc * 60 + p))


def without_attempt(label: Column) -> Column:
    """A label less the word of an attempt or outcome at its end."""
    return F.trim(F.regexp_replace(label, ATTEMPTS, ""))


def class_parts(name: Column) -> tuple[Column, Column]:
    """Position and side of a class such as `mount_top`; without a known side all is position."""
    side = F.substring_index(name, "_", -1)
    has = name.contains("_") & side.isin(*SIDES)
    return F.when(has, F.regexp_replace(name, r"_[^_]*$", "")).otherwise(name), F.when(has, side)


def detector_class(name: Column, roles: dict[int, str] | None = None) -> Column:
    """A detector's raw class (`Mount 1`, `side-control2`) as `position_role`; its number says the role."""
    roles = roles or {1: "top", 2: "bottom"}
    number = F.regexp_extract(name, r"([0-9]+)\s*$", 1)
    role = F.coalesce(*[F.when(number == str(n), F.lit(r)) for n, r in roles.items()])
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[0-9]+\s*$", ""), r"[^a-z0-9]+", " ")), " ", "_")
    return F.when(role.isNotNull(), F.concat(plain, F.lit("_"), role)).otherwise(plain)


def frame_actor(centre: Column, width: Column, side: Column) -> Column:
    """you or opponent, by the half of the frame in which a box has its centre and the side on which you are."""
    left = centre < width / 2
    return F.when(left == (side == "left"), "you").otherwise("opponent")


def role_actor(role: Column, own: Column) -> Column:
    """you, opponent or neutral, by the side of a position."""
    return F.when(role.isin("top", "bottom"), F.when(role == own, "you").otherwise("opponent")).otherwise("neutral")


def variations(first: Column, second: Column) -> Column:
    """The different search forms of an entry's two names, in lower case."""
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(F.lower(F.trim(c)), F.lit("")) for c in (first, second)])))


def reviewed(pairs: DataFrame, verdicts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with the `verdict` and `reason` of people (a, b, verdict, reason), whichever of the two stands first."""
    told = verdicts.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"), "verdict", "reason").dropDuplicates(["_a", "_b"])
    return pairs.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)}).join(told, ["_a", "_b"], "left").drop("_a", "_b")


def aliases_of(aliases: DataFrame, roster: DataFrame) -> DataFrame:
    """The aliases (alias, key) whose key is in the roster (key)."""
    return aliases.join(roster.select("key").distinct(), "key", "left_semi").select("alias", "key")


def clean_labels(events: DataFrame, library: DataFrame) -> DataFrame:
    """(events with `clean`, `changed`): labels less their attempt, under the name of the library (form, name, type) unless its type contradicts the event's."""
    forms = library.select(F.col("form").alias("_form"), F.col("name").alias("_name"), F.col("type").alias("_type")).dropDuplicates(["_form"])
    told = events.withColumn("_form", without_attempt(node_key(F.col("label")))).join(forms, "_form", "left")
    agrees = F.col("_name").isNotNull() & (F.col("_type").isNull() | F.col("type").isNull() | (F.col("_type") == F.col("type")))
    return told.withColumn("clean", F.when(agrees, F.col("_name")).otherwise(F.col("label"))).withColumn("changed", F.col("clean") != F.col("label")).drop("_form", "_name", "_type")


def at_path(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text."""
    return F.get_json_object(document, "$." + path)


def formula(document: Column, text: str) -> Column:
    """A sum, difference, product or quotient over numbers and dotted paths of a JSON text; anything else is refused. Null by zero.

    The text is read here, never handed to SQL.
    """
    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
            a, b = build(node.left), build(node.right)
            return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b if isinstance(node.op, ast.Mult) else F.try_divide(a, b)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, (ast.Name, ast.Attribute)):
            return at_path(document, ast.unparse(node)).try_cast("double")
        raise ValueError(f"not a formula: {text}")

    return build(ast.parse(text, mode="eval").body)
