"""Who did what to whom: category, relation and roles of an event, and whether a bout's actors can be believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("guard", "pass", "control", "takedown", "sweep", "submission", "escape", "transition")

# Category, relation, the actor's role and the other's for each type of event.
TYPE_ROLES = {
    "guard": ("state", "plays", "bottom", "top"), "pass": ("action", "executes", "top", "bottom"), "control": ("state", "holds", "controlling", "controlled"), "takedown": ("action", "executes", "executor", "defender"),
    "sweep": ("action", "executes", "executor", "defender"), "submission": ("action", "executes", "executor", "defender"), "escape": ("action", "escapes", "executor", "defender"), "transition": ("transition", "initiates", "executor", "defender"),
}
# Labels whose name says more than their type.
LABELS_BY_ROLE = {
    ("guard", "state", "plays", "neutral", "neutral"): "5050 guard|leg entanglement|leg lock entanglement|leg lock exchange|leg entry|single leg x|shin to shin guard|double guard pull|inversion|outside ashi garami",
    ("guard", "state", "plays", "bottom", "top"): "half guard|closed guard|butterfly guard|deep half guard|rubber guard|lasso guard|spider guard|worm guard|open guard|de la riva guard|guard pull|pull guard|jump guard",
    ("guard", "state", "defends", "bottom", "unknown"): "turtle position",
    ("control", "state", "holds", "top", "bottom"): "mount|side control|northsouth position|knee on belly|scarf hold|threequarter mount|top half guard|top control|smash half guard|crucifix|ground and pound|near fall|nearfall",
    ("control", "state", "holds", "controlling", "controlled"): "back control|body triangle|body lock|rear body lock|seatbelt control|truck|standing back control|collar tie|underhook|double underhooks|russian tie|kimura grip|front headlock|hooks in|turtle control",
    ("control", "state", "defends", "bottom", "unknown"): "turtle position",
    ("control", "action", "escapes", "executor", "defender"): "escape to turtle",
    ("control", "action", "executes", "executor", "defender"): "arm drag|smother",
    ("takedown", "action", "defends", "defender", "executor"): "takedown defense",
    ("transition", "action", "defends", "defender", "executor"): "takedown defense",
    ("escape", "action", "defends", "defender", "executor"): "sprawl",
    ("submission", "action", "executes", "unknown", "unknown"): "submit",
}
# Seconds in which two roles of one athlete exclude each other; events from which on a bout with one actor is a filing fault.
CLASH_SECONDS, ONE_SIDED = 10, 6

RULE = "type string, label string, category string, relation string, actor_role string, target_role string"


def rule_rows() -> list[tuple[str, str | None, str, str, str, str]]:
    """The rules by label, then those by type, whose label is null."""
    named = [(key[0], label, *key[1:]) for key, labels in LABELS_BY_ROLE.items() for label in labels.split("|")]
    return named + [(kind, None, *roles) for kind, roles in TYPE_ROLES.items()]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE)


def classify(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Events (type, label) with category, relation, actor_role, target_role, status (resolved, symmetric, unknown) and source (table, type_default).

    The rule of (type, label) counts, else that of the type; a type of none has unknown roles. `rules` is a curated table as `rule_table` gives, with one
    rule per (type, label) at most.
    """
    rules = rule_table(events.sparkSession) if rules is None else rules
    names = ("category", "relation", "actor_role", "target_role")
    by_label = F.broadcast(rules.where("label IS NOT NULL").select("type", "label", F.struct(*names).alias("_named")))
    by_type = F.broadcast(rules.where("label IS NULL").select("type", F.struct(*names).alias("_default")))
    told = events.join(by_label, ["type", "label"], "left").join(by_type, "type", "left")
    rule = F.coalesce("_named", "_default", F.struct(*[F.lit(v).alias(n) for n, v in zip(names, ("transition", "initiates", "unknown", "unknown"), strict=True)]))
    told = told.withColumns({n: rule[n] for n in names}).withColumn("source", F.when(F.col("_named").isNotNull(), "table").otherwise("type_default"))
    unknown = (F.col("actor_role") == "unknown") | (F.col("target_role") == "unknown")
    return told.withColumn("status", F.when(unknown, "unknown").when(F.col("actor_role") == "neutral", "symmetric").otherwise("resolved")).drop("_named", "_default")


def bout_flags(classified: DataFrame, bout: str = "match_id", seconds: int = CLASH_SECONDS, least: int = ONE_SIDED) -> DataFrame:
    """(bout, events, actors, one_sided, contradictions, role_reliable, perspective_reliable, reason) of the events with an actor.

    One-sided: `least` events or more, all of one actor. Contradictions: pairs of an actor's events within `seconds` that put them above and below, or
    holding and held. They are counted by a range of time within (bout, actor, axis), never by pairing all events.
    """
    axis = F.when(F.col("actor_role").isin("top", "bottom"), "height").when(F.col("actor_role").isin("controlling", "controlled"), "hold")
    low = F.col("actor_role").isin("bottom", "controlled")
    told = classified.where("actor IS NOT NULL").withColumns({"_axis": axis, "_low": low, "_s": F.col("ts").cast("long")})
    near = Window.partitionBy(bout, "actor", "_axis").orderBy("_s").rangeBetween(-seconds, seconds)
    known = F.col("_axis").isNotNull() & F.col("_s").isNotNull()
    told = told.withColumn("_clash", F.when(known & ~F.col("_low"), F.count_if(F.col("_low") & known).over(near)).otherwise(0))
    flags = told.groupBy(bout).agg(F.count("*").alias("events"), F.count_distinct("actor").alias("actors"), F.sum("_clash").alias("contradictions"))
    one = (F.col("events") >= least) & (F.col("actors") <= 1)
    reason = F.when(one, "one_sided").when(F.col("contradictions") > 0, "self_contradictory")
    return flags.withColumns({"one_sided": one, "role_reliable": ~one & (F.col("contradictions") == 0), "perspective_reliable": ~one, "reason": reason})


def attribute(classified: DataFrame, sides: DataFrame, flags: DataFrame, bout: str = "match_id") -> DataFrame:
    """Each event of an actor from the corner of each athlete of its bout (`sides`: bout, athlete, opponent).

    `perspective` is favor or contra, `target` whom it happened to. `subject_role` is the athlete's own role in it, which is told only where the label
    defines both sides and the bout's roles are reliable; a role is never turned round. `status` says whether it is; `confidence` whether the perspective counts.
    """
    told = classified.where("actor IS NOT NULL").join(sides.select(bout, "athlete", "opponent"), bout).join(flags.select(bout, "role_reliable", "perspective_reliable"), bout)
    favor = F.col("actor") == F.col("athlete")
    role = F.when(favor, F.col("actor_role")).otherwise(F.col("target_role"))
    status = F.when(~F.col("role_reliable") | (role == "unknown"), "unknown").otherwise(F.col("status"))
    told = told.withColumns({"perspective": F.when(favor, "favor").otherwise("contra"), "target": F.when(favor, F.col("opponent")).otherwise(F.col("athlete")), "status": status})
    return told.withColumns({"subject_role": F.when(F.col("status") == "unknown", "unknown").otherwise(role), "confidence": F.when(F.col("perspective_reliable"), "high").otherwise("low")}).drop("role_reliable", "perspective_reliable")


def is_event(kind: Column) -> Column:
    """Whether a type is one of the eight types of events."""
    return F.coalesce(F.lower(F.trim(kind)).isin(*EVENT_TYPES), F.lit(False))


def usable_perspective(confidence: Column) -> Column:
    return confidence == "high"


def usable_role(status: Column) -> Column:
    return status.isin("resolved", "symmetric")


def directional(confidence: Column, status: Column) -> Column:
    """Whether an event may enter a statistic with a direction."""
    return usable_perspective(confidence) & usable_role(status)
