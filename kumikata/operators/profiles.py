"""Athletes beside each other and beside everybody: benchmarks, overlaps, systems, lineages, eligibility, dossiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.operators import graphs
from kumikata.plans.runtime import cut, spread


def type_benchmark(mix: DataFrame, who: str, item: str, share: str = "share") -> DataFrame:
    """(who, item, share, mean, gap): each one's share of an item less the mean of everybody's."""
    mean = mix.groupBy(item).agg(F.avg(share).alias("mean"))
    return mix.join(F.broadcast(mean), item).select(who, item, share, "mean", (F.col(share) - F.col("mean")).alias("gap"))


def technique_benchmark(counts: DataFrame, who: str, item: str, n: str = "n", least: int = 5) -> DataFrame:
    """(who, most, most_ratio, least, least_ratio): the items that someone uses most and least often against everybody's share; of those used at least so often by all."""
    total = counts.groupBy(item).agg(F.sum(n).alias("_t"))
    every = counts.groupBy(F.lit(0).alias("one")).agg(F.sum(n).alias("_all"))
    own = counts.withColumn("_own", F.sum(n).over(Window.partitionBy(who))).withColumn("one", F.lit(0))
    told = own.join(total.where(F.col("_t") >= least), item).join(F.broadcast(every), "one").withColumn("ratio", F.round((F.col(n) / F.col("_own")) / (F.col("_t") / F.col("_all")), 6))
    return told.groupBy(who).agg(F.min_by(F.struct(item, "ratio"), F.struct(-F.col("ratio"), F.col(item))).alias("a"), F.min_by(F.struct(item, "ratio"), F.struct(F.col("ratio"), F.col(item))).alias("b")).select(who, F.col(f"a.{item}").alias("most"), F.col("a.ratio").alias("most_ratio"), F.col(f"b.{item}").alias("least"), F.col("b.ratio").alias("least_ratio"))


def top_sets(counts: DataFrame, who: str, item: str, n: str, top: int) -> DataFrame:
    """(who, items): each one's `top` most frequent items, in order of name."""
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(who).orderBy(F.desc(n), item))).where(F.col("_r") <= top)
    return ranked.groupBy(who).agg(F.array_sort(F.collect_list(item)).alias("items"))


def overlaps(pairs: DataFrame, sets: DataFrame, who: str) -> DataFrame:
    """Pairs (a, b) with `shared` items and `jaccard` of their sets; a side without a set has the empty one."""
    told = pairs
    for x in "ab":
        told = told.join(sets.select(F.col(who).alias(x), F.col("items").alias(f"_{x}")), x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", F.array().cast("array<string>")))
    return told.withColumns({"shared": F.size(F.array_intersect("_a", "_b")), "jaccard": graphs.jaccard(F.col("_a"), F.col("_b"))}).drop("_a", "_b")


def systems(edges: DataFrame, kinds: DataFrame, who: str) -> DataFrame:
    """(who, community, size, hub, support, dominant, share): an athlete's communities of moves with the type that leads in each."""
    # what is told of a community goes along with its members: it is found once, and laid by graph once
    of = ["graph", "community", "size", "hub", "support"]
    found = graphs.communities(edges, who).select(*of, "members").repartition("graph")
    members = found.select(*of, F.explode("members").alias("label")).join(kinds.select("label", "type"), "label", "left")
    counts = members.groupBy(*of, "type").agg(F.count("*").alias("n"))
    lead = counts.groupBy(*of).agg(F.min_by(F.struct("type", "n"), F.struct(-F.col("n"), F.col("type"))).alias("l"), F.sum("n").alias("all"))
    return lead.select(F.col("graph").alias(who), "community", "size", "hub", "support", F.col("l.type").alias("dominant"), (F.col("l.n") / F.col("all")).alias("share"))


def system_similarity(cosine: Column, same_hub: Column, sizes: tuple[Column, Column], ratings: tuple[Column, Column]) -> Column:
    """How alike two systems are: half by composition, a fifth by the hub's type, the rest by size and rating."""
    near = lambda a, b: F.coalesce(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b)), F.lit(1.0))
    return 0.50 * cosine + 0.20 * same_hub.cast("double") + 0.15 * near(*sizes) + 0.15 * near(*ratings)


def system_score(cosine: np.ndarray, same_hub: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], ratings: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`system_similarity` of arrays: the same operations in the same order, so that ties are the same."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.maximum(a, b)
        return np.divide(np.minimum(a, b), most, out=np.ones(most.shape), where=most != 0)

    return 0.50 * cosine + 0.20 * same_hub + 0.15 * near(*sizes) + 0.15 * near(*ratings)


def lineage(old: DataFrame, new: DataFrame, least: float = 0.3) -> DataFrame:
    """(kind, old, new, jaccard): what became of each community (community, members): kept, split, merged, born or gone.

    Only communities that share a member are compared, by counts: no list of members is joined. Kept: each is the other's most alike. Split: an old one's second heir; merged: a second origin of a new one.
    """
    # sizes are taken before members are spread, else once a member
    old, new = (cut(x.select("community", F.array_distinct("members").alias("members")).withColumn("size", F.size("members"))) for x in (old, new))
    side = lambda x, name, size: spread(x.select(F.col("community").alias(name), F.col("size").alias(size), F.explode("members").alias("m")))
    shared = side(old, "old", "_a").join(side(new, "new", "_b"), "m").groupBy("old", "new", "_a", "_b").agg(F.count("*").alias("_n"))
    pairs = cut(shared.select("old", "new", (F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n"))).alias("jaccard")).where(F.col("jaccard") >= least))
    ranked = pairs.withColumns({"_ro": F.row_number().over(Window.partitionBy("old").orderBy(F.desc("jaccard"), "new")), "_rn": F.row_number().over(Window.partitionBy("new").orderBy(F.desc("jaccard"), "old"))})
    kind = F.when((F.col("_ro") == 1) & (F.col("_rn") == 1), "kept").when(F.col("_ro") > 1, "split").otherwise("merged")
    seen = ranked.select(kind.alias("kind"), "old", "new", "jaccard")
    born = new.select(F.col("community").alias("new")).join(ranked.select("new"), "new", "left_anti").select(F.lit("born").alias("kind"), F.lit(None).cast(old.schema["community"].dataType).alias("old"), "new", F.lit(None).cast("double").alias("jaccard"))
    gone = old.select(F.col("community").alias("old")).join(ranked.select("old"), "old", "left_anti").select(F.lit("gone").alias("kind"), "old", F.lit(None).cast(new.schema["community"].dataType).alias("new"), F.lit(None).cast("double").alias("jaccard"))
    return seen.unionByName(born).unionByName(gone)


def stability(jaccard: Column, driven: Column) -> Column:
    """What a community's resampling says of it."""
    return F.when(driven, "athlete driven").when(jaccard >= 0.75, "stable").when(jaccard >= 0.5, "partially stable").otherwise("unstable")


def eligible(patterns: DataFrame, who: str, bout: str = "match_id", least: tuple[int, int, int, int] = (3, 5, 2, 2)) -> DataFrame:
    """(who, bouts, patterns, conditions, branches, reason): whether there is enough for a decision flow; the first gate that fails is the reason."""
    told = patterns.where("condition IS NOT NULL").groupBy(who).agg(F.count_distinct(bout).alias("bouts"), F.count("*").alias("patterns"), F.count_distinct("condition").alias("conditions"), F.count_distinct("action").alias("branches"))
    gates = zip(("bouts", "patterns", "conditions", "branches"), least, strict=True)
    return told.withColumn("reason", F.coalesce(*[F.when(F.col(c) < n, F.lit(f"too few {c}")) for c, n in gates], F.lit("eligible")))


def duplicates(names: DataFrame, name: str, n: str, most: int = 2) -> DataFrame:
    """(a, b, n_a, n_b, edits): names a few edits apart, for people to judge; never merged. Candidates share a word of three letters or more, met by equality."""
    words = names.select(F.col(name).alias("x"), F.col(n).alias("n"), F.explode(F.array_distinct(F.split(F.col(name), " "))).alias("w")).where("length(w) >= 3")
    a, b = words.select(F.col("x").alias("a"), F.col("n").alias("n_a"), "w"), words.select(F.col("x").alias("b"), F.col("n").alias("n_b"), "w")
    met = a.join(b, "w").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= most)).drop("w").distinct()
    return met.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= most)


def rings(events: DataFrame, axes: dict[str, str], who: str = "actor") -> DataFrame:
    """(axis, events, share, contributors, rate): use of each axis, by how many people, and how often it works among the known."""
    axis = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in axes.items()])
    told = events.withColumn("axis", axis).where("axis IS NOT NULL").groupBy("axis").agg(F.count("*").alias("events"), F.count_distinct(who).alias("contributors"), F.avg(F.col("ok").cast("double")).alias("rate"))
    every = told.agg(F.sum("events").alias("_all")).withColumn("_one", F.lit(0))
    return told.withColumn("_one", F.lit(0)).join(F.broadcast(every), "_one").withColumn("share", F.col("events") / F.col("_all")).drop("_one", "_all")


def split_mashed(events: DataFrame, rules: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Events whose label a rule (label, first, second) names become two, `seconds` apart; the second keeps the outcome."""
    told = events.join(F.broadcast(rules.select("label", "first", "second")), "label", "left")
    parts = F.when(F.col("first").isNull(), F.array(F.struct(F.col("label").alias("label"), F.col("ok").alias("ok"), F.lit(0.0).alias("plus")))).otherwise(F.array(F.struct(F.col("first").alias("label"), F.lit(None).cast("boolean").alias("ok"), F.lit(0.0).alias("plus")), F.struct(F.col("second").alias("label"), F.col("ok").alias("ok"), F.lit(seconds).alias("plus"))))
    rest = [c for c in events.columns if c not in ("label", "ok", "ts")]
    return told.select(*rest, "ts", F.posexplode(parts).alias("part", "p")).select(*rest, "part", "p.label", "p.ok", (F.col("ts") + F.col("p.plus")).alias("ts"))


def cross_validated(frame: DataFrame, vector: str, label: str, group: str, folds: int = 4, seed: int = 42) -> DataFrame:
    """(fold, n, accuracy): a forest that is asked only about groups which it has not seen; the indexer holds all labels, however many."""
    known = frame.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("string"))
    indexed = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc").fit(known).transform(known)
    told = indexed.select(F.col(vector).alias("a"), F.col("_index").alias("label"), F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).alias("fold"))
    # written once, laid out by content, so that each fit sees the same rows in the same order
    data = cut(told.repartition("a", "label").sortWithinPartitions("fold", "a", "label").select(array_to_vector("a").alias("features"), "label", "fold"))
    out = None
    for k in range(folds):
        model = RandomForestClassifier(numTrees=20, seed=seed).fit(data.where(F.col("fold") != k))
        part = model.transform(data.where(F.col("fold") == k)).agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out
