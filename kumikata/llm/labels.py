"""Problem 3: typed labels to the entries of a reference list, by a pigeonhole join in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumikata.functions.text import fold
from kumikata.plans.runtime import cut, small, spread

# Remarks that people add to a label and that leave its meaning as it is; what stands between blanks comes after a word.
REMARKS = [
    r"\([^)]*\)?",
    r"\[[^\]]*\]?",
    r"(\s)[-–,:]?\s*(left|right|far|near|other|both)\s+sides?\b",
    r"(\s)[-–,:]?\s*(lado)\s+(esquerdo|direito)\b",
    r"(\s)x\s?\d+\b",
    r"(\s)\d+\s?x\b",
    r"(\s)[-–,:]?\s*(attempts?|attempted|try|tries|tried|fail|failed|tentativa|quase|again|de novo)\s*[.!?]*$",
]

#: Most edits allowed for a reference string of at least so many characters without blanks.
EDITS = ((11, 4), (8, 3), (6, 1), (0, 0))


def edits_allowed(length: Column) -> Column:
    """The tolerance k for a reference string of this length."""
    out = F.lit(0)
    for least, k in sorted(EDITS):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def typed(col: Column) -> Column:
    """A label in lower case, unaccented, without remarks; dots stay, for they mark abbreviations."""
    out = fold(col)
    for remark in REMARKS:
        out = F.regexp_replace(out, remark, "$1 " if remark.startswith("(") else " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "'", ""), r"[^\p{L}\p{N}.]+", " "))


def words(col: Column) -> Column:
    """The words of what `typed` gives, dots dropped."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(col, r"\.", ""), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def spellings(library: DataFrame, key: str, aliases: str | None) -> DataFrame:
    """(node_key, w): the words of each entry's key and aliases."""
    names = F.coalesce(F.col(aliases), F.array().cast("array<string>")) if aliases else F.array().cast("array<string>")
    exploded = library.where(F.col(key).isNotNull()).select(F.col(key).alias("node_key"), F.explode(F.array_append(names, F.col(key))).alias("name"))
    return exploded.select("node_key", words(typed(F.col("name"))).alias("w")).where("size(w) > 0")


def reference(library: DataFrame, key: str = "node_key", aliases: str | None = "aliases") -> DataFrame:
    """(ref, ref_words, node_key, k): every spelling of each entry, its words also rotated and reversed.

    A spelling that several entries share is left out, for it names none of them.
    """
    parts = spellings(library, key, aliases)
    turned = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.concat(F.slice("w", i, F.size("w")), F.slice("w", F.lit(1), i - 1)))
    orders = parts.select("node_key", F.explode(F.array_distinct(F.array_append(turned, F.reverse("w")))).alias("ref_words"))
    spelled = orders.select("node_key", "ref_words", F.array_join("ref_words", "").alias("ref"))
    return (
        spelled.groupBy("ref").agg(F.min("node_key").alias("node_key"), F.max("node_key").alias("other"), F.min("ref_words").alias("ref_words"))
        .where(F.col("node_key") == F.col("other")).drop("other").withColumn("k", edits_allowed(F.length("ref")))
    )


def interchangeable(library: DataFrame, key: str, aliases: str | None) -> DataFrame:
    """(word, rival): each word of the list with each other word, of nearly its length, that the list uses before or after the same word."""
    placed = spellings(library, key, aliases).where("size(w) > 1").select(F.posexplode("w").alias("i", "word"), "w")
    beside = F.array(F.struct(F.lit(-1).alias("side"), F.get("w", F.col("i") - 1).alias("other")), F.struct(F.lit(1).alias("side"), F.get("w", F.col("i") + 1).alias("other")))
    places = placed.select("word", F.explode(F.filter(beside, lambda p: p["other"].isNotNull())).alias("place")).distinct()
    met = places.join(places.select("place", F.col("word").alias("rival")), "place")
    return met.where("word <> rival AND abs(length(word) - length(rival)) <= 4").select("word", "rival").distinct()


def segments(refs: DataFrame) -> DataFrame:
    """Each reference string cut into k+1 segments of nearly equal length: (size, k, part, start, len, piece)."""
    n, parts = F.length("ref"), F.col("k") + 1
    cuts = F.transform(
        F.sequence(F.lit(0), F.col("k")),
        lambda i: F.struct(i.alias("part"), (F.floor(i * n / parts) + 1).cast("int").alias("start"), (F.floor((i + 1) * n / parts) - F.floor(i * n / parts)).cast("int").alias("len")),
    )
    return refs.where("k > 0").select("ref", n.alias("size"), "k", F.inline(cuts)).withColumn("piece", F.expr("substring(ref, start, len)"))


def near(strings: DataFrame, refs: DataFrame) -> DataFrame:
    """(sq, ref, edits) of all pairs within the reference string's tolerance, by the pigeonhole join.

    A string within k edits of a reference holds one of its k+1 segments unchanged, moved by less than k positions:
    so the segments of the references meet the substrings at those positions by equality, and `levenshtein` verifies.
    """
    parts = small(segments(refs))
    shapes = small(parts.select("size", "k", "part", "start", "len").distinct())
    n, moved = F.length("sq"), F.length("sq") - F.col("size")
    # of k edits, those that move the segment lie on one side: hence the window of starts, from either end
    low = F.greatest(F.lit(1), F.col("start") - F.floor((F.col("k") - moved) / 2), F.col("start") - F.col("part"), F.col("start") + moved - (F.col("k") - F.col("part")))
    high = F.least(n - F.col("len") + 1, F.col("start") + F.floor((F.col("k") + moved) / 2), F.col("start") + F.col("part"), F.col("start") + moved + (F.col("k") - F.col("part")))
    lengths = strings.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), n - 4), n + 4)))
    probes = (
        lengths.join(shapes, "size").where(F.abs(n - F.col("size")) <= F.col("k")).withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high")
        .select("sq", "size", "part", F.explode(F.expr("transform(sequence(low, high), p -> substring(sq, p, len))")).alias("piece"))
    )
    met = probes.join(parts.select("size", "part", "piece", "ref", "k"), ["size", "part", "piece"]).select("sq", "ref", "k").distinct()
    return met.withColumn("edits", F.levenshtein("sq", "ref")).where("edits <= k").select("sq", "ref", "edits")


def completed(labels: DataFrame, library: DataFrame, key: str, aliases: str | None) -> DataFrame:
    """(typed, text) of labels with abbreviated words ("kneel. sh."): each completion from the words of one entry, and the label without its dots.

    The first abbreviated word leads to the entries that hold a word of its beginning; the others are completed from the same entry where it has such a word.
    """
    tokens = F.split("typed", " ")
    short = lambda t: t.rlike(r"^\p{L}{3,}\.$")
    stem = lambda t: F.regexp_replace(t, r"\.", "")
    cut_off = labels.where(F.exists(tokens, short)).withColumn("stem", stem(F.get(F.filter(tokens, short), F.lit(0)))).withColumn("begins", F.substring("stem", 1, 3))
    entries = spellings(library, key, aliases).select("w", F.explode("w").alias("word")).where("length(word) > 3").select("w", "word", F.substring("word", 1, 3).alias("begins")).distinct()
    met = cut_off.join(small(entries), "begins").where("startswith(word, stem) AND length(word) > length(stem)")
    whole = lambda t: F.coalesce(F.when(stem(t) == F.col("stem"), F.col("word")), F.get(F.filter("w", lambda x: x.startswith(stem(t))), F.lit(0)), t)
    full = met.select("typed", F.array_join(F.transform(tokens, lambda t: F.when(short(t), whole(t)).otherwise(t)), " ").alias("text"))
    return full.distinct().unionByName(labels.select("typed", F.col("typed").alias("text")))


def canonical(labels: DataFrame, library: DataFrame, label: str = "label", key: str = "node_key", aliases: str | None = "aliases") -> DataFrame:
    """Map free-entered values to a reference list: (label, node_key), one row for each different label that is not null.

    `library` is a curated list with a unique `key` and, optionally, an array of `aliases`. `node_key` is null where no
    entry is meant. Method: labels are folded and stripped of remarks, abbreviated words are completed from the list's own
    words, and equal spellings are joined. What is left goes through the pigeonhole join (`near`). A word of a label that is, or is
    nearer to, another word that the list uses in the same places rules a candidate out, so that a value which the list lacks
    does not fall to a neighbour; so do two different entries at the same distance. All of it is SQL functions and joins: nothing comes to the driver, no length
    of label or list is left out, and each step works on different typed forms, pairs and words, however often they occur.

    Cases: a null label has no row; an empty one, or one of symbols only, means nothing (null key). Repeated labels give one row;
    extra columns are ignored. Very long labels cost what their substrings cost and match nothing. An empty library leaves all keys null.
    """
    refs = cut(reference(library, key, aliases))
    known = small(refs.select("ref", "node_key"))
    base = cut(labels.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("typed", typed(F.col("label"))))
    forms = completed(base.select("typed").distinct(), library, key, aliases)
    spelled = cut(forms.withColumn("w", words(F.col("text"))).select("typed", "w", F.array_join("w", "").alias("sq")))
    exact = spelled.join(known, spelled["sq"] == known["ref"]).groupBy("typed").agg(F.min("node_key").alias("node_key"), F.max("node_key").alias("other"))
    exact = cut(exact.where("node_key = other").select("typed", "node_key"))
    rest = spelled.join(spread(exact), "typed", "left_anti")
    pairs = near(rest.select("sq").distinct(), refs)
    judged = cut(rest.join(spread(pairs), "sq").join(small(refs.select("ref", "ref_words", "node_key")), "ref").select("typed", "w", "ref_words", "node_key", "edits"))
    # a word that is nearer to a rival of the entry's word than to that word: told once for each different pair of words
    aligned = judged.where("size(w) = size(ref_words)").select("typed", "w", "ref_words", F.explode(F.arrays_zip(F.col("w").alias("word"), F.col("ref_words").alias("meant"))).alias("z")).where("z.word <> z.meant")
    pairs_of_words = aligned.select("z.word", "z.meant").distinct()
    rivals = small(interchangeable(library, key, aliases).select(F.col("word").alias("meant"), "rival"))
    misread = pairs_of_words.join(rivals, "meant").where("levenshtein(word, rival) < levenshtein(word, meant)").select("word", "meant")
    wrong = aligned.join(spread(misread), [F.col("z.word") == misread["word"], F.col("z.meant") == misread["meant"]], "left_semi").select("typed", "w", "ref_words")
    fits = judged.where("size(w) = size(ref_words) OR edits <= 2").join(spread(wrong), ["typed", "w", "ref_words"], "left_anti")
    # the least and the greatest entry of those at the least distance
    nearest = fits.groupBy("typed").agg(F.min(F.struct("edits", "node_key")).alias("a"), F.max(F.struct((-F.col("edits")).alias("near"), "node_key")).alias("z"))
    found = nearest.where("a.node_key = z.node_key").select("typed", F.col("a.node_key").alias("node_key"))
    return base.join(spread(exact.unionByName(found)), "typed", "left").select("label", "node_key")
