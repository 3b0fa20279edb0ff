"""Vectors: exact neighbours in blocks, centroids, sparse cosine, features, TF-IDF, archetypes, importances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumikata.operators.joins import merge_components
from kumikata.plans.runtime import cut

#: Rows of one block of vectors.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def masked(vector: Column, first: int, count: int) -> Column:
    """The part of a vector that is known."""
    return F.slice(vector, first, count)


def _blocks(frame: DataFrame, ident: str, vector: str, extra: str | None, tag: str) -> DataFrame:
    """Rows in blocks by hash, one row a block: (block, ids, rows, extras)."""
    fields = [F.col(ident).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("float")).alias("v"), (F.col(extra).cast("string") if extra else F.lit("")).alias("x")]
    told = frame.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(*fields)
    blocks = max(1, -(-told.count() // BLOCK))
    return told.withColumn(tag, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy(tag).agg(F.collect_list(F.struct("id", "v", "x")).alias(f"rows_{tag}")), blocks


def _tasks(frame: DataFrame, pairs: int) -> int:
    """A task for each pair of blocks, up to eight times as many as the session's shuffles have."""
    return max(1, min(pairs, 8 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def neighbours(queries: DataFrame, corpus: DataFrame, ident: str, vector: str, k: int = 5, least: float = -1.0) -> DataFrame:
    """(query, neighbour, cosine, rank): the `k` most alike of the corpus for each query, not itself; exact.

    Both sides are cut into blocks of bounded size; every pair of blocks is one row and one matrix product, of which the best `k` a query
    leave the task. Nothing of size N x N exists anywhere.
    """
    q, nq = _blocks(queries, ident, vector, None, "qb")
    c, nc = _blocks(corpus, ident, vector, None, "cb")
    # every query block with every corpus block, by an equality on the pair's number
    left = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    pairs = left.repartition(_tasks(queries, nq * nc), "qb", "cb").join(c, "cb")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["rows_qb"], frame["rows_cb"], strict=True):
                qi, ci = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
                qv, cv = (np.array([r["v"] for r in x], dtype="float64") for x in (a, b))
                qv, cv = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (qv, cv))
                score = qv @ cv.T
                score[qi[:, None] == ci[None, :]] = -2
                take = min(k, score.shape[1])
                at = np.argpartition(-score, take - 1, axis=1)[:, :take]
                # all that equal the last one taken come along, so that ties end the same way everywhere
                edge = np.take_along_axis(score, at, 1).min(1)
                r, col = np.nonzero((score >= edge[:, None] - 1e-12) & (score > -2) & (score >= least))
                yield pd.DataFrame({"query": qi[r], "neighbour": ci[col], "cosine": score[r, col]})

    found = pairs.select("rows_qb", "rows_cb").mapInPandas(best, "query long, neighbour long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(frame: DataFrame, ident: str, vector: str, label: str, least: float, same: bool) -> DataFrame:
    """(a, b, cosine): pairs with the same (or different) label at least that alike; exact, in blocks, only such pairs leave a task."""
    one, n = _blocks(frame, ident, vector, label, "qb")
    other = one.select(F.col("qb").alias("cb"), F.col("rows_qb").alias("rows_cb"))
    left = one.withColumn("cb", F.explode(F.sequence(F.col("qb"), F.lit(n - 1))))
    pairs = left.repartition(_tasks(frame, n * (n + 1) // 2), "qb", "cb").join(other, "cb")

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame_ in frames:
            for qb, cb, a, b in zip(frame_["qb"], frame_["cb"], frame_["rows_qb"], frame_["rows_cb"], strict=True):
                ai, bi = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
                al, bl = np.array([r["x"] for r in a], dtype=object), np.array([r["x"] for r in b], dtype=object)
                av, bv = (np.array([r["v"] for r in x], dtype="float64") for x in (a, b))
                av, bv = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) for x in (av, bv))
                score = av @ bv.T
                keep = (score >= least) & ((al[:, None] == bl[None, :]) == same)
                keep &= (ai[:, None] < bi[None, :]) if qb == cb else (ai[:, None] != bi[None, :])
                r, c = np.nonzero(keep)
                yield pd.DataFrame({"a": np.minimum(ai[r], bi[c]), "b": np.maximum(ai[r], bi[c]), "cosine": score[r, c]})

    return pairs.select("qb", "cb", "rows_qb", "rows_cb").mapInPandas(alike, "a long, b long, cosine double")


def weighted_mean(frame: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """(group, mean): the weighted mean vector of each group, by dimension; weights below 1e-6 count as that."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    spread = frame.select(group, w.alias("w"), F.posexplode(vector).alias("dim", "x"))
    dims = spread.groupBy(group, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def centroid_cosine(frame: DataFrame, ident: str, group: str, vector: str) -> DataFrame:
    """(ident, group, cosine): how alike each vector is to the mean of its group without it; null if it is alone."""
    spread = frame.select(group, F.posexplode(vector).alias("dim", "x"))
    dims = spread.groupBy(group, "dim").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda r: r["s"]).alias("sum"))
    sizes = frame.groupBy(group).agg(F.count("*").alias("n"))
    told = frame.join(sums, group).join(sizes, group)
    rest = F.zip_with("sum", vector, lambda s, x: s - x.cast("double"))
    return told.select(ident, group, F.when(F.col("n") > 1, cosine(F.col(vector), rest)).alias("cosine"))


def sparse_cosine(edges: DataFrame, source: str, target: str, weight: str, least: float = 0.0) -> DataFrame:
    """(a, b, cosine): how alike the ways out of two nodes are; only nodes that share a target meet."""
    norms = edges.groupBy(source).agg(F.sqrt(F.sum(F.col(weight).cast("double") * F.col(weight))).alias("norm"))
    unit = edges.join(norms, source).select(F.col(source).alias("node"), F.col(target).alias("t"), (F.col(weight) / F.col("norm")).alias("u"))
    a, b = unit.select(F.col("node").alias("a"), "t", F.col("u").alias("ua")), unit.select(F.col("node").alias("b"), "t", F.col("u").alias("ub"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine")).where(F.col("cosine") >= least)


def sparse_neighbours(edges: DataFrame, source: str, target: str, weight: str, k: int = 10) -> DataFrame:
    """(a, b, cosine, rank): for each node the `k` whose ways out are most alike, all above 0, lengths over all edges; exact.

    Nodes are in blocks of at most BLOCK by hash, and every pair of blocks is one product, taken BLOCK targets at a time, so that a target that many nodes
    share makes no pairs of rows. Of a product the best `k` a node leave the task, with what ties with the last.
    """
    rows = edges.groupBy(F.col(source).alias("id")).agg(F.collect_list(F.col(target)).alias("t"), F.collect_list(F.col(weight).cast("double")).alias("w"))
    rows = cut(rows)
    n = max(1, -(-rows.count() // BLOCK))
    block = rows.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("id", "t", "w")).alias("rows_qb"))
    other = block.select(F.col("qb").alias("cb"), F.col("rows_qb").alias("rows_cb"))
    pairs = block.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n * n, "qb", "cb").join(other, "cb")

    def flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        long = [len(r["t"]) for r in rows]
        w = [np.asarray(r["w"]) / np.linalg.norm(r["w"]) for r in rows]
        return np.array([r["id"] for r in rows], dtype=object), np.repeat(np.arange(len(rows)), long), np.concatenate([r["t"] for r in rows]).astype(str), np.concatenate(w)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["rows_qb"], frame["rows_cb"], strict=True):
                (ai, ar, at, aw), (bi, br, bt, bw) = flat(a), flat(b)
                both, code = np.unique(np.concatenate([at, bt]), return_inverse=True)
                ac, bc = code[: len(at)], code[len(at) :]
                score = np.zeros((len(ai), len(bi)))
                for low in range(0, len(both), BLOCK):
                    part = []
                    for r, c, w, size in ((ar, ac, aw, len(ai)), (br, bc, bw, len(bi))):
                        dense, inside = np.zeros((size, BLOCK)), (c >= low) & (c < low + BLOCK)
                        dense[r[inside], c[inside] - low] = w[inside]
                        part.append(dense)
                    score += part[0] @ part[1].T
                score[ai[:, None] == bi[None, :]] = 0
                take = min(k, score.shape[1])
                edge = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                r, c = np.nonzero((score >= edge[:, None] - 1e-9) & (score > 0))
                yield pd.DataFrame({"a": ai[r], "b": bi[c], "cosine": score[r, c]})

    found = pairs.select("rows_qb", "rows_cb").mapInPandas(best, "a string, b string, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_shares(frame: DataFrame, who: str, item: str, items: tuple[str, ...]) -> DataFrame:
    """(who, vector): each one's shares of the given items as a vector of length 1."""
    counts = frame.where(F.col(item).isin(*items)).groupBy(who).agg(F.array(*[F.count_if(F.col(item) == x).cast("double") for x in items]).alias("c"))
    return counts.select(who, F.transform("c", lambda x: x / norm(F.col("c"))).alias("vector"))


def nearest(frame: DataFrame, ident: str, vector: str, centres: DataFrame, centre: str, at: str) -> DataFrame:
    """(ident, centre, distance): the nearest of few centres for each vector; the centres, at most some hundred, are one joined row."""
    packed = centres.agg(F.collect_list(F.struct(F.col(centre).alias("c"), F.col(at).alias("v"))).alias("all")).withColumn("one", F.lit(0))
    told = frame.withColumn("one", F.lit(0)).join(F.broadcast(packed), "one")
    far = F.transform("all", lambda c: F.struct(F.round(F.sqrt(F.aggregate(F.zip_with(F.col(vector), c["v"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)), 9).alias("distance"), c["c"].alias("centre")))
    return told.select(ident, F.array_min(far).alias("m")).select(ident, F.col("m.centre").alias(centre), "m.distance")


# words


def terms(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, tf): the words of each text with their counts."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return documents.where(F.col(text).isNotNull()).select(ident, words.alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"))


def tfidf(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, weight): tf x (ln((n + 1) / (df + 1)) + 1), each text a vector of length 1; n counts all texts that are not null."""
    counted = terms(documents, ident, text)
    n = documents.where(F.col(text).isNotNull()).agg(F.count("*").alias("n")).withColumn("one", F.lit(0))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("one", F.lit(0)).join(F.broadcast(n), "one").select("term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counted.join(idf, "term").select(ident, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, ident).select(ident, "term", (F.col("w") / F.col("norm")).alias("weight"))


def search(index: DataFrame, ident: str, query: list[str], limit: int) -> DataFrame:
    """(ident, score): the texts most alike to a bag of words, a top-k report."""
    hit = index.where(F.col("term").isin(query)).groupBy(ident).agg((F.sum("weight") / float(np.sqrt(len(set(query))))).alias("score"))
    return hit.orderBy(F.desc(F.round("score", 9)), ident).limit(limit)


def blend(a: DataFrame, b: DataFrame, keys: list[str], item: str, p: str, weight: float = 0.5, floor: float = 1e-6) -> DataFrame:
    """(keys, item, p): geometric mean of two distributions over the union of their items, made to sum to 1."""
    both = a.select(*keys, item, F.col(p).alias("pa")).join(b.select(*keys, item, F.col(p).alias("pb")), [*keys, item], "full_outer")
    raw = F.pow(F.greatest(F.coalesce("pa", F.lit(0.0)), F.lit(floor)), F.lit(1 - weight)) * F.pow(F.greatest(F.coalesce("pb", F.lit(0.0)), F.lit(floor)), F.lit(weight))
    told = both.withColumn("raw", raw)
    return told.withColumn(p, F.col("raw") / F.sum("raw").over(Window.partitionBy(*keys))).select(*keys, item, p)


# models


def archetypes(frame: DataFrame, ident: str, vector: str, k: int = 6, seed: int = 42) -> DataFrame:
    """(ident, cluster): k-means over the vectors."""
    data = frame.select(ident, array_to_vector(vector).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(ident, F.col("prediction").alias("cluster"))


def silhouette(frame: DataFrame, vector: str, cluster: str) -> float:
    """How well clusters are apart, from -1 to 1."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="p").evaluate(frame.select(array_to_vector(vector).alias("features"), F.col(cluster).cast("double").alias("p")))


def importances(frame: DataFrame, features: list[str], outcome: str, seed: int = 42) -> DataFrame:
    """(metric, importance): what a random forest uses to tell the outcome."""
    told = frame.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("a"), F.col(outcome).cast("double").alias("label"))
    # trees are drawn by partition and place: the same rows in the same places give the same trees
    data = told.repartition(8, "a", "label").sortWithinPartitions("a", "label").select(array_to_vector("a").alias("features"), "label")
    model = RandomForestRegressor(numTrees=40, seed=seed).fit(data)
    return frame.sparkSession.createDataFrame(list(zip(features, map(float, model.featureImportances.toArray()), strict=True)), "metric string, importance double")


def density_clusters(frame: DataFrame, ident: str, vector: str, least: float, neighbours_: int = 3) -> DataFrame:
    """(ident, cluster, role): clusters of vectors that have `neighbours_` others at least `least` alike, with those beside them; the rest is noise.

    Cores are joined to clusters by components over their links; a border vector goes to its most alike core's cluster. A cluster is named by its
    least core.
    """
    pairs = similar_pairs(frame.withColumn("_one", F.lit("x")), ident, vector, "_one", least, True)
    links = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")))
    cores = links.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours_).select(F.col("a").alias("node"))
    between = links.join(cores.withColumnRenamed("node", "a"), "a", "left_semi").join(cores.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    named = merge_components(between, cores)
    beside = links.join(cores.withColumnRenamed("node", "a"), "a", "left_anti").join(named.select(F.col("node").alias("b"), "component"), "b")
    border = beside.groupBy(F.col("a").alias("node")).agg(F.min_by("component", F.struct(-F.round("cosine", 9), F.col("b"))).alias("component"))
    told = named.withColumn("role", F.lit("core")).unionByName(border.withColumn("role", F.lit("border")))
    ids = frame.select(F.col(ident).cast("long").alias("node"))
    return ids.join(told, "node", "left").select(F.col("node").alias(ident), F.col("component").alias("cluster"), F.coalesce("role", F.lit("noise")).alias("role"))


def next_moves(steps: DataFrame, who: str, top: int = 3, weight: float = 0.5, floor: float = 1e-6) -> DataFrame:
    """(who, source, rank, target, p): what someone is likely to do next, own habits blended with everybody's over what either has done from there.

    Of the moves that someone has not made, all of which weigh by everybody's habits alone, only those come beside the own ones that can be among the `top`: of a source's moves
    the first by weight, as many as anybody's own there and `top` more, and what is as likely in nine digits. The sum over all others is the source's. Everything is by source, in one exchange.
    """
    own, place = Window.partitionBy("source", who), Window.partitionBy("source")
    counted = steps.select(who, "source", "target").repartition("source").groupBy("source", who, "target").agg(F.count("*").alias("n"))
    known = counted.withColumns({"own": F.col("n") / F.sum("n").over(own), "_k": F.count("*").over(own), "all": F.sum("n").over(Window.partitionBy("source", "target"))})
    known = known.withColumns({"most": F.max("_k").over(place) + top, "every": F.col("all") / F.sum("n").over(place)})
    mine = lambda p: F.pow(F.greatest(p, F.lit(floor)), F.lit(1 - weight))
    theirs = F.pow(F.greatest(F.col("every"), F.lit(floor)), F.lit(weight))
    other = float(floor ** (1 - weight))
    pooled = known.groupBy("source", "target").agg(F.first("most").alias("most"), F.first(theirs).alias("g"))
    placed = pooled.withColumns({"_place": F.row_number().over(place.orderBy(F.desc("g"), "target")), "_level": F.row_number().over(Window.partitionBy("source", "g").orderBy("target")), "_t": F.count("*").over(place), "_sum": F.sum("g").over(place)})
    edge = F.min(F.when(F.col("_place") <= F.col("most"), F.col("g"))).over(place)
    near = placed.withColumn("_edge", edge).where((F.col("_level") <= F.col("most")) & (F.col("g") >= F.col("_edge") - 2e-9 * (1 + floor * F.col("_t")) / other))
    lists = near.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-other * F.col("g")).alias("minus"), "target", F.col("_level").alias("level")))).alias("_lists"), (other * F.first("_sum")).alias("_rest"), (2e-9 * (1 + floor * F.first("_t"))).alias("_near"))
    did = known.groupBy("source", who).agg(F.collect_list(F.struct((mine(F.col("own")) * theirs).alias("raw"), "target")).alias("_did"), F.sum((mine(F.col("own")) - other) * theirs).alias("_more"))
    told = did.join(lists.hint("merge"), "source").withColumns({"_sum": F.col("_rest") + F.col("_more"), "_names": F.transform("_did", lambda x: x["target"]), "_many": F.size("_did") + top})
    # the list is cut once more for each, before anything is rounded
    told = told.withColumn("_edge", F.get("_lists", F.least("_many", F.size("_lists")) - 1)["minus"] + F.col("_near"))
    others = F.filter("_lists", lambda x: (x["minus"] <= F.col("_edge")) & (x["level"] <= F.col("_many")) & ~F.array_contains("_names", x["target"]))
    both = F.concat("_did", F.transform(others, lambda x: F.struct((-x["minus"]).alias("raw"), x["target"].alias("target"))))
    shares = F.transform(both, lambda x: F.struct((-F.round(x["raw"] / F.col("_sum"), 9)).alias("minus"), x["target"].alias("target"), (x["raw"] / F.col("_sum")).alias("p")))
    best = told.select(who, "source", F.posexplode(F.slice(F.array_sort(shares), 1, top)).alias("_at", "_x"))
    return best.select(who, "source", (F.col("_at") + 1).alias("rank"), F.col("_x.target").alias("target"), F.col("_x.p").alias("p"))


def class_shares(probabilities: DataFrame, index: DataFrame, frame: str, cls: str, p: str) -> DataFrame:
    """(frame, node, p): a classifier's probabilities added up by the node that each class means (index: class, node), as shares; classes of no node are left out."""
    told = probabilities.join(index.select(F.col("class").alias(cls), "node"), cls).groupBy(frame, "node").agg(F.sum(p).alias("p"))
    return told.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(frame)))


def reranked(shares: DataFrame, prior: DataFrame, frame: str, given: str, alpha: float = 0.3, floor: float = 1e-3) -> DataFrame:
    """(frame, node, p, prior, score, place): shares (frame, given, node, p) weighed by what usually follows `given` (prior: given, node, p).

    The score is p^(1 - alpha) x prior^alpha, as a share of the frame; a node that never followed has `floor`.
    """
    told = shares.join(prior.select(given, "node", F.col("p").alias("prior")), [given, "node"], "left").withColumn("prior", F.coalesce("prior", F.lit(floor)))
    w = Window.partitionBy(frame)
    told = told.withColumn("score", F.pow("p", F.lit(1 - alpha)) * F.pow("prior", F.lit(alpha))).withColumn("score", F.col("score") / F.sum("score").over(w))
    return told.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "node")))


def signature(vector: Column, names: tuple[str, ...], most: int = 2, least: float = 1e-3) -> Column:
    """The names of a vector's largest numbers above `least`, `most` at most, the largest first."""
    pairs = F.transform(vector, lambda x, i: F.struct((-x).alias("minus"), i.alias("i")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda p: p["minus"] < -least)), 1, most)
    return F.transform(top, lambda p: F.get(F.array(*map(F.lit, names)), p["i"]))


def archetype_names(centres: DataFrame, centre: str, shares: str, deviance: str, names: tuple[str, ...]) -> DataFrame:
    """(centre, name): a cluster by what it does more than others, else by what it does most; equal names are told apart by the latter, then numbered."""
    top, most = signature(F.col(deviance), names), signature(F.col(shares), names, 1, 0.0)
    based = F.when(F.size(most) > 0, F.concat(F.initcap(F.get(most, F.lit(0))), F.lit("-Based"))).otherwise("Balanced")
    plain = F.when(F.size(top) > 0, F.concat(F.array_join(F.transform(top, lambda t: F.initcap(t)), " / "), F.lit(" Specialist"))).otherwise(based)
    told = centres.select(centre, plain.alias("_plain"), based.alias("_based"))
    alike = F.count("*").over(Window.partitionBy("_plain")) > 1
    told = told.withColumn("_name", F.when(alike, F.concat("_plain", F.lit(" · "), F.when(F.col("_based") == "Balanced", "Balanced-Based").otherwise(F.col("_based")))).otherwise(F.col("_plain")))
    number = F.row_number().over(Window.partitionBy("_name").orderBy(centre))
    return told.withColumn("_n", number).select(centre, F.when(F.col("_n") > 1, F.concat("_name", F.lit(" "), F.col("_n").cast("string"))).otherwise(F.col("_name")).alias("name"))


def compared(frame: DataFrame, ident: str, own: str, other: str, names: tuple[str, ...], near: float = 0.05, far: float = 0.10, used: float = 0.12) -> DataFrame:
    """(ident, aspect, verdict, delta, place): in which shares two vectors are alike (both used) and in which they differ; the largest differences first."""
    gaps = frame.select(ident, F.posexplode(F.arrays_zip(F.col(own).alias("a"), F.col(other).alias("b"))).alias("i", "z")).select(ident, F.get(F.array(*map(F.lit, names)), F.col("i")).alias("aspect"), (F.col("z.a") - F.col("z.b")).alias("delta"), F.greatest("z.a", "z.b").alias("_use"))
    verdict = F.when(F.abs("delta") >= far, F.when(F.col("delta") > 0, "more").otherwise("less")).when((F.abs("delta") < near) & (F.col("_use") > used), "alike")
    told = gaps.withColumn("verdict", verdict).where("verdict IS NOT NULL")
    return told.select(ident, "aspect", "verdict", "delta", F.row_number().over(Window.partitionBy(ident).orderBy(F.desc(F.abs("delta")), "aspect")).alias("place"))


def pooled_mix(neighbours: DataFrame, mixes: DataFrame, ident: str, neighbour: str, weight: str, items: tuple[str, ...]) -> DataFrame:
    """(ident, items ..., leading): the mixes of someone's neighbours (mixes: neighbour, items ...) pooled by likeness, and the item that leads; ties in the order of `items`."""
    told = neighbours.join(mixes, neighbour).groupBy(ident).agg(*[F.try_divide(F.sum(F.col(weight) * F.col(i)), F.sum(weight)).alias(i) for i in items])
    best = F.greatest(*items)
    return told.withColumn("leading", F.coalesce(*[F.when(F.col(i) == best, F.lit(i)) for i in items]))
