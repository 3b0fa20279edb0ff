"""Problem 2: items that appear together, by stripes and a log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kumikata.plans.runtime import cut

#: Entries of the stripes that a task keeps before it sends them on.
HELD = 2_000_000


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From baskets of sorted item numbers: per item the neighbours above it with their counts, added up in the task."""
    held: np.ndarray | None = None
    counts: np.ndarray | None = None

    def sent() -> Iterator[pa.RecordBatch]:
        if held is not None and len(held):
            a, b = held >> 32, held & 0xFFFFFFFF
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            offsets = pa.array(np.r_[starts, len(a)].astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(counts))], ["item", "others", "counts"])

    def merged(keys: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unique, inverse = np.unique(keys, return_inverse=True)
        return unique, np.bincount(inverse, ns, len(unique)).astype("int64")

    for batch in batches:
        lists = batch.column(0)
        items, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        sizes = np.diff(offsets)
        for size in np.unique(sizes[sizes > 1]):
            rows = items[offsets[:-1][sizes == size][:, None] + np.arange(size)]
            # baskets of one size at once, in blocks whose pairs fit into the bound
            upper = np.triu_indices(size, 1) if size <= 2000 else None
            step = max(1, HELD // (size * (size - 1) // 2))
            for i in range(0, len(rows), step):
                block = rows[i : i + step]
                firsts = [(block[:, upper[0]], block[:, upper[1]])] if upper else ((np.repeat(block[:, [j]], size - j - 1, 1), block[:, j + 1 :]) for j in range(size - 1))
                for a, b in firsts:
                    new, ns = merged(((a.astype("int64") << 32) | b).ravel(), np.ones(a.size))
                    held, counts = (new, ns) if held is None else merged(np.r_[held, new], np.r_[counts, ns])
                    if len(held) > HELD:
                        yield from sent()
                        held = counts = None
    yield from sent()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the same items merged by key in the task: (item_a, item_b, both); sums go on when they grow beyond HELD."""
    held, counts = np.empty(0, "int64"), np.empty(0, "int64")

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held >> 32), pa.array(held & 0xFFFFFFFF), pa.array(counts)], ["item_a", "item_b", "both"])

    for batch in batches:
        others = batch.column("others")
        sizes = np.diff(np.asarray(others.offsets))
        keys = np.r_[held, (np.repeat(np.asarray(batch.column("item")), sizes) << 32) | np.asarray(others.flatten())]
        held, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, np.r_[counts, np.asarray(batch.column("counts").flatten())], len(held)).astype("int64")
        if len(held) > HELD:
            yield sent()
            held, counts = np.empty(0, "int64"), np.empty(0, "int64")
    if len(held):
        yield sent()


def log_likelihood(both: Column, a: Column, b: Column, total: Column) -> Column:
    """Dunning's G2 of the 2 x 2 table of two items over all baskets."""

    def part(observed: Column, row: Column, column: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed * total / (row * column))).otherwise(0.0)

    return 2 * (part(both, a, b) + part(a - both, a, total - b) + part(b - both, total - a, b) + part(total - a - b + both, total - a, total - b))


def together(memberships: DataFrame, basket: str, item: str, least: int = 2, least_share: float = 0.0) -> DataFrame:
    """Pairs of items by the number of baskets that hold both.

    Columns: item_a, item_b (item_a < item_b by code point), both, count_a, count_b, baskets, lift (both over what independence
    gives) and llr (Dunning's log-likelihood ratio). Only pairs in at least `least` baskets and at least `least_share` of all baskets.

    An item below that support can be in no such pair and is left out first, without loss: what remains of the largest basket is bounded
    by the frequent items, of which there are at most (mean basket) / `least_share`. Each task adds up the stripes of its baskets,
    so that an item in a third of all baskets still sends one stripe a task; stripes meet by item and are merged there.

    Cases: a null basket or item belongs to nothing, though a basket that holds null items only counts among all baskets; repeated
    memberships count once; one item in a basket makes no pair; an empty table gives no row; extra columns are ignored.
    """
    rows = memberships.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    kept = cut(rows)
    baskets = kept.select("basket").distinct().count()
    support = max(least, int(np.ceil(round(least_share * baskets, 6))), 1)
    ids = numbered(kept.where("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support))  # consecutive, so that a pair fits into 64 bits
    numbers = kept.where("item IS NOT NULL").join(ids.select("item", "number"), "item")
    lists = numbers.groupBy("basket").agg(F.array_sort(F.collect_list("number")).alias("items")).where("size(items) > 1").select("items")
    stripes = lists.mapInArrow(_stripes, "item long, others array<long>, counts array<long>")
    merged = stripes.repartition("item").mapInArrow(_sums, "item_a long, item_b long, both long")
    pairs = merged.groupBy("item_a", "item_b").agg(F.sum("both").alias("both")).where(F.col("both") >= support)
    a = ids.select(F.col("number").alias("item_a"), F.col("item").alias("name_a"), F.col("n").alias("n_a"))
    b = ids.select(F.col("number").alias("item_b"), F.col("item").alias("name_b"), F.col("n").alias("n_b"))
    named = pairs.join(a, "item_a").join(b, "item_b")
    first = F.col("name_a") < F.col("name_b")
    out = named.select(
        F.least("name_a", "name_b").alias("item_a"), F.greatest("name_a", "name_b").alias("item_b"), "both",
        F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("count_a"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("count_b"), F.lit(baskets).cast("long").alias("baskets"),
    )
    d = lambda c: F.col(c).cast("double")
    return out.withColumn("lift", d("both") * d("baskets") / (d("count_a") * d("count_b"))).withColumn("llr", log_likelihood(d("both"), d("count_a"), d("count_b"), d("baskets")))


def numbered(items: DataFrame) -> DataFrame:
    """The rows with consecutive numbers below 2^31 in `number`; only partition counts come to the driver.

    Sorted items are numbered in their order.
    """
    items = cut(items)
    parts = items.withColumn("part", F.spark_partition_id())
    sizes = {r[0]: r[1] for r in parts.groupBy("part").count().collect()}
    start, starts = 0, {}
    for part in sorted(sizes):
        starts[part], start = start, start + sizes[part]
    if not starts:
        return items.withColumn("number", F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for part in starts.items() for x in part]), F.spark_partition_id())
    # monotonically_increasing_id is the partition's number and the row's place in it
    return cut(items.withColumn("number", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + offset))
