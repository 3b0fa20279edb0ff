"""Problem 7: frequent subsequences, by a finite-state transducer, weighted automata and pivot items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns that a task counts before it sends its sums on.
HELD = 1_000_000


#: Places of a sequence from which on those that no pattern needs are left out first.
LONG = 512


class Transducer:
    """The constraints of the patterns: `steps` different items in order, at most `gap` other events between two steps.

    `ranks` says how frequent an item is (0 the most); `follow` holds the allowed steps (item, next item) as sorted numbers, None allows all.
    A run over a sequence gives the graph of its candidate outputs: an edge for each allowed step between two places.
    """

    def __init__(self, steps: int, gap: int | None, items: int, follow: np.ndarray | None):
        self.steps, self.gap, self.items, self.follow = steps, gap, max(1, items), follow

    def edges(self, sequence: np.ndarray) -> np.ndarray:
        """A matrix of the steps that the constraints allow between the places of a sequence."""
        n = len(sequence)
        real = sequence < self.items  # the number of the items itself is a place without one
        ok = np.triu(np.ones((n, n), bool), 1) & (sequence[:, None] != sequence[None, :]) & real[:, None] & real[None, :]
        if self.gap is not None:
            ok &= ~np.triu(np.ones((n, n), bool), self.gap + 2)
        if self.follow is not None and n:
            steps = sequence[:, None].astype("int64") * self.items + sequence[None, :]
            at = np.minimum(np.searchsorted(self.follow, steps), max(0, len(self.follow) - 1))
            ok &= (self.follow[at] == steps) if len(self.follow) else False
        return ok

    def shortened(self, sequence: np.ndarray) -> np.ndarray:
        """A long sequence less the places that no pattern needs; without gaps to count the same patterns occur in both.

        A pattern occurs if each step but the last stands at its first place after the step before, and the last step at its item's last place: so those places
        suffice, of which there are at most (items)^(steps - 1) and a few, whatever the length.
        """
        if self.gap is not None or len(sequence) <= LONG:
            return sequence
        order = np.argsort(sequence, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(sequence[order]) != 0, True])
        places = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kept = front = np.unique([p[0] for p in places])
        for _ in range(self.steps - 2):
            after = [p[at[at < len(p)]] for p in places for at in [np.searchsorted(p, front, side="right")]]
            front = np.unique(np.concatenate(after))
            kept = np.union1d(kept, front)
        return sequence[np.union1d(kept, [p[-1] for p in places])]

    def automata(self, sequence: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(pivot, automaton) for each item that can be the rarest of a candidate output.

        The automaton of a pivot holds the places of items no rarer than it that lie on an accepted path of `steps` steps
        through it. Its states are these places; places of one item with the same steps ahead are one state, so that sequences with
        the same outputs give the same bytes and are counted together.
        """
        sequence = self.shortened(sequence)
        full = self.edges(sequence)
        if not full.any():
            return
        for pivot in np.unique(sequence[sequence < self.items]):
            keep = np.flatnonzero(sequence <= pivot)
            s, ok = sequence[keep], full[np.ix_(keep, keep)]
            # places on a path of `steps` places, with the pivot at one of them: by the places before and after
            live = np.zeros((self.steps, len(s)), bool)
            ahead = [np.ones(len(s), bool)]
            behind = [np.ones(len(s), bool)]
            for _ in range(self.steps - 1):
                ahead.append((ok & ahead[-1][None, :]).any(1))
                behind.append((ok & behind[-1][:, None]).any(0))
            hit = s == pivot
            for at in range(self.steps):
                # paths whose place `at` is the pivot
                now = hit & behind[at] & ahead[self.steps - 1 - at]
                forward = backward = now
                live[at] |= now
                for k in range(at + 1, self.steps):
                    forward = (ok & forward[:, None]).any(0) & ahead[self.steps - 1 - k]
                    live[k] |= forward
                for k in range(at - 1, -1, -1):
                    backward = (ok & backward[None, :]).any(1) & behind[k]
                    live[k] |= backward
            places = np.flatnonzero(live.any(0))
            if len(places) < self.steps:
                continue
            s, ok = s[places], ok[np.ix_(places, places)]
            # from the end: states of one item and one set of steps ahead are merged
            state, states, known = np.zeros(len(s), int), [], {}
            for i in range(len(s) - 1, -1, -1):
                key = (int(s[i]), tuple(sorted({int(state[j]) for j in np.flatnonzero(ok[i])})))
                if key not in known:
                    known[key] = len(states)
                    states.append(key)
                state[i] = known[key]
            flat = [x for item, nexts in states for x in (item, len(nexts), *nexts)]
            yield int(pivot), np.array(flat, "<i4").tobytes()

    def outputs(self, pivot: int, automaton: bytes) -> set[tuple[int, ...]]:
        """The different patterns with the pivot that an automaton accepts."""
        flat, states, at = np.frombuffer(automaton, "<i4").tolist(), [], 0
        while at < len(flat):
            states.append((flat[at], flat[at + 2 : at + 2 + flat[at + 1]]))
            at += 2 + flat[at + 1]
        # patterns of each length that begin at a state
        ends: list[list[set[tuple[int, ...]]]] = []
        for item, nexts in states:
            own: list[set[tuple[int, ...]]] = [set(), {(item,)}]
            for k in range(2, self.steps + 1):
                own.append({(item, *rest) for n in nexts for rest in ends[n][k - 1] if item not in rest})
            ends.append(own)
        return {p for own in ends for p in own[self.steps] if pivot in p}


def _pairs(ranks: np.ndarray, gap: int | None):
    """Ordered pairs of different frequent items, once per sequence, added up in the task; of very long sequences an upper bound."""
    items = int((ranks >= 0).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, "int64"), np.empty(0, "int64")
        for batch in batches:
            flat, sizes = _ranked(batch.column(0), ranks, gap)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for size in np.unique(sizes[sizes > 1]):
                chosen = starts[sizes == size]
                upper = np.triu_indices(size, 1) if size <= 1500 else None
                for x, y in [upper] if upper else ((np.full(size - a - 1, a), np.arange(a + 1, size)) for a in range(size - 1)):
                    if gap is not None:
                        near = y - x <= gap + 1
                        x, y = x[near], y[near]
                    step = max(1, 2_000_000 // max(1, len(x)))
                    for at in range(0, len(chosen) if len(x) else 0, step):
                        rows = flat[chosen[at : at + step, None] + np.arange(size)]
                        a, b = rows[:, x], rows[:, y]
                        codes = np.sort(np.where((a == b) | (a == items) | (b == items), -1, a * items + b), 1)
                        once = codes[(codes >= 0) & np.c_[np.ones(len(codes), bool), codes[:, 1:] != codes[:, :-1]]]
                        new, n = np.unique(once, return_counts=True)
                        held, inverse = np.unique(np.r_[held, new], return_inverse=True)
                        counts = np.bincount(inverse, np.r_[counts, n], len(held)).astype("int64")
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "n"])

    return run


def _ranked(lists: pa.ListArray, ranks: np.ndarray, gap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ranks, one after another, and their sizes: rare items left out, or blank where gaps are counted."""
    flat, sizes = ranks[np.asarray(lists.flatten())].astype("int64"), np.diff(np.asarray(lists.offsets))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if gap is not None:
        return np.where(flat < 0, int((ranks >= 0).sum()), flat), sizes
    flat, owner = flat[flat >= 0], owner[flat >= 0]
    # without gaps to count, an item repeated at once adds nothing
    keep = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])] if len(flat) else np.ones(0, bool)
    return flat[keep], np.bincount(owner[keep], minlength=len(sizes))


def _reduced(ranks: np.ndarray, gap: int | None):
    """Sequences of the ranks of the items that are left, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _ranked(batch.column(0), ranks, gap)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.array(flat.astype("int32")))
            yield pa.RecordBatch.from_arrays([lists.filter(pa.array(sizes > 1))], ["items"])

    return run


def _transduce(machine: Transducer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, a, n) for items, n in zip(batch.column("items").to_pylist(), batch.column("n").to_pylist(), strict=True) for p, a in machine.automata(np.array(items))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], ["pivot", "automaton", "n"])

    return run


def _mine(machine: Transducer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, ...], int] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.list_(pa.int32())), pa.array(list(sums.values()), pa.int64())], ["pattern", "n"])

        for batch in batches:
            for pivot, automaton, n in zip(*(batch.column(c).to_pylist() for c in ("pivot", "automaton", "n")), strict=True):
                for pattern in machine.outputs(pivot, automaton):
                    sums[pattern] = sums.get(pattern, 0) + n
            if len(sums) > HELD:
                yield sent()
                sums.clear()
        yield sent()

    return run


def frequent(sequences: DataFrame, items: int, steps: int = 3, least: int = 5, least_share: float = 0.01, gap: int | None = None) -> DataFrame:
    """Ordered patterns of `steps` different items in many sequences: (pattern array<int>, support, sequences).

    `sequences` has one row per sequence with `codes`, an array of item codes from 0 to `items` - 1 in order. A pattern counts once per
    sequence; `gap` bounds the other events between two steps (None: any number). Patterns in at least `least` sequences and at least `least_share`
    of all come out.

    Items, then ordered pairs, below the support are in no such pattern and are left out first, without loss. The constraints are compiled
    into a transducer; each different sequence, with the number of its copies, becomes one minimised automaton per pivot (the rarest
    item of an output); equal automata are added up, spread by pivot and automaton so that no pivot is one task's alone, and
    the weighted automata are mined where they lie. What reaches the driver are the frequent items and pairs: the items number at most (mean length) / `least_share`.

    Cases: null codes and empty sequences are left out (the latter do not count as sequences); ties and repeated rows count each; no sequence gives no row.
    """
    kept = sequences.select(F.filter("codes", lambda c: c.isNotNull()).alias("codes")).where("size(codes) > 0")
    total = kept.count()
    support = max(1, least, int(np.ceil(round(least_share * total, 6))))
    singles = kept.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").count().where(F.col("count") >= support).collect()
    ranks = np.full(max(1, items), -1)
    for rank, row in enumerate(sorted(singles, key=lambda r: (-r["count"], r["code"]))):
        ranks[row["code"]] = rank
    n = len(singles)
    follow = None
    if steps > 1:
        pairs = kept.mapInArrow(_pairs(ranks, gap), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
        follow = np.sort(np.array([r["pair"] for r in pairs.collect()], "int64"))
        used = np.unique(np.r_[follow // max(1, n), follow % max(1, n)])
    names = {rank: code for code, rank in enumerate(ranks) if rank >= 0}
    if steps > 1 and gap is None:  # items of no frequent pair go too
        ranks = np.where(np.isin(ranks, used), ranks, -1)
        compact = np.full(n + 1, -1)
        compact[used] = np.arange(len(used))
        names = {i: names[r] for i, r in enumerate(used)}
        follow = np.sort(compact[follow // max(1, n)] * len(used) + compact[follow % max(1, n)])
        ranks, n = np.where(ranks >= 0, compact[ranks], -1), len(used)
    machine = Transducer(steps, gap, n, follow)
    reduced = kept.mapInArrow(_reduced(ranks, gap), "items array<int>").where(F.size(F.array_distinct("items")) >= steps)
    # few bytes but much work: as many tasks as the session's shuffles have, whatever the bytes
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighted = reduced.groupBy("items").agg(F.count("*").alias("n")).repartition(tasks)
    automata = weighted.mapInArrow(_transduce(machine), "pivot int, automaton binary, n long").groupBy("pivot", "automaton").agg(F.sum("n").alias("n"))
    mined = automata.mapInArrow(_mine(machine), "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("support")).where(F.col("support") >= support)
    back = F.array(*[F.lit(int(names[i])) for i in range(n)]) if n else F.array().cast("array<int>")
    return mined.select(F.transform("pattern", lambda r: F.get(back, r)).alias("pattern"), "support", F.lit(total).cast("long").alias("sequences"))
