"""The ten operators against brute force, and their border cases."""

from __future__ import annotations

import datetime
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kumikata.llm import lookalike, names
from kumikata.llm.bouts import ordered
from kumikata.llm.components import components
from kumikata.llm.labels import canonical
from kumikata.llm.mixing import mixed
from kumikata.llm.packing import packed, plan
from kumikata.llm.runs import runs
from kumikata.llm.sequences import frequent
from kumikata.llm.springs import ranked, strengths
from kumikata.llm.stripes import together
from kumikata.llm.survivors import survivors

LIBRARY = "node_key string, label string, aliases array<string>"
TECHNIQUES = [
    ("standing walnut tilt", "Standing Walnut Tilt", ["Virada Noz em Pé", "SWT"]), ("reverse hornet mount", "Reverse Hornet Mount", None), ("double hornet hip slide", "x", []),
    ("kneeling quarry side pin", "x", []), ("standing quarry choke", "x", []), ("thunder throw", "x", []), ("reverse tundra throw", "x", []), ("standing thunder choke", "x", []), ("walnut choke", "x", []),
]


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame(TECHNIQUES, LIBRARY)


# 1

RECORDS = "g string, id long, trust int, at timestamp, a string, b string, size int"


def _survivors(spark, rows):
    frame = spark.createDataFrame(rows, RECORDS)
    return {r["group"]: r for r in survivors(frame, "g", "id", F.col("trust"), "at", {"a": F.col("a").isNotNull(), "b": F.col("b") != ""}).collect()}


def test_survivors_match_the_policy_by_brute_force(spark):
    rng = random.Random(3)
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    rows = [(f"g{rng.randrange(12)}", i, rng.choice([1, 2, 3, None]), rng.choice([None, day(rng.randrange(4))]), rng.choice([None, "x"]), rng.choice([None, "", "y"]), 7) for i in range(200)]
    got = _survivors(spark, rows)
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[2] or 99, -(r[3] or datetime.datetime(1, 1, 1)).toordinal(), -((r[4] is not None) + bool(r[5])), r[1]))
        assert got[group]["size"] == len(own) and got[group]["first_id"] == min(r[1] for r in own)
        assert got[group]["a_id"] == next((r[1] for r in own if r[4] is not None), None)
        assert got[group]["b_id"] == next((r[1] for r in own if r[5]), None)
        assert got[group]["layers"] >= 1


def test_survivors_of_nothing_and_of_null_groups(spark):
    assert _survivors(spark, []) == {}
    assert _survivors(spark, [(None, 1, 1, None, "x", "y", 1)]) == {}
    only = _survivors(spark, [("g", 5, None, None, None, None, 1), ("g", 4, None, None, None, None, 1)])["g"]
    assert (only["size"], only["first_id"], only["a_id"], only["b_id"]) == (2, 4, None, None)


# 2


def test_together_counts_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"b{rng.randrange(60)}", f"i{int(rng.random() ** 2 * 15)}", "x") for _ in range(700)] + [("b1", None, "x"), (None, "i1", "x"), ("empty", None, "x"), ("one", "i3", "x")] * 2
    got = {(r.item_a, r.item_b): (r.both, r.count_a, r.count_b, r.baskets) for r in together(spark.createDataFrame(rows, "basket string, item string, both string"), "basket", "item", 3).collect()}
    baskets = {b: {i for x, i, _ in rows if x == b and i} for b, _, _ in rows if b}
    single = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    assert got == {p: (n, single[p[0]], single[p[1]], len(baskets)) for p, n in pairs.items() if n >= 3}


def test_together_lift_and_likelihood(spark):
    rows = [(str(b), i) for b in range(20) for i in (["a", "b"] if b < 5 else ["c"])]
    one = together(spark.createDataFrame(rows, "basket string, item string"), "basket", "item").collect()[0]
    assert one["lift"] == pytest.approx(4.0)
    assert one["llr"] == pytest.approx(2 * (5 * np.log(4) + 15 * np.log(20 / 15)))
    assert together(spark.createDataFrame([], "basket string, item string"), "basket", "item").count() == 0


# 3


@pytest.mark.parametrize(
    ("label", "key"),
    [
        ("Standing Walnut Tilt", "standing walnut tilt"), ("standingwalnuttilt", "standing walnut tilt"), ("  STANDING_walnut-TILT!", "standing walnut tilt"), ("Stan. Walnut Tilt", "standing walnut tilt"),
        ("Walnut Tilt Standing", "standing walnut tilt"), ("Tilt Walnut Standing", "standing walnut tilt"), ("virada noz em pe", "standing walnut tilt"), ("S.W.T.", "standing walnut tilt"),
        ("Standing Walnut Tilt (try)", "standing walnut tilt"), ("Standing Walnut Tilt - left side", "standing walnut tilt"), ("Standing Walnut Tilt x2", "standing walnut tilt"), ("Standing Walnut Tilt attempt", "standing walnut tilt"),
        ("Sranding Walnnt Tlit", "standing walnut tilt"), ("double hornet hip side", "double hornet hip slide"), ("Kneeling Quarry Side Pin.", "kneeling quarry side pin"),
        ("Reverse Thunder Throw", None), ("Reverse Thnder Throw", None), ("walnut", None), ("walnut hornet combo", None), ("SJS", None), ("", None), ("!!!", None), ("walnut " * 3000, None),
    ],
)
def test_labels(spark, library, label, key):
    frame = spark.createDataFrame([(label, "x"), (label, "y"), (None, "z")], "label string, node_key string")
    assert [tuple(r) for r in canonical(frame, library).collect()] == [(label, key)]


def test_labels_without_library_or_labels(spark, library):
    empty = spark.createDataFrame([], LIBRARY)
    frame = spark.createDataFrame([("a b c d e f",), (None,)], "label string")
    assert [r.node_key for r in canonical(frame, empty).collect()] == [None]
    assert canonical(frame.limit(0), library).count() == 0


def test_labels_find_all_that_brute_force_finds(spark, library):
    """Every typed label within the tolerance of one entry alone, edited at random, comes back to it."""
    rng = random.Random(5)
    keys = [t[0] for t in TECHNIQUES]
    typed = {}
    for _ in range(150):
        key = rng.choice(keys)
        text = key
        for _ in range(rng.choice([1, 2])):
            i = rng.randrange(len(text))
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("qzvk") + text[i + 1 :], text[:i] + text[i] + text[i:], text[:i] + text[i : i + 2][::-1] + text[i + 2 :]])
        typed[text] = key
    got = {r.label: r.node_key for r in canonical(spark.createDataFrame([(t,) for t in typed], "label string"), library).collect()}
    wrong = [t for t, k in typed.items() if got[t] not in (k, None)]
    assert not wrong
    assert sum(got[t] == k for t, k in typed.items()) >= 0.95 * len(typed)


# 4

EVENTS = "event_id long, match_id string, idx int, label string, actor string, ts double, side string, events int"


def _event(i, match, idx, label, actor, ts):
    return (i, match, idx, label, actor, ts, "clash", 0)


def _runs_by_hand(rows, gap=30.0):
    out = []
    by = {}
    for r in sorted(rows):
        by.setdefault(r[1], {}).setdefault(r[2], r)
    for match, events in by.items():
        run = []
        for idx in [*sorted(events), None]:
            e = events.get(idx)
            key = e and e[3] is not None and e[4] is not None and (e[3].lower().replace(" ", ""), e[4].lower())
            last = run and run[-1]
            if run and e and key and key == run_key and not (last[5] is not None and e[5] is not None and e[5] - last[5] > gap):  # noqa: F821
                run.append(e)
                continue
            if len(run) > 1:
                out.append((match, run[0][2], run[-1][2], len(run)))
            run, run_key = ([e], key) if e and key else ([], None)
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, 1024])
def test_runs_are_those_of_brute_force(spark, library, chunk, monkeypatch):
    monkeypatch.setattr("kumikata.llm.bouts.CHUNK", chunk)
    rng = random.Random(9)
    rows, i = [], 0
    for match in ("m1", "m2", "m3", "hot"):
        ts = 0.0
        for idx in range(60 if match == "hot" else 14):
            ts += rng.choice([1, 5, 40])
            i += 1
            rows.append(_event(i, match, idx * rng.choice([1, 1]), rng.choice(["Standing Walnut Tilt", "standing walnuttilt", "Reverse Hornet Mount", None]), rng.choice(["Ana Souza", "ana souza", "ANA SOUZA", "Rita Lopes", None]), rng.choice([ts, ts, None])))
    rows += [(10_000 + r[0], *r[1:]) for r in rows[::7]]
    rng.shuffle(rows)
    frame = spark.createDataFrame([*rows, _event(99, None, 1, "x", "y", 0.0), _event(98, "m1", None, "x", "y", 0.0)], EVENTS)
    bouts, _ = ordered(frame, library, library_only=False)
    got = sorted((r.match_id, r.first_idx, r.last_idx, r["count"]) for r in runs(bouts).collect())
    assert got == _runs_by_hand(rows)


def test_runs_know_an_athlete_by_many_names(spark, library):
    rows = [_event(i, "m", i, "Standing Walnut Tilt", a, float(i)) for i, a in enumerate(["Alexandra Souza", "A. Souza", "Souza, Alexandra", "Lexi Souza", "Alexandra Sousa"])]
    bouts, _ = ordered(spark.createDataFrame(rows, EVENTS), library, library_only=False)
    assert [(r.first_idx, r.last_idx, r["count"], r.duration) for r in runs(bouts).collect()] == [(0, 4, 5, 4.0)]
    bouts, _ = ordered(spark.createDataFrame([], EVENTS), library, library_only=False)
    assert runs(bouts).count() == 0


# 5


def test_springs_solve_the_system(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{a}", f"p{b}", bool(d), 1) for a, b, d in zip(rng.integers(0, 25, 300), rng.integers(0, 25, 300), rng.random(300) < 0.1, strict=True)] + [("solo", "duo", False, 1), (None, "p1", False, 1), ("p1", "p1", False, 1)]
    got = {r.item: r.strength for r in strengths(spark.createDataFrame(rows, "winner string, loser string, draw boolean, item int"), tie="draw", ridge=2.0).collect()}
    used = [r for r in rows if r[0] and r[0] != r[1]]
    items = sorted({x for r in used for x in r[:2]})
    at = {x: i for i, x in enumerate(items)}
    matrix, right = 2.0 * np.eye(len(items)), np.zeros(len(items))
    for a, b, draw, _ in used:
        i, j = at[a], at[b]
        matrix[i, i] += 1
        matrix[j, j] += 1
        matrix[i, j] -= 1
        matrix[j, i] -= 1
        right[i] += not draw
        right[j] -= not draw
    want = np.linalg.solve(matrix, right)
    assert set(got) == set(items)
    assert np.allclose([got[x] for x in items], want, atol=1e-5)


def test_ranking_order_ties_and_nothing(spark):
    frame = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 5.0)], "item string, strength double")
    assert [(r.rank, r.item) for r in ranked(frame).orderBy("rank").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    assert ranked(frame.limit(0)).count() == 0
    assert strengths(spark.createDataFrame([], "winner string, loser string")).count() == 0


# 6

SAME = [
    ["Alexandra Nepafefi Le Goniromo", "Alexandra N. Le Goniromo", "Lexi Le Goniromo", "A. Le Goniromo", "Goniromo, Alexandra", "ALEXANDRA GONIROMO", "alexandra gnoiromo", 'Alexandra "Biscuit" Le Goniromo', "Alexandra Goniromo", "Goniromo Alexandra"],
    ["Rosângela Dusapimi", "RosÃ¢ngela Dusapimi", "rosangela dsapimi", "R. Dusapimi"],
    ["Marjorie Dusapimi", "Marge Dusapimi"],
    ["Xênia Goniromo", "Xenia Goniromo"],
    ["S. Lobomese"], ["Simone Lobomese"], ["Sofia Lobomese"],
    ["Plato"], [""], ["!!"],
]


def test_names(spark):
    rows = [(n, "x") for group in SAME for n in group] * 2 + [(None, "x")]
    found = names.link(spark.createDataFrame(rows, "name string, person string")).collect()
    assert len(found) == sum(map(len, SAME))
    groups = {}
    for r in found:
        groups.setdefault(r.person, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, SAME))
    assert names.link(spark.createDataFrame([], "name string")).count() == 0


def test_two_slips_meet_where_few_people_are_in_question(spark, library):
    rows = [_event(i, "m", i, "Standing Walnut Tilt", a, float(i)) for i, a in enumerate(["Kirsten Mirepro", "Kiki Mriepuro", "Bronwen Belipura", "Bronwen Belipura"])]
    bouts, _ = ordered(spark.createDataFrame(rows, EVENTS), library, library_only=False)
    assert sorted((r.first_idx, r.last_idx) for r in runs(bouts).collect()) == [(0, 1), (2, 3)]
    two = spark.createDataFrame([("t", "Kirsten Mirepro"), ("t", "Kirsten Mriepuro")], "team string, name string")
    assert [names.link(two, "name", "team", most=k).select("person").distinct().count() for k in (1, 2)] == [2, 1]


def test_names_within_a_scope(spark):
    rows = [("t1", "Simone Lobomese"), ("t1", "S. Lobomese"), ("t2", "Sofia Lobomese"), ("t2", "S. Lobomese"), (None, "S. Lobomese")]
    found = {(r.team, r.name): r.person for r in names.link(spark.createDataFrame(rows, "team string, name string"), "name", "team").withColumnRenamed("scope", "team").collect()}
    assert found == {("t1", "Simone Lobomese"): "S. Lobomese", ("t1", "S. Lobomese"): "S. Lobomese", ("t2", "Sofia Lobomese"): "S. Lobomese", ("t2", "S. Lobomese"): "S. Lobomese", ("", "S. Lobomese"): "S. Lobomese"}


@pytest.mark.parametrize(("a", "b", "value"), [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("abc", "xyz", 0.0), ("", "", 1.0)])
def test_jaro_winkler(a, b, value):
    assert names.jaro_winkler(a, b) == pytest.approx(value, abs=1e-4)


def test_components_of_chains_and_loops(spark):
    rng = random.Random(4)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(25)] + [("x", None), ("x", "x")]
    nodes = sorted({n for p in pairs for n in p if n} | {"lonely"})
    got = {r.node: r.component for r in components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(pairs, "a string, b string")).collect()}
    leader = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a and b:
                leader[a] = leader[b] = min(leader[a], leader[b])
    assert got == leader


# 7


@pytest.mark.parametrize("gap", [None, 1])
def test_sequences_are_those_of_brute_force(spark, gap):
    rng = np.random.default_rng(1)
    rows = [list(map(int, rng.zipf(1.6, rng.integers(1, 12)) % 9)) for _ in range(300)] + [[], [1, 2, 3] * 4, [None, 1, None, 2, 3]]
    got = {tuple(r.pattern): r.support for r in frequent(spark.createDataFrame([(r, 1) for r in rows], "codes array<int>, support int"), 9, least_share=0.03, gap=gap).collect()}
    want = Counter()
    for row in rows:
        row = [x for x in row if x is not None]
        want.update({(row[i], row[j], row[k]) for i, j, k in itertools.combinations(range(len(row)), 3) if len({row[i], row[j], row[k]}) == 3 and (gap is None or (j - i <= gap + 1 and k - j <= gap + 1))})
    least = max(5, 0.03 * (len(rows) - 1))
    assert got == {p: n for p, n in want.items() if n >= least}


def test_sequences_of_nothing(spark):
    assert frequent(spark.createDataFrame([], "codes array<int>"), 5).count() == 0
    assert frequent(spark.createDataFrame([([],), ([None],)], "codes array<int>"), 0).count() == 0


# 8


def test_packing_puts_every_piece_once_and_fills(spark):
    rng = random.Random(8)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(1, 900), 128]) for _ in range(3000)] + [0, None, -4, 2048, 2049, 5000, 4096]
    frame = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "id int, n int, container int")
    rows = packed(frame, "n", 2048, "id").collect()
    whole = Counter()
    filled = Counter()
    for r in rows:
        whole[r.id] += r["size"]
        filled[r.container] += r["size"]
    assert whole == Counter({i: max(0, s or 0) for i, s in enumerate(sizes)})
    assert len({(r.id, r.piece) for r in rows}) == len(rows)
    assert all(len([r for r in rows if r.id == i]) == max(1, -(-(s or 0) // 2048)) for i, s in enumerate(sizes) if (s or 0) > 2048)
    assert max(filled.values()) <= 2048
    assert 1 - sum(filled.values()) / (2048 * len(filled)) < 0.01
    assert sorted(filled) == list(range(len(filled)))


def test_packing_of_nothing_and_of_one_length(spark):
    assert packed(spark.createDataFrame([], "id int, n int"), "n", 10, "id").count() == 0
    rows = packed(spark.range(100).select(F.col("id"), F.lit(4).alias("n")), "n", 10, "id").groupBy("container").count().collect()
    assert {r["count"] for r in rows} == {2}
    made = plan({7: 3, 3: 5}, 10)
    assert made.containers == 4


# 9

DOCUMENTS = "id long, n int, source string, lang string, topic string, copies string"


def test_mixing_reaches_what_can_be_reached(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(50, 500), rng.choice(["big"] * 12 + ["mid"] * 4 + ["tiny", None, "other"]), rng.choice(["pt", "en", None]), rng.choice("ab"), "x") for i in range(4000)]
    rows += [(9001, 0, "big", "pt", "a", "x"), (9002, None, "mid", "pt", "a", "x")]
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 3), ("tiny", 0.25, 2), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixed(spark.createDataFrame(rows, DOCUMENTS), targets, "id", "n", "source", ("lang", "topic"))
    chosen, report = chosen.collect(), {r.source: r for r in report.collect()}
    most = {"big": 1, "mid": 3, "tiny": 2}
    assert len({r.id for r in chosen}) == len(chosen) and all(1 <= r.copies <= most[r.source] and r.n > 0 for r in chosen)
    total = sum(r[1] or 0 for r in rows if r[2] in ("big", "mid", "tiny"))
    assert report["big"].chosen == pytest.approx(0.4 * total, rel=0.01) and report["mid"].chosen == pytest.approx(0.3 * total, rel=0.01)
    assert report["tiny"].chosen == 2 * report["tiny"].available and not report["tiny"].reached
    assert report["none"].chosen == 0 and report["other"].target_share is None
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_mixing_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixed(spark.createDataFrame([], DOCUMENTS), targets, "id", "n", "source", ("lang",))
    assert chosen.count() == 0 and [r.chosen for r in report.collect()] == [0]
    chosen, report = mixed(spark.createDataFrame([(1, 5, "a", "pt", "t", "x")], DOCUMENTS), targets.limit(0), "id", "n", "source", ("lang",))
    assert chosen.count() == 0 and report.count() == 1


# 10


def test_one_form(spark):
    same = ["Rosângela vs Ana, the ﬁnal copa 12", "Rosângela vs Ana, the final copa 12", "Ｒｏｓａ̂ngela vs Ana, the final соpа 12", "Ros​â­ngela vs Αnа, thе fin﻿al cοpa 12"]
    other = ["Rosangela vs Ana, the final copa 12", "Rosângela vs Ana, the final copa 13", "rosângela vs Ana, the final copa 12", "Rosângela vs Ana,  the final copa 12", "", "Борьба на ковре в Москве", "x" * 100_000]
    rows = [(i, t, 1) for i, t in enumerate([*same, *other, None])]
    got = {r.id: r.canonical for r in lookalike.one_form(spark.createDataFrame(rows, "id int, text string, canonical int")).collect()}
    assert {got[i] for i in range(4)} == {"Rosângela vs Ana, the final copa 12"}
    assert len({got[i] for i in range(len(rows))}) == 1 + len(other) + 1
    assert got[len(rows) - 1] is None and got[4 + other.index("")] == "" and got[4 + other.index("Борьба на ковре в Москве")] == "Борьба на ковре в Москве"
    assert lookalike.one_form(spark.createDataFrame([], "text string")).count() == 0


def test_mixed_words_become_their_own_script(spark):
    rows = [("борьба ковер схватка",)] * 5 + [("wrestling contest copa",)] * 5 + [("cхватка kоbep",), ("contеst",)]
    got = [r.canonical for r in lookalike.one_form(spark.createDataFrame(rows, "text string")).collect()]
    assert got[-2].split()[0] == "схватка" and got[-1] == "contest"


def test_characters_that_look_different_stay():
    reader = lookalike.Canonical({})
    assert reader.text("x² ½ ① 2") == "x² ½ ① 2"
