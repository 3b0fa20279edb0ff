"""Operators on hand-built frames and published numbers."""

from __future__ import annotations

import datetime
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kumikata.functions import keys, special
from kumikata.operators import aggregates, flow, graphs, joins, profiles, ratings, sequences, stats, vectors
from kumikata.sources import readers, sinks


def one(spark, column, **values):
    """The value of a column over one row of typed literals."""
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


# keys


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Galvão", "galvao"), ("  Ana   Souza 2", "ana souza"), ("Ana 'Fera' Souza (Final)", "ana souza"), ("Sean O'Malley", "sean omalley"), ("Match 1 (Ana Souza", "ana souza"), ("Ana Souza: the champion", "ana souza"), ("[1:02:03] Ana", "ana"), ("", "")],
)
def test_athlete_key(spark, raw, key):
    assert one(spark, keys.athlete_key(F.col("n")), n=F.lit(raw)) == key


@pytest.mark.parametrize(("method", "family"), [(None, "void"), ("Pts: 4x2", "points"), ("Ref's decision", "decision"), ("Heel hook", "leg"), ("Lesão", "injury"), ("RNC", "strangle"), ("Kimura", "joint"), ("Something", "sub_other")])
def test_method_family(spark, method, family):
    assert one(spark, keys.method_family(F.col("m")), m=F.lit(method).cast("string")) == family


@pytest.mark.parametrize(("url", "video"), [("abcdefghijk", "abcdefghijk"), ("https://youtu.be/abcdefghijk?t=3", "abcdefghijk"), ("https://www.youtube.com/watch?x=1&v=abcdefghijk", "abcdefghijk"), ("https://youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("no", None), (None, None)])
def test_video_id(spark, url, video):
    assert one(spark, keys.video_id(F.col("u")), u=F.lit(url).cast("string")) == video


def test_minutes_titles_and_outcomes(spark):
    assert one(spark, keys.minute_left(F.col("t"), F.col("d"), F.col("s"), F.col("a")), t=F.lit(90.0), d=F.lit(360.0), s=F.lit(0.0), a=F.lit(False)) == "5-4"
    assert one(spark, keys.minute_left(F.col("t"), F.col("d"), F.col("s"), F.col("a")), t=F.lit(None).cast("double"), d=F.lit(360.0), s=F.lit(0.0), a=F.lit(False)) == "no time"
    assert one(spark, keys.outcome(F.col("k"), F.col("o"), F.col("p")), k=F.lit("sweep"), o=F.lit(None).cast("boolean"), p=F.lit(None).cast("int")) == "not known"
    a, b = keys.versus(F.col("t"))
    assert (one(spark, a, t=F.lit("Ana Souza vs. Rita Lopes, Open 2020")), one(spark, b, t=F.lit("Ana Souza vs. Rita Lopes, Open 2020"))) == ("Ana Souza", "Rita Lopes")
    assert one(spark, keys.first_year(F.col("t")), t=F.lit("in 20191 and 2020")) == 2020


# sequences

EVENTS = "match_id string, i int, actor string, label string, type string, ok boolean, ts double"


@pytest.fixture(scope="module")
def bout(spark):
    rows = [
        ("m", 1, "a", "guard", "guard", None, 0.0), ("m", 2, "b", "pass try", "pass", False, 5.0), ("m", 3, "a", "sweep", "sweep", True, 9.0), ("m", 4, None, "restart", "transition", None, 20.0),
        ("m", 5, "a", "mount", "control", True, 30.0), ("m", 6, "b", "armbar", "submission", True, 40.0), ("n", 1, "a", "mount", "control", None, 0.0), ("n", 2, "a", "choke", "submission", True, 300.0),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_no_edge_crosses_a_bout_or_an_actor(bout):
    assert {(r.source, r.target, r.weight, r.ok) for r in sequences.transition_edges(bout).collect()} == {("guard", "sweep", 1, 1), ("sweep", "mount", 1, 1), ("pass try", "armbar", 1, 1), ("mount", "choke", 1, 1)}


def test_reward_and_risk(bout):
    nodes = {r.label: r for r in sequences.transition_nodes(bout).collect()}
    assert (nodes["mount"].occ, nodes["mount"].denom, nodes["mount"].reward, nodes["mount"].risk, nodes["mount"].reward_risk) == (2, 2, 1, 1, 0.0)
    assert (nodes["pass try"].reward, nodes["choke"].denom, nodes["choke"].reward_risk) == (1, 0, 0.0)


def test_exchanges_and_runs(bout):
    split = {(r.match_id, r.i): r.exchange for r in sequences.exchanges(bout).collect()}
    assert split == {("m", 1): 1, ("m", 2): 1, ("m", 3): 1, ("m", 5): 2, ("m", 6): 2, ("n", 1): 1, ("n", 2): 2}
    assert [(r.actor, r.length) for r in sequences.runs(bout.where("match_id = 'n'")).collect()] == [("a", 2)]


def test_smoothing_ties_keep_the_label(spark):
    frames = spark.createDataFrame([("s", i, x) for i, x in enumerate("aabaab")], "s string, o int, x string")
    assert "".join(r.smoothed for r in sequences.smooth(frames, "s", "o", "x", 3).orderBy("o").collect()) == "aaaaab"


def test_lines_fold_by_length_and_time(spark):
    rows = [("s", 1, "x" * 600, 0.0, 2.0), ("s", 2, "y" * 600, 3.0, 2.0), ("s", 3, "z", 6.0, 1.0), ("s", 4, "w", 200.0, 1.0), ("t", 1, None, 0.0, 1.0)]
    got = sorted((r.stream, r.segment, r.lines) for r in sequences.fold_lines(spark.createDataFrame(rows, "s string, o int, x string, at double, d double"), "s", "o", "x", "at", "d").collect())
    assert got == [("s", 0, 1), ("s", 1, 2), ("s", 2, 1), ("t", 0, 1)]


def test_empty_frames_give_empty_results(spark):
    none = spark.createDataFrame([], EVENTS)
    assert sequences.transition_edges(none).count() == sequences.runs(none).count() == sequences.exchanges(none).count() == flow.chains(none).count() == flow.windows(none).count() == 0


# graphs


@pytest.fixture(scope="module")
def cliques(spark):
    rows = [(a, b, 5) for group in ("abcd", "wxyz") for a in group for b in group if a < b] + [("d", "w", 1)]
    return spark.createDataFrame([("g", *r) for r in rows], "graph string, source string, target string, weight long")


@pytest.mark.parametrize("method", ["louvain", "greedy"])
def test_two_cliques_are_two_communities(cliques, method):
    found = graphs.communities(cliques, "graph", method).collect()
    assert sorted(sorted(r.members) for r in found) == [list("abcd"), list("wxyz")]
    assert {r.hub for r in found} == {"d", "w"}
    assert len({r.fingerprint for r in found}) == 2


@pytest.mark.parametrize("small", [True, False])
def test_fixed_points_agree_however_solved(spark, bout, small):
    nodes, edges = sequences.transition_nodes(bout), sequences.transition_edges(bout)
    rank = {r.label: r["rank"] for r in graphs.weighted_pagerank(nodes, edges, small=small).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6)
    assert rank["choke"] > rank["guard"]
    value = {r.label: r.value for r in graphs.path_to_victory(nodes, edges, small=small).collect()}
    assert value["choke"] == pytest.approx(1.0) and all(-1 <= v <= 1 for v in value.values())
    again = {r.label: r.value for r in graphs.path_to_victory(nodes, edges, small=not small).collect()}
    assert again == pytest.approx(value, abs=1e-5)


def test_betweenness_of_a_chain(spark):
    chain = spark.createDataFrame([("g", "a", "b", 1), ("g", "b", "c", 1)], "graph string, source string, target string, weight long")
    assert {r.label: r.betweenness for r in graphs.betweenness(chain, "graph").collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_closure_stops_at_loops(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in graphs.closure(up).collect()}
    assert got[("d", "c")] == 3 and got[("a", "a")] == 3


# joins


def test_ranges_are_half_open_and_ends_may_be_missing(spark):
    points = spark.createDataFrame([("k", 0.0), ("k", 10.0), ("k", 99.0), ("other", 5.0)], "key string, at double")
    windows = spark.createDataFrame([("k", 0.0, 10.0, "first"), ("k", 10.0, None, "rest")], "key string, start double, end double, name string")
    assert sorted((r.at, r.name) for r in joins.range_join(points, windows, "key", "at", 4.0).collect()) == [(0.0, "first"), (10.0, "rest"), (99.0, "rest")]


def test_as_of_takes_the_last_before_or_at(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("j", 9)], "key string, t int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "key string, t int, v string")
    assert sorted((r.key, r.t, r.v or "") for r in joins.as_of(left, right, "key", "t", ["v"]).collect()) == [("j", 9, ""), ("k", 1, ""), ("k", 5, "y"), ("k", 9, "y")]


def test_mirrors_keep_rematches(spark):
    rows = [(1, "p", 2020, "W"), (2, "p", 2020, "L"), (3, "p", 2020, "L"), (4, "q", 2020, "L"), (5, "p", 2020, None)]
    got = joins.mirrors(spark.createDataFrame(rows, "id int, pair string, year int, wl string"), ["pair", "year"], "id", "wl", "W", "L")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_upserts_know_tombstones(spark):
    t = lambda d: datetime.datetime(2020, 1, d)
    old = spark.createDataFrame([(1, t(1), "a", False), (2, t(5), "b", False), (3, t(1), "c", False)], "id int, at timestamp, v string, gone boolean")
    new = spark.createDataFrame([(1, t(1), "A", False), (2, t(4), "B", False), (3, t(2), None, True), (4, t(1), "D", False)], old.schema)
    assert sorted((r.id, r.v) for r in joins.upsert(old, new, ["id"], "at", "gone").collect()) == [(1, "A"), (2, "b"), (4, "D")]


def test_components_of_names(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d")], "a string, b string")
    assert {r.node: r.component for r in joins.merge_components(pairs, nodes).collect()} == dict(zip("abcdef", "aaaddf", strict=True))


# statistics


def test_special_functions():
    assert special.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.beta_quantile(0.025, 8, 4) == pytest.approx(0.3902574, abs=1e-6)
    assert special.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503496, abs=1e-9)
    assert special.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)


@pytest.mark.parametrize(("k", "n", "lo", "hi", "grade"), [(5, 10, 0.2366, 0.7634, "low"), (0, 0, None, None, "none"), (1, 2, 0.0945, 0.9055, "insufficient"), (90, 300, 0.2509, 0.3542, "adequate")])
def test_wilson(spark, k, n, lo, hi, grade):
    row = spark.range(1).select(F.lit(k).alias("k"), F.lit(n).alias("n")).withColumns(stats.wilson(F.col("k"), F.col("n"))).first()
    assert row.grade == grade and (row.lo, row.hi) == (pytest.approx(lo, abs=1e-4), pytest.approx(hi, abs=1e-4)) if lo is not None else row.lo is None


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    got = {r.t: r.q for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "t int, p double"), "p", "t").collect()}
    assert got == {0: pytest.approx(0.02), 1: pytest.approx(0.04), 2: pytest.approx(0.04), 3: pytest.approx(0.02)}


def test_ranks_auc_and_gates(spark):
    frame = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True), (None, True)], "s double, y boolean")
    assert stats.auc(frame, "s", "y").first().auc == pytest.approx(0.875)
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").first().rho is None
    assert stats.spearman(spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double"), "x", "y").first().rho == pytest.approx(1)


def test_resampling_is_near_and_repeats(spark):
    counts = spark.createDataFrame([("g", f"p{i}", 3, 10) for i in range(30)], "g string, who string, k long, n long")
    row = stats.bootstrap(counts, "g", "who", "k", "n").first()
    assert row.rate == pytest.approx(0.3) and row.lo == pytest.approx(0.3) and row.hi == pytest.approx(0.3)
    cells = spark.createDataFrame([("g", "r1", "c1", 20), ("g", "r2", "c2", 20), ("h", "r1", "c1", 10), ("h", "r1", "c2", 10), ("h", "r2", "c1", 10), ("h", "r2", "c2", 10)], "g string, r string, c string, n long")
    p = {x.g: x.p for x in stats.permutation(cells, "g", "r", "c").collect()}
    assert p["g"] < 0.01 and p["h"] > 0.5


# ratings

GOLDEN = [
    ((1500.0, 200.0, 0.06), [(1400.0, 30.0, 1.0), (1550.0, 100.0, 0.0), (1700.0, 300.0, 0.0)], (1464.0507, 151.5165, 0.059996)),
    ((1750.0, 250.0, 0.06), [], (1750.0, 250.2172, 0.06)),
    ((1750.0, 250.0, 0.06), [(1750.0, 250.0, 1.0)], (1857.0824, 217.9272, 0.0599996)),
    ((1750.0, 250.0, 0.06), [(1750.0, 250.0, 0.5)], (1750.0, 217.9272, 0.0599984)),
]


@pytest.mark.parametrize(("state", "seen", "want"), GOLDEN)
def test_glicko_published_numbers(spark, state, seen, want):
    states = spark.createDataFrame([("me", *state), *[(f"o{i}", r, d, 0.06) for i, (r, d, _) in enumerate(seen)]], "athlete string, rating double, deviation double, volatility double")
    rows = [(1, "me", f"o{i}", s) for i, (_, _, s) in enumerate(seen)] or [(1, "x", "y", 1.0)]
    got = {r.athlete: r for r in ratings.glicko2(spark.createDataFrame(rows, "period int, a string, b string, score_a double"), states).collect()}["me"]
    assert (got.rating, got.deviation, got.volatility) == (pytest.approx(want[0], abs=2e-3), pytest.approx(want[1], abs=2e-3), pytest.approx(want[2], abs=1e-6))


def test_elo_is_the_plain_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{i % 3}", i, f"a{w}", f"a{l}", "POINTS", "R1", 2000 + i // 50) for i, (w, l) in enumerate(zip(rng.integers(0, 8, 300), rng.integers(0, 8, 300), strict=True)) if w != l]
    got = {(r.pool, r.athlete): r.elo for r in ratings.elo(spark.createDataFrame(rows, "pool string, i int, winner string, loser string, method string, stage string, year int"), "pool", ["year", "i"]).collect()}
    want: dict = {}
    for pool, _, w, l, *_ in rows:  # noqa: E741
        a, b = want.setdefault((pool, w), 1000.0), want.setdefault((pool, l), 1000.0)
        d = 40 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        want[(pool, w)], want[(pool, l)] = a + d, b - d
    assert got == pytest.approx(want)
    for pool in ("p0", "p1", "p2"):
        own = [v for (p, _), v in got.items() if p == pool]
        assert math.fsum(own) == pytest.approx(1000 * len(own))


def test_graph_ratings_never_fall_by_a_win(spark):
    rows = [("x", 1, "guard", 1.0, 800.0), ("x", 2, "guard", 1.0, 300.0), ("x", 2, "sweep", 1.0, 300.0), ("y", 1, "guard", 0.0, 800.0)]
    got = {(r.athlete, r.label): r.elo for r in ratings.graph_elo(spark.createDataFrame(rows, "athlete string, seq int, label string, score double, opponent double")).collect()}
    assert got[("x", "guard")] >= 800 >= got[("y", "guard")]


# vectors


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u.T
    np.fill_diagonal(score, -2)
    got = {(r["query"], r["rank"]): r.neighbour for r in vectors.neighbours(frame.where("id % 50 = 0"), frame, "id", "v", 4).collect()}
    assert got == {(q, k + 1): int(n) for q in (0, 50) for k, n in enumerate(np.argsort(-score[q])[:4])}


def test_text_search_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "guard guard pass"), (2, "guard sweep"), (3, None), (4, "")], "id long, t string")
    assert [r.id for r in vectors.search(vectors.tfidf(docs, "id", "t"), "id", ["sweep", "guard"], 5).collect()] == [2, 1]


def test_cube_and_lift(spark):
    frame = spark.createDataFrame([("x", "u", 2020), ("x", None, 2023), ("y", "u", None)], "a string, b string, year int")
    got = {(r.since, r.a, r.b): r.n for r in aggregates.cuts(frame, ("a", "b"), [F.count("*").alias("n")], "year", (2022,)).collect()}
    assert got[("all", "all", "all")] == 3 and got[("2022", "x", "unknown")] == 1 and ("2022", "y", "all") not in got


# sources and sinks


def test_delimited_bouts(spark, tmp_path):
    (tmp_path / "x_historical.csv").write_text("match_id;year;winner_name;loser_name;win_type;stage;submission;weight_class;sex\n1;2019;Ana ;Rita;sub by choke;f;RNC;60;f\n2;n/a;Ana;Rita;points;f;;60;f\n3;2020;;Rita;x;f;;60;f\n")
    rows = readers.matches(readers.delimited(spark, str(tmp_path), "matches")).collect()
    assert [(r.year, r.winner, r.win_type, r.stage, r.submission) for r in rows] == [(2019, "Ana", "SUBMISSION", "F", "rnc")]


def test_fighters_from_whatever_columns(spark):
    row = readers.fighters(spark.createDataFrame([("Ana", 10, 7)], "`Fighter Name` string, `Total Fights` int, wins int")).first()
    assert (row.fighter_name, row.wins, row.losses, row.win_ratio, row.sub_ratio) == ("Ana", 7, 3, 0.7, 0.0)


def test_pages_captions_and_skeletons(spark):
    cell = "<td>{}</td>"
    page = "<title> Ana </title><a href='/x'>x</a><table><tr><th>h</th></tr><tr><td>1</td><td><a href='/r'>Rita Lopes</a><span>Rita Lopes</span></td>" + "".join(map(cell.format, ["W", "RNC", "Open", "60", "F", "in 2019"])) + "</tr><tr>" + cell.format("1") + cell.format("Bia CruzBia Cruz") + "".join(map(cell.format, ["L", "Pts", "Cup", "60", "SF", "-"])) + "</tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "no table")], "id long, html string")
    assert [(r.opponent, r.wl, r.year) for r in readers.match_history(pages, "id", "html").orderBy("opponent").collect()] == [("Bia Cruz", "L", None), ("Rita Lopes", "W", 2019)]
    assert [(r.title, r.links) for r in readers.titles_and_links(pages, "html").where("id = 1").collect()] == [("Ana", ["/x", "/r"])]
    vtt = "WEBVTT\n\n00:01.000 --> 00:03.500\nhello <b>there</b>\n\n00:03.500 --> 00:05.000\nhello there\n\n01:00:00.000 --> 01:00:01.000\nend\n"
    assert [(r.i, r.start, r.end, r.text) for r in readers.captions(spark.createDataFrame([(1, vtt)], "id long, t string"), "id", "t").collect()] == [(1, 1.0, 3.5, "hello there"), (2, 3600.0, 3601.0, "end")]
    pose = readers.decode_pose("aa" * 138)
    assert len(pose) == 138 and pose[:3] == [-2.0, 0.0, -2.0]
    rows = ["    " + "a" * 69] * 4
    text = "\n".join(["mount", "tags: top", *rows, "roll", "tags: move", *rows, *rows])
    positions, moves = readers.positions_and_moves(readers.skeletons(spark.createDataFrame([(text,)], "t string"), "t"))
    assert [(r.name, r.tags) for r in positions.collect()] == [("mount", ["top"])]
    assert [(r.name, r.source, r.target, r.frames) for r in moves.collect()] == [("roll", "mount", "mount", 2)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    path = str(tmp_path / "t")
    sinks.replace_partitions(frame, path, "k")
    sinks.replace_partitions(frame.where("k = 'a'").withColumn("n", F.lit(9)), path, "k")
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    sinks.append_run(frame, str(tmp_path / "runs"), "r1")
    with pytest.raises(Exception, match="already exists"):
        sinks.append_run(frame, str(tmp_path / "runs"), "r1")
    assert sinks.long_table({"x": frame}).count() == 4


def test_density_clusters_have_borders_and_noise(spark):
    angles = [0.0, 0.05, 0.1, 0.15, 0.42, 2.0, 2.05, 2.1, 2.15, 4.0]
    frame = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.role) for r in vectors.density_clusters(frame, "id", "v", math.cos(0.3), 3).collect()}
    assert {got[i] for i in range(4)} == {(0, "core")} and {got[i] for i in range(5, 9)} == {(5, "core")}
    assert got[4] == (0, "border") and got[9] == (None, "noise")


def test_lineage_and_overlaps(spark):
    old = spark.createDataFrame([(1, list("abcd")), (2, list("wx"))], "community int, members array<string>")
    new = spark.createDataFrame([(7, list("abc")), (8, list("d")), (9, list("q"))], "community int, members array<string>")
    got = {(r.kind, r.old, r.new) for r in profiles.lineage(old, new, 0.2).collect()}
    assert got == {("kept", 1, 7), ("split", 1, 8), ("born", None, 9), ("gone", 2, None)}
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    sets = spark.createDataFrame([("x", ["p", "q"]), ("y", ["q", "r"])], "who string, items array<string>")
    assert {(r.b, r.shared, round(r.jaccard, 3)) for r in profiles.overlaps(pairs, sets, "who").collect()} == {("y", 1, 0.333), ("z", 0, 0.0)}


def test_mashed_events_are_split(spark, bout):
    rules = spark.createDataFrame([("armbar", "guard pull", "armbar finish")], "label string, first string, second string")
    parts = profiles.split_mashed(bout.where("label = 'armbar'"), rules).orderBy("part").collect()
    assert [(r.label, r.ok, r.ts) for r in parts] == [("guard pull", None, 40.0), ("armbar finish", True, 41.0)]


def test_walk_embedding_is_the_decomposition_of_shared_walks(spark):
    from kumikata import catalog

    rows = [(f"n{i}", f"n{(i * k + k) % 9}", 1 + (i * k) % 4) for i in range(8) for k in (1, 2, 5) if i != (i * k + k) % 9] + [("n2", "end", 1)]
    edges = spark.createDataFrame(rows, "source string, target string, weight int")
    sets, labels = graphs.walk_sets(edges, 12, 6)
    seen = [list(r["nodes"]) for r in sets.collect()]
    ways = {(labels.index(a), labels.index(b)) for a, b, _ in rows}
    assert len(seen) == 6 * len({r[0] for r in rows}) and "end" in labels
    assert all(sum(any((a, b) in ways for a in nodes) for b in nodes) >= len(nodes) - 1 for nodes in seen)
    shared = np.zeros((len(labels), len(labels)))
    for nodes in seen:
        for a in nodes:
            for b in nodes:
                shared[a, b] += a != b
    told = {r["label"]: r["vector"] for r in graphs.walk_embedding(edges, 3, 12, 6).collect()}
    vectors = np.array([told[x] for x in labels])
    u, s, _ = np.linalg.svd(shared)
    assert np.allclose(np.linalg.norm(vectors, axis=0), s[:3], rtol=1e-6)
    assert np.allclose(shared @ vectors, vectors @ np.diag([v @ shared @ v / (v @ v) for v in vectors.T]), atol=1e-3)
    frame = catalog.QUERIES["walk_embedding"](spark, "/root/testdata/sf0.001")
    events_ = catalog.QUERIES["transition_edges"](spark, "/root/testdata/sf0.001")
    assert frame.groupBy("label").count().where("count = 16").count() == events_.selectExpr("explode(array(source, target)) AS l").distinct().count()


def test_criteria_contrast_with_no_condition(spark):
    columns = "match_id string, actor string, i int, position string, action string, condition string, response string, success boolean, opponent string"
    told = [(f"m{k}", "a", 3 * j, None, "pass", "passing" if j < 2 else None, "sweep" if j < 2 else "mount", j == 0, f"o{k % 5}" if j < 2 else None) for k in range(12) for j in range(4)]
    alone = [(f"x{k}", "a", 1, "mount", "choke", "other" if k < 3 else None, "tap", True, "same" if k < 3 else None) for k in range(9)]
    frame = spark.createDataFrame(told + alone, columns)
    found = flow.criteria(frame).collect()
    assert [(r.position, r.action, r.condition, r.response) for r in found] == [("-", "pass", "passing", "sweep")]  # the other triad has one opponent
    r = found[0]
    assert (r.n_with, r.n_condition, r.n_without, r.n_no_condition, r.bouts, r.blocked) == (24, 24, 0, 24, 12, True)
    assert r.effect == pytest.approx(25 / 26 - 1 / 26) and r.effect_lo < r.effect < r.effect_hi and r.success_rate == 0.5
    assert r.p == pytest.approx(1 / 1001) and r.stability == 1.0 and r.survives
    # conditions that follow the bout alone say nothing within bouts
    bound = [(f"m{k}", "a", j, None, "pass", "passing" if k < 6 else None, "sweep" if k < 6 else "mount", None, f"o{k}") for k in range(12) for j in range(4)]
    (b,) = flow.criteria(spark.createDataFrame(bound, columns)).collect()
    assert b.p == 1.0 and b.effect > 0.8 and not b.survives


def test_spellings_of_an_athlete_are_one_side(spark):
    assert sequences.athletes_of(["zuleica de lutupuda", "lutupuda, zuleica", "frederica de belipura"]) == [0, 0, 1]
    assert sequences.athletes_of(["rosângela le gotunori", "r. le gotunori", "bronwen sorezada duninuto"]) == [0, 0, 1]
    assert sequences.athletes_of(["samantha de lederane", "beatriz lamafoso", "zia lamafosso"]) == [0, 1, 1]
    assert sequences.athletes_of(["ana souza", "rita souza"]) == [0, 1] and sequences.athletes_of(["ana souza", "ana lopes", "eva reis"]) == [0, 1, 2]
    names = ["odessa da senefage", "odesa senefage", "mariela gibolali", None, "third person"]
    rows = spark.createDataFrame([("m", i, a, "guard", "guard", None, 0.0) for i, a in enumerate(names, 1)], EVENTS)
    tagged = sequences.resolved_sides(rows)
    assert [r.side for r in tagged.orderBy("i").collect()] == ["a", "a", "b", None, None]
    assert [(r.actor, r.events) for r in sequences.sideless(tagged).collect()] == [("third person", 1)]


def test_sparse_neighbours_use_all_edges(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, (30, 12)) * (rng.random((30, 12)) < 0.25)
    dense[:, 0] = 1  # a target of all, by single steps
    edges = spark.createDataFrame([(f"s{i:02}", f"t{j}", int(w)) for (i, j), w in np.ndenumerate(dense) if w], "s string, t string, w int")
    u = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    np.fill_diagonal(score, -1)
    want = {(f"s{i:02}", r + 1): f"s{j:02}" for i in range(30) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:4])}
    assert {(r.a, r["rank"]): r.b for r in vectors.sparse_neighbours(edges, "s", "t", "w", 4).collect()} == want


def test_lift_stability_flags_what_one_athlete_carries(spark):
    own = [(f"p{i}", x) for i in range(8) for x in ["spread"] * 3 + ["rest"] * 7] + [("p0", "alone")] * 30
    base = [(f"q{i}", x) for i in range(8) for x in ["spread", "alone"] + ["rest"] * 18] + [("q0", "absent")]
    frames = [spark.createDataFrame(x, "who string, label string") for x in (own, base)]
    got = {r.label: r for r in stats.lift_stability(*frames, "who", "label").collect()}
    assert got["spread"].grade == "alta" and got["spread"].stable_share > 0.95 and got["spread"].lift == pytest.approx(math.log2((24 / 110) / (8 / 161)))
    assert got["alone"].lift > 0 and got["alone"].grade == "baixa" and 0.5 < got["alone"].stable_share < 0.7
    even = {r.label: r for r in stats.lift_stability(*frames, "who", "label", True).collect()}
    assert even["alone"].lift == pytest.approx(math.log2(30 / 40 / 8 / ((7 / 20 + 1 / 21) / 8)))


def test_permutation_tells_small_p_apart(spark):
    cells = spark.createDataFrame([("g", "r1", "c1", 30), ("g", "r2", "c2", 30)], "g string, r string, c string, n long")
    assert stats.permutation(cells, "g", "r", "c").first().p == pytest.approx(1 / 10_001)


def test_greedy_merges_are_the_best_and_do_not_see_every_link_again():
    rng = np.random.default_rng(3)
    near = graphs._undirected(pd.DataFrame({"source": [f"n{i}" for i in rng.integers(0, 14, 60)], "target": [f"n{i}" for i in rng.integers(0, 14, 60)], "weight": rng.integers(1, 5, 60)}))[1]
    parts = [[n] for n in sorted(near)]
    while True:
        best = min((-round(graphs.modularity([p for p in parts if p not in (a, b)] + [a + b], near), 12), *sorted((min(a), min(b))), a, b) for a in parts for b in parts if a < b and any(m in near[n] for n in a for m in b))
        if -best[0] <= graphs.modularity(parts, near) + 1e-12:
            break
        parts = [p for p in parts if p not in best[3:]] + [best[3] + best[4]]
    assert graphs.greedy_parts(sorted(near), near) == sorted((sorted(p) for p in parts), key=lambda p: (-len(p), p[0]))
    # few nodes have most of the links, as positions do
    ends = (4000 * rng.random((2, 30_000)) ** 3).astype(int)
    nodes, near = graphs._undirected(pd.DataFrame({"source": [f"n{i}" for i in ends[0]], "target": [f"n{i}" for i in ends[1]], "weight": 1}))
    began = time.process_time()
    assert sum(map(len, graphs.greedy_parts(nodes, near))) == len(nodes)
    assert time.process_time() - began < 40


def written(spark):
    """Bytes that the session's shuffles have written."""
    return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])


def test_next_moves_meet_only_those_that_can_be_among_the_first(spark):
    rng = np.random.default_rng(4)
    rows = [(f"a{rng.integers(40)}", f"s{rng.integers(3)}", f"t{int(50 * rng.random() ** 2):02d}") for _ in range(1200)]
    counts = {}
    for row in rows:
        counts[row] = counts.get(row, 0) + 1
    got = {(r.who, r.source, r["rank"]): (r.target, r.p) for r in vectors.next_moves(spark.createDataFrame(rows, "who string, source string, target string"), "who", 4).collect()}
    for who, source in {r[:2] for r in rows}:
        own, every = ({t: sum(n for (w, s, x), n in counts.items() if s == source and x == t and w in ws) for t in {r[2] for r in rows if r[1] == source}} for ws in ({who}, {r[0] for r in rows}))
        raw = {t: math.sqrt(max(own[t] / sum(own.values()), 1e-6) * max(every[t] / sum(every.values()), 1e-6)) for t in every}
        first = sorted((-round(x / sum(raw.values()), 9), t) for t, x in raw.items())[:4]
        assert [got[who, source, i + 1] for i in range(4)] == [(t, pytest.approx(-x, abs=1e-8)) for x, t in first]
    many = spark.range(1500).select(F.concat(F.lit("a"), "id").alias("who"), F.lit("s").alias("source"), F.concat(F.lit("t"), "id").alias("target")).localCheckpoint()
    before = written(spark)
    assert vectors.next_moves(many, "who").count() == 4500
    time.sleep(1)
    assert written(spark) - before < 2e6


def test_lineage_joins_no_lists_of_members(spark):
    of = lambda c, low, high: spark.range(low, high).groupBy(F.lit(c).alias("community")).agg(F.collect_list(F.concat(F.lit("a position by name "), "id")).alias("members"))
    old, new = of(1, 0, 30_000), of(7, 10_000, 40_000)
    began = time.monotonic()
    assert [tuple(r) for r in profiles.lineage(old, new, 0.2).collect()] == [("kept", 1, 7, 0.5)]
    assert time.monotonic() - began < 40


def test_dilemmas_reach_by_bits(spark):
    rng = np.random.default_rng(5)
    ends = rng.integers(0, 300, (2, 420))
    ways = {}
    for s, t in ends.T.tolist():
        ways.setdefault(s, set()).add(t)
    want = {}
    for node in ways:
        front, seen = {node}, set()
        for _ in range(3):
            front = {t for s in front for t in ways.get(s, ())}
            seen |= front
        want[f"n{node}"] = len(seen - {node})
    edges = spark.createDataFrame([(f"n{s}", f"n{t}") for s in ways for t in ways[s]], "source string, target string")
    assert {r.node: r.reach for r in graphs.reached(edges, 3, 64).collect()} == {n: x for n, x in want.items() if x}
    dense = spark.range(600).select(F.concat(F.lit("n"), "id").alias("source")).crossJoin(spark.range(600).select(F.concat(F.lit("n"), "id").alias("target"))).where("source <> target")
    value = spark.range(600).select(F.concat(F.lit("n"), "id").alias("label"), F.lit(0.5).alias("value"))
    began = time.monotonic()
    assert {(r.branches, r.reach) for r in graphs.dilemmas(dense, value).collect()} == {(599, 599)}
    assert time.monotonic() - began < 40
