"""Attribution, scouting, node ratings, systems and written forms on small cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kumikata.functions import keys as k
from kumikata.operators import attribution as at
from kumikata.operators import graphs, profiles, ratings, scouting as sc, stats, systems as y, vectors as v

EV = "match_id string, i int, label string, type string, actor string, ok boolean, ts double"


def _events(spark, rows):
    return spark.createDataFrame(rows, EV)


def test_roles_of_labels_and_types(spark):
    rows = [("m", 1, "half guard", "guard", "a", None, 1.0), ("m", 2, "5050 guard", "guard", "a", None, 2.0), ("m", 3, "takedown defense", "takedown", "b", None, 3.0), ("m", 4, "turtle position", "control", "a", None, 4.0), ("m", 5, "nothing known", "sweep", "a", None, 5.0), ("m", 6, "x", "match", None, None, None), ("m", 7, None, None, "a", None, None)]
    got = {r.i: (r.category, r.relation, r.actor_role, r.target_role, r.status, r.source) for r in at.classify(_events(spark, rows)).collect()}
    assert got[1] == ("state", "plays", "bottom", "top", "resolved", "table")
    assert got[2] == ("state", "plays", "neutral", "neutral", "symmetric", "table")
    assert got[3] == ("action", "defends", "defender", "executor", "resolved", "table")
    assert got[4] == ("state", "defends", "bottom", "unknown", "unknown", "table")
    assert got[5] == ("action", "executes", "executor", "defender", "resolved", "type_default")
    assert got[6][2:5] == got[7][2:5] == ("unknown", "unknown", "unknown")


def test_flags_of_bouts(spark):
    one = [("one", i, "mount", "control", "a", None, float(i)) for i in range(6)]
    few = [("few", i, "mount", "control", "a", None, float(i)) for i in range(5)]
    clash = [("clash", 1, "mount", "control", "a", None, 10.0), ("clash", 2, "half guard", "guard", "a", None, 20.0), ("clash", 3, "half guard", "guard", "b", None, 12.0)]
    apart = [("apart", 1, "mount", "control", "a", None, 10.0), ("apart", 2, "half guard", "guard", "a", None, 21.0), ("apart", 3, "back control", "control", "b", None, None)]
    axes = [("axes", 1, "back control", "control", "a", None, 1.0), ("axes", 2, "half guard", "guard", "a", None, 1.0), ("axes", 3, "x", "sweep", "b", None, 1.0)]
    got = {r.match_id: r for r in at.bout_flags(at.classify(_events(spark, one + few + clash + apart + axes))).collect()}
    assert (got["one"].one_sided, got["one"].reason, got["few"].one_sided, got["few"].role_reliable) == (True, "one_sided", False, True)
    assert (got["clash"].contradictions, got["clash"].role_reliable, got["clash"].perspective_reliable) == (1, False, True)
    assert got["apart"].contradictions == got["axes"].contradictions == 0
    assert at.bout_flags(at.classify(_events(spark, []))).count() == 0


def test_events_from_either_corner(spark):
    rows = [("m", 1, "half guard", "guard", "a", None, 1.0), ("m", 2, "turtle position", "control", "b", None, 2.0)]
    sides = spark.createDataFrame([("m", "a", "b"), ("m", "b", "a")], "match_id string, athlete string, opponent string")
    told = at.classify(_events(spark, rows))
    got = {(r.athlete, r.i): (r.perspective, r.subject_role, r.status, r.target) for r in at.attribute(told, sides, at.bout_flags(told)).collect()}
    assert got[("a", 1)] == ("favor", "bottom", "resolved", "b") and got[("b", 1)] == ("contra", "top", "resolved", "b")
    assert got[("b", 2)][:3] == ("favor", "unknown", "unknown") and got[("a", 2)][:3] == ("contra", "unknown", "unknown")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("m", 1, "p", "guard", "a", None, 10.0), ("m", 2, "p", "guard", "b", None, 25.0)], ("both", "double pull")),
        ([("m", 1, "p", "guard", "a", None, 10.0), ("m", 2, "p", "guard", "b", None, 25.5)], ("a", "pull")),
        ([("m", 1, "p", "guard", "a", None, 10.0), ("m", 2, "p", "guard", "a", None, 11.0)], ("a", "pull")),
        ([("m", 1, "t", "takedown", "b", False, 1.0), ("m", 2, "t", "takedown", "b", None, 9.0), ("m", 3, "p", "guard", "a", None, 9.5)], ("b", "takedown")),
        ([("m", 1, "s", "sweep", "b", True, 1.0)], None),
    ],
)
def test_openings(spark, rows, want):
    got = [(r.agent, r.opening) for r in sc.openings(_events(spark, rows), F.col("type") == "guard").collect()]
    assert got == ([want] if want else [])


def test_grades_and_the_weakest(spark):
    frame = spark.createDataFrame([(8, 4), (8, 3), (5, 3), (3, 2), (3, 1), (2, 2)], "n int, b int")
    assert [r[0] for r in frame.select(k.grade(F.col("n"), F.col("b"))).collect()] == ["strong", "sustained", "sustained", "limited", None, None]
    pairs = spark.createDataFrame([("strong", "limited"), ("strong", "strong"), ("strong", None)], "a string, b string")
    assert [r[0] for r in pairs.select(sc.weakest(F.col("a"), F.col("b"))).collect()] == ["limited", "strong", None]


def test_sections_of_events(spark):
    rows = [("takedown", "x"), ("control", "collar tie"), ("guard", "collar tie"), ("transition", "back knee cut"), ("pass", "y"), ("escape", "back")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, l string").select(sc.sections(F.col("t"), F.col("l"))).collect()]
    assert got == [["standing"], ["standing"], ["guard"], ["passing", "back_and_finishing"], ["passing"], []]


def test_scores_and_points(spark):
    bouts = spark.createDataFrame([("ok", 100.0, "a", "b", 2, 3), ("short", 100.0, "a", "b", 2, 3), ("late", 10.0, "a", "b", 2, 0), ("none", 100.0, "a", "b", 0, 0), ("other", 100.0, "a", "b", 1, 0)], "match_id string, duration double, a string, b string, score_a int, score_b int")
    scores = spark.createDataFrame([("ok", "a", 5.0, 2, 1), ("ok", "b", 6.0, 3, 2), ("short", "a", 5.0, 2, 1), ("late", "a", 11.0, 2, 1), ("other", "a", 1.0, 1, 1), ("other", "c", 1.0, 0, 2)], "match_id string, actor string, ts double, points int, order int")
    assert {r.match_id: r.complete for r in sc.complete_scores(bouts, scores).collect()} == {"ok": True, "short": False, "late": False, "none": False, "other": False}
    events = _events(spark, [("ok", 1, "x", "sweep", "a", None, 5.0), ("ok", 2, "x", "sweep", "a", None, 5.5), ("ok", 3, "x", "sweep", None, None, None)])
    twice = scores.unionByName(spark.createDataFrame([("ok", "a", 5.0, 4, 9)], scores.schema))
    assert {r.i: r.points for r in sc.points_by_event(events, twice).collect()} == {1: 4, 2: None, 3: None}
    over = spark.createDataFrame([(5.0, 10.0), (11.0, 10.0), (-1.0, 10.0), (5.0, None), (None, 10.0)], "s double, d double")
    assert [r[0] for r in over.select(sc.valid_overtime(F.col("s"), F.col("d"))).collect()] == [True, False, False, True, False]


def test_results_never_invent_a_defeat(spark):
    frame = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c"), ("a", None)], "athlete string, winner string").withColumns({"x": F.lit("a"), "y": F.lit("b")})
    assert [r[0] for r in frame.select(sc.result_for(*map(F.col, ("athlete", "winner", "x", "y")))).collect()] == ["won", "lost", "no result", "no result"]


def test_match_scores(spark):
    rows = [(True, "DRAW", 0, 0), (True, "SUBMISSION", 0, 9), (False, "SUBMISSION", 9, 0), (True, "", 0, 0), (False, "", 0, 0), (True, "", 0, 10), (True, "", 10, 0), (False, "", 10, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "w boolean, k string, a int, b int").select(ratings.match_score(*map(F.col, "wkab"))).collect()]
    assert got == pytest.approx([0.5, 1, 0, 0.75, 0.25, 0.5, 0.875, 0.5])


def test_node_track_of_one_bout_is_a_weighted_update(spark):
    bouts = spark.createDataFrame([("m", 2020, "a", "b", 1.0), ("n", 2021, "a", "b", 1.0)], "match string, period int, a string, b string, score_a double")
    nodes = spark.createDataFrame([("m", "a", "x", 3), ("n", "b", "y", 1), ("m", "c", "z", 1)], "match string, athlete string, node string, occurrences int")
    states, track = ratings.node_track(bouts, nodes, [("full", 1.0, ratings.DEVIATION, 0.5, 0.06), ("less", 0.25, ratings.DEVIATION, 0.5, 0.06)])
    got = {(r.cell, r.athlete, r.node): r for r in track.collect()}
    assert set(got) == {(c, a, n) for c in ("full", "less") for a, n in (("a", "x"), ("b", "y"))}
    first = {r.athlete: r for r in ratings.glicko2(bouts.where("period = 2020")).collect()}
    # with full weight and an athlete's own start, a node's first bout moves it as it moves the athlete; the second year it only widens
    assert got[("full", "a", "x")].rating == pytest.approx(first["a"].rating, abs=1e-6)
    assert got[("full", "a", "x")].deviation > first["a"].deviation
    assert got[("full", "b", "y")].seed == pytest.approx(first["b"].rating)
    assert 0 < got[("less", "a", "x")].rating - ratings.SEED < got[("full", "a", "x")].rating - ratings.SEED
    assert (got[("full", "a", "x")].bouts, got[("full", "a", "x")].occurrences) == (1, 3)
    told = {r.cell: r for r in ratings.node_criteria(states, track, bouts, nodes).collect()}
    assert told["full"].nodes == 2 and told["full"].holdout == 2 and told["full"].single_bout == 1.0
    assert told["less"].at_prior <= 1 and told["full"].base_loss > 0


def test_hash_and_difference_of_runs(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert ratings.bouts_hash(a, ["k", "v"]).first()["hash"] == ratings.bouts_hash(a.orderBy(F.desc("k")), ["k", "v"]).first()["hash"]
    assert ratings.bouts_hash(a, ["k", "v"]).first()["hash"] != ratings.bouts_hash(a.withColumn("v", F.lit("x")), ["k", "v"]).first()["hash"]
    one, two = (spark.createDataFrame(rows, "k int, r double") for rows in ([(1, 1.0), (2, 2.0)], [(1, 1.0 + 1e-12), (3, 2.0)]))
    assert sorted((r.k, r.field) for r in ratings.compare_states(one, two, ["k"], ["r"]).collect()) == [(2, "r"), (3, "r")]


def test_false_discovery_is_that_of_one_window(spark):
    ps = [0.001, 0.2, 0.03, 0.03, None, 0.9, 0.04, 0.5, 1.0]
    frame = spark.createDataFrame([(str(i), p) for i, p in enumerate(ps)], "t string, p double")
    known = sorted((p, str(i)) for i, p in enumerate(ps) if p is not None)
    want, low = {}, 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = low
    for parts in (1, 5):
        got = {r.t: r.q for r in stats.benjamini_hochberg(frame.repartition(parts), "p", "t").collect()}
        assert got == pytest.approx(want)
    assert stats.benjamini_hochberg(frame.limit(0), "p", "t").count() == 0


def test_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("n30", "n0")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in graphs.closure(edges).collect()}
    assert got[("n0", "n30")] == 30 and len(got) == 31 * 31


def test_all_labels_take_part(spark):
    frame = spark.createDataFrame([([float(i % 7), float(i)], f"label {i % 5}", i % 3) for i in range(60)], "v array<double>, label string, g int")
    assert sum(r.n for r in profiles.cross_validated(frame, "v", "label", "g", folds=2).collect()) == 60


def test_states_of_nodes_and_drivers(spark):
    found = spark.createDataFrame([("g", 0, 3, 9.0, ["a", "b", "c"]), ("g", 1, 1, 0.0, ["d"]), ("g", 2, 2, 0.5, ["e", "f"])], "graph string, community int, size int, support double, members array<string>")
    nodes = spark.createDataFrame([("g", x) for x in "abcdefz"], "graph string, label string")
    assert {r.label: r.state for r in y.classify_nodes(found, nodes, 2, 1.0).collect()} == {"a": "detected", "b": "detected", "c": "detected", "d": "singleton", "e": "low_support", "f": "low_support", "z": "unassigned"}
    units = spark.createDataFrame([("g", "p", "a", "b", 5.0), ("g", "p", "b", "c", 5.0), ("g", "q", "x", "y", 5.0), ("g", "r", "x", "y", 5.0), ("g", "s", "y", "z", 1.0)], "graph string, unit string, source string, target string, weight double")
    whole = graphs.communities(units.groupBy("graph", "source", "target").agg(F.sum("weight").alias("weight")), "graph")
    got = {tuple(sorted(r.members)): r.driver for r in y.drivers(units, whole).join(whole, ["graph", "community"]).collect()}
    assert got == {("a", "b", "c"): "p", ("x", "y", "z"): None}


def test_systems_are_matched_one_to_one(spark):
    rows = [("p", "q", 0, 0, 0.9), ("p", "q", 0, 1, 0.5), ("p", "q", 1, 0, 0.8), ("p", "q", 1, 1, 0.1), ("p", "q", 2, 0, 0.9), ("p", "q", 2, 1, 0.9)]
    similarity = spark.createDataFrame(rows, "a string, b string, system_a int, system_b int, score double")
    got = sorted((r.system_a, r.system_b) for r in y.match_systems(similarity.select("a", "b").distinct(), similarity).collect())
    assert got == [(0, 0), (1, 1)]


def test_levels_of_conditions(spark):
    observed = spark.createDataFrame([("s1", "x", 40), ("s1", "o", 2), ("s2", "x", 2), ("s2", "o", 40), ("s3", "x", 1), ("t", "o", 30)], "condition string, response string, n int")
    ladder = spark.createDataFrame([(c, 0, c) for c in ("s1", "s2", "s3", "t")] + [(c, 1, "s") for c in ("s1", "s2", "s3")] + [(c, 2, "all") for c in ("s1", "s2", "s3")] + [("t", 1, "all")], "condition string, depth int, level string")
    contrasts = y.sibling_contrasts(observed, ladder)
    got = {(r.condition, r.response): (r.chosen, r.reason) for r in y.select_level(contrasts, ladder).collect()}
    assert got[("s1", "x")] == ("s1", "specific")
    assert got[("s2", "x")] == ("s", "specific")  # not itself, but its family differs from the rest
    families = {"a": "f", "b": "f", "c": "g"}
    frame = spark.createDataFrame([("a",), ("a-and-b",), ("a-and-c",), ("z",)], "c string")
    assert [r[0] for r in frame.select(y.condition_family(F.col("c"), families)).collect()] == ["f", "f", None, None]


def test_names_of_clusters(spark):
    rows = [("1", [0.5, 0.3, 0.2], [0.2, 0.1, -0.3]), ("2", [0.1, 0.8, 0.1], [0.0, 0.0, 0.0]), ("3", [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]), ("4", [0.2, 0.6, 0.2], [0.0, 0.0, 0.0]), ("5", [0.3, 0.4, 0.3], [0.0, 0.5, 0.0])]
    centres = spark.createDataFrame(rows, "c string, s array<double>, d array<double>")
    got = {r.c: r.name for r in v.archetype_names(centres, "c", "s", "d", ("guard", "pass", "sweep")).collect()}
    assert got == {"1": "Guard / Pass Specialist", "2": "Pass-Based · Pass-Based", "3": "Balanced", "4": "Pass-Based · Pass-Based 2", "5": "Pass Specialist"}


def test_written_forms(spark):
    clock = spark.createDataFrame([("1:02:03",), ("2:05",), ("45",), ("a:b",), ("1:2:3:4",), (None,), ("",)], "t string")
    assert [r[0] for r in clock.select(k.clock_seconds(F.col("t"))).collect()] == [3723, 125, 45, None, None, None, None]
    classes = spark.createDataFrame([("mount_top",), ("side_control_bottom",), ("standing",), ("back_x",)], "c string")
    assert [tuple(r) for r in classes.select(*k.class_parts(F.col("c"))).collect()] == [("mount", "top"), ("side_control", "bottom"), ("standing", None), ("back_x", None)]
    raw = spark.createDataFrame([("Side-Control2",), ("Mount 1",), ("Standing",)], "c string")
    assert [r[0] for r in raw.select(k.detector_class(F.col("c"))).collect()] == ["side_control_bottom", "mount_top", "standing"]
    assert [r[0] for r in spark.createDataFrame([("arm bar attempt",), ("attempt",), ("toe hold failed",)], "l string").select(k.without_attempt(F.col("l"))).collect()] == ["arm bar", "attempt", "toe hold"]
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("p", "q")], "a string, b string")
    verdicts = spark.createDataFrame([("y", "x", "same", "seen")], "a string, b string, verdict string, reason string")
    assert sorted((r.a, r.verdict) for r in k.reviewed(pairs, verdicts).collect()) == [("p", None), ("x", "same"), ("y", "same")]


def test_formulas_over_documents(spark):
    frame = spark.createDataFrame([('{"a": {"b": 6}, "c": 3}',), ('{"a": {"b": 6}, "c": 0}',), ("{}",)], "d string")
    assert [r[0] for r in frame.select(k.formula(F.col("d"), "(a.b + 2) / c - 1")).collect()] == [pytest.approx(8 / 3 - 1), None, None]
    for bad in ("a ** 2", "f(a)", "'x'", "a if b else c"):
        with pytest.raises(ValueError, match="not a formula"):
            k.formula(F.col("d"), bad)


def test_many_pairs_are_matched_without_a_python_step_for_each(spark):
    scores = F.pmod(F.xxhash64("id", "system_a", "system_b"), F.lit(4)) / 4.0
    told = spark.range(300).select("id", F.concat(F.lit("a"), "id").alias("a"), F.lit("b").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("system_a")).withColumn("system_b", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("score", scores).drop("id").localCheckpoint()
    found = y.match_systems(told.select("a", "b").distinct(), told)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    want, of = set(), {}
    for r in told.collect():
        of.setdefault(r.a, {}).setdefault(r.system_a, []).append((-r.score, r.system_b))
    for a, systems in of.items():
        taken = set()
        for mine in sorted(systems):
            free = sorted(x for x in systems[mine] if x[1] not in taken)
            if free:
                taken.add(free[0][1])
                want.add((a, mine, free[0][1], -free[0][0]))
    assert {(r.a, r.system_a, r.system_b, r.score) for r in found.collect()} == want


def test_nearest_profiles_of_a_query_come_without_a_python_step_for_each_pair(spark, sf):
    from kumikata import catalog

    plan = catalog.QUERIES["nearest_profiles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "lambdafunction" in plan


def test_systems_find_communities_once(spark):
    edges = spark.createDataFrame([("x", "a", "b", 2), ("x", "b", "c", 1), ("y", "d", "e", 1)], "actor string, source string, target string, weight long").localCheckpoint()
    kinds = spark.createDataFrame([("a", "guard"), ("b", "guard"), ("c", "pass"), ("d", "pass")], "label string, type string").localCheckpoint()
    found = profiles.systems(edges, kinds, "actor")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroupsInPandas") == 1
    assert sorted(map(tuple, found.collect())) == [("x", 0, 3, "b", 3.0, "guard", 2 / 3), ("y", 0, 2, "d", 1.0, None, 0.5)]


def test_graphs_that_span_batches_have_their_own_communities(spark):
    import random

    draw, near, rows = random.Random(5), {}, []
    for k in range(40):
        mine = [(f"n{draw.randint(0, 25)}", f"n{draw.randint(0, 25)}", float(draw.randint(1, 3))) for _ in range(draw.randint(1, 60))]
        rows += [(f"g{k}", *x) for x in mine]
        near[f"g{k}"] = graphs._linked(*zip(*mine, strict=True))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = graphs.communities(spark.createDataFrame(rows, "g string, source string, target string, weight double"), "g").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    told = {}
    for r in sorted(found, key=lambda r: (r.graph, r.community)):
        assert r.size == len(r.members)
        told.setdefault(r.graph, []).append(r.members)
    assert told == {g: graphs.connected_parts(graphs.louvain_parts(*x), x[1])[0] for g, x in near.items() if x[0]}


def test_systems_of_two_lists_are_matched_as_their_scores_are(spark):
    import random

    draw = random.Random(9)
    kind = lambda: draw.choice(["guard", "pass", None])
    lists = lambda: [(c, kind(), draw.choice([0.5, 1.0, 2 / 3]), kind(), draw.randint(2, 4), draw.choice([0.0, 1.0, 3.0])) for c in sorted(draw.sample(range(9), draw.randint(1, 6)))]
    item = "array<struct<community:int,dominant:string,share:double,hub_type:string,size:int,support:double>>"
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}", lists(), lists()) for k in range(200)], f"a string, b string, systems_a {item}, systems_b {item}").localCheckpoint()
    each = pairs.select("a", "b", F.explode("systems_a").alias("x"), "systems_b").select("a", "b", "x", F.explode("systems_b").alias("z"))
    alike = F.when(F.col("x.dominant") == F.col("z.dominant"), F.least("x.share", "z.share")).otherwise(0.0)
    score = profiles.system_similarity(alike, F.coalesce(F.col("x.hub_type") == F.col("z.hub_type"), F.lit(False)), (F.col("x.size"), F.col("z.size")), (F.col("x.support"), F.col("z.support")))
    want = y.match_systems(pairs.select("a", "b"), each.select("a", "b", F.col("x.community").alias("system_a"), F.col("z.community").alias("system_b"), score.alias("score")))
    found = y.match_system_lists(pairs).localCheckpoint()
    told = found.select("a", "b", F.explode("matched").alias("m")).select("a", "b", "m.system_a", "m.system_b", "m.score")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, y.list_similarity(found).collect())) == sorted(map(tuple, y.profile_similarity(want).collect()))
    assert y.match_system_lists(pairs.where("false")).count() == 0


def test_a_label_s_key_form_is_that_of_the_expression_in_sql(spark):
    import duckdb

    from kumikata.sources.views import node_key

    labels = ["Ça-va  é 😀 x", "--", "", None, " A  b\t c ", "Kİ x", "😀", "ﬁ x", "straße ÄÖ", "a'b'c-d", "é é", "x - y", "2-on-1  grip"]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "label string").select(node_key(F.col("label"))).collect()]
    sql = "SELECT trim(regexp_replace(regexp_replace(lower(trim(?)), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
    assert found == [duckdb.execute(sql, [x]).fetchall()[0][0] for x in labels]


def test_events_by_bout_are_the_same_events(spark, sf, tmp_path):
    from kumikata.sources.views import events

    raw = spark.read.parquet(f"{sf}/match_events.parquet")
    later = raw.where("event_id % 5 = 0").withColumns({"event_id": F.col("event_id") + 10**9, "label": F.lit("a later arrival"), "actor": F.lit(None).cast("string")})
    raw.unionByName(later).write.parquet(f"{tmp_path}/match_events.parquet")
    every, some = events(spark, str(tmp_path)), events(spark, str(tmp_path), by_bout=True, of=("label", "type", "actor"))
    columns = ["match_id", "idx", "i", "label", "type", "actor"]
    assert some.columns == ["match_id", "idx", "label", "type", "actor", "i"]
    assert sorted(map(repr, every.select(columns).collect())) == sorted(map(repr, some.select(columns).collect()))
    assert some.where("label = 'a later arrival'").count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
