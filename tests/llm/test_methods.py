"""That the named methods decide, and that nothing is lost to bounds: cases that fail where a method or an exact way is taken out."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kumikata.llm import lookalike, mixing, names, p10, sequences, springs, stripes
from kumikata.llm.labels import canonical
from kumikata.llm.packing import packed
from kumikata.llm.sequences import Transducer, frequent
from kumikata.llm.springs import strengths
from kumikata.llm.survivors import survivors

DAY = datetime.datetime(2024, 5, 1)


def test_the_skyline_decides_between_records_of_equal_trust_and_age(spark):
    """Record 1 stands before record 2 by its number, but 2 has more and dominates it: the field comes from the first layer."""
    frame = spark.createDataFrame([("g", 1, 1, DAY, "x", None), ("g", 2, 1, DAY, "y", "z"), ("g", 3, 2, DAY, "w", "w")], "g string, id long, trust int, at timestamp, a string, b string")
    row = survivors(frame, "g", "id", F.col("trust"), "at", {"a": F.col("a").isNotNull(), "b": F.col("b").isNotNull()}).first()
    assert (row["a_id"], row["b_id"], row["layers"], row["first_id"]) == (2, 2, 2, 1)
    assert survivors(frame, "g", "id", F.col("trust"), "at", {"a": F.col("a").isNotNull()}, least=4).count() == 0


def test_several_abbreviations_and_labels_of_any_length(spark):
    long = "alpha " * 15 + "omega choke"
    library = spark.createDataFrame([("kneeling shoulder pin", None), (long, None), ("standing shoulder pin", None)], "node_key string, aliases array<string>")
    typed = {"kneel. should. pin": "kneeling shoulder pin", "stand. should. pin": "standing shoulder pin", long.replace("omega", "omegaa"): long, "x" * 5000: None, "": None}
    got = {r.label: r.node_key for r in canonical(spark.createDataFrame([(t,) for t in typed], "label string"), library).collect()}
    assert got == typed


def test_slips_in_both_words_meet(spark):
    """Four plain edits, two slips: one exchange in either word."""
    two = spark.createDataFrame([("Maria Souza",), ("Mraia Souaz",), ("Mario Lima",)], "name string")
    found = {r.name: r.person for r in names.link(two).collect()}
    assert found["Maria Souza"] == found["Mraia Souaz"] != found["Mario Lima"]


def test_middle_names_keep_people_apart(spark):
    rows = ["Ana Maria Silva", "Ana Paula Silva", "Ana M. Silva", "Ana Silva", "Bia Costa Lima", "Bia Lima"]
    found = {r.name: r.person for r in names.link(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert found["Ana Maria Silva"] == found["Ana M. Silva"] != found["Ana Paula Silva"]
    assert found["Ana Silva"] == "Ana Silva"  # it can mean either
    assert found["Bia Costa Lima"] == found["Bia Lima"]


def test_jaro_winkler_decides_two_slips():
    """Of pairs that are two slips apart, two exchanges or a doubled and a lost letter, it takes some and refuses others."""
    rng = random.Random(5)
    letters, verdicts = "abcdefghijklmnopqrstuvwxyz", []
    for _ in range(2000):
        word = [rng.choice(letters) for _ in range(10)]
        other = list(word)
        for i in sorted(rng.sample(range(0, 9, 3), 2), reverse=True):
            if rng.random() < 0.5:
                other[i], other[i + 1] = other[i + 1], other[i]
            else:
                other.insert(i, other[i]) if rng.random() < 0.5 else other.pop(i)
        one, two = "".join(word), "".join(other)
        if names.edits(one, two, 2) == 2:
            verdicts.append((names.word_slips(one, two), names.jaro_winkler(one, two)))
    assert all((v == 2) == (similar >= names.CLOSE) for v, similar in verdicts)
    assert 0.05 < sum(v == 2 for v, _ in verdicts) / len(verdicts) < 0.95


@pytest.mark.parametrize("most", [1, 2])
def test_large_blocks_are_cut_without_loss(spark, most):
    rng = random.Random(most)
    rows = []
    for _ in range(60):
        first, last = "".join(rng.choice("mn") + rng.choice("aeiou") for _ in range(3)), "".join(rng.choice("bp") + rng.choice("aeiou") for _ in range(3))
        slip = last[:2] + rng.choice("aeiou") + last[3:]
        rows += [(f"{first} {last}",), (f"{first} {slip}",), (f"{slip}, {first}",)]
    frame = spark.createDataFrame(rows, "name string")
    whole, split = ({(r.name, r.person) for r in names.link(frame, most=most, hot=hot).collect()} for hot in (10_000, 2))
    assert whole == split


def test_nicknames_are_a_parameter(spark):
    frame = spark.createDataFrame([("Zed Moraes",), ("Zacarias Moraes",)], "name string")
    assert [names.link(frame, nicknames=table).select("person").distinct().count() for table in ({}, {"zed": "zacarias"})] == [2, 1]


def test_strengths_that_do_not_settle_are_an_error(spark):
    frame = spark.createDataFrame([(f"a{i}", f"a{(i * 7 + 1) % 30}") for i in range(30) if i % 4], "winner string, loser string")
    with pytest.raises(RuntimeError, match="not settled"):
        strengths(frame, rounds=1)
    assert strengths(frame).count() > 20


def test_long_sequences_are_shortened_without_loss(monkeypatch):
    rng = np.random.default_rng(3)
    machine = Transducer(3, None, 6, None)
    whole = rng.integers(0, 6, 300)

    def patterns(sequence):
        return {p for pivot, automaton in machine.automata(sequence) for p in machine.outputs(pivot, automaton)}

    for n in (7, 12, 40, 300):
        monkeypatch.setattr(sequences, "LONG", 10_000)
        want = patterns(whole[:n])
        monkeypatch.setattr(sequences, "LONG", 1)
        assert patterns(whole[:n]) == want
        assert len(machine.shortened(whole)) < 80


def test_a_sequence_of_many_events(spark):
    """30,000 places, whose matrix of steps would hold 900 million entries."""
    frame = spark.createDataFrame([([0, 1, 2] * 10_000,), ([0, 1, 2],), ([2, 1, 0],)], "codes array<int>")
    got = {tuple(r.pattern): r.support for r in frequent(frame, 3, least=1, least_share=0.0).collect()}
    assert got[(0, 1, 2)] == 2 and got[(2, 1, 0)] == 2 and got[(1, 0, 2)] == 1


def test_sums_of_stripes_go_on_when_they_grow(spark, monkeypatch):
    rows = [(b, i) for b in range(40) for i in range(b % 7 + 2)]
    frame = spark.createDataFrame(rows, "basket int, item int").selectExpr("cast(basket as string) basket", "cast(item as string) item")
    want = sorted(map(tuple, stripes.together(frame, "basket", "item", 2).collect()))
    batches = [r for b in range(40) if b % 7 for r in [np.arange(b % 7 + 2)]]
    import pyarrow as pa

    monkeypatch.setattr(stripes, "HELD", 3)
    sent = list(stripes._stripes(iter([pa.RecordBatch.from_arrays([pa.array([list(map(int, r)) for r in batches], pa.list_(pa.int64()))], ["items"])])))
    assert len(sent) > 1
    parts = list(stripes._sums(iter(sent)))
    assert len(parts) > 1
    sums = pd.concat([p.to_pandas() for p in parts]).groupby(["item_a", "item_b"])["both"].sum()
    assert sums[(0, 1)] == len(batches) and want


def test_packing_does_not_depend_on_the_partitions(spark):
    frame = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 90 + 5).cast("int").alias("size"))
    one, other = (sorted(map(tuple, packed(frame.repartition(n), "size", 100, "k").collect())) for n in (1, 7))
    assert one == other


def test_marginals_sum_to_one(spark):
    rows = [(i, "abc"[i % 3], "xy"[i % 2], 10 + i % 5) for i in range(90)]
    documents = spark.createDataFrame(rows, "id long, source string, lang string, n int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.mixed(documents, targets, "id", "n", "source", ("lang",))
    told = mixing.marginals(documents, chosen, "id", "n", "source", ("lang",)).collect()
    for marginal in ("source", "lang"):
        assert sum(r.reached_share for r in told if r.marginal == marginal) == pytest.approx(1, abs=1e-4)


def test_letter_pairs_are_counted_as_by_hand():
    frame = pd.DataFrame({"text": ["ao ao", "сок", "aо", "xyz 12", "ＡＢ"]})
    got = {r.pair: r.n for f in lookalike._bigrams(iter([frame])) for r in f.itertuples()}
    assert got["^a"] == 2 and got["ao"] == 2 and got["o$"] == 2  # the word of two scripts counts nowhere
    assert got["^с"] == 1 and got["ок"] == 1 and got["AB"] == 1


def test_texts_read_together_are_those_read_alone(monkeypatch):
    rng = random.Random(2)
    alphabet = "abcо оеа\n​ｅé ёZ9.,ﬁ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", " ", ""]
    reader = lookalike.Canonical({"^a": 5, "ao": 3, "о$": 4, "^о": 9})
    want = [reader.text(t) for t in texts]
    for size in (1, 50, 10_000):
        monkeypatch.setattr(lookalike, "TOGETHER", size)
        assert lookalike.Canonical({"^a": 5, "ao": 3, "о$": 4, "^о": 9}).texts(texts) == want


def test_nulls_and_very_long_texts_keep_their_place(spark):
    texts = ["x" * 200_000, None, "ｆｕｌｌ", "", None, "plain"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = [r.canonical for r in lookalike.one_form(frame).orderBy("i").collect()]
    assert got == ["x" * 200_000, None, "full", "", None, "plain"]


def test_copies_of_one_string_never_pair(spark, tmp_path):
    rows = [(1, "same"), (2, "same"), (3, "sаme"), (4, "same"), (5, ""), (6, ""), (7, "​"), (8, None), (9, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in p10.p10_found(spark, str(tmp_path)).collect()}
    assert got == {(1, 3), (2, 3), (3, 4), (5, 7), (6, 7)}


def test_springs_name(spark):
    assert springs.strengths(spark.createDataFrame([("a", "b"), ("a", "b")], "winner string, loser string")).orderBy("item").first()["strength"] == pytest.approx(2 / 7, abs=1e-6)
