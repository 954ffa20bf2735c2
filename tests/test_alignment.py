"""Alignments of whole batches of pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment as A
from corpusloom.plans import errors


def pairs(seed, n=200):
    """Pairs of lists, of which some have equal lengths, shifted items, or nulls."""
    r = random.Random(seed)
    out = [(None, ["a"]), (["a"], None), ([], []), ([], ["a"]), (["a", "b"], ["b", "a"]), (["a", "b", "a"], ["x", "b", "y"])]
    for _ in range(n):
        a = [r.choice("abcdé𐐨") for _ in range(r.randrange(9))]
        b = [r.choice("01") if r.random() < 0.3 else x for x in a] if r.random() < 0.5 else [x for x in a if r.random() < 0.8] + [r.choice("ab") for _ in range(r.randrange(3))]
        out.append((a, b))
    return out


def listed(of):
    return [pa.array(x, pa.list_(pa.string())) for x in zip(*of, strict=True)]


@pytest.mark.parametrize("seed", range(5))
def test_steps_of_a_batch_are_those_of_each_pair(seed):
    of = pairs(seed)
    want = [[] if a is None or b is None else A.alignment(a, b) for a, b in of]
    assert A.align.func(*listed(of)).to_pylist() == want
    assert A.align.func(*(x.slice(3, 50) for x in listed(of))).to_pylist() == want[3:53]


def test_letters_are_counted_by_batch_without_a_table_for_each_pair(spark, monkeypatch):
    rows = spark.createDataFrame([("m", "ab ab", "ab 0b"), ("m", "ab", "abc"), ("m", "b", "b"), ("n", "é𐐨", "é"), ("m", None, "a")], "version string, text string, hyp string")
    counted = A.letter_operations(rows.coalesce(1))
    got = {(r.version, r.op, r.ref, r.hyp): r.n for r in counted.collect()}
    assert got == {("m", "ok", "a", "a"): 2, ("m", "ok", "b", "b"): 4, ("m", "ok", " ", " "): 1, ("m", "sub", "a", "0"): 1, ("m", "ins", None, "c"): 1, ("n", "ok", "é", "é"): 1, ("n", "del", "𐐨", None): 1}
    errors = {r.ref: (r.n, r.rate) for r in A.letter_errors(counted, "m", "n", 1).collect()}
    assert errors == {"a": (3, 0.333333), "b": (4, 0.0)}
    # replaced letters that are in no text need no table of costs
    monkeypatch.setattr(A, "alignment", lambda *a: 1 / 0)
    long = "the whole line " * 2000
    assert [len(x) for x in A.align.func(pa.array([list(long)]), pa.array([list(long.replace("e", "0"))])).to_pylist()] == [30_000]


def test_a_table_in_one_part_is_dealt_over_the_cores(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.range(100).selectExpr("id doc_id", "'a b. c' text", "'s' source").coalesce(1).write.parquet(path)
    parts = errors.transcripts(spark, str(tmp_path)).rdd.getNumPartitions()
    assert parts >= spark.sparkContext.defaultParallelism


def test_confusions_of_counted_letters(spark):
    rows = spark.createDataFrame([("m", "aab", "a0b")] * 3 + [("m", "abc", "ab"), ("m", "c", "a")], "version string, text string, hyp string")
    got = [(r.swap, r.n, r.rank) for r in A.confusions(A.letter_operations(rows), 2).orderBy("rank").collect()]
    assert got == [("a>0", 3, 1), ("c>a", 1, 2)]


TOLD = [(1, "m", "one two three four", "one 0 three 00"), (1, "b", "one two three four", "0 two three 00"), (2, "m", "two", "0"), (2, "b", "two", "two"), (3, "m", "a b c", "a x b c"), (4, "m", "", "a")]


def told(spark):
    return A.aligned(spark.createDataFrame(TOLD, "row_id long, version string, text string, hyp string"))


def test_places_are_summed_without_a_row_for_each_word(spark):
    out = A.position_errors(told(spark))
    assert {(r.version, r.place): (r.rate, r.n) for r in out.collect()} == {("m", "first"): (0.333333, 3), ("m", "middle"): (0.333333, 3), ("m", "last"): (0.5, 2), ("b", "first"): (0.5, 2), ("b", "middle"): (0.0, 2), ("b", "last"): (1.0, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode" not in plan


def test_words_that_only_the_model_misses(spark):
    out = A.model_only(told(spark), "m", "b")
    assert [(r.ref, r.n, r.heard_as) for r in out.collect()] == [("two", 2, "0")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # the versions of a row meet in one pass


def test_scores_of_long_rows(spark):
    long = "the whole line " * 1500
    rows = spark.createDataFrame([("a", long, long.replace("e", "0")), ("b", "kitten", "sitting"), ("c", None, "x"), ("d", "one two", "")], "version string, text string, hyp string")
    got = {r.version: (r.words, r.wrong, r.letters, r.wrong_letters, r.broken) for r in A.scored(rows).collect()}
    wrong = long.count("e")
    assert {k: got[k] for k in "abd"} == {"a": (4500, 4500, 18_000, wrong, True), "b": (1, 1, 6, 3, True), "d": (2, 2, 6, 6, True)}


@pytest.mark.parametrize("most", [0, 20, 1 << 14])
def test_distances_of_letters(spark, monkeypatch, most):
    monkeypatch.setattr(A, "MOST_CELLS", most)
    of = [tuple(None if x is None else "".join(x) for x in p) for p in pairs(7)]
    want = [None if None in p else A.distance(*map(list, p)) for p in of]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(of)], "i int, text string, hyp string").coalesce(1)
    assert [r.d for r in rows.select("i", A.letter_distance(F.col("text"), F.col("hyp")).alias("d")).orderBy("i").collect()] == want
    known = A.Pairs(*(pa.array(x, pa.string()) for x in zip(*of, strict=True))).distances(most).to_pylist()
    assert all(k in (None, w) for k, w in zip(known, want, strict=True)) and (most or known == want)


def test_operations_keep_rows_versions_and_places(spark):
    rows = spark.createDataFrame(TOLD, "row_id long, version string, text string, hyp string")
    got = [(r.pos, r.op, r.ref, r.hyp) for r in A.operations(rows).where("row_id = 3").orderBy("pos").collect()]
    assert got == [(0, "ok", "a", "a"), (1, "ins", None, "x"), (2, "ok", "b", "b"), (3, "ok", "c", "c")]
    assert A.operations(rows.where("row_id = 4")).select("op").first()[0] == "ins"
    import inspect

    assert "letters" not in inspect.signature(A.operations).parameters  # letters are counted, not listed


def test_word_distances_of_a_batch():
    of = pairs(11)
    assert A.word_distance.func(*listed(of)).to_pylist() == [None if None in p else A.distance(*p) for p in of]
