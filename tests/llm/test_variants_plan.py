"""The joins of op13 as Spark plans them."""

from corpusloom.llm import variants as V
from corpusloom.llm.store import written


def test_neighbours_are_never_broadcast(spark):
    words = spark.createDataFrame([("abcdef", 9), ("abcdeg", 5), ("zzzzzz", 5)], "word string, n long")
    pairs = V.near_pairs(written(V.coded(words)))
    assert {(r.word, r.near) for r in pairs.collect()} == {("abcdef", "abcdeg"), ("abcdeg", "abcdef")}
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
