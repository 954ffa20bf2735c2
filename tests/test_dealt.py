"""Queries with long work on each text deal a table that comes in one part over the cores."""

from corpusloom.operators import rewrite as R
from corpusloom.plans import mining, rewriting  # noqa: F401
from corpusloom import catalog


def test_spoken_form_is_dealt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "spoken_form", lambda docs: seen.append(docs.rdd.getNumPartitions()) or docs)
    catalog.queries()["tx_spoken_form"](spark, "/root/testdata/sf0.001")
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_composition_measures_each_line_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mining.T, "speech_seconds", lambda c: seen.append(c) or mining.F.lit(1.0))
    out = catalog.queries()["ag4_composition"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()
