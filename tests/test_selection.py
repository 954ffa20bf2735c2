"""Exact percentiles by brackets against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import selection as S

QS = (0.0, 0.02, 0.25, 0.5, 0.9, 1.0)


def rows_of(n, seed):
    g = random.Random(seed)
    make = [lambda: g.gauss(0, 1), lambda: float(g.randint(0, 3)), lambda: 5.0, lambda: g.random() ** 40, lambda: None, lambda: math.nan]
    out = []
    for _ in range(n):
        k = g.choice(["a", "a", "a", "b", None])
        out.append((k, make[{"a": 0, "b": 1, None: 3}[k]]() if g.random() < 0.9 else g.choice(make[4:])(), make[g.choice([2, 0])]()))
    return [*out, ("none", None, math.nan), ("one", 7.0, -1.0), ("two", 1.0, 2.0), ("two", 2.0, 2.0)]


@pytest.mark.parametrize(("n", "accuracy"), [(3000, 20_000), (3000, 100), (40, 10), (3000, 25)])
def test_places_equal_sorting(spark, n, accuracy):
    data = rows_of(n, n)
    df = spark.createDataFrame(data, "cat string, x double, y double").repartition(4)
    places = {f"{m}_{i}_{kind}": S.Place(F.col(m), q, kind == "cont") for m in "xy" for i, q in enumerate(QS) for kind in ("cont", "index") if kind == "cont" or q < 1}
    got = {r.cat: r for r in S.selected(df, ["cat"], places, {"n": F.count("*")}, accuracy).collect()}
    assert set(got) == {k for k, *_ in data}
    for k, r in got.items():
        assert r.n == sum(d[0] == k for d in data)
        for m, col in (("x", 1), ("y", 2)):
            v = sorted(d[col] for d in data if d[0] == k and d[col] is not None and not math.isnan(d[col]))
            for i, q in enumerate(QS):
                want = float(np.percentile(v, 100 * q)) if v else None
                assert r[f"{m}_{i}_cont"] == (want if want is None else pytest.approx(want, abs=1e-12))
                if q < 1:
                    assert r[f"{m}_{i}_index"] == (v[math.floor(len(v) * q)] if v else None)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "x double")
    assert [tuple(r) for r in S.selected(df, [], {"half": S.Place(F.col("x"), 0.5)}).collect()] == [(3.0,)]
    assert [tuple(r) for r in S.selected(df.limit(0), [], {"half": S.Place(F.col("x"), 0.5)}, {"n": F.count("*")}).collect()] == [(0, None)]
    assert S.selected(df.limit(0).withColumn("k", F.lit(1)), ["k"], {"half": S.Place(F.col("x"), 0.5)}).count() == 0


def test_no_buffer_holds_a_group(spark):
    """The plan has no exact percentile and collects no list."""
    plan = S.selected(spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x")), ["k"], {"half": S.Place(F.col("x"), 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and "collect_list" not in plan and "percentile(" not in plan


def test_grouping_sets(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 6.0)], "c string, t int, x double")
    got = S.grouping_sets(df, ["c", "t"], [["c"], ["t"], []]).groupBy("_set", "c", "t").agg(F.sum("x").alias("x")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, "a", None, 6.0), (0, None, None, 6.0), (1, None, 1, 8.0), (1, None, 2, 4.0), (2, None, None, 12.0)], key=repr)
