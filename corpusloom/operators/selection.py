"""Exact order statistics and percentiles of large groups, without a buffer that grows with a group.

Two passes: approximate percentiles with a proven error give each group a bracket around the wanted place; then values below
the bracket are only counted, and those inside are counted by value; of small groups all values are inside. The place is found among these counts by a running sum,
which sorts a small share of a group and spills. Both passes sum on the map side, so a hot group is no hot task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of the approximate percentiles: a place is off by n / ACCURACY at most.
ACCURACY = 20_000


@dataclass(frozen=True)
class Place:
    """The value of a measure at a share of its sorted values: interpolated between neighbours, or at floor(n q)."""

    measure: Column
    q: float
    interpolated: bool = True

    def bounds(self, accuracy: int) -> list[float]:
        slack = 3 / accuracy  # the error, and two neighbouring places of a group that is larger than accuracy
        return [max(0.0, self.q - slack), min(1.0, self.q + slack)]

    def ranks(self, n: Column) -> tuple[Column, Column]:
        """The position among values counted from 0, and whether it lies between two."""
        at = F.lit(self.q) * (n - 1) if self.interpolated else F.floor(n * F.lit(self.q)).cast("double")
        return F.floor(at), at


def selected(rows: DataFrame, by: Sequence[str], places: dict[str, Place], also: dict[str, Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """rows by group -> by, the places' values as double, and the aggregates of `also`.

    NULL and NaN are no values; a group without values has NULL. With no columns in by there is one row, for an empty table too."""
    names = list(places)
    value = {k: F.when(~F.isnan(p.measure.cast("double")), p.measure.cast("double")) for k, p in places.items()}
    keyed = rows.select(*by, *(value[k].alias(f"v_{i}") for i, k in enumerate(names)))
    bracket = [
        x
        for i, k in enumerate(names)
        for x in (F.count(f"v_{i}").alias(f"n_{i}"), F.percentile_approx(f"v_{i}", F.array(*map(F.lit, places[k].bounds(accuracy))), accuracy).alias(f"b_{i}"))
    ]
    found = keyed.groupBy(*by).agg(*bracket)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    both = keyed.alias("r").join(found.alias("g"), same) if by else keyed.alias("r").crossJoin(found.alias("g"))  # one row
    one = [F.struct(F.lit(i).alias("t"), F.col(f"r.v_{i}").alias("v"), F.when(F.col(f"g.n_{i}") > accuracy, F.get(f"g.b_{i}", 0)).otherwise(-math.inf).alias("low"), F.when(F.col(f"g.n_{i}") > accuracy, F.get(f"g.b_{i}", 1)).otherwise(math.inf).alias("high")) for i in range(len(names))]
    long = both.select(*(F.col(f"r.{c}").alias(c) for c in by), F.explode(F.array(*one)).alias("x")).where("x.v <= x.high")
    counted = long.groupBy(*by, "x.t", F.when(F.col("x.v") >= F.col("x.low"), F.col("x.v")).alias("v")).agg(F.count("*").alias("m"))
    order = Window.partitionBy(*by, "t").orderBy(F.asc_nulls_first("v"))
    running = counted.withColumn("up_to", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.element_at(F.array(*(F.col(f"n_{i}") for i in range(len(names)))), F.col("t") + 1)
    with_n = running.alias("r").join(found.alias("g"), same).select("r.*", n.alias("n")) if by else running.crossJoin(found).select(*running.columns, n.alias("n"))

    def chosen(pick):
        out = F.lit(None).cast("double")
        for i, k in enumerate(names):
            out = F.when(F.col("t") == i, pick(*places[k].ranks(F.col("n")))).otherwise(out)
        return out

    low, at = chosen(lambda a, b: a.cast("double")), chosen(lambda a, b: b)
    at_rank = lambda r: F.min(F.when(F.col("up_to") > r, F.coalesce("v", F.raise_error(F.lit("a place lies below its bracket")).cast("double"))))
    picked = with_n.groupBy(*by, "t").agg(at_rank(low).alias("a"), at_rank(F.ceil(at)).alias("b"), F.max(at - low).alias("w"))
    result = F.when(F.col("w") == 0, F.col("a")).otherwise((1 - F.col("w")) * F.col("a") + F.col("w") * F.col("b"))
    values = picked.groupBy(*by).agg(*(F.max(F.when(F.col("t") == i, result)).alias(k) for i, k in enumerate(names)))
    base = rows.groupBy(*by).agg(*(c.alias(k) for k, c in (also or {"_n": F.count("*")}).items()))
    wanted = [*(also or ()), *names]
    if not by:
        return base.crossJoin(values).select(*wanted)  # one row each
    return base.alias("r").join(values.alias("g"), same, "left").select(*(F.col(f"r.{c}").alias(c) for c in by), *wanted)


def grouping_sets(rows: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], to: str = "_set") -> DataFrame:
    """Each row once for each set, with NULL in the columns that the set leaves out, and the set's number."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    one = [F.struct(F.lit(i).alias(to), *((F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in columns)) for i, s in enumerate(sets)]
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.explode(F.array(*one)).alias("_one")).select(*rest, "_one.*")
