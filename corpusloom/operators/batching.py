"""Batches of bounded size for padded input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.mining import numbered_overall

POOL_BATCHES = 50


def frame_budget_batches(rows: DataFrame, frames: str, max_batch: int, budget: int, seed: int = 0, epoch: int = 0, key: str = "id") -> DataFrame:
    """(key, frames, pool, batch, draw): a seeded order is parted into pools of POOL_BATCHES * max_batch rows; in a pool, by
    length, a batch is closed before it would have more rows than max_batch or more padded frames than the budget. A row over
    the budget is an error. draw is the place of a batch in the shuffled order of batches."""
    safe = F.when(F.col(frames) > budget, F.raise_error(F.lit(f"a row exceeds the budget of {budget}"))).otherwise(F.col(frames).cast("long"))
    drawn = rows.select(key, safe.alias("frames"), F.xxhash64(F.lit(seed), F.lit(epoch), key).alias("_h"))
    pools = numbered_overall(drawn, ["_h", key]).withColumn("pool", F.floor((F.col("number") - 1) / (POOL_BATCHES * max_batch)))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frames", "_h"], kind="stable")
        batch, n, out = 0, 0, []
        for f in pdf["frames"].tolist():
            if n and (n + 1 > max_batch or (n + 1) * f > budget):
                batch, n = batch + 1, 0
            n += 1
            out.append(batch)
        return pdf.assign(batch=out)[[key, "frames", "pool", "batch"]]

    kind = dict(rows.dtypes)[key]
    out = pools.groupBy("pool").applyInPandas(cut, f"`{key}` {kind}, frames long, pool long, batch long")
    return out.withColumn("draw", F.xxhash64(F.lit(seed), F.lit(epoch), "pool", "batch"))


def length_class_batches(rows: DataFrame, length: str, classes: list[tuple[int, int]], key: str = "id") -> DataFrame:
    """Fixed-size batches by length class (upper length, batch size), in the order of length and key; only the last batch of a
    class is short. Ranges of length are numbered apart and offset by the ranges before them, so no class is one task's sort."""
    size, name = F.lit(classes[-1][1]), F.lit(len(classes) - 1)
    for i, (most, n) in reversed(list(enumerate(classes[:-1]))):
        size, name = F.when(F.col(length) <= most, n).otherwise(size), F.when(F.col(length) <= most, i).otherwise(name)
    marked = rows.withColumn("class", name).withColumn("_size", size)
    return numbered_overall(marked, [length, key], "class").withColumn("batch", F.floor((F.col("number") - 1) / F.col("_size"))).drop("_size", "number")


def padding_waste(batches: DataFrame, frames: str, *by: str) -> DataFrame:
    """(padded - real) / real."""
    each = batches.groupBy(*by).agg(F.count("*").alias("n"), F.max(frames).alias("most"), F.sum(frames).alias("real"))
    return each.agg(F.count("*").alias("batches"), F.round(F.sum(F.col("n") * F.col("most") - F.col("real")) / F.sum("real"), 6).alias("waste"))
