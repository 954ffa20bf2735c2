"""Scored takes: gates, eligibility, choice of the best take, and reports on the choice.

Scores follow one convention for missing measures: a comparison with NaN or NULL is never true, so a gate that asks for
"at least" fails on them and one that asks for "at most" passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.selection import Place, selected


@dataclass(frozen=True)
class GateRules:
    """Fixed limits beside the calibrated gates, which come as a one-row table."""

    shortest: float = 1.0
    longest: float = 14.5
    longest_of_long: float = 25.0
    least_peak: float = 0.02
    most_clipped: float = 0.001
    pace: tuple[float, float] = (2.6, 8.5)
    pace_from: int = 6
    most_cer: float = 0.02
    long: tuple[str, ...] = ("G1", "G2", "L")
    rising: tuple[str, ...] = ("A1", "A2", "A3")
    no_cer: tuple[str, ...] = ("I",)
    exclaiming: tuple[str, ...] = ("C",)
    cer_of: tuple[tuple[str, float], ...] = (("J", 0.05), ("G1", 0.03), ("G2", 0.03))


def number(c) -> Column:
    """A measure with NaN as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def in_duration(seconds: str, cat: str, rules: GateRules) -> Column:
    limit = F.when(F.col(cat).isin(*rules.long), rules.longest_of_long).otherwise(rules.longest)
    return F.col(seconds).between(F.lit(rules.shortest), limit)


def rejection(rules: GateRules) -> Column:
    """The first failing gate, or NULL. Needs seconds, peak, clipped, syllables, cer, similarity, buzz, ring, range_st, cat
    and the gates min_similarity, min_buzz, max_ring, min_range_st, exclamation_range_st."""
    v = {k: number(k) for k in ("seconds", "peak", "clipped", "cer", "similarity", "buzz", "ring", "range_st")}
    limit = F.when(F.col("cat").isin(*rules.long), rules.longest_of_long).otherwise(rules.longest)
    most = F.lit(rules.most_cer)
    for cat, value in rules.cer_of:
        most = F.when(F.col("cat") == cat, value).otherwise(most)
    pace = F.col("syllables") / F.nullif(v["seconds"], F.lit(0.0))
    at_least = lambda x, gate: F.coalesce(x >= F.col(gate), F.lit(False))
    return (
        F.when(v["seconds"] < rules.shortest, "short")
        .when(v["seconds"] > limit, "long")
        .when(v["peak"] < rules.least_peak, "silent")
        .when(v["clipped"] > rules.most_clipped, "clipped")
        .when((F.col("syllables") >= rules.pace_from) & ~F.coalesce(pace.between(*rules.pace), F.lit(False)), "pace")
        .when(~F.col("cat").isin(*rules.no_cer) & (v["cer"] > most), "misread")
        .when(v["similarity"] < F.col("min_similarity"), "voice")
        .when(v["buzz"] < F.col("min_buzz"), "buzz")
        .when(v["ring"] > F.col("max_ring"), "ring")
        .when(~at_least(v["range_st"], "min_range_st"), "monotone")
        .when(F.col("cat").isin(*rules.exclaiming) & ~at_least(v["range_st"], "exclamation_range_st"), "flat_exclamation")
    )


def eligible(scores: DataFrame, rules: GateRules, question_takes: Sequence) -> DataFrame:
    """Rising categories count only in the listed takes; rows without a score are no take."""
    return scores.where(F.col("cer").isNotNull() & (~F.col("cat").isin(*rules.rising) | F.col("take").isin(*question_takes)))


def judged(scores: DataFrame, gates: DataFrame, rules: GateRules) -> DataFrame:
    """scores with the reason of rejection; gates is one row."""
    return scores.crossJoin(F.broadcast(gates)).withColumn("reason", rejection(rules))


def preference(rules: GateRules) -> Column:
    """Smaller is better: misreadings, then the fall of questions, buzz, similarity, and the earlier take."""
    drop = F.when(F.col("cat").isin(*rules.rising), F.coalesce(-number("end_drop_st"), F.lit(0.0))).otherwise(0.0)
    return F.struct(F.round("cer", 3).alias("cer"), F.round(drop, 1).alias("drop"), (-F.round("buzz", 1)).alias("buzz"), (-F.round("similarity", 3)).alias("sim"), F.col("take").alias("take"))


def margin() -> Column:
    """The distance to the nearest gate, in rough relative units."""
    return F.least((F.col("similarity") - F.col("min_similarity")) / 0.05, F.col("buzz") - F.col("min_buzz"), (F.col("max_ring") - F.col("ring")) / 0.05, (F.col("range_st") - F.col("min_range_st")) / 2.0)


def choose(judged_takes: DataFrame, rules: GateRules) -> DataFrame:
    """One row a sentence: the best passing take with its scores, or the reasons by take. One aggregate, no window."""
    passing = F.col("reason").isNull()
    row = F.struct("take", F.round(margin(), 3).alias("margin"), "end_drop_st", "cer", "buzz", "similarity", "ring", "range_st", "seconds")
    why = F.sort_array(F.collect_list(F.when(~passing, F.struct("take", "reason"))))
    out = judged_takes.groupBy("id", "cat").agg(F.min_by(F.when(passing, row), F.when(passing, preference(rules))).alias("best"), why.alias("why"))
    once = F.map_from_entries(F.filter("why", lambda e, i: (i == 0) | (F.get("why", i - 1)["take"] != e["take"])))  # a take once
    return out.select("id", "cat", "best.*", F.when(F.col("best").isNull(), once).alias("dropped"))


def borderline(chosen: DataFrame, n: int = 25) -> DataFrame:
    """The n takes nearest to a gate, by category."""
    return _nearest(chosen.where("take is not null"), "margin", n)


def _nearest(rows: DataFrame, key: str, n: int) -> DataFrame:
    order = W.partitionBy("cat").orderBy(key, "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def random_rest(chosen: DataFrame, taken: DataFrame, n: int = 25, seed: int = 0) -> DataFrame:
    """n of the others by a seeded hash, by category."""
    rest = chosen.where("take is not null").join(taken.select("id", "cat"), ["id", "cat"], "left_anti")
    return _nearest(rest.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))), "draw", n).drop("draw")


def category_summary(chosen: DataFrame) -> DataFrame:
    """Sentences, kept, dropped and kept share by category."""
    return chosen.groupBy("cat").agg(F.count("*").alias("sentences"), F.count("take").alias("kept"), F.count_if(F.col("take").isNull()).alias("dropped"), F.round(F.count("take") / F.count("*"), 3).alias("kept_share"))


def drop_reasons(chosen: DataFrame) -> DataFrame:
    """Each reason once for a dropped sentence."""
    return chosen.where("take is null").select("cat", F.explode(F.array_distinct(F.map_values("dropped"))).alias("reason")).groupBy("cat", "reason").agg(F.count("*").alias("n"))


def bias_guard(chosen: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Medians of measures, of the chosen takes and of all, ineligible ones included."""
    both = chosen.where("take is not null").select(F.lit("chosen").alias("part"), *keys).unionByName(scores.select(F.lit("all").alias("part"), *keys))
    found = selected(both, ["part"], {k: Place(F.col(k), 0.5) for k in keys})
    return found.select("part", *(F.round(k, 4).alias(k) for k in keys))


def order_statistics(rows: DataFrame, value: str, places: dict[str, float]) -> DataFrame:
    """Values at floor(n q) of the sorted values by category, without interpolation; categories without values are left out."""
    found = selected(rows, ["cat"], {k: Place(F.col(value), q, False) for k, q in places.items()}, {"_n": F.count(number(value))})
    return found.where("_n > 0").drop("_n")


#: The gates as percentiles: measure and share.
GATES = {"min_similarity": ("similarity", 0.02), "min_buzz": ("buzz", 0.10), "max_ring": ("ring", 0.90), "min_range_st": ("range_st", 0.02), "exclamation_range_st": ("range_st", 0.25)}


def calibration(scores: DataFrame) -> DataFrame:
    """The gates as exact percentiles, to four places."""
    found = selected(scores, [], {k: Place(F.col(m), q) for k, (m, q) in GATES.items()})
    return found.select(*(F.round(k, 4).alias(k) for k in GATES))


def against_baseline(rows: DataFrame, baseline: str, key: str = "index", version: str = "version") -> DataFrame:
    """Every version's row with the baseline's row of the same key."""
    base = rows.where(F.col(version) == baseline).select(key, F.struct(*[c for c in rows.columns if c not in (key, version)]).alias("base"))
    return rows.where(F.col(version) != baseline).join(base, key)


def mean_interval(c) -> tuple[Column, Column, Column, Column]:
    """Mean, half width of the 95 % interval, maximum and sum of the finite values."""
    v = number(c)
    return F.round(F.avg(v), 6), F.round(1.96 * F.stddev_samp(v) / F.sqrt(F.count(v)), 6), F.max(v), F.round(F.sum(v), 4)
