"""Takes of sentences: line items stand in for takes, their orders for sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import selection as Q
from corpusloom.operators import takes as K
from corpusloom.plans.base import table

RULES = K.GateRules(shortest=3.0, longest=45.0, longest_of_long=49.0, most_clipped=0.99, least_peak=0.001, pace=(0.2, 50.0), most_cer=0.08, cer_of=(("R", 0.09),), long=("R",), rising=("A",), no_cer=("I",), exclaiming=("N",))
QUESTION_TAKES = (1, 2, 3)
GATES = {"min_similarity": 0.01, "min_buzz": 8.0, "max_ring": 0.9, "min_range_st": 2.0, "exclamation_range_st": 6.0}
LI = "t AS (SELECT l_orderkey AS id, l_linenumber AS take, l_returnflag AS cat, l_quantity::DOUBLE AS seconds, (l_partkey % 100) / 100.0::DOUBLE AS peak, (l_suppkey % 1000) / 1000.0::DOUBLE AS clipped, (l_partkey % 40)::INT AS syllables, l_discount::DOUBLE AS cer, l_tax::DOUBLE AS similarity, (l_extendedprice / 1000)::DOUBLE AS buzz, ((l_partkey + l_suppkey) % 100) / 100.0::DOUBLE AS ring, (l_orderkey % 17)::DOUBLE AS range_st, CASE WHEN l_partkey % 5 > 0 THEN (l_suppkey % 7)::DOUBLE END AS end_drop_st FROM lineitem)"
REASON = "CASE WHEN seconds < 3.0 THEN 'short' WHEN seconds > CASE WHEN cat = 'R' THEN 49.0 ELSE 45.0 END THEN 'long' WHEN peak < 0.001 THEN 'silent' WHEN clipped > 0.99 THEN 'clipped' WHEN syllables >= 6 AND NOT syllables / seconds BETWEEN 0.2 AND 50.0 THEN 'pace' WHEN cat <> 'I' AND cer > CASE WHEN cat = 'R' THEN 0.09 ELSE 0.08 END THEN 'misread' WHEN similarity < 0.01 THEN 'voice' WHEN buzz < 8.0 THEN 'buzz' WHEN ring > 0.9 THEN 'ring' WHEN range_st < 2.0 THEN 'monotone' WHEN cat = 'N' AND range_st < 6.0 THEN 'flat_exclamation' END"
JUDGED = f"{LI}, e AS (SELECT * FROM t WHERE cat <> 'A' OR take IN (1, 2, 3)), j AS (SELECT *, {REASON} AS reason FROM e)"
MARGIN = "round(least((similarity - 0.01) / 0.05, buzz - 8.0, (0.9 - ring) / 0.05, (range_st - 2.0) / 2.0), 3)"
PREF = "round(cer, 3), round(CASE WHEN cat = 'A' THEN coalesce(-end_drop_st, 0.0) ELSE 0.0 END, 1), -round(buzz, 1), -round(similarity, 3), take"
CHOSEN = f"{JUDGED}, b AS (SELECT * FROM (SELECT *, {MARGIN} AS margin, row_number() OVER (PARTITION BY id, cat ORDER BY {PREF}) AS rn FROM j WHERE reason IS NULL) WHERE rn = 1), c AS (SELECT s.id, s.cat, b.take, b.margin, b.end_drop_st, b.cer, b.buzz, b.similarity, b.ring, b.range_st, b.seconds FROM (SELECT DISTINCT id, cat FROM j) s LEFT JOIN b USING (id, cat))"


def scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("take"), F.col("l_returnflag").alias("cat"), F.col("l_quantity").cast("double").alias("seconds"), (F.col("l_partkey") % 100 / 100.0).alias("peak"), (F.col("l_suppkey") % 1000 / 1000.0).alias("clipped"),
        (F.col("l_partkey") % 40).cast("int").alias("syllables"), F.col("l_discount").cast("double").alias("cer"), F.col("l_tax").cast("double").alias("similarity"), (F.col("l_extendedprice") / 1000).cast("double").alias("buzz"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 100 / 100.0).alias("ring"), (F.col("l_orderkey") % 17).cast("double").alias("range_st"), F.when(F.col("l_partkey") % 5 > 0, (F.col("l_suppkey") % 7).cast("double")).alias("end_drop_st"),
    )


def gates(spark):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in GATES.items()))


def judged(spark, sf):
    return K.judged(K.eligible(scores(spark, sf), RULES, QUESTION_TAKES), gates(spark), RULES)


def chosen(spark, sf):
    return K.choose(judged(spark, sf), RULES)


query("fl6_duration", f"WITH {LI} SELECT id, take FROM t WHERE seconds BETWEEN 3.0 AND CASE WHEN cat = 'R' THEN 49.0 ELSE 45.0 END")(lambda spark, sf: scores(spark, sf).where(K.in_duration("seconds", "cat", RULES)).select("id", "take"))
query("fl7_gate_chain", f"WITH {JUDGED} SELECT id, take, reason FROM j")(lambda spark, sf: judged(spark, sf).select("id", "take", "reason"))
query("fl8_eligible", f"WITH {JUDGED} SELECT id, take, cat FROM e")(lambda spark, sf: K.eligible(scores(spark, sf), RULES, QUESTION_TAKES).select("id", "take", "cat"))
query("jn7_one_row_gates", f"WITH {LI} SELECT id, take, buzz >= 8.0 AS loud FROM t")(lambda spark, sf: scores(spark, sf).crossJoin(F.broadcast(gates(spark))).select("id", "take", (F.col("buzz") >= F.col("min_buzz")).alias("loud")))
query("wn2_best_take", f"WITH {CHOSEN} SELECT id, cat, take, cer FROM c")(lambda spark, sf: chosen(spark, sf).select("id", "cat", "take", "cer"))
query("wn3_borderline", f"WITH {CHOSEN} SELECT cat, id, take, margin, rank FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY margin, id)::INT AS rank FROM c WHERE take IS NOT NULL) WHERE rank <= 25")(lambda spark, sf: K.borderline(chosen(spark, sf)).select("cat", "id", "take", "margin", "rank"))


@query("wn4_random_rest", f"WITH {CHOSEN}, nearest AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY margin, id) AS near FROM c WHERE take IS NOT NULL) SELECT cat, id, take, rank FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY md5('0:' || id), id)::INT AS rank FROM nearest WHERE near > 25) WHERE rank <= 25")
def wn4_random_rest(spark, sf):
    picked = chosen(spark, sf)
    return K.random_rest(picked, K.borderline(picked)).select("cat", "id", "take", "rank")


query("jn1_sentences_with_takes", f"WITH {LI} SELECT o_orderkey AS id, count(take)::BIGINT AS n, min(cer) AS least_cer FROM orders LEFT JOIN t ON o_orderkey = id GROUP BY 1")(lambda spark, sf: table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(scores(spark, sf), "id", "left").groupBy("id").agg(F.count("take").alias("n"), F.min("cer").alias("least_cer")))
query("jn2_chosen_scores", f"WITH {CHOSEN} SELECT t.id, t.take, t.buzz, t.ring FROM c JOIN t USING (id, take)")(lambda spark, sf: chosen(spark, sf).select("id", "take").join(scores(spark, sf), ["id", "take"]).select("id", "take", "buzz", "ring"))


def versions(spark, sf):
    return scores(spark, sf).select(F.concat(F.lit("v"), F.col("take")).alias("version"), F.col("id").alias("index"), "cat", "seconds", "buzz", "range_st")


@query("jn3_against_baseline", f"WITH {LI} SELECT a.id AS index, 'v' || a.take AS version, round(a.buzz / b.buzz, 6) AS ratio, round(a.seconds - b.seconds, 6) AS diff FROM t a JOIN t b ON a.id = b.id AND b.take = 1 WHERE a.take <> 1")
def jn3_against_baseline(spark, sf):
    return K.against_baseline(versions(spark, sf), "v1").select("index", "version", F.round(F.col("buzz") / F.col("base.buzz"), 6).alias("ratio"), F.round(F.col("seconds") - F.col("base.seconds"), 6).alias("diff"))


@query("ag7_gap_medians", f"WITH {LI} SELECT 'v' || a.take AS version, round(median(a.buzz / b.buzz), 6) AS ratio, round(median(a.seconds - b.seconds), 6) AS diff, round(median(a.range_st - b.range_st) FILTER (WHERE a.cat = 'A'), 6) AS rising_diff FROM t a JOIN t b ON a.id = b.id AND b.take = 1 WHERE a.take <> 1 GROUP BY 1")
def ag7_gap_medians(spark, sf):
    both = K.against_baseline(versions(spark, sf), "v1")
    gaps = {"ratio": F.col("buzz") / F.col("base.buzz"), "diff": F.col("seconds") - F.col("base.seconds"), "rising_diff": F.when(F.col("cat") == "A", F.col("range_st") - F.col("base.range_st"))}
    found = Q.selected(both, ["version"], {k: Q.Place(c, 0.5) for k, c in gaps.items()})
    return found.select("version", *(F.round(k, 6).alias(k) for k in gaps))


query("ag5_calibration", f"WITH {LI} SELECT round(quantile_cont(similarity, 0.02), 4) AS min_similarity, round(quantile_cont(buzz, 0.1), 4) AS min_buzz, round(quantile_cont(ring, 0.9), 4) AS max_ring, round(quantile_cont(range_st, 0.02), 4) AS min_range_st, round(quantile_cont(range_st, 0.25), 4) AS exclamation_range_st FROM t")(lambda spark, sf: K.calibration(scores(spark, sf)))


@query("ag6_version_medians", f"WITH {LI} SELECT take, cat, count(*)::BIGINT AS n, round(median(buzz), 6) AS buzz, round(median(end_drop_st), 6) AS drop_st FROM t GROUP BY GROUPING SETS ((take), (take, cat))")
def ag6_version_medians(spark, sf):
    rows = Q.grouping_sets(scores(spark, sf).select("take", "cat", "buzz", "end_drop_st"), ["take", "cat"], [["take"], ["take", "cat"]])
    found = Q.selected(rows, ["_set", "take", "cat"], {"buzz": Q.Place(F.col("buzz"), 0.5), "drop_st": Q.Place(F.col("end_drop_st"), 0.5)}, {"n": F.count("*")})
    return found.select("take", "cat", "n", F.round("buzz", 6).alias("buzz"), F.round("drop_st", 6).alias("drop_st"))


@query("ag8_mean_interval", f"WITH {LI} SELECT cat, round(avg(buzz), 6) AS mean, round(1.96 * stddev_samp(buzz) / sqrt(count(buzz)), 6) AS half_width, max(buzz) AS most, round(sum(seconds), 4) AS seconds FROM t GROUP BY cat")
def ag8_mean_interval(spark, sf):
    mean, half, most, _ = K.mean_interval("buzz")
    return scores(spark, sf).groupBy("cat").agg(mean.alias("mean"), half.alias("half_width"), most.alias("most"), K.mean_interval("seconds")[3].alias("seconds"))


query("ag12_category_summary", f"WITH {CHOSEN} SELECT cat, count(*)::BIGINT AS sentences, count(take)::BIGINT AS kept, count(*) FILTER (WHERE take IS NULL)::BIGINT AS dropped, round(count(take) / count(*)::DOUBLE, 3) AS kept_share FROM c GROUP BY cat")(lambda spark, sf: K.category_summary(chosen(spark, sf)))
query("ag12_drop_reasons", f"WITH {CHOSEN} SELECT cat, reason, count(DISTINCT id)::BIGINT AS n FROM (SELECT id, cat, take, min(reason) AS reason FROM j GROUP BY ALL) JOIN (SELECT id, cat FROM c WHERE take IS NULL) USING (id, cat) GROUP BY cat, reason")(lambda spark, sf: K.drop_reasons(chosen(spark, sf)))
query("ag13_pass_rate", f"WITH {JUDGED} SELECT take, count(*)::BIGINT AS seen, round(avg((reason IS NULL)::INT), 6) AS pass_rate FROM j GROUP BY take")(lambda spark, sf: judged(spark, sf).groupBy("take").agg(F.count("*").alias("seen"), F.round(F.avg(F.col("reason").isNull().cast("int")), 6).alias("pass_rate")))
query("ag13_chosen_takes", f"WITH {CHOSEN} SELECT take, count(*)::BIGINT AS n FROM c WHERE take IS NOT NULL GROUP BY take")(lambda spark, sf: chosen(spark, sf).where("take is not null").groupBy("take").agg(F.count("*").alias("n")))
GUARD = ("buzz", "ring", "range_st", "similarity", "cer")
query("ag14_bias_guard", f"WITH {CHOSEN}, g AS (SELECT 'chosen' AS part, {', '.join(GUARD)} FROM c WHERE take IS NOT NULL UNION ALL SELECT 'all', {', '.join(GUARD)} FROM t) SELECT part, {', '.join(f'round(median({k}), 4) AS {k}' for k in GUARD)} FROM g GROUP BY part")(lambda spark, sf: K.bias_guard(chosen(spark, sf), scores(spark, sf), GUARD))
query("ag15_order_statistics", f"WITH {CHOSEN} SELECT cat, list_sort(list(end_drop_st) FILTER (WHERE end_drop_st IS NOT NULL))[(count(end_drop_st) // 10 + 1)] AS p10, list_sort(list(end_drop_st) FILTER (WHERE end_drop_st IS NOT NULL))[(count(end_drop_st) // 2 + 1)] AS p50 FROM c WHERE take IS NOT NULL GROUP BY cat")(lambda spark, sf: K.order_statistics(chosen(spark, sf).where("take is not null"), "end_drop_st", {"p10": 0.1, "p50": 0.5}))


@query("ag16_quality_report", f"WITH {CHOSEN} SELECT cat, take, count(*)::BIGINT AS n, round(sum(seconds) / 3600, 6) AS hours, round(median(seconds), 6) AS median_seconds FROM c GROUP BY GROUPING SETS ((cat), (take), ())")
def ag16_quality_report(spark, sf):
    rows = Q.grouping_sets(chosen(spark, sf).select("cat", "take", "seconds"), ["cat", "take"], [["cat"], ["take"], []])
    found = Q.selected(rows, ["_set", "cat", "take"], {"median_seconds": Q.Place(F.col("seconds"), 0.5)}, {"n": F.count("*"), "hours": F.round(F.sum("seconds") / 3600, 6)})
    return found.select("cat", "take", "n", "hours", F.round("median_seconds", 6).alias("median_seconds"))


@query("ag19_contour_summary", f"WITH {LI}, s AS (SELECT id, bool_or(range_st >= 2 AND end_drop_st < 1) AS any_take FROM t GROUP BY id) SELECT (SELECT round(avg((buzz > 50)::INT), 6) FROM t) AS jump_share, (SELECT round(median(range_st), 6) FROM t) AS range_st, (SELECT round(avg((range_st >= 2 AND coalesce(end_drop_st < 1, false))::INT), 6) FROM t) AS shape_share, (SELECT count(*) FILTER (WHERE any_take) FROM s)::BIGINT AS sentences")
def ag19_contour_summary(spark, sf):
    shape = (F.col("range_st") >= 2) & F.coalesce(F.col("end_drop_st") < 1, F.lit(False))
    rows = scores(spark, sf)
    also = {"jump_share": F.round(F.avg((F.col("buzz") > 50).cast("int")), 6), "shape_share": F.round(F.avg(shape.cast("int")), 6)}
    one = Q.selected(rows, [], {"range_st": Q.Place(F.col("range_st"), 0.5)}, also).withColumn("range_st", F.round("range_st", 6))
    any_take = rows.groupBy("id").agg(F.bool_or(shape).alias("any_take")).agg(F.count_if("any_take").alias("sentences"))
    return one.crossJoin(any_take)  # one row each


@query("ag20_seed_stability", f"WITH {LI}, s AS (SELECT id, sum((cer > 0.05)::INT) AS f, count(*) AS n FROM t GROUP BY id) SELECT round(avg((f = 0)::INT), 6) AS never, round(avg((f > 0 AND f < n)::INT), 6) AS sometimes, round(avg((f = n)::INT), 6) AS always, round(sum(f) / sum(n)::DOUBLE, 6) AS clip_rate FROM s")
def ag20_seed_stability(spark, sf):
    by = scores(spark, sf).groupBy("id").agg(F.sum((F.col("cer") > 0.05).cast("int")).alias("f"), F.count("*").alias("n"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return by.agg(share(F.col("f") == 0).alias("never"), share((F.col("f") > 0) & (F.col("f") < F.col("n"))).alias("sometimes"), share(F.col("f") == F.col("n")).alias("always"), F.round(F.sum("f") / F.sum("n"), 6).alias("clip_rate"))


@query("ag20_always_failing", f"WITH {LI}, s AS (SELECT id, bool_and(cer > 0.05) AS always FROM t WHERE take > 1 GROUP BY id) SELECT id FROM s JOIN (SELECT id FROM t WHERE take = 1 AND cer <= 0.05) USING (id) WHERE always")
def ag20_always_failing(spark, sf):
    rows = scores(spark, sf)
    always = rows.where("take > 1").groupBy("id").agg(F.bool_and(F.col("cer") > 0.05).alias("always")).where("always").select("id")
    return always.join(rows.where("take = 1 and cer <= 0.05").select("id"), "id")


query("ag22_real_time_factor", f"WITH {LI} SELECT cat, round(sum(buzz) / sum(seconds), 6) AS factor FROM t GROUP BY cat")(lambda spark, sf: scores(spark, sf).groupBy("cat").agg(F.round(F.sum("buzz") / F.sum("seconds"), 6).alias("factor")))
SUBSETS = {"every": "true", "test": "id % 5 = 0", "listen": "id % 7 = 0"}
query("ag23_candidates", f"WITH {LI} SELECT take, {', '.join(f'round(avg({m}) FILTER (WHERE {w}), 6) AS {m}_{k}' for m in ('buzz', 'cer', 'ring') for k, w in SUBSETS.items())} FROM t GROUP BY take")(lambda spark, sf: scores(spark, sf).groupBy("take").agg(*(F.round(F.avg(F.when(F.expr(w), K.number(m))), 6).alias(f"{m}_{k}") for m in ("buzz", "cer", "ring") for k, w in SUBSETS.items())))
query("dd7_keys_in_both", f"WITH {LI} SELECT DISTINCT a.id FROM t a JOIN t b USING (id) WHERE a.take = 1 AND b.take = 4")(lambda spark, sf: scores(spark, sf).where("take = 1").select("id").intersect(scores(spark, sf).where("take = 4").select("id")))
query("dd8_without_borderline", f"WITH {CHOSEN}, r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY margin, id) AS rank FROM c WHERE take IS NOT NULL) SELECT id, cat FROM r WHERE rank > 25")(lambda spark, sf: (lambda c: c.where("take is not null").join(K.borderline(c).select("id", "cat"), ["id", "cat"], "left_anti").select("id", "cat"))(chosen(spark, sf)))
query("cl3_speed_tier", "SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 'failed' WHEN value / 100 <= 0.5 THEN 'fast' WHEN value / 100 <= 1.5 THEN 'usable' ELSE 'slow' END AS tier FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", F.when(F.col("value").isNull() | (F.col("value") <= 0), "failed").when(F.col("value") / 100 <= 0.5, "fast").when(F.col("value") / 100 <= 1.5, "usable").otherwise("slow").alias("tier")))


@query("cl4_best_backend", "WITH b AS (SELECT user_id, min(value) FILTER (WHERE event_type = 'click') AS gpu, min(value) FILTER (WHERE event_type <> 'click') AS cpu, min_by(event_type, value) FILTER (WHERE event_type <> 'click') AS cpu_name FROM (SELECT user_id, event_type, avg(value) AS value FROM events WHERE value > 0 GROUP BY ALL) GROUP BY user_id) SELECT user_id, CASE WHEN gpu IS NOT NULL AND (cpu IS NULL OR gpu * 1.2 <= cpu) THEN 'click' ELSE cpu_name END AS backend FROM b")
def cl4_best_backend(spark, sf):
    gpu, mean = F.col("event_type") == "click", table(spark, sf, "events").where("value > 0").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    by = mean.groupBy("user_id").agg(F.min(F.when(gpu, F.col("value"))).alias("gpu"), F.min(F.when(~gpu, F.col("value"))).alias("cpu"), F.min_by(F.when(~gpu, F.col("event_type")), F.when(~gpu, F.col("value"))).alias("cpu_name"))
    return by.select("user_id", F.when(F.col("gpu").isNotNull() & (F.col("cpu").isNull() | (F.col("gpu") * 1.2 <= F.col("cpu"))), "click").otherwise(F.col("cpu_name")).alias("backend"))


@query("io6_wide_to_long", f"WITH {LI} SELECT id, take, version, value FROM (SELECT id, take, seconds, buzz, ring FROM t) UNPIVOT (value FOR version IN (seconds, buzz, ring))")
def io6_wide_to_long(spark, sf):
    return scores(spark, sf).select("id", "take", "seconds", "buzz", "ring").unpivot(["id", "take"], ["seconds", "buzz", "ring"], "version", "value")
