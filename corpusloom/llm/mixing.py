"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame and SQL functions only.

1. Sources get targets: weight times a common level, stopped at ``cap`` times the source's size, the excess reshared.
2. A source's documents fall into blocks by hash. A target is whole passes over the source plus a part of one more: the
   first blocks of a permuted order, the block at the edge filled document by document.
3. All (pass, block) pairs are dealt to the output shards: at every node of a binary tree the exact counts by source are
   split by hypergeometric draws, each conditioned on the draws before it. Then each shard takes its quota of every
   source from the permuted blocks, disjoint from the other shards, and sorts its rows by a hash.

No source is sorted or collected as a whole: a source has at most MAX_BLOCKS blocks, and only blocks are ranked.

Edge cases: a null or empty text has size 0 and is taken as often as its block, which adds no words; a null source is a
source of its own, the last; rows that repeat (doc_id, source, size) are taken or left together; an empty table gives an
empty table; further columns pass through, but for one named shard, which the added one replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.store import WORD, read, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SHARDS = 16
#: Documents in a block, unless a source would then have more than MAX_BLOCKS blocks.
BLOCK_DOCS = 128
MAX_BLOCKS = 65_536


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size, n_docs) rows summed by source -> s_idx, source_size, source_docs, target. One row a source."""
    by = units.groupBy("source").agg(F.sum("unit_size").alias("source_size"), F.count("*").alias("source_docs"))
    order = W.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("s_idx", (F.row_number().over(order) - 1).cast("int"))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("s_idx") % len(weights) + 1))
    by = by.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    # Sources in the order in which a rising level reaches their limits; those reached form a prefix of it.
    rise = W.orderBy(F.col("limit") / F.col("weight"), "s_idx")
    before, every = rise.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    by = by.withColumn("left_words", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    by = by.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("left_words") / F.col("left_weight"))
    by = by.withColumn("full", F.col("weight") * F.col("level") >= F.col("limit"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("weight"), -F.col("s_idx"), "level"))).over(every)["level"]
    by = by.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level)))
    return by.select("source", "s_idx", "source_size", "source_docs", "target")


def _uniform(*cols) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of the marked are among so many drawn from total: the inverse of the distribution function at u.

    Weights follow from the ratio of neighbouring probabilities and are kept as logarithms against the largest, so no
    factorial is formed. One pass finds the sum, the next the place."""
    lo = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    hi = F.least(drawn, marked)

    def step(x):  # log p(x + 1) - log p(x)
        return F.log((marked - x) * (drawn - x).cast("double") / ((x + 1) * (total - marked - drawn + x + 1)))

    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

    def add(acc, x):
        at = acc["at"] + step(x)
        top = F.greatest(acc["top"], at)
        return F.struct(at.alias("at"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(at - top)).alias("sum"))

    xs = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<long>"))
    whole = F.aggregate(xs, start, add)

    def find(w):
        aim = u * w["sum"]
        first = F.struct(F.lit(0.0).alias("at"), F.exp(-w["top"]).alias("cum"), lo.alias("x"))

        def look(acc, x):
            at = acc["at"] + step(x)
            return F.struct(at.alias("at"), (acc["cum"] + F.exp(at - w["top"])).alias("cum"), F.when(acc["cum"] < aim, x + 1).otherwise(acc["x"]).alias("x"))

        return F.aggregate(xs, first, look, lambda acc: acc["x"])

    return F.element_at(F.transform(F.array(whole), find), 1)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(s_idx, n) -> one row per shard with counts array<struct<s_idx, n>>; the counts by source add up exactly.

    One array holds a count for each source, so its length is the number of sources, not of rows."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("s_idx", "n"))).alias("counts")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    while True:
        width = F.col("hi") - F.col("lo")
        mid = F.col("lo") + F.ceil(width / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])
        # shards get equal room; of an uneven rest, the left half takes the part above
        node = node.withColumn("total", total).withColumn("room", F.when(width > 1, F.ceil(F.col("total") * (mid - F.col("lo")) / width)).otherwise(F.col("total")).cast("long"))
        start = F.struct(F.col("total").alias("rest"), F.col("room").alias("room"), F.array().cast("array<struct<s_idx:int,n:long>>").alias("out"))

        def draw(acc, c):
            n = hypergeometric(acc["rest"], c["n"], acc["room"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), c["s_idx"]))
            return F.struct((acc["rest"] - c["n"]).alias("rest"), (acc["room"] - n).alias("room"), F.concat(acc["out"], F.array(F.struct(c["s_idx"].alias("s_idx"), n.alias("n")))).alias("out"))

        left = F.when(width > 1, F.aggregate("counts", start, draw, lambda a: a["out"])).otherwise(F.col("counts"))
        node = node.withColumn("left", left)
        right = F.zip_with("counts", "left", lambda c, l: F.struct(c["s_idx"].alias("s_idx"), (c["n"] - l["n"]).alias("n")))
        halves = F.when(width > 1, F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("left").alias("counts")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"), right.alias("counts")))).otherwise(F.array(F.struct("lo", "hi", "counts")))
        node = node.select(F.explode(halves).alias("h")).select("h.*")
        shards = (shards + 1) // 2
        if shards == 1:
            return node.select(F.col("lo").alias("shard"), "counts")


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """One row per distinct (doc_id, source, size): n_rows, source_size, target and shards, the shard of each copy taken."""
    spark = docs.sparkSession
    units = written(docs.select("doc_id", "source", word_count("text").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")).withColumn("unit_size", F.col("n_rows") * F.col("size")))
    stats = written(source_targets(units, weights, share, cap))
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_docs") / BLOCK_DOCS)))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), n_blocks).cast("int")
    # the sources are few beside the documents: Spark broadcasts them if they are small enough, else it splits hot ones
    units = units.alias("u").join(stats.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    units = units.select("u.*", "s_idx", "source_size", "target", block.alias("block"))

    blocks = units.groupBy("s_idx", "block").agg(F.sum("unit_size").alias("words"))
    need = stats.select("s_idx", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("passes"), F.col("target"), F.col("source_size"))
    need = need.withColumn("passes", F.least(F.lit(cap), F.col("passes"))).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = blocks.join(need.select("s_idx", "passes", "rest"), "s_idx")
    order = W.partitionBy("s_idx").orderBy(F.xxhash64(F.lit(seed + 1), "s_idx", "block"), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    whole = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("passes") < cap)
    edge = ~whole & (F.col("before") < F.col("rest")) & (F.col("passes") < cap)
    blocks = blocks.withColumn("edge", edge).withColumn("copies", F.col("passes") + (whole | edge).cast("int"))
    blocks = written(blocks.withColumn("room", F.when(F.col("edge"), F.col("rest") - F.col("before"))))

    # every copy of a block is one thing to deal out, in an order permuted anew for each pass
    copies = blocks.select("s_idx", "block", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("pass"), "copies").where("pass <= copies")
    copies = copies.withColumn("at", F.row_number().over(W.partitionBy("s_idx").orderBy(F.xxhash64(F.lit(seed + 2), "pass", "s_idx", "block"), "pass", "block")) - 1)
    dealt = split_tree(blocks.groupBy("s_idx").agg(F.sum("copies").cast("long").alias("n")), shards, seed)
    ends = dealt.select("shard", F.explode("counts").alias("c")).select("shard", "c.s_idx", "c.n")
    ends = ends.withColumn("end", F.sum("n").over(W.partitionBy("s_idx").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.groupBy("s_idx").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("ends"))
    copies = copies.join(ends, "s_idx").withColumn("shard", F.filter("ends", lambda e: e["end"] > F.col("at"))[0]["shard"])
    copies = copies.groupBy("s_idx", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    blocks = written(blocks.select("s_idx", "block", "edge", "room", "passes").join(copies, ["s_idx", "block"], "left"))

    units = units.join(blocks, ["s_idx", "block"])
    shard_list = F.transform("shards", lambda c: c["shard"])
    keep = ["doc_id", "source", "size", "n_rows", "source_size", "target"]
    plain = units.where(~F.col("edge")).select(*keep, shard_list.alias("shards"))
    # the block at the edge: from the longest document down, each that still fits is taken once more
    item = F.struct((-F.col("unit_size")).alias("least"), F.xxhash64(F.lit(seed + 3), "doc_id", "size").alias("h"), "doc_id", "size", "n_rows", "unit_size")
    edges = units.where("edge").groupBy("s_idx", "source", "source_size", "target", "room", "passes", "shards").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def fit(acc, d):
        ok = d["unit_size"] <= acc["room"]
        return F.struct((acc["room"] - F.when(ok, d["unit_size"]).otherwise(0)).alias("room"), F.concat(acc["oks"], F.array(ok)).alias("oks"))

    oks = F.aggregate("items", F.struct(F.col("room").alias("room"), F.array().cast("array<boolean>").alias("oks")), fit, lambda a: a["oks"])
    edges = edges.withColumn("chosen", oks).select("*", F.explode(F.arrays_zip("items", "chosen")).alias("z"))
    edges = edges.select(F.col("z.items.doc_id").alias("doc_id"), "source", F.col("z.items.size").alias("size"), F.col("z.items.n_rows").alias("n_rows"), "source_size", "target", F.when(F.col("z.chosen"), shard_list).otherwise(F.slice(shard_list, 1, F.col("passes"))).alias("shards"))
    return plain.unionByName(edges).withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def mix(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mixed rows: docs' columns and shard; a document taken twice has two rows. Every partition holds its part of each shard
    in a hashed order; write.partitionBy("shard") makes a folder for each."""
    plan = mix_plan(docs, seed=seed, **options).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.posexplode("shards").alias("_copy", "shard")).hint("merge")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("own"), "doc_id", "source", word_count("text").alias("size"))
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
    rows = rows.select("own", "shard", F.xxhash64(F.lit(seed + 4), "doc_id", "_copy").alias("order"))
    # a sort-merge join (asked for above) has spread the documents by a hash of their keys, so every partition holds a random part of each shard: it is
    # shuffled where it lies, and the texts move once
    return rows.sortWithinPartitions("shard", "order").select("own.*", "shard")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    plan = mix_plan(docs)
    plan = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), F.sort_array("shards").alias("shards"))
