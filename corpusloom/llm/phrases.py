"""Phrase collocations by dynamic itemset counting.

The corpus is written in shards, as word numbers with the words of each block, and the shards are scanned in turn, again and
again. Words are counted from the first scan on. After
each scan, a phrase whose two subphrases (all words but the last, all but the first) have reached the threshold so far is
active, and is counted in the next scans until it has seen each shard once. So lengths interleave: pairs start while words
are still being counted. The scans end when no phrase is left whose cycle is incomplete.

What is active is kept in an array of fixed size for each length: the scan after which the first phrase of a slot reached the
threshold. Both subphrases' slots, and the scans after which they were active themselves, tell when a phrase became active,
the same in each later scan, so each phrase is counted over exactly one cycle. Phrases that share a slot may make further phrases active; those are counted exactly too and stay
below the threshold. Nothing that grows with the corpus is broadcast or collected. Counts are sums of partial sums, so a
language or a phrase with most of the rows is no hot group.

Edge cases: a null text is the empty text, which has no word; a null lang is `und`; texts of any length are counted as wholes,
a piece of a text is held as a whole in one task; repeated rows count each time; ties are ordered by the phrase's bytes;
an empty table gives an empty table. Only text and lang are read, so further columns have no effect.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.store import forget, read, shared_dir, written

SHARDS = 3
LENGTHS = 4
MIN_COUNT = 30
#: Slots of a length's array: 2^24 bytes each.
SLOT_BITS = 24
#: Tokens that a task holds before they become blocks.
TASK_TOKENS = 1_500_000
NONE = 255
#: Bits of a map that bitmap_construct_agg makes.
BITMAP = 8 * 4096
#: Rows of a language that are ordered in one task.
ORDERED_ROWS = 50_000
BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(r"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
BLOCK = "shard int, lang string, words array<string>, tokens binary"
PARTIAL = "lang string, k int, phrase string, active int, slot int, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    """The last step of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Packer:
    """Texts of a task as blocks: a language's words and the numbers of its tokens among them, marks and text ends as breaks."""

    def __init__(self, tokens: int):
        self.limit, self.held = tokens, 0
        self.buffers: dict[str, tuple] = {}

    def add(self, lang: str, text: str):
        if lang not in self.buffers:
            number = defaultdict(count().__next__)
            for c in BREAKS:
                number[c]
            self.buffers[lang] = (number, [])
        number, parts = self.buffers[lang]
        # A-Z become small, as bytes of other letters are not touched
        found = TOKEN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        parts.append(np.zeros(1, np.int32))
        self.held += len(found) + 1
        if self.held >= self.limit:
            yield from self.flush()

    def flush(self):
        for lang, (number, parts) in self.buffers.items():
            yield lang, list(number), np.concatenate(parts)
        self.buffers, self.held = {}, 0


def _counted(keys: np.ndarray):
    """For each distinct key a place where it stands and how often it comes, and the number of each place's key."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
    n = np.diff(new, append=len(keys))
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.repeat(np.arange(len(new)), n)
    return order[new], inverse, n


class Scan:
    """One scan of a shard in a task."""

    def __init__(self, step: int, shards: int, since: list[np.ndarray]):
        self.step, self.shards, self.since = step, shards, since

    def sums(self, lang: str, words: list[str], a: np.ndarray):
        """Partial sums of all phrases that are to be counted in this scan."""
        seed = xxhash.xxh3_64_intdigest(lang)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        named = pa.array(words, pa.large_string())
        n_breaks, first_cycle = len(BREAKS), self.step < self.shards

        def out(k, phrases, active, slots, n):
            m = len(n)
            return [pa.repeat(pa.scalar(lang, pa.string()), m), pa.repeat(pa.scalar(k, pa.int32()), m), phrases.cast(pa.string()), pa.array(active, pa.int32()), pa.array(slots, pa.int32()), pa.array(n, pa.int64())]

        if first_cycle:
            n = np.bincount(a, minlength=len(words))
            n[:n_breaks] = 0
            found = np.flatnonzero(n)
            yield out(0, pa.array([""], pa.large_string()), [-1], [-1], [int(n.sum())])
            yield out(1, named.take(pa.array(found)), np.full(len(found), -1), self._slots(hashes[found]), n[found])
        # at place i of length k: h the phrase's hash, s the scan after which its slot was reached, group its number
        h = hashes[a]
        s = self.since[0][self._slots(hashes)]
        s[:n_breaks] = NONE
        s, group = s[a], a
        for k in range(2, LENGTHS + 1):
            if len(s) < 2:
                return
            active = np.maximum(s[:-1], s[1:])
            h = _mix(h[:-1] * np.uint64(3) + hashes[a[k - 1 :]])
            at = np.flatnonzero(active != NONE)
            if not len(at):
                return
            # numbers of the phrases at these places: exact, from the number of the first words and the last word
            first, inverse, n = _counted(group[at] * len(words) + a[at + k - 1])
            places = at[first]
            slots, act = self._slots(h[places]), active[places]
            counted = act.astype(np.int64) + self.shards >= self.step
            if counted.any():
                p = places[counted]
                phrases = pc.binary_join_element_wise(*(named.take(pa.array(a[p + j])) for j in range(k)), pa.scalar(" ", pa.large_string()))
                yield out(k, phrases, act[counted], slots[counted], n[counted])
            if k < LENGTHS:
                s = np.full(len(active), NONE, np.uint8)
                # a slot that others reached before the phrase was active counts from then on only
                s[at] = np.maximum(self.since[k - 1][slots], act)[inverse]
                group = np.full(len(active), -1)
                group[at] = inverse

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - int(np.log2(len(self.since[0]))))).astype(np.int64)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def packed(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, text) -> blocks (shard, lang, words, tokens: 32-bit numbers); a task deals its blocks to the shards in turn."""
    schema, limit = _arrow(BLOCK), TASK_TOKENS

    def run(batches):
        from pyspark import TaskContext

        packer, turn = Packer(limit), count(TaskContext.get().partitionId())

        def rows(blocks):
            for lang, words, tokens in blocks:
                yield pa.RecordBatch.from_pylist([{"shard": next(turn) % shards, "lang": lang, "words": words, "tokens": tokens.astype("<i4").tobytes()}], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                yield from rows(packer.add(lang, text.as_py() or ""))
        yield from rows(packer.flush())

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCK)


def scanned(shard: DataFrame, step: int, shards: int, since) -> DataFrame:
    """Blocks -> partial sums; since is a broadcast of the arrays."""
    schema = _arrow(PARTIAL)

    def run(batches):
        scan = Scan(step, shards, [np.frombuffer(x, np.uint8) for x in since.value])
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[i].as_py(), "<i4").astype(np.int64)
                for columns in scan.sums(batch.column("lang")[i].as_py(), batch.column("words")[i].as_py(), tokens):
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return small_batches(shard.select("lang", "words", "tokens"), run, PARTIAL)


def small_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with one row a batch, as a row is a whole block."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1")
    try:
        out = df.mapInArrow(run, schema)
        out._jdf.queryExecution().executedPlan()  # the setting is read here
        return out
    finally:
        conf.set(name, before)


def reached(state: DataFrame, min_count: int) -> list[np.ndarray]:
    """The slots of the phrases of each length that reached the threshold, as bits of maps of fixed size."""
    slot = F.col("slot").cast("long") + 1  # the maps' places count from 1
    rows = state.where((F.col("k") > 0) & (F.col("k") < LENGTHS) & (F.col("n") >= min_count))
    rows = rows.groupBy("k", F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    found = [[np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")) + (r.b - 1) * BITMAP for r in rows if r.k == k] for k in range(1, LENGTHS)]
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(text, lang) -> two tables: (lang, k, phrase, n) of the phrases of 1 to 4 words with n >= min_count, and (lang, n) of
    all words."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    packed(docs, shards).write.partitionBy("shard").parquet(f"{base}/shards")
    corpus = spark.read.schema(BLOCK).parquet(f"{base}/shards")
    since = [np.full(1 << slot_bits, NONE, np.uint8) for _ in range(LENGTHS - 1)]
    state, path, step, last = None, None, 0, -1
    while step < shards or step <= last + shards:
        shared = spark.sparkContext.broadcast([x.tobytes() for x in since])
        found = scanned(corpus.where(F.col("shard") == step % shards), step, shards, shared)
        if state is not None:
            found = state.unionByName(found)
        found = found.groupBy("lang", "k", "phrase").agg(F.min("active").alias("active"), F.min("slot").alias("slot"), F.sum("n").alias("n"))
        # a phrase below the threshold after its cycle is out
        found = found.where((F.col("n") >= min_count) | (F.col("k") == 0) | (F.col("active") + shards > step))
        old, path = path, f"{base}/after-{step}"
        state = written(found, path)
        if old:
            forget(spark, old)
        shared.destroy()
        for array, slots in zip(since, reached(state, min_count), strict=True):
            new = slots[array[slots] == NONE]
            if len(new):
                array[new] = step
                last = step
        step += 1
    forget(spark, f"{base}/shards")
    totals = state.where("k = 0").select("lang", "n")
    return state.where((F.col("k") > 0) & (F.col("n") >= min_count)).select("lang", "k", "phrase", "n"), totals


def scored(frequent: DataFrame, totals: DataFrame, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one contains with share per cent of their count."""
    words = F.split("phrase", " ")
    candidates = frequent.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    with_l = cut.join(part.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"])
    both = with_l.join(part.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best"))
    spans = candidates.where("k > 2").select("lang", "a", "k", words.alias("w")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    spans = spans.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    longer = spans.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(19,0)") * F.col("longer") < F.lit(share).cast("decimal(19,0)") * F.col("best.a")))
    return kept.join(totals, "lang").select("lang", "phrase", "best.a", "best.l", "best.r", "n", "best.score")


def first_of_each(df: DataFrame, key: str, order: list, most: int, rows: int, rank: str = "rank") -> DataFrame:
    """The first so many rows of each key with their ranks. No task orders more than some ORDERED_ROWS + most rows of a key:
    parts of a key are cut to their first rows, and parts of what is left, until one part holds it."""
    while rows > max(ORDERED_ROWS, 2 * most):
        parts = -(-rows // max(ORDERED_ROWS, 2 * most))
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        df = df.withColumn("part", part).withColumn(rank, F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).where(F.col(rank) <= most).drop("part", rank)
        rows = parts * most
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= most)


def collocations(docs: DataFrame, most: int = 2000, min_count: int = MIN_COUNT, shards: int = SHARDS) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: the first so many phrases of each language."""
    frequent, totals = frequent_phrases(docs, min_count, shards)
    ranked = first_of_each(scored(frequent, totals), "lang", [F.desc("score"), F.desc("a"), "phrase"], most, frequent.where("k > 1").count())
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), spans AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.n AS l, r.n AS r, ((2000000::HUGEINT * c.a) // (l.n + r.n)) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates WHERE k > 2))
  GROUP BY ALL
), kept AS (
  SELECT b.*, t.n FROM best b JOIN totals t USING (lang) LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
