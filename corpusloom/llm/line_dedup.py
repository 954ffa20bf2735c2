"""Line dedup over levelled sorted runs of line hashes. DataFrame and SQL functions only.

Batches of documents arrive in turn. A batch's distinct line keys are counted; a merge-anti-join with the run of lines
that are already known to be common leaves those that still need counting, and they become a new sorted run at level 0.
Whenever a level holds FANOUT runs, they are merged into one run of the next level, and keys whose sum has reached
``min_docs`` move to the common run. At the end a last merge makes the verdict for every line of every batch.

A key is the line stripped of blank and code points 9 to 13, A-Z in lower case; keys with fewer than ``min_chars`` code
points are never dropped. Keys are compared by 96 hash bits. A row is a document: a line counts once for each row.

Edge cases: null and empty texts are one empty line; texts of any length are split as wholes; an empty table gives an
empty table; further columns pass through, but for the added n_lines and n_dropped, which replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import SPACE, forget, lower_az, read, shared_dir, union_all, written

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 4, 2
KEY = ["h", "g"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(SPACE)))


class LevelledRuns:
    """Sorted runs (h, g, n) in a shared folder, by level, and the run of common keys."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.common: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame | None:
        return union_all([self.spark.read.schema("h long, g int, n long").parquet(p) for p in paths]) if paths else None

    def _write(self, counts: DataFrame) -> str:
        path = shared_dir(self.spark)
        counts.select("h", "g", "n").sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def unknown(self, counts: DataFrame) -> DataFrame:
        """The keys of a batch that are not common yet."""
        known = self._read(self.common)
        return counts if known is None else counts.join(known.select(*KEY), KEY, "left_anti")

    def add(self, lines: DataFrame) -> None:
        """lines: (h, g), once for each document of the batch that has the line."""
        counts = lines.groupBy(*KEY).agg(F.count("*").alias("n"))
        self._push(0, self._write(self.unknown(counts)))

    def _push(self, level: int, path: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            merged = written(self._read(old).groupBy(*KEY).agg(F.sum("n").alias("n")), temp := shared_dir(self.spark))
            self.common.append(self._write(merged.where(F.col("n") >= self.min_docs)))
            self._push(level + 1, self._write(merged.where(F.col("n") < self.min_docs)))
            for p in [*old, temp]:
                forget(self.spark, p)

    def all_common(self) -> DataFrame:
        """Every key found in at least min_docs documents so far."""
        rest = self._read([p for level in self.levels for p in level])
        found = [f.select(*KEY) for f in [self._read(self.common)] if f is not None]
        if rest is not None:
            found.append(rest.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select(*KEY))
        return union_all(found).distinct()


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with the kept lines as text, n_lines and n_dropped."""
    spark = docs.sparkSession
    key = F.transform(lines_of(F.col("text")), line_key)
    pairs = F.transform(key, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))
    # hashes in place of texts: the one pass over the texts but for the last
    hashed = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.char_length("text"), F.lit(-1)).alias("l"), pairs.alias("keys"))
    hashed = written(hashed.withColumn("batch", F.pmod(F.xxhash64("doc_id", "t"), F.lit(batches)).cast("int")))
    runs = LevelledRuns(spark, min_docs)
    for b in range(batches):
        batch = hashed.where(F.col("batch") == b)
        runs.add(batch.select("r", F.explode("keys").alias("k")).where("k is not null").select("r", "k.h", "k.g").distinct().select("h", "g"))
    common = written(runs.all_common())

    # a row is known by doc_id and its text's hash and length: rows that share all three lose the same lines
    per_text = hashed.select("doc_id", "t", "l", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("doc_id", "t", "l", "pos", "k.h", "k.g")
    places = F.sort_array(F.collect_set("pos"))
    lost = per_text.join(common, KEY, "left_semi").groupBy("doc_id", "t", "l").agg(places.alias("places"))
    # a byte for each line up to the last lost one, so that no line looks through the others
    gaps = F.zip_with("places", F.slice(F.concat(F.array(F.lit(-1)), "places"), F.lit(1), F.size("places")), lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1")))
    lost = lost.select(F.col("doc_id").alias("d"), "t", "l", F.size("places").alias("n"), F.encode(F.array_join(gaps, ""), "UTF-8").alias("flags"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]).alias("own"), "doc_id", F.col("text").alias("whole"), F.xxhash64("text").alias("rt"), F.coalesce(F.char_length("text"), F.lit(-1)).alias("rl"))
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rt") == F.col("t")) & (F.col("rl") == F.col("l")), "left")
    lines = lines_of(F.col("whole"))
    kept = F.filter(lines, lambda line, i: F.substring("flags", i + 1, F.lit(1)) != F.lit(b"1"))
    rows = rows.select(
        "own",
        F.when(F.col("flags").isNull(), F.coalesce("whole", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
    )
    return rows.select("own.*", "text", "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, d.rn, l.i, list_extract(d.parts, l.i) AS line,
         translate(trim(list_extract(d.parts, l.i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS i) l
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rn) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE k IN (SELECT k FROM common)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id, rn
"""
