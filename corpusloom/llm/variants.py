"""Grouping of spelling variants: words that differ by one letter, found by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. A word's reduced form and all reduced words that one inserted, deleted or replaced
symbol makes of it are looked up among the reduced forms of the vocabulary, and the words found are verified letter by
letter. A replaced letter with the same symbol leaves the reduced word as it is, so no pair is lost. Over a small alphabet
a word has few neighbours, whatever the script. Neighbours that no word has are mostly dropped before the shuffle, by a map
of bits of fixed size. Pairs are verified within the join, so the pairs of a crowded reduced word are never written.

Edge cases: null words are dropped; words of any length are compared as wholes, places of long ones in parts; a word that
comes in several rows has the sum of their counts; of near words with equal counts the first in code-point order is the
form; an empty table gives an empty table; further columns have no effect.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import UPPER, forget, in_batches, read, shared_dir, written

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant.
FORM_RATIO = 5
SYMBOLS = 8
#: Bits of the map of reduced words that occur: 2^26 bits are 8 MB.
MAP_BITS = 26
BITMAP = 8 * 4096
#: Neighbours that are made at once.
NEIGHBOURS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def symbols_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Letters to symbols 1..symbols, by a hash of the code point."""
    mixed = (letters.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return ((mixed >> np.uint64(8)) * np.uint64(symbols) >> np.uint64(24)) + np.uint64(1)


def by_length(words: list[str], symbols: int):
    """(rows, matrix of their symbols) for the words of each length."""
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for n, rows in of.items():
        if n:
            letters = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n)
            yield np.array(rows), symbols_of(letters, symbols)


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)


def prefixes(s: np.ndarray) -> np.ndarray:
    """Codes of s[:, :i] for i = 0..n: a number in base BASE, modulo 2^64."""
    out = np.zeros((s.shape[0], s.shape[1] + 1), np.uint64)
    for i in range(s.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + s[:, i]
    return out


def codes(words: list[str], symbols: int) -> np.ndarray:
    """The code of each word's reduced form; words with equal reduced forms have equal codes."""
    out = np.zeros(len(words), np.uint64)
    for rows, s in by_length(words, symbols):
        out[rows] = prefixes(s)[:, -1]
    return out


def neighbours(s: np.ndarray, symbols: int):
    """(row, code) arrays of all reduced words within one edit of each row, itself included; each word once."""
    m, n = s.shape
    p, pre = powers(n + 1), prefixes(s)
    whole = pre[:, -1:]
    after = whole - pre * p[n - np.arange(n + 1)]  # the code of s[i:]
    yield np.arange(m), pre[:, -1]
    step = max(1, NEIGHBOURS // (m * symbols))
    alphabet = np.arange(1, symbols + 1, dtype=np.uint64)
    for a in range(0, n + 1, step):
        i = np.arange(a, min(a + step, n + 1))
        here = np.where(i[None, :] < n, s[:, np.minimum(i, n - 1)], np.uint64(0))
        # a symbol goes in at the end of its run, and out at the end of its run, so that no word comes twice
        made = (pre[:, i] * p[n + 1 - i] + after[:, i])[:, :, None] + alphabet * p[n - i][None, :, None]
        yield from _chosen(made, here[:, :, None] != alphabet)
        i, here = i[i < n], here[:, i < n]
        if len(i):
            rest = pre[:, i] * p[n - 1 - i] + after[:, i + 1]
            following = np.where(i[None, :] + 1 < n, s[:, np.minimum(i + 1, n - 1)], np.uint64(0))
            yield from _chosen(rest, here != following)
            kept = pre[:, i] * p[n - i] + after[:, i + 1]
            yield from _chosen(kept[:, :, None] + alphabet * p[n - 1 - i][None, :, None], here[:, :, None] != alphabet)


def _chosen(made: np.ndarray, mask: np.ndarray):
    at = np.nonzero(mask)
    yield at[0], made[at]


def coded(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n) -> word, n, code"""

    def run(batch):
        yield [batch.column("word"), batch.column("n"), pa.array(codes(batch.column("word").to_pylist(), symbols).view(np.int64))]

    return in_batches(words.select("word", "n"), run, "word string, n long, code long", 10_000)


def _slot(code, bits: int):
    return F.shiftrightunsigned(code, 64 - bits) + 1


def occurring(known: DataFrame, bits: int) -> bytes:
    """The map of the codes that occur, of 2^bits bits, whatever the size of the vocabulary."""
    slot = _slot(F.col("code"), bits)
    rows = known.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros((max(1, (1 << bits) // BITMAP), BITMAP // 8), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def near_pairs(known: DataFrame, symbols: int = SYMBOLS, bits: int = MAP_BITS) -> DataFrame:
    """(word, n, code) with distinct words -> word, n, near, near_n for all words that differ by one letter, both ways."""
    shared = known.sparkSession.sparkContext.broadcast(occurring(known, bits))

    def run(batch):
        here = np.frombuffer(shared.value, np.uint8)
        words, n = batch.column("word"), batch.column("n")
        for rows, s in by_length(words.to_pylist(), symbols):
            lot = max(1, NEIGHBOURS // (2 * symbols * (s.shape[1] + 1)))
            for a in range(0, len(rows), lot):
                for row, code in neighbours(s[a : a + lot], symbols):
                    slot = code >> np.uint64(64 - bits)
                    there = np.flatnonzero(here[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    if len(there):
                        of = pa.array(rows[a + row[there]])
                        yield [words.take(of), n.take(of), pa.array(code[there].view(np.int64))]

    asked = in_batches(known.select("word", "n"), run, "word string, n long, code long", 10_000)
    # the neighbours are many times the vocabulary, by whose size Spark would judge them: a merge, so that they are never broadcast
    found = asked.hint("merge").join(known.select("code", F.col("word").alias("near"), F.col("n").alias("near_n")), "code").where(F.levenshtein("word", "near", 1) == 1)
    return found.select("word", "n", "near", "near_n").dropDuplicates(["word", "near"])


def roots(forms: DataFrame, least_ratio: float, most: int) -> DataFrame:
    """(word, form) -> word, root: forms followed to the last, by doubling the way in each round.

    Each step multiplies the count by least_ratio, and the last has most, so the number of rounds is known."""
    spark, old = forms.sparkSession, None
    steps = max(1, ceil(log(max(most, 2)) / log(least_ratio)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log(steps + 1, 2))):
        path = shared_dir(spark)
        out = written(out, path)
        if old:
            forget(spark, old)
        old = path
        out = out.join(out.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return out


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, symbols: int = SYMBOLS, bits: int = MAP_BITS) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n.

    A word's form is its near word with the largest count, if that is at least ratio times its own; its root is the last
    word that forms lead to, or the word itself."""
    known = written(coded(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), symbols))
    best = near_pairs(known, symbols, bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = known.select("word", "n").join(best, "word", "left")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    most = found.agg(F.max("n")).first()[0] or 1
    led = roots(found.where("form IS NOT NULL"), ratio, most)
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, run: the maximal runs of letters, A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    return found.withColumn("run", F.translate("run", UPPER, UPPER.lower()))


def with_slips(doc_id: Column, run: Column, every: int = 199) -> Column:
    """A run without one letter where the hash of doc_id and run is divisible by every; a null doc_id is the empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(occurrences: DataFrame, letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """(word) -> word, n of words with so many letters and occurrences."""
    return occurrences.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(read(spark, sf_dir, "documents").select("doc_id", "text")).where(F.char_length("run") >= MIN_LETTERS)
    return group_variants(vocabulary(found.select(with_slips(F.col("doc_id"), F.col("run")).alias("word"))))


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), once AS (
  SELECT doc_id, run, count(*) AS times FROM found WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM once
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, steps
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed
), v AS (
  SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), less AS (
  SELECT DISTINCT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, v.word FROM less a JOIN v ON v.word = a.rest
  UNION SELECT v.word, a.word FROM less a JOIN v ON v.word = a.rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min({'w': near.near, 'n': b.n}, (-b.n, near.near)) AS best FROM near JOIN v b ON b.word = near.near GROUP BY near.word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN best.w END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, led.root FROM led JOIN formed f ON f.form = led.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN led USING (word)
"""
