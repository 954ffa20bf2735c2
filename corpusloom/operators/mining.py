"""Sentence mining: filters, checks, first-wins dedup, merging, ids and reports. Rows are ordered by (src, id, seq), so
"first" never depends on the order of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

ORDER = ("src", "id", "seq")


@dataclass(frozen=True)
class MiningRules:
    """What a mined sentence must be; language tables are parameters."""

    # fixed values: limits, patterns and letters that must match
    words: tuple[int, int] = (3, 25)
    forbidden: str = r"[\d@/\\_#*<>{}\[\]|=+]|http|www|[а-яА-Я]"
    odd_start: str = "w"
    special: str = "əıöüşçğƏIÖÜŞÇĞİ"
    special_from: int = 4
    tells: str = ""
    hard_tells: str = ""


def strict_filter(c, rules: MiningRules) -> Column:
    """Every rule must hold: length, final mark, no digits, links or symbols, no "Name:" start, no acronym, no inner sentence
    break, no word of a foreign letter, a letter of the language in longer sentences, no transliteration."""
    c = T.col(c)
    n, wc = T.word_count(c), T.WORD_CHARS
    body = F.substring(c, F.lit(1), F.char_length(c) - 1)
    special = c.rlike(f"[{rules.special}]")
    ok = n.between(*rules.words) & F.right(c, F.lit(1)).isin(".", "!", "?") & ~c.rlike(rules.forbidden)
    ok &= ~c.rlike(rf"^[{wc}.]+( [{wc}.]+)?:\s") & ~c.rlike(rf"(?<![{wc}])\p{{Lu}}{{2,}}(?![{wc}])") & ~body.rlike(r"[.!?…]\s+\S")
    if rules.odd_start:
        ok &= ~c.rlike(rf"(?<![{wc}])(?i:[{rules.odd_start}])")
    ok &= (n < rules.special_from) | special
    if rules.tells:
        ok &= ~c.rlike(T.guarded(rules.tells)) | (special & ~c.rlike(T.guarded(rules.hard_tells or rules.tells)))
    return ok


def loose_filter(c, alphabet: str, least_share: float = 0.98, words: tuple[int, int] = (3, 30)) -> Column:
    c = T.col(c)
    share = F.coalesce(T.alphabet_share(c, alphabet), F.lit(0.0))
    return (share > least_share) & ~c.rlike(r"\d") & T.word_count(c).between(*words) & F.right(c, F.lit(1)).isin(".", "!", "?") & ~F.contains(c, F.lit("  "))


def violations(c, lo, hi, allowed: str = T.ALLOWED) -> Column:
    """The names of all rules that a sentence breaks, in a fixed order; lo and hi are word limits."""
    c, n = T.col(c), T.word_count(c)
    odd = F.size(T.outside(c, allowed)) > 0
    return F.array_compact(
        F.array(
            F.when((c == "") | ~F.right(c, F.lit(1)).isin(*T.SENTENCE_MARKS), F.lit("final mark")),
            F.when(odd, F.lit("characters")),
            F.when(c.rlike(rf"(?<![{T.WORD_CHARS}])\p{{Lu}}{{2,}}(?![{T.WORD_CHARS}])"), F.lit("acronym")),
            F.when(F.contains(c, F.lit("  ")) | (c != F.trim(c)), F.lit("spaces")),
            F.when(~n.between(T.col(lo), T.col(hi)), F.lit("word limits")),
            F.when(c.rlike(r"^\p{Ll}"), F.lit("lower-case start")),
        )
    )


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Word limits by category: the limit with the longest prefix of cat wins; limits (prefix, lo, hi) is a small dimension."""
    both = rows.select("cat").distinct().join(limits, F.startswith(F.col("cat"), limits.prefix))  # categories by prefixes, both short lists
    best = both.groupBy("cat").agg(F.max_by(F.struct("lo", "hi"), F.length("prefix")).alias("l"))
    return rows.join(best, "cat").select(*rows.columns, "l.lo", "l.hi")


def no_digit_in_any(columns: list[str]) -> Column:
    return ~F.exists(F.array(*columns), lambda c: c.rlike(r"\d"))


def first_of_key(rows: DataFrame, key: str = "k", order=ORDER) -> DataFrame:
    """The first row of each key, by a struct minimum: sums on the map side, with no window over a hot key."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def unknown_only(rows: DataFrame, *known: DataFrame, key: str = "k") -> DataFrame:
    """Rows whose key none of the known sets has."""
    every = known[0].select(key)
    for k in known[1:]:
        every = every.union(k.select(key))
    return rows.join(every.distinct(), key, "left_anti").select(rows.columns)


def duplicate_of(rows: DataFrame, key: str = "k", order=ORDER) -> DataFrame:
    """Every row with the holder of its key: the first row that has it, itself included; bad rows claim keys too."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("holder"))
    return rows.join(first, key).withColumn("is_first", F.struct(*order) == F.col("holder"))


def merged(rows: DataFrame, checks: Column, known: DataFrame, key: str = "k", order=ORDER) -> DataFrame:
    """Drop reasons in the order bad row, checker, known, duplicate; reason NULL is kept. Only rows that pass claim a key."""
    marked = rows.join(known.select(F.col(key).alias("_k")).distinct(), rows[key] == F.col("_k"), "left")
    reason = F.when(F.col("text").isNull() | (F.col("text") == ""), "bad row").when(checks, "checker").when(F.col("_k").isNotNull(), "known")
    marked = marked.withColumn("reason", reason).drop("_k")
    first = marked.where("reason is null").groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    out = marked.join(first, key, "left")
    late = F.col("reason").isNull() & (F.struct(*order) != F.col("_first"))
    return out.withColumn("reason", F.when(late, "duplicate").otherwise(F.col("reason"))).drop("_first")


def numbered(rows: DataFrame, by: str = "cat", order=ORDER) -> DataFrame:
    """A running number within each category, without a task that sorts a whole one."""
    return numbered_overall(rows, list(order), by)


def numbered_overall(rows: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """A running number over all rows, or over those of each value of ``by``: ranges are numbered apart, then offset by the sizes of
    the ranges before them, one row for each range and value."""
    from corpusloom.operators.storage import kept

    spark = rows.sparkSession
    n, own = int(spark.conf.get("spark.sql.shuffle.partitions")), [by] if by else []
    part = kept(rows.repartitionByRange(n, *own, *order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part", *own).count()
    before = W.partitionBy(*own).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", *own, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(c).alias("_by") for c in own], "_before")
    same = (F.col("_part") == F.col("_p")) & (F.col(by).eqNullSafe(F.col("_by")) if by else F.lit(True))
    inside = F.row_number().over(W.partitionBy("_part", *own).orderBy(*order))
    return part.withColumn("_in", inside).join(offsets, same).withColumn("number", F.col("_in") + F.col("_before")).select(*rows.columns, "number")


def labels(c, question_words: str, particles: str, first: str, second: str, alternative: str, dense: tuple[str, int, str, int] = ("bpm", 3, "q", 2)) -> Column:
    """All categories of a sentence: the question tree, persons, dense consonants, 6-10 words, or statement_other."""
    c, wc = T.col(c), T.WORD_CHARS
    is_q, is_e = F.endswith(c, F.lit("?")), F.endswith(c, F.lit("!"))
    question = F.when(F.contains(F.lower(c), F.lit(alternative)), "alternative_question").when(c.rlike(T.guarded(question_words)), "wh_question").when(c.rlike(T.guarded(particles, True)), "yes_no_question").otherwise("intonation_question")
    suffix = lambda s: c.rlike(rf"(?iu)[{wc}]{{2,}}({s})(?![{wc}])")
    person = F.when(suffix(first) & suffix(second), "first_and_second_person").when(suffix(first), "first_person")
    count = lambda letters: F.regexp_count(c, F.lit(rf"(?<![{wc}])(?i:[{letters}])[{wc}]+"))
    thick = F.when((count(dense[0]) >= dense[1]) | (count(dense[2]) >= dense[3]), "consonant_dense")
    plain = ~is_q & ~is_e
    found = F.array_compact(F.array(F.when(is_q, question), F.when(is_e, F.lit("exclamation")), F.when(plain, person), F.when(plain, thick), F.when(plain & T.word_count(c).between(6, 10), F.lit("statement_6_10"))))
    return F.when(F.size(found) == 0, F.array(F.lit("statement_other"))).otherwise(found)


def single_label(c, question_words: str, particles: str, first: str, alternative: str) -> Column:
    """The first category that fits."""
    c, wc = T.col(c), T.WORD_CHARS
    is_q = F.endswith(c, F.lit("?"))
    return (
        F.when(is_q & F.contains(F.lower(c), F.lit(alternative)), "alternative_question")
        .when(is_q & c.rlike(T.guarded(question_words)), "wh_question")
        .when(is_q & c.rlike(T.guarded(particles, True)), "yes_no_question")
        .when(is_q, "other_question")
        .when(F.endswith(c, F.lit("!")), "exclamation")
        .when(c.rlike(rf"[{wc}]{{2,}}({first})(?![{wc}])"), "first_person_m")
        .when(T.word_count(c).between(6, 10), "statement_6_10")
        .otherwise("statement_other")
    )
