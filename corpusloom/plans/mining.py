"""Mining, checking, dedup and reports over the lines of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as T
from corpusloom.operators import mining as M
from corpusloom.operators import selection as Q
from corpusloom.operators.storage import kept
from corpusloom.plans.base import LINES, W, lines, sql_loose_key, sql_n_words, sql_words, table, with_lines
from corpusloom.plans.text_scalars import BIN, PARTICLES, QUESTION_WORDS, TYPE, VOWEL_COUNT

RULES = M.MiningRules(special="aeiouéñßäöüèêçíóá", tells="scum|loweiig", hard_tells="scum", odd_start="z")
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéñßäöüèêçíóáÉÑÄÖÜÈÊÇÍÓÁ"
FIRST, SECOND, ALT = "ed|es|en", "th|on", "tion"
NOT_W = rf"(^|[^{W}])"
END_W = rf"($|[^{W}])"
N = sql_n_words("text")
ENDS = "right(text, 1) IN ('.', '!', '?')"
STRICT = (
    rf"{N} BETWEEN 3 AND 25 AND {ENDS} AND NOT regexp_matches(text, '[\d@/\\_#*<>{{}}\[\]|=+]|http|www|[а-яА-Я]') "
    rf"AND NOT regexp_matches(text, '^[{W}.]+( [{W}.]+)?:\s') AND NOT regexp_matches(text, '{NOT_W}\p{{Lu}}{{2,}}{END_W}') "
    rf"AND NOT regexp_matches(left(text, length(text) - 1), '[.!?…]\s+\S') AND NOT regexp_matches(text, '{NOT_W}[zZ]') "
    rf"AND ({N} < 4 OR regexp_matches(text, '[{RULES.special}]')) AND (NOT regexp_matches(lower(text), '{NOT_W}(scum|loweiig){END_W}') OR (regexp_matches(text, '[{RULES.special}]') AND NOT regexp_matches(lower(text), '{NOT_W}(scum){END_W}')))"
)
SHARE = rf"coalesce(length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{LATIN}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE, 0)"
LOOSE = rf"{SHARE} > 0.98 AND NOT regexp_matches(text, '\d') AND {N} BETWEEN 3 AND 30 AND {ENDS} AND NOT contains(text, '  ')"
ALLOWED = LATIN + " ,.!?:;-"
VIOLATIONS = (
    rf"list_filter([CASE WHEN right(text, 1) NOT IN ('.', '!', '?', '…') THEN 'final mark' END, CASE WHEN regexp_matches(text, '[^{LATIN} ,.!?:;-]') THEN 'characters' END, "
    rf"CASE WHEN regexp_matches(text, '{NOT_W}\p{{Lu}}{{2,}}{END_W}') THEN 'acronym' END, CASE WHEN contains(text, '  ') OR text <> trim(text) THEN 'spaces' END, "
    rf"CASE WHEN NOT {N} BETWEEN lo AND hi THEN 'word limits' END, CASE WHEN regexp_matches(text, '^\p{{Ll}}') THEN 'lower-case start' END], lambda x: x IS NOT NULL)"
)
KEY = sql_loose_key("text")
QW, PT = rf"regexp_matches(lower(text), '{NOT_W}({QUESTION_WORDS}){END_W}')", rf"regexp_matches(lower(text), '({PARTICLES}){END_W}')"
SUFFIX = rf"regexp_matches(lower(text), '[{W}]{{2,}}({{s}}){END_W}')".replace("{{s}}", "{s}")
DENSE = lambda letters: rf"len(list_filter(string_split_regex(lower(text), '[^{W}]+'), lambda x: regexp_matches(x, '^[{letters}].')))"
LABELS = (
    f"CASE WHEN ends_with(text, '?') THEN [CASE WHEN contains(lower(text), '{ALT}') THEN 'alternative_question' WHEN {QW} THEN 'wh_question' WHEN {PT} THEN 'yes_no_question' ELSE 'intonation_question' END] "
    f"WHEN ends_with(text, '!') THEN ['exclamation'] ELSE list_filter([CASE WHEN {SUFFIX.replace('{s}', FIRST)} AND {SUFFIX.replace('{s}', SECOND)} THEN 'first_and_second_person' WHEN {SUFFIX.replace('{s}', FIRST)} THEN 'first_person' END, "
    f"CASE WHEN {DENSE('bpm')} >= 3 OR {DENSE('q')} >= 2 THEN 'consonant_dense' END, CASE WHEN {N} BETWEEN 6 AND 10 THEN 'statement_6_10' END], lambda x: x IS NOT NULL) END"
)
SINGLE = f"CASE WHEN ends_with(text, '?') AND contains(lower(text), '{ALT}') THEN 'alternative_question' WHEN ends_with(text, '?') AND {QW} THEN 'wh_question' WHEN ends_with(text, '?') AND {PT} THEN 'yes_no_question' WHEN ends_with(text, '?') THEN 'other_question' WHEN ends_with(text, '!') THEN 'exclamation' WHEN regexp_matches(text, '[{W}]{{2,}}({FIRST}){END_W}') THEN 'first_person_m' WHEN {N} BETWEEN 6 AND 10 THEN 'statement_6_10' ELSE 'statement_other' END"
KEYED = f"keyed AS (SELECT *, {KEY} AS k, {SINGLE} AS cat FROM lines)"
BENCH = f"known AS (SELECT DISTINCT {KEY} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark))"
FIRSTS = "firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, id, seq) AS rn FROM passing) WHERE rn = 1)"
SECONDS = f"({VOWEL_COUNT.format(c='text')} / 5.77::DOUBLE + 0.5::DOUBLE)"


def keyed(spark, sf):
    return lines(spark, sf).withColumn("k", T.loose_key("text")).withColumn("cat", M.single_label("text", QUESTION_WORDS, PARTICLES, FIRST, ALT))


def known(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).select(T.loose_key("text").alias("k")).distinct()


def mined(spark, sf):
    passing = keyed(spark, sf).where(M.strict_filter("text", RULES))
    return M.first_of_key(M.unknown_only(passing, known(spark, sf)))


MINED = f"WITH {LINES}, {KEYED}, {BENCH}, passing AS (SELECT * FROM keyed WHERE {STRICT} AND k NOT IN (SELECT k FROM known)), {FIRSTS}"


@query("flagship_mine", f"{MINED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY src, id, seq) AS number FROM firsts) SELECT cat, count(*)::BIGINT AS n_lines, round(sum({SECONDS}) / 3600, 6) AS hours, min(format('{{}}_{{:05d}}', cat, number)) AS first_id, max(number)::INT AS last_number FROM numbered GROUP BY cat")
def flagship_mine(spark, sf):
    rows = M.numbered(mined(spark, sf))
    return rows.groupBy("cat").agg(F.count("*").alias("n_lines"), F.round(F.sum(T.speech_seconds("text")) / 3600, 6).alias("hours"), F.min(T.padded_id("cat", "number")).alias("first_id"), F.max("number").cast("int").alias("last_number"))


def on_lines(name, sql, where=None, **columns):
    query(name, with_lines(f"SELECT id, seq, {sql} FROM lines" + (f" WHERE {where[0]}" if where else "")))(lambda spark, sf: (lines(spark, sf).where(where[1]()) if where else lines(spark, sf)).select("id", "seq", *(c().alias(k) for k, c in columns.items())))


on_lines("fl1_strict_filter", "text", where=(STRICT, lambda: M.strict_filter("text", RULES)), text=lambda: F.col("text"))
on_lines("fl2_loose_filter", "text", where=(LOOSE, lambda: M.loose_filter("text", LATIN)), text=lambda: F.col("text"))
on_lines("fl3_violations", VIOLATIONS.replace("lo AND hi", "2 AND 25") + " AS broken", broken=lambda: M.violations("text", F.lit(2), F.lit(25), ALLOWED))
on_lines("fl9_known_symbols_only", "text", where=(rf"NOT regexp_matches(text, '[^{LATIN} ,.!?:;-]')", lambda: F.size(T.outside("text", ALLOWED)) == 0), text=lambda: F.col("text"))
on_lines("cl2_single_label", f"{SINGLE} AS cat", cat=lambda: M.single_label("text", QUESTION_WORDS, PARTICLES, FIRST, ALT))
query("cl1_multi_label", with_lines(f"SELECT id, seq, unnest(CASE WHEN len(l) = 0 THEN ['statement_other'] ELSE l END) AS cat FROM (SELECT id, seq, {LABELS} AS l FROM lines)"))(lambda spark, sf: lines(spark, sf).select("id", "seq", F.explode(M.labels("text", QUESTION_WORDS, PARTICLES, FIRST, SECOND, ALT)).alias("cat")))


@query("fl4_word_limits", f"WITH {LINES}, {KEYED} SELECT id, seq, cat, CASE WHEN starts_with(cat, 'statement_6') THEN 6 WHEN starts_with(cat, 'statement') THEN 8 ELSE 2 END AS lo, CASE WHEN starts_with(cat, 'statement_6') THEN 10 WHEN starts_with(cat, 'statement') THEN 60 ELSE 25 END AS hi FROM keyed")
def fl4_word_limits(spark, sf):
    limits = spark.createDataFrame([("", 2, 25), ("statement", 8, 60), ("statement_6", 6, 10)], "prefix string, lo int, hi int")
    return M.with_limits(keyed(spark, sf), limits).select("id", "seq", "cat", "lo", "hi")


@query("fl5_clean_rows", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '\d') AND NOT regexp_matches(source, '1')")
def fl5_clean_rows(spark, sf):
    return table(spark, sf, "documents").where(M.no_digit_in_any(["text", "lang"]) & ~F.col("source").contains("1")).select("doc_id")


@query("fl10_label_completeness", "SELECT (SELECT count(*) FROM documents WHERE source IS NULL)::BIGINT AS unlabelled, (SELECT count(DISTINCT source) FROM documents WHERE doc_id % 10 = 3 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 10 <> 3))::BIGINT AS unseen, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS speakers")
def fl10_label_completeness(spark, sf):
    docs = table(spark, sf, "documents").select("source", (F.col("doc_id") % 10 == 3).alias("held"))
    seen = docs.where("not held").select("source").distinct()
    unseen = docs.where("held").select("source").distinct().join(seen, "source", "left_anti").agg(F.count("*").alias("unseen"))
    return docs.agg(F.count_if(F.col("source").isNull()).alias("unlabelled"), F.countDistinct("source").alias("speakers")).crossJoin(unseen)  # one row each


@query("dd1_filter_then_first", f"WITH {LINES}, {KEYED}, passing AS (SELECT * FROM keyed WHERE {LOOSE}), {FIRSTS} SELECT id, seq, k FROM firsts")
def dd1_filter_then_first(spark, sf):
    return M.first_of_key(keyed(spark, sf).where(M.loose_filter("text", LATIN))).select("id", "seq", "k")


@query("dd2_not_known", f"WITH {LINES}, {KEYED}, {BENCH} SELECT id, seq FROM keyed WHERE k NOT IN (SELECT k FROM known)")
def dd2_not_known(spark, sf):
    return M.unknown_only(keyed(spark, sf), known(spark, sf)).select("id", "seq")


@query("dd3_duplicate_of", f"WITH {LINES}, {KEYED} SELECT id, seq, first_value(src || ':' || id || ':' || seq) OVER w AS holder, row_number() OVER w = 1 AS is_first FROM keyed WINDOW w AS (PARTITION BY k ORDER BY src, id, seq)")
def dd3_duplicate_of(spark, sf):
    return M.duplicate_of(keyed(spark, sf)).select("id", "seq", F.concat_ws(":", "holder.src", "holder.id", "holder.seq").alias("holder"), "is_first")


@query("dd4_exact_text", "WITH r AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'kept' ELSE 'dropped' END AS part FROM documents), n AS (SELECT part, count(*)::BIGINT AS n FROM r GROUP BY part) SELECT part, n, doc_id AS dropped_id FROM n LEFT JOIN r USING (part) WHERE part = 'dropped' UNION ALL SELECT part, n, NULL FROM n WHERE part = 'kept'")
def dd4_exact_text(spark, sf):
    """How many stay and how many go, with a row for each id that goes."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("k"))
    marked = M.duplicate_of(docs, "k", ("doc_id",)).select("doc_id", F.when(F.col("is_first"), "kept").otherwise("dropped").alias("part"))
    gone = marked.where("part = 'dropped'").select("part", F.col("doc_id").alias("dropped_id"))
    return marked.groupBy("part").agg(F.count("*").alias("n")).join(gone, "part", "left")


@query("dd5_merge_reasons", f"WITH {LINES}, {KEYED}, {BENCH}, r AS (SELECT *, CASE WHEN NOT ({LOOSE}) THEN 'checker' WHEN k IN (SELECT k FROM known) THEN 'known' END AS reason0 FROM keyed), d AS (SELECT *, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY k, reason0 IS NULL ORDER BY src, id, seq) > 1 THEN 'duplicate' ELSE reason0 END AS reason FROM r) SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM d GROUP BY 1")
def dd5_merge_reasons(spark, sf):
    out = M.merged(keyed(spark, sf), ~M.loose_filter("text", LATIN), known(spark, sf))
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("dd6_union_first_chunks", f"WITH {LINES}, u AS (SELECT 0 AS part, id, seq, text FROM lines UNION ALL SELECT 1, item_id, 0, text FROM benchmark) SELECT part, id, seq::BIGINT AS seq FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, id, seq) AS rn FROM u) WHERE rn = 1")
def dd6_union_first_chunks(spark, sf):
    both = lines(spark, sf).select(F.lit(0).alias("part"), "id", "seq", "text").unionByName(table(spark, sf, "benchmark").select(F.lit(1).alias("part"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("seq"), "text"))
    return M.first_of_key(both, "text", ("part", "id", "seq")).select("part", "id", "seq")


@query("dd9_vocabulary_algebra", f"WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM documents) GROUP BY w), stems AS (SELECT DISTINCT regexp_extract(w, '^(.{{2,}})(tion|ing)$', 1) AS w FROM w WHERE regexp_matches(w, '^.{{2,}}(tion|ing)$')), forms AS (SELECT w FROM w WHERE n >= 3) SELECT 'stem' AS kind, w FROM stems WHERE w NOT IN (SELECT w FROM w WHERE n >= 100) UNION ALL SELECT 'form', w FROM forms")
def dd9_vocabulary_algebra(spark, sf):
    words = word_counts(spark, sf)
    stems = words.select(F.regexp_extract("w", "^(.{2,})(tion|ing)$", 1).alias("w")).where("w <> ''").distinct().join(words.where("n >= 100").select("w"), "w", "left_anti")
    return stems.select(F.lit("stem").alias("kind"), "w").union(words.where("n >= 3").select(F.lit("form"), "w"))


def word_counts(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


VOCAB = r"(SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) GROUP BY w)"
query("ag24_vocabulary", f"SELECT * FROM {VOCAB} WHERE n >= 3")(lambda spark, sf: word_counts(spark, sf).where("n >= 3"))


@query("ag1_counts", f"WITH {LINES}, {KEYED} SELECT src, cat, count(*)::BIGINT AS n FROM keyed GROUP BY GROUPING SETS ((src), (cat), ())")
def ag1_counts(spark, sf):
    return keyed(spark, sf).groupingSets([["src"], ["cat"], []], "src", "cat").agg(F.count("*").alias("n"))


@query("ag2_hours", f"WITH {LINES}, {KEYED} SELECT cat, count(*)::BIGINT AS n, round(sum({SECONDS}) / 3600, 6) AS hours FROM keyed GROUP BY ROLLUP (cat)")
def ag2_hours(spark, sf):
    return keyed(spark, sf).rollup("cat").agg(F.count("*").alias("n"), F.round(F.sum(T.speech_seconds("text")) / 3600, 6).alias("hours"))


@query("ag3_file_report", f"WITH {LINES}, {KEYED}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark), x AS (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS ws FROM keyed), y AS (SELECT src, id, seq, count(*) AS n, count(*) FILTER (WHERE w NOT IN (SELECT w FROM v)) AS fresh FROM (SELECT src, id, seq, unnest(ws) AS w FROM x) GROUP BY ALL) SELECT x.src, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT ({LOOSE}))::BIGINT AS bad, round(sum(len(ws)) / count(*)::DOUBLE, 6) AS words_per_line, round(sum(coalesce(fresh, 0)) / greatest(sum(len(ws)), 1)::DOUBLE, 6) AS new_share, count(DISTINCT k)::BIGINT AS keys FROM x LEFT JOIN y USING (src, id, seq) GROUP BY ROLLUP (x.src)")
def ag3_file_report(spark, sf):
    vocabulary = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).distinct()
    rows = keyed(spark, sf).withColumn("ws", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = rows.select("src", F.explode("ws").alias("w")).join(vocabulary.withColumn("old", F.lit(True)), "w", "left")
    fresh = words.rollup("src").agg(F.count_if(F.col("old").isNull()).alias("fresh"), F.count("*").alias("words"))
    report = rows.rollup("src").agg(F.count("*").alias("n_lines"), F.count_if(~M.loose_filter("text", LATIN)).alias("bad"), F.round(F.sum(F.size("ws")) / F.count("*"), 6).alias("words_per_line"), F.countDistinct("k").alias("keys"))
    both = report.join(fresh, report.src.eqNullSafe(fresh.src), "left")
    return both.select(report.src, "n_lines", "bad", "words_per_line", F.round(F.coalesce("fresh", F.lit(0)) / F.greatest(F.coalesce("words", F.lit(0)), F.lit(1)), 6).alias("new_share"), "keys")


@query("ag4_composition", f"WITH {LINES}, x AS (SELECT {TYPE} AS kind, {BIN} AS bin, {SECONDS} AS s FROM lines) SELECT kind, bin, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, round(sum(s) / 3600, 6) AS hours, round(median(s), 6) AS s50, round(quantile_cont(s, 0.9), 6) AS s90 FROM x GROUP BY kind, bin")
def ag4_composition(spark, sf):
    measured = lines(spark, sf, dealt=True).select(T.sentence_type("text").alias("kind"), T.length_bin("text").alias("bin"), T.speech_seconds("text").alias("s"))
    rows = kept(measured)  # read three times, and measured once
    by = Q.selected(rows, ["kind", "bin"], {"s50": Q.Place(F.col("s"), 0.5), "s90": Q.Place(F.col("s"), 0.9)}, {"n": F.count("*"), "hours": F.round(F.sum("s") / 3600, 6)})
    by = by.withColumns({k: F.round(k, 6) for k in ("s50", "s90")})
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over a dozen groups


@query("ag4_last_letters", f"WITH {LINES}, x AS (SELECT right(regexp_replace(lower(text), '[^\\p{{L}}]+', '', 'g'), 1) AS letter, count(*)::BIGINT AS n FROM lines GROUP BY 1) SELECT letter, n FROM x WHERE letter <> '' ORDER BY n DESC, letter LIMIT 12")
def ag4_last_letters(spark, sf):
    return lines(spark, sf).select(F.right(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", ""), F.lit(1)).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "letter").limit(12)


@query("ag21_breakdown", f"WITH {LINES} SELECT {TYPE} AS kind, lower(left(text, 1)) AS head, count(*)::BIGINT AS n, (sum({N}))::BIGINT AS words FROM lines GROUP BY ALL")
def ag21_breakdown(spark, sf):
    return breakdown(lines(spark, sf), lambda c: T.sentence_type(c), lambda c: F.lower(F.left(c, F.lit(1))))


def breakdown(rows, kind, head):
    """The key functions of a breakdown are plain functions from Column to Column."""
    return rows.groupBy(kind(F.col("text")).alias("kind"), head(F.col("text")).alias("head")).agg(F.count("*").alias("n"), F.sum(T.word_count("text")).alias("words"))


query("ud3_breakdown_key", f"WITH {LINES} SELECT {BIN} AS kind, right(text, 1) AS head, count(*)::BIGINT AS n, (sum({N}))::BIGINT AS words FROM lines GROUP BY ALL")(lambda spark, sf: breakdown(lines(spark, sf), T.length_bin, lambda c: F.right(c, F.lit(1))))


@query("wn1_numbers", f"WITH {LINES}, {KEYED} SELECT cat, id, seq, row_number() OVER (PARTITION BY cat ORDER BY src, id, seq)::INT AS number FROM keyed")
def wn1_numbers(spark, sf):
    return M.numbered(keyed(spark, sf)).select("cat", "id", "seq", F.col("number").cast("int").alias("number"))


@query("wn5_every_kth", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS number FROM documents) WHERE number % 7 = 0")
def wn5_every_kth(spark, sf):
    return M.numbered_overall(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"]).where("number % 7 = 0").select("doc_id")


@query("wn6_fixed_sample", "SELECT doc_id, n_chars FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 150")
def wn6_fixed_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.md5(F.concat_ws(":", F.lit(0), "doc_id")), "doc_id").limit(150)


@query("wn18_ordering", "SELECT source, doc_id, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id")
def wn18_ordering(spark, sf):
    return table(spark, sf, "documents").select("source", "doc_id", "n_chars").orderBy("source", F.desc("n_chars"), "doc_id")


@query("jn6_new_word_share", f"WITH {LINES}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark), x AS (SELECT src, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM lines) SELECT src, round(avg((v.w IS NULL)::INT), 6) AS new_share FROM x LEFT JOIN v USING (w) GROUP BY src")
def jn6_new_word_share(spark, sf):
    vocabulary = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).distinct().withColumn("old", F.lit(True))
    words = lines(spark, sf).select("src", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    return words.join(vocabulary, "w", "left").groupBy("src").agg(F.round(F.avg(F.col("old").isNull().cast("int")), 6).alias("new_share"))


@query("jn10_text_lookup", f"WITH {LINES}, {KEYED}, b AS (SELECT item_id, {KEY} AS k FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark)) SELECT DISTINCT item_id, id, seq FROM b JOIN keyed USING (k)")
def jn10_text_lookup(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("text")).select("item_id", T.loose_key("text").alias("k"))
    return items.join(keyed(spark, sf), "k").select("item_id", "id", "seq").distinct()


@query("jn12_longest_stem", f"WITH v AS {VOCAB}, words AS (SELECT w FROM v WHERE n >= 2), stems AS (SELECT w AS stem FROM v WHERE n >= 20 AND length(w) >= 2), cuts AS (SELECT w, unnest(range(2, length(w) + 1)) AS cut FROM words) SELECT w, max_by(stem, length(stem)) AS stem FROM cuts JOIN stems ON left(w, cut) = stem GROUP BY w")
def jn12_longest_stem(spark, sf):
    words = word_counts(spark, sf)
    stems = words.where("n >= 20 and length(w) >= 2").select(F.col("w").alias("stem"))
    sizes = stems.agg(F.collect_set(F.char_length("stem")).alias("sizes"))  # one row; only beginnings as long as some stem are made
    fit = F.filter("sizes", lambda n: n <= F.char_length("w"))
    cuts = words.where("n >= 2").crossJoin(sizes).select("w", F.explode(fit).alias("cut")).withColumn("stem", F.expr("left(w, cut)"))
    return cuts.join(stems, "stem").groupBy("w").agg(F.max_by("stem", "cut").alias("stem"))
