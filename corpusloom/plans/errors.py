"""Error analysis on transcripts with planted errors: every k-th word of the text is replaced, so the counts are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as T
from corpusloom.operators import alignment as A
from corpusloom.plans.base import LINES, lines, table

#: A replaced word is in no text, so the alignment is forced; the word's letters are swapped one for one.
PLANTED = {"dataset": 11, "base": 5, "step": 7}
WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
BASE = f"{LINES}, clauses AS (SELECT id, src, seq, parts[part + 1] AS text, part FROM (SELECT id, src, seq, parts, unnest(range(0, len(parts))) AS part FROM (SELECT id, src, seq, string_split_regex(text, '[.!?,]+') AS parts FROM lines))), w AS (SELECT {{'id': id, 'seq': seq, 'part': part}} AS row_id, id, seq, part, src, text, {WORDS} AS ws FROM clauses), v AS (SELECT w.*, version, k FROM w, (VALUES ('dataset', 11), ('base', 5), ('step', 7)) t(version, k)), s AS (SELECT *, len(list_filter(range(1, len(ws) + 1), lambda i: (i + id) % k = 0))::BIGINT AS wrong FROM v WHERE len(ws) > 0)"


def transcripts(spark, sf, *versions):
    """row_id (id, seq, part), version, text, hyp in long form, by clause; texts are cut to plain letters first."""
    clauses = F.transform(F.split("text", "[.!?,]+"), lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")))
    rows = lines(spark, sf, dealt=True).select("id", "src", "seq", F.posexplode(clauses).alias("part", "text")).where("text <> ''").withColumn("row_id", F.struct("id", "seq", "part"))
    wide = rows.select("row_id", "id", "src", "text", *(_spoiled(k).alias(v) for v, k in PLANTED.items() if not versions or v in versions))
    return wide.unpivot(["row_id", "id", "src", "text"], [v for v in PLANTED if not versions or v in versions], "version", "hyp")


def _spoiled(k):
    words = F.split("text", " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i + 1 + F.col("id")) % k == 0, F.regexp_replace(w, ".", "0")).otherwise(w)), " ")


@query("ea1_edit_distance", r"SELECT w, levenshtein(w, replace(w, 'e', ''))::INT AS d FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def ea1_edit_distance(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return words.select("w", F.levenshtein("w", F.regexp_replace("w", "e", "")).alias("d"))


@query("ea2_word_distance", f"WITH {BASE} SELECT id, seq, part::INT AS part, version, wrong::INT AS wrong FROM s")
def ea2_word_distance(spark, sf):
    return transcripts(spark, sf).select("row_id.*", "version", A.word_distance(F.split("text", " "), F.split("hyp", " ")).alias("wrong"))


#: Letters of the words that were replaced.
WRONG_LETTERS = "coalesce(list_sum(list_transform(list_filter(range(1, len(ws) + 1), lambda i: (i + id) % k = 0), lambda i: length(ws[i]))), 0)"


@query("ea3_cer", f"WITH {BASE} SELECT id, seq, part::INT AS part, version, round({WRONG_LETTERS} / length(array_to_string(ws, ''))::DOUBLE, 6) AS cer FROM s")
def ea3_cer(spark, sf):
    """The error rate of every row, 0 where nothing is wrong."""
    return A.with_cer(transcripts(spark, sf)).select("row_id.*", "version", F.round("cer", 6).alias("cer"))


@query("ea4_corpus_score", f"WITH {BASE} SELECT version, count(*)::BIGINT AS clips, round(sum(wrong) / sum(len(ws))::DOUBLE, 6) AS wer, round(sum({WRONG_LETTERS}) / sum(length(array_to_string(ws, '')))::DOUBLE, 6) AS cer, count(*) FILTER (WHERE wrong / len(ws)::DOUBLE > 0.5)::BIGINT AS broken FROM s GROUP BY version")
def ea4_corpus_score(spark, sf):
    return A.corpus_score(A.scored(transcripts(spark, sf)), "version")


OPS_SQL = "o AS (SELECT row_id, version, k, id, i, n, w, (i + id) % k = 0 AS bad FROM (SELECT row_id, version, k, id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM s))"


@query("ea5_operations", f"WITH {BASE}, {OPS_SQL} SELECT row_id.id AS id, row_id.seq AS seq, row_id.part::INT AS part, version, (i - 1)::INT AS pos, CASE WHEN bad THEN 'sub' ELSE 'ok' END AS op, w AS ref, CASE WHEN bad THEN regexp_replace(w, '.', '0', 'g') ELSE w END AS hyp FROM o WHERE version IN ('step', 'dataset')")
def ea5_operations(spark, sf):
    """The alignment of every clause; a replaced word is in no text, so that it can only be substituted."""
    return A.operations(transcripts(spark, sf, "step", "dataset")).select("row_id.*", "version", "pos", "op", "ref", "hyp")


@query("ea6_letter_errors", f"WITH {BASE}, {OPS_SQL}, l AS (SELECT version, bad, unnest(string_split(w, '')) AS ref FROM o WHERE version IN ('step', 'dataset')), g AS (SELECT ref, count(*) FILTER (WHERE version = 'step') AS n, avg(bad::INT) FILTER (WHERE version = 'step') AS a, avg(bad::INT) FILTER (WHERE version = 'dataset') AS b FROM l GROUP BY ref) SELECT ref, n::BIGINT AS n, round(a, 6) AS rate, round(a - b, 6) AS excess FROM g WHERE n >= 30")
def ea6_letter_errors(spark, sf):
    return A.letter_errors(A.letter_operations(transcripts(spark, sf, "step", "dataset")), "step", "dataset")


@query("ea7_confusions", f"WITH {BASE}, {OPS_SQL}, l AS (SELECT version, unnest(string_split(w, '')) AS ref FROM o WHERE bad AND version = 'step'), g AS (SELECT version, ref || '>0' AS swap, count(*)::BIGINT AS n FROM l GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY n DESC, swap)::INT AS rank FROM g) WHERE rank <= 15")
def ea7_confusions(spark, sf):
    return A.confusions(A.letter_operations(transcripts(spark, sf, "step")), 15)


@query("ea8_model_only", f"WITH {BASE}, {OPS_SQL}, r AS (SELECT DISTINCT row_id, w FROM o WHERE version = 'dataset' AND NOT bad), m AS (SELECT o.w AS ref, count(*)::BIGINT AS n, min_by(regexp_replace(o.w, '.', '0', 'g'), {{'r': row_id, 'i': i}}) AS heard_as FROM o JOIN r USING (row_id, w) WHERE o.version = 'step' AND bad GROUP BY 1) SELECT * FROM m ORDER BY n DESC, ref LIMIT 40")
def ea8_model_only(spark, sf):
    return A.model_only(A.aligned(transcripts(spark, sf, "step", "dataset")), "step", "dataset")


@query("ea9_position_errors", f"WITH {BASE}, {OPS_SQL} SELECT version, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS place, round(avg(bad::INT), 6) AS rate, count(*)::BIGINT AS n FROM o WHERE version IN ('step', 'base') GROUP BY 1, 2")
def ea9_position_errors(spark, sf):
    return A.position_errors(A.aligned(transcripts(spark, sf, "step", "base")))


@query("ea10_breakdown", f"WITH {BASE} SELECT version, CASE WHEN len(ws) <= 5 THEN '1-5' WHEN len(ws) <= 10 THEN '6-10' WHEN len(ws) <= 15 THEN '11-15' ELSE '16+' END AS bin, count(*)::BIGINT AS clips, round(sum(wrong) / sum(len(ws))::DOUBLE, 6) AS wer FROM s GROUP BY ALL")
def ea10_breakdown(spark, sf):
    return A.corpus_score(A.scored(transcripts(spark, sf).withColumn("bin", T.length_bin("text"))), "version", "bin").select("version", "bin", "clips", "wer")


GRID_SQL = f"""WITH {BASE}, {OPS_SQL}, l AS (SELECT version, bad, unnest(string_split(w, '')) AS ref FROM o),
a AS (SELECT version, round(sum(wrong) / sum(len(ws))::DOUBLE, 6) AS wer, round(sum(wrong) FILTER (WHERE len(ws) <= 5) / (sum(len(ws)) FILTER (WHERE len(ws) <= 5))::DOUBLE, 6) AS wer_short FROM s GROUP BY version),
p AS (SELECT version, round(avg(bad::INT) FILTER (WHERE i = 1), 6) AS first, round(avg(bad::INT) FILTER (WHERE i > 1 AND i < n), 6) AS middle, round(avg(bad::INT) FILTER (WHERE i > 1 AND i = n), 6) AS last FROM o GROUP BY version),
q AS (SELECT version, round(avg(bad::INT) FILTER (WHERE ref = 'e'), 6) AS e, round(avg(bad::INT) FILTER (WHERE ref = 'n'), 6) AS n FROM l GROUP BY version)
SELECT * FROM a JOIN p USING (version) JOIN q USING (version)"""


@query("ea11_experiment_grid", GRID_SQL)
def ea11_experiment_grid(spark, sf):
    """One row a variant: WER of all and of short rows, error rates by place, and of two letters."""
    rows = transcripts(spark, sf)
    short = lambda c: F.when(F.col("short"), F.col(c))
    wer = [F.round(F.sum("wrong") / F.sum("words"), 6).alias("wer"), F.round(F.sum(short("wrong")) / F.sum(short("words")), 6).alias("wer_short")]
    words = A.word_counts(A.aligned(rows.withColumn("short", T.word_count("text") <= 5), "short"), "short")
    words = words.groupBy("version").agg(*wer, *(F.round(wrong / n, 6).alias(place) for place, (wrong, n) in A.by_place().items()))
    letters = A.letter_operations(rows).where("ref in ('e', 'n')").groupBy("version").pivot("ref", ["e", "n"]).agg(F.round(F.sum(F.when(F.col("op") != "ok", F.col("n")).otherwise(0)) / F.sum("n"), 6))
    return words.join(letters, "version")


@query("ea12_against_normalised", f"WITH {BASE} SELECT id, seq, part::INT AS part, CASE WHEN (id + seq + part) % 10 <> 0 THEN round(CASE WHEN (id + seq + part) % 3 = 0 THEN 1 + wrong - ((1 + id) % k = 0)::INT ELSE wrong END / len(ws)::DOUBLE, 6) END AS wer FROM s WHERE version = 'step'")
def ea12_against_normalised(spark, sf):
    """Against the normalised text, whose first word differs, where there is one; a failed hypothesis keeps its row."""
    number = F.col("row_id.id") + F.col("row_id.seq") + F.col("row_id.part")
    other = F.when(number % 3 == 0, F.regexp_replace("text", "^[a-z]+", "1"))
    rows = transcripts(spark, sf, "step").withColumn("normalised", other).withColumn("hyp", F.when(number % 10 != 0, F.col("hyp")))
    ref = T.scoring_words(F.coalesce("normalised", "text"))
    return rows.select("row_id.*", F.round(A.word_distance(ref, T.scoring_words("hyp")) / F.greatest(F.size(ref), F.lit(1)), 6).alias("wer"))


@query("ea13_long_texts", r"WITH w AS (SELECT conv_id, list_filter(string_split_regex(regexp_replace(lower(translate(string_agg(text, ' ' ORDER BY turn), 'Iİ', 'ıi')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM conversations GROUP BY conv_id) SELECT conv_id, len(ws)::INT AS words, round(len(list_filter(range(0, len(ws)), lambda i: i % 9 = 4 AND ws[i + 1] <> '0')) / greatest(len(ws), 1)::DOUBLE, 6) AS wer FROM w")
def ea13_long_texts(spark, sf):
    turns = table(spark, sf, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    whole = turns.groupBy("conv_id").agg(text.alias("text"))
    ref = T.scoring_words("text")
    hyp = F.transform(ref, lambda w, i: F.when(i % 9 == 4, F.lit("0")).otherwise(w))
    return whole.select("conv_id", F.size(ref).alias("words"), F.round(A.word_distance(ref, hyp) / F.greatest(F.size(ref), F.lit(1)), 6).alias("wer"))


#: Numbers become words in place, so words keep their places and runs are islands of changed ones.
RUNS_SQL = rf"""WITH {LINES}, w AS (SELECT id, seq, unnest(range(1, len(a) + 1)) AS i, a, b FROM (SELECT id, seq, {{0}} AS a, {{1}} AS b FROM lines WHERE regexp_matches(text, '\d'))),
c AS (SELECT id, seq, i, a[i] AS x, b[i] AS y, i - row_number() OVER (PARTITION BY id, seq ORDER BY i) AS island FROM w WHERE a[i] <> b[i]),
r AS (SELECT id, seq, min(i) AS place, string_agg(x, ' ' ORDER BY i) AS before, string_agg(y, ' ' ORDER BY i) AS after FROM c GROUP BY id, seq, island)
SELECT id, seq, list({{{{'before': before, 'after': after}}}} ORDER BY place) AS runs FROM r GROUP BY id, seq"""
_SPLIT = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


@query("ea14_changed_runs", RUNS_SQL.format(_SPLIT.format("text"), _SPLIT.format("regexp_replace(text, '\\d+', 'number', 'g')")))
def ea14_changed_runs(spark, sf):
    rows = lines(spark, sf).withColumn("after", F.regexp_replace("text", r"\d+", "number"))
    return rows.where("text <> after").select("id", "seq", A.changed_runs("text", "after").alias("runs"))


query("ud4_alignment_function", f"WITH {BASE}, {OPS_SQL}, c AS (SELECT row_id FROM s WHERE version = 'step' AND wrong > 0) SELECT row_id.id AS id, row_id.seq AS seq, row_id.part::INT AS part, (i - 1)::INT AS at, CASE WHEN bad THEN 'sub' ELSE 'ok' END AS op FROM o JOIN c USING (row_id) WHERE version = 'step'")(lambda spark, sf: transcripts(spark, sf, "step").where("text <> hyp").select("row_id.*", F.posexplode(A.align(T.scoring_words("text"), T.scoring_words("hyp"))).alias("at", "step")).select("id", "seq", "part", "at", "step.op"))
