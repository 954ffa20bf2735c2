"""Corpus rewriting: censuses of every rule, spoken texts, cutting, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as T
from corpusloom.operators import rewrite as R
from corpusloom.plans.base import spread, sql_words, table

RULES = {r.name: r for r in R.rules()}
IDS = {"phone": "tx4", "date_iso": "tx6", "date_dmy": "tx6", "date_dm": "tx6", "dotted": "tx7", "time": "tx8", "currency": "tx10", "currency_before": "tx10", "percent": "tx11", "unit": "tx12", "roman": "tx13", "roman_span": "tx13", "fraction": "tx14", "range": "tx15", "suffixed": "tx16", "number": "tx17", "acronym": "tx18"}
#: Patterns without look-around for the censuses that SQL can make too: the guards are taken as a captured character.
CENSUS = {"percent": (r"(\d{1,12} ?%)", "tx11"), "fraction": (r"(\d{1,9}/\d{1,9})", "tx14"), "digits": (r"(\d+)", "tx17"), "capitals": (r"(\p{Lu}{2,5})", "tx18"), "times": (r"(\d{1,2}:\d{2})", "tx8"), "dotted": (r"(\d+(?:\.\d+){2,})", "tx7")}


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def _register():
    for name, (pattern, number) in CENSUS.items():
        sql = f"WITH s AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '{pattern}')) AS span FROM documents) SELECT '{name}' AS rule, source, lang, count(*)::BIGINT AS n, count(DISTINCT span)::BIGINT AS spans, count(DISTINCT doc_id)::BIGINT AS docs FROM s GROUP BY source, lang"

        def run(spark, sf, rule=R.SpanRule(name, pattern[1:-1], None)):
            d = docs(spark, sf)
            return R.census(R.spans(d, rule), d)

        query(f"{number}_census_{name}", sql)(run)
    for name, number in IDS.items():

        def speak(spark, sf, rule=RULES[name]):
            return R.apply_rule(docs(spark, sf), rule).select("doc_id", "text")

        query(f"{number}_{name}")(speak)


_register()
TIDY = r"trim(regexp_replace(regexp_replace(translate(text, '‘’“”–—…' || chr(160), '''''' || chr(34) || chr(34) || '--.' || ' '), '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g'))"
query("tx1_tidy", f"SELECT doc_id, {TIDY} AS text FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", R.tidy("text").alias("text")))
query("tx2_abbreviations")(lambda spark, sf: docs(spark, sf).select("doc_id", R.abbreviations("text").alias("text")))


@query("tx3_foreign_words")
def tx3_foreign_words(spark, sf):
    """Foreign words as they are said, a written suffix harmonised, with a capital where one was or a sentence starts."""
    return R.apply_rule(R.apply_rule(docs(spark, sf), RULES["foreign_start"]), RULES["foreign"]).select("doc_id", "text")


query("tx5_thousands")(lambda spark, sf: docs(spark, sf).select("doc_id", R.thousands("text").alias("text")))
#: Without look-around a digit between two signs is taken twice: in a first and a second pass.
_OPERATORS = "text"
for _pattern, _said in ((r"(\d):(\d)", r"\1 \2"), (r"(\d)\s?[xх×]\s?(\d)", r"\1 vurulsun \2")):
    for _ in range(2):
        _OPERATORS = f"regexp_replace({_OPERATORS}, '{_pattern}', '{_said}', 'g')"
query("tx9_operators", f"SELECT doc_id, {_OPERATORS} AS text FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", R.operators("text").alias("text")))
#: Every number of a text beside the next one, joined by the signs in turn: what the corpus itself has few of.
_SIGNED = "regexp_replace(regexp_replace(regexp_replace(text, '([a-z]) ([a-z])', '\\1 1:2x3 \\2', 'g'), '([a-z]), ([a-z])', '\\1 4x5х6×7 \\2', 'g'), 'e', '8', 'g')"


@query("tx9_signed", f"WITH documents AS (SELECT doc_id, {_SIGNED} AS text FROM documents) SELECT doc_id, {_OPERATORS} AS text FROM documents")
def tx9_signed(spark, sf):
    """Scores and chained products between the words of every text."""
    c = F.regexp_replace(F.regexp_replace("text", "([a-z]) ([a-z])", "$1 1:2x3 $2"), "([a-z]), ([a-z])", "$1 4x5х6×7 $2")
    return docs(spark, sf).select("doc_id", R.operators(F.regexp_replace(c, "e", "8")).alias("text"))


_sym = "text"
for _a, _b in R.SYMBOLS.items():
    _sym = f"replace({_sym}, '{_a}', '{_b}')"
query("tx19_symbols", f"SELECT doc_id, {_sym} AS text FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", R.symbols("text").alias("text")))


@query("tx20_number_words")
def tx20_number_words(spark, sf):
    """The distinct whole numbers of the corpus in words, cardinal and ordinal."""
    found = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))).alias("span")).distinct()
    words = R.whole_words(F.col("span"))
    return found.select("span", words.alias("words"), R.ordinal_form(words).alias("ordinal"))


query("tx_spoken_form")(lambda spark, sf: R.spoken_form(spread(docs(spark, sf).select("doc_id", "text"), "doc_id")).select("doc_id", "text"))
N_WORDS = f"len({sql_words('text')})"


@query("tx21_chunks", f"SELECT doc_id, {N_WORDS}::BIGINT AS words, true AS within FROM documents WHERE {N_WORDS} > 0")
def tx21_chunks(spark, sf):
    """No word is lost and every chunk keeps to the limit."""
    chunks = R.chunk_rows(docs(spark, sf), 15, conjunctions=("and", "und", "et", "y"))
    return chunks.groupBy("doc_id").agg(F.sum(T.word_count("chunk")).alias("words"), (F.max(T.word_count("chunk")) <= 15).alias("within"))


#: Chunks as SQL: clauses are parted by a recursive query.
CONJ = ("and", "und", "et", "y")
CHUNKS_SQL = rf"""
WITH RECURSIVE sentences AS (
  SELECT doc_id, source, s, list_filter(string_split(parts[s], ' '), lambda x: x <> '') AS ws, parts[s] AS whole
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS s FROM (SELECT doc_id, source, list_filter(string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?;:]) ', '\1' || chr(1), 'g'), '^$', ''), chr(1)), lambda x: x <> '') AS parts FROM documents))
), clauses AS (
  SELECT doc_id, source, s, c, string_split(cs[c], ' ') AS ws FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS c FROM (SELECT doc_id, source, s, string_split(replace(whole, ', ', ',' || chr(1)), chr(1)) AS cs FROM sentences WHERE len(ws) > 15))
), marked AS (
  SELECT *, list_filter(range(1, len(ws) + 1), lambda i: list_contains(['and', 'und', 'et', 'y'], lower(trim(ws[i], ',.;:!?')))) AS conj FROM clauses
), seg(doc_id, source, s, c, ws, conj, a, b) AS (
  SELECT doc_id, source, s, c, ws, conj, 1::BIGINT, len(ws)::BIGINT FROM marked
  UNION ALL
  SELECT doc_id, source, s, c, ws, conj, unnest([a, cut]), unnest([cut - 1, b])
  FROM (SELECT *, list_sort(list_transform(list_filter(conj, lambda i: i >= a + 2 AND i <= b - 2), lambda i: {{'far': abs(i - a - (b - a + 1) // 2), 'i': i}}))[1].i AS cut FROM seg WHERE b - a + 1 > 15) WHERE cut IS NOT NULL
), ends AS (
  SELECT *, unnest(range(a, b + 1, 15)) AS f FROM seg
  WHERE b - a + 1 <= 15 OR len(list_filter(conj, lambda i: i >= a + 2 AND i <= b - 2)) = 0
), chunks AS (
  SELECT doc_id, source, s, 0 AS c, 1 AS f, whole AS chunk FROM sentences WHERE len(ws) BETWEEN 1 AND 15
  UNION ALL SELECT doc_id, source, s, c - 1, f, array_to_string(ws[f:least(f + 14, b)], ' ') FROM ends
)
"""


@query("tx21_chunk_texts", CHUNKS_SQL + "SELECT doc_id, (s - 1)::INT AS s, c::INT AS c, f::INT AS first, chunk FROM chunks")
def tx21_chunk_texts(spark, sf):
    return R.chunk_rows(docs(spark, sf), 15, conjunctions=CONJ).select("doc_id", "s", "k.c", F.col("k.a").alias("first"), "chunk")


@query("tx21_chunk_lengths", CHUNKS_SQL + "SELECT source, len(string_split(chunk, ' '))::INT AS words, count(*)::BIGINT AS n FROM chunks GROUP BY ALL")
def tx21_chunk_lengths(spark, sf):
    chunks = R.chunk_rows(docs(spark, sf), 15, conjunctions=CONJ).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return chunks.groupBy("source", T.word_count("chunk").alias("words")).agg(F.count("*").alias("n"))


@query("tx22_limited", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS letters, true AS within FROM documents WHERE length(regexp_replace(text, '\s+', '', 'g')) > 0")
def tx22_limited(spark, sf):
    """No letter is lost and every piece keeps to the limit, but for a mark just behind it."""
    pieces = R.limited_rows(docs(spark, sf), 280)
    return pieces.groupBy("doc_id").agg(F.sum(F.char_length(F.regexp_replace("piece", r"\s+", ""))).alias("letters"), (F.max(F.char_length("piece")) <= 281).alias("within"))


PIECES_SQL = rf"""
WITH RECURSIVE sentences AS (
  SELECT doc_id, s, trim(parts[s], ' ') AS whole FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([{R.LIMIT_ENDS}]) ?', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents))
), taken(doc_id, s, k, piece, rest) AS (
  SELECT doc_id, s, -1, NULL::VARCHAR, whole FROM sentences
  UNION ALL
  SELECT doc_id, s, k + 1, trim(left(rest, n), ' '), trim(substr(rest, n + 1), ' ') FROM (
    SELECT *, CASE WHEN length(rest) <= 40 THEN length(rest) WHEN m >= 21 THEN m WHEN b >= 20 THEN b ELSE 40 END AS n FROM (
      SELECT *, length(regexp_extract(left(rest, 41), '^(.*[{R.LIMIT_MARKS}])', 1)) AS m, length(regexp_extract(left(rest, 41), '^(.* )', 1)) - 1 AS b FROM taken WHERE rest <> ''))
)
SELECT doc_id, (s - 1)::INT AS s, k::INT AS k, piece FROM taken WHERE k >= 0
"""


@query("tx22_pieces", PIECES_SQL)
def tx22_pieces(spark, sf):
    """Pieces of forty characters, so that most sentences are cut."""
    return R.limited_rows(docs(spark, sf), 40)


STEMS, CLEAN = ("tion", "scum"), ("tions",)


def flags(spark, sf):
    lists = [spark.createDataFrame([(s,) for s in x], "stem string") for x in (STEMS, CLEAN)]
    return R.flagged_words(docs(spark, sf), *lists)


WORDS = r"w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)), f AS (SELECT doc_id, i, ws[i] AS word, regexp_replace(lower(translate(ws[i], 'Iİ', 'ıi')), '[^\p{L}]', '', 'g') AS f FROM w), b AS (SELECT doc_id, i, word, (starts_with(f, 'tion') OR starts_with(f, 'scum')) AND NOT starts_with(f, 'tions') AS bad FROM f)"
query("fl11_flagged_words", f"WITH {WORDS} SELECT doc_id, count(*) FILTER (WHERE bad)::BIGINT AS bad, count(*)::BIGINT AS words FROM b GROUP BY doc_id")(lambda spark, sf: flags(spark, sf).groupBy("doc_id").agg(F.count_if("bad").alias("bad"), F.count("*").alias("words")))
query("tx23_redacted", f"WITH {WORDS}, m AS (SELECT *, lag(bad) OVER (PARTITION BY doc_id ORDER BY i) AS b0 FROM b) SELECT doc_id, string_agg(CASE WHEN bad THEN '[…]' ELSE word END, ' ' ORDER BY i) FILTER (WHERE NOT (bad AND coalesce(b0, false))) AS text, count(*) FILTER (WHERE bad)::BIGINT AS n_bad FROM m GROUP BY doc_id")(lambda spark, sf: R.redacted(flags(spark, sf)))
query("tx24_segments", r"SELECT doc_id, list_filter(list_transform(string_split(text, 'tion'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS segments FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", R.marker_segments("text", "tion").alias("segments")))
query("tx27_paragraphs", "SELECT doc_id, i::INT AS pos, parts[i] AS paragraph FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[i]) <> ''")(lambda spark, sf: docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "paragraph")).where("trim(paragraph) <> ''").select("doc_id", (F.col("p") + 1).alias("pos"), "paragraph"))
