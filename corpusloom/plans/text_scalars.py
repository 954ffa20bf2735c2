"""Text measures over documents and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as T
from corpusloom.plans.base import W, lines, sql_loose_key, sql_n_words, sql_words, table, with_lines

AZ = "lower(translate({c}, 'Iİ', 'ıi'))"
VOWEL_COUNT = "length(regexp_replace(lower(translate({c}, 'Iİ', 'ıi')), '[^aeəıioöuü]', '', 'g'))"
MARK = "right(rtrim({c}), 1)"
TYPE = f"CASE {MARK.format(c='text')} WHEN '?' THEN 'question' WHEN '!' THEN 'exclamation' ELSE 'statement' END"
BIN = f"CASE WHEN {sql_n_words('text')} <= 5 THEN '1-5' WHEN {sql_n_words('text')} <= 10 THEN '6-10' WHEN {sql_n_words('text')} <= 15 THEN '11-15' ELSE '16+' END"
#: For the languages of the corpus, in place of those of the rules.
QUESTION_WORDS = "the|that|que|der|les"
PARTICLES = "ed|es|en"
SYMBOLS = "abcdefghijklmnopqrstuvwxyz"


def on_docs(name, sql, **columns):
    query(name, f"SELECT doc_id, {sql} FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", *(c().alias(k) for k, c in columns.items())))


def on_lines(name, sql, **columns):
    query(name, with_lines(f"SELECT id, seq, {sql} FROM lines"))(lambda spark, sf: lines(spark, sf).select("id", "seq", *(c().alias(k) for k, c in columns.items())))


on_docs("sc1_az_lower", f"{AZ.format(c='text')} AS low", low=lambda: T.az_lower("text"))
on_docs("sc2_az_capitalise", "CASE WHEN left(text, 1) = 'i' THEN 'İ' ELSE upper(left(text, 1)) END || substr(text, 2) AS cap", cap=lambda: T.az_capitalise("text"))
on_docs("sc3_scoring_words", rf"list_filter(string_split_regex(regexp_replace({AZ.format(c='text')}, '[^{W}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS words", words=lambda: T.scoring_words("text"))
on_lines("sc4_strict_key", rf"array_to_string(regexp_extract_all({AZ.format(c='text')}, '\p{{L}}+'), ' ') AS k", k=lambda: T.strict_key("text"))
on_lines("sc5_loose_key", f"{sql_loose_key('text')} AS k", k=lambda: T.loose_key("text"))
on_docs("sc6_squeezed", r"trim(regexp_replace(text, '\s+', ' ', 'g')) AS t", t=lambda: T.squeezed("text"))
on_docs("sc7_syllables", f"({VOWEL_COUNT.format(c='text')})::INT AS n", n=lambda: T.syllables("text"))
on_docs("sc8_speech_seconds", f"round({VOWEL_COUNT.format(c='text')} / 5.77::DOUBLE + 0.5::DOUBLE, 6) AS seconds", seconds=lambda: F.round(T.speech_seconds("text"), 6))
on_lines("sc9_sentence_type", f"{TYPE} AS kind", kind=lambda: T.sentence_type("text"))
on_lines("sc10_length_bin", f"{BIN} AS bin", bin=lambda: T.length_bin("text"))
_whole = rf"(^|[^{W}])({QUESTION_WORDS})($|[^{W}])"
_end = rf"({PARTICLES})($|[^{W}])"
on_lines("sc11_question_kind", f"CASE WHEN {MARK.format(c='text')} <> '?' THEN NULL WHEN regexp_matches(lower(text), '{_whole}') THEN 'question_word' WHEN regexp_matches(lower(text), '{_end}') THEN 'yes_no' ELSE 'other' END AS kind", kind=lambda: T.question_kind("text", QUESTION_WORDS, PARTICLES))
on_lines("sc12_alphabet_share", rf"round(length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{T.ALPHABET}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE, 9) AS share", share=lambda: F.round(T.alphabet_share("text"), 9))
on_lines("sc13_outside", f"""list_sort(list_filter(list_distinct(string_split(text, '')), lambda x: NOT contains('{T.ALLOWED}', x))) AS odd""", odd=lambda: T.outside("text"))
query("sc14_unicode_cleanup")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.cleaned("text").alias("clean")))
on_docs("sc14_strip_controls", r"regexp_replace(translate(text, chr(13) || chr(10) || chr(9), '   '), '\p{C}', '', 'g') AS clean", clean=lambda: T.strip_controls("text"))
on_docs("sc15_phoneme_cleanup", f"trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '()[]{{}}', ',,,,,,'), '[^{SYMBOLS}, ]', '', 'g'), '( *, *)+', ', ', 'g'), ' +', ' ', 'g')) AS p", p=lambda: T.phoneme_cleanup("text", SYMBOLS))
_share = rf"length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{T.ALPHABET}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE"
on_docs(
    "sc16_input_check",
    rf"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'empty' WHEN length(text) > 500 THEN 'too_long' WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN 'nothing_to_say' ELSE 'ok' END AS verdict, "
    rf"list_filter([CASE WHEN length(text) > 450 THEN 'near_limit' END, CASE WHEN regexp_matches(text, '[\p{{Cyrillic}}\p{{Greek}}\p{{Arabic}}\p{{Han}}]') THEN 'other_script' END, CASE WHEN {_share} < 0.5 THEN 'few_letters_of_the_language' END], lambda x: x IS NOT NULL) AS warnings",
    verdict=lambda: T.input_check("text")["verdict"],
    warnings=lambda: T.input_check("text")["warnings"],
)
on_lines("sc17_pause_after", f"(CASE {MARK.format(c='text')} WHEN '?' THEN 0.28 WHEN '!' THEN 0.24 WHEN '.' THEN 0.22 WHEN ';' THEN 0.16 WHEN ':' THEN 0.13 WHEN ',' THEN 0.09 ELSE 0.08 END)::DOUBLE AS pause", pause=lambda: T.pause_after("text"))


def _stressed(c):
    """Synthetic stress marks: one before every third letter that follows a consonant cluster's end."""
    return F.regexp_replace(F.lower(c), "([bcdfgklmnprst])([aeiou])", "$1'$2")


on_docs(
    "sc18_early_stress",
    rf"len(list_filter({sql_words(r'''regexp_replace(lower(text), '([bcdfgklmnprst])([aeiou])', '\1''\2', 'g')''')}, lambda w: contains(w, '''') AND length(regexp_replace(w, '[^aeəıioöuü]', '', 'g')) >= 2 AND length(regexp_replace(string_split(w, '''')[-1], '[^aeəıioöuü]', '', 'g')) > 1))::INT AS n",
    n=lambda: T.early_stress(_stressed(F.col("text"))),
)
on_lines("sc19_token_ids", f"list_concat([0], flatten(list_transform(list_filter(string_split(text, ''), lambda s: s <> '' AND contains('{SYMBOLS}', s)), lambda s: [ascii(s) - 96, 0]))) AS ids", ids=lambda: T.token_ids("text", SYMBOLS))
#: Each word's vowels, and the place of the first one behind a mark.
PHONEME_VOWELS = "[aeiouyæøœɐɑɒɔəɛɜɪɯʊʌʏıöü]"
PHONEME_WORDS = rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '([bcdfgklmnprst])([aeiou])', '\1''\2', 'g'), '\s+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, list_transform(ws, lambda w: {{'w': w, 'at': instr(w, '''')}}) AS ws FROM w)
SELECT doc_id, list_transform(ws, lambda x: {{'n_vowels': len(regexp_extract_all(x.w, '{PHONEME_VOWELS}'))::INT, 'stressed': CASE WHEN x.at > 0 AND regexp_matches(x.w[x.at + 1:], '{PHONEME_VOWELS}') THEN len(regexp_extract_all(x.w[1:x.at], '{PHONEME_VOWELS}')) ELSE -1 END::INT}}) AS words FROM m"""
query("sc20_phoneme_words", PHONEME_WORDS)(lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.phoneme_words(_stressed(F.col("text"))).alias("words")))
query("sc21_semitones", "SELECT event_id, round(12 * log2(value / 100), 6) AS st FROM events WHERE value > 0")(lambda spark, sf: table(spark, sf, "events").where("value > 0").select("event_id", F.round(T.semitones("value", F.lit(100.0)), 6).alias("st")))
on_docs("sc22_sha256", "sha256(text) AS sha", sha=lambda: F.sha2(F.encode("text", "UTF-8"), 256))
on_lines("sc23_padded_id", "format('{}_{:05d}', src, seq) AS pid", pid=lambda: T.padded_id("src", "seq"))
