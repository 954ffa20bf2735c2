"""Phrase collocations against counting everything."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import phrases


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counts(rows):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, total


def brute(rows, least, most):
    f, total = counts(rows)
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = (q for (g, q), n in f.items() if g == lang and n >= least and len(q) > len(p) and 100 * n >= 80 * a)
        if any(p == q[i : i + len(p)] for q in inside for i in range(len(q) - len(p) + 1)):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, v in found.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:most]))


def table(n=400, seed=1):
    g = random.Random(seed)
    words = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 3))) for _ in range(60)]
    fixed = ["new york city hall", "of the", "at the end of", "Ünï x", "a a a a a a"]
    rows = []
    for i in range(n):
        w = [g.choice(words[: 5 + i % 55]) if g.random() < 0.8 else g.choice(fixed) for _ in range(g.randint(0, 40))]
        text = "".join(x + g.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", "\x1c", "  ", ", "]) for x in w)
        rows.append((g.choice(["en", "en", "fr", None]), text.upper() if i % 11 == 0 else text))
    return rows + [("en", None), ("en", ""), (None, None), ("de", " . "), ("xx", "rare words here")] + [("en", "copy of a copy")] * 90 + [("fr", "q " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("shards", "least"), [(3, 30), (5, 12), (1, 45)])
def test_collocations_equal_brute_force(spark, shards, least):
    rows = table()
    got = rows_of(phrases.collocations(frame(spark, rows), 50, least, shards))
    want = brute(rows, least, 50)
    assert len(want) > 15 and {x[0] for x in want} == {"en", "fr", "und"}
    assert got == want


def test_slots_shared_by_phrases_change_nothing(spark):
    """With 64 slots most phrases are active too soon."""
    rows = table(150, 2)
    frequent, totals = phrases.frequent_phrases(frame(spark, rows), 20, 4, slot_bits=6)
    f, total = counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent.collect()} == {k: n for k, n in f.items() if n >= 20}
    assert {r.lang: r.n for r in totals.collect() if r.n} == {k: n for k, n in total.items() if n}


def test_tokens_summed_up_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TASK_TOKENS", 50)
    rows = table(120, 3)
    assert rows_of(phrases.collocations(frame(spark, rows), 2000, 15)) == brute(rows, 15, 2000)


def test_many_rows_of_a_language_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ORDERED_ROWS", 7)
    rows = table(200, 4)
    plain = phrases.collocations(frame(spark, rows), 3, 15)
    assert rows_of(plain) == brute(rows, 15, 3)


def test_columns_and_empty_tables(spark):
    docs = frame(spark, [("en", "the end")] * 40).withColumns({c: F.lit("x") for c in ("shard", "n", "k", "phrase", "active", "slot", "rank")})
    assert rows_of(phrases.collocations(docs)) == [("en", 1, "the end", 40, 40, 40, 80, 1_000_000)]
    out = phrases.collocations(docs.limit(0))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_products_of_more_than_64_bits(spark):
    big = 9_000_000_000_000_000
    frequent = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big), ("en", 2, "x y", big - 1)], "lang string, k int, phrase string, n long")
    got = phrases.scored(frequent, spark.createDataFrame([("en", 3 * big)], "lang string, n long")).collect()
    assert [(r.a, r.score) for r in got] == [(big - 1, 2_000_000 * (big - 1) // (2 * big))]


def test_query(spark, tmp_path):
    rows = table(300, 5)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(phrases.op12_collocations(spark, str(tmp_path))) == brute(rows, 30, 2000)
