"""Spelling variants against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(n, ratio=5):
    form, out = {}, {}
    for w in n:
        found = sorted((-n[v], v) for v in n if near(w, v))
        form[w] = found[0][1] if found and -found[0][0] >= ratio * n[w] else None
        out[w] = len(found)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def words(size, alphabet, seed, longest=9):
    g = random.Random(seed)
    return {"".join(g.choice(alphabet) for _ in range(g.randint(1, longest))): 5 ** g.randint(0, 7) + g.randint(0, 2) for _ in range(size)}


@pytest.mark.parametrize(("alphabet", "symbols", "bits"), [("ab", 8, 26), ("aeéçl", 8, 26), ("aeéçl", 2, 26), ("abcdefghijklmnopqrstuvwxyzàüÿ÷", 8, 16), ("漢字🙂a", 3, 20)])
def test_groups_equal_brute_force(spark, alphabet, symbols, bits):
    n = words(500, alphabet, len(alphabet), 7)
    g = random.Random(1)
    for w in list(n)[:100]:
        i = g.randrange(len(w))
        n.setdefault(w[:i] + g.choice(alphabet) + w[i:], g.randint(1, 9))
    got = rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3), symbols=symbols, bits=bits))
    assert got == brute(n)


def test_chains_of_forms(spark):
    chain = ["abcdef"[:6] + "x" * i for i in range(12)]
    n = {w: 6**i for i, w in enumerate(chain)}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {r[2] for r in got} == {chain[-1]}


def test_neighbourhoods(monkeypatch):
    """All reduced words within one edit, each once, also when places are taken in parts."""
    for step in (variants.NEIGHBOURS, 1):
        monkeypatch.setattr(variants, "NEIGHBOURS", step)
        for s in ([1, 1, 2, 3, 3], [2], [1, 1, 1, 1]):
            q, want = 3, {tuple(s)}
            for i in range(len(s) + 1):
                want |= {(*s[:i], c, *s[i:]) for c in range(1, q + 1)}
                if i < len(s):
                    want |= {(*s[:i], c, *s[i + 1 :]) for c in range(1, q + 1)} | {(*s[:i], *s[i + 1 :])}
            got = np.concatenate([c for _, c in variants.neighbours(np.array([s], np.uint64), q)]).tolist()
            code = [0 if not w else int(variants.prefixes(np.array([w], np.uint64))[0, -1]) for w in want]
            assert len(got) == len(set(got)) and set(got) == set(code)


def test_edges(spark):
    rows = [("word", 3), ("word", 4), (None, 9), ("", 2), ("w" * 30_000, 5), ("w" * 30_001, 50), ("wore", 1)]
    docs = spark.createDataFrame(rows, "word string, n long").withColumns({c: F.lit(1) for c in ("code", "near", "form", "root", "b")})
    got = rows_of(variants.group_variants(docs))
    assert got == brute({"word": 7, "": 2, "w" * 30_000: 5, "w" * 30_001: 50, "wore": 1})
    assert variants.group_variants(docs.limit(0)).count() == 0


def test_ties_go_to_the_first_in_code_point_order(spark):
    n = {"housez": 50, "houseé": 50, "house": 5, "housea": 49}
    got = {r[0]: r for r in rows_of(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))}
    assert got["house"][1] == "housez" and got["house"][4] == 3


def test_query(spark, tmp_path):
    g = random.Random(9)
    base = ["".join(g.choice("abcdeéÀst") for _ in range(g.randint(4, 9))) for _ in range(150)]
    docs = []
    for i in range(900):
        w = [g.choice(base[: 2 + i % 150]) for _ in range(30)]
        docs.append((i * 7 if i % 50 else None, g.choice([" ", "-", "1", "×", ", "]).join(x.capitalize() if g.random() < 0.2 else x for x in w)))
    docs += [(5, None), (5, ""), (6, "123"), *[(7, "doubled DOUBLED doublet")] * 6]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    got = rows_of(variants.op13_variants(spark, str(tmp_path)))
    assert got == brute(n) and sum(r[1] is not None for r in got) > 3
