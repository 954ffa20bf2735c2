"""BPE with word ends against the tokenizers library and against merging by rank."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import word_bpe

PATH = public_tokenizers.path(word_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return word_bpe.tokenizer(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def table():
    return word_bpe.offset_table(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def by_rank(own, word):
    """A word's tokens by merging the pair of least rank, leftmost first, until none is left."""
    s = word.encode().decode("latin-1")
    first = {own.letter[t[0]]: i for i, t in enumerate(own.shown) if len(t) == 1}
    last = {own.letter[t[0]]: i for i, t in enumerate(own.shown) if t[1:] == own.end}
    whole = {m: i for i, m in enumerate(own.made) if m >= 0}
    parts = [first[c] for c in s[:-1]] + [last[s[-1]]]
    while best := min(((own.merge[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.merge), default=None):
        i = best[1]
        parts[i : i + 2] = [whole[best[0]]]
    return parts


TEXTS = ["", " ", "Hello World's  end", "<|endoftext|>a<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ İx ǅ ﬁ éé 가", "1234 x9y  \x1c\x85 z", "'s 'LL ''ve don'T", "🙂🙂 ünïcödé 漢字かな", "՘ ꟎\U0001a7cb \U000323b0 ᲉꟋ", "ab" * 5000, "!" * 700 + "a"]


def test_texts_as_the_library(own, table, library):
    g = random.Random(5)
    pieces = [t.replace("</w>", "") for t in library.get_vocab() if t.isascii() and "|" not in t]
    random_ones = ["".join(g.choice(pieces) for _ in range(g.randint(1, 6))) for _ in range(3000)] + ["".join(g.choice("aos") for _ in range(g.randint(1, 60))) for _ in range(500)]
    for text in TEXTS + random_ones:
        got, want = ids(own, text), library.encode(text, add_special_tokens=False).ids
        assert got == want, text
        assert table.decode(np.array(got, int)).decode() == library.decode(want, skip_special_tokens=False)


def test_code_points_as_the_library(own, library):
    points = [c for c in range(0, 0x40000, 1) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 23 == 0 or own.newer.match(chr(c)) and c % 5 == 0)]
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(own, text) == want.ids, hex(ord(text[1]))


def test_backtracking_equals_merging(own):
    g = random.Random(6)
    for _ in range(60):
        word = "".join(g.choice("abeinrst") for _ in range(g.randint(1, 14)))
        assert ids(own, word) == by_rank(own, word)
    # the longest tokens first would be wrong here: some words need a step back
    greedy = [w for w in ("".join(g.choice("aeinrst") for _ in range(9)) for _ in range(300)) if own.size[ids(own, w)[0]] < max(own.size[i] for i in range(len(own.made)) if own.size[i] and w.encode().decode("latin-1").startswith(own._symbols(own.shown[i])))]
    assert greedy


def test_pairs(own):
    g = random.Random(7)
    tokens = [i for i, m in enumerate(own.made) if m >= 0 and own.shown[i].isascii() and not own.shown[i].endswith(own.end)]
    ends = [i for i, m in enumerate(own.made) if m >= 0 and own.shown[i].isascii() and own.shown[i].endswith(own.end)]
    seen = set()
    for _ in range(400):
        x, y = g.choice(tokens), g.choice(ends)
        fits = own.compatible_pairs[x << 32 | y]
        seen.add(fits)
        assert fits == (by_rank(own, own.shown[x] + own.shown[y].removesuffix(own.end)) == [x, y])
    assert seen == {True, False}


def test_columns_and_edges(spark):
    rows = [(1, t, "k") for t in TEXTS] + [(None, None, None), (2, "same", "k"), (2, "same", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumns({"n_tokens": F.lit("x"), "decoded": F.lit(1), "word": F.col("text")})
    out = word_bpe.encode(docs)
    assert out.columns == ["doc_id", "decoded", "word", "n_tokens", "ids"]
    back = word_bpe.decode(out, keep_ids=True)
    assert back.columns == ["doc_id", "decoded", "word", "n_tokens", "ids", "text"]
    got = back.collect()
    assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got)
    assert [r.text for r in got if r.word is None] == [""]
    assert [(r.ids, r.decoded) for r in word_bpe.encode(docs, decoded=True).collect()] == [(r.ids, r.text) for r in got]
    assert word_bpe.encode(docs.limit(0)).count() == 0
    assert word_bpe.decode(out.withColumn("ids", F.lit(None).cast("array<int>"))).where("text <> ''").count() == 0


def test_query(spark, tmp_path, library):
    rows = [(i * 3 % 31, t) for i, t in enumerate([*TEXTS, None, "same", "same"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in word_bpe.op11_word_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(want, skip_special_tokens=False)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_other_vocabularies_are_refused():
    import json

    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)
    model["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="merge"):
        word_bpe.WordBpe(model)
