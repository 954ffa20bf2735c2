"""Training-data operators: edge cases for each, and results against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import byte_bpe, fingerprints, jaccard_join, language_id, line_dedup, media, mixing, quality_fm, substring_dedup, token_counts, webp
from corpusloom.llm.shingles import shingle_sets
from corpusloom.llm.store import range_bits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("aeiorstn") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows():
    base = [prose(rng.randint(20, 120)) for _ in range(40)]
    texts = [*base, base[0], base[1], base[2] + " tail of a near copy", None, "", " \n\t ", "one two", "one two", "İÉ\x1cß 🙂\n\nx", "Shared line.\n" + prose(30), prose(20_000)]
    texts += [f"shared LINE.  \n{prose(15)}" for _ in range(11)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base[5], "en", "s1", 3)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Further columns with the names of added ones and of those that the operators use inside."""
    inside = ("t", "l", "d", "h", "g", "n", "s", "p", "r", "own", "whole", "flags", "rt", "rl", "lettered", "size", "order", "row", "rows", "_t", "_d", "_s", "_n", "_h", "_kept", "_all", "_again", "_copy", "_order", "_lost", "_lettered", "_size")
    return df.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "n_lines", "n_dropped", "n_tokens", "ids", "shard", "fingerprint", *inside)})


def all_texts():
    return [r[1] for r in ROWS]


def test_quality_scores_every_row(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = quality_fm.train(docs, labels)
    got = quality_fm.score(clashing(docs), machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.score(empty, machine).count() == 0 and quality_fm.train(empty, labels) is None
    assert quality_fm.score(docs, None).first().score == 0.5


def test_factorisation_identity_equals_all_pairs():
    m = quality_fm.FactorisationMachine(30, 4)
    m.v = np.random.default_rng(0).normal(size=(30, 4)).astype(np.float32)
    s, x = np.array([3, 7, 9], np.int32), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(m.v[s[i]] @ m.v[s[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(s, x, np.array([0]))[0][0] == pytest.approx(pairs, rel=1e-5)


def test_language_network_gradients_and_positions(docs, empty):
    m = language_id.ByteGru(["a", "b"], 3, 5)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    g = np.random.default_rng(1)
    x, y, mask, w = g.integers(0, 256, (4, 5)), g.integers(0, 2, 4), np.ones((4, 5), bool), np.ones(4)
    grad = m.gradients(x, y, mask, w)[1]
    for k, at in (("uf", (1, 2)), ("ub", (0, 7)), ("tablef", (x[1, 2], 4)), ("out", (2, 1))):
        m.p[k][at] += 1e-4
        up = m.gradients(x, y, mask, w)[0]
        m.p[k][at] -= 2e-4
        assert grad[k][at] == pytest.approx((up - m.gradients(x, y, mask, w)[0]) / 2e-4, abs=1e-4)
        m.p[k][at] += 1e-4
    m = language_id.ByteGru(["en", "fr"])
    texts = [b"", b"x", b"abc" * 50, b"y" * (language_id.WINDOW * language_id.BLOCK + 5)]
    total, labelled = m.pooled(texts)
    assert labelled.sum(1).tolist() == [len(t) for t in texts] and np.allclose(total.sum(1), [len(t) for t in texts], rtol=1e-3)
    # the scoring pass and the training pass agree
    prob = m.position_probabilities(np.frombuffer(texts[2][:64], np.uint8)[None])
    states = np.concatenate([np.stack([s[6][0] for s in sorted(m._forward(np.frombuffer(texts[2][:64], np.uint8)[None], d), key=lambda s: s[0])]) for d in "fb"], 1)
    e = np.exp(states @ m.p["out"] + m.p["bias"])
    assert np.allclose(prob[:, :, 0], e / e.sum(1, keepdims=True), atol=1e-4)
    model = language_id.train(docs, 50, 20)
    got = language_id.identify(clashing(docs), model, keep_text=True).collect()
    assert len(got) == docs.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert language_id.identify(empty, model).count() == 0 and language_id.train(empty) is None and language_id.identify(docs, None).first().lang_pred == "und"


def brute_repeats(texts):
    seen, out = set(), []
    for raw in texts:
        turn, own = np.zeros(len(raw) + 1, int), set()
        for i in range(len(raw) - 49):
            own.add(raw[i : i + 50])
            if raw[i : i + 50] in seen:
                turn[i] += 1
                turn[i + 50] -= 1
        seen |= own
        out.append(np.frombuffer(raw, np.uint8)[np.cumsum(turn[:-1]) == 0].tobytes())
    return out


def test_repeats_equal_brute_force(spark, empty):
    passage = prose(30)
    texts = [prose(40), passage, "x " + passage + " y", passage[5:90] + "!", "ab" * 200, "ab" * 90, prose(10) + passage[20:] + prose(5), None, "", "short"]
    texts += [texts[0], texts[0][:60] + "-" + texts[0][60:], passage * 3]
    for batches in (1, 4):
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), batches=batches).collect()}
        want = brute_repeats([(t or "").encode() for t in texts])
        assert [bytes(got[i].kept) for i in range(len(texts))] == want
    assert substring_dedup.remove_repeats(empty).count() == 0
    odd = spark.createDataFrame([(None, passage), (5, passage), (5, passage), (5, "other " + passage), (9, passage)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.kept)) for r in substring_dedup.remove_repeats(odd).collect()) == sorted([(0, len(passage)), (5, len(passage)), (5, len(passage)), (5, len(passage) + 6), (9, 0)])


def test_hot_suffixes_are_spread_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(substring_dedup, "HOT_SEEN", 8)
    monkeypatch.setattr(substring_dedup, "HEAVY_WINDOWS", 5)
    g, passage = random.Random(8), prose(14)
    word = lambda: "".join(g.choice("bcdfghjk") for _ in range(12))
    texts = [f"{word()} {word()} {passage[g.randint(0, 12):]} {word()} {word()}" for _ in range(80)] + [passage, None, prose(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = substring_dedup.hot_suffixes(docs, 50)
    assert len(hot)
    rows = substring_dedup.batch_entries(docs.withColumn("tag", F.lit(0)), 6, 50, spark.sparkContext.broadcast(hot)).where(F.col("kind") == substring_dedup.ARRAY).collect()
    by, seen = {}, {}
    for r in rows:
        for suffix in (row[: substring_dedup.SUFFIX].tobytes() for row in substring_dedup._unplanes([r.block], substring_dedup.ENTRY)):
            by[suffix, r.p] = by.get((suffix, r.p), 0) + 1
            seen[suffix] = seen.get(suffix, 0) + 1
    suffix = max(seen, key=seen.get)
    assert max(n for (s, _), n in by.items() if s == suffix) <= seen[suffix] / 4
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])


def test_fingerprints(spark, docs, empty):
    texts = all_texts()
    prints = fingerprints.sketches(texts)
    sets = shingle_sets(texts)
    assert prints[40] == prints[0] and prints[43] == b"" == prints[44] == prints[45]
    errors = [fingerprints.likeness(prints[0], prints[i]) - len(np.intersect1d(sets[0], sets[i])) / max(1, len(np.union1d(sets[0], sets[i]))) for i in range(43)]
    assert np.abs(errors).max() < 0.15
    attempts, fingerprints.ATTEMPTS = fingerprints.ATTEMPTS, 0
    assert fingerprints.sketches(texts) == prints
    fingerprints.ATTEMPTS = attempts
    few = [(3, "abcdef"), (1, None), (2, "xyz" * 10)]
    got = {r.doc_id: r for r in fingerprints.with_edits(spark.createDataFrame(few, "doc_id long, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [got[i].edited_sha256 for i in (3, 2, 1)] == [sha("abcdxy"), sha(("xyz" * 10)[:20]), sha("")]
    assert fingerprints.with_edits(docs).count() == docs.count() and fingerprints.with_edits(empty).count() == 0
    assert fingerprints.fingerprint(clashing(docs)).count() == docs.count()


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0, 1), (3, 0)])
@pytest.mark.parametrize("how", [{}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 9, "references": True, "groups": 3}])
def test_webp_round_trips(transforms, how):
    g = np.random.default_rng(len(transforms))
    for h, w, k in ((1, 1, 2), (5, 7, 2), (9, 17, 16), (12, 21, 90)):
        image = g.integers(0, 256, (k, 4)).astype(np.uint8)[g.integers(0, k, (h, w))]
        assert (webp.decode(webp.encode(image, transforms, **how)) == image).all()


def file_of(width, height, bits):
    """A file around bits, which are given in the order in which they are read."""
    bits = "".join(bits.split())
    body = b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def test_webp_by_hand():
    byte = lambda n: format(n, "08b")[::-1]
    one = lambda n: "1 0 1" + byte(n)
    # subtract green; green is 10 or 20, red 5, blue 7, alpha 255
    codes = f"1 1 1 {byte(10)} {byte(20)} {one(5)} {one(7)} {one(255)} 1 0 0 0"
    assert webp.decode(file_of(3, 1, f"1 01 0 0 0 {codes} 0 1 0")).tolist() == [[[15, 10, 17, 255], [25, 20, 27, 255], [15, 10, 17, 255]]]
    # a palette of two colours, the second 1, 2, 3 and 0 more than the first; eight pixels in one byte, the first lowest
    table = f"0 1 1 1 {byte(8)} {byte(2)} 1 1 1 {byte(9)} {byte(1)} 1 1 1 {byte(7)} {byte(3)} 1 1 1 {byte(255)} {byte(0)} 1 0 0 0"
    # of two symbols the lesser has code 0: green 2 8, red 1 9, blue 3 7, alpha 0 255
    index = f"{one(0b00000110)} {one(0)} {one(0)} {one(255)} 1 0 0 0"
    first, second = [9, 8, 7, 255], [10, 10, 10, 255]
    got = webp.decode(file_of(4, 1, f"1 11 {byte(1)} {table} 1 1 1 1  0 0 0 0  0 0 0 {index}"))
    assert got.tolist() == [[first, second, second, first]]


def test_media_uses_what_the_format_offers(monkeypatch):
    import corpusloom.llm.webp as module

    met = set()
    read = module.read_tokens
    monkeypatch.setattr(module, "read_tokens", lambda *a: (met.update(np.digitize(read(*a)[0][:, 0], (256, 280)).tolist()), read(*a))[1])
    g = np.random.default_rng(2)
    text = b" ".join(bytes(g.choice(list(b"etaoin"), g.integers(1, 4)).tolist()) for _ in range(3000))
    for raw in (text, text[:1000] * 3, bytes(g.integers(0, 256, 5000).astype(np.uint8)) * 2):
        payload = media.padded(raw)
        assert media.pixels(media.store([payload])[0]).tobytes() == payload
    assert met == {0, 1, 2}  # literals, back-references, places in the cache
    few = media.store([media.padded(b"abcdabcdefgh" * 500)])[0]
    assert few[25] & 7 == 7 and media.pixels(few).tobytes() == media.padded(b"abcdabcdefgh" * 500)  # the palette transform


def test_pixel_column(spark):
    files = spark.createDataFrame([(1, 3, bytearray(media.store([media.padded(b"abc")])[0])), (2, None, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.pixel_column(files).collect()}
    assert (got[1].height, got[1].width, bytes(got[1].pixels)) == (1, 144, media.padded(b"abc")) and got[2].pixels is None and got[2].height is None


def test_media_round_trips(docs, empty):
    payloads = [media.padded(p) for p in (b"", b"x", b"y" * 576, bytes(range(256)) * 9, ("é " * 400).encode(), b"z" * 200_000)]
    assert [len(p) for p in payloads[:3]] == [576, 576, 576]
    files = media.store(payloads)
    assert [media.pixels(f).tobytes() for f in files] == payloads and media.store(payloads[3:4]) == files[3:4]
    with pytest.raises(ValueError):
        media.pixels(b"no image at all, but long enough to be read")
    assert media.media_column(docs).count() == docs.count() and media.media_column(empty).count() == 0


def test_lines_equal_brute_force(docs, empty):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for i, t in enumerate(all_texts()):
        for k in {key(x) for x in (t or "").split("\n")}:
            found.setdefault(k, set()).add(i)
    common = {k for k, v in found.items() if len(k) >= 1 and len(v) >= 10}
    want = sorted("\n".join(x for x in (t or "").split("\n") if key(x) not in common) for t in all_texts())
    for batches in (1, 4, 7):
        assert sorted(r.text for r in line_dedup.drop_common_lines(clashing(docs), batches=batches).collect()) == want
    assert common and line_dedup.drop_common_lines(empty).count() == 0


def test_encoding_equals_the_library(docs, empty):
    import public_tokenizers
    import tiktoken

    t = byte_bpe.tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    g = random.Random(1)
    texts = [x or "" for x in all_texts()] + ["".join(g.choice(["a", "é", "  ", "\n", "'s", "日本", "🙂", "9", "٣", "_", "x" * g.randint(1, 200)]) for _ in range(15)) for _ in range(200)]
    for x in texts:
        ids = t.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(x) and t.decode(ids) == x.encode()
    assert sorted({t.hash.find(k) for k in t.ranks}) == list(range(len(t.ranks))) and t.hash.find(b"no such entry") == -1
    back = byte_bpe.decode(byte_bpe.encode(clashing(docs)))
    assert sorted(r.text for r in back.collect()) == sorted(x or "" for x in all_texts()) and byte_bpe.encode(empty).count() == 0


def test_separator_scan(spark, docs, empty):
    ids = np.array([1, 2, 9, 9, 3, 9, 4, 5, 6, 7, 8, 1, 1, 9, 2], "<u2")
    for size in (1, 2, 4, 100):
        blocks = [("f", i // size, ids[i : i + size].tobytes()) for i in range(0, len(ids), size)] + [("empty", 0, b"")]
        got = token_counts.count_documents(spark.createDataFrame(blocks, "file string, block long, data binary"), end=9).collect()
        assert sorted((r.ordinal, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 1), (3, 7), (4, 1)]
    flat = token_counts.write_flat(docs, 64)
    n = sum(len(byte_bpe.tokenizer().encode(t or "")) // 4 for t in all_texts())
    assert token_counts.count_documents(flat.where("data is not null").select("file", "block", "data")).agg(F.sum("n_tokens")).first()[0] == n
    assert token_counts.write_flat(empty).count() == 0


def test_flat_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "RANGE_BYTES", 64)
    g, want = random.Random(6), {}
    for name in ("a", "b", "none"):
        ids = np.array([] if name == "none" else [9 if g.random() < 0.02 else 1 for _ in range(1001)], "<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 9)
        want[name] = np.diff(np.r_[-1, ends]) - 1
        if len(ids) - 1 > (ends[-1] if len(ends) else -1):
            want[name] = np.r_[want[name], len(ids) - 1 - ends[-1]]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # stands for the 2 GiB that a file's content may have
    try:
        for size in (7, 16, 5000):
            got = {}
            for r in token_counts.count_documents(token_counts.read_flat(spark, str(tmp_path), size), end=9).orderBy("ordinal").collect():
                got.setdefault(r.file.rsplit("/")[-1], []).append(r.n_tokens)
            assert got == {k: v.tolist() for k, v in want.items() if len(v)}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_jaccard_groups_equal_brute_force(spark, docs, empty):
    g = random.Random(4)
    texts, base = all_texts(), prose(60).split()
    for _ in range(60):  # near copies of one text, some of which reach others only over a third
        own = list(base)
        for _ in range(g.randint(0, 4)):
            own[g.randrange(len(own))] = g.choice(VOCABULARY)
        texts.append(" ".join(own))
    sets = shingle_sets(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and len(sets[j]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r for r in jaccard_join.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(sets[i]), find(i)) for i in range(len(texts))]
    assert jaccard_join.near_duplicate_groups(empty).count() == 0
    kept = jaccard_join.keep_one(clashing(docs))
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (40, 41, 42)").count() == 0


def test_keep_one_equals_brute_force_by_row(spark):
    a, b, c, d = (prose(40) for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (2, b), (None, a), (None, c), (None, c), (None, c + " tail"), (3, d), (3, d), (4, ""), (4, ""), (5, None), (None, ""), (None, ""), (6, d + " tail")]
    sets = shingle_sets([t for _, t in rows])
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").withColumn("t", F.xxhash64("text"))
    hashes = {r.n: r.t for r in docs.collect()}
    left, want = list(range(len(rows))), []
    while left:
        group, size = {left[0]}, 0
        while size < len(group):
            size = len(group)
            group |= {j for j in left for i in list(group) if len(sets[i]) and len(sets[j]) and 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]))}
        left = [i for i in left if i not in group]
        want.append(rows[min(group, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, hashes[n]))])
    want.remove((4, ""))  # of a repeated row without words one stays
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()), key=key) == sorted(want, key=key)


def test_ranges_follow_bytes_and_counts_are_summed_before_the_shuffle(spark, empty):
    long = spark.range(8, numPartitions=8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 800_000).alias("text"))
    assert (range_bits(long, 500, 1_000_000), range_bits(long, 500, 1_000_000, 5), range_bits(empty, 500, 1_000_000)) == (6, 5, 4)
    assert range_bits(spark.range(40_000).select("id", F.lit("x").alias("text")), 500, 1_000_000) == 7
    texts = ["a b c d e f " + prose(8) for _ in range(30)]
    blocks = jaccard_join.describe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 4, 5).where("block is not null")
    sets = np.concatenate(shingle_sets(texts)) >> np.uint64(24)
    u, c = np.unique(sets, return_counts=True)
    assert sum(len(r.block) // 5 for r in blocks.collect()) == len(u) < len(sets)
    token, df = jaccard_join.hot_tokens(blocks)
    assert (token.tolist(), df.tolist()) == (u[c >= jaccard_join.MIN_HOT].tolist(), c[c >= jaccard_join.MIN_HOT].tolist())


def test_mix_comes_near_its_targets(spark, empty):
    g = random.Random(2)
    many = [(i, prose(g.randint(1, 60)), None, g.choice(["a", "b", "b", "b", "c", None]), 1) for i in range(1500)] + [(9000, None, None, "a", 0), (9001, "w " * 7, None, "c", 0), (9001, "w " * 7, None, "c", 0)]
    docs = spark.createDataFrame(many, SCHEMA)
    plan = [r.asDict() for r in mixing.mix_plan(docs).collect()]
    total = sum(r["size"] * r["n_rows"] for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        t[1] += r["size"] * r["n_rows"] * len(r["shards"])
        assert len(r["shards"]) <= 2
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total) and all(abs(k - t) <= 0.02 * t for t, k, _ in by.values()) and all(t <= 2 * s + 1e-6 for t, _, s in by.values())
    free = {s: t / w for (s, w) in zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True) for t in [by[s][0]] if t < 2 * by[s][2] - 1e-6}
    assert len({round(v, 4) for v in free.values()}) == 1
    first = sorted((r.doc_id, r.shard) for r in mixing.mix(docs).collect())
    assert first == sorted((r.doc_id, r.shard) for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mix(clashing(docs)).columns.count("shard") == 1


def test_hypergeometric_follows_its_distribution(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    l = lambda x: F.lit(x).cast("long")
    got = u.select(mixing.hypergeometric(l(20), l(7), l(8), F.col("u")).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in got:
        assert r["count"] / 4000 == pytest.approx(comb(7, r.x) * comb(13, 8 - r.x) / comb(20, 8), abs=1e-3)
    quotas = spark.createDataFrame([(0, 50), (1, 3), (2, 0), (3, 47)], "s_idx int, n long")
    tree = mixing.split_tree(quotas, 8, 1).collect()
    assert [sum(r.counts[i].n for r in tree) for i in range(4)] == [50, 3, 0, 47] and {sum(c.n for c in r.counts) for r in tree} <= {12, 13}


def test_pipeline_stages(spark, docs, tmp_path):
    labelled = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).fillna({"lang": "en"})
    labelled.write.parquet(str(tmp_path / "documents.parquet"))
    stage, names = labelled, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, stage, str(tmp_path))
        if name != names[-1]:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        stage = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    assert stage.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for r in stage.limit(5).collect():
        assert len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) >= 0


def test_operators_take_columns_of_any_name(docs):
    """Columns named like those inside come through with their values."""
    odd = clashing(docs)
    for out in (line_dedup.drop_common_lines(odd), mixing.mix(odd), jaccard_join.keep_one(odd)):
        assert out.count() and out.where("t <> 'x' or _order <> 'x' or own <> 'x' or _kept <> 'x' or size <> 'x'").count() == 0


def test_lines_of_a_long_text_are_not_compared_with_each_other(spark):
    long = "\n".join([f"line {i % 30_000}" for i in range(60_000)] + ["common"] * 20_000)
    docs = spark.createDataFrame([(0, long)] + [(i, f"own {i}\ncommon") for i in range(1, 12)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (80_000, 20_000) and got[0].text == long[: long.index("\ncommon")] and got[3].text == "own 3"


def test_large_groups_are_parted(spark, monkeypatch):
    """Near copies of one text in more rows than a task takes, with shingles of more documents than a list takes."""
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 10)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    g, base, texts = random.Random(6), prose(50).split(), []
    for _ in range(90):
        own = list(base)
        for _ in range(g.randint(0, 5)):
            own[g.randrange(len(own))] = g.choice(VOCABULARY)
        texts.append(" ".join(own))
    sets = shingle_sets(texts)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label
