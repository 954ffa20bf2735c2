"""The ten queries as registered, on a small table, against brute force, the tokenizer library or held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import byte_bpe, fingerprints, jaccard_join, language_id, line_dedup, media, mixing, quality_fm, substring_dedup, token_counts
from corpusloom.llm.shingles import shingle_sets

WORDS = {k: ["".join(random.Random(f"{k}{i}").choice(letters) for _ in range(2 + i % 7)) for i in range(200)] for k, letters in {"en": "aeioustnrhd", "fr": "aeéèûilmrqv", "poor": "xzkwjy"}.items()}


def table():
    """(doc_id, text, lang, source, quality or None)"""
    g = random.Random(3)

    def prose(kind, n):
        return " ".join(g.choice(WORDS[kind]) for _ in range(n))

    passage, out = prose("en", 30), []
    for i in range(150):
        kind = ("en", "fr", "poor")[i % 3]
        text = prose(kind, g.randint(25, 90))
        if i % 10 == 4:
            text += " " + passage[g.randint(0, 9) :]
        if i % 9 == 2:
            text = f"  Shared LINE {i % 2}\n{text}\nshared line {i % 2}\t"
        out.append((text, "fr" if kind == "fr" else "en", int(kind != "poor")))
    for i in range(12):
        words = out[i][0].split(" ")
        words[g.randrange(len(words))] = "changed"
        out.append((" ".join(words), *out[i][1:]))
    out += [out[5], out[5], (None, None, 1), ("", "en", None), (" \n\t\n", "en", 0), ("1234 5678", "en", None), ("one two", "en", 1), ("one two", "en", None), ("İÉ\x1cß 🙂\n\nx", "fr", None), ("ab" * 300, "en", 0), (prose("en", 6000), "en", 1)]
    ids = random.Random(4).sample(range(1000, 9000), len(out))
    return [(d, t, lang, g.choice(["a", "a", "b", "c", None]), q) for d, (t, lang, q) in zip(ids, out, strict=True)]


TABLE = table()
TEXTS = {d: t or "" for d, t, *_ in TABLE}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in TABLE], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, *_, q in TABLE if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def by_id(df):
    rows = df.collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(TABLE) and set(got) == set(TEXTS)
    return got


def test_op1(spark, sf):
    got = by_id(quality_fm.op1_quality_fm(spark, sf))
    assert all(r.held_out == is_held_out(d) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    unseen = [(got[d].predicted, q) for d, t, _, _, q in TABLE if q is not None and is_held_out(d) and len(t or "") > 50]
    assert len(unseen) > 15 and sum(a == b for a, b in unseen) >= 0.9 * len(unseen)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality_fm.train(docs, labels.where(~quality_fm.held_out()))
    for d in list(TEXTS)[:5]:  # every pair of features, one by one
        slots, x = quality_fm.features(TEXTS[d])
        raw = float(m.w0) + float(m.w[slots] @ x) + sum(float(m.v[slots[i]] @ m.v[slots[j]]) * float(x[i] * x[j]) for i in range(len(x)) for j in range(i))
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-3)


def test_op2(spark, sf):
    got = by_id(language_id.op2_language_id(spark, sf))
    assert all(r.held_out == is_held_out(d) and 0 <= r.score <= 1 for d, r in got.items())
    assert all(r.lang_pred in (("en", "fr") if any(c.isalpha() for c in TEXTS[d]) else ("und",)) for d, r in got.items())
    unseen = [(got[d].lang_pred, lang) for d, t, lang, *_ in TABLE if is_held_out(d) and len(t or "") > 50]
    assert len(unseen) > 15 and sum(a == b for a, b in unseen) >= 0.9 * len(unseen)


def test_op3(spark, sf):
    got, seen = by_id(substring_dedup.op3_suffix_dedup(spark, sf)), set()
    for d in sorted(TEXTS):
        raw = TEXTS[d].encode()
        gone, own = np.zeros(len(raw), bool), set()
        for i in range(len(raw) - 49):
            own.add(raw[i : i + 50])
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    assert sum(r.n_spans > 0 for r in got.values()) > 20


def test_op4(spark, sf):
    got = by_id(fingerprints.op4_fingerprints(spark, sf))
    order = sorted(TEXTS, reverse=True)
    whole, edited, similar = [TEXTS[d] for d in order], [], []
    for t, after in zip(whole, whole[1:] + whole[:1], strict=True):
        n = len(t) // 3
        edited.append(t[: len(t) - n] + after[:n])
    both = lambda a, b: len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b)))
    sets, edited_sets = shingle_sets(whole), shingle_sets(edited)
    for i, d in enumerate(order):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(whole[i]), sha(edited[i])) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(sets[i]):
            similar.append((r.near_edited - both(sets[i], edited_sets[i]), r.near_next - both(sets[i], sets[(i + 1) % len(sets)])))
    assert np.abs(similar).max() < 0.2 and np.abs(similar).mean() < 0.04
    same = {}
    for d, t in TEXTS.items():
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_op5(spark, sf):
    got, same = by_id(media.op5_webp_media(spark, sf)), {}
    for d, t in TEXTS.items():
        raw, r = t.encode(), got[d]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        own = (r.media_bytes, r.media_sha256, r.feature)
        assert same.setdefault(t, own) == own
    files = {r.doc_id: bytes(r.media) for r in media.media_column(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all((got[d].media_bytes, got[d].media_sha256) == (len(f), sha(f)) for d, f in files.items())


def test_op6(spark, sf):
    got, found = by_id(line_dedup.op6_line_dedup(spark, sf)), {}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in TEXTS.items():
        for k in {key(x) for x in t.split("\n")}:
            found.setdefault(k, set()).add(d)
    common = {k for k, v in found.items() if k and len(v) >= line_dedup.MIN_DOCS}
    for d, t in TEXTS.items():
        kept = [x for x in t.split("\n") if key(x) not in common]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept), sha("\n".join(kept)))


def test_op7_and_op8(spark, sf):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.tokenizer().ranks, special_tokens={})
    got, counted = by_id(byte_bpe.op7_byte_bpe(spark, sf)), by_id(token_counts.op8_token_counts(spark, sf))
    for d, t in TEXTS.items():
        ids = library.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))
        assert counted[d].n_tokens == len(ids)


def test_op9(spark, sf):
    got, ids = by_id(jaccard_join.op9_jaccard_join(spark, sf)), sorted(TEXTS)
    sets, label = shingle_sets([TEXTS[d] for d in ids]), list(ids)
    for i in range(len(ids)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and len(sets[j]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert [(got[d].n_shingles, got[d].component_id) for d in ids] == [(len(s), c) for s, c in zip(sets, label, strict=True)]
    assert len(set(label)) < len(ids)


def test_op10(spark, sf):
    got, size, source = by_id(mixing.op10_source_mix(spark, sf)), {}, {}
    for d, t, _, s, _ in TABLE:
        size[d] = len([w for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w])
        source.setdefault(s, []).append(d)
    named = sorted((s for s in source if s is not None), key=lambda s: s.encode("utf-32-be")) + [None]
    sums = {s: sum(size[d] for d in source[s]) for s in named}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(named)}
    left, free, target = 1.5 * sum(sums.values()), set(named), {}
    while free:  # shares by weight; what exceeds twice its source is fixed and the rest shared anew
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * sums[s]}
        for s in over or set(free):
            target[s] = 2.0 * sums[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for d, _, _, s, _ in TABLE:
        assert (got[d].size, got[d].source_size) == (size[d], sums[s]) and got[d].target == pytest.approx(target[s]) and 0 <= got[d].taken <= 2 * size[d]
    for s in named:
        assert abs(sum(got[d].taken for d in source[s]) - target[s]) <= max(size[d] for d in source[s])
    assert {d: r.taken for d, r in by_id(mixing.op10_source_mix(spark, sf)).items()} == {d: r.taken for d, r in got.items()}
