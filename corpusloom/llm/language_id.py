"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. A forward and a backward recurrent layer read each window; at
every byte their states give probabilities over the languages, so every position is labelled. A document's probability is
the mean over all its positions, its language the largest of these.

The network is fitted on a bounded sample: windows spread over whole texts of SAMPLE_DOCS labelled documents, those with
the smallest hash of doc_id. Scoring reads every byte of every text.

Edge cases: a null text or one without a letter is ``und`` with score 0; texts of any length are read as wholes, in
bounded memory; with no labelled document every text is ``und``; repeated rows give repeated results; further columns pass
through unless they bear the name of an added one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import held_out, in_batches, read, unused

WINDOW, HIDDEN = 64, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 8
STEPS, BATCH, RATE = 500, 256, 0.02
#: Windows in one pass of the network; it bounds memory, whatever the texts.
BLOCK = 4096
UND = "und"


class ByteGru:
    """Parameters by direction: table (256, 3h) is the input part, u (h, 3h) the recurrent part, both for z, r, n; out
    (2h, languages) and bias label a position."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, window: int = WINDOW, seed: int = 5):
        self.langs, self.h, self.window = langs, hidden, window
        rng = np.random.default_rng(seed)
        self.p = {f"{k}{d}": (rng.normal(0, s, shape)).astype(np.float32) for d in "fb" for k, s, shape in (("table", 0.5, (256, 3 * hidden)), ("u", 0.4, (hidden, 3 * hidden)))}
        self.p |= {"out": rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), np.float32)}

    # training

    def _forward(self, x: np.ndarray, d: str):
        h = self.h
        table, u, state, trace = self.p["table" + d], self.p["u" + d], np.zeros((len(x), h), np.float32), []
        for t in range(self.window) if d == "f" else range(self.window - 1, -1, -1):
            g, a = table[x[:, t]], state @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + a[:, : 2 * h])))
            z, r, un = zr[:, :h], zr[:, h:], a[:, 2 * h :]
            n = np.tanh(g[:, 2 * h :] + r * un)
            trace.append((t, state, z, r, un, n))
            state = n + z * (state - n)
            trace[-1] += (state,)
        return trace

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray):
        """Loss and gradients of a batch of windows: x (b, window) bytes, y (b,) languages, mask of real positions."""
        h, p = self.h, self.p
        traces = {d: self._forward(x, d) for d in "fb"}
        states = np.zeros((self.window, len(x), 2 * h), np.float32)
        for d, at in (("f", 0), ("b", h)):
            for step in traces[d]:
                states[step[0], :, at : at + h] = step[6]
        logits = states @ p["out"] + p["bias"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        prob = e / e.sum(2, keepdims=True)
        w = (mask.T * weight).astype(np.float32)
        w /= max(w.sum(), 1)
        loss = -(np.log(prob[:, np.arange(len(x)), y] + 1e-9) * w).sum()
        dl = prob
        dl[:, np.arange(len(x)), y] -= 1
        dl *= w[:, :, None]
        flat = dl.reshape(-1, dl.shape[2])
        grad = {"out": states.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(0)}
        dstates = dl @ p["out"].T
        for d, at in (("f", 0), ("b", h)):
            u, du, carry, inputs = p["u" + d], np.zeros_like(p["u" + d]), np.zeros((len(x), h), np.float32), []
            for t, before, z, r, un, n, _ in reversed(traces[d]):
                dh = dstates[t, :, at : at + h] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ da
                carry = dh * z + da @ u.T
                inputs.append((t, np.concatenate([dz, dr, dn], 1)))
            byte = np.concatenate([x[:, t] for t, _ in inputs])
            rows = np.concatenate([g for _, g in inputs])
            grad["u" + d] = du
            grad["table" + d] = np.stack([np.bincount(byte, rows[:, j], 256) for j in range(3 * h)], 1).astype(np.float32)
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        weight = (1 / np.maximum(share, 1e-6) ** 0.5).astype(np.float32)
        mask = np.arange(self.window)[None, :] < lengths[:, None]
        for i in range(1, steps + 1):
            at = rng.integers(0, len(x), BATCH)
            _, grad = self.gradients(x[at], y[at], mask[at], weight[y[at]])
            now = rate * (1 - (i - 1) / steps)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)

    # scoring

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, window) bytes -> (window, languages, n) probabilities. Sigmoids are taken as (1 + tanh(a / 2)) / 2, the
        halves folded into the weights."""
        h, n = self.h, len(x)
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)
        cols = np.ascontiguousarray(x.T)
        logits = np.empty((self.window, len(self.langs), n), np.float32)
        g, a, zr = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        for d, at in (("f", 0), ("b", h)):
            table = np.ascontiguousarray((self.p["table" + d] * half).T)
            u = np.ascontiguousarray((self.p["u" + d] * 0.5).T)
            out = np.ascontiguousarray(self.p["out"][at : at + h].T)
            state = np.zeros((h, n), np.float32)
            for t in range(self.window) if d == "f" else range(self.window - 1, -1, -1):
                np.take(table, cols[t], 1, g, "clip")
                np.matmul(u, state, a)
                np.add(g[: 2 * h], a[: 2 * h], zr)
                np.tanh(zr, zr)
                c, new = a[2 * h :], g[2 * h :]
                new += c
                c *= zr[h:]
                new += c
                np.tanh(new, new)
                np.subtract(state, new, c)
                state += new
                c *= zr[:h]
                state += c
                state *= 0.5
                if d == "f":
                    np.matmul(out, state, logits[t])
                else:
                    logits[t] += out @ state
        logits += self.p["bias"][:, None]
        np.subtract(logits, logits.max(1, keepdims=True), logits)
        np.exp(logits, logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]):
        """By text: the sum over its positions of the probabilities, and the positions labelled with each language."""
        k = len(self.langs)
        total, labelled = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
        for at, x, lengths in window_blocks(texts, self.window):
            prob = self.position_probabilities(x)
            if (short := np.flatnonzero(lengths < self.window)).size:
                dead = np.arange(self.window)[:, None] >= lengths[short][None, :]
                prob[:, :, short] *= ~dead[:, None, :]
            sums, best = prob.sum(0), prob.max(1)
            hits = np.stack([((prob[:, j] == best) & (best > 0)).sum(0) for j in range(k)])
            for j in range(k):
                total[:, j] += np.bincount(at, sums[j], len(texts))
                labelled[:, j] += np.bincount(at, hits[j], len(texts)).astype(np.int64)
        return total, labelled


def window_blocks(texts: list[bytes], window: int, block: int = BLOCK):
    """Blocks of windows: the index of each window's text, the bytes (n, window) with zeros past the end, the lengths."""
    for rows, parts, n in _grouped(texts, window * block):
        sizes = np.array([len(p) for p in parts])
        counts = -(-sizes // window)
        x = np.zeros(int(counts.sum()) * window, np.uint8)
        starts = np.r_[0, np.cumsum(counts)[:-1]] * window
        for s, p in zip(starts.tolist(), parts, strict=True):
            x[s : s + len(p)] = np.frombuffer(p, np.uint8)
        lengths = np.full(int(counts.sum()), window)
        lengths[np.cumsum(counts) - 1] = sizes - (counts - 1) * window
        yield np.repeat(rows, counts), x.reshape(-1, window), lengths


def _grouped(texts: list[bytes], most: int):
    rows, parts, n = [], [], 0
    for i, text in enumerate(texts):
        for s in range(0, len(text), most):  # a very long text spans several blocks
            part = text[s : s + most]
            if n and n + len(part) > most:
                yield rows, parts, n
                rows, parts, n = [], [], 0
            rows.append(i)
            parts.append(part)
            n += len(part)
    if parts:
        yield rows, parts, n


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> ByteGru | None:
    """Fits a network to docs (doc_id, text, lang); the rows to learn from are the caller's choice."""
    known = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    ids = [r[0] for r in known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    if not ids:
        return None

    def spread(batch):  # windows at even distances over the whole text
        got = []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            raw = text.encode()
            for s in np.unique(np.linspace(0, max(0, len(raw) - WINDOW), SAMPLE_WINDOWS).astype(int)).tolist():
                got.append((raw[s : s + WINDOW], lang))
        yield [[w for w, _ in got], [g for _, g in got]]

    rows = in_batches(known.where(F.col("doc_id").isin(ids)).select("text", "lang"), spread, "w binary, lang string").orderBy(F.xxhash64("w"), "w").collect()
    langs = sorted({r.lang for r in rows})
    model = ByteGru(langs)
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r.w)] = np.frombuffer(r.w, np.uint8)
    model.fit(x, np.array([langs.index(r.lang) for r in rows]), np.array([len(r.w) for r in rows]), steps)
    return model


def identify(docs: DataFrame, model: ByteGru | None, keep_text: bool = False) -> DataFrame:
    """docs' columns, with text only if asked for, then lang_pred, score (the pooled probability of lang_pred) and positions,
    the number of bytes that bear each language's label."""
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "positions", *["text"] * (not keep_text))]
    names = [f.name for f in own]
    lettered = unused("lettered", names)
    rows = docs.select(*names, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias(lettered))
    if model is None:
        return rows.select(*names, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,bigint>").alias("positions"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by HIDDEN and the number of languages
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "lang_pred string, score double, positions map<string,bigint>"])

    def run(batch):
        m = shared.value
        texts = [x.encode() if x is not None else b"" for x in batch.column(lettered).to_pylist()]
        total, labelled = m.pooled(texts)
        n = np.maximum([len(t) for t in texts], 1)
        best = total.argmax(1)
        yield [
            *(batch.column(n) for n in names),
            [m.langs[b] if t else UND for b, t in zip(best.tolist(), texts, strict=True)],
            [min(1.0, s) if t else 0.0 for s, t in zip((total.max(1) / n).tolist(), texts, strict=True)],
            [list(zip(m.langs, c, strict=True)) if t else [] for c, t in zip(labelled.tolist(), texts, strict=True)],
        ]

    return in_batches(rows, run, schema)


def train_on_known(docs: DataFrame) -> ByteGru | None:
    """The network of the query and the pipeline: rows that are held out stay unseen."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train_on_known(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "positions")
