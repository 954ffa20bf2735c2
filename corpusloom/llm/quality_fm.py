"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its hashed words (values of unit length together), bands of structure statistics (shares of
capitals, digits, marks and symbols, repetition of words and lines, lengths) and bands of its length as metadata. The score
is the logistic of  w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2],  which is linear in the features
that a document has.

Labels come from a bounded sample: TRAIN_DOCS labelled rows, those with the smallest hash of doc_id. Scoring reads whole texts.

Edge cases: a null text counts as empty, and empty texts get the score of their statistics; with no labelled row every score
is 0.5; repeated rows give repeated results; a doc_id with several labels is learnt once for each; further columns of docs
pass through unless they bear the name of an added one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import Memo, held_out, in_batches, read

BITS, FACTORS = 16, 8
TRAIN_DOCS, EPOCHS, BATCH, RATE = 6000, 12, 64, 0.05
THRESHOLD = 0.3
MEMO_WORDS = 300_000
WORD_SLOTS = 1 << BITS
BANDS = 12


def _class_table() -> np.ndarray:
    """Of each byte: 0 other, 1 small letter, 2 capital, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 symbol, 8 beyond ASCII."""
    t = np.zeros(256, np.int64)
    t[97:123], t[65:91], t[48:58], t[32], t[10], t[128:] = 1, 2, 3, 4, 5, 8
    t[[33, 44, 46, 58, 59, 63]] = 6
    t[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!,.:;?"]] = 7
    return t


CLASSES = _class_table()


def statistics(text: str, counts: Counter, n_words: int) -> list[float]:
    """Structure statistics, each from 0 to 1."""
    raw = text.encode()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by = np.bincount(CLASSES, by_byte, 9)
    n, letters = max(1, len(raw)), max(1.0, by[1] + by[2] + by[8])
    lines = text.split("\n")
    top = max(counts.values(), default=0)
    rare = sum(1 for c in counts.values() if c == 1)
    return [
        by[2] / letters, by[3] / n, by[4] / n, min(1.0, 10 * by[5] / n), min(1.0, 4 * by[6] / n), min(1.0, 4 * by[7] / n), by[8] / n,
        min(1.0, 20 * by_byte[33] / n), min(1.0, 20 * by_byte[124] / n), min(1.0, 20 * (by_byte[35] + by_byte[36] + by_byte[37] + by_byte[38] + by_byte[42]) / n),
        top / max(1, n_words), len(counts) / max(1, n_words), rare / max(1, len(counts)), 1 - len(set(lines)) / len(lines),
        min(1.0, len(text) / max(1, n_words) / 20), min(1.0, math.log1p(max(map(len, lines))) / 12), min(1.0, math.log1p(n_words) / 12),
    ]


N_STATS = 17
N_META = 16
SIZE = WORD_SLOTS + N_STATS * (BANDS + 1) + N_META

_words = Memo(lambda w: zlib.crc32(w.encode()) & (WORD_SLOTS - 1), MEMO_WORDS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a document."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    slots = np.fromiter(map(_words.__getitem__, counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    values /= max(1e-6, float(np.sqrt((values * values).sum())))
    more_slots, more_values = [], []
    for k, s in enumerate(statistics(text, counts, len(words))):
        # a share between two bands counts for both, so that scores change without steps
        x = math.sqrt(s) * (BANDS - 1)
        j = min(int(x), BANDS - 1)
        at = WORD_SLOTS + k * (BANDS + 1) + j
        more_slots += [at, at + 1]
        more_values += [1 - (x - j), x - j]
    more_slots.append(WORD_SLOTS + N_STATS * (BANDS + 1) + min(N_META - 1, len(text).bit_length()))
    more_values.append(1.0)
    return np.concatenate([slots, np.array(more_slots, np.int32)]), np.concatenate([values, np.array(more_values, np.float32)])


class FactorisationMachine:
    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, factors)).astype(np.float32)

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray):
        """Scores before the logistic of documents laid end to end, and the sums of each factor."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, 0)
        pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[slots] * values, starts) + pairs, sums

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        slots, values = (np.concatenate([d[k] for d in docs]) for k in range(2))
        starts = np.r_[0, np.cumsum([len(d[0]) for d in docs])[:-1]]
        return 1 / (1 + np.exp(-np.clip(self.raw(slots, values, starts)[0], -30, 30)))

    def fit(self, docs, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-4, seed: int = 4) -> None:
        """Logistic loss by gradients scaled with their running squares."""
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        self.w0 = math.log(share / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                part = [docs[i] for i in order[s : s + BATCH]]
                sizes = np.array([len(d[0]) for d in part])
                slots, values = (np.concatenate([d[k] for d in part]) for k in range(2))
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                raw, sums = self.raw(slots, values, starts)
                err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[order[s : s + BATCH]]
                e = (np.repeat(err, sizes) * values / len(part)).astype(np.float32)
                own, at = np.unique(slots, return_inverse=True)
                dw = np.bincount(at, e, len(own)) + decay * self.w[own]
                inner = e[:, None] * (np.repeat(sums, sizes, 0) - self.v[slots] * values[:, None])
                dv = np.stack([np.bincount(at, inner[:, f], len(own)) for f in range(inner.shape[1])], 1) + decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                g0 += float(err.mean()) ** 2
                self.w[own] -= (rate * dw / np.sqrt(gw[own])).astype(np.float32)
                self.v[own] -= (rate * dv / np.sqrt(gv[own])).astype(np.float32)
                self.w0 -= rate * float(err.mean()) / math.sqrt(g0)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> FactorisationMachine | None:
    """Fits a machine to docs (doc_id, text) and labels (doc_id, quality); which rows may be learnt from is the caller's choice."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_docs)

    def run(batch):
        got = [features(t) for t in batch.column("text").to_pylist()]
        yield [batch.column("doc_id"), batch.column("quality"), [s.tobytes() for s, _ in got], [v.tobytes() for _, v in got]]

    # the sample is bounded, and so is what reaches the driver: the distinct words of train_docs texts
    joined = docs.select("doc_id", "text").join(picked, "doc_id")
    rows = in_batches(joined.select("doc_id", "quality", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, slots binary, vals binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.quality, r.slots))
    if not rows:
        return None
    machine = FactorisationMachine()
    machine.fit([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.vals, np.float32)) for r in rows], np.array([r.quality for r in rows], np.float32))
    return machine


def score(docs: DataFrame, machine: FactorisationMachine | None) -> DataFrame:
    """docs' columns but text, then score."""
    own = [f for f in docs.schema.fields if f.name not in ("text", "score")]
    names = [f.name for f in own]
    if machine is None:
        return docs.select(*names, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of the size that BITS and FACTORS fix

    def run(batch):
        m = shared.value
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            yield [*(part.column(n) for n in names), m.scores([features(t) for t in part.column("text").to_pylist()]).astype(float)]

    return in_batches(docs.select(*names, "text"), run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "score double"]))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    machine = train(docs, labels.where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
