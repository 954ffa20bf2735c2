"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves each pre-token that is a vocabulary entry as a whole. Tier
two: any other pre-token is merged over linked bytes, with a heap that gives the pair of lowest rank, leftmost first. A
bounded cache holds the results for pre-tokens seen lately; it changes no result.

Edge cases: a null text is the empty text and has no ids; texts of any length are encoded as wholes, and so are
pre-tokens of any length, in n log n time; repeated rows give repeated results; further columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import Memo, in_batches, read

MEMO_ENTRIES = 150_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash by hashing and displacing: n keys to 0..n-1, each bucket with its own displacement."""

    LOAD = 4
    TRIES = 256

    def __init__(self, keys: list[bytes]):
        self.n, self.m = len(keys), max(1, len(keys) // self.LOAD)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys have one hash")
        bucket = (h >> np.uint64(32)) % np.uint64(self.m)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket.astype(int), minlength=self.m))[:-1])
        free = np.ones(self.n, bool)
        self.shift, slot = np.zeros(self.m, np.int64), np.zeros(self.n, np.int64)
        for b in sorted(range(self.m), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                start, done = 1, False
                while not done:
                    d = np.arange(start, start + self.TRIES, dtype=np.uint64)
                    at = self._slots(h[own][:, None], d[None, :])
                    good = free[at].all(0)
                    if len(own) > 1:
                        s = np.sort(at, 0)
                        good &= (s[1:] != s[:-1]).all(0)
                    if done := bool(good.any()):
                        j = int(np.argmax(good))
                        self.shift[b], slot[own] = int(d[j]), at[:, j]
                        free[at[:, j]] = False
                    start += self.TRIES
        rest = iter(np.flatnonzero(free).tolist())
        for b in range(self.m):  # a bucket of one key names its slot itself
            if len(members[b]) == 1:
                slot[members[b][0]] = s = next(rest)
                self.shift[b] = -s - 1
        self.key_at = [b""] * self.n
        self.index_at = [0] * self.n
        for i, s in enumerate(slot.tolist()):
            self.key_at[s], self.index_at[s] = keys[i], i
        self.shift = self.shift.tolist()

    def _slots(self, h, d):
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The index of a key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.m]
        if d < 0:
            s = -d - 1
        else:
            x = ((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
            s = (x >> 32) % self.n
        return self.index_at[s] if self.key_at[s] == key else -1


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO_ENTRIES):
        self.ranks, self.pattern, self.size = ranks, pattern, memo
        keys = list(ranks)
        self.hash, self.id_of = PerfectHash(keys), [ranks[k] for k in keys]
        self._ready()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "split", "bytes_of", "pairs")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def _ready(self):
        self.split = regex.compile(self.pattern)
        self.memo = Memo(self._pre_token, self.size)
        self.bytes_of = {i: k for k, i in self.ranks.items()}
        self.pairs = [-1] * 65_536
        for k, i in self.ranks.items():
            if len(k) == 2:
                self.pairs[k[0] << 8 | k[1]] = i

    def _pre_token(self, token: str) -> bytes:
        raw = token.encode()
        i = self.hash.find(raw)
        ids = [self.id_of[i]] if i >= 0 else self.merged(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of bytes by merges alone: the pair of lowest rank first, of equal ranks the leftmost.

        Part i runs from byte i to end[i]; rank[i] is that of part i joined to the next, or -1."""
        n, get, pop, push = len(raw), self.ranks.get, heapq.heappop, heapq.heappush
        pairs = self.pairs
        rank = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])]
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        rank.append(-1)
        end, prev = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            r, i = divmod(pop(heap), n)
            if rank[i] != r:
                continue
            j = end[i]
            e = end[i] = end[j]
            rank[j] = -1
            if e < n:
                prev[e] = i
                r = rank[i] = get(raw[i : end[e]], -1)
                if r >= 0:
                    push(heap, r * n + i)
            else:
                rank[i] = -1
            p = prev[i]
            if p >= 0:
                r = rank[p] = get(raw[p:e], -1)
                if r >= 0:
                    push(heap, r * n + p)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            e = end[i]
            out.append(ranks[raw[i:e]])
            i = e
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(load_ranks(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN)


def shared_tokenizer(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """The tokenizer as a broadcast: its size is that of the vocabulary file, whatever the data."""
    return spark.sparkContext.broadcast(tokenizer(path, pattern))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """docs' columns but text, then n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded: the
    bytes that decoding the ids gives."""
    bpe = shared_tokenizer(docs.sparkSession, path, pattern)
    own = [f for f in docs.schema.fields if f.name not in ("text", "n_tokens", "ids", "decoded")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "n_tokens long, ids binary", *["decoded binary"] * decoded])

    def run(batch):
        t = bpe.value
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = [t.encode(x or "") for x in part.column("text").to_pylist()]
            yield [*(part.column(f.name) for f in own), [len(x) // 4 for x in ids], ids, *[[t.decode(x) for x in ids]] * decoded]

    return in_batches(docs.select(*(f.name for f in own), "text"), run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(..., ids) -> (..., text): bytes that are no UTF-8 become replacement characters."""
    bpe = shared_tokenizer(encoded.sparkSession, path, pattern)
    own = [f for f in encoded.schema.fields if f.name not in ("text", "ids")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "text string"])

    def run(batch):
        t = bpe.value
        yield [*(batch.column(f.name) for f in own), [t.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]]

    return in_batches(encoded.select(*(f.name for f in own), "ids"), run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
