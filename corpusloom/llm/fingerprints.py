"""Document fingerprints by one-permutation MinHash.

The shingles of a document are hashed once. The top bits of a hash choose one of BINS bins, which keeps its least hash.
Empty bins are filled by optimal densification: each draws bins by a hash of (bin, attempt), the same for every document,
until one is not empty, and copies it. The low KEPT bits of each bin are packed. The likeness of two fingerprints is the
share of equal bins, corrected for those that agree by chance: (share - 2^-b) / (1 - 2^-b), from 0 to 1.

Edge cases: a null or empty text, or one of white space, has the empty fingerprint ''; its likeness is 1 to another empty
one and 0 to any other. Texts of any length are hashed as wholes. Rows that share doc_id and text are one document for the
order of ``with_edits`` and get equal rows; null doc_ids come last in descending order; of rows that share doc_id only, the
hash of the text decides. A single document is its own next one. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mixed, shingle_hashes
from corpusloom.llm.store import cut_points, in_batches, read

BINS, KEPT = 512, 4
#: Draws that are made for all texts together, before the rest goes by a table of first draws.
ATTEMPTS = 24
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=256)
def _probe(attempt: int, bins: int) -> np.ndarray:
    """The bin that each bin draws at an attempt."""
    return (mixed(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 2 + 1)) % np.uint64(bins)).astype(np.int64)


@lru_cache(maxsize=4)
def _first_draw(bins: int) -> np.ndarray:
    """By bin: the first attempt that draws each other bin."""
    first, at, all_bins = np.full((bins, bins), -1), 0, np.arange(bins)
    while (first < 0).any():
        probe = _probe.__wrapped__(at, bins)
        new = first[all_bins, probe] < 0
        first[all_bins[new], probe[new]] = at
        at += 1
    return first


def low_bits(texts: list[str | None], bins: int = BINS, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """The kept bits of each bin, a row for each text, and which texts have a shingle at all."""
    hashes = shingle_hashes(texts)
    every = np.concatenate([*hashes, np.empty(0, np.uint64)])
    doc = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    shift = np.uint64(64 - bins.bit_length() + 1)
    table = np.full(len(texts) * bins, NONE, np.uint64)
    np.minimum.at(table, doc * bins + (every >> shift).astype(np.int64), every)
    table = table.reshape(len(texts), bins)
    full = table != NONE
    some = full.any(1)
    rows, cols = np.nonzero(~full & some[:, None])
    for at in range(ATTEMPTS):  # optimal densification
        probe = _probe(at, bins)[cols]
        hit = full[rows, probe]
        table[rows[hit], cols[hit]] = table[rows[hit], probe[hit]]
        rows, cols = rows[~hit], cols[~hit]
    if rows.size:  # few full bins: the one that each empty bin would draw first
        first, edge = _first_draw(bins), np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own, there = rows[a], np.flatnonzero(full[rows[a]])
            table[own, cols[a:z]] = table[own, there[first[cols[a:z]][:, there].argmin(1)]]
    # the kept bits depend on the bin too: a value copied into many bins agrees with another by chance in few of them only
    return (mixed(table + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << kept) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray, kept: int = KEPT) -> list[bytes]:
    """The kept bits without gaps: the stored fingerprints."""
    if not len(low):
        return []
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - kept :].reshape(len(low), -1)
    rows = np.packbits(bits, 1)
    return [rows[i].tobytes() if some[i] else b"" for i in range(len(low))]


def sketches(texts: list[str | None], bins: int = BINS, kept: int = KEPT) -> list[bytes]:
    """The packed fingerprint of each text."""
    return packed(*low_bits(texts, bins, kept), kept)


def likenesses(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """Of rows of kept bits: the share of equal bins, corrected for those that agree by chance."""
    chance = 2.0**-kept
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def likeness(a: bytes, b: bytes, bins: int = BINS, kept: int = KEPT) -> float:
    if not a or not b:
        return float(a == b)
    x, y = (np.unpackbits(np.frombuffer(p, np.uint8))[: bins * kept].reshape(bins, kept) for p in (a, b))
    chance = 2.0**-kept
    return float(np.clip(((x == y).all(1).mean() - chance) / (1 - chance), 0, 1))


def fingerprint(docs: DataFrame, bins: int = BINS, kept: int = KEPT) -> DataFrame:
    """docs' columns but text, then fingerprint (binary)."""
    own = [f for f in docs.schema.fields if f.name not in ("text", "fingerprint")]

    def run(batch):
        for s in range(0, batch.num_rows, 200):
            part = batch.slice(s, 200)
            yield [*(part.column(f.name) for f in own), sketches(part.column("text").to_pylist(), bins, kept)]

    return in_batches(docs.select(*(f.name for f in own), "text"), run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "fingerprint binary"]))


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as much of the next document, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _bucket(bounds: list[float]):
    """The bucket of a doc_id in descending order, by a search in halves; nulls fall into the last one."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & (F.get(edges, mid) < F.col("doc_id").cast("double"))
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length() + 1)])
    ascending = F.aggregate(steps, start, halve, lambda acc: acc["lo"])
    return F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(len(bounds) - ascending)


def with_edits(docs: DataFrame, bins: int = BINS, kept: int = KEPT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next.

    The texts are shuffled once, into ranges of doc_id; a range's last document finds its next one in a guest row, a copy
    of the first row of the range after it."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = cut_points(docs, "doc_id", n, max(1e-5, 1 / (8 * n)))
    docs = docs.withColumn("bucket", _bucket(cuts)).withColumn("h", F.xxhash64("text"))
    # the first row of each range; there are at most n of them
    first = docs.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("real"), "doc_id", (-F.col("h").cast("decimal(20,0)")).alias("m"))).alias("f")).select("bucket", "f.doc_id", "f.m").collect()
    first.sort(key=lambda r: r.bucket)
    guests = [(first[i].doc_id, int(-first[i].m), first[i - 1].bucket, i == 0) for i in range(len(first))]
    guests = spark.createDataFrame(guests, f"g_id {kind}, g_h long, g_bucket int, wrap boolean")
    meet = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h"))
    both = docs.join(F.broadcast(guests), meet, "left")
    spread = F.when(F.col("g_bucket").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("g_bucket").alias("bucket"), F.lit(True).alias("guest"))))
    rows = both.select("doc_id", "text", "h", F.explode(spread).alias("s")).select("doc_id", "text", "h", "s.*")
    rows = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "h", "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _stream(rows, bins, kept, schema)


def _stream(rows: DataFrame, bins: int, kept: int, schema: str) -> DataFrame:
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = rows.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def close(waiting, following):
        """Rows of documents (doc_id, text, bits, some, fingerprint, rows) whose next ones are known, as result columns."""
        texts = [edited(d[1], f[1]) for d, f in zip(waiting, following, strict=True)]
        low, some = low_bits(texts, bins, kept)
        own, after = (tuple(np.stack([d[k] for d in docs]) for k in (2, 3)) for docs in (waiting, following))
        near_edited, near_next = likenesses(*own, low, some, kept), likenesses(*own, *after, kept)
        shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        out = [[d[0] for d in waiting], [len(d[1]) for d in waiting], shas, [d[4] for d in waiting], [p.hex() for p in packed(low, some, kept)], near_edited, near_next]
        again = np.repeat(np.arange(len(waiting)), [d[5] for d in waiting])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type).take(pa.array(again)) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    def run(batches):
        last = None  # a document whose next one has not come yet: bucket, guest, [doc_id, text, bits, some, fingerprint, rows]
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest")]
            low, some = low_bits(cols[1], bins, kept)
            prints = [p.hex() for p in packed(low, some, kept)]
            waiting, following = [], []
            for i, (doc_id, text, bucket, guest) in enumerate(zip(*cols, strict=True)):
                if last and last[0] == bucket and last[1] == guest and last[2][0] == doc_id and last[2][1] == text:
                    last[2][5] += 1
                    continue
                now = (bucket, guest, [doc_id, text, low[i], some[i], prints[i], 1])
                if last and not last[1] and last[0] == bucket:
                    waiting.append(last[2])
                    following.append(now[2])
                last = now
            if waiting:
                yield close(waiting, following)

    return rows.mapInArrow(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
