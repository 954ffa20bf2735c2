"""Suffix-array dedup: passages of 50 bytes that occur in a document with a smaller doc_id, found by a logarithmic index family.

Suffixes. A suffix array of every byte would be many times the text, so the arrays are sparse: of each window of ``length``
bytes, the suffix whose first 12 bytes have the least hash enters it. Equal windows choose the same suffix at the same
offset, so no repeat is missed. An entry is the suffix's first 12 bytes, a hash of the segment that its windows cover, the
document, its place in it, and short hashes of the bytes on either side. Arrays are sorted by these bytes.

Index family. Batches of ascending doc_id arrive in turn. A task's entries are sorted runs; by ranges of suffixes, spread by
hash, the batch's runs and the arrays of all levels are merged, and in the same scan entries whose segment an earlier document
has are found. The batch and the levels of equal size become one array of the next level, as in a binary counter. An array
keeps one document for each segment, the smallest. What is found leaves as packed blocks by bucket of documents.

Partial matches. Suffixes that agree while their segments differ (at the ends of a repeat) are compared window by window on
the texts themselves, after the last batch. A common window reaches half its further bytes at least to one side, so only
suffixes that agree with another document's on one side are compared. Suffixes with very many different segments are found in
a sample first: their entries are spread by segment too, and their windows compared by an aggregate, which sums on the map side.

Repeated entries of a task are folded before they are shuffled, so a text with very many copies costs one entry a task.

Edge cases: null and empty texts have 0 bytes; texts under 50 bytes are kept; texts of any length are read in chunks that
share their edges; rows that repeat a doc_id and text are judged alike, and rows that repeat a doc_id with another text each
against smaller ids only; rows with a null doc_id are kept whole and are no source; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mixed
from corpusloom.llm.store import cut_points, forget, in_batches, range_bits, read, release, shared_dir, trimmed, union_all, written

LENGTH, SUFFIX = 50, 12
BATCHES = 4
FLUSH = 50_000
RANGE_BYTES = 1_000_000
#: Documents of a bucket of marks, and marks that a task holds before they leave it.
BUCKET_DOCS, MARKS = 2000, 100_000
#: A suffix with so many different segments among one in HOT_SHARE documents is hot: it is not brought together in one task, which
#: takes some 600 bytes for a segment, 20 MB for the largest suffix that is not hot.
HOT_SHARE, HOT_SEEN, HOT_MOST = 64, 512, 100_000
#: So many windows of hot suffixes, the most frequent ones, are told to all tasks.
HEAVY_WINDOWS = 20_000
CHUNK = (1 << 18) - 1024
#: Texts up to so many bytes are hashed together.
BUFFER = 1 << 16
_BASE = 0xD1342543DE82EF95
_VALUE = np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = {w: np.uint64(pow(_BASE, w, 1 << 64)) for w in (1, 2, 4)}
_up = np.cumprod(np.r_[np.uint64(1), np.full(1 << 18, _BASE, np.uint64)])
_down = np.cumprod(np.r_[np.uint64(1), np.full(1 << 18, pow(_BASE, -1, 1 << 64), np.uint64)])
#: An entry's bytes: suffix, segment hash, doc_id, tag, place, hashes of the left and of the right side; integers big-endian.
#: A place is the start of the first window, how far on the last one starts, and how far on the suffix does.
SEGMENT, DOC, TAG, PLACE, SIDES, ENTRY = SUFFIX, SUFFIX + 5, SUFFIX + 13, SUFFIX + 15, SUFFIX + 21, SUFFIX + 25
#: A mark is the doc_id, tag and place of an entry. Kinds of rows: array blocks, and marks of covered entries, of entries to compare, and of those of hot suffixes.
MARK = SIDES - DOC
ARRAY, COVERED, ASKED, HOT = range(4)
ROWS = "kind int, p int, block binary"


def suffixes(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each chosen suffix of each text: the text's number, its hash, the hash of its segment (40 bits), the first and last start of
    its windows, its place, and hashes of the bytes on either side (16 bits)."""
    parts, held, size = [], [], 0
    for i, raw in enumerate(texts):
        for c in range(0, max(0, len(raw) - length + 1), CHUNK):
            piece = raw[c : c + CHUNK + length - 1]
            if held and size + len(piece) > BUFFER:
                parts.append(_buffer(held, length))
                held, size = [], 0
            held.append((i, c, piece))
            size += len(piece)
    if held:
        parts.append(_buffer(held, length))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint64))


def _buffer(pieces: list[tuple[int, int, bytes]], length: int):
    """The suffixes of pieces of texts (text, place in it, bytes) that are hashed together; no window crosses pieces."""
    text, offset, size = (np.array(x) for x in zip(*((i, c, len(x)) for i, c, x in pieces), strict=True))
    end = np.cumsum(size)
    begin = end - size
    b = np.frombuffer(b"".join(x for *_, x in pieces), np.uint8)
    value = _VALUE[b]
    h, w = value, 1
    while w * 2 < SUFFIX:
        h, half = h[:-w] * _SCALE[w] + h[w:], h
        w *= 2
    h = mixed(h[: -(SUFFIX - w)] * _SCALE[SUFFIX - w] + half[w : len(half) - (SUFFIX - w - w // 2)])
    n, span = len(h), length - SUFFIX + 1
    low = np.uint64((1 << 20) - 1)
    m, w = (h & ~low) | (low - np.arange(n, dtype=np.uint64)), 1  # of equal hashes, the last in the window
    while w * 2 <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    m = np.minimum(m[: n - span + 1], m[span - w :])
    new = np.r_[True, m[1:] != m[:-1]]
    new[begin[begin < len(m)]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(m)] - 1
    piece = np.searchsorted(end, first, "right")
    last = np.minimum(last, end[piece] - length)
    inside = first <= last
    first, last, piece = first[inside], last[inside], piece[inside]
    at = (low - (m[first] & low)).astype(np.int64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value * _up[: len(b)], out=sums[1:])
    seg = (sums[last + length] - sums[first]) * _down[first]
    seg = mixed(seg + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)
    side = (length - SUFFIX + 1) // 2
    after, until, since = at + SUFFIX, np.minimum(at + SUFFIX + side, end[piece]), np.maximum(at - side, begin[piece])
    left = mixed((sums[at] - sums[since]) * _down[since] + (at - since).astype(np.uint64)) >> np.uint64(48)
    right = mixed((sums[until] - sums[after]) * _down[after] + (until - after).astype(np.uint64)) >> np.uint64(48)
    move = offset[piece] - begin[piece]
    return text[piece], h[at], seg, first + move, last + move, at + move, left, right


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from those before them."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _bytes(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def _planes(rows: np.ndarray) -> bytes:
    """Rows of bytes as all first bytes, all second ones, and so on, which compress better."""
    return rows.T.tobytes()


def _unplanes(blocks: list[bytes], width: int) -> np.ndarray:
    return np.ascontiguousarray(np.concatenate([np.empty((0, width), np.uint8), *(np.frombuffer(b, np.uint8).reshape(width, -1).T for b in blocks)]))


def _merged(rows: np.ndarray, width: int) -> np.ndarray:
    """The order of rows of bytes by their first ``width``; sorted runs are merged."""
    return np.argsort(np.ascontiguousarray(rows[:, :width]).view(f"S{width}").ravel(), kind="stable")


def _starts(rows: np.ndarray, width: int) -> np.ndarray:
    """True where sorted rows differ from those before them in their first bytes."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :width] != rows[:-1, :width]).any(axis=1)
    return new


def _number(rows: np.ndarray, at: int, to: int) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 8 - (to - at) :] = rows[:, at:to]
    return out.view(">u8").ravel().astype(np.uint64)


def _covered(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted entries, those whose segment a smaller document has."""
    new = _starts(rows, DOC)
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def hot_suffixes(docs: DataFrame, length: int) -> np.ndarray:
    """The sorted hashes of hot suffixes, by their different segments in a sample of the documents; HOT_MOST at most."""
    import pyarrow as pa

    def run(batch):
        _, h, seg, *_ = suffixes([(text or "").encode() for text in batch.column("text").to_pylist()], length)
        yield [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64))]

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(64)), F.lit(HOT_SHARE)) == 0)
    seen = in_batches(sample.select("text"), run, "h long, seg long", 500).distinct().groupBy("h").count().where(F.col("count") >= HOT_SEEN)
    return np.sort(seen.orderBy(F.desc("count"), "h").limit(HOT_MOST).toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def _is_in(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def batch_entries(docs: DataFrame, bits: int, length: int, hot) -> DataFrame:
    """Sorted runs of the batch's entries, as blocks by range of suffixes, those of hot suffixes in ranges from 2^bits on; and
    the marks of those that a smaller document of the same task covers, in any range."""
    import pyarrow as pa

    def flush(held):
        h, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        p = (h >> np.uint64(64 - bits)).astype(np.int64)
        apart = np.flatnonzero(_is_in(h, hot.value))
        if len(apart):
            p[apart] = (mixed(h[apart] + _number(rows[apart], SEGMENT, DOC)) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)
        order = _merged(np.concatenate([_bytes(p, 4), rows], axis=1), 4 + TAG)
        p, rows = p[order], rows[order]
        gone = _covered(rows, _number(rows, DOC, TAG))
        any_range = int(p[int(_number(rows[:1], DOC, TAG)[0] % np.uint64(len(p)))])
        marks = [(COVERED, any_range, _planes(rows[gone, DOC:SIDES]))] if gone.any() else []
        p, rows = p[~gone], rows[~gone]
        edge = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)].tolist()
        out = [(ARRAY, int(p[a]), _planes(rows[a:z])) for a, z in zip(edge[:-1], edge[1:], strict=True)] + marks
        return [list(x) for x in zip(*out, strict=True)]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            doc_id, tag = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
            texts = [(text or "").encode() for text in batch.column("text").to_pylist()]
            for part in _parts(texts):
                text, h, seg, first, last, at, left, right = suffixes(texts[part], length)
                if not len(h):
                    continue
                joined = np.frombuffer(b"".join(texts[part]), np.uint8)
                begin = np.cumsum([0, *map(len, texts[part])])[text]
                rows = np.empty((len(h), ENTRY), np.uint8)
                rows[:, :SUFFIX] = joined[(begin + at)[:, None] + np.arange(SUFFIX)]
                rows[:, SEGMENT:DOC] = _bytes(seg, 5)
                rows[:, DOC:TAG] = _bytes(doc_id[part][text].view(np.uint64) ^ np.uint64(1 << 63), 8)
                rows[:, TAG:PLACE] = _bytes(tag[part][text], 2)
                rows[:, PLACE : PLACE + 4], rows[:, PLACE + 4], rows[:, PLACE + 5] = _bytes(first, 4), last - first, at - first
                rows[:, SIDES : SIDES + 2], rows[:, SIDES + 2 :] = _bytes(left, 2), _bytes(right, 2)
                held.append((h, rows))
                size += len(h)
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flush(held), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "p", "block"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(flush(held), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "p", "block"])

    _small_batches(docs.sparkSession)
    return docs.select("doc_id", "tag", "text").mapInArrow(trimmed(run), ROWS)


def _parts(texts: list[bytes], most: int = 1 << 19):
    """Slices of texts of about so many bytes."""
    a, size = 0, 0
    for z, text in enumerate(texts):
        if z > a and size + len(text) > most:
            yield slice(a, z)
            a, size = z, 0
        size += len(text)
    yield slice(a, len(texts))


def _small_batches(spark: SparkSession, rows: int = 200) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _agree(group: np.ndarray, doc: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Entries whose group has another document with the same side."""
    key = (group << 16) | side.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, own = key[order], doc[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start), size)
    return out


def merge_scan(blocks: DataFrame, merge: list[int], last: bool, bits: int) -> DataFrame:
    """blocks (level, kind, p, block), level -1 for the batch. Rows as in ROWS: marks of the batch's entries that an earlier document
    covers; the merged array of the batch and the levels in ``merge``. After the last batch, in place
    of an array, marks of entries that share a side with a different segment, and of all those of hot suffixes."""
    import pyarrow as pa

    def run(table):
        kind, level, p = (table.column(c).to_numpy() for c in ("kind", "level", "p"))
        block = table.column("block").to_pylist()
        out = [(COVERED, 0, b) for k, b in zip(kind.tolist(), block, strict=True) if k == COVERED]
        runs = [i for i in np.argsort(-level, kind="stable").tolist() if kind[i] == ARRAY]
        rows = _unplanes([block[i] for i in runs], ENTRY)
        if len(rows):
            level = np.repeat(level[runs], [len(block[i]) // ENTRY for i in runs])
            order = _merged(rows, TAG)
            rows, level = rows[order], level[order]
            doc = _number(rows, DOC, TAG)
            gone = _covered(rows, doc)
            fresh = gone & (level < 0)
            if fresh.any():
                out.append((COVERED, 0, _planes(rows[fresh, DOC:SIDES])))
            if last:
                rows, doc = rows[~gone], doc[~gone]
                hot = p[0] >= 1 << bits
                if not hot:
                    group = np.cumsum(_starts(rows, SUFFIX))
                    ask = _agree(group, doc, _number(rows, SIDES, SIDES + 2)) | _agree(group, doc, _number(rows, SIDES + 2, ENTRY))
                    rows = rows[ask]
                if len(rows):
                    out.append((HOT if hot else ASKED, 0, _planes(rows[:, DOC:SIDES])))
            else:
                keep = ~gone & np.isin(level, [-1, *merge])
                if keep.any():
                    out.append((ARRAY, int(p[0]), _planes(rows[keep])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["kind", "p", "block"])

    return blocks.groupBy("p").applyInArrow(trimmed(run), ROWS)


def by_bucket(marks: DataFrame, buckets: int) -> DataFrame:
    """The marks of many ranges brought together: rows as in ROWS, p the bucket of documents."""
    import pyarrow as pa

    def packed(held):
        out = []
        for kind, blocks in held.items():
            marks = _unplanes(blocks, MARK)
            bucket = (mixed(_number(marks, 0, 8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, marks = bucket[order], marks[order]
            edge = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)].tolist()
            out += [(kind, int(bucket[a]), _planes(marks[a:z])) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "p", "block"])

    def pack(batches):
        held, size = {}, 0
        for batch in batches:
            for kind, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "block")), strict=True):
                held.setdefault(kind, []).append(block)
                size += len(block) // MARK
                if size >= MARKS:
                    yield packed(held)
                    held, size = {}, 0
        if size:
            yield packed(held)

    return marks.mapInArrow(trimmed(pack), ROWS)


def per_document(marks: DataFrame) -> DataFrame:
    """Packed marks by bucket of documents -> (kind, doc_id, tag, places): one row for each kind and document."""
    import pyarrow as pa

    def run(table):
        kind, blocks = table.column("kind").to_numpy(), table.column("block").to_pylist()
        kinds = np.repeat(kind, [len(b) // MARK for b in blocks]).astype(np.uint8)
        rows = np.concatenate([kinds[:, None], _unplanes(blocks, MARK)], axis=1)
        rows = rows[_merged(rows, 1 + MARK)]
        rows = rows[_starts(rows, 1 + MARK)]
        at = np.flatnonzero(_starts(rows, 11))
        edge = (np.r_[at, len(rows)] * (MARK - 10)).astype(np.int64)
        doc = (_number(rows[at], 1, 9) ^ np.uint64(1 << 63)).view(np.int64)
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(rows[:, 11:].tobytes())]).cast(pa.binary())
        return pa.table([pa.array(rows[at, 0].astype(np.int32)), pa.array(doc), pa.array(_number(rows[at], 9, 11).astype(np.int32)), binary], names=["kind", "doc_id", "tag", "places"])

    return marks.groupBy("p").applyInArrow(trimmed(run), "kind int, doc_id long, tag int, places binary")


class SuffixIndex:
    """The family of arrays: level k holds the entries of 2^k batches, or is empty. ``add`` takes batches of ascending doc_id."""

    def __init__(self, spark: SparkSession, bits: int, length: int, hot, buckets: int):
        self.spark, self.bits, self.length, self.hot, self.buckets = spark, bits, length, hot, buckets
        self.levels: dict[int, str] = {}
        self.marks: list[DataFrame] = []

    def add(self, docs: DataFrame, last: bool = False) -> None:
        spark, merge = self.spark, []
        while len(merge) in self.levels and not last:
            merge.append(len(merge))
        sides = [batch_entries(docs, self.bits, self.length, self.hot).select(F.lit(-1).alias("level"), "kind", "p", "block")]
        for k, at in self.levels.items():
            sides.append(spark.read.schema(ROWS).parquet(at).where(F.col("kind") == ARRAY).select(F.lit(k).alias("level"), "kind", "p", "block"))
        to = shared_dir(spark)
        out = written(merge_scan(union_all(sides), merge, last, self.bits), to)
        self.marks.append(written(by_bucket(out.where(F.col("kind") != ARRAY), self.buckets)))  # apart from the arrays, which go when they are merged
        for used in [self.levels.pop(k) for k in (list(self.levels) if last else merge)]:
            forget(spark, used)
        if last:
            forget(spark, to)
        else:
            self.levels[len(merge)] = to
        release(spark)


def _places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last start of the windows of marked suffixes, and how far on from the first the suffix is."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, MARK - 10)
    first = _number(rows, 0, 4).astype(np.int64)
    return first, first + rows[:, 4], rows[:, 5].astype(np.int64)


def window_matches(docs: DataFrame, asked: DataFrame, bits: int, length: int) -> DataFrame:
    """Of the asked suffixes, compared window by window on the texts: (doc_id, tag, ranges) of bytes that a smaller document covers."""
    import pandas as pd
    import pyarrow as pa

    texts, warm = (docs.join(asked.where(F.col("kind") == kind), ["doc_id", "tag"]) for kind in (ASKED, HOT))

    def cut(batch):
        for doc_id, tag, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "places")), strict=True):
            raw = text.encode()
            first, last, ahead = _places(places)
            n = len(first)
            h = mixed((_VALUE[np.frombuffer(raw, np.uint8)[(first + ahead)[:, None] + np.arange(SUFFIX)]] * _up[:SUFFIX]).sum(axis=1, dtype=np.uint64))
            ranges = (h >> np.uint64(64 - bits)).astype(np.int32)
            yield [pa.array(ranges), pa.array([doc_id] * n, pa.int64()), pa.array([tag] * n, pa.int32()), pa.array(first), pa.array(ahead.astype(np.int32)), [raw[a : z + length] for a, z in zip(first.tolist(), last.tolist(), strict=True)]]

    segments = in_batches(texts.select("doc_id", "tag", "text", "places"), cut, "p int, doc_id long, tag int, first long, ahead int, bytes binary", 200)

    def compare(pdf):
        sizes = pdf["bytes"].str.len().to_numpy()
        doc = pdf["doc_id"].to_numpy()
        count = sizes - length + 1
        rows, window, pieces, at = np.repeat(np.arange(len(pdf)), count), [], [], 0
        while at < len(pdf):  # hashes of the windows, for about a million bytes at a time
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 200_000)))
            b = np.frombuffer(b"".join(pdf["bytes"].iloc[at:to]), np.uint8)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_VALUE[b] * _up[: len(b)], out=sums[1:])
            start = np.r_[0, np.cumsum(sizes[at:to])[:-1]]
            inner = np.arange(int(count[at:to].sum())) - np.repeat(np.r_[0, np.cumsum(count[at:to])[:-1]], count[at:to])
            s = np.repeat(start, count[at:to]) + inner
            window.append((sums[s + length] - sums[s]) * _down[s])
            pieces.append(inner)
            at = to
        inner = np.concatenate(pieces)
        ahead = pdf["ahead"].to_numpy()[rows] - inner
        key = mixed(np.concatenate(window) + ahead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((doc[rows], key))
        new = _runs(key[order])
        least = doc[rows][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.zeros(len(rows), bool)
        hit[order] = doc[rows][order] > least
        at = np.flatnonzero(hit)
        edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]])]) if len(at) else at
        a, z = at[edge], at[np.r_[edge[1:], len(at)] - 1] if len(at) else at
        first = pdf["first"].to_numpy()
        return pd.DataFrame({"doc_id": doc[rows[a]], "tag": pdf["tag"].to_numpy()[rows[a]], "start": first[rows[a]] + inner[a], "stop": first[rows[a]] + inner[z] + length})

    found = segments.groupBy("p").applyInPandas(trimmed(compare), "doc_id long, tag int, start long, stop long")
    if not asked.where(F.col("kind") == HOT).isEmpty():
        found = found.unionByName(written(hot_matches(warm, length)))
    return found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def hot_matches(texts: DataFrame, length: int) -> DataFrame:
    """Windows (doc_id, tag, start, stop) of hot suffixes that a smaller document has. The least document of each window is an
    aggregate; it is joined back to windows that several documents have, those of very many documents as a broadcast."""
    import pyarrow as pa

    def windows(batch):
        for doc_id, tag, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "places")), strict=True):
            raw = text.encode()
            first, last, aheads = _places(places)
            keys, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, z, far in zip(first.tolist(), last.tolist(), aheads.tolist(), strict=True):
                b = np.frombuffer(raw, np.uint8, z - a + length, a)
                sums = np.r_[np.uint64(0), np.cumsum(_VALUE[b] * _up[: len(b)], dtype=np.uint64)]
                s = np.arange(z - a + 1)
                value = (sums[s + length] - sums[s]) * _down[s]
                keys.append(mixed(value + (far - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                starts.append(s + a)
            keys, starts = np.concatenate(keys), np.concatenate(starts)
            yield [pa.array(keys), pa.array([doc_id] * len(keys), pa.int64()), pa.array([tag] * len(keys), pa.int32()), pa.array(starts)]

    seen = written(in_batches(texts.select("doc_id", "tag", "text", "places"), windows, "key long, doc_id long, tag int, start long", 500))
    shared = seen.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = written(shared.select("key", "least", "n"))
    heavy = written(shared.orderBy(F.desc("n"), "key").limit(HEAVY_WINDOWS).select("key", "least"))
    light = shared.select("key", "least").join(F.broadcast(heavy), "key", "left_anti")
    rest = seen.join(F.broadcast(heavy), "key", "left_anti").join(light, "key")
    found = seen.join(F.broadcast(heavy), "key").unionByName(rest).where("doc_id > least")
    return found.select("doc_id", "tag", "start", (F.col("start") + length).alias("stop"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (binary)."""
    if not SUFFIX < length <= 255 + SUFFIX:
        raise ValueError(f"length must be from {SUFFIX + 1} to {255 + SUFFIX}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    tag = F.pmod(F.xxhash64("text"), F.lit(65_536)).cast("int") if again else F.lit(0)
    docs = docs.withColumn("tag", tag)
    known = docs.where("doc_id is not null")
    bits = range_bits(docs, 1000, RANGE_BYTES)
    cuts = cut_points(known, "doc_id", batches, 0.001)
    hot = spark.sparkContext.broadcast(hot_suffixes(known, length))
    index = SuffixIndex(spark, bits, length, hot, max(1, known.count() // BUCKET_DOCS))
    for i in range(len(cuts) + 1):
        batch = known if not cuts else known.where((F.col("doc_id") > cuts[i - 1] if i else F.lit(True)) & (F.col("doc_id") <= cuts[i] if i < len(cuts) else F.lit(True)))
        index.add(batch, last=i == len(cuts))
    found = written(per_document(union_all(index.marks)))
    ranges = written(window_matches(known, found, bits, length))
    release(spark)
    covered = found.where(F.col("kind") == COVERED).select("doc_id", "tag", "places")
    marks = written(covered.join(ranges, ["doc_id", "tag"], "full"))
    release(spark)
    rows = docs.join(marks, ["doc_id", "tag"], "left")

    def cut(batch):
        out = []
        for text, places, found in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "ranges")), strict=True):
            raw = (text or "").encode()
            turn = np.zeros(len(raw) + 1, np.int64)
            if places:
                first, last, _ = _places(places)
                np.add.at(turn, first, 1)
                np.add.at(turn, last + length, -1)
            for r in found or []:
                turn[r["start"]] += 1
                turn[r["stop"]] -= 1
            gone = np.cumsum(turn[:-1]) > 0
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(edge) else raw
            out.append((len(raw), [{"start": a, "stop": z} for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)], kept))
        yield [batch.column("doc_id"), *map(list, zip(*out, strict=True))]

    return in_batches(rows.select("doc_id", "text", "places", "ranges"), cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary", 200)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rn, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT d.doc_id, d.rn, b.b, substr(d.h, 2000 * b.b + 1, 2098) AS part
  FROM docs d, LATERAL (SELECT unnest(range(0, (length(d.h) // 2 - 50) // 1000 + 1)) AS b) b
  WHERE length(d.h) >= 100
), windows AS (
  SELECT k.doc_id, k.rn, 1000 * k.b + j.j AS s, substr(k.part, 2 * j.j + 1, 100) AS w
  FROM blocks k, LATERAL (SELECT unnest(range(0, length(k.part) // 2 - 49)) AS j) j
), firsts AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
  SELECT v.rn, v.s, CASE WHEN v.s > lag(v.s) OVER (PARTITION BY v.rn ORDER BY v.s) + 50 THEN 1 ELSE 0 END AS opens
  FROM windows v JOIN firsts f ON v.w = f.w AND f.first_id < v.doc_id
), spans AS (
  SELECT rn, min(s) AS a, max(s) + 50 AS z
  FROM (SELECT rn, s, sum(opens) OVER (PARTITION BY rn ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM hits)
  GROUP BY rn, span
), gaps AS (
  SELECT rn, a, z, lag(z, 1, 0) OVER (PARTITION BY rn ORDER BY a) AS after FROM spans
), kept AS (
  SELECT d.rn, sum(g.z - g.a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(d.h, (2 * g.after + 1)::BIGINT, (2 * (g.a - g.after))::BIGINT), '' ORDER BY g.a)
           || substr(any_value(d.h), (2 * max(g.z) + 1)::BIGINT) AS h
  FROM gaps g JOIN docs d ON d.rn = g.rn GROUP BY d.rn
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       coalesce(k.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.rn = d.rn
"""
