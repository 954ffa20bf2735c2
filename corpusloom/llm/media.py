"""Media columns: texts stored as lossless WebP images and read back as pixel arrays.

A payload fills an image 144 pixels wide (576 bytes a row: red, green, blue and alpha); payloads of more than 16,384 rows
take several images, one after the other. ``store`` writes all images of a batch at once: runs of pixels that came before are
back-references, pixels that the colour cache holds are places in it, all others literals, under prefix codes that follow
from a fixed ranking. Images of few colours (short or repetitive texts) are written with the palette transform and, where there are 16
colours at most, several pixels in one. So equal payloads have equal files. Predictor and cross-colour transforms lengthen
texts, whose neighbouring bytes don't resemble each other; ``store`` uses neither. ``media_column`` makes a column of files,
``pixel_column`` reads any column of lossless WebP files with the decoder of corpusloom.llm.webp.

Edge cases: a null or empty text is a payload of one row of padding; texts of any length are stored as wholes; repeated rows
give repeated results; bytes that are no lossless WebP raise ValueError, a null file gives null pixels; an empty table gives an
empty table; further columns of docs are not taken over.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import webp
from corpusloom.llm.store import in_batches, read

ROW = 576
WIDTH = ROW // 4
#: Bytes in the order of how common they are taken to be; all others follow as equals.
COMMON = b" e\xfftanioshrdl\xc3ucmfgp\xa9y\nw.,b\xb3vkz\xa8\xb1!\xaa\xa7\xbc\xa4TEAIOSR"
_ORDER = (1, 0, 2, 3)  # the bytes of a pixel (red, green, blue, alpha) as their codes come: green, red, blue, alpha


def padded(raw: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of ROW."""
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


CACHE_BITS = 9
#: A back-reference repeats at least so many pixels, at most as many as the format allows.
LEAST_RUN, MOST_RUN = 4, 4096
#: The palette is used from this many pixels a colour on.
PER_COLOUR = 4


@lru_cache
def _static():
    """Lengths and codes of green symbols, of other bytes and of distances, and the bits that begin every image before its pixels."""
    rank = np.full(256, 1000)
    rank[list(COMMON)] = np.arange(len(COMMON))
    weights = (200_000 / (rank + 4) ** 1.5).astype(np.int64) + 1
    total = int(weights.sum())
    green = webp.code_lengths(np.r_[weights, np.full(24, total // 2000), np.full(1 << CACHE_BITS, total // (3 << CACHE_BITS))])
    other, far = webp.code_lengths(weights), webp.code_lengths(np.ones(40, np.int64))
    head = webp.Writer()
    head.put(0, 1)  # no transform
    head.put(1, 1)
    head.put(CACHE_BITS, 4)
    head.put(0, 1)  # one group of codes
    for lengths in (green, other, other, other, far):
        webp.write_prefix(head, lengths)
    return tuple((x, webp.canonical(x).astype(np.uint64)) for x in (green, other, far)), head


def _references(argb: np.ndarray, image: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of pixels that began earlier in their image, from left to right: place, length and distance."""
    n = len(argb) - LEAST_RUN + 1
    if n < 2:
        return []
    key = image[:n].astype(np.uint64)
    for k in range(LEAST_RUN):
        key = (key ^ argb[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    found, free = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        j = int(before[i])
        if i < free or image[i] != image[j]:
            continue
        most = min(MOST_RUN, int(start[image[i] + 1]) - i)
        differs = np.flatnonzero(argb[i : i + 16] != argb[j : j + 16]) if most > 16 else np.flatnonzero(argb[i : i + most] != argb[j : j + most])
        if not len(differs) and most > 16:
            differs = np.flatnonzero(argb[i : i + most] != argb[j : j + most])
        run = int(differs[0]) if len(differs) else most
        if run >= LEAST_RUN:
            found.append((i, run, i - j))
            free = i + run
    return found


def _distance_codes(distance: np.ndarray) -> np.ndarray:
    """Distances as the format numbers them: the short ones first."""
    short = np.zeros(8 * WIDTH + 1, np.int64)
    for k, (x, y) in reversed(list(enumerate(webp.near_distances()))):
        if 0 < x + y * WIDTH < len(short):
            short[x + y * WIDTH] = k + 1
    code = short[np.minimum(distance, len(short) - 1)] * (distance < len(short))
    return np.where(code > 0, code, distance + 120)


def _extended(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes of lengths or distances, the bits after them and how many they are."""
    less = value - 1
    more = np.maximum(np.frexp(less.astype(float))[1] - 2, 0)
    return np.where(less < 4, less, 2 * more + (less >> more)), less & ((1 << more) - 1), more


def _bodies(images: list[bytes]) -> list[bytes]:
    """Images as what follows their sizes in a file, all written together under the fixed codes."""
    ((green_n, green), (other_n, other), (far_n, far)), head = _static()
    argb = np.frombuffer(b"".join(images), np.uint8).reshape(-1, 4)[:, [3, 0, 1, 2]].copy().view(">u4").ravel().astype(np.int64)
    size = np.array([len(i) // 4 for i in images])
    start, image = np.r_[0, np.cumsum(size)], np.repeat(np.arange(len(images)), size)
    # what the cache holds before each pixel: the last one with its key
    key = (webp.CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    by = image << CACHE_BITS | key
    order = np.argsort(by.astype(np.uint16) if len(images) << CACHE_BITS <= 1 << 16 else by, kind="stable")  # numbers of 16 bits are sorted by radix
    own, last = order[1:], order[:-1]
    held = np.zeros(len(argb), bool)
    held[own] = (image[own] == image[last]) & (argb[own] == argb[last])
    token = np.ones(len(argb), bool)
    copies = np.array(_references(argb, image, start), np.int64).reshape(-1, 3)
    for i, run, _ in copies.tolist():
        token[i + 1 : i + run] = False
    is_copy = np.zeros(len(argb), bool)
    is_copy[copies[:, 0]] = True
    at = np.flatnonzero(token)
    parts, bits = np.zeros((len(at), 4), np.uint64), np.zeros((len(at), 4), np.int64)
    cached = held[at] & ~is_copy[at]
    plain = ~held[at] & ~is_copy[at]
    symbol = 280 + key[at[cached]]
    parts[cached, 0], bits[cached, 0] = green[symbol], green_n[symbol]
    for k, shift, codes, lengths in ((0, 8, green, green_n), (1, 16, other, other_n), (2, 0, other, other_n), (3, 24, other, other_n)):
        symbol = argb[at[plain]] >> shift & 255
        parts[plain, k], bits[plain, k] = codes[symbol], lengths[symbol]
    if len(copies):
        here = is_copy[at]
        code, extra, n = _extended(copies[:, 1])
        parts[here, 0], bits[here, 0], parts[here, 1], bits[here, 1] = green[256 + code], green_n[256 + code], extra.astype(np.uint64), n
        code, extra, n = _extended(_distance_codes(copies[:, 2]))
        parts[here, 2], bits[here, 2], parts[here, 3], bits[here, 3] = far[code], far_n[code], extra.astype(np.uint64), n
    # the parts of an image lie one after the other behind its head, which begins a word of 32 bits
    first = np.r_[np.searchsorted(at, start)] * 4
    bits, parts = bits.ravel(), parts.ravel()
    ends = np.r_[0, np.cumsum(bits)]
    before = ends[first[:-1]]
    n_bits = head.n + ends[first[1:]] - before
    words = -(-n_bits // 32)
    base = np.r_[0, np.cumsum(words)[:-1]]
    place = ends[:-1] + np.repeat(base * 32 + head.n - before, np.diff(first))
    word, value = place >> 5, parts << (place & 31).astype(np.uint64)
    # parts that begin in the same word have no bit in common, so their sum is their union
    edge = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, edge)
    out = np.zeros(int(words.sum()) + 2, np.uint64)
    out[word[edge]] = sums & np.uint64(0xFFFFFFFF)
    out[word[edge] + 1] |= sums >> np.uint64(32)
    lead = np.array([head.value >> s & 0xFFFFFFFF for s in range(0, head.n, 32)], np.uint64)
    for b in base.tolist():
        out[b : b + len(lead)] |= lead
    raw = out.astype("<u4").tobytes()
    return [raw[4 * b : 4 * b + ((n + 7) >> 3)] for b, n in zip(base.tolist(), n_bits.tolist(), strict=True)]


def _file(body: bytes, rows: int) -> bytes:
    body = b"\x2f" + ((WIDTH - 1) | (rows - 1) << 14 | 1 << 28).to_bytes(4, "little") + body
    return b"RIFF" + struct.pack("<I", 12 + len(body) + (len(body) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def store(payloads: list[bytes]) -> list[bytes]:
    """Payloads (multiples of ROW bytes) as files."""
    files: list[list[bytes]] = [[] for _ in payloads]
    images, waiting = [], []
    for k, p in enumerate(payloads):
        for s in range(0, len(p), ROW * webp.LARGEST):
            image = np.frombuffer(p[s : s + ROW * webp.LARGEST], np.uint8).reshape(-1, WIDTH, 4)
            colours = len(np.unique(image.view(np.uint32)))
            if colours <= 256 and PER_COLOUR * colours <= image.size // 4:
                files[k].append(webp.encode(image, (webp.PALETTE,), references=True))
            else:
                waiting.append((k, len(files[k])))
                files[k].append(b"")
                images.append(image.tobytes())
    if images:
        for (k, s), image, body in zip(waiting, images, _bodies(images), strict=True):
            files[k][s] = _file(body, len(image) // ROW)
    return [b"".join(f) for f in files]


def pixels(data: bytes) -> np.ndarray:
    """The pixels of one or more files laid end to end, of one width: (height, width, 4), red, green, blue, alpha."""
    parts, at = [], 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        parts.append(webp.decode(data[at : at + size]))
        at += size
    return np.concatenate(parts)


def feature(image: np.ndarray) -> str:
    """Height and width, the mean of each channel in hundredths, and the share of samples by their upper two bits in thousandths."""
    flat = image.reshape(-1, 4)
    hist = np.bincount((flat >> 6).ravel(), minlength=4) * 1000 // flat.size
    means = flat.sum(0, dtype=np.int64) * 100 // len(flat)
    return f"{image.shape[0]}x{image.shape[1]};" + ",".join(map(str, means.tolist())) + ";" + ",".join(map(str, hist.tolist()))


def media_column(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media (binary): each text as UTF-8, padded and stored; n_bytes is before padding."""

    def run(batch):
        for s in range(0, batch.num_rows, 100):
            part = batch.slice(s, 100)
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield [part.column("doc_id"), [len(r) for r in raw], store([padded(r) for r in raw])]

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary", 400)


def pixel_column(files: DataFrame) -> DataFrame:
    """files (doc_id, n_bytes, media) -> those columns, height, width, pixels (binary: rows of red, green, blue, alpha) and feature."""

    def run(batch):
        for s in range(0, batch.num_rows, 100):
            part = batch.slice(s, 100)
            images = [None if m is None else pixels(m) for m in part.column("media").to_pylist()]
            yield [
                *(part.column(c) for c in ("doc_id", "n_bytes", "media")),
                *([None if i is None else i.shape[k] for i in images] for k in (0, 1)),
                [None if i is None else i.tobytes() for i in images],
                [None if i is None else feature(i) for i in images],
            ]

    schema = f"doc_id {dict(files.dtypes)['doc_id']}, n_bytes long, media binary, height int, width int, pixels binary, feature string"
    return in_batches(files.select("doc_id", "n_bytes", "media"), run, schema, 400)


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = pixel_column(media_column(read(spark, sf_dir, "documents")))
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
