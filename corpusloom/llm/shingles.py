"""Word shingles as 64-bit hashes, in numpy, for many texts at once.

A word is a run of bytes other than blank and 9 to 13, with A-Z in lower case. Its hash is a polynomial of table values of
its bytes modulo 2^64, taken from running sums over the whole buffer, so no word is ever a Python object."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers of a word by its place in a shingle.
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Bytes of texts that are hashed together; a longer text is hashed alone.
BUFFER = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 and to their negatives, modulo 2^64; kept for the usual length."""
    if n <= BUFFER and _powers:
        return _powers["up"][:n], _powers["down"][:n]
    size = max(n, BUFFER)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    if size == BUFFER:
        _powers.update(up=up, down=down)
    return up[:n], down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's begin (one more entry than texts)."""
    raw = b" ".join(texts).translate(_LOWER) + b" "
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up, out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return h, np.searchsorted(starts, begin)


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    h, at = word_hashes(texts)
    total = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _PLACES[i % 64]
    total = mixed(total)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = z - a
        if n >= k:
            out.append(total[a : z - k + 1])
        else:
            out.append(mixed((h[a:z] * _PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else np.empty(0, np.uint64))
    return out


def shingle_hashes(texts: list[str | None], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Of each text a hash for each run of k words, in order, repeats included; fewer words make one shingle, no word none."""
    out, part, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) + 1 > BUFFER - 1:
            out += _shingles(part, k)
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    return out + (_shingles(part, k) if part else [])


def shingle_sets(texts: list[str | None], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The same as sorted arrays without repeats."""
    out = []
    for h in shingle_hashes(texts, k):
        h = np.sort(h)
        out.append(h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h)
    return out
