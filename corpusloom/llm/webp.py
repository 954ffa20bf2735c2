"""Lossless WebP in numpy: decoding of every part of the format, and an encoder that can write all of them.

Decoding follows the public bitstream specification: prefix codes (simple and normal), groups of codes chosen by an
entropy image, back-references with the short-distance map, colour cache, and the inverse predictor, cross-colour,
subtract-green and palette transforms with pixel bundling. Images under one group of codes, the common case here, take a
path in which code lengths are looked up at every bit position of a window at once; their back-references and places in the
colour cache are then followed for all pixels together."""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LARGEST = 1 << 14


@lru_cache
def near_distances() -> list[tuple[int, int]]:
    """The offsets (x, y) of the 120 short distances: nearest first, then smaller |x|, then the positive x."""
    found = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


@lru_cache(maxsize=64)
def _near(width: int) -> np.ndarray:
    """The distances in pixels of the short ones, in images of this width."""
    return np.array([max(1, x + y * width) for x, y in near_distances()])


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > len(self.data) * 8 + 64:
            raise ValueError("the image ends early")
        return word & ((1 << n) - 1)


# prefix codes


@lru_cache
def _reversed() -> np.ndarray:
    """Numbers of 15 bits with their bits in reverse order."""
    numbers, out = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for b in range(15):
        out |= (numbers >> b & 1) << (14 - b)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that belong to code lengths, with their first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used])  # codes in order, as fractions of all 15-bit numbers
    codes[used] = _reversed()[(np.cumsum(room) - room) & 32767]
    return codes


class Prefix:
    """A table over the next ``width`` bits: symbol and code length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        if len(used) <= 1:  # the only symbol takes no bits
            self.width, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0], np.int16), np.zeros(1, np.uint8)
        else:
            self.width = int(lengths.max())
            self.symbol, self.length = np.zeros(1 << self.width, np.int16), np.zeros(1 << self.width, np.uint8)
            for s, c in zip(used.tolist(), canonical(lengths)[used].tolist(), strict=True):
                self.symbol[c :: 1 << int(lengths[s])] = s
                self.length[c :: 1 << int(lengths[s])] = lengths[s]
            if (self.length == 0).any():
                raise ValueError("a prefix code is not complete")
        self.symbols, self.sizes, self.mask = self.symbol.tolist(), self.length.tolist(), (1 << self.width) - 1

    def read(self, bits: Bits) -> int:
        first = bits.at >> 3
        w = (int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7)) & self.mask
        bits.at += self.sizes[w]
        return self.symbols[w]


@lru_cache(maxsize=64)
def _prefix(lengths: bytes) -> Prefix:
    return Prefix(np.frombuffer(lengths, np.int64))


def prefix_of(lengths: np.ndarray) -> Prefix:
    """Alphabets that differ in unused symbols at their end share a table."""
    return _prefix(lengths[: int(np.flatnonzero(lengths)[-1]) + 1].tobytes() if lengths.any() else b"")


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        lengths[symbols] = 1
        return prefix_of(lengths)
    of = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of[LENGTH_ORDER[i]] = bits.read(3)
    code = prefix_of(of)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            lengths[at : at + n] = before if s == 16 else 0
            at += n
    return prefix_of(lengths)


def _extended(bits: Bits, code: int) -> int:
    """A length or distance: its prefix code and the bits after it."""
    if code < 4:
        return code + 1
    more = (code - 2) >> 1
    return ((2 + (code & 1)) << more) + bits.read(more) + 1


# pixels


#: Code descriptions met last: colour cache bits, the description's bits and their number, the codes. A description ends
#: where its own bits say, so equal bits are equal codes.
_met: list[tuple[int, int, int, list[Prefix]]] = []


def _read_codes(bits: Bits, cache_bits: int) -> list[Prefix]:
    start, first = bits.at, bits.at >> 3
    for known in _met:
        if known[0] == cache_bits and (int.from_bytes(bits.data[first : first + (known[2] >> 3) + 2], "little") >> (start & 7)) & ((1 << known[2]) - 1) == known[1]:
            bits.at += known[2]
            return known[3]
    codes = [read_prefix(bits, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    n = bits.at - start
    _met.insert(0, (cache_bits, (int.from_bytes(bits.data[first : first + (n >> 3) + 2], "little") >> (start & 7)) & ((1 << n) - 1), n, codes))
    del _met[8:]
    return codes


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values (height * width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, per_row, block = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        per_row = (width + (1 << block) - 1) >> block
        groups_at = ((read_pixels(bits, per_row, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF).tolist()
    groups = [_read_codes(bits, cache_bits) for _ in range(max(groups_at) + 1 if groups_at else 1)]
    total = width * height
    if not groups_at and not cache_bits and not groups[0][0].lengths[256:].any():
        out, bits.at = read_literals(bits.data, bits.at, total, groups[0][:4])
        return out
    if not groups_at and total > SMALL and groups[0][0].width:
        tokens, bits.at = read_tokens(bits.data, bits.at, total, groups[0])
        return resolved(tokens, total, width, cache_bits)
    out, cache, near = [0] * total, [0] * (1 << cache_bits), near_distances()
    i = cached = 0
    while i < total:
        if groups_at:
            green, red, blue, alpha, far = groups[groups_at[(i // width >> block) * per_row + (i % width >> block)]]
        else:
            green, red, blue, alpha, far = groups[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            n = _extended(bits, s - 256)
            d = _extended(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = near[d - 1]
                d = max(1, x + y * width)
            if d > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + n):
                out[j] = out[j - d]
            i += n
        else:
            while cached < i:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.int64)


WINDOW = 1 << 15
#: Images of fewer pixels are read pixel by pixel.
SMALL = 32


def read_literals(data: bytes, at: int, n: int, codes: list[Prefix]) -> tuple[np.ndarray, int]:
    """n pixels of four literals each, from bit at on: ARGB values and the bit after them.

    In a window of the data, tables give the length of the code that would start at each bit; from these follow, for every
    bit, where the next pixel and the eighth pixel after it would start. Only every eighth start is then followed in turn."""
    if not sum(c.width for c in codes):
        return np.full(n, int(codes[3].symbol[0]) << 24 | int(codes[1].symbol[0]) << 16 | int(codes[0].symbol[0]) << 8 | int(codes[2].symbol[0]), np.int64), at
    parts = []
    while n:
        first = at >> 3
        size = min(WINDOW, len(data) - first)
        raw = np.frombuffer(data[first : first + size + 16] + bytes(12), np.uint8).astype(np.uint32)
        v = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        w = (v[: size + 8, None] >> np.arange(8, dtype=np.uint32)).ravel()
        limit, end = size * 8, len(w) - 1
        place = np.arange(end + 1, dtype=np.int32)
        same = all(c is codes[0] for c in codes)
        steps = []
        for c in codes[:1] if same else codes:  # green, red, blue, alpha
            step = place + c.length[w & c.mask]
            step[-16:] = np.minimum(step[-16:], end)
            steps.append(step)
        if same:
            steps *= 4
            pair = step[step]
            ahead = pair[pair]
        else:
            ahead = steps[3][steps[2][steps[1][steps[0]]]]
        two = ahead[ahead]
        four = two[two]
        eight = memoryview(four[four])
        p, starts, most = at & 7, [], -(-n // 8)
        while p < limit and len(starts) < most:
            starts.append(p)
            p = eight[p]
        grid = np.empty((len(starts), 8), np.int32)
        grid[:, 0] = starts
        for k in range(1, 8):
            grid[:, k] = ahead[grid[:, k - 1]]
        here = grid.ravel()[:n]
        here = here[: np.searchsorted(here, limit)]
        if not len(here):
            raise ValueError("the image ends early")
        at = first * 8 + int(ahead[here[-1]])
        n -= len(here)
        value = np.zeros(len(here), np.int64)
        for c, shift, step in zip(codes, (8, 16, 0, 24), steps, strict=True):
            value |= c.symbol[w[here] & c.mask].astype(np.int64) << shift
            here = step[here]
        parts.append(value)
    return np.concatenate(parts), at


#: The first value (less one) and the number of further bits of each prefix code of a length or distance.
_MORE = np.array([0 if c < 4 else (c - 2) >> 1 for c in range(40)])
_EIGHT = np.arange(8)
_BASE = np.array([c if c < 4 else (2 + (c & 1)) << ((c - 2) >> 1) for c in range(40)])


def read_tokens(data: bytes, at: int, n: int, codes: list[Prefix]) -> tuple[np.ndarray, int]:
    """The tokens of n pixels from bit at on, and the bit after them: rows of green symbol, ARGB value or length, distance code.

    As in read_literals, but a token may be a literal, a back-reference or a place in the cache."""
    green, red, blue, alpha, far = codes
    parts = []
    while n > 0:
        first = at >> 3
        size = min(WINDOW, len(data) - first)
        if size <= 0:
            raise ValueError("the image ends early")
        raw = np.frombuffer(data[first : first + size + 16] + bytes(12), np.uint8).astype(np.int64)  # places are taken as they are, not cast for each table
        v = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        w = (v[: size + 8, None] >> _EIGHT).ravel()
        limit, end = size * 8, len(w) - 1
        place = np.arange(end + 1)
        slot = w & green.mask
        symbol = green.symbol.take(slot)
        after = place + green.length.take(slot)
        after[-16:] = np.minimum(after[-16:], end)
        lit = symbol < 256
        if red is blue is alpha:
            step = place + red.length.take(w & red.mask)
            step[-16:] = np.minimum(step[-16:], end)
            to = step.take(step.take(step.take(after)))
        else:
            to = after
            for c in (red, blue, alpha):
                to = np.minimum(to + c.length.take(w.take(to) & c.mask), end) if c.width else to
        ahead = np.where(lit, to, after)  # a place in the cache is its green symbol alone
        copy = np.flatnonzero((symbol >= 256) & (symbol < 280))
        to = np.minimum(after[copy] + _MORE[symbol[copy] - 256], end)
        code = far.symbol[w[to] & far.mask]
        ahead[copy] = np.minimum(to + far.length[w[to] & far.mask] + _MORE[code], end)
        two = ahead.take(ahead)
        four = two.take(two)
        eight = memoryview(four.take(four))
        p, starts, most = at & 7, [], -(-n // 8)
        while p < limit and len(starts) < most:
            starts.append(p)
            p = eight[p]
        grid = np.empty((len(starts), 8), np.int64)
        grid[:, 0] = starts
        for k in range(1, 8):
            grid[:, k] = ahead.take(grid[:, k - 1])
        here = grid.ravel()
        here = here[: np.searchsorted(here, limit)]
        token = np.zeros((len(here), 3), np.int64)
        token[:, 0] = symbol[here]
        s = token[:, 0]
        run = np.ones(len(here), np.int64)
        lit = np.flatnonzero(s < 256)
        to, value = after[here[lit]], s[lit] << 8
        for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
            value |= c.symbol[w[to] & c.mask].astype(np.int64) << shift
            to = to + c.length[w[to] & c.mask]
        token[lit, 1] = value
        copy = np.flatnonzero((s >= 256) & (s < 280))
        to, length = after[here[copy]], s[copy] - 256
        run[copy] = token[copy, 1] = _BASE[length] + (w[to] & ((1 << _MORE[length]) - 1)) + 1
        to = to + _MORE[length]
        code = far.symbol[w[to] & far.mask]
        to = to + far.length[w[to] & far.mask]
        token[copy, 2] = _BASE[code] + (w[to] & ((1 << _MORE[code]) - 1)) + 1
        used = int(np.searchsorted(np.cumsum(run), n)) + 1
        if not len(here):
            raise ValueError("the image ends early")
        used = min(used, len(here))
        at = first * 8 + int(ahead[here[used - 1]])
        n -= int(run[:used].sum())
        parts.append(token[:used])
    if n:
        raise ValueError("a back-reference leaves the image")
    return np.concatenate(parts), at


def _roots(to: np.ndarray) -> np.ndarray:
    """Follows pointers, none of which leads to a later place, until they stay."""
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def resolved(tokens: np.ndarray, total: int, width: int, cache_bits: int) -> np.ndarray:
    """Tokens as ARGB values.

    Every pixel points to the one that it repeats: first those of back-references, along which each pixel learns its key in the
    colour cache, then those of the cache, which repeat the last pixel before with their key (0 where there is none)."""
    s, value = tokens[:, 0], tokens[:, 1]
    is_copy = (s >= 256) & (s < 280)
    run = np.where(is_copy, value, 1)
    start = np.cumsum(run) - run
    to, argb = np.arange(total + 1), np.zeros(total + 1, np.int64)
    lit, cached, copy = np.flatnonzero(s < 256), np.flatnonzero(s >= 280), np.flatnonzero(is_copy)
    argb[start[lit]] = value[lit]
    if len(copy):
        near = _near(width)
        d = tokens[copy, 2]
        d = np.where(d > 120, d - 120, near[np.minimum(d, 120) - 1])
        if (d > start[copy]).any():
            raise ValueError("a back-reference leaves the image")
        own = np.repeat(np.arange(len(copy)), run[copy])
        pixel = start[copy][own] + np.arange(len(own)) - (np.cumsum(run[copy]) - run[copy])[own]
        to[pixel] = pixel - d[own]
    if len(cached):
        root = _roots(to)[:total]
        key = (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - cache_bits)
        key[start[cached]] = s[cached] - 280
        key = key[root].astype(np.uint16)  # numbers of 16 bits are sorted by radix
        order = np.argsort(key, kind="stable")
        before = np.full(total, total)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        to[start[cached]] = before[start[cached]]
    return argb[_roots(to)[:total]]


# transforms: pixels as uint8 arrays (height, width, 4) in the order alpha, red, green, blue


def _channels(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(height, width, 4)


def _predict(mode: int, left, top, right, corner):
    """The prediction of a pixel (lists of four) from those left, above, above right and above left of it."""
    if mode == 0:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 5:
        return avg(avg(left, right), top)
    if mode <= 9:
        return avg(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return avg(avg(left, corner), avg(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = avg(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def _walk_predictor(pixels: np.ndarray, modes: np.ndarray, block: int, sign: int) -> np.ndarray:
    """sign 1 adds predictions to residuals, -1 takes them from pixels."""
    height, width, _ = pixels.shape
    flat = pixels.reshape(-1, 4).tolist()
    out = [None] * len(flat) if sign > 0 else flat
    res = flat if sign > 0 else [None] * len(flat)
    for i in range(height * width):
        y, x = divmod(i, width)
        if not i:
            guess = [255, 0, 0, 0]
        elif not y:
            guess = out[i - 1]
        elif not x:
            guess = out[i - width]
        else:  # above the last pixel of a row, the right neighbour is the first one of the row itself
            guess = _predict(int(modes[y >> block, x >> block]), out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        if sign > 0:
            out[i] = [(r + g) & 255 for r, g in zip(res[i], guess, strict=True)]
        else:
            res[i] = [(o - g) & 255 for o, g in zip(out[i], guess, strict=True)]
    return np.array(out if sign > 0 else res, np.uint8).reshape(height, width, 4)


def _spread(table: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    return table.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]


def _cross_colour(pixels: np.ndarray, table: np.ndarray, block: int, sign: int) -> np.ndarray:
    height, width, _ = pixels.shape
    by = _spread(table.view(np.int8), block, height, width).astype(np.int64)
    delta = lambda t, c: (t * c.astype(np.int8).astype(np.int64)) >> 5
    out = pixels.copy()
    red, green, blue = (pixels[:, :, k].astype(np.int64) for k in (1, 2, 3))
    new_red = (red + sign * delta(by[:, :, 3], pixels[:, :, 2])) & 255
    base = new_red if sign > 0 else red
    out[:, :, 1] = new_red
    out[:, :, 3] = (blue + sign * (delta(by[:, :, 2], pixels[:, :, 2]) + delta(by[:, :, 1], base.astype(np.uint8)))) & 255
    return out


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """A WebP file as pixels (height, width, 4): red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data, 21 * 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            rows, cols = (height + (1 << block) - 1) >> block, (coded + (1 << block) - 1) >> block
            steps.append((kind, block, _channels(read_pixels(bits, cols, rows, False), rows, cols), coded))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, 0, None, coded))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(read_pixels(bits, n, 1, False), 1, n)[0], 0, dtype=np.uint8)
            steps.append((kind, _bundle_bits(n), table, coded))
            coded = (coded + (1 << _bundle_bits(n)) - 1) >> _bundle_bits(n)
    pixels = _channels(read_pixels(bits, coded, height, True), height, coded)
    for kind, block, table, wide in reversed(steps):
        if kind == PREDICTOR:
            pixels = _walk_predictor(pixels, table[:, :, 2] & 15, block, 1)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, table, block, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[:, :, 1] += pixels[:, :, 2]
            pixels[:, :, 3] += pixels[:, :, 2]
        else:
            each = 8 >> block
            index = (pixels[:, :, 2, None] >> (np.arange(1 << block, dtype=np.uint8) * each)) & ((1 << each) - 1)
            full = np.zeros((256, 4), np.uint8)  # an index beyond the palette is transparent black
            full[: len(table)] = table
            pixels = full[index.reshape(height, -1)[:, :wide]]
    return pixels[:, :, [1, 2, 3, 0]]


# encoding


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += int(n)


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths; if one exceeds the limit, counts are flattened and it starts again."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        heap = list(zip(counts[used].tolist(), used.tolist(), range(len(used)), strict=True))  # count, least symbol, node
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        for node in range(len(used), len(above)):
            a = heapq.heappop(heap)
            b = heap[0]
            above[a[2]] = above[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), node))
        depth = [0] * len(above)
        for node in range(len(above) - 2, -1, -1):
            depth[node] = depth[above[node]] + 1
        lengths[used] = depth[: len(used)]
        if lengths.max() <= limit:
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def write_prefix(out: Writer, lengths: np.ndarray) -> None:
    used, lengths = np.flatnonzero(lengths), lengths.tolist()
    if len(used) <= 2 and (not len(used) or used.max() < 256):
        used = used if len(used) else np.array([0])
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    tokens = []
    for length, same in groupby(lengths):
        run = sum(1 for _ in same)
        while run:
            if length == 0 and run >= 3:
                n = min(run, 138)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
                run -= n
            elif run >= 4:
                n = min(run - 1, 6)
                tokens += [(length, 0, 0), (16, n - 3, 2)]
                run -= n + 1
            else:
                tokens.append((length, 0, 0))
                run -= 1
    of = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if np.count_nonzero(of) == 1:  # a lone length still needs a complete code
        of[np.flatnonzero(of == 0)[0]] = 1
    codes = canonical(of)
    out.put(0, 1)
    n = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if of[s]) + 1)
    out.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        out.put(of[s], 3)
    out.put(0, 1)
    for s, more, bits in tokens:
        out.put(codes[s], of[s])
        out.put(more, bits)


def _extend(value: int) -> tuple[int, int, int]:
    """The prefix code of a length or distance, the bits after it, and how many they are."""
    if value <= 4:
        return value - 1, 0, 0
    more = (value - 1).bit_length() - 2
    half = ((value - 1) >> more) & 1
    return 2 * more + 2 + half, (value - 1) & ((1 << more) - 1), more


def _symbols(argb: list[int], width: int, cache_bits: int, references: bool):
    """What an image is written as: literals, back-references (length, distance) and places in the colour cache."""
    short = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(near_distances()))) if x + y * width > 0}
    seen, cache, out, i = {}, {}, [], 0

    def note(j):
        if cache_bits:
            cache[(CACHE_FACTOR * argb[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[j]
        if references and j + 2 < len(argb):
            seen[tuple(argb[j : j + 3])] = j

    while i < len(argb):
        j = seen.get(tuple(argb[i : i + 3])) if references else None
        if j is not None:
            n = 0
            while i + n < len(argb) and n < 4096 and argb[j + n] == argb[i + n]:
                n += 1
            out.append(("copy", n, short.get(i - j, i - j + 120), i))
            for k in range(i, i + n):
                note(k)
            i += n
            continue
        key = (CACHE_FACTOR * argb[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        out.append(("cache", key, 0, i) if cache_bits and cache.get(key) == argb[i] else ("pixel", argb[i], 0, i))
        note(i)
        i += 1
    return out


def write_pixels(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, groups: int = 1, block: int = 2) -> None:
    """An entropy-coded image; with several groups of codes, blocks of the image take them in turn."""
    argb = argb.astype(np.int64).ravel().tolist()
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    per_row = (width + (1 << block) - 1) >> block
    group_of = lambda i: 0
    rows = (len(argb) // width + (1 << block) - 1) >> block
    groups = min(groups, rows * per_row)
    if main:
        out.put(int(groups > 1), 1)
        if groups > 1:
            turn = np.arange(rows * per_row) % groups
            group_of = lambda i: int(turn[(i // width >> block) * per_row + (i % width >> block)])
            out.put(block - 2, 3)
            write_pixels(out, turn << 8, per_row, False)
    todo = []
    for kind, a, d, i in _symbols(argb, width, cache_bits, references):
        g = group_of(i)
        if kind == "pixel":
            todo.append((g, [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]))
        elif kind == "cache":
            todo.append((g, [(0, 280 + a, 0, 0)]))
        else:
            n, far = _extend(a), _extend(d)
            todo.append((g, [(0, 256 + n[0], n[1], n[2]), (4, far[0], far[1], far[2])]))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]
    for g, parts in todo:
        for k, s, _, _ in parts:
            counts[g][k][s] += 1
    lengths = [[code_lengths(np.array(c)) for c in own] for own in counts]
    for own in lengths:
        for x in own:
            write_prefix(out, x)
    codes = [[canonical(x).tolist() for x in own] for own in lengths]
    # the only symbol of a code takes no bits
    spent = [[x.tolist() if np.count_nonzero(x) > 1 else [0] * len(x) for x in own] for own in lengths]
    for g, parts in todo:
        for k, s, more, bits in parts:
            out.put(codes[g][k][s] if spent[g][k][s] else 0, spent[g][k][s])
            out.put(more, bits)


def _file(width: int, height: int, bits: Writer) -> bytes:
    body = b"\x2f" + ((width - 1) | (height - 1) << 14 | 1 << 28).to_bytes(4, "little") + bits.value.to_bytes((bits.n + 7) // 8, "little")
    return b"RIFF" + struct.pack("<I", 12 + len(body) + (len(body) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode(rgba: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, groups: int = 1, block: int = 2, seed: int = 0) -> bytes:
    """Pixels (height, width, 4) as a WebP file. transforms are applied in their order; their parameters by block are drawn
    at random, as any choice can be undone; a palette needs 256 colours at most and comes without other transforms before."""
    rng, out = np.random.default_rng(seed), Writer()
    height, width, _ = rgba.shape
    pixels, coded = np.ascontiguousarray(rgba[:, :, [3, 0, 1, 2]]), width
    value = lambda p: p.reshape(-1, 4).view(">u4").ravel().astype(np.int64)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        rows, cols = (height + (1 << block) - 1) >> block, (coded + (1 << block) - 1) >> block
        if kind in (PREDICTOR, CROSS_COLOUR):
            table = rng.integers(0, 256, (rows, cols, 4)).astype(np.uint8)
            if kind == PREDICTOR:
                table[:, :, 2] %= 14
                pixels = _walk_predictor(pixels, table[:, :, 2], block, -1)
            else:
                pixels = _cross_colour(pixels, table, block, -1)
            out.put(block - 2, 3)
            write_pixels(out, value(table), cols, False)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[:, :, 1] -= pixels[:, :, 2]
            pixels[:, :, 3] -= pixels[:, :, 2]
        else:
            colours, index = np.unique(value(pixels), return_inverse=True)
            table = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
            out.put(len(table) - 1, 8)
            write_pixels(out, value(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
            b = _bundle_bits(len(table))
            coded = (width + (1 << b) - 1) >> b
            wide = np.zeros((height, coded << b), np.int64)
            wide[:, :width] = index.reshape(height, width)
            packed = (wide.reshape(height, coded, 1 << b) << (np.arange(1 << b) * (8 >> b))).sum(2)
            pixels = np.zeros((height, coded, 4), np.uint8)
            pixels[:, :, 0], pixels[:, :, 2] = 255, packed
    out.put(0, 1)
    write_pixels(out, value(pixels), coded, True, cache_bits, references, groups, block)
    return _file(width, height, out)
