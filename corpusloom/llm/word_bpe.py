"""BPE with word ends: encoding by backtracking, decoding by an offset table.

A word is a string of symbols, of which the last bears the word's end. One pass of an Aho-Corasick automaton over a word
finds the longest token that starts at each place. The encoder takes these tokens from left to right. Two neighbours have
to be compatible, which means that merging the letters of both gives just these two; if they are not, a shorter token is
tried, and if there is none, the encoder goes back by a token and marks the place, which is then never tried again. A
prefix has one exact encoding at most, so the first way to the word's end gives the merges' own result, in linear time.
Compatibility is read from a table of pairs, filled by undoing the merges on both sides of the border, latest first.

Edge cases: a null text is the empty text, without ids; texts and words of any length are encoded as wholes; repeated rows
give repeated results and there are no ties; the strings of added tokens are these tokens wherever a text holds them; an
empty table gives an empty table; further columns pass through, except those with names of the operator's own columns.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import Memo, in_batches, read

VOCABULARY = "word_bpe_49k.json"
MEMO_WORDS = 200_000
#: Pairs whose compatibility is remembered.
MEMO_PAIRS = 200_000
#: Longer words are not remembered.
MEMO_LENGTH = 256
#: Tokens that are decoded at once.
DECODE_TOKENS = 500_000
NEVER = 1 << 40

# The tokenizers library splits by Unicode 16 and lowers by Unicode 17, Python's modules by 17 and 15.1.
#: Letters, numbers and white space of the regex module that are none for the library.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals that Python doesn't know: first, last, and the small letter of the first.
NEWER_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
# End of fixed values.
SMALL = {c: small + c - a for a, b, small in NEWER_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}  # letters are lowered one by one, whatever follows
NEWER_CLASS = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"


class WordMemo(Memo):
    """A Memo that leaves out long words, so that its size is bounded in bytes too."""

    def __missing__(self, word):
        return self.function(word) if len(word) > MEMO_LENGTH else super().__missing__(word)


def byte_letters() -> str:
    """The letter of each byte: printing ones are themselves, the others come in order from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class WordBpe:
    """Made from a vocabulary file in which each merge makes a token of its own from earlier ones."""

    def __init__(self, model: dict):
        bpe, steps = model["model"], model["normalizer"]["normalizers"]
        splits = model["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or not splits[0]["invert"] or model.get("decoder"):
            raise ValueError("not a vocabulary of lower-case words")
        self.pattern, self.end = splits[0]["pattern"]["Regex"], bpe["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocabulary: dict[str, int] = bpe["vocab"]
        n = 1 + max([*vocabulary.values(), *self.added.values()])
        self.left, self.right, self.made = [-1] * n, [-1] * n, [-1] * n
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(bpe["merges"]):
            a, b = (vocabulary[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocabulary["".join(pair if not isinstance(pair, str) else pair.split(" "))]
            if self.made[whole] >= 0:
                raise ValueError("two merges make one token")
            self.left[whole], self.right[whole], self.made[whole], self.merge[a, b] = a, b, rank, rank
        if any(max(self.made[a], self.made[b]) >= rank for (a, b), rank in self.merge.items()):
            raise ValueError("a merge joins tokens that only later merges make")
        self.shown = [""] * n
        for t, i in [*vocabulary.items(), *self.added.items()]:
            self.shown[i] = t
        #: One symbol for each letter, and another for it at a word's end.
        letters = byte_letters()
        self.letter = {c: chr(b) for b, c in enumerate(letters)}
        symbols = {i: self._symbols(t) for t, i in vocabulary.items()}
        self._ready_automaton(symbols)

    def _symbols(self, token: str) -> str:
        ends = token.endswith(self.end) and len(token) > len(self.end)
        s = [self.letter[c] for c in (token[: -len(self.end)] if ends else token)]
        return "".join(s[:-1]) + chr(ord(s[-1]) + 256) if ends else "".join(s)

    def _ready_automaton(self, symbols: dict[int, str]) -> None:
        """The automaton holds the tokens that merging their own letters gives, the others can't be in any result."""
        self.compatible_pairs = Memo(self._compatible, MEMO_PAIRS)
        self.size = [0] * len(self.shown)
        for i, s in symbols.items():
            self.size[i] = len(s)
        whole = {s: i for i, s in symbols.items() if self._is_result(i)}
        self.automaton = ahocorasick.Automaton()
        for s, i in whole.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.shown)
        for s, i in whole.items():
            self.shorter[i] = next((whole[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in whole), -1)
        older = self.pattern.replace(r"\p{L}", rf"[\p{{L}}--{NEWER_CLASS}]").replace(r"\p{N}", rf"[\p{{N}}--{NEWER_CLASS}]")
        self.split, self.split_newer, self.newer = regex.compile(self.pattern), regex.compile(older, regex.V1), re.compile(NEWER_CLASS)
        self.rare = frozenset(map(chr, [*SMALL, *(c for a, b in NEWER for c in range(a, b + 1))]))
        self.memo = WordMemo(self._word, MEMO_WORDS)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _is_result(self, i: int) -> bool:
        """Both halves of a token are results of merging, and so is the token if no merge across its border comes before its own."""
        while self.made[i] >= 0:
            if not self._meet(self.left[i], self.right[i], self.made[i]):
                return False
            if not self._is_result(self.left[i]):
                return False
            i = self.right[i]
        return True

    def _meet(self, x: int, y: int, until: int) -> bool:
        """Whether merging the letters of x and y reaches x and y, and joins no parts of theirs before the given rank."""
        merge, made = self.merge, self.made
        used_x = used_y = until
        while True:
            rank = merge.get((x, y), NEVER)
            if rank < used_x and (rank <= used_y and rank < until):
                return False
            if made[x] > made[y]:
                used_x, x = made[x], self.right[x]
            elif made[y] >= 0:
                used_y, y = made[y], self.left[y]
            else:
                return True

    def _compatible(self, pair: int) -> bool:
        return self._meet(pair >> 32, pair & 0xFFFFFFFF, NEVER)

    def merged(self, word: str) -> list[int]:
        """The ids of a word of symbols."""
        size, shorter, fits, n = self.size, self.shorter, self.compatible_pairs, len(word)
        longest = [-1] * n
        for last, i in self.automaton.iter(word):  # the matches from one place come from the shortest to the longest
            longest[last - size[i] + 1] = i
        out: list[int] = []
        closed, at, t = bytearray(n + 1), 0, longest[0]
        while at < n:
            while t >= 0 and (closed[at + size[t]] or (out and not fits[out[-1] << 32 | t])):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += size[t]
                t = longest[at] if at < n else -1
            else:
                closed[at] = 1
                t = out.pop()
                at -= size[t]
                t = shorter[t]
        return out

    def _word(self, word: str) -> bytes:
        s = word.encode().decode("latin-1")
        ids = self.merged(s[:-1] + chr(ord(s[-1]) + 256))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        split = self.split
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if not self.rare.isdisjoint(text):
                text = text.translate(SMALL)
                split = self.split_newer if self.newer.search(text) else split
        return b"".join(map(self.memo.__getitem__, split.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. White space only parts words, so it needn't be squeezed."""
        if self.apart is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.added[x]) if i % 2 else self._plain(x) for i, x in enumerate(self.apart.split(text)))


class OffsetTable:
    """Decoding: the strings of all tokens lie end to end in one array, and each id has its offset and length there."""

    def __init__(self, model: dict):
        ids = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        raw = [f"{ids.get(i, '')} ".encode() for i in range(max(ids) + 1)]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(x) for x in raw])
        self.offset = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings in UTF-8 with a blank between them, gathered from the offset table."""
        out = []
        for k in range(0, len(ids), DECODE_TOKENS):
            part = ids[k : k + DECODE_TOKENS]
            n = self.length[part]
            start = np.cumsum(n) - n
            out.append(self.table[np.repeat(self.offset[part] - start, n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def tokenizer(content: str) -> WordBpe:
    """In each worker once: it is made from the text of the vocabulary file."""
    return WordBpe(json.loads(content))


@lru_cache(maxsize=2)
def offset_table(content: str) -> OffsetTable:
    return OffsetTable(json.loads(content))


def shared_vocabulary(spark: SparkSession, path: str | None):
    """The vocabulary file's text as a broadcast: its size is the file's, whatever the data."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _others(df: DataFrame, *taken: str) -> tuple[list[str], list[str]]:
    own = [f for f in df.schema.fields if f.name.lower() not in taken]
    return [f.name for f in own], [f"`{f.name}` {f.dataType.simpleString()}" for f in own]


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(text, ...) -> docs' other columns, n_tokens long, ids array<int> and, if asked for, decoded: the text of these ids."""
    shared = shared_vocabulary(docs.sparkSession, path)
    names, kinds = _others(docs, "text", "n_tokens", "ids", *["decoded"] * decoded)

    def run(batch):
        t, table = tokenizer(shared.value), offset_table(shared.value) if decoded else None
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            found = [t.encode(x or "") for x in part.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in found], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            back = [pa.array([table.decode(np.frombuffer(x, "<u4")) for x in found], pa.binary()).cast(pa.string())] if decoded else []
            yield [*(part.column(c) for c in names), pa.array(n), ids, *back]

    return in_batches(docs.select(*names, "text"), run, ", ".join([*kinds, "n_tokens long", "ids array<int>", *["decoded string"] * decoded]))


def decode(encoded: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(ids, ...) -> encoded's other columns, with ids if asked for, then text: the decoded ids, empty for null ids."""
    shared = shared_vocabulary(encoded.sparkSession, path)
    names, kinds = _others(encoded, "text", *(() if keep_ids else ("ids",)))

    def run(batch):
        t = offset_table(shared.value)
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            texts = [t.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x) else b"" for x in part.column("ids")]
            yield [*(part.column(c) for c in names), pa.array(texts, pa.binary()).cast(pa.string())]

    return in_batches(encoded.select(*dict.fromkeys([*names, "ids"])), run, ", ".join([*kinds, "text string"]))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
