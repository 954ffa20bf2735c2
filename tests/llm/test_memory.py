"""What a Python worker holds between tasks is bounded."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import byte_bpe, substring_dedup, webp
from corpusloom.llm.store import trimmed


def anonymous_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_long_pre_tokens_are_not_kept():
    bpe = byte_bpe.tokenizer()
    text = " ".join(chr(97 + i % 26) * 5000 + chr(97 + i // 26) for i in range(100))
    assert bpe.decode(bpe.encode(text)).decode() == text
    assert max(map(len, [*bpe.memo, *bpe.memo.old]), default=0) <= bpe.memo.LONGEST


@pytest.mark.parametrize("grouped", [False, True])
def test_memory_goes_back_after_a_task(grouped):
    kept = []

    def work(table):
        parts = [bytes(100_000) for _ in range(2000)]  # below what the C library maps by itself
        kept.append(parts[-1])  # holds the end of its heap
        return table

    def batches(tables):
        for t in tables:
            yield work(t)

    table = pa.table({"a": [1]})
    before = anonymous_mb()
    out = trimmed(work)(table) if grouped else list(trimmed(batches)([table]))[0]
    assert out.equals(table) and anonymous_mb() < before + 50


def test_code_lengths_of_many_symbols_take_no_copies(monkeypatch):
    """The nodes that are merged are numbers: lists of all symbols below them would grow with each merge."""
    pushed = []
    for name in ("heappush", "heapreplace"):
        monkeypatch.setattr(webp.heapq, name, lambda heap, x, f=getattr(webp.heapq, name): (pushed.append(x), f(heap, x))[1])
    lengths = webp.code_lengths(np.arange(1, 257))
    assert (2.0 ** -lengths).sum() == 1 and (np.diff(lengths) <= 0).all()
    assert len(pushed) == 255 and all(isinstance(n, int) for x in pushed for n in x)


def test_suffix_dedup_tasks_give_memory_back():
    given = []

    class Frame:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, function, schema):
            given.append(function)

        mapInArrow = applyInArrow

    substring_dedup.merge_scan(Frame(), [], True, 4)
    substring_dedup.by_bucket(Frame(), 4)
    substring_dedup.per_document(Frame())
    assert len(given) == 3 and all(f.__name__ == "run" or f.__name__ == "pack" for f in given) and all(hasattr(f, "__wrapped__") for f in given)
