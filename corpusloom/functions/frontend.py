"""The contract of a text frontend, wrapped once for each Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as D

NEEDED = ("normalize", "phonemize", "symbols", "metadata")


def metadata_hash(frontend) -> str:
    return hashlib.sha256(repr(sorted(frontend.metadata().items())).encode()).hexdigest()


def phonemes(make, expected_hash: str | None = None):
    """A Column function from texts to phoneme strings. make() gives the frontend; it must have normalize, phonemize, symbols and
    metadata, and its metadata must have the expected hash. Symbols outside its set are an error."""

    @F.pandas_udf(D.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frontend = make()
        for name in NEEDED:
            if not callable(getattr(frontend, name, None)):
                raise TypeError(f"the frontend has no {name}()")
        if expected_hash and metadata_hash(frontend) != expected_hash:
            raise ValueError("the frontend's metadata differ from those expected")
        known = set(frontend.symbols())

        def one(text):
            if text is None:
                return None
            out = frontend.phonemize(frontend.normalize(text))
            if odd := set(out) - known:
                raise ValueError(f"unknown symbols: {sorted(odd)}")
            return out

        for s in batches:
            yield s.map(one)

    return run


def measured(rows, key: str, column: str, measure, fields: str):
    """A measure of each row (value -> dict) as columns; a failure is a row with an error, not the end of the job."""
    names = [f.split()[0] for f in fields.split(", ")]
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[column], strict=True):
                try:
                    got = measure(v)
                    out.append((k, *(got.get(n) for n in names), None))
                except Exception as e:  # noqa: BLE001  the contract: errors are kept as rows
                    out.append((k, *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, {fields}, error string")
