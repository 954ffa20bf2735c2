"""Whole files as rows: a sink for named files, which Spark has no writer for, and clips in it as PCM16 WAV."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITTEN = "name string, bytes long"


def write_files(rows: DataFrame, path: str) -> int:
    """(name, content) -> files below path, of any store that pyarrow knows; how many. A file is written under another name
    and then moved, so that readers see whole files and a task that runs again writes the same. Names are unique, without `..`."""
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                if ".." in name.split("/"):
                    raise ValueError(f"a name leads out of the folder: {name}")
                to = f"{root}/{name}"
                folder, _, last = to.rpartition("/")
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/.{last}.new") as f:
                    f.write(content.as_buffer())
                store.move(f"{folder}/.{last}.new", to)
                out.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.int64())], names=["name", "bytes"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(run, WRITTEN).agg(F.count("*")).first()[0]


def wav(samples: DataFrame, key: str, values: str, rate: int = 24_000) -> DataFrame:
    """(key, values: array of -1..1) -> key, content: mono PCM16 WAV."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(values):
                buffer = io.BytesIO()
                with wave.open(buffer, "wb") as w:
                    w.setparams((1, 2, rate, 0, "NONE", None))
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float32) if x.is_valid else np.zeros(0, np.float32)
                    w.writeframes((np.clip(v, -1, 1) * np.float32(32767)).astype("<i2").tobytes())
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], names=[key, "content"])

    kind = dict(samples.dtypes)[key]
    return samples.select(key, values).mapInArrow(run, f"`{key}` {kind}, content binary")
