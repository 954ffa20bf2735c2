"""Reading and writing JSON lines, manifests, listings and clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import squeezed

SENTENCES = "cat string, text string, _corrupt string"


def read_corpus(spark: SparkSession, path: str, label: str = r"([^/]+?)\.jsonl?$") -> DataFrame:
    """JSON lines with text; src is what the pattern finds in the file's path, its stem by default; blanks are squeezed."""
    rows = spark.read.schema("text string").option("recursiveFileLookup", "true").json(path)
    rows = rows.select(F.regexp_extract("_metadata.file_path", label, 1).alias("src"), squeezed("text").alias("text"))
    return rows.where("text <> ''")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Authored sentences; a line that is no JSON is kept in _corrupt, blank lines are dropped by the reader."""
    return spark.read.schema(SENTENCES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def with_issue(rows: DataFrame) -> DataFrame:
    """bad json, missing key, or NULL."""
    return rows.withColumn("issue", F.when(F.col("_corrupt").isNotNull(), "bad json").when(F.col("cat").isNull() | F.col("text").isNull(), "missing key"))


def restricted(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def unfinished(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the output does not have yet."""
    return rows.join(done.select(key), key, "left_anti")


def read_counts(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """word, tab, count."""
    return spark.read.schema("word string, n long").option("sep", "\t").option("quote", "").csv(path).where(F.col("n") >= least)


def write_by_category(rows: DataFrame, path: str, by: str = "cat") -> None:
    rows.write.partitionBy(by).json(path)


def write_lines(rows: DataFrame, path: str, *columns: str, sep: str = "|") -> None:
    rows.select(F.concat_ws(sep, *columns).alias("value")).write.text(path)


def listing(names: DataFrame, pattern: str, groups: dict[str, int], skip: str = r"\.part(ial)?$", column: str = "name") -> tuple[DataFrame, DataFrame]:
    """Names parted by a pattern, and the names that do not fit; names that match skip are left out."""
    names = names.where(~F.col(column).rlike(skip))
    fits = F.col(column).rlike(pattern)
    return names.where(fits).select(column, *(F.regexp_extract(column, pattern, g).alias(k) for k, g in groups.items())), names.where(~fits)


def union_once(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of keyed tables; a key that comes twice raises an error when the rows are read."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = twice.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key twice: "), F.col(key).cast("string")))).otherwise(F.lit("")))
    return rows.join(checked.where("_ok = ''").select(key), key)


def report(rows: DataFrame, by: str, *measures) -> DataFrame:
    """One JSON object: for each group its measures."""
    groups = rows.groupBy(by).agg(*measures)
    names = [c for c in groups.columns if c != by]
    return groups.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("key"), F.struct(*names).alias("value")))))).alias("report"))


def read_clips(spark: SparkSession, path: str, rate: int = 24_000) -> DataFrame:
    """PCM16 WAV files as (path, samples array<float>, error): the first channel; other rates and formats are errors."""
    import io
    import wave

    import numpy as np
    import pandas as pd

    def load(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getsampwidth() != 2 or w.getframerate() != rate:
                            raise ValueError(f"{w.getsampwidth() * 8} bits at {w.getframerate()} Hz")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())[:, 0] / np.float32(32768)
                    out.append((name, x.astype(np.float32), None))
                except (ValueError, EOFError, wave.Error) as e:
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "samples", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, samples array<float>, error string")
