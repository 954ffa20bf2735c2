"""Token counts by a separator scan over flat token files without an index.

A flat file is a run of little-endian unsigned 16-bit (or 32-bit) token ids; an end-of-document id closes each document. The
scan reads it in blocks of fixed size, which know nothing of documents. In each block a vectorised search finds the
separators; a block tells how many it has, the tokens before the first and after the last, and the lengths between. A
prefix scan over the blocks of a file then carries the open length and the number of closed documents across the
boundaries, so that a document over any number of blocks is counted once.

Edge cases: an empty document has length 0; tokens after the last separator of a file are a last document; an empty file
has none; null texts are empty; repeated rows and long texts are written and counted as they come.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import shared_tokenizer
from corpusloom.llm.store import in_batches, read, written

END, WIDTH = 50_256, 2
BLOCK_TOKENS = 1 << 16
#: Bytes that are read at once, and in one task.
RANGE_BYTES, PART_BYTES = 8 << 20, 128 << 20


def write_flat(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, end: int = END, path: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into one flat file per task, in blocks as rows (file, block, data), and, in rows
    (file, ordinal, doc_id), tells which document was written where."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    bpe = shared_tokenizer(spark, path)
    schema = f"file long, block long, data binary, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    size = block_tokens * WIDTH
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")

    def run(batches):
        file, t, close = TaskContext.get().partitionId(), bpe.value, np.array([end], "<u2").tobytes()
        rest, block, ordinal = b"", 0, 0

        def blocks(parts, first):
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(parts, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, arrow[4].type)], schema=arrow)

        for batch in batches:
            made = [rest]
            for text in batch.column("text").to_pylist():
                made += [np.frombuffer(t.encode(text or ""), "<u4").astype("<u2").tobytes(), close]
            rest = b"".join(made)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id").cast(arrow[4].type)], schema=arrow)
            ordinal += n
            if full := len(rest) // size:
                yield blocks([rest[i * size : (i + 1) * size] for i in range(full)], block)
                block, rest = block + full, rest[full * size :]
        if rest:
            yield blocks([rest], block)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_flat(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """Flat files below a path, of any size, as rows (file, block, data); file is the path. Spark lists the files; tasks read
    ranges of blocks at their offset through pyarrow's file systems, which have to know the path's scheme."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    size = block_tokens * width
    step = max(1, RANGE_BYTES // size) * size
    parts = max(spark.sparkContext.defaultParallelism, -(-(files.agg(F.sum("length")).first()[0] or 0) // PART_BYTES))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("length") - 1), F.lit(step).cast("long"))).alias("at")
    ranges = files.select("file", "length", at).select("file", "at", F.least(F.lit(step), F.col("length") - F.col("at")).alias("n")).repartition(parts, "file", "at")

    def run(batch):
        from pyarrow import fs

        for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n")), strict=True):
            store, name = (fs.LocalFileSystem(), "/" + file[5:].lstrip("/")) if file.startswith("file:") else fs.FileSystem.from_uri(file)
            with store.open_input_file(name) as f:
                data = f.read_at(n, at)
            if len(data) != n:
                raise ValueError(f"{file}: {len(data)} of {n} bytes at {at}")
            blocks = [data[i : i + size] for i in range(0, max(1, n), size)]
            yield [[file] * len(blocks), pa.array(range(at // size, at // size + len(blocks)), pa.int64()), pa.array(blocks, pa.binary())]

    return in_batches(ranges, run, "file string, block long, data binary", 64)


def count_documents(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """(file, block, data) -> file, ordinal (from 0), n_tokens of each document."""
    kind = dict(blocks.dtypes)["file"]

    def scan(batch):
        file, block, out = batch.column("file"), batch.column("block"), []
        for data in batch.column("data").to_pylist():
            ids = np.frombuffer(data or b"", f"<u{width}")
            at = np.flatnonzero(ids == end)
            out.append((len(ids), len(at), int(at[0]) if len(at) else len(ids), int(len(ids) - 1 - at[-1]) if len(at) else len(ids), (np.diff(at) - 1).tolist()))
        yield [file, block, *map(list, zip(*out, strict=True))]

    seen = in_batches(blocks.select("file", "block", "data"), scan, f"file {kind}, block long, n long, ends long, head long, tail long, inner array<long>", 64)
    seen = written(seen)  # a few numbers a block and one a document
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    seen = seen.withColumn("closed", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    seen = seen.withColumn("open", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # what was open before the last block with a separator no longer is
    seen = seen.withColumn("carry", F.col("open") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("open"))).over(before), F.lit(0)))
    last = F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"))) == 1
    left_open = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n"))
    seen = seen.withColumn("rest", F.when(last & (left_open > 0), left_open))
    lengths = F.concat(F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>")), F.when(F.col("rest").isNotNull(), F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    return seen.select("file", "closed", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("closed") + F.col("i")).alias("ordinal"), "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = written(write_flat(read(spark, sf_dir, "documents").select("doc_id", "text")))
    counted = count_documents(flat.where("data is not null").select("file", "block", "data"))
    where = flat.where("data is null").select("file", "ordinal", "doc_id")
    return where.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
