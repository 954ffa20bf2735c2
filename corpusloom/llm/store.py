"""Tables, shared folders and small helpers that the training-data operators use."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import uuid
from functools import reduce, wraps
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word or a line end: blank and the code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, one of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: later steps read it from there, also after executors are lost."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() made, through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no live DataFrame needs; else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lower_az(c):
    return F.translate(c, UPPER, UPPER.lower())


def range_bits(docs: DataFrame, rows: int, size: int, most: int = 29) -> int:
    """The bits of ranges that hold so many of the documents (doc_id, text) and so many bytes of text each, at most."""
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return min(most, max(4, ceil(log2(max(1, n / rows, (total or 0) / size)))))


def unused(name: str, names: list[str]) -> str:
    """A name like this one that none of the names equals, whatever their case."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trim() -> None:
    """Gives this process's free memory back to the system: Arrow's pool and the C library keep it else, so that a worker which
    waits for its next task holds as much as its largest one took."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(function):
    """A function of mapInArrow, or of one argument for each group, that gives its memory back when a task or group is done."""

    @wraps(function)
    def task(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    @wraps(function)
    def group(table):
        out = function(table)
        trim()
        return out

    return task if inspect.isgeneratorfunction(function) else group


def in_batches(df: DataFrame, function, schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow with batches of so many rows at most, so that a worker holds few long texts at once.

    function takes a pyarrow.RecordBatch and yields lists of columns in the order of schema."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(trimmed(run), schema)


class Memo(dict):
    """A bounded cache over a function: two generations, of which the older goes when the younger is full. Strings of more than
    LONGEST characters are not kept, so that its bytes are bounded too."""

    LONGEST = 64

    def __init__(self, function, size: int):
        super().__init__()
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
            if isinstance(key, str) and len(key) > self.LONGEST:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def cut_points(df: DataFrame, column: str, parts: int, error: float) -> list[float]:
    """Values that part a column into about equal ranges; none for a table without values."""
    df = df.where(F.col(column).isNotNull()).select(column)
    if parts < 2 or df.isEmpty():
        return []
    return sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], error)))
