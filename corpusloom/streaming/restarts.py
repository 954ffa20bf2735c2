"""Following metric logs that may start anew under the same name, with a stateful streaming operator.

A log arrives in chunks, one file each or as rows of a table, in any order: number `seq` of the log `run`, taken from byte `start` of the log. A
chunk that starts before the byte where the last one ended means that the log shrank: the run began anew, and what was read
before belongs to an earlier generation. Of each log the state holds the generation, the next byte and number, the rest of a
line whose end has not arrived, and chunks that came before their turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LINES = "run string, generation int, lines array<string>"
CHUNKS = "seq=(\\d+)/start=(\\d+)/"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Generations(StatefulProcessor):
    """Chunks of a log in their order, as complete lines with the log's generation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "generation int, next_byte long, next_seq long, rest string, waiting long")
        self.early = handle.getMapState("early", "seq long", "start long, size long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, next_byte, next_seq, rest, waiting = self.place.get() if self.place.exists() else (0, 0, 0, "", 0)
        for part in rows:
            # chunks whose turn it is pass by the state, which is asked only while some chunk waits there
            here = {int(q): (int(a), int(n), v or "") for q, a, n, v in zip(part["seq"], part["start"], part["size"], part["value"], strict=True) if q >= next_seq}
            done: list[tuple[int, list[str]]] = []
            while next_seq in here or (waiting and self.early.containsKey((next_seq,))):
                found = here.pop(next_seq, None)
                if waiting and (found is None or self.early.containsKey((next_seq,))):  # a number that came twice is read once
                    found = found or self.early.getValue((next_seq,))
                    self.early.removeKey((next_seq,))
                    waiting -= 1
                start, size, value = found
                if start < next_byte:
                    generation, rest = generation + 1, ""
                *lines, rest = (rest + value).split("\n")
                done.append((generation, [x for x in lines if x.strip() and "\0" not in x]))
                next_byte, next_seq = start + size, next_seq + 1
            for seq, chunk in here.items():
                if seq > next_seq:  # a number that was read before comes again only by mistake
                    waiting += not (waiting and self.early.containsKey((seq,)))
                    self.early.updateValue((seq,), chunk)
            if done:
                yield pd.DataFrame({"run": [key[0]] * len(done), "generation": [g for g, _ in done], "lines": [x for _, x in done]})
        self.place.update((generation, next_byte, next_seq, rest, waiting))

    def close(self) -> None:
        pass


def read_chunks(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of chunks below path, in folders run=.../seq=.../start=..., so many files a batch at most."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(path)
    at = F.col("_metadata.file_path")
    number = [F.regexp_extract(at, CHUNKS, g).cast("long") for g in (1, 2)]
    return files.select(F.regexp_extract(at, "run=([^/]+)/", 1).alias("run"), number[0].alias("seq"), number[1].alias("start"), F.col("_metadata.file_size").alias("size"), "value")


def read_chunk_rows(spark: SparkSession, path: str, most: int = 16) -> DataFrame:
    """A stream of chunks that are rows of a table, many in a file, so many files a batch at most."""
    return spark.readStream.schema("run string, seq long, start long, size long, value string").option("maxFilesPerTrigger", most).parquet(path)


def with_generations(chunks: DataFrame, schema: str) -> DataFrame:
    """(run, seq, start, size, value) -> run, generation and the rows of the lines that are complete and can be read."""
    found = chunks.groupBy("run").transformWithStateInPandas(statefulProcessor=Generations(), outputStructType=LINES, outputMode="append", timeMode="none")
    rows = found.select("run", "generation", F.explode("lines").alias("line")).select("run", "generation", F.from_json("line", schema).alias("m"))
    return rows.where("m IS NOT NULL AND m.step IS NOT NULL").select("run", "generation", "m.*")


def follow_generations(spark: SparkSession, path: str, table_path: str, checkpoint: str, schema: str, most: int = 1000):
    """Reads what has arrived, a chunk a file, into a table."""
    return follow_chunks(read_chunks(spark, path, most), table_path, checkpoint, schema)


def follow_chunks(chunks: DataFrame, table_path: str, checkpoint: str, schema: str):
    """Reads a stream of chunks into a table. State is kept in RocksDB, the only store that has maps; the setting is put back."""
    spark, name = chunks.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        rows = with_generations(chunks, schema)
        return rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def latest_generation(rows: DataFrame) -> DataFrame:
    """Of each run the rows since it last began anew."""
    newest = rows.groupBy("run").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["run", "generation"], "left_semi")
