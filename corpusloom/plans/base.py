"""Tables that the registered queries read, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over the cores by their key, where their table comes in fewer parts than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key) if rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Lines of documents as candidate sentences: id, src, seq, text, in the order (src, id, seq); dealt over the cores for
    long work on each."""
    docs = table(spark, sf_dir, "documents")
    docs = spread(docs.select("doc_id", "source", "text"), "doc_id") if dealt else docs
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "src", (F.col("pos") + 1).cast("long").alias("seq"), F.trim("line").alias("text")).where("text <> ''")


LINES = "lines AS (SELECT doc_id AS id, source AS src, i::BIGINT AS seq, trim(parts[i]) AS text FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[i]) <> '')"
#: \\w of all scripts, and squeezed words, in SQL
W = r"\p{L}\p{N}_"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def sql_n_words(c: str) -> str:
    return f"len({sql_words(c)})"


def sql_loose_key(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def with_lines(body: str) -> str:
    return f"WITH {LINES} {body}"
