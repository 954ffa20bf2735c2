"""Following metric logs with Structured Streaming. One file a flush, written by rename: Spark does not follow a growing file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"
METRIC = "run string, attempt int, step long, stage string, epoch int, wall_time double, loss double"


def read_log(spark: SparkSession, path: str, schema: str = METRIC) -> DataFrame:
    """A stream of metric rows from arriving text files; lines that are no complete JSON are skipped."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(path)
    row = F.from_json("value", schema)
    return lines.select(row.alias("m")).where("m.step is not null and m.run is not null").select("m.*")


def latest_run(rows: DataFrame) -> DataFrame:
    """Rows of the newest run only: a restart begins a new run id. Ids are ordered by name, a number at their end as a number."""
    digits = F.ltrim(F.regexp_extract("run", r"(\d*)$", 1), F.lit("0"))
    newest = rows.agg(F.max_by("run", F.struct(F.regexp_replace("run", r"\d+$", ""), F.length(digits), digits, "run")).alias("run"))
    return rows.join(F.broadcast(newest), "run")


def resumed(rows: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """One row a step: the last attempt wins; steps of earlier attempts beyond their checkpoint (run, attempt, step) are dropped."""
    if checkpoints is not None:
        limit = checkpoints.select("run", "attempt", F.col("step").alias("_limit"))
        rows = rows.join(limit, ["run", "attempt"], "left").where("_limit is null or step <= _limit").drop("_limit")
    rest = [c for c in rows.columns if c not in ("run", "step")]
    best = rows.groupBy("run", "step").agg(F.max_by(F.struct(*rest), F.col("attempt")).alias("r"))
    return best.select("run", "step", "r.*")


def status(rows: DataFrame, max_steps: int, price_per_hour: float, window: int = 200) -> DataFrame:
    """Where each run is: step, percent, stage, seconds a step, rest of time, cost so far, mean loss of the last 50 rows."""
    from corpusloom.operators import series as S

    last = rows.groupBy("run").agg(F.max("step").alias("step"), F.max_by("stage", "step").alias("stage"), F.max_by("epoch", "step").alias("epoch"), (F.max_by("wall_time", "step") - F.min_by("wall_time", "step")).alias("elapsed"))
    gap = S.typical_gap(rows, "step", "wall_time", window, ["run"])
    mean = S.latest_means(rows, "step", ["loss"], 50, ["run"]).withColumnRenamed("loss", "latest_loss")
    out = last.join(gap, "run", "left").join(mean, "run", "left")
    return out.select("run", "step", "stage", "epoch", F.round(100 * F.col("step") / max_steps, 2).alias("percent"), "seconds_per_step", F.round((max_steps - F.col("step")) * F.col("seconds_per_step")).alias("eta_seconds"), F.round(F.col("elapsed") / 3600 * price_per_hour, 3).alias("cost"), "latest_loss")


def follow(log: DataFrame, table_path: str, checkpoint: str):
    """Appends arriving rows to a table and ends when all that is there has been read; the checkpoint keeps what was read."""
    return log.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_versions(spark: SparkSession, path: str, pattern: str = r"step-(\d{8})") -> DataFrame:
    """Each completed version once, by its markers (not empty: Spark passes over empty files); names with .partial are no version."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.done").option("recursiveFileLookup", "true").load(path)
    names = files.select(F.regexp_extract("path", pattern, 1).alias("version"), "path").where("version <> '' and path not like '%.partial%'")
    return names.dropDuplicates(["version"]).select("version")


def score_arriving(takes: DataFrame, score, table_path: str, checkpoint: str):
    """Scores every take that has arrived, once: score is DataFrame -> DataFrame."""
    return takes.writeStream.foreachBatch(lambda batch, _: score(batch).write.mode("append").parquet(table_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listings_at_steps(steps: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """(step, clip): the newest n steps with the clips listed for them, one row each; a step without clips has one with NULL."""
    newest = steps.select("step").distinct().orderBy(F.desc("step")).limit(n)
    return newest.join(files.select("step", "clip"), "step", "left")
