"""Grids of runs that resume: a table of statistics by key, what is still to do, and logs of other programs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a run is known by; a run that is repeated takes the place of its row.
KEY = ("graph_name", "estimator", "epsilon", "delta", "k", "run_id")
#: Marks in the logs: a batch of samples, the time of a phase in milliseconds, and the end of a run.
TAKING, DONE_MS, ENDED = r"\[INFO \]: Iteration .*taking (\d+)", r"^done \(([0-9.eE+-]+) millisecs\)", "INFO: Getting results...done"


def record(rows: DataFrame, path: str) -> None:
    """Write statistics ``rows``, which have the columns of ``KEY``, into the table at ``path``.

    Each call adds one folder, named by its time, however many runs there are; ``recorded`` takes of a run the rows of its last
    call, so rows of a run that is recorded again, or whose job is tried again, are there once. Of rows of one key in
    ``rows`` all are kept.
    """
    rows.withColumn("recorded_at", F.lit(time.time_ns())).write.mode("append").partitionBy("recorded_at").parquet(path)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The statistics at ``path``, of ``schema``; no rows where nothing was recorded yet."""
    from pyspark.errors import AnalysisException

    try:
        every = spark.read.schema(f"{schema}, recorded_at long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    last = every.withColumn("_last", F.max("recorded_at").over(Window.partitionBy(*KEY)))
    return last.where("recorded_at = _last").drop("recorded_at", "_last")


def planned(grid: DataFrame, done: DataFrame, runs: int) -> DataFrame:
    """``grid(graph_name, estimator, epsilon)`` with ``finished`` (its runs in ``done``), and ``reason`` to skip it or null.

    ``done`` has ``terminated`` besides. A setting is skipped as ``hopeless`` if a run of the same graph and estimator
    with an epsilon as large or larger did not terminate, unless it is the largest of the grid and was never run;
    and as ``enough`` where ``runs`` runs are there. Equal epsilons are equal doubles. One aggregate of the runs and a
    window over the epsilons of a graph and estimator, whose number is that of the grid's.
    """
    own = ["graph_name", "estimator"]
    told = done.groupBy(*own, "epsilon").agg(F.count("*").alias("finished"), F.min("terminated").alias("worst"))
    top = grid.agg(F.max("epsilon").alias("top"))
    every = grid.select(*own, "epsilon").distinct().withColumn("_asked", F.lit(True)).join(told, [*own, "epsilon"], "full")
    larger = Window.partitionBy(*own).orderBy(F.desc("epsilon")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("_worst", F.min("worst").over(larger)).where("_asked").join(F.broadcast(top))
    finished = F.coalesce("finished", F.lit(0))
    first = (F.col("epsilon") == F.col("top")) & (finished == 0)
    reason = F.when(first, None).when(F.col("_worst") <= 0, "hopeless").when(finished >= runs, "enough")
    return every.select(*own, "epsilon", finished.cast("long").alias("finished"), reason.alias("reason"))


def to_do(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``grid``, which has the columns of ``KEY``, that ``done`` lacks."""
    return grid.join(done.select(*KEY).distinct(), list(KEY), "left_anti")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, line)`` of the logs at ``path``; ``at`` orders the lines of a file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.select("file", F.struct("_start", F.monotonically_increasing_id().alias("n")).alias("at"), F.col("value").alias("line"))


def _number(line: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast(kind)


def parse_logs(lines: DataFrame) -> DataFrame:
    """``(file, m, time, terminated)`` of ``lines(file, at, line)``, a row for each file.

    ``m`` is the most samples that an iteration took and ``time``, in seconds, the last time told; both are 0 where the run
    did not end. Lines of any other kind are passed over. An aggregate with a partial one before, so a log may have any
    length.
    """
    taken, ms = _number(F.col("line"), TAKING, "long"), _number(F.col("line"), DONE_MS, "double")
    told = lines.select("file", "at", taken.alias("taken"), ms.alias("ms"), F.col("line").contains(ENDED).alias("ended"))
    last = F.max_by(F.when(F.col("ms").isNotNull(), F.col("ms")), F.when(F.col("ms").isNotNull(), F.col("at")))
    found = told.groupBy("file").agg(F.coalesce(F.max("taken"), F.lit(0)).alias("m"), F.coalesce(last / 1000, F.lit(0.0)).alias("time"), F.max("ended").alias("ended"))
    zero = lambda c, z: F.when(F.col("ended"), F.col(c)).otherwise(z).alias(c)
    return found.select("file", zero("m", F.lit(0)), zero("time", F.lit(0.0)), F.col("ended").cast("int").alias("terminated"))
