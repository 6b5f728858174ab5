"""Processing only what is new: by anti-join against what was done, or as a stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones; repeated and null keys keep all their rows. State grows with what is stored, not in memory."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def with_stamp(table: DataFrame, column: str = "FECHA_PROCESADO") -> DataFrame:
    """The table with its column of processing times, empty where it had none."""
    return table if column.upper() in {c.upper() for c in table.columns} else table.withColumn(column, F.lit(None).cast("timestamp"))


def pending(table: DataFrame, column: str = "FECHA_PROCESADO") -> DataFrame:
    """The rows of a table that no run has stamped yet."""
    return with_stamp(table, column).filter(F.col(column).isNull())


def stamped(table: DataFrame, processed: DataFrame, key: str, at: datetime, column: str = "FECHA_PROCESADO") -> DataFrame:
    """The table with the time of the run on those rows whose key was processed and that had none; a null key is never taken for processed."""
    done = processed.select(F.col(key).alias("_done")).filter("_done IS NOT NULL").distinct()
    joined = with_stamp(table, column).join(done, F.col(key) == F.col("_done"), "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.when(F.col("_done").isNotNull(), F.lit(at)))).drop("_done")


def caught_up(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str | None = None) -> None:
    """Read new Parquet files of a folder, transform them without state, append, and stop; the checkpoint remembers the files.

    With ``key``, repeats are dropped across runs; that state grows with the number of keys, so for long-lived use take ``new_rows``.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream.dropDuplicates([key]) if key else stream
    running = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    running.awaitTermination()
