"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset (tests, local mode)
    a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _LOCAL.setdefault("base", f"file://{tempfile.mkdtemp(prefix='contactdq-')}")
    return f"{base.rstrip('/')}/contactdq-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{what}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder under one path; those that no later step reads are deleted at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        """Write a DataFrame and read it again."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{what}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned; what still reads them fails, so nothing may."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a task makes of one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of a DataFrame as one struct: columns made beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Fixed: the ASCII white-space characters, plainly and as the inside of a pattern's class.
SPACES, SPACE_CLASS = " \t\n\x0b\x0c\r", r" \t\n\x0B\f\r"


def spaced_words(text: Column) -> Column:
    """Words between the ASCII white-space characters 09-0D and 20; null and blank texts give an empty array."""
    flat = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, f"[{SPACE_CLASS}]+"))
