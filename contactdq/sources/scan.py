"""Copying a large table by ranges of its key, so that a broken run goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def key_ranges(source: DataFrame, key: str, ranges: int) -> DataFrame:
    """``range, low`` (the least key of each range of about as many rows): a range partitioning of the key column alone. Rows without a key are in no range."""
    keys = source.select(F.col(f"`{key}`").alias("k")).filter("k IS NOT NULL").repartitionByRange(ranges, "k")
    return keys.groupBy(F.spark_partition_id().alias("range")).agg(F.min("k").alias("low"))


def scan(source: DataFrame, key: str, path: str, ranges: int = 16) -> DataFrame:
    """Copy a table range by range to ``path`` and read it back; what an earlier, broken run has stored whole is not read again.

    The bounds are worked out once and stored first, so all runs cut alike. Each range is a filter on the key, which sources push down (``key >= low AND key < next``);
    the first one also has the rows without a key and those that came below all bounds since, the last one those above. Rows of one key are never parted. A range counts as stored
    once all of its files are; ``<path>/last`` tells its last key and its rows.
    """
    spark, base = source.sparkSession, path.rstrip("/")
    if not _there(spark, f"{base}/bounds"):
        key_ranges(source, key, ranges).coalesce(1).write.mode("overwrite").parquet(f"{base}/bounds")
    lows = [r["low"] for r in spark.read.parquet(f"{base}/bounds").orderBy("low").collect()]  # as many rows as ranges
    k = F.col(f"`{key}`")
    for n in range(max(1, len(lows))):
        if _there(spark, f"{base}/last/range={n}"):
            continue
        above = (k >= F.lit(lows[n])) if n else F.lit(True)
        below = (k < F.lit(lows[n + 1])) if n + 1 < len(lows) else F.lit(True)
        own = above & below if n else (below | k.isNull())
        source.filter(own).write.mode("overwrite").parquet(f"{base}/rows/range={n}")
        stored = spark.read.schema(source.schema).parquet(f"{base}/rows/range={n}")
        stored.agg(F.max(k).alias("ultima"), F.count("*").alias("filas")).coalesce(1).write.mode("overwrite").parquet(f"{base}/last/range={n}")
    return spark.read.schema(source.schema).parquet(*[f"{base}/rows/range={n}" for n in range(max(1, len(lows)))])
