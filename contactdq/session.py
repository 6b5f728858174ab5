"""Session settings and table access shared by queries, tests and benchmarks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "contactdq", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a DataFrame to a new place below the folder that driver and executors share, and read it again.

    Several steps then read what was worked out once, plans stay small, and a lost executor costs nothing of what lies there. The folder is the one
    named in ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a temporary folder stands in.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.setdefault("base", f"file://{tempfile.mkdtemp(prefix='contactdq-')}")
    path = f"{base.rstrip('/')}/contactdq-{uuid.uuid4().hex}/{what}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
