"""Where the registry comes from: a snapshot written before, a table of the catalog, or another database."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactdq.operators.identity import registry_snapshot
from contactdq.sources.publish import checked_identifier

MODES = ("auto", "snapshot", "dblink", "remoto")


def open_registry(spark: SparkSession, mode: str = "auto", path: str | None = None, table: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """The registry with DNI_NORM and CUIT_NORM.

    ``snapshot`` reads what ``write_snapshot`` wrote to ``path``, ``dblink`` a table of the catalog, ``remoto`` a table of another database by Spark's JDBC
    source with the options ``jdbc``; ``auto`` takes the first of these, in this order, for which it is told enough. Another mode is an error.
    """
    if mode not in MODES:
        raise ValueError(f"no registry mode {mode!r}; there are {', '.join(MODES)}")
    given = {"snapshot": path, "dblink": table if not jdbc else None, "remoto": jdbc}
    chosen = next((m for m in MODES[1:] if given[m]), None) if mode == "auto" else mode
    if chosen is None or (chosen != "dblink" and not given[chosen]) or (chosen == "dblink" and not table):
        raise ValueError(f"registry mode {mode!r} is not told where to read")
    if chosen == "snapshot":
        return spark.read.parquet(f"{path.rstrip('/')}/rows")
    if chosen == "dblink":
        return registry_snapshot(spark.table(checked_identifier(table)))
    return registry_snapshot(spark.read.format("jdbc").options(**jdbc).load())


def write_snapshot(registry: DataFrame, path: str, at: datetime, source: str = "") -> int:
    """Write a snapshot, sorted by identity number within its files so that lookups skip most of them, and one row that tells its origin; returns its rows."""
    base = path.rstrip("/")
    registry_snapshot(registry).repartition("DNI_NORM").sortWithinPartitions("DNI_NORM").write.parquet(f"{base}/rows")
    rows = registry.sparkSession.read.parquet(f"{base}/rows").count()
    registry.sparkSession.createDataFrame([(source, rows, at)], "origen string, filas long, fecha timestamp").coalesce(1).write.parquet(f"{base}/meta")
    return rows


def partial_search(registry: DataFrame, fragment: str, limit: int = 200) -> DataFrame:
    """Registry rows whose identity number or tax id holds the digits of ``fragment``, in order of both, up to the limit; none without a digit."""
    digits = "".join(c for c in fragment if "0" <= c <= "9")
    hits = registry.filter((F.col("DNI_NORM").contains(digits) | F.col("CUIT_NORM").contains(digits)) & F.lit(bool(digits)))
    return hits.orderBy("DNI_NORM", "CUIT_NORM").limit(limit)
