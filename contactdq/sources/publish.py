"""Publishing results: names, identifiers, checked table writes, CSV files, audit rows."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]{0,127}")


def plain_identifier(text: str) -> str:
    """Upper case, no accents, anything but letters and digits one underscore."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9]+", "_", flat).strip("_").upper()


def result_name(user: str, client: str, now: datetime, longest: int = 128) -> str:
    """USER_CLIENT_yyyymmdd_HHMMSS; what is too long loses letters before the time stamp."""
    stamp = now.strftime("%Y%m%d_%H%M%S")
    front = f"{plain_identifier(user)}_{plain_identifier(client)}"
    return f"{front[: longest - len(stamp) - 1].rstrip('_')}_{stamp}" if longest < 128 else f"{front}_{stamp}"


def checked_identifier(name: str) -> str:
    """The name, if it is a table name with at most one schema in front; an error otherwise."""
    parts = name.split(".")
    if len(parts) > 2 or not all(_IDENTIFIER.fullmatch(p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def publish(result: DataFrame, path: str, expected: int | None = None) -> int:
    """Write to a staging folder, compare its rows with those produced, and only then take the final name.

    Nothing is left under the final name if counts differ or a task fails for good. The rows are counted while they are written.
    """
    from pyspark.sql import Observation

    spark, seen = result.sparkSession, Observation()
    staging = f"{path.rstrip('/')}__staging"
    result.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(staging)
    stored = spark.read.schema(result.schema).parquet(staging).count()
    jvm = spark.sparkContext._jvm
    place, final = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if stored != (seen.get["n"] if expected is None else expected):
        store.delete(place, True)
        raise ValueError(f"{stored} rows stored, {seen.get['n'] if expected is None else expected} expected; nothing published")
    if store.exists(final):
        raise FileExistsError(path)
    store.rename(place, final)
    return stored


def write_csv(result: DataFrame, path: str, sep: str = ",", bom: bool = True) -> bool:
    """CSV with a header, one file for each task, UTF-8 with a byte-order mark in the first header cell; nothing for an empty result."""
    if result.isEmpty():
        return False
    names = [*result.columns]
    named = result.toDF(*([("﻿" if bom else "") + names[0], *names[1:]]))
    named.write.options(sep=sep, header=True, encoding="UTF-8", quote='"', escape='"').csv(path)
    return True


def publish_with_csv(result: DataFrame, path: str, csv_path: str, sep: str = ",") -> int:
    """Publish a result, then write the CSV beside it from what was stored, so the plan runs once; the number of rows."""
    stored = publish(result, path)
    if stored:
        write_csv(result.sparkSession.read.schema(result.schema).parquet(path), csv_path, sep)
    return stored


def snapshot(registry: DataFrame, table: str, buckets: int = 256, at: datetime | None = None, source: str = "") -> int:
    """A registry as two tables, ``<table>_dni`` and ``<table>_cuit``, each bucketed and sorted by its key, so that lookups by either join it without moving it.

    ``<table>_meta`` tells origin, rows and date. The registry is worked out once: the second table is made from the first. Returns the rows.
    """
    spark, name = registry.sparkSession, checked_identifier(table)
    registry.write.bucketBy(buckets, "DNI_NORM").sortBy("DNI_NORM").mode("overwrite").saveAsTable(f"{name}_dni")
    spark.table(f"{name}_dni").write.bucketBy(buckets, "CUIT_NORM").sortBy("CUIT_NORM").mode("overwrite").saveAsTable(f"{name}_cuit")
    rows = spark.table(f"{name}_cuit").count()
    spark.createDataFrame([(source, rows, at)], "origen string, filas long, fecha timestamp").coalesce(1).write.mode("overwrite").saveAsTable(f"{name}_meta")
    return rows


def overwrite_touched(table: DataFrame, changed: DataFrame, path: str, partition: str, key: str) -> int:
    """Put ``changed`` rows (of the same columns) in place of those with their keys, in a table of files partitioned by a column; the number of partitions written anew.

    Only partitions that hold a changed row are written, each as a whole. The new rows are stored first, so a failure leaves every partition either old or new.
    """
    from contactdq.session import stored

    spark = table.sparkSession
    changed = stored(changed.select(*table.columns), "changed")
    touched = changed.select(partition).distinct()
    kept = table.join(touched, partition, "left_semi").join(changed.select(key), key, "left_anti")
    fresh = stored(kept.select(*table.columns).unionByName(changed), "fresh")
    n = touched.count()
    if n:
        fresh.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        spark.catalog.refreshByPath(path)
    return n


def shortened(text: Column, width: int) -> Column:
    """A text of at most ``width`` characters; what is cut ends with three dots. The whole text belongs into the audit rows."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width - 3)), F.lit("...")))


def audit(actions: DataFrame, table_name: str, user: str, key: str, before: list[str], after: list[str]) -> DataFrame:
    """What would be changed, as rows of an audit table: the row before and after as JSON."""
    return actions.select(
        F.lit(table_name).alias("TABLA"),
        F.lit("UPDATE").alias("OPERACION"),
        F.col(key).cast("string").alias("ID_REGISTRO"),
        F.to_json(F.struct(*sorted(before)), {"ignoreNullFields": "false"}).alias("DATOS_ANTES"),
        F.to_json(F.struct(*sorted(after)), {"ignoreNullFields": "false"}).alias("DATOS_DESPUES"),
        F.lit(user).alias("USUARIO_BD"),
    )


def catalog(spark: SparkSession, database: str | None = None, views: bool | None = None, text: str = "") -> DataFrame:
    """Tables and views of the catalog with their columns, the system's own left out.

    ``views`` asks for views only or tables only, ``text`` for names that hold it, whatever its case. One row of names for each column, from the catalog's own lists.
    """
    rows = []
    for db in [database] if database else [d.name for d in spark.catalog.listDatabases() if d.name.lower() not in ("information_schema", "sys")]:
        for t in spark.catalog.listTables(db):
            is_view = t.tableType in ("VIEW", "TEMPORARY")
            if views not in (None, is_view) or text.lower() not in t.name.lower():
                continue
            name = t.name if t.isTemporary else f"{db}.{t.name}"
            rows += [(db, t.name, "VISTA" if is_view else "TABLA", c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "esquema string, tabla string, clase string, columna string, tipo string").distinct()
