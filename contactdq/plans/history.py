"""The record of runs: one row for each state a run takes, appended, and the newest row of each run as its history."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, tipo string, origen string, descripcion string, usuario string, cliente string, fecha_inicio timestamp, fecha_fin timestamp, estado string, stats map<string,string>, tabla_resultado string, csv string, error string, log array<string>, registrado timestamp"

#: Fixed: how many runs a history shows.
SHOWN = 300


class Run:
    """A run that writes down its start and its end; messages and counts go with the end."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, at: datetime, **about: str):
        self.spark, self.folder = spark, folder
        self.row = {"id": uuid.uuid4().hex[:12], "tipo": kind, "fecha_inicio": at, "estado": "EN_CURSO", "stats": {}, "log": [], **about}
        self._write(at)

    def say(self, at: datetime, message: str) -> None:
        self.row["log"].append(f"{at:%H:%M:%S}  {message}")

    def end(self, at: datetime, state: str, stats: dict | None = None, **about: str) -> None:
        self.row |= {"estado": state, "fecha_fin": at, "stats": {k: str(v) for k, v in (stats or {}).items()}, **about}
        self._write(at)

    def _write(self, at: datetime) -> None:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        row = {**self.row, "registrado": at}
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)


def history(spark: SparkSession, folder: str, limit: int = SHOWN) -> DataFrame:
    """The newest state of each of the last runs, the newest run first."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    newest = Window.partitionBy("id").orderBy(F.col("registrado").desc(), (F.col("estado") == "EN_CURSO").asc())
    last = rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    return last.orderBy(F.col("fecha_inicio").desc(), "id").limit(limit)
