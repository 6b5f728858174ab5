"""Structural normalisation: cells with several values become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.functions.text import letters_only

#: What people write in place of a value.
PLACEHOLDERS = ("notiene", "noposee", "sintelefono", "sintel", "sinmail", "sincorreo", "nocorresponde", "noregistra", "norecuerda", "nomail", "s/d", "sd")


def values_of(cell: Column) -> Column:
    """The values of a cell in order, repeats kept, placeholders and blanks left out."""
    raw = F.split(F.trim(F.coalesce(cell.cast("string"), F.lit(""))), r"[|;,]| {2,}|\t|\n|\r")
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: (x != "") & ~letters_only(x).isin(*PLACEHOLDERS))


def exploded(rows: DataFrame, key: str, media: list[str], extras: list[str] | None = None, keep_empty: bool = True, dedup_across_rows: bool = False) -> DataFrame:
    """One row for each row, medium and distinct value, the other media empty; a row without values gives one row if ``keep_empty``."""


    def marked(medium: str) -> Column:
        return F.transform(F.array_distinct(values_of(F.col(medium))), lambda v: F.struct(F.lit(medium).alias("m"), v.alias("v")))

    entries = F.flatten(F.array(*[marked(m) for m in media]))
    none = F.array(F.struct(F.lit("").alias("m"), F.lit("").alias("v")))
    entries = F.when(F.size(entries) > 0, entries).otherwise(none) if keep_empty else entries
    out = rows.select(F.col(key), *(extras or []), F.explode(entries).alias("_e"))
    out = out.select(key, *[F.when(F.col("_e.m") == m, F.col("_e.v")).otherwise("").alias(m) for m in media], *(extras or []))
    return out.dropDuplicates([key, *media]) if dedup_across_rows else out


def counts(source: DataFrame, result: DataFrame, key: str, media: list[str]) -> DataFrame:
    """Source rows, distinct keys, result rows and values that are not empty."""
    filled = sum((F.count_if(F.col(m) != "") for m in media[1:]), F.count_if(F.col(media[0]) != ""))
    a = source.agg(F.count("*").alias("filas_origen"), F.count_distinct(key).alias("claves"))
    b = result.agg(F.count("*").alias("filas_resultado"), filled.alias("valores"))
    return a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j").drop("_j")
