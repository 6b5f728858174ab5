"""Column profiles and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What each process counts, as conditions on its result.
_NO_NAME = "(ANALISIS LIKE 'SIN COINCIDENCIA%' OR ANALISIS LIKE 'DENOMINACION VACIA%' OR ANALISIS LIKE 'AMBAS DENOMINACIONES%')"
STATISTICS = {
    "mails": {"total": "true", "conservados": "ESTADO = 'CONSERVADO'", "modificados": "ESTADO = 'MODIFICADO'", "bajas": "ESTADO = 'BAJA'", "revision_manual": "ESTADO = 'REVISION MANUAL'"},
    "telefonos": {"total": "true", "validos": "VALIDO = 1", "bajas": "VALIDO <> 1", "moviles": "TIPO_LINEA = 'MOVIL'", "fijos": "TIPO_LINEA = 'FIJO'"},
    "denominacion": {"total": "true", "coincidentes": "COINCIDE = 1", "parciales": f"coalesce(COINCIDE, 0) <> 1 AND NOT {_NO_NAME}", "sin_coincidencia": _NO_NAME},
    "dep_mails": {"total": "true", "depurados": "FUE_DEPURADO", "sin_cambios": "NOT FUE_DEPURADO"},
    "dep_telefonos": {"total": "true", "depurados": "FUE_DEPURADO", "sin_cambios": "NOT FUE_DEPURADO", "pais_asumido": "ORIGEN_PAIS = 'asumido'", "sin_numero": "coalesce(E164, '') = ''"},
    "osint": {"total": "true", "consultados": "PROVEEDOR <> ''", "registrados": "ESTADO_OSINT = 'Registered'", "errores": "ESTADO_OSINT = 'Error'"},
    "cuit": {
        "total": "true",
        "validados": "ESTADO_VALIDACION IN ('CUIT Y DENOMINACION COINCIDENTES', 'VALIDADO (DNI Y NOMBRE COINCIDENTES)', 'VALIDADO MANUAL')",
        "no_coincide": "ESTADO_VALIDACION IN ('NO COINCIDE NINGUN PARAMETRO', 'NO COINCIDE NOMBRE', 'RECHAZADO MANUAL')",
        "solo_cuit": "ESTADO_VALIDACION = 'SOLO CUIT COINCIDENTE'",
        "solo_denom": "ESTADO_VALIDACION = 'SOLO DENOMINACION COINCIDENTE'",
        "pendientes": "ESTADO_VALIDACION = 'PENDIENTE DE DECISION'",
        "no_encontrados": "ESTADO_VALIDACION = 'DNI NO ENCONTRADO EN PADRON'",
        "dni_invalido": "ESTADO_VALIDACION IN ('DNI INVALIDO', 'CUIT Y DNI DEL ORIGEN NO CONCUERDAN')",
        "con_alerta": "ALERTAS <> ''",
    },
}


def statistics(result: DataFrame, process: str) -> DataFrame:
    """One row of counts; a process without its own counts rows only."""
    if process == "cuitificacion":
        number = F.nullif(F.col("NUMERO_BUSCADO"), F.lit(""))
        some = lambda test: F.count_distinct(F.when(F.expr(test), F.col("NUMERO_BUSCADO")))
        told = result.agg(F.count("*").alias("total"), F.count_distinct(number).alias("numeros_unicos"), some("ESTADO = 'ENCONTRADO'").alias("encontrados"), some("REVISION = 'SI'").alias("en_revision"))
        return told.select("total", "numeros_unicos", "encontrados", (F.col("numeros_unicos") - F.col("encontrados")).alias("no_encontrados"), "en_revision")
    if process == "comparacion":
        by = result.groupBy("MOTIVO").agg(F.count("*").alias("n"), F.sum(F.col("R_DISPERSION").cast("double")).alias("d"))
        one = lambda reason: F.coalesce(F.sum(F.when(F.col("MOTIVO") == reason, F.col("n"))), F.lit(0)).cast("long")
        return by.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            one("COINCIDENCIA EXACTA").alias("exactas"),
            one("SIN RELACION").alias("sin_relacion"),
            one("ALGORITMOS EN DESACUERDO").alias("en_desacuerdo"),
            F.round(F.sum("d") / F.sum("n"), 2).alias("dispersion_promedio"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("MOTIVO", "n")))).alias("por_motivo"),
        )
    return result.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in STATISTICS.get(process, {"total": "true"}).items()])


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: nulls, blanks, distinct values that are not blank, least and greatest length."""
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    full = {c: F.when(F.trim(t) != "", t) for c, t in text.items()}
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count_if(text[c].isNull()).alias(f"n{i}"), F.count_if(F.trim(text[c]) == "").alias(f"b{i}"), F.count_distinct(full[c]).alias(f"d{i}"), F.min(F.length(full[c])).alias(f"lo{i}"), F.max(F.length(full[c])).alias(f"hi{i}")]
    out = [F.struct(F.lit(c).alias("columna"), F.col(f"n{i}").alias("nulos"), F.col(f"b{i}").alias("blancos"), F.col(f"d{i}").alias("distintos"), F.col(f"lo{i}").alias("largo_min"), F.col(f"hi{i}").alias("largo_max")) for i, c in enumerate(columns)]
    return rows.agg(*aggs).select(F.inline(F.array(*out)))


def sample_profile(rows: DataFrame, columns: list[str], limit: int = 50) -> DataFrame:
    """The profile of a preview of at most 1 to 100 rows."""
    return preview(rows, columns, limit)[1]


def preview(rows: DataFrame, columns: list[str] | None = None, limit: int = 50, where: str | None = None, with_total: bool = False) -> tuple[DataFrame, DataFrame, int | None]:
    """(sample, its profile by column, rows in all) of those rows that pass a filter; the sample has the first 1 to 100 of them.

    With the total, one pass reads everything: the rows are counted as they go by the search for the first ones. Without it, reading stops when the sample is full.
    """
    from pyspark.sql import Observation

    spark, columns, n = rows.sparkSession, columns or rows.columns, max(1, min(100, limit))
    some = rows.filter(where) if where else rows
    some, seen = some.select(*[F.col(f"`{c}`") for c in columns]), Observation()
    if with_total:
        placed = some.withColumn("_place", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n"))
        first = placed.orderBy("_place").limit(n).drop("_place")
    else:
        first = some.limit(n)
    sample = spark.createDataFrame(first.collect(), some.schema)
    return sample, profile(sample, columns), seen.get["n"] if with_total else None


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a number from 1 in their order, without gaps; each task numbers its own after the counts of those before it."""
    placed = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_low")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = placed.join(F.broadcast(starts.select("_part", "_low", "_start")), "_part")
    return joined.select((F.col("_start") + F.col("_at") - F.col("_low") + 1).cast("long").alias(column), *[F.col(f"`{c}`") for c in rows.columns])


def first_unique(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return rows.groupBy(column).agg(F.min(order).alias("primera"))


def within_budget(values: DataFrame, order: str, limit: int, providers: int, at_least: int = 0) -> DataFrame:
    """The first floor(limit / providers) values by order; without providers the first ``limit``."""
    n = max(at_least, limit // providers) if providers else limit
    return values.orderBy(order).limit(n)


def newest(rows: DataFrame, live: DataFrame, key: str, when: str) -> DataFrame:
    """Stored and live entries by key, live ones winning, newest first."""
    both = rows.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_live").desc(), F.col(when).desc())))
    return ranked.filter("_r = 1").drop("_r", "_live").orderBy(F.col(when).desc())
