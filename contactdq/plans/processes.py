"""The processes by name: each takes rows and parameters and gives its result table; sources and sinks are the caller's."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactdq.operators import identity, linking, mail_agent, mails, names, normalise, phones, profile
from contactdq.sources import files

#: Process keys, their category and whether a menu shows them.
REGISTRY = {
    "osint": ("buscar", True), "mails": ("validar", True), "telefonos": ("validar", True), "cuitificacion": ("buscar", True), "cuit": ("validar", True),
    "denominacion": ("validar", False), "comparacion": ("validar", False), "dep_mails": ("depurar", True), "dep_telefonos": ("depurar", True), "cruce_redes": ("buscar", True),
}


def _stamped(result: DataFrame, at: datetime) -> DataFrame:
    return result.withColumn("FECHA_PROCESO", F.lit(at))


def _yes(column: str):
    return F.when(F.col(column), "SI").otherwise("NO").alias(column)


def clean_mails(rows: DataFrame, at: datetime, id_col: str, column: str) -> DataFrame:
    """ID_ORIGEN, MAIL_ORIGINAL, MAIL_DEPURADO, FUE_DEPURADO, CAMBIOS, FECHA_PROCESO."""
    step = mails.cleaned(rows.select(F.col(id_col).cast("string").alias("ID_ORIGEN"), F.col(column).alias("MAIL_ORIGINAL")), "MAIL_ORIGINAL")
    return _stamped(step.select("ID_ORIGEN", "MAIL_ORIGINAL", "MAIL_DEPURADO", _yes("FUE_DEPURADO"), F.left(F.array_join("CAMBIOS", "; "), F.lit(1000)).alias("CAMBIOS")), at)


def clean_phones(rows: DataFrame, at: datetime, id_col: str, column: str, country: str = "AR") -> DataFrame:
    step = phones.cleaned_cells(rows, id_col, column, country)
    cols = ("PREFIJO_PAIS", "NUMERO_NACIONAL", "TELEFONO_DEPURADO", "E164", "ORIGEN_PAIS")
    return _stamped(step.select(F.col("ID_ORIGEN").cast("string"), "TELEFONO_ORIGINAL", *cols, _yes("FUE_DEPURADO"), F.left(F.array_join("CAMBIOS", "; "), F.lit(500)).alias("CAMBIOS")), at)


def validate_phones(rows: DataFrame, at: datetime, id_col: str, column: str, user: str = "engine", plan: DataFrame | None = None, country: str = "AR") -> DataFrame:
    """The 14 columns of a verdict; without a numbering plan no number is valid, and what only plans tell stays empty."""
    step = phones.validated(rows.select(F.col(id_col).cast("string").alias("ID_ORIGEN"), F.col(column).alias("TELEFONO_ORIGINAL")), "TELEFONO_ORIGINAL", plan, country)
    if plan is None:
        none = F.lit(None).cast("string")
        step = step.withColumns({"TELEFONO_NORMALIZADO": none, "TIPO_LINEA": none, **{c: F.lit("") for c in ("CODIGO_PAIS", "PREFIJO", "TELEFONO", "TIPO_TELEFONO")}})
    low = ~F.col("VALIDO")
    verdict = (F.col("VALIDO").cast("int").alias("VALIDO"), "MOTIVO", F.when(low, F.lit(at)).alias("FECHA_BAJA"), F.when(low, F.lit(user)).alias("USUARIO_BAJA"), F.when(low, F.col("MOTIVO")).alias("MOTIVO_BAJA"))
    return _stamped(step.select("ID_ORIGEN", "TELEFONO_ORIGINAL", "TELEFONO_NORMALIZADO", "CODIGO_PAIS", "PREFIJO", "TELEFONO", "TIPO_TELEFONO", "TIPO_LINEA", *verdict), at)


def judge_mails(rows: DataFrame, at: datetime, id_col: str, column: str, user: str = "engine") -> DataFrame:
    step = mail_agent.processed(rows.select(F.col(id_col).cast("string").alias("ID_ORIGEN"), F.col(column).alias("MAIL_ORIGINAL")), "MAIL_ORIGINAL")
    low = F.col("ESTADO") == "BAJA"
    return _stamped(step.select("ID_ORIGEN", "MAIL_ORIGINAL", "MAIL_DEPURADO", "ESTADO", "VALIDO", "MOTIVO", F.when(low, F.lit(at)).alias("FECHA_BAJA"), F.when(low, F.lit(user)).alias("USUARIO_BAJA"), F.when(low, F.col("MOTIVO")).alias("MOTIVO_BAJA")), at)


def compare(rows: DataFrame, at: datetime, id_col: str, left: str, right: str) -> DataFrame:
    step = names.six_metrics(rows.select(F.col(id_col).cast("string").alias("ID_ORIGEN"), F.col(left).alias("DENOMINACION_1"), F.col(right).alias("DENOMINACION_2")), "DENOMINACION_1", "DENOMINACION_2")
    cols = (*names.METRICS, "R_PROMEDIO", "R_MAXIMO", "R_MINIMO", "R_DISPERSION")
    return _stamped(step.select("ID_ORIGEN", "DENOMINACION_1", "DENOMINACION_2", "NORM_1", "NORM_2", *[F.col(c).cast("decimal(5,2)").alias(c) for c in cols], "MOTIVO", "DETALLE"), at)


def denominations(rows: DataFrame, at: datetime, left: str, right: str, least: float = 80.0) -> DataFrame:
    step = names.compared_denominations(rows, left, right, least)
    return _stamped(step.select(F.col(left).alias("DENOMINACION_ORIGEN"), F.col(right).alias("DENOMINACION_VALIDAR"), "PORCENTAJE", "UMBRAL", "COINCIDE", "ANALISIS"), at)


def enrich(rows: DataFrame, at: datetime, registry: DataFrame, id_col: str, number: str) -> DataFrame:
    return _stamped(identity.enriched(rows, identity.registry_snapshot(registry), number, id_col), at)


def validate_numbers(rows: DataFrame, at: datetime, registry: DataFrame, id_col: str, number: str, name: str, least: float = identity.USUAL_LEAST, dni: str | None = None) -> DataFrame:
    """By one column of mixed numbers, or by tax id and identity number where ``dni`` names a second one."""
    snapshot = identity.registry_snapshot(registry)
    if dni:
        return _stamped(identity.validated_tax_ids(rows, snapshot, number, dni, name, id_col, least), at)
    return _stamped(identity.validated_against_registry(rows, snapshot, number, name, id_col, least), at)


def validate_subjects(rows: DataFrame, at: datetime, registry: DataFrame, id_col: str, dni: str, name: str, least: float = identity.USUAL_LEAST, settle_clear: bool = False) -> DataFrame:
    return _stamped(identity.validated_subjects(rows, identity.registry_snapshot(registry), dni, name, id_col, least, settle_clear), at)


def cross(rows: DataFrame, at: datetime, base: DataFrame, k: int = 5, **columns) -> DataFrame:
    if not 1 <= k <= 20:
        raise ValueError("between 1 and 20 candidates")
    return _stamped(linking.cross_match(rows, base, k, **columns), at)


def cross_and_settle(rows: DataFrame, at: datetime, base: DataFrame, k: int = 5, user: str | None = None, margin: float = 0.03, **columns) -> DataFrame:
    """The cross-match with its second pass: yes rows that compete for one base row, or of one row, are settled by score and user (column ``user``)."""
    matched = cross(rows, at, base, k, **columns, **({"extras": [user]} if user else {}))
    keyed = matched.withColumns({"ID": F.concat_ws(":", "ID_ARCHIVO", F.col("RANKING").cast("string")), "USERNAME": F.col(user) if user else F.lit("")})
    return linking.resolved_conflicts(keyed, margin).drop("ID", "USERNAME" if user != "USERNAME" else "ID")


def dry_run(spark: SparkSession, path: str, column: str, registry_path: str, id_column: str, name_column: str, at: datetime, k: int = 5) -> DataFrame:
    """A file of contacts against a registry file, without any database: the rows are numbered from 1 in the order of the file."""
    contacts = profile.numbered(files.read_contacts(spark, path, column), "FILA")
    registry = files.read_registry(spark, registry_path, id_column, name_column)
    return cross(contacts, at, registry, k, left_id="FILA", left_name=next(c for c in contacts.columns if c.lower() == column.lower()), right_id="ID_BASE", right_name="DENOM")


def explode(rows: DataFrame, at: datetime, key: str, media: list[str], extras: list[str] | None = None) -> DataFrame:
    return normalise.exploded(rows, key, media, extras)


def scan_providers(rows: DataFrame, at: datetime, findings: DataFrame, mail: str, order: str, providers: list[str], limit: int = 20_000) -> DataFrame:
    return _stamped(mails.provider_scan(rows, mail, order, findings, providers, limit), at)


def confirm_mails(rows: DataFrame, at: datetime, column: str, order: str, findings: DataFrame, providers: list[str], limit: int | None = None) -> DataFrame:
    """Cleaning, validation and provider evidence in one flow."""
    return _stamped(mails.three_stages(rows, column, order, findings, providers, limit), at)


PROCESSES: dict[str, Callable[..., DataFrame]] = {
    "osint": scan_providers,
    "mails": judge_mails,
    "telefonos": validate_phones,
    "cuitificacion": enrich,
    "cuit": validate_numbers,
    "cuit_dni": validate_subjects,
    "denominacion": denominations,
    "comparacion": compare,
    "dep_mails": clean_mails,
    "dep_telefonos": clean_phones,
    "cruce_redes": cross,
    "cruce_denominaciones": cross_and_settle,
    "normalizacion": explode,
    "mails_osint": confirm_mails,
}


def run(name: str, rows: DataFrame, at: datetime, /, **parameters) -> tuple[DataFrame, DataFrame]:
    """(result, counts) of a process; an unknown name is an error."""
    if name not in PROCESSES:
        raise KeyError(f"no process {name!r}; there are {', '.join(sorted(PROCESSES))}")
    result = PROCESSES[name](rows, at, **parameters)
    return result, _counts(name, rows, result, parameters)


#: Parameters that take the identifier (or the left name) and the datum (or the right one) of a file, by process.
_OF_FILES = {
    "mails": ("id_col", "column"), "dep_mails": ("id_col", "column"), "telefonos": ("id_col", "column"), "dep_telefonos": ("id_col", "column"), "denominacion": ("left", "right"),
    "comparacion": ("left", "right"), "cuitificacion": ("", "number"), "cuit": ("number", "name"), "cuit_dni": ("dni", "name"), "mails_osint": ("", "column"),
}


def run_file(spark: SparkSession, name: str, path: str, at: datetime, /, **parameters) -> tuple[DataFrame, DataFrame]:
    """(result, counts) of a process over a delimited file or a workbook; its columns are found by their names, by the first row or by their places.

    Rows are numbered from 1 in the order of the file (FILA), which is their identifier where the file has none.
    """
    table, header, _ = files.read_table(spark, path)
    top = table.first()
    rows, first = profile.numbered(table, "FILA"), [str(c) if c is not None else "" for c in top] if top else []
    if name == "normalizacion":
        key, media, extras = files.normalisation_columns(header, first)
        return run(name, rows, at, key=table.columns[key], media=[table.columns[i] for i in media], extras=[table.columns[i] for i in extras], **parameters)
    if name not in _OF_FILES:
        raise KeyError(f"no process {name!r} over one file")
    one, two = files.process_columns(header, first, {"cuit_dni": "cuit", "mails_osint": "mails", "dep_mails": "mails", "dep_telefonos": "telefonos"}.get(name, name))
    chosen = {_OF_FILES[name][1]: table.columns[two]}
    if _OF_FILES[name][0]:
        chosen[_OF_FILES[name][0]] = table.columns[one] if one is not None else "FILA"
    if name in ("comparacion", "cuit", "cuit_dni", "cuitificacion"):
        chosen["id_col"] = "FILA"
    if name == "mails_osint":
        chosen["order"] = "FILA"
    return run(name, rows, at, **(chosen | parameters))


def _counts(name: str, rows: DataFrame, result: DataFrame, parameters: dict) -> DataFrame:
    if name == "normalizacion":
        told = normalise.counts(rows, result, parameters["key"], parameters["media"])
        return told.select(F.col("filas_resultado").alias("total"), F.col("claves").alias("cuit_unicos"), F.col("valores").alias("medios"))
    return profile.statistics(result.withColumn("FUE_DEPURADO", F.col("FUE_DEPURADO") == "SI") if "FUE_DEPURADO" in result.columns else result, "cuit" if name == "cuit_dni" else name)


def run_all(clients: list[dict], load: Callable[[dict], DataFrame], name: str, at: datetime) -> list[tuple[str, str, str]]:
    """(client, state, message) of each client in turn; one failure never stops the rest."""
    told = []
    for client in clients:
        try:
            result, _ = run(name, load(client), at, **client.get("parameters", {}))
            told.append((client["name"], "FINALIZADO", str(result.count())))
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            told.append((client["name"], "ERROR", str(error).splitlines()[0]))
    return told


def run_states(log: DataFrame, running: list[str]) -> DataFrame:
    """Runs stored as going on that no process holds any more were interrupted."""
    lost = (F.col("ESTADO") == "EN_CURSO") & ~F.col("ID").isin(*running) if running else F.col("ESTADO") == "EN_CURSO"
    return log.withColumn("ESTADO", F.when(lost, "INTERRUMPIDO").otherwise(F.col("ESTADO")))
