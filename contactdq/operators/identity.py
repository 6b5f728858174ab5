"""Argentine tax and identity numbers, and their lookup in a national registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactdq.functions.text import digits, filled
from contactdq.operators.names import name_percentage

#: Weights of the check digit, prefixes of natural and legal persons, marks of the registry.
WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
PERSON_PREFIXES, COMPANY_PREFIXES = ("20", "23", "24", "27"), ("30", "33", "34")
LOW_MARKS = ("*", "S", "SI", "1", "T", "TRUE", "B", "BAJA", "X")
ACTIVE_MARKS = ("N", "NO", "0", "F", "FALSE", "A", "ACTIVO", "ALTA", "", "-")

REGISTRY_COLUMNS = ("CUIT", "DENOMINACION", "NOMBRE_LIMPIO", "DNI", "SEXO", "FECHA_NACIMIENTO", "PROVINCIA", "ACTIVIDAD", "MARCA_BAJA", "FECHA_FALLECIMIENTO", "CUIT_REEMPLAZO")


def dni_reason(dni: Column) -> Column:
    """Why an identity number is implausible; empty if it is plausible."""
    n = F.length(dni)
    return (
        F.when(F.coalesce(dni, F.lit("")) == "", "DNI vacío o nulo")
        .when(~dni.rlike("^[0-9]+$"), F.concat(F.lit("El DNI contiene caracteres no numéricos: '"), dni, F.lit("'")))
        .when(n < 6, F.concat(F.lit("DNI demasiado corto ("), n, F.lit(" dígitos): '"), dni, F.lit("'")))
        .when(n > 8, F.concat(F.lit("DNI demasiado largo ("), n, F.lit(" dígitos): '"), dni, F.lit("'")))
        .when(dni.rlike("^([0-9])\\1*$"), F.concat(F.lit("DNI de relleno (todos los dígitos iguales): '"), dni, F.lit("'")))
        .otherwise("")
    )


def check_digit(ten: Column) -> Column:
    """The last digit of a tax id from its first ten: weighted sum modulo 11, where 11 gives 0 and 10 gives 9."""
    total = None
    for i, w in enumerate(WEIGHTS):
        term = F.substring(ten, i + 1, 1).cast("int") * w
        total = term if total is None else total + term
    rest = 11 - total % 11
    return F.when(F.length(ten) == 10, F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest))


def formatted_cuit(number: Column) -> Column:
    d = digits(number)
    return F.when(F.length(d) == 11, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 8), F.substring(d, 11, 1))).otherwise(F.coalesce(number.cast("string"), F.lit("")))


def validated_cuit(rows: DataFrame, column: str) -> DataFrame:
    """Adds CUIT_NORMALIZADO, VALIDO, MOTIVO, TIPO_PERSONA and DNI (the inner number without leading zeros)."""
    d = digits(F.col(column))
    prefix, last = F.substring(d, 1, 2), check_digit(F.substring(d, 1, 10))
    step = rows.withColumn("_d", d)
    reason = (
        F.when(d == "", "CUIT vacío o nulo")
        .when(F.length(d) != 11, F.concat(F.lit("El CUIT debe tener 11 dígitos y tiene "), F.length(d), F.lit(": '"), d, F.lit("'")))
        .when(~prefix.isin(*PERSON_PREFIXES, *COMPANY_PREFIXES), F.concat(F.lit("Prefijo de CUIT inexistente: '"), prefix, F.lit("'")))
        .when(F.substring(d, 11, 1).cast("int") != last, F.concat(F.lit("Dígito verificador incorrecto: termina en "), F.substring(d, 11, 1), F.lit(" y debería terminar en "), last))
        .otherwise("CUIT estructuralmente válido")
    )
    step = step.withColumn("MOTIVO", reason).withColumn("VALIDO", F.col("MOTIVO") == "CUIT estructuralmente válido")
    ok = F.col("VALIDO")
    return step.withColumns(
        {"CUIT_NORMALIZADO": F.when(ok, F.col("_d")), "TIPO_PERSONA": F.when(ok, F.when(F.substring("_d", 1, 2).isin(*PERSON_PREFIXES), "FISICA").otherwise("JURIDICA")), "DNI": F.when(ok, F.ltrim(F.substring("_d", 3, 8), F.lit("0")))}
    ).drop("_d")


def registry_keys(number: Column, kind: str = "dni") -> tuple[Column, Column]:
    """(tax id, identity number) to look a value up by: 11 digits are a tax id whatever is asked; more than 11 asked as a tax id are nothing."""
    d = digits(number)
    long = F.length(d) > 11
    return F.when(F.length(d) == 11, d).otherwise(""), F.when(F.length(d) == 11, "").when(long & F.lit(kind == "cuit"), "").otherwise(d)


def dni_variants(dni: Column) -> Column:
    """As is, padded to eight digits, without leading zeros; distinct, in this order, without empty ones."""
    return F.when(dni == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(F.array(dni, filled(dni, 8), F.ltrim(dni, F.lit("0")))), lambda x: x != ""))


def registry_snapshot(registry: DataFrame) -> DataFrame:
    """The registry with DNI_NORM and CUIT_NORM, digits only; written bucketed by these keys it serves lookups without a shuffle."""
    return registry.withColumns({"DNI_NORM": digits(F.col("DNI")), "CUIT_NORM": digits(F.col("CUIT"))})


def lookup_first_variant(rows: DataFrame, registry: DataFrame, number: str, row_id: str, kind: str = "dni") -> DataFrame:
    """Registry rows of each input row: by tax id, or by the first variant of the identity number that has any.

    ``registry`` is a snapshot. Rows without any match are kept once, with null registry columns. Each number is looked up once, and rows meet what was found by the number, so
    null and repeated row ids do no harm.
    """
    cuit, dni = registry_keys(F.col(number), kind)
    keyed = rows.withColumns({"_cuit": cuit, "_dni": dni})
    asked = keyed.select("_cuit", "_dni").distinct()
    variants = asked.select("_dni").distinct().select("_dni", F.posexplode(dni_variants(F.col("_dni"))).alias("_pos", "_k")).filter("_k <> ''")
    by_dni = variants.join(registry, F.col("_k") == F.col("DNI_NORM")).withColumn("_best", F.min("_pos").over(Window.partitionBy("_dni"))).filter("_pos = _best").drop("_pos", "_best", "_k")
    by_cuit = asked.filter("_cuit <> ''").select("_cuit").distinct().join(registry, F.col("_cuit") == F.col("CUIT_NORM"))
    found = asked.join(by_cuit, "_cuit").unionByName(asked.join(by_dni, "_dni"))
    return keyed.join(found, ["_cuit", "_dni"], "left").drop("_cuit", "_dni")


def low_mark(mark: Column) -> tuple[Column, Column]:
    """(is low, note) of a registry mark; an unknown one counts as active, with a note."""
    v = F.upper(F.trim(F.coalesce(mark, F.lit(""))))
    low = v.isin(*LOW_MARKS)
    return low, F.when(low, "Marcado como BAJA en el padrón").when(v.isin(*ACTIVE_MARKS), "").otherwise(F.concat(F.lit("MARCA_BAJA con valor no reconocido: '"), v, F.lit("' (se trata como activo)")))


def enriched(numbers: DataFrame, registry: DataFrame, number: str, row_id: str) -> DataFrame:
    """One row for each distinct denomination that the registry has for a number; REVISION says SI where there is more than one.

    All variants of an identity number count. Each number is looked up once, whatever the ids of the rows that ask for it. Of the rows of one denomination the first by kind of key, variant and tax id is shown.
    """
    d = digits(F.col(number))
    keys = F.when(F.length(d) == 11, F.array(F.struct(F.lit(0).alias("pos"), d.alias("k")))).otherwise(F.transform(dni_variants(d), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("k"))))
    asked = numbers.select(row_id, F.col(number).alias("NUMERO_ORIGEN"), d.alias("NUMERO_BUSCADO"), keys.alias("_keys"))
    single = asked.select("NUMERO_BUSCADO", "_keys").distinct().select("NUMERO_BUSCADO", F.explode("_keys").alias("_p")).select("NUMERO_BUSCADO", "_p.pos", "_p.k").filter("k <> ''")
    named = registry.withColumn("_den", F.trim(F.coalesce("DENOMINACION", F.lit("")))).filter("_den <> ''")
    hits = single.filter("pos = 0").join(named, F.col("k") == F.col("CUIT_NORM")).unionByName(single.filter("pos > 0").join(named, F.col("k") == F.col("DNI_NORM")))
    cut = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    shown = F.struct(F.col("pos"), F.col("CUIT_NORM").alias("c"), F.trim(F.coalesce("DNI", F.lit(""))).alias("dni"), cut("MARCA_BAJA").alias("m"), cut("FECHA_FALLECIMIENTO").alias("f"), cut("CUIT_REEMPLAZO").alias("r"))
    first = hits.groupBy("NUMERO_BUSCADO", F.col("_den").alias("DENOMINACION_ENCONTRADA")).agg(F.min(shown).alias("s"))
    counts = first.groupBy("NUMERO_BUSCADO").agg(F.count("*").cast("int").alias("_n"))
    joined = asked.drop("_keys").join(first, "NUMERO_BUSCADO", "left").join(counts, "NUMERO_BUSCADO", "left")
    found = F.col("DENOMINACION_ENCONTRADA").isNotNull()
    return joined.select(
        row_id,
        "NUMERO_ORIGEN",
        "NUMERO_BUSCADO",
        F.when(found, formatted_cuit(F.col("s.c"))).alias("CUIT_ENCONTRADO"),
        "DENOMINACION_ENCONTRADA",
        F.col("s.dni").alias("DNI_ENCONTRADO"),
        F.col("s.m").alias("MARCA_BAJA"),
        F.col("s.f").alias("FECHA_FALLECIMIENTO"),
        F.when(F.col("s.r").isNotNull(), formatted_cuit(F.col("s.r"))).alias("CUIT_REEMPLAZO"),
        F.when(F.col("NUMERO_BUSCADO") == "", "NUMERO INVALIDO").when(found, "ENCONTRADO").otherwise("NO ENCONTRADO").alias("ESTADO"),
        F.when(F.col("_n") > 1, "SI").otherwise("NO").alias("REVISION"),
        F.coalesce("_n", F.lit(0)).alias("COINCIDENCIAS"),
    )


def enrichment_counts(found: DataFrame) -> DataFrame:
    """Distinct numbers, those found, those not found and those in review."""
    number = F.col("NUMERO_BUSCADO")
    return found.agg(
        F.count_distinct(number).alias("unicos"), F.count_distinct(F.when(F.col("ESTADO") == "ENCONTRADO", number)).alias("encontrados"), F.count_distinct(F.when(F.col("REVISION") == "SI", number)).alias("en_revision")
    ).withColumn("no_encontrados", F.col("unicos") - F.col("encontrados"))


def manual_search(registry: DataFrame, number: str, limit: int = 200) -> DataFrame:
    """Exact search of one number, without repeats of (CUIT, DNI), cut at the limit; ``truncado`` says whether more exist."""
    d = "".join(c for c in number if "0" <= c <= "9")
    variants = {d, d.zfill(8), d.lstrip("0")} - {""}
    hits = registry.filter(F.col("CUIT_NORM") == d if len(d) == 11 else F.col("DNI_NORM").isin(*variants)).dropDuplicates(["CUIT_NORM", "DNI_NORM"])
    cut = hits.orderBy("CUIT_NORM", "DNI_NORM").limit(limit + 1)
    return cut.withColumns({"_i": F.row_number().over(Window.orderBy("CUIT_NORM", "DNI_NORM")), "truncado": F.count("*").over(Window.partitionBy(F.lit(0))) > limit}).filter(F.col("_i") <= limit).drop("_i")


#: States of a validation and its usual threshold.
BOTH_FIT, ONLY_NUMBER, ONLY_NAME, NOTHING_FITS = "CUIT Y DENOMINACION COINCIDENTES", "SOLO CUIT COINCIDENTE", "SOLO DENOMINACION COINCIDENTE", "NO COINCIDE NINGUN PARAMETRO"
SUBJECT_FITS, OTHER_NAME, NOT_FOUND, BAD_DNI = "VALIDADO (DNI Y NOMBRE COINCIDENTES)", "NO COINCIDE NOMBRE", "DNI NO ENCONTRADO EN PADRON", "DNI INVALIDO"
PENDING, CHOSEN, REFUSED, CONTRADICTION = "PENDIENTE DE DECISION", "VALIDADO MANUAL", "RECHAZADO MANUAL", "CUIT Y DNI DEL ORIGEN NO CONCUERDAN"
USUAL_LEAST = 90.0


def _text(column: str, registry: DataFrame) -> Column:
    """A registry column as trimmed text; empty where it is null or not there."""
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in registry.columns else F.lit("")


def _candidates(asked: DataFrame, registry: DataFrame, least: float) -> DataFrame:
    """``_c, _d, _n`` (tax id, identity number, name as asked) with ``by_cuit`` and ``by_dni``: candidates, the best name first.

    Keys are the values asked for, each triple once, so repeated or null row ids play no part and equal rows are compared once.
    """
    by_cuit = asked.filter("_c <> ''").join(registry, F.col("_c") == F.col("CUIT_NORM")).withColumn("_by", F.lit("c"))
    variants = asked.select("*", F.posexplode(dni_variants(F.col("_d"))).alias("_pos", "_k"))
    first = Window.partitionBy("_c", "_d", "_n")
    by_dni = variants.join(registry, F.col("_k") == F.col("DNI_NORM")).withColumn("_best", F.min("_pos").over(first)).filter("_pos = _best").drop("_pos", "_k", "_best").withColumn("_by", F.lit("d"))
    found = by_cuit.unionByName(by_dni)
    shown = F.coalesce(F.nullif(_text("NOMBRE_LIMPIO", registry), F.lit("")), _text("DENOMINACION", registry))
    low, note = low_mark(F.col("MARCA_BAJA")) if "MARCA_BAJA" in registry.columns else (F.lit(False), F.lit(""))
    death, replaced = _text("FECHA_FALLECIMIENTO", registry), _text("CUIT_REEMPLAZO", registry)
    alerts = F.array_compact(
        F.array(
            F.when(low, F.lit("DADO DE BAJA")).otherwise(F.nullif(note, F.lit(""))),
            F.when(death != "", F.concat(F.lit("FALLECIDO ("), death, F.lit(")"))),
            F.when(replaced != "", F.concat(F.lit("CUIT REEMPLAZADO POR "), formatted_cuit(replaced))),
        )
    )
    scored = found.withColumns({"_s": name_percentage(F.col("_n"), shown, least), "_shown": shown})
    details = {"sexo": "SEXO", "fecha_nacimiento": "FECHA_NACIMIENTO", "provincia": "PROVINCIA", "actividad": "ACTIVIDAD", "marca_baja": "MARCA_BAJA"}
    one = F.struct(
        (-F.col("_s.percent")).alias("orden"),
        F.col("CUIT_NORM").alias("cuit"),
        F.col("_s.percent").alias("porcentaje"),
        (F.col("_s.percent") >= min(100.0, max(0.0, least))).alias("coincide"),
        F.col("_s.analysis").alias("analisis"),
        F.coalesce(F.nullif(_text("DENOMINACION", registry), F.lit("")), F.col("_shown")).alias("denominacion"),
        F.col("_shown").alias("nombre_limpio"),
        *[_text(c, registry).alias(n) for n, c in details.items()],
        low.alias("es_baja"),
        death.alias("fecha_fallecimiento"),
        F.when(replaced != "", formatted_cuit(replaced)).alias("cuit_reemplazo"),
        alerts.alias("alertas"),
    )
    kept = lambda by: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("_by") == by, F.col("_one")))))
    return scored.select("_c", "_d", "_n", "_by", one.alias("_one")).groupBy("_c", "_d", "_n").agg(kept("c").alias("by_cuit"), kept("d").alias("by_dni"))


def _with_candidates(rows: DataFrame, registry: DataFrame, cuit: Column, dni: Column, name: Column, least: float) -> DataFrame:
    keyed = rows.withColumns({"_c": cuit, "_d": dni, "_n": F.coalesce(name.cast("string"), F.lit(""))})
    told = _candidates(keyed.select("_c", "_d", "_n").distinct(), registry, least)
    joined = keyed.join(told, ["_c", "_d", "_n"], "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(told.schema[c].dataType)) for c in ("by_cuit", "by_dni")})


def _joined(*notes: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*notes)), "; ")


def _taken(best: Column, state: Column, assigned: tuple[str, ...], cuit: str, name: str) -> dict[str, Column]:
    """The columns of the candidate that a state assigns; empty ones for the other states."""
    some = state.isin(*assigned)
    return {
        cuit: F.when(some, formatted_cuit(best["cuit"])),
        name: F.when(some, best["denominacion"]),
        "PORCENTAJE": F.when(some, best["porcentaje"]).otherwise(0.0),
        **{c: F.when(some, best[c.lower()]) for c in ("MARCA_BAJA", "FECHA_FALLECIMIENTO", "CUIT_REEMPLAZO")},
    }


def _decision_columns() -> list[Column]:
    return [F.lit(None).cast("string").alias("USUARIO_DECISION"), F.lit(None).cast("timestamp").alias("FECHA_DECISION")]


def validated_tax_ids(rows: DataFrame, registry: DataFrame, cuit: str | None, dni: str | None, name: str, row_id: str, least: float = USUAL_LEAST) -> DataFrame:
    """Tax id, identity number and name against the registry: one row for each input row with state, chosen candidate, alerts and all candidates.

    A tax id in the registry decides by the name's percentage. Without one, the rows of the identity number decide: one whose name fits
    corrects the tax id, several are left for a person to choose from. Either column may be missing.
    """
    none = F.lit("")
    c, d = digits(F.col(cuit)) if cuit else none, digits(F.col(dni)) if dni else none
    # Only eleven digits are a tax id; the text as it came is what an alert shows.
    step = _with_candidates(rows, registry, c, d, F.col(name), least).withColumn("_own", formatted_cuit(F.col("_c")))
    known, fitting = F.size("by_cuit") > 0, F.filter("by_dni", lambda x: x["coincide"])
    best = F.when(known, F.get("by_cuit", 0)).otherwise(F.get(fitting, 0))
    state = (
        F.when(known & F.get("by_cuit", 0)["coincide"], BOTH_FIT)
        .when(known, ONLY_NUMBER)
        .when(F.size(fitting) == 0, NOTHING_FITS)
        .when(F.size(fitting) == 1, ONLY_NAME)
        .otherwise(PENDING)
    )
    step = step.withColumns({"ESTADO_VALIDACION": state, "_best": best, "_fit": F.size(fitting)})
    inner, whole = F.ltrim(F.substring("_c", 3, 8), F.lit("0")), F.format_string("%.0f", F.bround("_best.porcentaje"))
    clash = F.when(
        (F.length("_c") == 11) & (F.col("_d") != "") & (inner != F.ltrim(F.col("_d"), F.lit("0"))),
        F.concat(F.lit("El CUIT del origen ("), F.col("_own"), F.lit(") contiene el DNI "), inner, F.lit(", pero la columna DNI dice "), F.col("_d"), F.lit(": los datos del origen se contradicen")),
    )
    st = F.col("ESTADO_VALIDACION")
    told = (
        F.when(st == ONLY_NUMBER, F.concat(F.lit("El CUIT existe en el padrón pero está a nombre de '"), F.col("_best.denominacion"), F.lit("' ("), whole, F.lit("% de coincidencia): puede ser el CUIT de otra persona")))
        .when((st == NOTHING_FITS) & (F.size("by_dni") > 0), F.concat(F.lit("El CUIT no figura en el padrón. Por DNI hay "), F.size("by_dni"), F.lit(" persona(s), pero ninguna con un nombre parecido")))
        .when(st == NOTHING_FITS, "Ni el CUIT ni el DNI figuran en el padrón")
        .when(st == PENDING, F.concat(F.lit("El CUIT no figura en el padrón. Por DNI hay "), F.col("_fit"), F.lit(" personas cuyo nombre supera el umbral: requiere decisión manual")))
        .when(st == ONLY_NAME, F.concat(F.lit("El CUIT del origen ("), F.col("_own"), F.lit(") no figura en el padrón, pero por DNI la persona SÍ está, con el CUIT "), formatted_cuit(F.col("_best.cuit")), F.lit(": el CUIT del origen estaría mal cargado")))
    )
    assigned = (BOTH_FIT, ONLY_NUMBER, ONLY_NAME)
    more = F.when(st.isin(*assigned) & (F.size("_best.alertas") > 0), F.array_join("_best.alertas", "; "))
    shown = _taken(F.col("_best"), st, assigned, "CUIT_PADRON", "DENOMINACION_PADRON")
    details = F.when(known, F.col("by_cuit")).otherwise(F.col("by_dni"))
    return step.select(
        row_id,
        (F.col(cuit).cast("string") if cuit else F.lit(None).cast("string")).alias("CUIT_ORIGEN"),
        (F.col(dni).cast("string") if dni else F.lit(None).cast("string")).alias("DNI_ORIGEN"),
        F.col(name).alias("DENOMINACION_ORIGEN"),
        *[shown[k].alias(k) for k in ("CUIT_PADRON", "DENOMINACION_PADRON", "PORCENTAJE")],
        F.lit(float(least)).alias("UMBRAL"),
        "ESTADO_VALIDACION",
        F.size(details).alias("CANDIDATOS"),
        *[shown[k].alias(k) for k in ("MARCA_BAJA", "FECHA_FALLECIMIENTO", "CUIT_REEMPLAZO")],
        _joined(clash, told, more).alias("ALERTAS"),
        *_decision_columns(),
        details.alias("CANDIDATOS_DETALLE"),
    )


def validated_against_registry(rows: DataFrame, registry: DataFrame, number: str, name: str, row_id: str, least: float = USUAL_LEAST, kind: str = "cuit") -> DataFrame:
    """``validated_tax_ids`` for one column of mixed numbers: eleven digits are a tax id, others an identity number."""
    cuit, dni = registry_keys(F.col(number), kind)
    mixed = rows.withColumns({"_cuit": cuit, "_dni": dni})
    return validated_tax_ids(mixed, registry, "_cuit", "_dni", name, row_id, least)


def validated_subjects(rows: DataFrame, registry: DataFrame, dni: str, name: str, row_id: str, least: float = USUAL_LEAST, settle_clear: bool = False, margin: float = 30.0) -> DataFrame:
    """Identity number and name against the registry: one row for each input row with state, chosen candidate, alerts and all candidates.

    One candidate is decided by the name. Several are different persons and always left to a person, unless ``settle_clear`` is set and the
    best one fits and leads the second by ``margin`` points.
    """
    step = _with_candidates(rows, registry, F.lit(""), digits(F.col(dni)), F.col(name), least)
    reason, n, best = dni_reason(F.col("_d")), F.size("by_dni"), F.get("by_dni", 0)
    lead = best["porcentaje"] - F.get("by_dni", 1)["porcentaje"]
    clear = (n > 1) & best["coincide"] & (lead >= margin) & F.lit(settle_clear)
    state = F.when(reason != "", BAD_DNI).when(n == 0, NOT_FOUND).when(clear | ((n == 1) & best["coincide"]), SUBJECT_FITS).when(n == 1, OTHER_NAME).otherwise(PENDING)
    step = step.withColumns({"ESTADO_VALIDACION": state, "_best": best, "_lead": lead})
    st = F.col("ESTADO_VALIDACION")
    own = F.when(st.isin(SUBJECT_FITS, OTHER_NAME) & (F.size("_best.alertas") > 0), F.array_join("_best.alertas", "; "))
    told = (
        F.when(st == BAD_DNI, reason)
        .when(st == PENDING, F.concat(n, F.lit(" personas distintas comparten este DNI (difieren en el prefijo del CUIT): requiere decisión manual")))
        .when((st == SUBJECT_FITS) & (n > 1), F.concat(F.lit("Resuelto automáticamente: "), n, F.lit(" personas con este DNI, pero el elegido le saca "), F.format_string("%.0f", F.bround("_lead")), F.lit(" puntos al segundo")))
    )
    shown = _taken(F.col("_best"), st, (SUBJECT_FITS, OTHER_NAME), "CUIT_ASIGNADO", "DENOMINACION_BCRA")
    asked = ~st.isin(BAD_DNI)
    return step.select(
        row_id,
        F.col(dni).cast("string").alias("DNI_ORIGINAL"),
        F.col("_d").alias("DNI"),
        F.col(name).alias("DENOMINACION_ORIGEN"),
        *[shown[k].alias(k) for k in ("CUIT_ASIGNADO", "DENOMINACION_BCRA", "PORCENTAJE")],
        F.lit(float(least)).alias("UMBRAL"),
        "ESTADO_VALIDACION",
        F.when(asked, n).otherwise(0).alias("CANDIDATOS"),
        *[shown[k].alias(k) for k in ("MARCA_BAJA", "FECHA_FALLECIMIENTO", "CUIT_REEMPLAZO")],
        _joined(own, told).alias("ALERTAS"),
        *_decision_columns(),
        F.col("by_dni").alias("CANDIDATOS_DETALLE"),
    )


def with_decisions(validated: DataFrame, decisions: DataFrame, row_id: str) -> DataFrame:
    """Pending rows take what a person decided: ``decisions`` has the row id (one row each), CUIT, USUARIO_DECISION and FECHA_DECISION.

    A null CUIT refuses all candidates; one that is no candidate of the row changes nothing.
    """
    cuit, name = ("CUIT_ASIGNADO", "DENOMINACION_BCRA") if "CUIT_ASIGNADO" in validated.columns else ("CUIT_PADRON", "DENOMINACION_PADRON")
    d = decisions.select(F.col(row_id), digits(F.col("CUIT")).alias("_chosen"), F.col("USUARIO_DECISION").alias("_user"), F.col("FECHA_DECISION").alias("_when"), F.lit(True).alias("_told"))
    joined = validated.join(d, row_id, "left")
    step = joined.withColumn("_one", F.get(F.filter("CANDIDATOS_DETALLE", lambda x: x["cuit"] == F.col("_chosen")), 0))
    open_ = (F.col("ESTADO_VALIDACION") == PENDING) & F.col("_told")
    taken, refused = F.coalesce(open_ & F.col("_one").isNotNull(), F.lit(False)), F.coalesce(open_ & (F.col("_chosen") == ""), F.lit(False))
    one = F.col("_one")
    new = {
        cuit: (formatted_cuit(one["cuit"]), None),
        name: (one["denominacion"], None),
        "PORCENTAJE": (one["porcentaje"], 0.0),
        "MARCA_BAJA": (one["marca_baja"], F.col("MARCA_BAJA")),
        "FECHA_FALLECIMIENTO": (one["fecha_fallecimiento"], F.col("FECHA_FALLECIMIENTO")),
        "CUIT_REEMPLAZO": (one["cuit_reemplazo"], F.col("CUIT_REEMPLAZO")),
        "ALERTAS": (F.array_join(one["alertas"], "; "), F.concat(F.lit("Ninguno de los "), F.col("CANDIDATOS"), F.lit(" candidatos fue considerado válido"))),
        "ESTADO_VALIDACION": (F.lit(CHOSEN), F.lit(REFUSED)),
        "USUARIO_DECISION": (F.col("_user"), F.col("_user")),
        "FECHA_DECISION": (F.col("_when"), F.col("_when")),
    }
    told = {c: F.when(taken, yes).when(refused, no).otherwise(F.col(c)) for c, (yes, no) in new.items()}
    return step.select(*[told.get(c, F.col(c)).alias(c) for c in validated.columns])


def state_counts(validated: DataFrame) -> DataFrame:
    """Rows by state, and how many of them carry an alert."""
    return validated.groupBy("ESTADO_VALIDACION").agg(F.count("*").alias("CANTIDAD"), F.count_if(F.col("ALERTAS") != "").alias("CON_ALERTA"))
