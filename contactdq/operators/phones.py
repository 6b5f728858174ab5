"""Phone numbers: splitting of cells, cleaning to country code and national number, filler numbers, structural checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.functions.barrier import settled
from contactdq.functions.text import letters_only
from contactdq.session import stored

#: Country codes, label words, placeholders.
COUNTRY_CODES = {"AR": "54", "UY": "598", "BR": "55", "CL": "56", "PY": "595"}
LABELS = r"(?iu)\b(tel|telefono|teléfono|cel|celular|whatsapp|wsp|wpp|movil|móvil|fijo|contacto|llamar|int|interno)\b\.?:?"
NO_PHONE = ("notiene", "noposee", "sintelefono", "sintel", "notienetel", "nocorresponde", "noregistra", "norecuerda")
SEPARATOR = r"(?i)\s*[/;,]\s*|\s+y\s+"


def parts(cell: Column) -> Column:
    """The numbers of a cell; one null for a null or blank cell."""
    some = F.filter(F.transform(F.split(cell, SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, some).otherwise(F.array(F.lit(None).cast("string")))


def cleaned(rows: DataFrame, column: str, country: str = "AR") -> DataFrame:
    """Adds PREFIJO_PAIS, NUMERO_NACIONAL, TELEFONO_DEPURADO, E164, ORIGEN_PAIS, FUE_DEPURADO and CAMBIOS (a list of notes)."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    plain = F.trim(F.regexp_replace(raw, LABELS, " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "^00", "+"), "[^0-9+]", "")
    step = rows.withColumns({"_raw": raw, "_c": F.regexp_replace(plain, r"(?<!^)\+", "")})
    step = step.withColumns({"_plus": F.col("_c").startswith("+"), "_d": F.ltrim(F.col("_c"), F.lit("+"))})
    home = COUNTRY_CODES[country]
    codes = [home] + sorted((c for c in COUNTRY_CODES.values() if c != home), key=lambda c: (-len(c), c))
    code = F.lit(None).cast("string")
    for c in reversed(codes):
        code = F.when(F.col("_d").startswith(c) & (F.length("_d") > len(c) + 5), c).otherwise(code)
    step = step.withColumn("_code", code)
    step = step.withColumns({"PREFIJO_PAIS": F.coalesce("_code", F.lit(home)), "_n": F.when(F.col("_code").isNull(), F.col("_d")).otherwise(F.expr("substring(_d, length(_code) + 1)"))})
    mobile = (F.col("PREFIJO_PAIS") == "54") & F.col("_n").rlike("^9[0-9]{10}$")
    step = step.withColumns({"_mobile": mobile, "_n2": F.when(mobile, F.expr("substring(_n, 2)")).otherwise(F.col("_n"))})
    known = F.col("PREFIJO_PAIS").isin(*COUNTRY_CODES.values())
    trunk = known & F.col("_n2").rlike("^0.+")
    step = step.withColumns({"_trunk": trunk, "_n3": F.when(trunk, F.expr("substring(_n2, 2)")).otherwise(F.col("_n2"))})
    twelve = (F.col("PREFIJO_PAIS") == "54") & (F.length("_n3") == 12)
    place = F.when(F.col("_n3").rlike("^1115"), 2)
    for at in (3, 4, 2):
        place = place.when(F.substring("_n3", at + 1, 2) == "15", at)
    step = step.withColumn("_fifteen", F.when(twelve, place))
    step = step.withColumn("NUMERO_NACIONAL", F.when(F.col("_fifteen").isNotNull(), F.expr("concat(substring(_n3, 1, _fifteen), substring(_n3, _fifteen + 3))")).otherwise(F.col("_n3")))
    some = F.col("_d") != ""
    notes = F.array_compact(
        F.array(
            F.when((F.col("_raw") != "") & (F.col("_c") != F.col("_raw")), "quitados símbolos y espacios"),
            F.when(some & F.col("_code").isNull(), F.lit(f"código de país asumido: {home}")),
            F.when(some & F.col("_mobile"), "quitado el 9 de móvil"),
            F.when(some & F.col("_trunk"), "quitado el 0 troncal"),
            F.when(some & F.col("_fifteen").isNotNull(), "quitado el 15 de móvil"),
        )
    )
    only = lambda c: F.when(some, c)
    return step.withColumns(
        {
            "CAMBIOS": notes,
            "FUE_DEPURADO": some & (F.size(notes) > 0),
            "ORIGEN_PAIS": only(F.when(F.col("_code").isNull(), "asumido").when(F.col("_plus"), "explicito").otherwise("detectado")),
            "TELEFONO_DEPURADO": only(F.concat(F.lit("+"), F.col("PREFIJO_PAIS"), F.lit(" "), F.col("NUMERO_NACIONAL"))),
            "E164": only(F.concat(F.lit("+"), F.col("PREFIJO_PAIS"), F.col("NUMERO_NACIONAL"))),
        }
    ).withColumns({"PREFIJO_PAIS": only(F.col("PREFIJO_PAIS")), "NUMERO_NACIONAL": only(F.col("NUMERO_NACIONAL"))}).drop("_raw", "_c", "_plus", "_d", "_code", "_n", "_mobile", "_n2", "_trunk", "_n3", "_fifteen")


def cleaned_cells(rows: DataFrame, row_id: str, column: str, country: str = "AR") -> DataFrame:
    """One row for each number of a cell: ID_ORIGEN, TELEFONO_ORIGINAL and the columns of cleaned; an empty cell gives one null row."""
    single = rows.select(F.col(row_id).alias("ID_ORIGEN"), F.explode(parts(F.col(column))).alias("TELEFONO_ORIGINAL"))
    return cleaned(single, "TELEFONO_ORIGINAL", country)


#: Fixed: verdicts on a number, in order of trial; the last is given where only numbering plans could tell.
EMPTY, NO_NUMBER, TOO_SHORT = "Teléfono vacío o nulo", "Texto corresponde a 'no posee teléfono' (no es un número)", "No contiene suficientes dígitos para ser un teléfono"
NO_PLANS = "Librería 'phonenumbers' no instalada (pip install phonenumbers)"


#: Fixed: verdicts that a numbering plan gives.
NO_COUNTRY, POSSIBLE, WRONG_LENGTH = "No se pudo interpretar como número telefónico (Invalid country calling code)", "Formato posible pero no es un número válido en el plan de numeración", "Cantidad de dígitos incorrecta para la región"
VALID = "Número válido"

#: Fixed: label words taken out wherever they stand, with a dot or colon behind them.
LABEL_PARTS = r"(cel|tel|celular|telefono|teléfono|fijo|movil|móvil|wsp|whatsapp)\s*[.:]?"

#: A numbering plan: numbers of a country that start so have these lengths, are of this kind, and have an area code of so many digits; a trunk prefix is dialled within the country only.
PLAN = "CODIGO_PAIS string, PREFIJO string, LARGO_MIN int, LARGO_MAX int, TIPO_LINEA string, LARGO_AREA int, TRONCAL string"


def _steps(number: Column) -> Column:
    return F.transform(F.sequence(F.lit(2), F.length(number)), lambda i: F.pmod(F.substr(number, i, F.lit(1)).cast("int") - F.substr(number, i - 1, F.lit(1)).cast("int"), F.lit(10)))


def filler_reason(number: Column) -> Column:
    """Why six digits or more are filler: all equal, running up or down by one (9 and 0 joined), or a group of two or three that is all there is, three times or more; else null."""
    tail = F.concat(F.lit(" ("), number, F.lit("): número de relleno"))
    group = F.when(number.rlike("^([0-9]{2})\\1{2,}$"), F.left(number, F.lit(2))).when(number.rlike("^([0-9]{3})\\1{2,}$"), F.left(number, F.lit(3)))
    reason = (
        F.when(number.rlike("^([0-9])\\1+$"), F.concat(F.lit("Todos los dígitos son iguales"), tail))
        .when(F.forall(_steps(number), lambda s: s == 1), F.concat(F.lit("Secuencia ascendente de dígitos"), tail))
        .when(F.forall(_steps(number), lambda s: s == 9), F.concat(F.lit("Secuencia descendente de dígitos"), tail))
        .when(group.isNotNull(), F.concat(F.lit("Patrón '"), group, F.lit("' repetido"), tail))
    )
    return F.when(number.rlike("^[0-9]{6,}$"), reason)


def is_filler(number: Column) -> Column:
    return filler_reason(number).isNotNull()


def _first_look(column: str) -> tuple[Column, Column]:
    """(digits, reason) of a cell by what can be told without numbering plans: empty, placeholder, too short, filler; null where nothing speaks against it."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    number = F.regexp_replace(raw, "[^0-9]", "")
    return number, F.when(raw == "", EMPTY).when(letters_only(raw).isin(*NO_PHONE), NO_NUMBER).when(F.length(number) < 6, TOO_SHORT).otherwise(filler_reason(number))


def validated(rows: DataFrame, column: str, plan: DataFrame | None = None, country: str = "AR") -> DataFrame:
    """Adds VALIDO and MOTIVO, and with a numbering plan TELEFONO_NORMALIZADO, CODIGO_PAIS, PREFIJO, TELEFONO, TIPO_TELEFONO and TIPO_LINEA.

    Line types and area codes are a matter of numbering plans, which are an input (columns of ``PLAN``). Without one, a number that passes the first look
    gets the verdict for that case, and is not valid.
    """
    number, reason = _first_look(column)
    if plan is None:
        return rows.withColumn("MOTIVO", F.coalesce(reason, F.lit(NO_PLANS))).withColumn("VALIDO", F.lit(False))
    # Each distinct cell is looked at once, and written: few files hold many cells, and several steps read what comes of them.
    looked = rows.select(F.coalesce(F.col(column), F.lit("")).alias("_cell")).distinct()
    number, reason = _first_look("_cell")
    looked = settled(looked.withColumns({"_why": reason, "_call": dialled(F.col("_cell"))}), "_why", "_call")
    looked = stored(looked.withColumn("_call", F.when(F.col("_why").isNull(), F.col("_call"))), "cells")
    told = by_plan(looked.filter("_call IS NOT NULL").select("_call").distinct(), "_call", plan, country)
    told = looked.join(told, "_call", "left").drop("_call")
    joined = rows.withColumn("_cell", F.coalesce(F.col(column), F.lit(""))).join(told, "_cell").withColumns({"MOTIVO": F.coalesce("_why", "MOTIVO"), "VALIDO": F.coalesce("VALIDO", F.lit(False))})
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("CODIGO_PAIS", "PREFIJO", "TELEFONO", "TIPO_TELEFONO")}).drop("_cell", "_why")


def dialled(cell: Column) -> Column:
    """The digits of a cell, behind a plus sign if one stands first once the label words are out."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(cell, F.lit("")))), LABEL_PARTS, "")
    return F.concat(F.when(F.ltrim(text).startswith("+"), "+").otherwise(""), F.regexp_replace(text, "[^0-9]", ""))


def by_plan(calls: DataFrame, call: str, plan: DataFrame, country: str = "AR") -> DataFrame:
    """Distinct dialled numbers with what the plan says of them.

    Behind a plus (or 00) stands a country code, the longest that the plan has; other numbers are of the home country, as they stand or, if that is
    not valid, with its code in front. A trunk prefix is left out. The longest prefix of the plan that a number starts with decides, by an equi-join over the
    beginnings of the number: it is valid if its length fits, possible if some number of the country is as long.
    """
    home = COUNTRY_CODES[country]
    countries = plan.groupBy(F.col("CODIGO_PAIS").alias("code")).agg(F.max("TRONCAL").alias("trunk"), F.min("LARGO_MIN").alias("low"), F.max("LARGO_MAX").alias("high"), F.collect_set(F.length("PREFIJO")).alias("lengths"))
    digits = F.regexp_replace(F.col(call), r"^(\+|00)", "")
    way = lambda order, code, rest: F.struct(F.lit(order).alias("way"), code.alias("code"), rest.alias("rest"))
    abroad = F.array(*[way(3 - n, F.left(digits, F.lit(n)), F.substr(digits, F.lit(n + 1))) for n in (3, 2, 1)])
    within = F.array(way(0, F.lit(home), digits), way(1, F.lit(home), F.when(digits.startswith(home), F.substr(digits, F.lit(len(home) + 1)))))
    ways = calls.select(call, F.explode(F.when(F.col(call).rlike(r"^(\+|00)"), abroad).otherwise(within)).alias("w")).select(call, "w.*").filter("rest IS NOT NULL").join(countries, "code", "left")
    ways = ways.withColumn("code", F.when(F.col("lengths").isNotNull(), F.col("code")))
    ways = ways.withColumn("national", F.when((F.col("trunk") != "") & F.col("rest").startswith(F.col("trunk")), F.expr("substring(rest, length(trunk) + 1)")).otherwise(F.col("rest")))
    starts = ways.select(call, "way", F.struct("code", "national", "low", "high").alias("c"), F.explode_outer(F.expr("transform(filter(lengths, i -> i <= length(national)), i -> left(national, i))")).alias("start"))
    listed = plan.select(F.col("CODIGO_PAIS").alias("code"), F.col("PREFIJO").alias("start"), F.struct("LARGO_MIN", "LARGO_MAX", "TIPO_LINEA", "LARGO_AREA").alias("p"))
    hits = starts.withColumn("code", F.col("c.code")).join(listed, ["code", "start"], "left")
    seen = hits.groupBy(call, "way").agg(F.first("c").alias("c"), F.max_by("p", F.when(F.col("p").isNotNull(), F.struct(F.length("start"), F.col("p.LARGO_MAX"), F.col("p.LARGO_MIN")))).alias("p")).select(call, "way", "c.*", "p")
    seen = seen.withColumns({"fits": F.coalesce(F.length("national").between(F.col("p.LARGO_MIN"), F.col("p.LARGO_MAX")), F.lit(False)), "possible": F.length("national").between(F.col("low"), F.col("high"))})
    told = seen.groupBy(call).agg(F.min_by(F.struct("code", "national", "p", "fits", "possible"), F.struct(F.col("code").isNull(), ~F.col("fits"), "way")).alias("b")).select(call, "b.*")
    mobile = (F.col("code") == "54") & F.col("national").startswith("9")
    plain = F.when(mobile, F.expr("substring(national, 2)")).otherwise(F.col("national"))
    filler = filler_reason(F.col("national"))
    valid = F.coalesce(F.col("fits"), F.lit(False)) & filler.isNull()
    only = lambda c: F.when(valid, c)
    area = F.coalesce("p.LARGO_AREA", F.lit(0))
    reason = F.when(F.col("code").isNull(), NO_COUNTRY).when(~F.col("fits") & F.col("possible"), POSSIBLE).when(~F.col("fits"), WRONG_LENGTH).otherwise(F.coalesce(filler, F.lit(VALID)))
    kind = F.col("p.TIPO_LINEA")
    return told.select(
        call, valid.alias("VALIDO"), reason.alias("MOTIVO"), only(F.concat(F.lit("+"), F.col("code"), F.col("national"))).alias("TELEFONO_NORMALIZADO"), only(F.col("code")).alias("CODIGO_PAIS"),
        only(F.left(plain, area)).alias("PREFIJO"), only(F.substr(plain, area + 1)).alias("TELEFONO"), only(F.when(kind == "MOVIL", "C").when(kind == "FIJO", "F").otherwise("")).alias("TIPO_TELEFONO"), only(F.coalesce(kind, F.lit("DESCONOCIDO"))).alias("TIPO_LINEA"),
    )
