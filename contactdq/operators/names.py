"""Comparison and classification of person and company names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.functions.similarity import dice, edit_figures, jaccard, jaro_winkler, jaro_winkler_of, overlap
from contactdq.functions.text import compared_name, name_key, name_tokens, percent_name, sorted_key, words

METRICS = ("R_JARO_WINKLER", "R_LEVENSHTEIN", "R_DAMERAU", "R_OVERLAP", "R_DICE", "R_JACCARD")

#: Fixed thresholds of the diagnosis, in percent.
HIGH, MEDIUM, LOW, SWAP = 85, 60, 40, 1.0

#: Acronyms and words of company forms.
COMPANY_FORMS = ("SA", "SRL", "SAS", "SC", "SCA", "SH", "LTDA", "CIA", "SOCIEDAD", "ANONIMA", "RESPONSABILIDAD", "LIMITADA")

#: Words that point to a company or shop.
COMPANY_HINTS = (
    "SA", "SRL", "SAS", "SCA", "LTDA", "SC", "COOP", "COOPERATIVA", "TALLER", "BARRACA", "CENTRO", "CLUB", "SHOP", "STORE", "DISTRIBUCIONES",
    "IMPRESIONES", "PIZZERIA", "MILANESERIA", "CARNICERIA", "PANADERIA", "FLORERIA", "AUTOMOVILES", "AUTOMOTORES", "PROPIEDADES", "INMOBILIARIA",
    "ESTETICA", "PELUQUERIA", "FOTOGRAFIA", "CONTENIDOS", "EMPRESA", "ESTUDIO", "CONSULTORA", "SERVICIOS", "COMERCIAL", "MERCADO",
    "FARMACIA", "FERRETERIA", "RESTAURANTE", "BAR", "HOTEL", "GIMNASIO", "ENCUENTRO", "OFICIAL", "CATERING", "CONSTRUCCIONES",
)

#: What separates a name from a trade, in order of trial.
ROLE_SEPARATORS = ("|", "·", "•", "—", "–")


def _both_empty(a: Column, b: Column, both: float, value: Column) -> Column:
    return F.when((a == "") & (b == ""), F.lit(both)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(value)


def once(rows: DataFrame, keys: list[str], figures: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``figures`` adds to their keys, worked out once for each distinct combination of keys, none of which is null."""
    told = figures(rows.select(*keys).distinct())
    return rows.join(told, keys)


def six_metrics(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with NORM_1, NORM_2, the six similarities in percent, their mean, extremes and spread, MOTIVO and DETALLE.

    Figures depend on the two normalised names alone: each distinct pair of them is compared once.
    """
    return once(pairs.withColumns({"NORM_1": compared_name(F.col(left)), "NORM_2": compared_name(F.col(right))}), ["NORM_1", "NORM_2"], _six_figures)


def _six_figures(keyed: DataFrame) -> DataFrame:
    a, b = F.col("NORM_1"), F.col("NORM_2")
    longest = F.greatest(F.length(a), F.length(b))
    ta, tb = F.array_distinct(words(a)), F.array_distinct(words(b))
    scored = keyed.withColumn("_e", edit_figures("NORM_1", "NORM_2")).withColumns(
        {
            "R_JARO_WINKLER": _both_empty(a, b, 0.0, F.col("_e.jaro_winkler") * 100),
            "R_LEVENSHTEIN": _both_empty(a, b, 100.0, (1 - F.levenshtein(a, b) / longest) * 100),
            "R_DAMERAU": _both_empty(a, b, 100.0, (1 - F.col("_e.damerau") / longest) * 100),
            "R_OVERLAP": overlap(ta, tb) * 100,
            "R_DICE": dice(ta, tb, 1.0) * 100,
            "R_JACCARD": jaccard(ta, tb, 1.0) * 100,
        }
    ).drop("_e").withColumns({m: F.round(m, 2) for m in METRICS})
    values = [F.col(m) for m in METRICS]
    total = values[0]
    for v in values[1:]:
        total = total + v
    summed = scored.withColumns({"R_PROMEDIO": F.floor((F.round(total * 100) + 3) / 6) / 100, "R_MAXIMO": F.greatest(*values), "R_MINIMO": F.least(*values)})
    return diagnosed(summed.withColumn("R_DISPERSION", F.round(F.col("R_MAXIMO") - F.col("R_MINIMO"), 2)))


def diagnosed(scored: DataFrame) -> DataFrame:
    """Adds MOTIVO and DETALLE: what kind of difference the six figures show. The first rule that fits decides."""
    a, b = F.col("NORM_1"), F.col("NORM_2")
    jw, lev, dam, ovl, dic, jac = (F.col(m) for m in METRICS)
    wa, wb = words(a), words(b)
    only_a, only_b = F.filter(wa, lambda x: ~F.array_contains(wb, x)), F.filter(wb, lambda x: ~F.array_contains(wa, x))
    close = F.greatest(jw, dam) >= HIGH
    common = F.array_distinct(F.array_intersect(wa, wb))
    moved = (F.size(common) >= 2) & (F.filter(wa, lambda x: F.array_contains(common, x)) != F.filter(wb, lambda x: F.array_contains(common, x)))
    spelled = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    swapped = F.flatten(
        F.transform(
            only_a,
            lambda x: F.transform(F.filter(only_b, lambda y: (F.length(x) == F.length(y)) & (x != y) & (spelled(x) == spelled(y))), lambda y: F.concat(F.lit("Letras intercambiadas: "), x, F.lit(" / "), y)),
        )
    )
    swap_detail = F.coalesce(F.get(swapped, 0), F.lit("Letras contiguas intercambiadas"))
    typo_detail = F.when((F.size(only_a) > 0) & (F.size(only_b) > 0), F.concat(F.lit("Difieren: "), F.get(only_a, 0), F.lit(" / "), F.get(only_b, 0))).otherwise("")
    extra = F.when(F.size(F.array_distinct(wb)) > F.size(F.array_distinct(wa)), F.array_except(wb, wa)).otherwise(F.array_except(wa, wb))
    spread = F.col("R_MAXIMO") - F.col("R_MINIMO")
    whole = lambda c: F.format_string("%.0f", c)
    rules = [
        ((a == "") | (b == ""), "DATO VACIO", F.lit("Una de las dos denominaciones está vacía")),
        (a == b, "COINCIDENCIA EXACTA", F.lit("")),
        (dam - lev >= SWAP, "TRANSPOSICION DE LETRAS", swap_detail),
        ((ovl == 0) & close, "TEXTO SIN SEPARAR", F.lit("Las palabras coinciden pero falta la separación")),
        ((ovl >= 99) & (jac >= 99) & (lev < MEDIUM), "MISMAS PALABRAS EN OTRO ORDEN", F.lit("Mismas palabras, distinto orden")),
        ((ovl >= 99) & (jac >= 99), "COINCIDENCIA EXACTA", F.lit("Mismas palabras en el mismo orden")),
        (ovl >= 99, "UN LADO TIENE NOMBRES DE MAS", F.concat(F.lit("Nombres presentes en un solo lado: "), F.array_join(F.slice(F.array_sort(extra), 1, 4), ", "))),
        (close & (jac < 99) & moved, "MISMAS PALABRAS EN OTRO ORDEN, CON TIPEO", F.lit("Palabras en distinto orden y con diferencias de tipeo")),
        (close & (jac < 99), "ERROR DE TIPEO", typo_detail),
        ((F.greatest(lev, dam) < LOW) & (ovl == 0), "SIN RELACION", F.lit("")),
        (spread >= 50, "ALGORITMOS EN DESACUERDO", F.concat(F.lit("Los algoritmos van de "), whole(F.col("R_MINIMO")), F.lit("% a "), whole(F.col("R_MAXIMO")), F.lit("%: requiere revisión"))),
    ]
    reason, detail = F.lit("COINCIDENCIA PARCIAL"), F.lit("")
    for test, name, text in reversed(rules):
        reason, detail = F.when(test, F.lit(name)).otherwise(reason), F.when(test, text).otherwise(detail)
    return scored.withColumns({"MOTIVO": reason, "DETALLE": detail})


def reason_histogram(compared: DataFrame) -> DataFrame:
    """Rows and mean spread for each reason."""
    return compared.groupBy("MOTIVO").agg(F.count("*").alias("CANTIDAD"), F.round(F.avg("R_DISPERSION"), 2).alias("DISPERSION_MEDIA"))


def _percent(a: str, b: str, least: float) -> tuple[float, str]:
    """Words of the shorter name, in order, each take the closest free word of the longer one."""
    if not a and not b:
        return 0.0, "AMBAS DENOMINACIONES VACIAS"
    if not a or not b:
        return 0.0, "DENOMINACION VACIA"
    if a == b:
        return 100.0, "DENOMINACION EXACTA"
    short, long = sorted((a.split(), b.split()), key=len)
    free, total, typos, matched = list(long), 0.0, 0, 0
    for word in short:
        scores = [jaro_winkler_of(word, x) for x in free]
        best = max(range(len(scores)), key=scores.__getitem__, default=None)
        if best is not None and scores[best] >= 0.90:
            matched, total, typos = matched + 1, total + scores[best], typos + (scores[best] < 1)
            free.pop(best)
    percent = round(max(200 * total / (len(short) + len(long)), 100 * jaro_winkler_of(a.replace(" ", ""), b.replace(" ", ""))), 2)
    if matched == len(short):
        if not free:
            return percent, "COINCIDENTE CON DIFERENCIAS DE TIPEO" if typos else "COINCIDENTE: MISMOS NOMBRES EN OTRO ORDEN"
        extra = " ".join(free[:4])
        if set(free) <= set(COMPANY_FORMS):
            return percent, f"COINCIDENTE: DIFIERE SOLO EN SIGLA SOCIETARIA ({extra})"
        return percent, f"COINCIDE CON NOMBRE ADICIONAL EN UNA ({extra}){' (typos)' if typos else ''}"
    if percent >= least:
        return percent, f"NOMBRES COINCIDENTES (>= {least:g}%)"
    return percent, f"COINCIDENCIA PARCIAL ({matched} de {len(short)} nombres coinciden)" if matched else "SIN COINCIDENCIA"


def name_percentage(left: Column, right: Column, least: float = 80.0) -> Column:
    """A struct ``percent, analysis`` of two names; compare ``percent`` with the threshold, held between 0 and 100, for the verdict."""
    return _percentage(percent_name(left), percent_name(right), least)


def _percentage(left: Column, right: Column, least: float) -> Column:
    least = min(100.0, max(0.0, float(least)))

    @F.pandas_udf("percent double, analysis string")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = {p: _percent(*p, least) for p in set(zip(a, b))}
        return pd.DataFrame([known[p] for p in zip(a, b)], columns=["percent", "analysis"])

    return scored(left, right)


def compared_denominations(pairs: DataFrame, left: str, right: str, least: float = 80.0) -> DataFrame:
    """PORCENTAJE, UMBRAL, COINCIDE and ANALISIS beside the pair. The threshold is held between 0 and 100; two empty names or one never coincide. Each distinct pair of names is compared once."""
    least = min(100.0, max(0.0, float(least)))
    keyed = pairs.withColumns({"_nx": percent_name(F.col(left)), "_ny": percent_name(F.col(right))})
    return (
        once(keyed, ["_nx", "_ny"], lambda keys: keys.withColumn("_s", _percentage(F.col("_nx"), F.col("_ny"), least)))
        .withColumns({"PORCENTAJE": F.col("_s.percent"), "UMBRAL": F.lit(float(least)), "COINCIDE": ((F.col("_s.percent") >= least) & ~F.col("_s.analysis").isin("AMBAS DENOMINACIONES VACIAS", "DENOMINACION VACIA")).cast("int"), "ANALISIS": F.col("_s.analysis")})
        .drop("_s", "_nx", "_ny")
    )


SURE, DOUBTFUL, FAMILY_GAP, ORDER_GAIN = 0.92, 0.80, 0.25, 0.10


def cross_scores(pairs: DataFrame, left_key: str, right_key: str, left_name: str | None = None, right_name: str | None = None) -> DataFrame:
    """Adds the cross-match figures of two keys: JARO_WINKLER(_ORD), LEVENSHTEIN, DAMERAU, OVERLAP, DICE, JACCARD, MOTIVO, COINCIDE.

    The verdict takes the better of edit and set similarity; a wide gap between the two turns a yes into a review.
    """
    a, b = F.col(left_key), F.col(right_key)
    usable = (a != "") & (b != "")
    named = F.col(left_name).eqNullSafe(F.col(right_name)) if left_name and right_name else F.lit(False)
    step = pairs.withColumns({"_oa": sorted_key(a), "_ob": sorted_key(b), "_ta": name_tokens(a), "_tb": name_tokens(b)})
    step = step.withColumns(
        {
            "_e": edit_figures(left_key, right_key),
            "_jwo": jaro_winkler("_oa", "_ob"),
            "LEVENSHTEIN": F.when(usable, F.levenshtein(a, b)),
            "_ov": overlap(F.col("_ta"), F.col("_tb")),
            "_di": dice(F.col("_ta"), F.col("_tb")),
            "_ja": jaccard(F.col("_ta"), F.col("_tb")),
        }
    )
    step = step.withColumn("DAMERAU", F.when(usable, F.col("_e.damerau")))
    jw, jwo, ov, di, ja = (F.when(usable, F.col(c)).otherwise(0.0) for c in ("_e.jaro_winkler", "_jwo", "_ov", "_di", "_ja"))
    shared, apart = F.size(F.array_intersect("_ta", "_tb")), F.size(F.array_except("_ta", "_tb")) + F.size(F.array_except("_tb", "_ta"))
    best, gap = F.greatest(jwo, di), jwo - di
    wide = F.abs(gap) >= FAMILY_GAP
    fixed = lambda n, c: F.format_string(f"%.{n}f", c)
    other = ~(a == b) & (F.col("_oa") != F.col("_ob"))
    tags = F.array(
        F.when(a == b, F.when(named, "IDENTICO").otherwise("IDENTICO_NORMALIZADO")).when(F.col("_oa") == F.col("_ob"), "ORDEN_DE_TOKENS_INVERTIDO"),
        F.when(other & (F.col("DAMERAU") < F.col("LEVENSHTEIN")), F.concat(F.lit("TRANSPOSICION_DE_CARACTERES("), F.col("LEVENSHTEIN") - F.col("DAMERAU"), F.lit(")"))),
        F.when(other & (ov >= 0.999) & (ja < 0.999), F.concat(F.lit("SUBCONJUNTO_TOKENS(sobran="), apart, F.lit(")"))),
        F.when(other & (jwo - jw >= ORDER_GAIN), "MEJORA_AL_ORDENAR_TOKENS"),
        F.when(other & (shared == 0), "SIN_TOKENS_EN_COMUN"),
        F.when((best < SURE) & (best >= DOUBTFUL), F.concat(F.lit("ZONA_GRIS(score="), fixed(4, best), F.lit(")"))),
        F.when(wide, F.concat(F.lit("DESACUERDO_ENTRE_FAMILIAS("), F.when(gap > 0, "EDICION_SOBRE_CONJUNTOS").otherwise("CONJUNTOS_SOBRE_EDICION"), F.lit(", jw_ord="), fixed(3, jwo), F.lit(", dice="), fixed(3, di), F.lit(")"))),
    )
    verdict = F.when(best >= SURE, F.when(wide, "RE").otherwise("SI")).when(best >= DOUBTFUL, "RE").otherwise("NO")
    done = step.withColumns(
        {
            "JARO_WINKLER": F.round(jw, 6),
            "JARO_WINKLER_ORD": F.round(jwo, 6),
            "OVERLAP": F.round(ov, 6),
            "DICE": F.round(di, 6),
            "JACCARD": F.round(ja, 6),
            "MOTIVO": F.when(usable, F.left(F.array_join(F.filter(tags, lambda x: x.isNotNull()), "; "), F.lit(200))).otherwise("UNO_DE_LOS_DOS_VACIO"),
            "COINCIDE": F.when(usable, verdict).otherwise("NO"),
        }
    )
    return done.drop("_oa", "_ob", "_ta", "_tb", "_e", "_jwo", "_ov", "_di", "_ja")


def first_segment(text: Column) -> Column:
    """What stands before the first separator, by the order of the list, that occurs; trimmed."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    out = raw
    for sep in reversed(ROLE_SEPARATORS):
        out = F.when(raw.contains(sep), F.trim(F.substring_index(raw, sep, 1))).otherwise(out)
    return out


def classified(names: DataFrame, column: str) -> DataFrame:
    """Adds DENOMINACION, CLAVE, CLAVE_ORDENADA, TOKENS, TIPO (F person, J company, RUIDO neither) and MOTIVO_NORM."""
    step = names.withColumn("DENOMINACION", first_segment(F.col(column))).withColumn("CLAVE", name_key(F.col("DENOMINACION")))
    step = step.withColumns({"CLAVE_ORDENADA": sorted_key(F.col("CLAVE")), "TOKENS": name_tokens(F.col("CLAVE"))})
    raw, key = F.col("DENOMINACION"), F.col("CLAVE")
    letters = F.length(F.regexp_replace(raw, "[^\\p{L}\\p{N}]", ""))
    kept = F.length(F.regexp_replace(key, "[^A-Z0-9]", ""))
    ruined = (letters >= 4) & (kept < F.greatest(F.lit(3.0), letters * 0.5))
    user = ~raw.contains(" ") & (raw.contains("_") | raw.contains(".")) & (F.lower(raw) == raw) & raw.rlike("\\p{Ll}")
    hints = F.array_sort(F.array_intersect("TOKENS", F.array(*map(F.lit, COMPANY_HINTS))))
    rules = [
        (raw == "", "RUIDO", F.lit("DENOMINACION_VACIA")),
        (raw.rlike("(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$"), "RUIDO", F.lit("CAMPO_NOMBRE_CONTIENE_EMAIL")),
        (ruined, "RUIDO", F.lit("NOMBRE_NO_NORMALIZABLE_A_ASCII")),
        (user, "RUIDO", F.lit("CAMPO_NOMBRE_CONTIENE_USERNAME")),
        (F.size(hints) > 0, "J", F.concat(F.lit("INDICIO_JURIDICA("), F.get(hints, 0), F.lit(")"))),
        (F.size("TOKENS") <= 1, "RUIDO", F.lit("DENOMINACION_DE_UN_SOLO_TOKEN_NO_RESOLUBLE")),
    ]
    kind, why = F.lit("F"), F.lit("")
    for test, name, text in reversed(rules):
        kind, why = F.when(test, F.lit(name)).otherwise(kind), F.when(test, text).otherwise(why)
    return step.withColumns({"TIPO": kind, "MOTIVO_NORM": why})


def duplicate_keys(names: DataFrame, key: str = "CLAVE") -> DataFrame:
    """Keys that more than one row has."""
    return names.filter(F.col(key) != "").groupBy(key).agg(F.count("*").alias("CANTIDAD")).filter("CANTIDAD > 1")


def class_histogram(names: DataFrame) -> DataFrame:
    """Rows for each type and reason."""
    return names.groupBy("TIPO", "MOTIVO_NORM").agg(F.count("*").alias("CANTIDAD"))


def with_fallback(rows: DataFrame, column: str, others: list[str], value: str = "_VALOR") -> DataFrame:
    """The first of the columns that is neither null nor blank, and COLUMNA_USADA, its name; the first column's if all are blank."""
    out, used = F.col(column), F.lit(column)
    for name in reversed([column, *others]):
        some = F.trim(F.coalesce(F.col(name), F.lit(""))) != ""
        out, used = F.when(some, F.col(name)).otherwise(out), F.when(some, F.lit(name)).otherwise(used)
    return rows.withColumns({value: out, "COLUMNA_USADA": used})
