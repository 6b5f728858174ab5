"""The one-pass e-mail process: repair and verdict in one, with reasons, as the ``mails`` process reports them.

It differs from cleaning and then validating: placeholders and lost characters are judged before any repair, the user is judged before the
domain is repaired, and education and institutional domains pass as they are. Verdicts on domains are worked out once for
each distinct domain. Typos are not learned during a run, as that would make reasons depend on the order of rows; ``repaired_domains`` gives the pairs instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactdq.functions.text import letters_only
from contactdq.operators import mail_lists as L
from contactdq.operators.mails import _OWN, Lists, _ats, _respelled, _similar, _suffix, _unrepeated, _with_dot
from contactdq.session import stored
from contactdq.sources.publish import overwrite_touched, shortened

#: Further phrases for having no mail, which this process knows beside the common ones.
MORE_NO_MAIL = (
    "nocuentacon", "nocuentocon", "nocuenta", "nocuento", "nolotiene", "nolaposee", "noloposee", "nolorecuerda", "nosabe", "nodeclara", "nodeclarado", "nodenuncia", "nodenunciado",
    "noinforma", "noinformado", "nodisponible", "nodispone", "nobrinda", "nobrindo", "noaporta", "noaporto", "nofacilita", "nomanifiesta", "norefiere", "nocontesta", "noresponde",
    "noquiere", "noquiso", "nodesea", "seniega", "senego", "nocorreo", "sinemail", "sindatos", "sindato", "sininformacion", "novalido", "noaplica", "nada", "ninguno", "ninguna",
    "desconocido", "desconoce", "seignora", "ignora",
)
NO_MAIL = (*L.NO_MAIL, *MORE_NO_MAIL)


def domain_verdict(domain: str, lists: Lists) -> tuple[str, bool, bool, str, bool]:
    """(domain, valid, modified, reason, review) of one domain."""

    def no(reason: str) -> tuple:
        return domain, False, False, reason, False

    original, notes = domain, []
    if not domain or any(not (c.isascii() and c.isalnum() and c == c.lower() or c in ".-") for c in domain):
        return no(f"Dominio contiene caracteres inválidos: '{domain}'")
    if domain[0] in ".-" or domain[-1] in ".-":
        return no("Dominio empieza o termina con punto/guión")
    if ".." in domain:
        return no("Dominio contiene puntos consecutivos '..'")
    if "." not in domain:
        dotted = _with_dot(domain, lists)
        if dotted is None:
            return no("Dominio no contiene extensión (.TLD)")
        domain = dotted
        notes.append(f"Extensión reconstruida (faltaba el punto separador, dominio recuperado: '{domain}')")
    labels = domain.split(".")
    if any(not x or x[0] == "-" or x[-1] == "-" for x in labels):
        return original, False, False, "Segmento de dominio con guión mal ubicado", False
    if len(labels[-1]) > 20:
        return original, False, False, "La extensión final del dominio supera los 20 caracteres; requiere revisión manual", True
    if len(labels[-2]) > 20:
        return original, False, False, "Un segmento intermedio del dominio supera los 20 caracteres; requiere revisión manual", True
    single = domain if domain in lists.valid else _unrepeated(domain, lists)
    if single == domain and domain not in lists.valid and any(a == b == c for a, b, c in zip(domain, domain[1:], domain[2:])):
        return original, False, False, "Dominio contiene 3+ caracteres repetidos consecutivos sin corresponder a ningún dominio reconocible (relleno/typo no recuperable)", False
    if single != domain:
        domain = single
        notes.append(f"Caracteres repetidos colapsados por similitud a dominio conocido (-> '{domain}')")
    if "edu.ar" in domain or "edu.uy" in domain:
        return domain, True, False, "Dominio educativo (Válido)", False
    if any(x in domain for x in lists.institutions):
        return domain, True, False, "Dominio institucional especial (Válido)", False
    if domain in lists.invalid:
        return original, False, False, f"Dominio en lista negra: '{domain}'", False
    if any(x in domain for x in ("noposee", "notiene", "correo", "ntiene")):
        return original, False, False, "Dominio corresponde a palabra clave inválida", False
    if domain in lists.typos:
        notes = [f"Corrección de typo en dominio ({domain} -> {lists.typos[domain]})"]
        domain = lists.typos[domain]
    elif (fixed := _suffix(domain, lists)) != domain:
        notes = [f"Corrección automática de sufijo ({domain} -> {fixed})"]
        domain = fixed
    elif not notes and domain not in lists.valid and (near := _similar(domain, lists)) != domain:
        notes = [f"Aprendizaje automático: typo detectado por similitud ({domain} -> {near})"]
        domain = near
    head, _, tld = domain.rpartition(".")
    if tld not in lists.final_tlds:
        meant = lists.tld_typos.get(tld)
        if meant not in lists.final_tlds:
            return domain, False, bool(notes), f"TLD final no válido: '.{tld}'", False
        notes.append(f"Corrección de typo en extensión ('.{tld}' -> '.{meant}')")
        domain = f"{head}.{meant}"
    return domain, True, bool(notes), "; ".join(notes) or "Email válido", False


def repaired_domains(rows: DataFrame, column: str, lists: Lists = Lists()) -> DataFrame:
    """Distinct domains of the texts with their verdicts."""
    step, _ = _respelled(rows, column, lists)
    return _verdicts(step, lists)


def _verdicts(step: DataFrame, lists: Lists) -> DataFrame:
    @F.pandas_udf("v_domain string, v_valid boolean, v_modified boolean, v_reason string, v_review boolean")
    def judge(d: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([domain_verdict(x, lists) for x in d], columns=["v_domain", "v_valid", "v_modified", "v_reason", "v_review"])

    return step.select("cut").filter("cut IS NOT NULL").distinct().withColumn("_v", judge("cut")).select("cut", "_v.*")


def processed(rows: DataFrame, column: str, lists: Lists = Lists()) -> DataFrame:
    """Adds MAIL_DEPURADO (null unless kept), ESTADO (CONSERVADO, MODIFICADO, BAJA, REVISION MANUAL), VALIDO (0, 1) and MOTIVO."""
    step, notes = _respelled(rows, column, lists)
    step = step.join(_verdicts(step, lists), "cut", "left")
    raw = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(column), F.lit("")))), "^mailto:", "")
    text = F.when(F.col("_one"), F.concat("_u4", F.lit("@"), "cut")).otherwise(F.col("_t7"))
    u, d = F.col("_u4"), F.col("cut")
    runs = F.transform(F.regexp_extract_all(u, F.lit("[a-zñ]+"), F.lit(0)), lambda x: F.length(x))
    longest, letters = F.coalesce(F.array_max(runs), F.lit(0)), F.aggregate(runs, F.lit(0), lambda a, x: a + x)
    plain = letters_only(u)
    early = [
        (F.coalesce(F.col(column), F.lit("")) == "", False, F.lit("Correo vacío o nulo")),
        (letters_only(raw).isin(*NO_MAIL), False, F.lit("Texto corresponde a 'no posee email' (no es un correo)")),
        (raw.contains("?"), True, F.lit("Contiene '?' en lugar de un carácter perdido por un problema de codificación anterior a esta tabla (no recuperable con certeza); requiere revisión manual")),
    ]
    late = [
        (F.length(text) > 200, True, F.lit("Supera la longitud máxima razonable (200 caracteres); requiere revisión manual")),
        (_ats(text) != 1, False, F.lit("Formato incorrecto (falta o excede el número de @)")),
        (F.length(d) > 200, True, F.lit("El dominio supera la longitud máxima razonable (200 caracteres); requiere revisión manual")),
        (~u.rlike("^[a-zA-ZñÑ0-9._+-]+$"), False, F.concat(F.lit("Usuario contiene caracteres inválidos: '"), u, F.lit("'"))),
        (u.startswith(".") | u.endswith("."), False, F.lit("Usuario empieza o termina con punto")),
        (u.contains(".."), False, F.lit("Usuario contiene puntos consecutivos '..'")),
        (u.rlike("^[0-9]+$"), False, F.concat(F.lit("Usuario puramente numérico: '"), u, F.lit("'"))),
        (u.rlike("[0-9]") & (longest < 5) & (letters < 6), False, F.concat(F.lit("Usuario con patrón de ID/teléfono (racha de letras máxima="), longest, F.lit(", total letras="), letters, F.lit("): '"), u, F.lit("'"))),
        (u.isin(*lists.users), False, F.concat(F.lit("Usuario en lista negra de exclusión: '"), u, F.lit("'"))),
        (plain.isin(*NO_MAIL) | F.regexp_replace(plain, "(correo|email|mail)$", "").isin(*NO_MAIL), False, F.lit("Usuario corresponde a un patrón de 'no posee email'")),
    ]
    review, reason, valid, modified = F.col("v_review"), F.col("v_reason"), F.col("v_valid"), F.col("v_modified")
    for test, asks, why in reversed(late):
        review, reason, valid, modified = (F.when(test, F.lit(asks)).otherwise(review), F.when(test, why).otherwise(reason), F.when(test, False).otherwise(valid), F.when(test, False).otherwise(modified))
    said = F.array_join(F.array_compact(F.array(*notes[1:])), "; ")
    reason = F.when(said != "", F.concat(F.lit("Normalización lingüística aplicada ("), said, F.lit("); "), reason)).otherwise(reason)
    modified = modified | (said != "")
    for test, asks, why in reversed(early):
        review, reason, valid, modified = (F.when(test, F.lit(asks)).otherwise(review), F.when(test, why).otherwise(reason), F.when(test, False).otherwise(valid), F.when(test, False).otherwise(modified))
    step = step.withColumns({"_review": F.coalesce(review, F.lit(False)), "MOTIVO": reason, "_valid": F.coalesce(valid, F.lit(False)), "_modified": F.coalesce(modified, F.lit(False))})
    kept = F.col("_valid") & ~F.col("_review")
    state = F.when(F.col("_review"), "REVISION MANUAL").when(~F.col("_valid"), "BAJA").when(F.col("_modified"), "MODIFICADO").otherwise("CONSERVADO")
    step = step.withColumns({"ESTADO": state, "VALIDO": kept.cast("int"), "MAIL_DEPURADO": F.when(kept, F.concat("_u4", F.lit("@"), "v_domain"))})
    return step.drop(*_OWN, "v_domain", "v_valid", "v_modified", "v_reason", "v_review", "_review", "_valid", "_modified")


def linguistic_log(rows: DataFrame, column: str, lists: Lists = Lists()) -> DataFrame:
    """MAIL_ORIGINAL, MAIL_NORMALIZADO and DETALLE of the texts that were recovered by reading them as speech or misspelling; each distinct text once."""
    step, notes = _respelled(rows, column, lists)
    said = F.array_join(F.array_compact(F.array(*notes[1:])), "; ")
    text = F.when(F.col("_one"), F.concat("_u4", F.lit("@"), "cut")).otherwise(F.col("_t7"))
    return step.select(F.col(column).alias("MAIL_ORIGINAL"), text.alias("MAIL_NORMALIZADO"), said.alias("DETALLE")).filter("DETALLE <> ''").distinct()


#: What stands in the columns of a row that the job touched.
LOW_REASON, REVIEW_MARK = "no pasa validacion", "REVISION MANUAL"


def changes(table: DataFrame, key: str, mail: str, at, user: str, lists: Lists = Lists(), widest: int = 100) -> DataFrame:
    """The rows of a table of mails that its cleaning would change, as they will be, with ``_before`` and ``_after`` (JSON) and ``_kind`` (BAJA, MOD or REVISION) beside them.

    Only rows without FECHA_BAJA are looked at. A bad mail is marked as low, a repaired one replaced, one for review marked; a row that already says so is no change, so a second run finds nothing.
    The columns of audit are those of ``plans.schemas.AUDIT_COLUMNS``.
    """
    judged = processed(table.filter("FECHA_BAJA IS NULL"), mail, lists) if mail != "MAIL_DEPURADO" else None
    if judged is None:
        raise ValueError("the column of mails may not be named MAIL_DEPURADO")
    low, changed, ask = (F.col("ESTADO") == s for s in ("BAJA", "MODIFICADO", "REVISION MANUAL"))
    spoken = F.col("MOTIVO").startswith("Normalización lingüística").cast("tinyint")
    new = {
        mail: F.when(changed, F.col("MAIL_DEPURADO")).otherwise(F.col(f"`{mail}`")),
        "FECHA_BAJA": F.when(low, F.lit(at)),
        "USUARIO_BAJA": F.when(low, F.lit(user)).otherwise(F.col("USUARIO_BAJA")),
        "MOTIVO_BAJA": F.when(low, F.lit(LOW_REASON)).otherwise(F.col("MOTIVO_BAJA")),
        "FECHA_MOD": F.when(changed | ask, F.lit(at)).otherwise(F.col("FECHA_MOD")),
        "USUARIO_MOD": F.when(changed, F.lit(user)).otherwise(F.col("USUARIO_MOD")),
        "MOTIVO_MOD": F.when(ask, F.lit(REVIEW_MARK)).when(changed, shortened(F.col("MOTIVO"), widest)).otherwise(F.col("MOTIVO_MOD")),
        "NORMALIZADO_LINGUISTICO": F.when(low | changed, spoken).otherwise(F.col("NORMALIZADO_LINGUISTICO")),
    }
    kinds = {c: table.schema[c].dataType for c in new}
    due = judged.filter(low | changed | (ask & ~F.col("MOTIVO_MOD").eqNullSafe(F.lit(REVIEW_MARK))))
    # The row as it is stands beside the row as it will be, so neither is worked out twice.
    kept = due.select(*[F.col(f"`{c}`").alias(c) if c not in new else new[c].cast(kinds[c]).alias(c) for c in table.columns], F.col(f"`{mail}`").alias("_old"), F.when(low, "BAJA").when(ask, "REVISION").otherwise("MOD").alias("_kind"), F.col("MOTIVO").alias("_why"))
    before, after = F.struct(F.col("_old").alias("mail")), F.struct(F.col(f"`{mail}`").alias("mail"), F.when(F.col("_kind") == "MOD", "MODIFICADO").when(F.col("_kind") == "BAJA", "BAJA").otherwise("REVISION_MANUAL").alias("estado"), F.col("_why").alias("motivo_detalle"))
    return kept.select(*table.columns, F.to_json(before, {"ignoreNullFields": "false"}).alias("_before"), F.to_json(after, {"ignoreNullFields": "false"}).alias("_after"), "_kind")


def clean_in_place(spark: SparkSession, path: str, partition: str, key: str, mail: str, audit_path: str, at, user: str, name: str, lists: Lists = Lists()) -> dict[str, int]:
    """Clean a table of mails (files at ``path``, partitioned by a column) where it stands; how many rows were changed, by kind, and how many partitions written.

    The changes are worked out once and stored; audit rows and new rows come from there. Only partitions with a change are written. The audit rows of a run stand under its
    time, so a run that is repeated after a failure writes the same rows again and none twice; a run that finds nothing to do changes nothing.
    """
    table = spark.read.parquet(path)
    due = stored(changes(table, key, mail, at, user, lists), "changes")
    counts = {r["_kind"]: r["count"] for r in due.groupBy("_kind").count().collect()}
    if not counts:
        return {"particiones": 0}
    rows = due.select(F.lit(at).alias("FECHA"), F.lit(name).alias("TABLA"), F.col("_kind").alias("OPERACION"), F.col(key).cast("string").alias("ID_REGISTRO"), F.col("_before").alias("DATOS_ANTES"), F.col("_after").alias("DATOS_DESPUES"), F.lit(user).alias("USUARIO_BD"))
    rows.withColumn("CORRIDA", F.date_format("FECHA", "yyyyMMddHHmmss")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("CORRIDA").parquet(audit_path)
    return counts | {"particiones": overwrite_touched(table, due.drop("_before", "_after", "_kind"), path, partition, key)}
