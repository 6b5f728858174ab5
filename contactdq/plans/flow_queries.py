"""Named queries over whole flows: phones by a numbering plan, previews, mails in three stages, the second opinion, changes of a table of mails."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from contactdq.operators import mail_agent, mail_features, mails, phones, profile
from contactdq.plans.queries import _MAIL_SQL, MAILS, made, query
from contactdq.plans.schemas import with_audit_columns
from contactdq.session import table

# Phones --------------------------------------------------------------------------------------------------------------

# A plan of two countries: areas of two digits, some of them split into areas of three, with mobiles behind a 9; in the other country the first digit tells.
PLAN = """SELECT '54' AS "CODIGO_PAIS", cast(11 + n_nationkey AS STRING) AS "PREFIJO", 10 AS "LARGO_MIN", 10 AS "LARGO_MAX", 'FIJO' AS "TIPO_LINEA", 2 AS "LARGO_AREA", '0' AS "TRONCAL" FROM nation
 UNION ALL SELECT '54', '9' || cast(11 + n_nationkey AS STRING), 11, 11, 'MOVIL', 2, '0' FROM nation UNION ALL SELECT '54', '22' || cast(r_regionkey AS STRING), 10, 11, 'FIJO', 3, '0' FROM region
 UNION ALL SELECT '598', cast(r_regionkey + 1 AS STRING), 8, 8, CASE r_regionkey WHEN 1 THEN 'FIJO' WHEN 2 THEN 'MOVIL' END, r_regionkey % 2, '0' FROM region"""
_N = "lpad(cast((c_custkey * 7919) % 100000000 AS STRING), 8, '4')"
DIALLED = f"""SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'Cel.: (0' || cast(11 + c_custkey % 30 AS STRING) || ') ' || {_N} WHEN 1 THEN '+54 9 ' || cast(11 + c_custkey % 40 AS STRING) || ' ' || {_N} WHEN 2 THEN 'miTel:+598 ' || cast(c_custkey % 9 AS STRING) || substr({_N}, 2)
 WHEN 3 THEN '0054 22' || cast(c_custkey % 10 AS STRING) || substr({_N}, 2) WHEN 4 THEN '54' || cast(11 + c_custkey % 25 AS STRING) || {_N} WHEN 5 THEN '+999 ' || {_N} WHEN 6 THEN '+598 ' || repeat(cast(1 + c_custkey % 5 AS STRING), 8) WHEN 7 THEN cast(11 + c_custkey % 25 AS STRING) || {_N} || cast(c_custkey % 1000 AS STRING)
 WHEN 8 THEN 'no tiene' WHEN 9 THEN '' WHEN 10 THEN '22' || cast(c_custkey % 7 AS STRING) || {_N} ELSE 'tel 12-' || cast(c_custkey % 1000 AS STRING) END AS tel FROM customer"""

# The same in SQL: each number in the ways that it can be read, the longest prefix of each, the first way that is valid or else the first.
_PLAN_SQL = f"""WITH p AS ({PLAN}), k AS (SELECT "CODIGO_PAIS" AS code, max("TRONCAL") AS trunk, min("LARGO_MIN") AS low, max("LARGO_MAX") AS high FROM p GROUP BY 1),
 c AS (SELECT id, tel, regexp_replace(lower(trim(tel)), '(cel|tel|celular|telefono|teléfono|fijo|movil|móvil|wsp|whatsapp)\\s*[.:]?', '', 'g') AS t, regexp_replace(tel, '[^0-9]', '', 'g') AS d FROM ({DIALLED}) s),
 e AS (SELECT *, starts_with(ltrim(t), '+') OR starts_with(d, '00') AS far, CASE WHEN starts_with(ltrim(t), '+') THEN d ELSE regexp_replace(d, '^00', '') END AS n,
  CASE WHEN trim(tel) = '' THEN '{phones.EMPTY}' WHEN regexp_replace(lower(tel), '[^a-z]', '', 'g') = 'notiene' THEN '{phones.NO_NUMBER.replace("'", "''")}' WHEN length(d) < 6 THEN '{phones.TOO_SHORT}' END AS why FROM c),
 w AS (SELECT id, 3 - i AS way, left(n, i) AS code, substr(n, i + 1) AS rest FROM e, (VALUES (1), (2), (3)) v(i) WHERE far AND why IS NULL UNION ALL SELECT id, 0, '54', d FROM e WHERE NOT far AND why IS NULL
  UNION ALL SELECT id, 1, '54', substr(d, 3) FROM e WHERE NOT far AND why IS NULL AND starts_with(d, '54')),
 x AS (SELECT id, way, code, low, high, CASE WHEN trunk <> '' AND starts_with(rest, trunk) THEN substr(rest, length(trunk) + 1) ELSE rest END AS nat FROM w JOIN k USING (code)),
 y AS (SELECT x.*, l.pre, l.lo, l.hi, l.kind, l.area FROM x LEFT JOIN LATERAL (SELECT "PREFIJO" AS pre, "LARGO_MIN" AS lo, "LARGO_MAX" AS hi, "TIPO_LINEA" AS kind, "LARGO_AREA" AS area FROM p WHERE p."CODIGO_PAIS" = x.code AND starts_with(x.nat, p."PREFIJO") ORDER BY length("PREFIJO") DESC LIMIT 1) l ON true),
 z AS (SELECT *, coalesce(length(nat) BETWEEN lo AND hi, false) AS fits FROM y),
 b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY fits DESC, way) = 1),
 f AS (SELECT e.id, e.why, b.*, CASE WHEN replace(nat, left(nat, 1), '') = '' THEN 'Todos los dígitos son iguales (' || nat || '): número de relleno' END AS filler, CASE WHEN code = '54' AND starts_with(nat, '9') THEN substr(nat, 2) ELSE nat END AS own FROM e LEFT JOIN b ON b.id = e.id),
 g AS (SELECT *, why IS NULL AND coalesce(fits, false) AND filler IS NULL AS ok FROM f)
 SELECT id, ok::INT AS "VALIDO", coalesce(why, CASE WHEN code IS NULL THEN '{phones.NO_COUNTRY}' WHEN NOT fits AND length(nat) BETWEEN low AND high THEN '{phones.POSSIBLE}' WHEN NOT fits THEN '{phones.WRONG_LENGTH}' ELSE coalesce(filler, '{phones.VALID}') END) AS "MOTIVO",
  CASE WHEN ok THEN '+' || code || nat END AS "TELEFONO_NORMALIZADO", CASE WHEN ok THEN code ELSE '' END AS "CODIGO_PAIS", CASE WHEN ok THEN left(own, area) ELSE '' END AS "PREFIJO", CASE WHEN ok THEN substr(own, area + 1) ELSE '' END AS "TELEFONO",
  CASE WHEN ok AND kind = 'MOVIL' THEN 'C' WHEN ok AND kind = 'FIJO' THEN 'F' ELSE '' END AS "TIPO_TELEFONO", CASE WHEN ok THEN coalesce(kind, 'DESCONOCIDO') END AS "TIPO_LINEA" FROM g"""
_PHONE_COLUMNS = ("MOTIVO", "TELEFONO_NORMALIZADO", "CODIGO_PAIS", "PREFIJO", "TELEFONO", "TIPO_TELEFONO", "TIPO_LINEA")


def _dialled(spark, sf_dir):
    return phones.validated(made(spark, sf_dir, DIALLED), "tel", made(spark, sf_dir, PLAN.replace('"', "")))


@query("phone_plan", _PLAN_SQL)
def phone_plan(spark, sf_dir):
    return _dialled(spark, sf_dir).select("id", F.col("VALIDO").cast("int").alias("VALIDO"), *_PHONE_COLUMNS)


@query("phone_plan_counts", f"""SELECT count(*) AS total, count(*) FILTER ("VALIDO" = 1) AS validos, count(*) FILTER ("VALIDO" = 0) AS bajas, count(*) FILTER ("TIPO_LINEA" = 'MOVIL') AS moviles, count(*) FILTER ("TIPO_LINEA" = 'FIJO') AS fijos FROM ({_PLAN_SQL}) z""")
def phone_plan_counts(spark, sf_dir):
    return profile.statistics(_dialled(spark, sf_dir).withColumn("VALIDO", F.col("VALIDO").cast("int")), "telefonos")


# Previews ------------------------------------------------------------------------------------------------------------

_SEEN = "(SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 3 = 1 ORDER BY o_orderkey LIMIT 40)"
_ONE = "SELECT '{0}' AS columna, count(*) FILTER ({0} IS NULL) AS nulos, count(*) FILTER (trim({0}) = '') AS blancos, count(DISTINCT CASE WHEN trim({0}) <> '' THEN {0} END) AS distintos, min(CASE WHEN trim({0}) <> '' THEN length({0}) END) AS largo_min, max(CASE WHEN trim({0}) <> '' THEN length({0}) END) AS largo_max FROM {1}"


# Mails ---------------------------------------------------------------------------------------------------------------

ANSWERS = """SELECT DISTINCT CASE user_id % 5 WHEN 0 THEN 'carlos@yahoo.com' WHEN 1 THEN 'ana?lucia@gmail.com' WHEN 2 THEN 'juan@fibertel.com.ar' WHEN 3 THEN 'pedro@gmail.com' ELSE 'luis.maria@hotmail.com' END AS "MAIL", event_type AS "PROVEEDOR",
 CASE WHEN user_id % 5 = 3 THEN 'Error' WHEN user_id % 5 = 2 THEN 'Not Found' WHEN event_type < 'm' THEN 'Registered' ELSE 'Not Found' END AS "ESTADO_OSINT", CASE WHEN user_id % 5 < 2 THEN 'http://' || event_type ELSE '' END AS "URL_OSINT" FROM events"""
ASKED_OF = ("click", "view", "purchase", "signup")
_FLOW_SQL = f"""WITH v AS ({_MAIL_SQL}), a AS (SELECT "MAIL_DEPURADO" AS m, min(id) AS f FROM v WHERE "ESTADO" IN ('VALIDO', 'REVISION') GROUP BY 1 ORDER BY f, m LIMIT 4),
 g AS (SELECT "MAIL" AS m, count(*) AS n, count(*) FILTER ("ESTADO_OSINT" = 'Error') AS e, string_agg(DISTINCT CASE WHEN "ESTADO_OSINT" = 'Registered' THEN "PROVEEDOR" END, ', ' ORDER BY CASE WHEN "ESTADO_OSINT" = 'Registered' THEN "PROVEEDOR" END) AS w,
  string_agg(CASE WHEN "ESTADO_OSINT" = 'Registered' AND "URL_OSINT" <> '' THEN "URL_OSINT" END, ' | ' ORDER BY "PROVEEDOR") AS u FROM ({ANSWERS}) s WHERE "PROVEEDOR" IN {ASKED_OF} GROUP BY 1)
 SELECT v.id, v."MAIL_DEPURADO", CASE WHEN "FUE_DEPURADO" THEN 'SI' ELSE 'NO' END AS "FUE_DEPURADO", CASE WHEN g.w IS NULL OR "ESTADO" = 'INVALIDO' THEN "ESTADO" WHEN "ESTADO" = 'REVISION' THEN 'VALIDO' ELSE 'VALIDO_CONFIRMADO' END AS "ESTADO",
  CASE WHEN "ESTADO" = 'INVALIDO' THEN '{mails.THROWN_OUT}' WHEN g.n IS NULL THEN '{mails.NOT_ASKED}' WHEN g.w IS NOT NULL AND "ESTADO" = 'REVISION' THEN 'REVISION despejada: registrado en ' || g.w WHEN g.w IS NOT NULL THEN 'Registrado en ' || g.w
   WHEN g.n = g.e THEN 'Sin dato: los ' || g.e || ' proveedores dieron error' ELSE 'Sin registro en ' || (g.n - g.e) || ' proveedor(es) (no es evidencia de invalidez)' END AS "NOTA_OSINT", coalesce(g.w, '') AS "PROVEEDORES_REGISTRADO", coalesce(g.u, '') AS "URLS_OSINT"
 FROM v LEFT JOIN (SELECT g.* FROM g JOIN a USING (m)) g ON g.m = v."MAIL_DEPURADO\""""


@query("mail_flow", _FLOW_SQL)
def mail_flow(spark, sf_dir):
    """Four mails may be asked about: registered, erring and unknown ones are among them, and some that the budget leaves out."""
    told = mails.three_stages(made(spark, sf_dir, MAILS), "mail", "id", made(spark, sf_dir, ANSWERS.replace('"', "")), list(ASKED_OF), limit=4 * len(ASKED_OF))
    return told.select("id", "MAIL_DEPURADO", "FUE_DEPURADO", "ESTADO", "NOTA_OSINT", "PROVEEDORES_REGISTRADO", "URLS_OSINT")


@query("mail_second_opinion")
def mail_second_opinion(spark, sf_dir):
    """A model fitted on four fifths of the mails judges all of them; strong disagreement with the rules makes a review."""
    judged = mails.processed_once(made(spark, sf_dir, MAILS), "mail").withColumn("held_out", F.expr("crc32(cast(id AS string)) % 5 = 0"))
    model = mail_features.fitted(judged.filter("NOT held_out"), "mail")
    told = mail_features.second_opinion(mail_features.scored(judged.withColumn("REGLA", F.col("ESTADO")), "mail", model), "PUNTAJE")
    return told.select("id", "held_out", "REGLA", "ESTADO", F.round("PUNTAJE", 4).alias("PUNTAJE"))


_KEPT = "c_custkey % 14 IN (2, 6, 7, 8, 9, 11, 12)"


@query(
    "mail_changes",
    f"""SELECT c_custkey AS id, CASE WHEN {_KEPT} THEN 'MOD' WHEN c_custkey % 14 = 13 THEN 'REVISION' ELSE 'BAJA' END AS "OPERACION", CASE WHEN {_KEPT} THEN v."MAIL_DEPURADO" ELSE m.mail END AS mail, CASE WHEN c_custkey % 14 = 13 THEN 'REVISION MANUAL' END AS marca
 FROM customer JOIN ({_MAIL_SQL}) v ON v.id = c_custkey JOIN ({MAILS}) m ON m.id = c_custkey WHERE c_custkey % 14 <> 4 AND c_custkey % 3 <> 0""",
)
def mail_changes(spark, sf_dir):
    """What the in-place cleaning of a table would change; a third of its rows are low already."""
    rows = with_audit_columns(made(spark, sf_dir, MAILS)).withColumn("FECHA_BAJA", F.when(F.col("id") % 3 == 0, F.lit(datetime(2026, 1, 1))))
    due = mail_agent.changes(rows, "id", "mail", datetime(2026, 1, 2), "engine")
    return due.select("id", F.col("_kind").alias("OPERACION"), "mail", F.when(F.col("MOTIVO_MOD") == mail_agent.REVIEW_MARK, F.col("MOTIVO_MOD")).alias("marca"))


@query("preview", f"SELECT z.*, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1) AS total FROM ({_ONE.format('o_orderpriority', _SEEN)} UNION ALL {_ONE.format('o_orderstatus', _SEEN)}) z")
def preview(spark, sf_dir):
    _, columns, total = profile.preview(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 40, "o_orderkey % 3 = 1", with_total=True)
    return columns.withColumn("total", F.lit(total).cast("long"))
