"""Named queries over the test tables and the SQL that checks them.

Inputs are made by one SQL text that both engines read; what is under test is Spark-side the operator, and in the oracle plain SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactdq.functions.text import name_key, name_tokens, sorted_key
from contactdq.operators import identity, linking, names, normalise, phones, profile
from contactdq.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """An input by SQL over the tables that the text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


# Names of two words on both sides: the percentage pairs each word with the closest free one, as far as 0.90 alike.
_TWO = "trim(regexp_replace(upper({0}), '[^A-Z0-9 ]+', ' ', 'g'))"


def _percent_sql(source: str) -> str:
    """``source`` with ``pct``: the percentage of the names ``nx`` and ``ny``."""
    jw = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_winkler_similarity({a}, {b}) END"
    words = f"SELECT *, string_split(nx, ' ')[1] AS x1, string_split(nx, ' ')[2] AS x2, string_split(ny, ' ')[1] AS y1, string_split(ny, ' ')[2] AS y2 FROM ({source}) s"
    alike = f"SELECT *, {jw('x1', 'y1')} AS s11, {jw('x1', 'y2')} AS s12, {jw('x2', 'y1')} AS s21, {jw('x2', 'y2')} AS s22 FROM ({words}) w"
    first = f"SELECT *, greatest(s11, s12) AS f, CASE WHEN greatest(s11, s12) >= 0.9 THEN CASE WHEN s11 >= s12 THEN s22 ELSE s21 END ELSE greatest(s21, s22) END AS g FROM ({alike}) a"
    return f"SELECT *, CASE WHEN nx = ny THEN 100.0 ELSE round(greatest(50 * (CASE WHEN f >= 0.9 THEN f ELSE 0 END + CASE WHEN g >= 0.9 THEN g ELSE 0 END), 100 * jaro_winkler_similarity(replace(nx, ' ', ''), replace(ny, ' ', ''))), 2) END AS pct FROM ({first}) f"


# Name pairs ----------------------------------------------------------------------------------------------------------

PARTS = "SELECT p_name AS n, min(p_partkey) AS id FROM part GROUP BY p_name"
SWAP = "split_part({0}, ' ', 2) || ' ' || split_part({0}, ' ', 1)"
# One pair for each line of an order: the names of the part with its part key and of the part with its supplier key, the second swapped, misspelt or as it is.
PAIRS = f"SELECT l_orderkey * 8 + l_linenumber AS a_id, l_partkey AS b_id, p.p_name AS a, CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN {SWAP.format('q.p_name')} WHEN 1 THEN q.p_name || 'x' ELSE q.p_name END AS b FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_partkey = l_suppkey"

_METRICS_SQL = f"""
WITH p AS (SELECT a_id, b_id, trim(regexp_replace(upper(a), '[^A-Z0-9 ]+', ' ', 'g')) AS x, trim(regexp_replace(upper(b), '[^A-Z0-9 ]+', ' ', 'g')) AS y FROM ({PAIRS}) s),
t AS (SELECT *, list_distinct(string_split(x, ' ')) AS tx, list_distinct(string_split(y, ' ')) AS ty FROM p),
m AS (SELECT *, len(list_intersect(tx, ty)) AS c, greatest(length(x), length(y)) AS l FROM t),
r AS (SELECT *, round(jaro_winkler_similarity(x, y) * 100, 2) AS jw, round((1 - levenshtein(x, y) / l) * 100, 2) AS lev, round((1 - damerau_levenshtein(x, y) / l) * 100, 2) AS dam,
  round(c / least(len(tx), len(ty)) * 100, 2) AS ovl, round(2 * c / (len(tx) + len(ty)) * 100, 2) AS dic, round(c / (len(tx) + len(ty) - c) * 100, 2) AS jac FROM m),
q AS (SELECT *, floor((round((jw + lev + dam + ovl + dic + jac) * 100) + 3) / 6) / 100 AS prom, greatest(jw, lev, dam, ovl, dic, jac) AS hi, least(jw, lev, dam, ovl, dic, jac) AS lo FROM r)
SELECT a_id, b_id, jw AS "R_JARO_WINKLER", lev AS "R_LEVENSHTEIN", dam AS "R_DAMERAU", ovl AS "R_OVERLAP", dic AS "R_DICE", jac AS "R_JACCARD", prom AS "R_PROMEDIO", hi AS "R_MAXIMO", lo AS "R_MINIMO", round(hi - lo, 2) AS "R_DISPERSION",
 CASE WHEN x = y THEN 'COINCIDENCIA EXACTA' WHEN dam - lev >= 1 THEN 'TRANSPOSICION DE LETRAS' WHEN ovl = 0 AND greatest(jw, dam) >= 85 THEN 'TEXTO SIN SEPARAR'
  WHEN ovl >= 99 AND jac >= 99 AND lev < 60 THEN 'MISMAS PALABRAS EN OTRO ORDEN' WHEN ovl >= 99 AND jac >= 99 THEN 'COINCIDENCIA EXACTA' WHEN ovl >= 99 THEN 'UN LADO TIENE NOMBRES DE MAS'
  WHEN greatest(jw, dam) >= 85 AND c >= 2 THEN 'MISMAS PALABRAS EN OTRO ORDEN, CON TIPEO' WHEN greatest(jw, dam) >= 85 THEN 'ERROR DE TIPEO'
  WHEN greatest(lev, dam) < 40 AND ovl = 0 THEN 'SIN RELACION' WHEN hi - lo >= 50 THEN 'ALGORITMOS EN DESACUERDO' ELSE 'COINCIDENCIA PARCIAL' END AS "MOTIVO"
FROM q"""


def _compared(spark, sf_dir) -> DataFrame:
    return names.six_metrics(made(spark, sf_dir, PAIRS), "a", "b")


@query("six_metrics", _METRICS_SQL)
def six_metrics(spark, sf_dir):
    return _compared(spark, sf_dir).select("a_id", "b_id", *names.METRICS, "R_PROMEDIO", "R_MAXIMO", "R_MINIMO", "R_DISPERSION", "MOTIVO")


@query("reason_histogram", f'SELECT "MOTIVO", count(*) AS "CANTIDAD", round(avg("R_DISPERSION"), 2) AS "DISPERSION_MEDIA" FROM ({_METRICS_SQL}) z GROUP BY 1')
def reason_histogram(spark, sf_dir):
    return names.reason_histogram(_compared(spark, sf_dir))


_PERCENTAGE_SQL = f"""SELECT a_id, b_id, pct AS "PORCENTAJE", cast(pct >= 80 AS INT) AS "COINCIDE", CASE WHEN nx = ny THEN 'DENOMINACION EXACTA' WHEN f >= 0.9 AND g >= 0.9 AND f = 1 AND g = 1 THEN 'COINCIDENTE: MISMOS NOMBRES EN OTRO ORDEN' WHEN f >= 0.9 AND g >= 0.9 THEN 'COINCIDENTE CON DIFERENCIAS DE TIPEO'
 WHEN pct >= 80 THEN 'NOMBRES COINCIDENTES (>= 80%)' WHEN f >= 0.9 OR g >= 0.9 THEN 'COINCIDENCIA PARCIAL (1 de 2 nombres coinciden)' ELSE 'SIN COINCIDENCIA' END AS "ANALISIS" FROM ({_percent_sql(f"SELECT a_id, b_id, {_TWO.format('a')} AS nx, {_TWO.format('b')} AS ny FROM ({PAIRS}) s")}) p"""


@query("name_percentage", _PERCENTAGE_SQL)
def name_percentage(spark, sf_dir):
    return names.compared_denominations(made(spark, sf_dir, PAIRS), "a", "b", 80.0).select("a_id", "b_id", "PORCENTAJE", "COINCIDE", "ANALISIS")


@query("denomination_counts", f"""SELECT count(*) AS total, count(*) FILTER ("COINCIDE" = 1) AS coincidentes, count(*) FILTER ("COINCIDE" = 0 AND "ANALISIS" <> 'SIN COINCIDENCIA') AS parciales, count(*) FILTER ("ANALISIS" = 'SIN COINCIDENCIA') AS sin_coincidencia FROM ({_PERCENTAGE_SQL}) z""")
def denomination_counts(spark, sf_dir):
    return profile.statistics(names.compared_denominations(made(spark, sf_dir, PAIRS), "a", "b", 80.0), "denominacion")


NAMES = "SELECT 'c' || cast(c_custkey AS STRING) AS id, replace(c_name, '#', ' la  ') AS n FROM customer UNION ALL SELECT 'p' || cast(p_partkey AS STRING), p_name || ' | extra' FROM part UNION ALL SELECT 'n' || cast(n_nationkey AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) || '@x.com' WHEN n_nationkey % 3 = 1 THEN n_name || ' SRL' ELSE lower(n_name) || '_x' END FROM nation"
_STOP = "('" + "','".join(("DE", "DEL", "LA", "LAS", "EL", "LOS", "Y", "E", "A", "EN", "CON", "THE", "OF", "AND")) + "')"
_KEYED = f"""SELECT id, d, k, list_filter(list_distinct(string_split(k, ' ')), lambda t: length(t) >= 2 AND t NOT IN {_STOP}) AS toks FROM
 (SELECT id, d, trim(regexp_replace(regexp_replace(upper(d), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS k FROM (SELECT id, trim(string_split(n, '|')[1]) AS d FROM ({NAMES}) s) u) v"""


@query("name_keys", f"""SELECT id, k AS "CLAVE", array_to_string(list_sort(string_split(k, ' ')), ' ') AS "CLAVE_ORDENADA", array_to_string(list_sort(toks), ' ') AS "TOKENS" FROM ({_KEYED}) z""")
def name_keys(spark, sf_dir):
    step = made(spark, sf_dir, NAMES).withColumn("CLAVE", name_key(names.first_segment(F.col("n"))))
    return step.select("id", "CLAVE", sorted_key(F.col("CLAVE")).alias("CLAVE_ORDENADA"), F.array_join(F.array_sort(name_tokens(F.col("CLAVE"))), " ").alias("TOKENS"))


_CLASS_SQL = f"""SELECT id, k AS "CLAVE", CASE WHEN d LIKE '%@%.com' THEN 'RUIDO' WHEN d NOT LIKE '% %' AND d LIKE '%\\_%' ESCAPE '\\' AND lower(d) = d THEN 'RUIDO' WHEN list_contains(toks, 'SRL') THEN 'J' WHEN len(toks) <= 1 THEN 'RUIDO' ELSE 'F' END AS "TIPO",
 CASE WHEN d LIKE '%@%.com' THEN 'CAMPO_NOMBRE_CONTIENE_EMAIL' WHEN d NOT LIKE '% %' AND d LIKE '%\\_%' ESCAPE '\\' AND lower(d) = d THEN 'CAMPO_NOMBRE_CONTIENE_USERNAME' WHEN list_contains(toks, 'SRL') THEN 'INDICIO_JURIDICA(SRL)' WHEN len(toks) <= 1 THEN 'DENOMINACION_DE_UN_SOLO_TOKEN_NO_RESOLUBLE' ELSE '' END AS "MOTIVO_NORM" FROM ({_KEYED}) z"""


@query("name_classes", _CLASS_SQL)
def name_classes(spark, sf_dir):
    return names.classified(made(spark, sf_dir, NAMES), "n").select("id", "CLAVE", "TIPO", "MOTIVO_NORM")


@query("class_histogram", f'SELECT "TIPO", "MOTIVO_NORM", count(*) AS "CANTIDAD" FROM ({_CLASS_SQL}) y GROUP BY 1, 2')
def class_histogram(spark, sf_dir):
    return names.class_histogram(names.classified(made(spark, sf_dir, NAMES), "n"))


@query("duplicate_keys", f'SELECT k AS "CLAVE", count(*) AS "CANTIDAD" FROM ({_KEYED}) z WHERE k <> \'\' GROUP BY k HAVING count(*) > 1')
def duplicate_keys(spark, sf_dir):
    return names.duplicate_keys(names.classified(made(spark, sf_dir, NAMES), "n"))


# Linking -------------------------------------------------------------------------------------------------------------

LEFT = f"SELECT cast(id AS STRING) AS id, CASE WHEN id % 5 = 0 THEN 'zzqq' WHEN id % 2 = 0 THEN {SWAP.format('n')} ELSE n || ' extra' END AS n FROM ({PARTS}) l"
RIGHT = f"SELECT id AS bid, n AS bn FROM ({PARTS}) r"

_MATCH_SQL = f"""
WITH a AS (SELECT id, upper(n) AS k, string_split(upper(n), ' ') AS t FROM ({LEFT}) x), b AS (SELECT bid, upper(bn) AS k, string_split(upper(bn), ' ') AS t FROM ({RIGHT}) y),
ex AS (SELECT a.id, b.bid FROM a JOIN b ON a.k = b.k),
nr AS (SELECT DISTINCT u.id, v.bid FROM (SELECT id, unnest(t) AS w FROM a WHERE k NOT IN (SELECT k FROM b)) u JOIN (SELECT bid, unnest(t) AS w FROM b) v ON u.w = v.w WHERE length(u.w) >= 4),
pr AS (SELECT * FROM ex UNION SELECT * FROM nr),
s AS (SELECT pr.id, pr.bid, a.k AS x, b.k AS y, a.t AS tx, b.t AS ty, jaro_winkler_similarity(a.k, b.k) AS jw, jaro_winkler_similarity(array_to_string(list_sort(a.t), ' '), array_to_string(list_sort(b.t), ' ')) AS jwo,
  levenshtein(a.k, b.k) AS lev, damerau_levenshtein(a.k, b.k) AS dam, len(list_intersect(list_distinct(a.t), list_distinct(b.t))) AS c, len(list_distinct(a.t)) AS na, len(list_distinct(b.t)) AS nb FROM pr JOIN a USING (id) JOIN b USING (bid)),
q AS (SELECT *, 2 * c / (na + nb) AS di FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY greatest(round(jwo, 6), round(di, 6)) DESC, bid) AS rk,
  CASE WHEN greatest(jwo, di) >= 0.92 THEN CASE WHEN abs(jwo - di) >= 0.25 THEN 'RE' ELSE 'SI' END WHEN greatest(jwo, di) >= 0.80 THEN 'RE' ELSE 'NO' END AS v FROM q)
SELECT a.id AS "ID_ARCHIVO", w.bid AS "ID_BASE", round(w.jw, 6) AS "JARO_WINKLER", round(w.jwo, 6) AS "JARO_WINKLER_ORD", w.lev AS "LEVENSHTEIN", w.dam AS "DAMERAU", round(w.di, 6) AS "DICE", round(w.c / (w.na + w.nb - w.c), 6) AS "JACCARD",
 coalesce(w.v, 'NO') AS "COINCIDE", coalesce(w.rk, 0) AS "RANKING" FROM a LEFT JOIN (SELECT * FROM w WHERE rk <= 5) w ON a.id = w.id"""


def _matched(spark, sf_dir) -> DataFrame:
    return linking.cross_match(made(spark, sf_dir, LEFT), made(spark, sf_dir, RIGHT), 5, "id", "n", "bid", "bn")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five base names of each file name, with scores and verdict."""
    return _matched(spark, sf_dir).select("ID_ARCHIVO", "ID_BASE", "JARO_WINKLER", "JARO_WINKLER_ORD", "LEVENSHTEIN", "DAMERAU", "DICE", "JACCARD", "COINCIDE", "RANKING")


query("blocking_topk", _MATCH_SQL)(flagship)


@query("verdict_counts", f'SELECT "COINCIDE", count(*) AS "CANTIDAD" FROM ({_MATCH_SQL}) z WHERE "RANKING" <= 1 GROUP BY 1')
def verdict_counts(spark, sf_dir):
    return linking.verdict_counts(_matched(spark, sf_dir))


@query("paired_match")
def paired_match(spark, sf_dir):
    return linking.paired_match(made(spark, sf_dir, PAIRS), "a", "b").select("a_id", "b_id", "JARO_WINKLER", "JARO_WINKLER_ORD", "DICE", "MOTIVO", "COINCIDE", "RANKING")


# The same operators over whole tables: one pair for each order, and every part row linked by its own id.

# Names of two words at most: the SQL has the rules of the diagnosis for these only.
ORDER_PAIRS = """SELECT o_orderkey AS a_id, o_custkey AS b_id, n AS a, CASE o_orderkey % 6 WHEN 0 THEN split_part(n, ' ', 2) || ' ' || split_part(n, ' ', 1) WHEN 1 THEN n || 'x' WHEN 2 THEN split_part(n, ' ', 2) WHEN 3 THEN lower(c_mktsegment) || ' ' || split_part(n, ' ', 2)
 WHEN 4 THEN replace(n, ' ', '') ELSE lower(n) END AS b FROM orders JOIN (SELECT c_custkey, c_mktsegment, replace(c_name, '#', ' ') AS n FROM customer) c ON c_custkey = o_custkey"""
_ALL_METRICS_SQL = _METRICS_SQL.replace(PAIRS, ORDER_PAIRS)
ALL_PARTS = "SELECT p_name AS n, p_partkey AS id FROM part"
ALL_LEFT, ALL_RIGHT = LEFT.replace(PARTS, ALL_PARTS), RIGHT.replace(PARTS, ALL_PARTS)


def _all_compared(spark, sf_dir) -> DataFrame:
    return names.six_metrics(made(spark, sf_dir, ORDER_PAIRS), "a", "b")


@query("six_metrics_all", _ALL_METRICS_SQL)
def six_metrics_all(spark, sf_dir):
    return _all_compared(spark, sf_dir).select("a_id", "b_id", *names.METRICS, "R_PROMEDIO", "R_MAXIMO", "R_MINIMO", "R_DISPERSION", "MOTIVO")


@query("reason_histogram_all", f'SELECT "MOTIVO", count(*) AS "CANTIDAD", round(avg("R_DISPERSION"), 2) AS "DISPERSION_MEDIA" FROM ({_ALL_METRICS_SQL}) z GROUP BY 1')
def reason_histogram_all(spark, sf_dir):
    return names.reason_histogram(_all_compared(spark, sf_dir))


@query("name_percentage_all")
def name_percentage_all(spark, sf_dir):
    return names.compared_denominations(made(spark, sf_dir, ORDER_PAIRS), "a", "b", 80.0).select("a_id", "b_id", "PORCENTAJE", "COINCIDE", "ANALISIS")


@query("paired_match_all")
def paired_match_all(spark, sf_dir):
    return linking.paired_match(made(spark, sf_dir, ORDER_PAIRS), "a", "b").select("a_id", "b_id", "JARO_WINKLER", "JARO_WINKLER_ORD", "DICE", "MOTIVO", "COINCIDE", "RANKING")


def _all_matched(spark, sf_dir) -> DataFrame:
    return linking.cross_match(made(spark, sf_dir, ALL_LEFT), made(spark, sf_dir, ALL_RIGHT), 5, "id", "n", "bid", "bn")


# The SQL scores every pair of rows: 4.8 s over sf0.01, not ended after 45 s over sf0.1.
_ALL_MATCH_SQL = _MATCH_SQL.replace(LEFT, ALL_LEFT).replace(RIGHT, ALL_RIGHT)


@query("blocking_topk_all", _ALL_MATCH_SQL)
def blocking_topk_all(spark, sf_dir):
    return _all_matched(spark, sf_dir).select("ID_ARCHIVO", "ID_BASE", "JARO_WINKLER", "JARO_WINKLER_ORD", "LEVENSHTEIN", "DAMERAU", "DICE", "JACCARD", "COINCIDE", "RANKING")


@query("verdict_counts_all", f'SELECT "COINCIDE", count(*) AS "CANTIDAD" FROM ({_ALL_MATCH_SQL}) z WHERE "RANKING" <= 1 GROUP BY 1')
def verdict_counts_all(spark, sf_dir):
    return linking.verdict_counts(_all_matched(spark, sf_dir))


# As many distinct keys as rows: eight base rows have the name of one part and a token of their own family, and each a number. On the file side words are swapped, the token or
# a word is misspelt, the number is missing, or (one row in 997) the token is unknown to the base.
_OWN = "(SELECT p.p_partkey AS id, q.p_name AS n, substr(md5(cast(q.p_partkey AS STRING)), 1, 12) AS f FROM part p JOIN part q ON q.p_partkey = p.p_partkey - (p.p_partkey - 1) % 8)"
OWN_RIGHT = f"SELECT id AS bid, n || ' ' || f || ' x' || cast(id AS STRING) AS bn FROM {_OWN} o"
OWN_LEFT = f"""SELECT cast(id AS STRING) AS id, CASE WHEN id % 997 = 0 THEN n || ' ' || substr(md5('no' || cast(id AS STRING)), 1, 12) WHEN id % 5 = 0 THEN f || ' ' || {SWAP.format('n')} WHEN id % 5 = 1 THEN n || ' ' || left(f, 5) || 'q' || substr(f, 7)
 WHEN id % 5 = 2 THEN 'z' || substr(n, 2) || ' ' || f WHEN id % 5 = 3 THEN n || ' ' || f || ' x' || cast(id AS STRING) ELSE n || ' ' || f || ' xx' END AS n FROM {_OWN} o"""


def _own_matched(spark, sf_dir) -> DataFrame:
    return linking.cross_match(made(spark, sf_dir, OWN_LEFT), made(spark, sf_dir, OWN_RIGHT), 5, "id", "n", "bid", "bn")


# The SQL scores every pair of rows that share a long token.
_OWN_MATCH_SQL = _MATCH_SQL.replace(LEFT, OWN_LEFT).replace(RIGHT, OWN_RIGHT).replace("string_split(upper(n), ' ') AS t", "list_distinct(string_split(upper(n), ' ')) AS t")


@query("blocking_topk_own", _OWN_MATCH_SQL)
def blocking_topk_own(spark, sf_dir):
    return _own_matched(spark, sf_dir).select("ID_ARCHIVO", "ID_BASE", "JARO_WINKLER", "JARO_WINKLER_ORD", "LEVENSHTEIN", "DAMERAU", "DICE", "JACCARD", "COINCIDE", "RANKING")


CLAIMS = """SELECT o_orderkey AS "ID", o_custkey % 400 AS "ID_ARCHIVO", o_orderkey % 700 AS "ID_BASE", CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'u' || cast(o_custkey % 5 AS STRING) END AS "USERNAME",
 (o_orderkey % 100) / 100.0 AS jw, ((o_orderkey * 7) % 100) / 100.0 AS di, 'M' AS "MOTIVO", CASE WHEN o_orderkey % 3 = 0 THEN 'SI' ELSE 'NO' END AS "COINCIDE" FROM orders"""


def _claims(spark, sf_dir) -> DataFrame:
    step = made(spark, sf_dir, CLAIMS.replace('"', ""))
    return step.withColumns({"JARO_WINKLER_ORD": F.col("jw").cast("double"), "DICE": F.col("di").cast("double")}).drop("jw", "di")


def _pass_sql(source: str, group: str, contested: str, tag: str) -> str:
    return f"""SELECT * EXCLUDE (sc, usr, inn, rk, us, gap) REPLACE (
  CASE WHEN inn AND NOT (us = 1 AND usr <> '') AND NOT (gap >= 0.03 AND rk = 1) THEN 'RE' ELSE "COINCIDE" END AS "COINCIDE",
  CASE WHEN inn THEN left("MOTIVO" || '; ' || CASE WHEN us = 1 AND usr <> '' THEN 'MISMA_ENTIDAD_MULTIPLE_PERFIL' WHEN gap >= 0.03 AND rk = 1 THEN 'GANA_POR_MARGEN(' || printf('%.4f', gap) || ')' WHEN gap >= 0.03 THEN '{tag}_PIERDE_POR_MARGEN' ELSE '{tag}_EMPATE_SIN_EVIDENCIA' END, 200) ELSE "MOTIVO" END AS "MOTIVO")
 FROM (SELECT *, max(CASE WHEN rk = 1 THEN sc END) OVER (PARTITION BY "{group}", "COINCIDE" = 'SI') - max(CASE WHEN rk = 2 THEN sc END) OVER (PARTITION BY "{group}", "COINCIDE" = 'SI') AS gap FROM
 (SELECT *, greatest(jw, di) AS sc, lower(trim("USERNAME")) AS usr, "COINCIDE" = 'SI' AND {contested} AS inn, row_number() OVER (PARTITION BY "{group}", "COINCIDE" = 'SI' ORDER BY greatest(jw, di) DESC, "ID") AS rk,
  len(list_distinct(list(lower(trim("USERNAME"))) OVER (PARTITION BY "{group}", "COINCIDE" = 'SI'))) AS us FROM {source} g) h) i"""


_FIRST = _pass_sql(f"(SELECT * REPLACE (CAST(jw AS DOUBLE) AS jw, CAST(di AS DOUBLE) AS di) FROM ({CLAIMS}) c)", "ID_BASE", "len(list_distinct(list(\"ID_ARCHIVO\") OVER (PARTITION BY \"ID_BASE\", \"COINCIDE\" = 'SI'))) > 1", "CONFLICTO_N1")
_SECOND = _pass_sql(f"({_FIRST})", "ID_ARCHIVO", "count(*) OVER (PARTITION BY \"ID_ARCHIVO\", \"COINCIDE\" = 'SI') > 1", "CONFLICTO_1N")


@query("conflict_resolution", f'SELECT "ID", "COINCIDE", "MOTIVO" FROM ({_SECOND}) z')
def conflict_resolution(spark, sf_dir):
    return linking.resolved_conflicts(_claims(spark, sf_dir)).select("ID", "COINCIDE", "MOTIVO")


@query("conflict_detection", f"""SELECT "ID_BASE", count(DISTINCT "ID_ARCHIVO") AS "CANTIDAD" FROM ({CLAIMS}) z WHERE "COINCIDE" = 'SI' GROUP BY 1 HAVING count(DISTINCT "ID_ARCHIVO") > 1""")
def conflict_detection(spark, sf_dir):
    return linking.conflicts(_claims(spark, sf_dir))


# Identity numbers ----------------------------------------------------------------------------------------------------


def _digit_sql(ten: str) -> str:
    total = " + ".join(f"cast(substr({ten}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(identity.WEIGHTS))
    return f"CASE 11 - ({total}) % 11 WHEN 11 THEN 0 WHEN 10 THEN 9 ELSE 11 - ({total}) % 11 END"


TEN = "'20' || lpad(cast(c_custkey AS STRING), 8, '0')"
CUITS = f"SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN {TEN} || '5' WHEN 1 THEN '99' || lpad(cast(c_custkey AS STRING), 8, '0') || '1' WHEN 2 THEN '' WHEN 3 THEN '20-' || cast(c_custkey AS STRING) ELSE {TEN} || cast({_digit_sql(TEN)} AS STRING) END AS n FROM customer"


@query(
    "cuit_validate",
    f"""WITH d AS (SELECT id, regexp_replace(n, '[^0-9]', '', 'g') AS c FROM ({CUITS}) s), v AS (SELECT *, length(c) = 11 AND substr(c, 1, 2) IN ('20','23','24','27','30','33','34') AND CASE WHEN length(c) = 11 THEN cast(substr(c, 11, 1) AS INT) = {_digit_sql("substr(c, 1, 10)")} ELSE false END AS ok FROM d)
    SELECT id, ok AS "VALIDO", CASE WHEN ok THEN c END AS "CUIT_NORMALIZADO", CASE WHEN ok THEN CASE WHEN substr(c, 1, 2) IN ('20','23','24','27') THEN 'FISICA' ELSE 'JURIDICA' END END AS "TIPO_PERSONA", CASE WHEN ok THEN ltrim(substr(c, 3, 8), '0') END AS "DNI",
    CASE WHEN length(c) = 11 THEN substr(c, 1, 2) || '-' || substr(c, 3, 8) || '-' || substr(c, 11, 1) ELSE c END AS formatted FROM v""",
)
def cuit_validate(spark, sf_dir):
    step = identity.validated_cuit(made(spark, sf_dir, CUITS), "n")
    from contactdq.functions.text import digits

    return step.select("id", "VALIDO", "CUIT_NORMALIZADO", "TIPO_PERSONA", "DNI", identity.formatted_cuit(digits(F.col("n"))).alias("formatted"))


REGISTRY = f"""SELECT {TEN} || cast({_digit_sql(TEN)} AS STRING) AS "CUIT", c_name AS "DENOMINACION", replace(c_name, '#', ' ') AS "NOMBRE_LIMPIO", CASE WHEN c_custkey % 2 = 0 THEN lpad(cast(c_custkey AS STRING), 8, '0') ELSE cast(c_custkey AS STRING) END AS "DNI",
 CASE WHEN c_custkey % 9 = 0 THEN '*' WHEN c_custkey % 9 = 1 THEN 'Q' END AS "MARCA_BAJA", CASE WHEN c_custkey % 13 = 0 THEN '1999-01-01' END AS "FECHA_FALLECIMIENTO", cast(NULL AS STRING) AS "CUIT_REEMPLAZO" FROM customer
 UNION ALL SELECT '27' || lpad(cast(s_suppkey AS STRING), 8, '0') || '1', s_name, s_name, cast(s_suppkey AS STRING), NULL, NULL, NULL FROM supplier"""
ASKED = f"SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey AS STRING) WHEN 1 THEN lpad(cast(c_custkey AS STRING), 8, '0') WHEN 2 THEN {TEN} || cast({_digit_sql(TEN)} AS STRING) ELSE cast(c_custkey * 1000 AS STRING) END AS n, CASE WHEN c_custkey % 3 = 0 THEN 'Someone Else' ELSE replace(c_name, '#', ' ') END AS nm FROM customer"

_SNAP = f"""(SELECT *, regexp_replace("CUIT", '[^0-9]', '', 'g') AS cn, regexp_replace("DNI", '[^0-9]', '', 'g') AS dn FROM ({REGISTRY}) s)"""
_VARIANTS = f"SELECT id, d, pos, k FROM (SELECT id, n AS d, unnest([0, 1, 2]) AS pos, unnest([n, CASE WHEN length(n) < 8 THEN lpad(n, 8, '0') ELSE n END, ltrim(n, '0')]) AS k FROM ({ASKED}) q WHERE length(n) <> 11) w"


def _snapshot(spark, sf_dir) -> DataFrame:
    return identity.registry_snapshot(made(spark, sf_dir, REGISTRY.replace('"', "")))


@query(
    "registry_lookup",
    f"""WITH r AS {_SNAP}, dn AS (SELECT v.id, v.pos, r."CUIT", r."DENOMINACION" FROM ({_VARIANTS}) v JOIN r ON r.dn = v.k),
    best AS (SELECT id, min(pos) AS pos FROM dn GROUP BY id), f AS (SELECT DISTINCT dn.* FROM dn JOIN best USING (id, pos) UNION ALL SELECT q.id, 0, r."CUIT", r."DENOMINACION" FROM ({ASKED}) q JOIN r ON r.cn = q.n WHERE length(q.n) = 11)
    SELECT q.id, q.n, f."CUIT", f."DENOMINACION" FROM ({ASKED}) q LEFT JOIN f USING (id)""",
)
def registry_lookup(spark, sf_dir):
    asked = made(spark, sf_dir, ASKED)
    return identity.lookup_first_variant(asked, _snapshot(spark, sf_dir), "n", "id").select("id", "n", "CUIT", "DENOMINACION")


_CUITIFY = f"""WITH r AS {_SNAP}, h AS (SELECT DISTINCT q.id, r."DENOMINACION" AS den FROM ({ASKED}) q JOIN r ON length(q.n) = 11 AND r.cn = q.n UNION SELECT v.id, r."DENOMINACION" FROM ({_VARIANTS}) v JOIN r ON r.dn = v.k), c AS (SELECT id, count(*) AS n FROM h GROUP BY id)
    SELECT q.id, q.n AS "NUMERO_BUSCADO", h.den AS "DENOMINACION_ENCONTRADA", CASE WHEN h.den IS NULL THEN 'NO ENCONTRADO' ELSE 'ENCONTRADO' END AS "ESTADO", CASE WHEN c.n > 1 THEN 'SI' ELSE 'NO' END AS "REVISION", cast(coalesce(c.n, 0) AS INT) AS "COINCIDENCIAS" FROM ({ASKED}) q LEFT JOIN h USING (id) LEFT JOIN c USING (id)"""


@query("cuitificar", _CUITIFY)
def cuitificar(spark, sf_dir):
    found = identity.enriched(made(spark, sf_dir, ASKED), _snapshot(spark, sf_dir), "n", "id")
    return found.select("id", "NUMERO_BUSCADO", "DENOMINACION_ENCONTRADA", "ESTADO", "REVISION", "COINCIDENCIAS")


@query(
    "cuitificar_counts",
    f"""SELECT count(DISTINCT "NUMERO_BUSCADO") AS unicos, count(DISTINCT CASE WHEN "ESTADO" = 'ENCONTRADO' THEN "NUMERO_BUSCADO" END) AS encontrados, count(DISTINCT CASE WHEN "REVISION" = 'SI' THEN "NUMERO_BUSCADO" END) AS en_revision, count(DISTINCT "NUMERO_BUSCADO") - count(DISTINCT CASE WHEN "ESTADO" = 'ENCONTRADO' THEN "NUMERO_BUSCADO" END) AS no_encontrados FROM ({_CUITIFY}) z""",
)
def cuitificar_counts(spark, sf_dir):
    return identity.enrichment_counts(identity.enriched(made(spark, sf_dir, ASKED), _snapshot(spark, sf_dir), "n", "id"))


def _registry_sql(asked: str) -> str:
    """CTEs for ``asked`` (id, c, d, nm): ``hits`` of the registry by either key, with percentage and alerts, and ``told``: the best ones of each row."""
    variants = "SELECT id, nm, d, unnest([0, 1, 2]) AS pos, unnest([d, CASE WHEN length(d) < 8 THEN lpad(d, 8, '0') ELSE d END, ltrim(d, '0')]) AS k FROM asked WHERE d <> ''"
    dash = "substr(cn, 1, 2) || '-' || substr(cn, 3, 8) || '-' || substr(cn, 11, 1)"
    alerts = """concat_ws('; ', CASE WHEN "MARCA_BAJA" = '*' THEN 'DADO DE BAJA' WHEN "MARCA_BAJA" = 'Q' THEN 'MARCA_BAJA con valor no reconocido: ''Q'' (se trata como activo)' END, CASE WHEN "FECHA_FALLECIMIENTO" IS NOT NULL THEN 'FALLECIDO (' || "FECHA_FALLECIMIENTO" || ')' END)"""
    shown = _TWO.format('"NOMBRE_LIMPIO"')
    named = f"SELECT *, {_TWO.format('nm')} AS nx, {shown} AS ny FROM (SELECT id, nm, 'c' AS src, r.* FROM asked JOIN r ON r.cn = c AND c <> '' UNION ALL SELECT v.id, v.nm, 'd', r.* FROM vars v JOIN r ON r.dn = v.k JOIN best b ON b.id = v.id AND b.pos = v.pos) h"
    first = "arg_min(h, struct_pack(a := -pct, b := cn))"
    return f"""asked AS ({asked}), r AS (SELECT * FROM {_SNAP}), vars AS (SELECT id, nm, min(pos) AS pos, k FROM ({variants}) v WHERE k <> '' GROUP BY ALL), best AS (SELECT v.id, min(v.pos) AS pos FROM vars v JOIN r ON r.dn = v.k GROUP BY v.id),
    hits AS (SELECT *, {dash} AS fc, {alerts} AS al FROM ({_percent_sql(named)}) p),
    told AS (SELECT id, count(*) FILTER (src = 'c') AS nc, count(*) FILTER (src = 'd') AS nd, count(*) FILTER (src = 'd' AND pct >= 90) AS nf, {first} FILTER (src = 'c') AS bc, {first} FILTER (src = 'd') AS bd, {first} FILTER (src = 'd' AND pct >= 90) AS bf FROM hits h GROUP BY id)"""


def _validated_sql(asked: str, own: str, clash: str = "NULL") -> str:
    """The whole validation of ``asked``; ``own`` shows the tax id that was asked for, ``clash`` is the alert on numbers that contradict each other."""
    return f"""WITH {_registry_sql(asked)},
    s AS (SELECT a.*, coalesce(nc, 0) AS nc, coalesce(nd, 0) AS nd, coalesce(nf, 0) AS nf, CASE WHEN nc > 0 THEN bc ELSE bf END AS b,
      CASE WHEN nc > 0 AND bc.pct >= 90 THEN '{identity.BOTH_FIT}' WHEN nc > 0 THEN '{identity.ONLY_NUMBER}' WHEN coalesce(nf, 0) = 0 THEN '{identity.NOTHING_FITS}' WHEN nf = 1 THEN '{identity.ONLY_NAME}' ELSE '{identity.PENDING}' END AS st FROM asked a LEFT JOIN told USING (id)),
    t AS (SELECT *, st NOT IN ('{identity.NOTHING_FITS}', '{identity.PENDING}') AS taken FROM s)
    SELECT id, c AS "CUIT_ORIGEN", d AS "DNI_ORIGEN", CASE WHEN taken THEN b.fc END AS "CUIT_PADRON", CASE WHEN taken THEN b."DENOMINACION" END AS "DENOMINACION_PADRON", CASE WHEN taken THEN b.pct ELSE 0.0 END AS "PORCENTAJE", st AS "ESTADO_VALIDACION",
    cast(CASE WHEN nc > 0 THEN nc ELSE nd END AS INT) AS "CANDIDATOS", CASE WHEN taken THEN coalesce(b."MARCA_BAJA", '') END AS "MARCA_BAJA", CASE WHEN taken THEN coalesce(b."FECHA_FALLECIMIENTO", '') END AS "FECHA_FALLECIMIENTO",
    concat_ws('; ', {clash}, CASE st WHEN '{identity.ONLY_NUMBER}' THEN 'El CUIT existe en el padrón pero está a nombre de ''' || b."DENOMINACION" || ''' (' || printf('%.0f', b.pct) || '% de coincidencia): puede ser el CUIT de otra persona'
      WHEN '{identity.NOTHING_FITS}' THEN CASE WHEN nd > 0 THEN 'El CUIT no figura en el padrón. Por DNI hay ' || nd || ' persona(s), pero ninguna con un nombre parecido' ELSE 'Ni el CUIT ni el DNI figuran en el padrón' END
      WHEN '{identity.PENDING}' THEN 'El CUIT no figura en el padrón. Por DNI hay ' || nf || ' personas cuyo nombre supera el umbral: requiere decisión manual'
      WHEN '{identity.ONLY_NAME}' THEN 'El CUIT del origen (' || {own} || ') no figura en el padrón, pero por DNI la persona SÍ está, con el CUIT ' || b.fc || ': el CUIT del origen estaría mal cargado' END,
      CASE WHEN taken THEN nullif(b.al, '') END) AS "ALERTAS" FROM t"""


_VALIDATED = _validated_sql(f"SELECT id, CASE WHEN length(n) = 11 THEN n ELSE '' END AS c, CASE WHEN length(n) = 11 THEN '' ELSE n END AS d, nm FROM ({ASKED}) q", "c")
_SHOWN = ("id", "CUIT_ORIGEN", "DNI_ORIGEN", "CUIT_PADRON", "DENOMINACION_PADRON", "PORCENTAJE", "ESTADO_VALIDACION", "CANDIDATOS", "MARCA_BAJA", "FECHA_FALLECIMIENTO", "ALERTAS")


def _validated(spark, sf_dir) -> DataFrame:
    return identity.validated_against_registry(made(spark, sf_dir, ASKED), _snapshot(spark, sf_dir), "n", "nm", "id")


@query("registry_validation", _VALIDATED)
def registry_validation(spark, sf_dir):
    return _validated(spark, sf_dir).select(*_SHOWN)


@query("registry_states", f"""SELECT "ESTADO_VALIDACION", count(*) AS "CANTIDAD", count(*) FILTER ("ALERTAS" <> '') AS "CON_ALERTA" FROM ({_VALIDATED}) z GROUP BY 1""")
def registry_states(spark, sf_dir):
    return identity.state_counts(_validated(spark, sf_dir))


# Tax id and identity number side by side: a third of the tax ids are of nobody, a seventh of the identity numbers are another's.
BOTH = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN '23' || lpad(cast(c_custkey AS STRING), 8, '0') || '7' ELSE {TEN} || cast({_digit_sql(TEN)} AS STRING) END AS c, CASE WHEN c_custkey % 7 = 0 THEN cast(c_custkey + 1 AS STRING) ELSE cast(c_custkey AS STRING) END AS d, CASE WHEN c_custkey % 5 = 0 THEN 'Someone Else' ELSE replace(c_name, '#', ' ') END AS nm FROM customer"
_OWN, _INNER = "substr(c, 1, 2) || '-' || substr(c, 3, 8) || '-' || substr(c, 11, 1)", "ltrim(substr(c, 3, 8), '0')"
_BOTH_SQL = _validated_sql(BOTH, _OWN, f"CASE WHEN {_INNER} <> ltrim(d, '0') THEN 'El CUIT del origen (' || {_OWN} || ') contiene el DNI ' || {_INNER} || ', pero la columna DNI dice ' || d || ': los datos del origen se contradicen' END")


def _both(spark, sf_dir) -> DataFrame:
    return identity.validated_tax_ids(made(spark, sf_dir, BOTH), _snapshot(spark, sf_dir), "c", "d", "nm", "id")


@query("tax_id_validation", _BOTH_SQL)
def tax_id_validation(spark, sf_dir):
    return _both(spark, sf_dir).select(*_SHOWN)


_COUNTED = {
    "validados": identity.BOTH_FIT, "no_coincide": identity.NOTHING_FITS, "solo_cuit": identity.ONLY_NUMBER, "solo_denom": identity.ONLY_NAME,
    "pendientes": identity.PENDING, "no_encontrados": identity.NOT_FOUND, "dni_invalido": identity.BAD_DNI,
}


@query("validation_counts", "SELECT count(*) AS total, " + ", ".join(f"""count(*) FILTER ("ESTADO_VALIDACION" = '{s}') AS {n}""" for n, s in _COUNTED.items()) + f""", count(*) FILTER ("ALERTAS" <> '') AS con_alerta FROM ({_BOTH_SQL}) z""")
def validation_counts(spark, sf_dir):
    return profile.statistics(_both(spark, sf_dir), "cuit")


_ONE_FITS = f"'{identity.SUBJECT_FITS}', '{identity.OTHER_NAME}'"


@query(
    "subject_validation",
    f"""WITH {_registry_sql(f"SELECT id, '' AS c, n AS d, nm FROM ({ASKED}) q")},
    s AS (SELECT a.*, coalesce(nd, 0) AS nd, bd AS b, CASE WHEN length(d) < 6 THEN 'DNI demasiado corto (' || length(d) || ' dígitos): ''' || d || '''' WHEN length(d) > 8 THEN 'DNI demasiado largo (' || length(d) || ' dígitos): ''' || d || '''' WHEN replace(d, substr(d, 1, 1), '') = '' THEN 'DNI de relleno (todos los dígitos iguales): ''' || d || '''' END AS why FROM asked a LEFT JOIN told USING (id)),
    t AS (SELECT *, CASE WHEN why IS NOT NULL THEN '{identity.BAD_DNI}' WHEN nd = 0 THEN '{identity.NOT_FOUND}' WHEN nd > 1 THEN '{identity.PENDING}' WHEN b.pct >= 90 THEN '{identity.SUBJECT_FITS}' ELSE '{identity.OTHER_NAME}' END AS st FROM s)
    SELECT id, d AS "DNI", st AS "ESTADO_VALIDACION", CASE WHEN st IN ({_ONE_FITS}) THEN b.fc END AS "CUIT_ASIGNADO", CASE WHEN st IN ({_ONE_FITS}) THEN b.pct ELSE 0.0 END AS "PORCENTAJE", cast(CASE WHEN why IS NULL THEN nd ELSE 0 END AS INT) AS "CANDIDATOS",
    CASE st WHEN '{identity.BAD_DNI}' THEN why WHEN '{identity.NOT_FOUND}' THEN '' WHEN '{identity.PENDING}' THEN nd || ' personas distintas comparten este DNI (difieren en el prefijo del CUIT): requiere decisión manual' ELSE b.al END AS "ALERTAS" FROM t""",
)
def subject_validation(spark, sf_dir):
    found = identity.validated_subjects(made(spark, sf_dir, ASKED), _snapshot(spark, sf_dir), "n", "nm", "id")
    return found.select("id", "DNI", "ESTADO_VALIDACION", "CUIT_ASIGNADO", "PORCENTAJE", "CANDIDATOS", "ALERTAS")


@query("partial_search", f"""SELECT "CUIT", "DENOMINACION" FROM {_SNAP} r WHERE contains(dn, '14') OR contains(cn, '14') ORDER BY dn, cn LIMIT 200""")
def partial_search(spark, sf_dir):
    from contactdq.sources.registry import partial_search as search

    return search(_snapshot(spark, sf_dir), "14").select("CUIT", "DENOMINACION")


@query(
    "low_marks",
    f"""SELECT "CUIT", coalesce("MARCA_BAJA", '') = '*' AS baja, CASE WHEN "MARCA_BAJA" = '*' THEN 'Marcado como BAJA en el padrón' WHEN "MARCA_BAJA" = 'Q' THEN 'MARCA_BAJA con valor no reconocido: ''Q'' (se trata como activo)' ELSE '' END AS nota FROM ({REGISTRY}) s""",
)
def low_marks(spark, sf_dir):
    low, note = identity.low_mark(F.col("MARCA_BAJA"))
    return _snapshot(spark, sf_dir).select("CUIT", low.alias("baja"), note.alias("nota"))


# Cells, phones, profiles ---------------------------------------------------------------------------------------------

CELLS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'no tiene' WHEN 1 THEN cast(c_custkey AS STRING) || ' | ' || cast(c_custkey AS STRING) || ';' || c_mktsegment WHEN 2 THEN '' WHEN 3 THEN NULL ELSE c_name || ',,' || c_mktsegment END AS tel, CASE WHEN c_custkey % 3 = 0 THEN 'a@b.c, d@e.f' END AS mail, c_mktsegment AS zona FROM customer"
_CELL_SQL = f"""WITH c AS ({CELLS}), v AS (
 SELECT id, m, v FROM (SELECT id, 'tel' AS m, trim(unnest(regexp_split_to_array(tel, '[|;,]'))) AS v FROM c UNION SELECT id, 'mail', trim(unnest(regexp_split_to_array(mail, '[|;,]'))) FROM c) u WHERE v <> '' AND v <> 'no tiene')
 SELECT c.id, CASE WHEN m = 'tel' THEN v ELSE '' END AS tel, CASE WHEN m = 'mail' THEN v ELSE '' END AS mail, c.zona FROM c LEFT JOIN v USING (id)"""


@query("explode_media", _CELL_SQL)
def explode_media(spark, sf_dir):
    return normalise.exploded(made(spark, sf_dir, CELLS), "id", ["tel", "mail"], ["zona"])


@query("explode_counts", f"SELECT (SELECT count(*) FROM customer) AS filas_origen, (SELECT count(DISTINCT c_custkey) FROM customer) AS claves, count(*) AS filas_resultado, count(*) FILTER (tel <> '') + count(*) FILTER (mail <> '') AS valores FROM ({_CELL_SQL}) z")
def explode_counts(spark, sf_dir):
    cells = made(spark, sf_dir, CELLS)
    return normalise.counts(cells, normalise.exploded(cells, "id", ["tel", "mail"]), "id", ["tel", "mail"])


NINE = "lpad(cast((c_custkey * 7919) % 10000000 AS STRING), 7, '4')"
PHONES = f"SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '(011) 15-4' || {NINE} WHEN 1 THEN '011 4' || {NINE} WHEN 2 THEN '+54 9 11 4' || {NINE} WHEN 3 THEN '114' || {NINE} WHEN 4 THEN 'Cel: 0223 15 ' || {NINE} WHEN 5 THEN '+598 9' || {NINE} WHEN 6 THEN CASE WHEN c_custkey % 3 = 0 THEN '0054 11 4' || {NINE} WHEN c_custkey % 3 = 1 THEN '02966 15 ' || substr({NINE}, 2) ELSE '595 21 ' || {NINE} END ELSE CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN cast(c_custkey AS STRING) ELSE '5411' || {NINE} || '0' END END AS tel FROM customer"


# The cleaning rules in plain SQL, step by step.
_CLEAN_SQL = f"""WITH a AS (SELECT id, trim(tel) AS raw, regexp_replace(trim(regexp_replace(tel, '(?i)\\b(tel|telefono|cel|celular|whatsapp|wsp|wpp|movil|fijo|contacto|llamar|int|interno)\\b\\.?:?', ' ', 'g')), '^00', '+') AS p FROM ({PHONES}) s),
 b AS (SELECT *, regexp_replace(p, '[^0-9]', '', 'g') AS d, starts_with(regexp_replace(p, '[^0-9+]', '', 'g'), '+') AS plus FROM a),
 c AS (SELECT *, CASE WHEN length(d) > 7 AND starts_with(d, '54') THEN '54' WHEN length(d) > 8 AND starts_with(d, '595') THEN '595' WHEN length(d) > 8 AND starts_with(d, '598') THEN '598' WHEN length(d) > 7 AND starts_with(d, '55') THEN '55' WHEN length(d) > 7 AND starts_with(d, '56') THEN '56' END AS code FROM b),
 n AS (SELECT *, coalesce(code, '54') AS pais, CASE WHEN code IS NULL THEN d ELSE substr(d, length(code) + 1) END AS n1 FROM c),
 m AS (SELECT *, CASE WHEN pais = '54' AND regexp_full_match(n1, '9[0-9]{{10}}') THEN substr(n1, 2) ELSE n1 END AS n2 FROM n),
 t AS (SELECT *, CASE WHEN length(n2) > 1 AND starts_with(n2, '0') THEN substr(n2, 2) ELSE n2 END AS n3 FROM m),
 f AS (SELECT *, CASE WHEN pais <> '54' OR length(n3) <> 12 THEN 0 WHEN starts_with(n3, '1115') THEN 2 WHEN substr(n3, 4, 2) = '15' THEN 3 WHEN substr(n3, 5, 2) = '15' THEN 4 WHEN substr(n3, 3, 2) = '15' THEN 2 ELSE 0 END AS spot FROM t)
 SELECT id, CASE WHEN d <> '' THEN '+' || pais || CASE WHEN spot > 0 THEN left(n3, spot) || substr(n3, spot + 3) ELSE n3 END END AS "E164", CASE WHEN d <> '' THEN pais END AS "PREFIJO_PAIS", CASE WHEN d = '' THEN NULL WHEN code IS NULL THEN 'asumido' WHEN plus THEN 'explicito' ELSE 'detectado' END AS "ORIGEN_PAIS",
  d <> '' AND (regexp_replace(raw, '[^0-9+]', '', 'g') <> raw OR code IS NULL OR n1 <> n2 OR n2 <> n3 OR spot > 0 OR starts_with(raw, '00')) AS changed FROM f"""


@query("phone_clean", f'SELECT id, "E164", "PREFIJO_PAIS", "ORIGEN_PAIS" FROM ({_CLEAN_SQL}) z')
def phone_clean(spark, sf_dir):
    return phones.cleaned_cells(made(spark, sf_dir, PHONES), "id", "tel").select(F.col("ID_ORIGEN").alias("id"), "E164", "PREFIJO_PAIS", "ORIGEN_PAIS")


@query("phone_counts", f"""SELECT count(*) AS total, count(*) FILTER (changed) AS depurados, count(*) FILTER (NOT changed) AS sin_cambios, count(*) FILTER ("ORIGEN_PAIS" = 'asumido') AS pais_asumido, count(*) FILTER ("E164" IS NULL) AS sin_numero FROM ({_CLEAN_SQL}) z""")
def phone_counts(spark, sf_dir):
    return profile.statistics(phones.cleaned_cells(made(spark, sf_dir, PHONES), "id", "tel"), "dep_telefonos")


FILLERS = "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN repeat(cast(c_custkey % 10 AS STRING), 7) WHEN 1 THEN '7890123' WHEN 2 THEN '3210987' WHEN 3 THEN repeat(lpad(cast(c_custkey % 100 AS STRING), 2, '0'), 3) WHEN 4 THEN repeat(lpad(cast(c_custkey % 1000 AS STRING), 3, '0'), 3) ELSE '4123456' END AS n FROM customer"


@query(
    "filler_detector",
    f"""SELECT id, length(n) >= 6 AND (replace(n, left(n, 1), '') = '' OR len(list_filter(steps, lambda s: s <> 1)) = 0 OR len(list_filter(steps, lambda s: s <> 9)) = 0 OR (length(n) % 2 = 0 AND repeat(left(n, 2), length(n) // 2) = n) OR (length(n) % 3 = 0 AND length(n) >= 9 AND repeat(left(n, 3), length(n) // 3) = n)) AS relleno
    FROM (SELECT *, list_transform(range(1, length(n)), lambda i: (10 + cast(substr(n, i + 1, 1) AS INT) - cast(substr(n, i, 1) AS INT)) % 10) AS steps FROM ({FILLERS}) s) k""",
)
def filler_detector(spark, sf_dir):
    return made(spark, sf_dir, FILLERS).select("id", phones.is_filler(F.col("n")).alias("relleno"))


# Telephone cells of every kind that can be judged without numbering plans; a ninth need plans.
CALLS = "SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'No  tiene' WHEN 1 THEN '' WHEN 2 THEN 'tel 12-' || cast(c_custkey % 1000 AS STRING) WHEN 3 THEN repeat(cast(c_custkey % 10 AS STRING), 8) WHEN 4 THEN '7890123' WHEN 5 THEN 'Cel: 321 0987' WHEN 6 THEN repeat(lpad(cast(c_custkey % 100 AS STRING), 2, '0'), 4) WHEN 7 THEN repeat(lpad(cast(c_custkey % 1000 AS STRING), 3, '0'), 3) ELSE '+54 11 4' || lpad(cast((c_custkey * 7919) % 10000000 AS STRING), 7, '4') END AS tel FROM customer"
_CALL_SQL = f"""WITH c AS (SELECT id, tel, regexp_replace(tel, '[^0-9]', '', 'g') AS d FROM ({CALLS}) s), k AS (SELECT *, list_transform(range(1, length(d)), lambda i: (10 + cast(substr(d, i + 1, 1) AS INT) - cast(substr(d, i, 1) AS INT)) % 10) AS steps FROM c)
 SELECT id, CASE WHEN trim(tel) = '' THEN 'Teléfono vacío o nulo' WHEN regexp_replace(lower(tel), '[^a-z]', '', 'g') = 'notiene' THEN 'Texto corresponde a ''no posee teléfono'' (no es un número)' WHEN length(d) < 6 THEN 'No contiene suficientes dígitos para ser un teléfono'
  WHEN replace(d, left(d, 1), '') = '' THEN 'Todos los dígitos son iguales (' || d || '): número de relleno' WHEN len(list_filter(steps, lambda s: s <> 1)) = 0 THEN 'Secuencia ascendente de dígitos (' || d || '): número de relleno' WHEN len(list_filter(steps, lambda s: s <> 9)) = 0 THEN 'Secuencia descendente de dígitos (' || d || '): número de relleno'
  WHEN length(d) % 2 = 0 AND repeat(left(d, 2), length(d) // 2) = d THEN 'Patrón ''' || left(d, 2) || ''' repetido (' || d || '): número de relleno' WHEN length(d) % 3 = 0 AND length(d) >= 9 AND repeat(left(d, 3), length(d) // 3) = d THEN 'Patrón ''' || left(d, 3) || ''' repetido (' || d || '): número de relleno'
  ELSE 'Librería ''phonenumbers'' no instalada (pip install phonenumbers)' END AS "MOTIVO", 0 AS "VALIDO" FROM k"""


@query("phone_verdicts", _CALL_SQL)
def phone_verdicts(spark, sf_dir):
    return phones.validated(made(spark, sf_dir, CALLS), "tel").select("id", "MOTIVO", F.col("VALIDO").cast("int").alias("VALIDO"))


@query("phone_verdict_counts", f"""SELECT count(*) AS total, count(*) FILTER ("VALIDO" = 1) AS validos, count(*) FILTER ("VALIDO" = 0) AS bajas, count(*) FILTER ("VALIDO" > 1) AS moviles, count(*) FILTER ("VALIDO" > 1) AS fijos FROM ({_CALL_SQL}) z""")
def phone_verdict_counts(spark, sf_dir):
    told = phones.validated(made(spark, sf_dir, CALLS), "tel").withColumns({"VALIDO": F.col("VALIDO").cast("int"), "TIPO_LINEA": F.lit(None).cast("string")})
    return profile.statistics(told, "telefonos")


@query("comparison_counts", f"""SELECT count(*) AS total, count(*) FILTER ("MOTIVO" = 'COINCIDENCIA EXACTA') AS exactas, count(*) FILTER ("MOTIVO" = 'SIN RELACION') AS sin_relacion, count(*) FILTER ("MOTIVO" = 'ALGORITMOS EN DESACUERDO') AS en_desacuerdo, round(avg("R_DISPERSION"), 2) AS dispersion_promedio FROM ({_ALL_METRICS_SQL}) z""")
def comparison_counts(spark, sf_dir):
    return profile.statistics(_all_compared(spark, sf_dir), "comparacion").drop("por_motivo")


@query("profile_columns", "SELECT * FROM (SELECT 'c_name' AS columna, count(*) FILTER (c_name IS NULL) AS nulos, count(*) FILTER (trim(c_name) = '') AS blancos, count(DISTINCT c_name) AS distintos, min(length(c_name)) AS largo_min, max(length(c_name)) AS largo_max FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), count(*) FILTER (trim(c_mktsegment) = ''), count(DISTINCT c_mktsegment), min(length(c_mktsegment)), max(length(c_mktsegment)) FROM customer) z")
def profile_columns(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@query("first_unique", "SELECT event_type, min(event_id) AS primera FROM events GROUP BY 1")
def first_unique(spark, sf_dir):
    return profile.first_unique(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("budget_cut", "SELECT user_id, min(event_id) AS primera FROM events GROUP BY 1 ORDER BY primera LIMIT 33")
def budget_cut(spark, sf_dir):
    return profile.within_budget(profile.first_unique(table(spark, sf_dir, "events"), "user_id", "event_id"), "primera", 100, 3)


# E-mail --------------------------------------------------------------------------------------------------------------

MAILS = """SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN 'Jose' || n || '@gmeil.com' WHEN 1 THEN 'ana' || n || ' arroba hotmail punto com' WHEN 2 THEN 'luis.maria@hotmail.con' WHEN 3 THEN 'notiene@nomail.com'
 WHEN 4 THEN 'juan@fibertel.com.ar' WHEN 5 THEN '' WHEN 6 THEN 'mailto:pedro@gmail.com.ar' WHEN 7 THEN 'carlos#yahoo.com' WHEN 8 THEN 'mariagmail.com' WHEN 9 THEN 'ana lucia@outlook.com;' WHEN 10 THEN 'ab12@gmail.com'
 WHEN 11 THEN 'roberto@hotmail' WHEN 12 THEN 'roberto@hotmail.com.uru' ELSE 'ana?lucia@gmail.com' END AS mail FROM (SELECT c_custkey, cast(c_custkey AS STRING) AS n FROM customer) s"""
_MAIL_SQL = """SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN 'jose' || n || '@gmail.com' WHEN 1 THEN 'ana' || n || '@hotmail.com' WHEN 2 THEN 'luis.maria@hotmail.com' WHEN 3 THEN 'notiene@nomail.com' WHEN 4 THEN 'juan@fibertel.com.ar' WHEN 5 THEN ''
 WHEN 6 THEN 'pedro@gmail.com' WHEN 7 THEN 'carlos@yahoo.com' WHEN 8 THEN 'maria@gmail.com' WHEN 9 THEN 'ana.lucia@outlook.com' WHEN 10 THEN 'ab12@gmail.com' WHEN 11 THEN 'roberto@hotmail.com' WHEN 12 THEN 'roberto@hotmail.com' ELSE 'ana?lucia@gmail.com' END AS "MAIL_DEPURADO",
 c_custkey % 14 NOT IN (3, 4, 5, 10, 13) AS "FUE_DEPURADO", CASE WHEN c_custkey % 14 IN (0, 1, 3, 5, 10) THEN 'INVALIDO' WHEN c_custkey % 14 = 13 THEN 'REVISION' ELSE 'VALIDO' END AS "ESTADO" FROM (SELECT c_custkey, cast(c_custkey AS STRING) AS n FROM customer) s"""


def _mails(spark, sf_dir) -> DataFrame:
    from contactdq.operators import mails

    return mails.processed(made(spark, sf_dir, MAILS), "mail")


@query("mail_clean_validate", _MAIL_SQL)
def mail_clean_validate(spark, sf_dir):
    return _mails(spark, sf_dir).select("id", "MAIL_DEPURADO", "FUE_DEPURADO", "ESTADO")


@query("mail_row_states", f"""SELECT s AS "ESTADO", count(*) AS "CANTIDAD" FROM (SELECT CASE WHEN "ESTADO" = 'REVISION' THEN 'REVISION MANUAL' WHEN "ESTADO" = 'INVALIDO' THEN 'BAJA' WHEN "FUE_DEPURADO" THEN 'MODIFICADO' ELSE 'CONSERVADO' END AS s FROM ({_MAIL_SQL}) m) z GROUP BY 1""")
def mail_row_states(spark, sf_dir):
    from contactdq.operators import mails

    return mails.row_states(_mails(spark, sf_dir)).groupBy("ESTADO").agg(F.count("*").alias("CANTIDAD"))


FINDINGS = """SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'carlos@yahoo.com' WHEN 1 THEN 'ana?lucia@gmail.com' ELSE 'notiene@nomail.com' END AS "MAIL", event_type AS "PROVEEDOR", CASE WHEN event_type < 'm' THEN 'Registered' ELSE 'Not Found' END AS "ESTADO_OSINT" FROM events"""


@query("verdict_lattice", f"""SELECT m.id, CASE WHEN f.p IS NOT NULL AND "ESTADO" = 'REVISION' THEN 'VALIDO' WHEN f.p IS NOT NULL AND "ESTADO" = 'VALIDO' THEN 'VALIDO_CONFIRMADO' ELSE "ESTADO" END AS "ESTADO", f.p AS "PROVEEDORES_REGISTRADO"
 FROM ({_MAIL_SQL}) m LEFT JOIN (SELECT "MAIL", string_agg("PROVEEDOR", ', ' ORDER BY "PROVEEDOR") AS p FROM ({FINDINGS}) g WHERE "ESTADO_OSINT" = 'Registered' GROUP BY 1) f ON f."MAIL" = m."MAIL_DEPURADO\"""")
def verdict_lattice(spark, sf_dir):
    from contactdq.operators import mails

    return mails.confirmed(_mails(spark, sf_dir), made(spark, sf_dir, FINDINGS.replace('"', ""))).select("id", "ESTADO", "PROVEEDORES_REGISTRADO")


# Incremental runs and audit ------------------------------------------------------------------------------------------


@query("incremental_new_rows", "SELECT event_id, user_id FROM events WHERE event_id % 10 >= 3")
def incremental_new_rows(spark, sf_dir):
    from contactdq.streaming.incremental import new_rows

    events = table(spark, sf_dir, "events")
    return new_rows(events.select("event_id", "user_id"), events.filter("event_id % 10 < 3").select("event_id"), "event_id")


@query("audit_json")
def audit_json(spark, sf_dir):
    from contactdq.sources.publish import audit

    return audit(_mails(spark, sf_dir).filter("FUE_DEPURADO"), "MAILS", "engine", "id", ["mail"], ["MAIL_DEPURADO", "ESTADO"])


@query("history_merge", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.v ELSE b.v END AS v FROM (SELECT c_custkey AS k, 'stored' AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, 'live' AS v FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def history_merge(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("t"))
    stored, live = customers.filter("k % 2 = 0").withColumn("v", F.lit("stored")), customers.filter("k % 3 = 0").withColumn("v", F.lit("live"))
    return profile.newest(stored, live, "k", "t").select("k", "v")


@query("mail_agent", """SELECT c_custkey AS id, CASE WHEN c_custkey % 14 IN (0, 1, 3, 5, 10) THEN 'BAJA' WHEN c_custkey % 14 = 13 THEN 'REVISION MANUAL' WHEN c_custkey % 14 = 4 THEN 'CONSERVADO' ELSE 'MODIFICADO' END AS "ESTADO",
 CASE c_custkey % 14 WHEN 2 THEN 'luis.maria@hotmail.com' WHEN 4 THEN 'juan@fibertel.com.ar' WHEN 6 THEN 'pedro@gmail.com' WHEN 7 THEN 'carlos@yahoo.com' WHEN 8 THEN 'maria@gmail.com' WHEN 9 THEN 'ana.lucia@outlook.com' WHEN 11 THEN 'roberto@hotmail.com' WHEN 12 THEN 'roberto@hotmail.com' END AS "MAIL_DEPURADO" FROM customer""")
def mail_agent(spark, sf_dir):
    from contactdq.operators import mail_agent as agent

    return agent.processed(made(spark, sf_dir, MAILS), "mail").select("id", "ESTADO", "MAIL_DEPURADO")


@query("mail_agent_counts", "SELECT count(*) AS total, count(*) FILTER (c_custkey % 14 = 4) AS conservados, count(*) FILTER (c_custkey % 14 IN (2, 6, 7, 8, 9, 11, 12)) AS modificados, count(*) FILTER (c_custkey % 14 IN (0, 1, 3, 5, 10)) AS bajas, count(*) FILTER (c_custkey % 14 = 13) AS revision_manual FROM customer")
def mail_agent_counts(spark, sf_dir):
    from contactdq.operators import mail_agent as agent

    return profile.statistics(agent.processed(made(spark, sf_dir, MAILS), "mail"), "mails")


import contactdq.plans.flow_queries  # noqa: E402,F401  registers queries of its own
import contactdq.plans.rule_queries  # noqa: E402,F401  and this one
