"""Named queries whose SQL works out by rules what the operators say: verdicts on mails of many kinds of users and domains, domains put right by the list of typos, pairs compared one to one, audit rows."""

from __future__ import annotations


from contactdq.operators import linking, mails
from contactdq.plans import queries as base
from contactdq.plans.queries import _MAIL_SQL, MAILS, ORDER_PAIRS, PAIRS, QUERIES, made, query

# Verdicts on mails -----------------------------------------------------------------------------------------------------

_LISTS = mails.Lists()
_USERS = ("'ana'", "'Ana.' || n", "n", "'.ana'", "'luis.'", "'a..' || w", "'ab' || n", "'juan perez'", "'notiene'", "'sinmail' || n", "w", "'maria_' || n", "''", f"'{_LISTS.users[1]}'", "'mailto:' || w", "w || '+' || n", "'año' || w", "w || '?'")
_DOMAINS = (
    "'@gmail.com'", "'@Hotmail.com'", "'@x..y'", "'@-a.com'", "'@gmail'", "'@w' || w || '.aaa'", "'@sede.edu.ar'", f"'@{_LISTS.invalid[0]}'", "'@correo.com'", "'@dom.zzz'", "'@' || w || '.com.ar'", "'@a@b.com'", "'@g mail.com'", "' no posee'",
    "'@' || repeat('a', 25) || '.com'", "'@a.-b.com'", f"'@sub.{_LISTS.institutions[0]}.gob.ar'", "'@dom.' || repeat('b', 21)", "'@www' || w || '.com'",
)
_WORD = "translate(md5(cast(c_custkey AS STRING)), '0123456789', 'ghijklmnop')"
_CASE = lambda options, place: "CASE " + place + " " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"
# Users and domains come together in all ways as keys run on.
KINDS = f"""SELECT id, CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN repeat('x', 201) || '@gmail.com' ELSE {_CASE(_USERS, f'id % {len(_USERS)}')} || {_CASE(_DOMAINS, f'id % {len(_DOMAINS)}')} END AS mail
 FROM (SELECT c_custkey AS id, cast(c_custkey AS STRING) AS n, substr({_WORD}, 1, 3 + c_custkey % 7) AS w FROM customer) k"""


def _in(column: str, words) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"{column} IN ({quoted})"


_RULES = (
    ("raw IS NULL OR raw = ''", "INVALIDO", "'Correo vacío o nulo'"),
    (_in("regexp_replace(t, '[^a-z]', '', 'g')", _LISTS.no_mail), "INVALIDO", "'Texto corresponde a ''no posee email'' (no es un correo)'"),
    ("contains(t, '?')", "REVISION", "'Contiene ''?'' por pérdida de codificación anterior a esta tabla; no reconstruible con certeza'"),
    ("length(t) > 200", "REVISION", "'Supera la longitud máxima razonable (200 caracteres)'"),
    ("length(t) - length(replace(t, '@', '')) <> 1", "INVALIDO", "'Formato incorrecto (falta o excede el número de @)'"),
    ("NOT regexp_full_match(u, '[a-zA-ZñÑ0-9._+-]+')", "INVALIDO", "'Usuario contiene caracteres inválidos: ''' || u || ''''"),
    ("starts_with(u, '.') OR ends_with(u, '.')", "INVALIDO", "'Usuario empieza o termina con punto'"),
    ("contains(u, '..')", "INVALIDO", "'Usuario contiene puntos consecutivos ''..'''"),
    ("regexp_full_match(u, '[0-9]+')", "INVALIDO", "'Usuario puramente numérico: ''' || u || ''''"),
    ("regexp_matches(u, '[0-9]') AND longest < 5 AND letters < 6", "INVALIDO", "'Usuario con patrón de ID/teléfono (racha de letras máxima=' || longest || ', total letras=' || letters || '): ''' || u || ''''"),
    (_in("u", _LISTS.users), "INVALIDO", "'Usuario en lista negra de exclusión: ''' || u || ''''"),
    (f"regexp_matches(u, '{mails.NO_MAIL_USER}')", "INVALIDO", "'Usuario corresponde a un patrón de ''no posee email'''"),
    ("length(d) > 200", "REVISION", "'El dominio supera la longitud máxima razonable (200 caracteres)'"),
    ("NOT regexp_full_match(d, '[a-z0-9.-]+')", "INVALIDO", "'Dominio contiene caracteres inválidos: ''' || d || ''''"),
    ("regexp_matches(d, '^[.-]|[.-]$')", "INVALIDO", "'Dominio empieza o termina con punto/guión'"),
    ("contains(d, '..')", "INVALIDO", "'Dominio contiene puntos consecutivos ''..'''"),
    ("NOT contains(d, '.')", "INVALIDO", "'Dominio no contiene extensión (.TLD)'"),
    ("contains(d, '.-') OR contains(d, '-.')", "INVALIDO", "'Segmento de dominio con guión mal ubicado'"),
    ("length(labels[-1]) > 20", "REVISION", "'La extensión final supera los 20 caracteres'"),
    ("length(labels[-2]) > 20", "REVISION", "'Un segmento intermedio supera los 20 caracteres'"),
    (f"regexp_matches(d, '{'|'.join(c * 3 for c in 'abcdefghijklmnopqrstuvwxyz0123456789-')}') AND NOT {_in('d', _LISTS.valid)}", "INVALIDO", "'Dominio contiene 3+ caracteres repetidos consecutivos sin corresponder a ningún dominio reconocible (relleno no recuperable)'"),
    ("contains(d, 'edu.ar') OR contains(d, 'edu.uy')" + "".join(f" OR contains(d, '{w}')" for w in _LISTS.institutions), "VALIDO", "'Email válido'"),
    (_in("d", _LISTS.invalid), "INVALIDO", "'Dominio en lista negra: ''' || d || ''''"),
    ("regexp_matches(d, 'noposee|notiene|correo|ntiene')", "INVALIDO", "'Dominio corresponde a palabra clave inválida'"),
    ("NOT " + _in("labels[-1]", _LISTS.final_tlds), "INVALIDO", "'TLD final no válido: ''.' || labels[-1] || ''''"),
)
_VERDICT_SQL = f"""WITH c AS (SELECT id, mail AS raw, regexp_replace(lower(trim(coalesce(mail, ''))), '^mailto:', '') AS t FROM ({KINDS}) s), p AS (SELECT *, split_part(t, '@', 1) AS u, split_part(t, '@', -1) AS d FROM c),
 r AS (SELECT *, string_split(d, '.') AS labels, list_transform(regexp_extract_all(u, '[a-zñ]+'), lambda x: length(x)) AS runs FROM p), l AS (SELECT *, coalesce(list_max(runs), 0) AS longest, coalesce(list_sum(runs), 0)::INT AS letters FROM r)
 SELECT id, CASE {" ".join(f"WHEN {test} THEN '{state}'" for test, state, _ in _RULES)} ELSE 'VALIDO' END AS "ESTADO", CASE {" ".join(f"WHEN {test} THEN {why}" for test, _, why in _RULES)} ELSE 'Email válido' END AS "MOTIVO" FROM l"""


@query("mail_verdicts", _VERDICT_SQL)
def mail_verdicts(spark, sf_dir):
    return mails.validated(made(spark, sf_dir, KINDS), "mail").select("id", "ESTADO", "MOTIVO")


# Domains by the list of typos --------------------------------------------------------------------------------------------

_TYPOS = ", ".join(f"({i}, '{wrong}', '{right}')" for i, (wrong, right) in enumerate(sorted(_LISTS.typos.items())))
_TYPED = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Ana.' ELSE 'luis_' END || {_WORD} || '@' || CASE WHEN c_custkey % 2 = 0 THEN upper(wrong) ELSE wrong END AS mail FROM customer JOIN (VALUES {_TYPOS}) v(k, wrong, meant) ON k = c_custkey % {len(_LISTS.typos)}"
# What the list names is what a domain becomes, unless that is a provider whose country ending is put right after it; such meanings are left to the unit tests.
_SETTLED = [right for right in sorted(set(_LISTS.typos.values())) if mails.repaired_domain(right, _LISTS)[0] == right]
_PLAIN = [wrong for wrong, right in sorted(_LISTS.typos.items()) if right in _SETTLED and mails.cut_after_known(wrong, _LISTS) == wrong and mails._unrepeated(wrong, _LISTS) == wrong and wrong not in _LISTS.invalid]
TYPED = f"SELECT * FROM ({_TYPED}) t WHERE {_in('lower(substring_index(mail, chr(64), -1))', _PLAIN)}"


@query("mail_typos", f"""SELECT id, lower(split_part(mail, '@', 1)) || '@' || meant AS "MAIL_DEPURADO", true AS "FUE_DEPURADO" FROM ({TYPED.replace("substring_index(mail, chr(64), -1)", "split_part(mail, '@', -1)")}) s JOIN (VALUES {_TYPOS}) v(k, wrong, meant) ON wrong = lower(split_part(mail, '@', 2))""")
def mail_typos(spark, sf_dir):
    return mails.cleaned(made(spark, sf_dir, TYPED), "mail").select("id", "MAIL_DEPURADO", "FUE_DEPURADO")


# Pairs one to one ----------------------------------------------------------------------------------------------------------


def _paired_sql(pairs: str) -> str:
    key = lambda c: f"trim(regexp_replace(regexp_replace(upper(trim({c})), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    tokens = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda t: length(t) >= 2 AND t NOT IN {base._STOP}))"
    alike = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_winkler_similarity({a}, {b}) END"
    return f"""WITH p AS (SELECT a_id, b_id, trim(a) AS na, trim(b) AS nb, {key('a')} AS x, {key('b')} AS y FROM ({pairs}) s), t AS (SELECT *, {tokens('x')} AS tx, {tokens('y')} AS ty, array_to_string(list_sort(string_split(x, ' ')), ' ') AS ox, array_to_string(list_sort(string_split(y, ' ')), ' ') AS oy FROM p),
 m AS (SELECT *, {alike('x', 'y')} AS jw, {alike('ox', 'oy')} AS jwo, levenshtein(x, y) AS lev, damerau_levenshtein(x, y) AS dam, len(list_intersect(tx, ty)) AS c FROM t),
 q AS (SELECT *, CASE WHEN least(len(tx), len(ty)) = 0 THEN 0.0 ELSE c / least(len(tx), len(ty)) END AS ov, CASE WHEN len(tx) + len(ty) = 0 THEN 0.0 ELSE 2 * c / (len(tx) + len(ty)) END AS di, CASE WHEN len(tx) + len(ty) = c THEN 0.0 ELSE c / (len(tx) + len(ty) - c) END AS ja FROM m),
 w AS (SELECT *, greatest(jwo, di) AS best, abs(jwo - di) >= 0.25 AS wide, x <> y AND ox <> oy AS other FROM q)
 SELECT a_id, b_id, round(jw, 6) AS "JARO_WINKLER", round(jwo, 6) AS "JARO_WINKLER_ORD", round(di, 6) AS "DICE", left(concat_ws('; ', CASE WHEN x = y THEN CASE WHEN na = nb THEN 'IDENTICO' ELSE 'IDENTICO_NORMALIZADO' END WHEN ox = oy THEN 'ORDEN_DE_TOKENS_INVERTIDO' END,
  CASE WHEN other AND dam < lev THEN 'TRANSPOSICION_DE_CARACTERES(' || (lev - dam) || ')' END, CASE WHEN other AND ov >= 0.999 AND ja < 0.999 THEN 'SUBCONJUNTO_TOKENS(sobran=' || (len(tx) + len(ty) - 2 * c) || ')' END, CASE WHEN other AND jwo - jw >= 0.10 THEN 'MEJORA_AL_ORDENAR_TOKENS' END,
  CASE WHEN other AND c = 0 THEN 'SIN_TOKENS_EN_COMUN' END, CASE WHEN best < 0.92 AND best >= 0.80 THEN 'ZONA_GRIS(score=' || printf('%.4f', best) || ')' END,
  CASE WHEN wide THEN 'DESACUERDO_ENTRE_FAMILIAS(' || CASE WHEN jwo > di THEN 'EDICION_SOBRE_CONJUNTOS' ELSE 'CONJUNTOS_SOBRE_EDICION' END || ', jw_ord=' || printf('%.3f', jwo) || ', dice=' || printf('%.3f', di) || ')' END), 200) AS "MOTIVO",
  CASE WHEN best >= 0.92 THEN CASE WHEN wide THEN 'RE' ELSE 'SI' END WHEN best >= 0.80 THEN 'RE' ELSE 'NO' END AS "COINCIDE", 1 AS "RANKING" FROM w"""


query("paired_match", _paired_sql(PAIRS))(QUERIES["paired_match"])
query("paired_match_all", _paired_sql(ORDER_PAIRS))(QUERIES["paired_match_all"])

# Rows that share an id on the base side, the least name of which counts.
REPEATED = "SELECT p_partkey % 50 AS bid, p_name AS bn FROM part"
_LEAST = "SELECT p_partkey % 50 AS bid, min(p_name) AS bn FROM part GROUP BY 1"


@query("blocking_repeated_ids", base._MATCH_SQL.replace(base.RIGHT, _LEAST))
def blocking_repeated_ids(spark, sf_dir):
    got = linking.cross_match(made(spark, sf_dir, base.LEFT), made(spark, sf_dir, REPEATED), 5, "id", "n", "bid", "bn")
    return got.select("ID_ARCHIVO", "ID_BASE", "JARO_WINKLER", "JARO_WINKLER_ORD", "LEVENSHTEIN", "DAMERAU", "DICE", "JACCARD", "COINCIDE", "RANKING")


# Audit -----------------------------------------------------------------------------------------------------------------------

query(
    "audit_json",
    f"""SELECT 'MAILS' AS "TABLA", 'UPDATE' AS "OPERACION", cast(m.id AS VARCHAR) AS "ID_REGISTRO", cast(json_object('mail', m.mail) AS VARCHAR) AS "DATOS_ANTES", cast(json_object('ESTADO', v."ESTADO", 'MAIL_DEPURADO', v."MAIL_DEPURADO") AS VARCHAR) AS "DATOS_DESPUES", 'engine' AS "USUARIO_BD"
 FROM ({MAILS}) m JOIN ({_MAIL_SQL}) v ON v.id = m.id WHERE v."FUE_DEPURADO\"""",
)(QUERIES["audit_json"])
