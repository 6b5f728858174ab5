"""Whole flows: linking with bounds, conflicts of hot ids, phones by a plan, previews, a table cleaned where it stands, the registry by both keys, the fitted second opinion."""

import hashlib
import json
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactdq.functions import letters, text
from contactdq.functions import similarity as S
from contactdq.operators import identity, linking, mail_agent, mail_features, mails, names, phones, profile
from contactdq.plans import processes
from contactdq.plans.schemas import with_audit_columns
from contactdq.sources import files, publish, scan, workbook

NOW = datetime(2026, 1, 2, 3, 4, 5)


# Linking


def spelled(rnd, k):
    return "".join(rnd.choices("abcdefghijklmnop", k=k))


def contacts(seed):
    """Names of frequent words and a rare one, on one side with slips of every kind; some of frequent words only."""
    rnd = random.Random(seed)
    common = [spelled(rnd, 6) for _ in range(5)]
    base = [f"{rnd.choice(common)} {rnd.choice(common)} {spelled(rnd, rnd.randrange(3, 9))}" for _ in range(120)] + [" ".join(rnd.sample(common, 3)) for _ in range(20)]
    asked = []
    for i in range(60):
        words = rnd.choice(base).split()
        kind = i % 6
        if kind == 0:
            rnd.shuffle(words)
        elif kind == 1:
            words[2] = words[2][:-1] + "q"
        elif kind == 2:
            words[2] = spelled(rnd, 7)
        elif kind == 3:
            words = [words[0], words[2]]
        elif kind == 4:
            words = words[:2]
        asked.append(" ".join(words))
    return asked, base


@pytest.mark.parametrize("rare,k", [(2, 5), (2, 1), (50, 5)])
def test_bounds_lose_no_pair_of_the_best(spark, rare, k, monkeypatch):
    asked, base = contacts(rare + k)
    left = spark.createDataFrame(list(enumerate(asked)), "i long, n string")
    right = spark.createDataFrame(list(enumerate(base)), "b long, m string")
    keyed = lambda d, c: {r.CLAVE: [t for t in r.TOKENS] for r in names.classified(d, c).select("CLAVE", "TOKENS").collect()}
    xs, ys = keyed(left, "n"), keyed(right, "m")
    score = lambda x, y: max(round(S.jaro_winkler_of(" ".join(sorted(x.split())), " ".join(sorted(y.split()))), 6), round(2 * len(set(xs[x]) & set(ys[y])) / (len(xs[x]) + len(ys[y])), 6))
    long = lambda t: {w for w in t if len(w) >= 4}
    got = linking.best_pairs(spark.createDataFrame(list(xs.items()), "CLAVE string, TOKENS array<string>"), spark.createDataFrame(list(ys.items()), "CLAVE string, TOKENS array<string>"), k, rare=rare).collect()
    told = {(r.x, r.y): r.score for r in got}
    assert len(told) == len(got)
    for x in xs:
        every = sorted((score(x, y) for y in ys if long(xs[x]) & long(ys[y])), reverse=True)
        mine = sorted((s for (a, _), s in told.items() if a == x), reverse=True)
        assert mine[:k] == pytest.approx(every[:k], abs=2e-6)
        if len(every) >= k:  # ties with the last of the best are all there
            assert sum(s >= every[k - 1] - 1e-9 for s in every) == sum(s >= every[k - 1] - 1e-9 for s in mine)


def test_five_of_a_letter_are_five(spark):
    """Letters told apart as bits: a fifth one must not fall on another letter's bit, else the bound is below the score."""
    x, y = "OLD WIDGET 645E6QFDD05D", "OLD WIDGET 645E6BFDD05D X3289"
    spelled = lambda key, side: linking._spelled(spark.createDataFrame([(key, key.split())], "CLAVE string, TOKENS array<string>"), side)
    bound = spelled(x, "x").crossJoin(spelled(y, "y")).selectExpr("*", "2 AS open").select(linking._bound().alias("b")).first().b
    assert bound >= S.jaro_winkler_of(" ".join(sorted(x.split())), " ".join(sorted(y.split())))


@pytest.mark.parametrize("tail,most", [("", 1000), (" X1234567", 0)])
def test_few_pairs_are_looked_up_for_high_floors(spark, tail, most):
    """Of 4,000 pairs that share a token, those without rare letters in common are not met, and none where the lengths alone keep the score below the floor."""
    words = lambda i, salt, end="": "WIDGET " + hashlib.md5(f"{salt}{i}".encode()).hexdigest()[:12].upper() + end
    spelled = lambda keys, side: linking._spelled(spark.createDataFrame([(key, key.split()) for key in keys], "CLAVE string, TOKENS array<string>"), side)
    held = spelled([words(i, "a") for i in range(20)], "x").selectExpr("x", "lx", "mx", "array('WIDGET') AS ts", "1 AS open", "0.95D AS floor")
    base = spelled([words(i, "b", tail) for i in range(200)], "y").selectExpr("*", "'WIDGET' AS t")
    assert linking._looked_up(held, base).count() <= most


def test_a_left_key_without_a_floor_meets_its_best_only(spark):
    """Of 12,000 pairs of keys whose floors tell nothing only those come out that can be among the best of their left key."""
    words = lambda i, salt: "WIDGET " + hashlib.md5(f"{salt}{i}".encode()).hexdigest()[:12].upper()
    asked, base = [words(i, "a") for i in range(20)], [words(i, "b") for i in range(600)]
    spelled = lambda keys, side: linking._spelled(spark.createDataFrame([(key, key.split()) for key in keys], "CLAVE string, TOKENS array<string>"), side)
    held = spelled(asked, "x").selectExpr("x", "lx", "mx", "array('WIDGET') AS ts", "1 AS open", "0.0D AS floor")
    got = {(r.x, r.y) for r in linking._looked_up(held, spelled(base, "y").selectExpr("*", "'WIDGET' AS t")).collect()}
    assert len(got) <= 400
    ordered = lambda key: " ".join(sorted(key.split()))
    for x in asked:
        score = {y: S.jaro_winkler_of(ordered(x), ordered(y)) for y in base}
        assert {y for y in base if score[y] >= sorted(score.values())[-5]} <= {y for a, y in got if a == x}


def _cell(keys):
    """Letters of sorted keys as ``linking._spelled`` tells them."""
    bits, more = np.zeros((len(keys), 3), np.uint64), np.zeros(len(keys), np.int32)
    for i, key in enumerate(keys):
        for c in set(key):
            for nth in range(key.count(c)):
                at = linking._ALPHABET.index(c) * linking._EACH + nth
                if nth < linking._EACH:
                    bits[i, at // linking._BITS] |= np.uint64(1 << at % linking._BITS)
                else:
                    more[i] += 1
    return bits, more, np.array([len(k.split()) for k in keys], np.int32)


@pytest.mark.parametrize("length", [3, 20, 64, 70])
def test_cells_lose_no_pair_that_reaches_its_floor(length, monkeypatch):
    """By rare letters, by all letters, with few candidates or many: every pair as good as the floor and the best five of the cell comes out."""
    rnd = random.Random(length)
    key = lambda n: "".join(rnd.choices("0123456789ABCDEF", k=n))
    base = [key(length) for _ in range(300)]
    slip = lambda y, n: "".join(key(1) if i in rnd.sample(range(length), n) else c for i, c in enumerate(y))
    asked = [slip(rnd.choice(base), rnd.randrange(3)) for _ in range(30)] + [key(rnd.randrange(1, length + 4)) for _ in range(10)]
    bits, more, words = _cell(asked)
    score = np.array([[S.jaro_winkler_of(x, y) for y in base] for x in asked])
    floor = np.array([rnd.choice([0.0, np.sort(s)[-3] - 1e-6]) for s in score])
    for small in (0, 1000):
        monkeypatch.setattr(letters, "SMALL", small)
        for many in (5, 10_000):
            monkeypatch.setattr(letters, "MANY", many)
            monkeypatch.setattr(letters, "FIRST", 40)
            for misses in range(5):
                x, y = letters.compared_cell({"sx": asked, "bits": bits, "more": more, "words": words, "open": np.zeros(40, np.int32), "floor": floor, "misses": np.full(40, misses)}, letters.Base(base, *_cell(base)), 5, 3)
                got = set(zip(x.tolist(), y.tolist()))
                assert len(got) == len(x)
                for i in range(40):
                    lack = lambda y: len(asked[i]) - sum((Counter(asked[i]) & Counter(y)).values())
                    wanted = {j for j in range(300) if score[i, j] >= max(floor[i], np.sort(score[i])[-5]) and (misses > 3 or lack(base[j]) <= misses)}
                    assert wanted <= {j for a, j in got if a == i}


def test_jaro_winkler_against_many():
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("ABC 0", k=n))
    for n in (1, 2, 3, 5, 31, 63, 64):
        base = letters.Base(keys := [word(n) for _ in range(50)], *_cell(keys))
        for key in (word(1), word(3), word(17), word(64), keys[7]):
            assert letters.jaro_winkler_against(key, base, np.arange(50)).tolist() == [S.jaro_winkler_of(key, y) for y in keys]


def test_each_pair_of_names_is_compared_once(spark, monkeypatch):
    seen, scores = [], linking.cross_scores
    monkeypatch.setattr(linking, "cross_scores", lambda pairs, *a: seen.append(pairs.count()) or scores(pairs, *a))
    rows = spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'ana perez', NULL) AS a", "'perez ana' AS b")
    got = linking.paired_match(rows, "a", "b")
    assert seen == [2]
    assert {(r.id % 2, r.MOTIVO, r.COINCIDE, r.RANKING) for r in got.collect()} == {(0, "ORDEN_DE_TOKENS_INVERTIDO", "SI", 1), (1, "UNO_DE_LOS_DOS_VACIO", "NO", 1)}
    stages = got._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert max(s.count("ArrowEvalPython") for s in stages) == 1


def test_a_task_holds_one_python_worker(spark):
    rows = spark.createDataFrame([(1, "ⒶNA Pérez", "perez ana"), (2, "ana", None)], "id long, a string, b string")
    got = linking.paired_match(rows, "a", "b")
    stages = got._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert max(s.count("ArrowEvalPython") for s in stages) == 1
    assert {(r.id, r.CLAVE_ARCHIVO, r.CLAVE_BASE) for r in got.collect()} == {(1, "ANA PEREZ", "PEREZ ANA"), (2, "ANA", "")}


def test_plain_names_need_no_table_of_letters(monkeypatch):
    monkeypatch.setattr(text, "_shown", lambda: pytest.fail("made"))
    assert text._undisguised.func(pd.Series([None, None], dtype=object)).tolist() == [None, None]
    monkeypatch.undo()
    assert text._undisguised.func(pd.Series([None, "ⒶNA", ""], dtype=object)).tolist() == [None, "ANA", ""]


def test_base_rows_of_one_id(spark):
    left = spark.createDataFrame([(1, "ana maria lopez")], "i long, n string")
    right = spark.createDataFrame([(7, "ana maria lopez"), (7, "ana maria gomez"), (7, None), (8, "ana lopez maria")], "b long, m string")
    got = linking.cross_match(left, right, 5, "i", "n", "b", "m").collect()
    assert sorted((r.ID_BASE, r.DENOM_BASE) for r in got) == [(7, "ana maria gomez"), (8, "ana lopez maria")]


def test_distances_of_many_pairs_at_once():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdé \U0001f600XYZ", k=rnd.randrange(0, 25)))
    left = [word() for _ in range(800)]
    right = [rnd.choice([word(), x[::-1], x[:4] + word(), x[1:] + x[:1], x]) for x in left]
    assert S.jaro_winkler_all(left, right).tolist() == [S.jaro_winkler_of(a, b) for a, b in zip(left, right)]
    assert S.damerau_all(left, right).tolist() == [S.damerau_of(a, b) for a, b in zip(left, right)]


# Conflicts


def plain_pass(rows, group, tag, margin, contested):
    by = {}
    for r in rows:
        if r["COINCIDE"] == "SI" and r[group] is not None:
            by.setdefault(r[group], []).append(r)
    for own in by.values():
        if not contested(own):
            continue
        own.sort(key=lambda r: (-max(r["JARO_WINKLER_ORD"] or 0, r["DICE"] or 0), r["ID"]))
        users = {(r["USERNAME"] or "").strip().lower() for r in own}
        gap = max(own[0]["JARO_WINKLER_ORD"] or 0, own[0]["DICE"] or 0) - max(own[1]["JARO_WINKLER_ORD"] or 0, own[1]["DICE"] or 0)
        for n, r in enumerate(own):
            if len(users) == 1 and users != {""}:
                text = "MISMA_ENTIDAD_MULTIPLE_PERFIL"
            elif gap >= margin:
                text = f"GANA_POR_MARGEN({gap:.4f})" if n == 0 else f"{tag}_PIERDE_POR_MARGEN"
            else:
                text = f"{tag}_EMPATE_SIN_EVIDENCIA"
            r["MOTIVO"] = f"{r['MOTIVO']}; {text}" if r["MOTIVO"] else text
            if not text.startswith(("MISMA", "GANA")):
                r["COINCIDE"] = "RE"


def test_conflicts_like_group_by_group(spark):
    """A base id has half of all rows; null ids compete for nothing."""
    rnd = random.Random(9)
    rows = [
        {
            "ID": i, "ID_ARCHIVO": str(rnd.randrange(300)), "ID_BASE": None if i % 10 == 0 else 1 if i % 2 else rnd.randrange(200), "USERNAME": rnd.choice(["", None, "Ana ", "ana", "bo"]), "JARO_WINKLER_ORD": rnd.choice([None, rnd.randrange(100) / 100]),
            "DICE": rnd.randrange(100) / 100, "MOTIVO": rnd.choice(["", "M"]), "COINCIDE": rnd.choice(["SI", "SI", "NO", "RE"]), "extra": i % 3,
        }
        for i in range(1500)
    ]
    schema = "ID long, ID_ARCHIVO string, ID_BASE long, USERNAME string, JARO_WINKLER_ORD double, DICE double, MOTIVO string, COINCIDE string, extra int"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = linking.resolved_conflicts(frame)
    assert got.columns == frame.columns
    plain_pass(rows, "ID_BASE", "CONFLICTO_N1", 0.03, lambda own: len({r["ID_ARCHIVO"] for r in own}) > 1)
    plain_pass(rows, "ID_ARCHIVO", "CONFLICTO_1N", 0.03, lambda own: len(own) > 1)
    assert {(r.ID, r.COINCIDE, r.MOTIVO, r.extra) for r in got.collect()} == {(r["ID"], r["COINCIDE"], r["MOTIVO"], r["extra"]) for r in rows}


# Phones


PLAN = [("54", "11", 10, 10, "FIJO", 2, "0"), ("54", "911", 11, 11, "MOVIL", 2, "0"), ("54", "22", 10, 10, "FIJO", 2, "0"), ("54", "223", 10, 10, "FIJO", 3, "0"), ("598", "9", 8, 8, "MOVIL", 0, "0"), ("598", "2", 8, 8, "FIJO", 1, "0"), ("598", "8", 8, 8, None, 0, "0")]


def test_each_cell_is_looked_at_once(spark, monkeypatch):
    seen, keep = [], phones.stored
    monkeypatch.setattr(phones, "stored", lambda df, what: seen.append(df.count()) or keep(df, what))
    plan = spark.createDataFrame([("54", "11", 10, 10, "FIJO", 2, "0"), ("54", "113", 10, 10, "MOVIL", 3, "0")], phones.PLAN)
    rows = spark.range(400).selectExpr("id", "CASE id % 4 WHEN 0 THEN '011 4567-8912' WHEN 1 THEN '+999 1234567' WHEN 2 THEN '' END AS tel")
    got = {(r.id % 4, r.MOTIVO, r.TIPO_LINEA, r.PREFIJO) for r in phones.validated(rows, "tel", plan).collect()}
    assert seen == [3]
    assert got == {(0, phones.VALID, "FIJO", "11"), (1, phones.NO_COUNTRY, None, ""), (2, phones.EMPTY, None, ""), (3, phones.EMPTY, None, "")}


def test_phones_by_a_plan(spark):
    cases = {
        "Tel: 011 4321-9876": (True, "+541143219876", "54", "11", "43219876", "F", "FIJO"),
        "mitelefono +54 9 11 4321-9876": (True, "+5491143219876", "54", "11", "43219876", "C", "MOVIL"),
        "0054 223 456-7891": (True, "+542234567891", "54", "223", "4567891", "F", "FIJO"),
        "2214567891": (True, "+542214567891", "54", "22", "14567891", "F", "FIJO"),
        "541143219876": (True, "+541143219876", "54", "11", "43219876", "F", "FIJO"),
        "+598 099 123 457": (True, "+59899123457", "598", "", "99123457", "C", "MOVIL"),
        "+598 81234568": (True, "+59881234568", "598", "", "81234568", "", "DESCONOCIDO"),
        "+598 22222222": (False, "Todos los dígitos son iguales (22222222): número de relleno"),
        "+999 1234569": (False, phones.NO_COUNTRY),
        "33 4321 9876": (False, phones.POSSIBLE),
        "11 4321": (False, phones.WRONG_LENGTH),
        "12345": (False, phones.TOO_SHORT),
        "no tiene": (False, phones.NO_NUMBER),
        None: (False, phones.EMPTY),
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, tel string")
    plan = spark.createDataFrame(PLAN, phones.PLAN)
    got = {r.tel: r for r in phones.validated(rows, "tel", plan).collect()}
    for cell, want in cases.items():
        r = got[cell]
        if want[0]:
            assert (r.VALIDO, r.TELEFONO_NORMALIZADO, r.CODIGO_PAIS, r.PREFIJO, r.TELEFONO, r.TIPO_TELEFONO, r.TIPO_LINEA) == want and r.MOTIVO == phones.VALID, cell
        else:
            assert (r.VALIDO, r.MOTIVO) == want and r.TELEFONO_NORMALIZADO is None and r.CODIGO_PAIS == "", cell
    result, counts = processes.run("telefonos", rows, NOW, id_col="i", column="tel", plan=plan)
    assert len(result.columns) == 14 and result.filter("VALIDO = 1 AND FECHA_BAJA IS NULL").count() == 7 == counts.first().validos
    assert phones.validated(rows, "tel", spark.createDataFrame([], phones.PLAN)).filter("VALIDO").count() == 0


# Previews


def test_preview_with_filter_and_total(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN ' ' ELSE concat('v', id) END AS v").repartition(5)
    sample, columns, total = profile.preview(rows.orderBy("id"), ["id", "v"], 8, "id >= 100", with_total=True)
    assert [r.id for r in sample.collect()] == list(range(100, 108)) and total == 900
    assert {r.columna: (r.nulos, r.blancos, r.distintos) for r in columns.collect()} == {"id": (0, 0, 8), "v": (2, 2, 4)}
    few, _, none = profile.preview(rows, limit=500)
    assert few.count() == 100 and none is None and profile.preview(rows, ["v"], 5, "id < 0", with_total=True)[2] == 0


# Mails


def mail_table(spark, path):
    cells = ["jose1@gmeil.com", "juan@fibertel.com.ar", "carlos#yahoo.com", "ana?lucia@gmail.com", "notiene@nomail.com", "", None, "mariagmail.com"]
    rows = spark.createDataFrame([(i, cells[i % 8], "p0" if i < 16 else f"p{i % 3 + 1}") for i in range(48)], "id long, mail string, parte string")
    rows = with_audit_columns(rows).withColumn("FECHA_BAJA", F.when(F.col("id") % 11 == 0, F.lit(NOW)))
    rows = rows.filter("parte <> 'p1' OR mail = 'juan@fibertel.com.ar'")  # a part in which nothing is to be done
    rows.write.partitionBy("parte").parquet(path)
    return {r.id: r for r in spark.read.parquet(path).collect()}


def test_a_table_cleaned_where_it_stands(spark, tmp_path):
    path, audit = f"file://{tmp_path}/mails", f"file://{tmp_path}/audit"
    before = mail_table(spark, path)
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.glob("mails/parte=p1/*.parquet")}
    told = mail_agent.clean_in_place(spark, path, "parte", "id", "mail", audit, NOW, "engine", "MAILS")
    after = {r.id: r for r in spark.read.parquet(path).collect()}
    assert before.keys() == after.keys() and told["particiones"] == 3
    assert stamps == {p: p.stat().st_mtime_ns for p in tmp_path.glob("mails/parte=p1/*.parquet")}
    differ = {i for i in before if before[i] != after[i]}
    rows = spark.read.parquet(audit).collect()
    assert {int(r.ID_REGISTRO) for r in rows} == differ and len(rows) == len(differ) == sum(n for k, n in told.items() if k != "particiones")
    for r in rows:
        old, new = before[int(r.ID_REGISTRO)], after[int(r.ID_REGISTRO)]
        assert json.loads(r.DATOS_ANTES)["mail"] == old.mail and json.loads(r.DATOS_DESPUES)["mail"] == new.mail
        if r.OPERACION == "BAJA":
            assert new.mail == old.mail and new.FECHA_BAJA == NOW and new.MOTIVO_BAJA == mail_agent.LOW_REASON
        elif r.OPERACION == "MOD":
            assert new.mail != old.mail and new.FECHA_MOD == NOW and new.FECHA_BAJA is None
        else:
            assert new.mail == old.mail and new.MOTIVO_MOD == "REVISION MANUAL"
    assert not any(i % 11 == 0 for i in differ)
    # A second run finds nothing to do.
    assert mail_agent.clean_in_place(spark, path, "parte", "id", "mail", audit, NOW, "engine", "MAILS") == {"particiones": 0}
    assert {r.id: r for r in spark.read.parquet(path).collect()} == after and spark.read.parquet(audit).count() == len(rows)


def test_evidence_within_a_budget(spark):
    rows = spark.createDataFrame([(1, "pedro@gmail.com"), (2, "ana@gmail.com"), (3, "ana@gmail.com"), (4, "bad"), (5, "luis?x@gmail.com"), (6, "rosa@gmail.com"), (7, None)], "n long, m string")
    kinds = [("pedro@gmail.com", "a", "Error", ""), ("ana@gmail.com", "a", "Registered", "u1"), ("ana@gmail.com", "b", "Registered", "u2"), ("luis?x@gmail.com", "b", "Registered", None), ("luis?x@gmail.com", "a", "Error", ""), ("rosa@gmail.com", "a", "Registered", "")]
    findings = spark.createDataFrame(kinds, "MAIL string, PROVEEDOR string, ESTADO_OSINT string, URL_OSINT string")
    got = {r.n: r for r in mails.three_stages(rows, "m", "n", findings, ["a", "b"], limit=7).collect()}
    assert [got[i].ESTADO for i in range(1, 8)] == ["VALIDO", "VALIDO_CONFIRMADO", "VALIDO_CONFIRMADO", "INVALIDO", "VALIDO", "VALIDO", "INVALIDO"]
    assert got[1].NOTA_OSINT == "Sin dato: los 1 proveedores dieron error" and got[5].NOTA_OSINT == "REVISION despejada: registrado en b" and got[6].NOTA_OSINT == mails.NOT_ASKED and got[7].NOTA_OSINT == mails.THROWN_OUT
    assert got[2].URLS_OSINT == "u1 | u2" and got[3].PROVEEDORES_REGISTRADO == "a, b" and got[2].MAIL_ORIGINAL == "ana@gmail.com"
    assert {r.NOTA_OSINT for r in mails.three_stages(rows, "m", "n", findings, []).collect()} == {mails.NOT_ASKED, mails.THROWN_OUT}


def test_each_mail_is_judged_once(spark, monkeypatch):
    seen, work = [], mails.processed
    monkeypatch.setattr(mails, "processed", lambda rows, *a: seen.append(rows.count()) or work(rows, *a))
    rows = spark.range(300).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'Ana@gmeil.com' WHEN 1 THEN '' END AS mail")
    got = mails.processed_once(rows, "mail")
    assert seen == [3]
    plain = work(rows, "mail")
    assert got.columns == plain.columns and got.exceptAll(plain).count() == 0 and got.count() == 300


def test_a_second_opinion_fitted_here(spark):
    rnd = random.Random(2)
    good = [f"{rnd.choice(['ana', 'luis', 'rosa', 'juan'])}.{spelled(rnd, 6)}@{rnd.choice(['gmail.com', 'hotmail.com', 'yahoo.com.ar'])}" for _ in range(300)]
    bad = [f"{rnd.randrange(10**7)}@{rnd.choice(['gmail.com', 'x..y', 'nowhere.zzz'])}" for _ in range(200)] + [spelled(rnd, 8) for _ in range(50)]
    judged = mails.processed(spark.createDataFrame([(i, m) for i, m in enumerate(good + bad)], "id long, mail string"), "mail").withColumn("held", F.expr("id % 4 = 0"))
    model = mail_features.fitted(judged.filter("NOT held"), "mail")
    told = mail_features.scored(judged, "mail", model).filter("held AND ESTADO <> 'REVISION'").collect()
    wrong = sum((r.PUNTAJE >= 0.5) != (r.ESTADO == "VALIDO") for r in told)
    assert len(told) > 100 and wrong <= 0.05 * len(told)
    odd = mail_features.second_opinion(mail_features.scored(judged.withColumn("ESTADO", F.when(F.col("ESTADO") == "VALIDO", "BAJA").otherwise("VALIDO")), "mail", model), "PUNTAJE")
    assert odd.filter("ESTADO = 'REVISION MANUAL'").count() > 0.9 * odd.count()
    assert mail_features.fitted(judged.filter("ESTADO = 'VALIDO'"), "mail") is None
    assert mail_features.scored(judged.limit(3), "mail", None).filter("PUNTAJE IS NULL").count() == 3


# Registry


def test_registry_by_either_key_without_moving_it(spark):
    rows = spark.createDataFrame([(f"20{i:08d}{i % 10}", f"n{i}", "x", str(i), None, None, None) for i in range(500)], "CUIT string, DENOMINACION string, NOMBRE_LIMPIO string, DNI string, MARCA_BAJA string, FECHA_FALLECIMIENTO string, CUIT_REEMPLAZO string")
    assert publish.snapshot(identity.registry_snapshot(rows), "padron_prueba", 4, NOW, "here") == 500
    assert tuple(spark.table("padron_prueba_meta").first()) == ("here", 500, NOW)
    asked = spark.range(300).selectExpr("cast(id AS string) AS k", "lpad(cast(id AS string), 8, '0') AS d")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, key, probe in (("padron_prueba_dni", "DNI_NORM", asked.select(F.col("k").alias("p"))), ("padron_prueba_cuit", "CUIT_NORM", asked.selectExpr("concat('20', d, right(k, 1)) AS p"))):
            met = probe.join(spark.table(table), F.col("p") == F.col(key))
            assert met.count() == 300
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(p#") == 1 and plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("dni", "cuit", "meta"):
            spark.sql(f"DROP TABLE padron_prueba_{t}")


# Files


def quoted_file(rnd, n):
    cell = lambda: rnd.choice(["x", "", "ñ", 'a "quoted" word', "two\nlines", "with; sign", "many\n\nlines\n", 'end"\n', "long " * 40])
    rows = [[str(i), cell(), cell(), "z"] for i in range(n)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(s in c for s in '";\n') else c
    return rows, "\n".join(";".join(map(quoted, r)) for r in [["id", "nombre", "nota", "fin"], *rows]) + "\n"


def test_quoted_cells_over_line_ends_in_many_tasks(spark, tmp_path):
    rnd = random.Random(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, n in (("2000", 300), ("64", 40), ("7", 6)):
            rows, text = quoted_file(rnd, n)
            path = tmp_path / f"q{size}.csv"
            path.write_text(text, encoding="utf-8")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = files.records(spark, str(path))
            assert found.rdd.getNumPartitions() > 3
            assert [bytes(r.value).decode() for r in found.orderBy("_n").collect()][1:] == [";".join('"' + c.replace('"', '""') + '"' if any(s in c for s in '";\n') else c for c in r) for r in rows]
            want = sorted(tuple(c or None for c in r) for r in rows)
            got, header, _ = files.read_table(spark, str(path))
            assert header == ["id", "nombre", "nota", "fin"] and sorted(tuple(c.strip() if c else c for c in r) for r in got.collect()) == sorted(tuple(c.strip() if c else c for c in r) for r in want)
            assert files.read_contacts(spark, str(path), "NOMBRE").count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_broken_scan_goes_on(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "id")
    path = f"file://{tmp_path}/copy"
    broken = rows.withColumn("id", F.when(F.col("k") == "k778", F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        scan.scan(broken, "k", path, 8).count()
    done = {p: p.stat().st_mtime_ns for p in tmp_path.glob("copy/rows/range=*/*.parquet")}
    assert 0 < len({p.parent for p in done}) < 8
    got = scan.scan(rows, "k", path, 8)
    assert sorted(r.id for r in got.collect()) == list(range(1000)) and got.filter("k IS NULL").count() == 20
    assert all(p.stat().st_mtime_ns == t for p, t in done.items() if p.exists()) and sum(p.exists() for p in done) > 0
    last = spark.read.parquet(f"{path}/last")
    assert last.agg(F.sum("filas")).first()[0] == 1000 and last.count() == len(list(tmp_path.glob("copy/rows/range=*")))
    assert scan.scan(rows.limit(0), "k", f"{path}2", 8).count() == 0


def test_processes_over_files(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('id_cli;Correo;nota\n7;ana@gmeil.com;"a\nb"\n9;luis@hotmail.com;\n', encoding="utf-8")
    result, _ = processes.run_file(spark, "dep_mails", str(path), NOW)
    assert sorted((r.ID_ORIGEN, r.MAIL_DEPURADO) for r in result.collect()) == [("7", "ana@gmail.com"), ("9", "luis@hotmail.com")]
    path.write_text("rosa@gmail.com\nbad\n", encoding="utf-8")
    result, counts = processes.run_file(spark, "mails", str(path), NOW)
    assert sorted((r.ID_ORIGEN, r.ESTADO) for r in result.collect()) == [("1", "CONSERVADO"), ("2", "BAJA")]
    path.write_text("nombre,razon\nana paz,ANA PAZ\n", encoding="utf-8")
    assert [r.MOTIVO for r in processes.run_file(spark, "comparacion", str(path), NOW)[0].collect()] == ["COINCIDENCIA EXACTA"]
    with pytest.raises(KeyError):
        processes.run_file(spark, "cruce_redes", str(path), NOW)


def test_lookups_of_rows_with_null_and_repeated_ids(spark):
    registry = identity.registry_snapshot(spark.createDataFrame([("20000000075", "a", "a", "7", None, None, None), ("27000000078", "b", "b", "00000007", None, None, None), ("20000000091", "c", "c", "9", None, None, None)], "CUIT string, DENOMINACION string, NOMBRE_LIMPIO string, DNI string, MARCA_BAJA string, FECHA_FALLECIMIENTO string, CUIT_REEMPLAZO string"))
    rows = spark.createDataFrame([(None, "7"), (None, "9"), (1, "20000000075"), (1, "5"), (1, None)], "id long, n string")
    got = sorted((r.id is None, r.n or "", r.DENOMINACION or "") for r in identity.lookup_first_variant(rows, registry, "n", "id").collect())
    assert got == [(False, "", ""), (False, "20000000075", "a"), (False, "5", ""), (True, "7", "a"), (True, "9", "c")]
    told = sorted((r.NUMERO_BUSCADO, r.DENOMINACION_ENCONTRADA or "", r.COINCIDENCIAS) for r in identity.enriched(rows, registry, "n", "id").collect())
    assert told == [("", "", 0), ("20000000075", "a", 1), ("5", "", 0), ("7", "a", 2), ("7", "b", 2), ("9", "c", 1)]


def test_default_lists_are_written_once(spark, tmp_path):
    folder = f"file://{tmp_path}/lists"
    assert files.write_defaults(spark, folder, {"typos": {"gmeil.com": "gmail.com"}, "words": ("a", "b#c")}) == ["typos", "words"]
    assert files.write_defaults(spark, folder, {"words": ("z",)}) == []
    assert files.read_list(spark, f"{folder}/words.txt", ()) == ("a", "b#c") and files.read_list(spark, f"{folder}/typos.txt", {}) == {"gmeil.com": "gmail.com"}


def test_dates_of_workbooks():
    assert workbook.as_date("45000") == "2023-03-15 00:00:00" and workbook.as_date("45000.75") == "2023-03-15 18:00:00" and workbook.as_date("x") == "x" and workbook.as_date("1e300") == "1e300"
    assert workbook.as_date("43538", True) == "2023-03-15 00:00:00"
    shown = workbook._shown_as_date
    assert shown("dd/mm/yyyy") and shown("[$-2C0A]h:mm") and not shown("0.00") and not shown('0 "dias"') and not shown("[Red]#,##0") and not shown("General")


def test_catalog_of_views_or_tables(spark):
    spark.range(1).createOrReplaceTempView("una_vista_suelta")
    told = {(r.tabla, r.clase) for r in publish.catalog(spark, views=True, text="VISTA_suelta").collect()}
    assert told == {("una_vista_suelta", "VISTA")} and publish.catalog(spark, views=False, text="vista_suelta").count() == 0
    spark.catalog.dropTempView("una_vista_suelta")
