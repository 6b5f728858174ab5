"""Golden cases of the contact-data operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contactdq.functions.similarity import damerau_of, jaro_winkler_of
from contactdq.operators import identity, linking, names, normalise, phones
from contactdq.sources import files, publish

PAIRS = [
    ("PEREZ JUAN CARLOS", "PEREZ JUAN CARLOS", 100, 100, 100, 100, 100, 100, "COINCIDENCIA EXACTA"),
    ("PEREZ JUAN CARLOS", "JUAN CARLOS PEREZ", 68.93, 29.41, 29.41, 100, 100, 100, "MISMAS PALABRAS EN OTRO ORDEN"),
    ("MARIA GONZALEZ", "MAIRA GONZALEZ", 98.10, 85.71, 92.86, 50, 50, 33.33, "TRANSPOSICION DE LETRAS"),
    ("RODRIGUEZ MARIA", "RODRIGEZ MARIA", 98.67, 93.33, 93.33, 50, 50, 33.33, "ERROR DE TIPEO"),
    ("LOPEZ ANA MARIA", "LOPEZ ANA", 92.00, 60.00, 60.00, 100, 80, 66.67, "UN LADO TIENE NOMBRES DE MAS"),
    ("JUAN PEREZ", "JUANPEREZ", 98.00, 90.00, 90.00, 0, 0, 0, "TEXTO SIN SEPARAR"),
    ("JOSÉ PÉREZ", "JOSE PEREZ", 100, 100, 100, 100, 100, 100, "COINCIDENCIA EXACTA"),
    ("MARTINEZ LAURA", "SUAREZ CARLOS", 68.73, 28.57, 28.57, 0, 0, 0, "SIN RELACION"),
    ("MUÑOZ ANA", "MUNOZ ANA", 94.07, 88.89, 88.89, 50, 50, 33.33, "ERROR DE TIPEO"),
    ("ANA MARIA RODRIGUEZ", "RODRIGEZ MARIA ANA", 57.85, 10.53, 10.53, 66.67, 66.67, 50, "ALGORITMOS EN DESACUERDO"),
    (None, "PEREZ JUAN", 0, 0, 0, 0, 0, 0, "DATO VACIO"),
    (None, None, 0, 100, 100, 0, 100, 100, "DATO VACIO"),
]


def test_six_metrics(spark):
    rows = names.six_metrics(spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(PAIRS)], "i int, a string, b string"), "a", "b").orderBy("i").collect()
    for r, p in zip(rows, PAIRS):
        assert [r[m] for m in names.METRICS] == pytest.approx(list(p[2:8]), abs=0.011), p
        assert r.MOTIVO == p[8]
    assert rows[2].DETALLE == "Letras intercambiadas: MARIA / MAIRA" and rows[3].DETALLE == "Difieren: RODRIGUEZ / RODRIGEZ" and rows[4].DETALLE.endswith(": MARIA")


def test_folding_beyond_the_latin_blocks(spark):
    from contactdq.functions.text import compared_name, folded, percent_name

    row = spark.createDataFrame([("Nguy\u1ec7n \uff21na\u00a0Nu\u00f1ez n\u00ba \u2460\u0301",)], "n string").select(compared_name(F.col("n")).alias("a"), percent_name(F.col("n")).alias("b"), folded(F.col("n"), "\u1ec7").alias("c")).first()
    assert row.a == "NGUYEN ANA NU\u00d1EZ NO 1" and row.b == "NGUYEN ANA NUNEZ NO 1" and row.c.startswith("Nguy\u1ec7n")


def test_distances():
    assert damerau_of("CA", "ABC") == 2 and damerau_of("", "ab") == 2
    assert round(jaro_winkler_of("JUAN PEREZ", "PEREZ JUAN"), 2) == 0.30


CROSS = [
    (1, "Juan Pérez", "PEREZ JUAN", "SI"),
    (2, "Ana Muñoz", "MUNOZ ANA MARIA", "SI"),
    (3, "Rodriguez Nataly", "RODRIGUEZ NATALIA", "RE"),
    (4, "FERREIRA BRUN ANDREA", "ANDRES FERREIRA BRUN", "RE"),
    (5, "MAITE", "MAITE S.R.L.", "SI"),
    (6, "\U0001d40b\U0001d42e\U0001d41c\U0001d422\U0001d41a Fernandez", "FERNANDEZ LUCIA", "SI"),
]


def test_cross_match_verdicts(spark):
    rows = names.cross_scores(names.classified(names.classified(spark.createDataFrame(CROSS, "i int, a string, b string, v string"), "b").select("i", "a", "v", F.col("CLAVE").alias("kb")), "a").withColumnRenamed("CLAVE", "ka"), "ka", "kb").collect()
    assert {r.i: r.COINCIDE for r in rows} == {c[0]: c[3] for c in CROSS}


def test_ranked_candidates_and_noise(spark):
    left = spark.createDataFrame([(1, "Juan Perez"), (2, "jperez@gmail.com"), (3, "Barraca El Encuentro SRL"), (4, "Zzz Qqq"), (5, None)], "id int, n string")
    right = spark.createDataFrame([(10, "PEREZ JUAN"), (11, "PEREZ JUANA"), (12, "GOMEZ ANA")], "bid int, bn string")
    rows = linking.cross_match(left, right, 5, "id", "n", "bid", "bn").collect()
    got = {(r.ID_ARCHIVO, r.RANKING): (r.ID_BASE, r.COINCIDE, r.MOTIVO) for r in rows}
    assert got[("1", 1)][:2] == (10, "SI") and ("1", 2) in got
    assert got[("2", 0)][1:] == ("NO", "CAMPO_NOMBRE_CONTIENE_EMAIL") and got[("3", 0)][2] == "INDICIO_JURIDICA(BARRACA)"
    assert got[("4", 0)][2] == "SIN_CANDIDATOS_EN_INDICE" and got[("5", 0)][2] == "DENOMINACION_VACIA"


def test_hot_keys_rank_as_by_brute_force(spark):
    """Many rows of few keys: all rows keep their own best candidates, and a pair of keys is scored once."""
    from contactdq.functions.similarity import jaro_winkler_of

    kinds = ["JUAN PEREZ", "PEREZ JUAN", "PEREZ JUANA", "GOMEZ ANA", "PEREZ", "juan  perez"]
    left, right = [(i, kinds[i % 6]) for i in range(60)] + [(60, "ZZZ QQQ")], [(i, kinds[(i * 7 + 1) % 6]) for i in range(90)]
    key = lambda n: " ".join(n.upper().split())
    want = set()
    for i, n in left:
        near = [(b, key(m)) for b, m in right if key(m) == key(n)] or [(b, key(m)) for b, m in right if {t for t in key(n).split() if len(t) >= 4} & set(key(m).split())]
        best = []
        for b, m in near:
            x, y = set(key(n).split()), set(m.split())
            best.append((-max(round(jaro_winkler_of(" ".join(sorted(key(n).split())), " ".join(sorted(m.split()))), 6), round(2 * len(x & y) / (len(x) + len(y)), 6)), b))
        want |= {(str(i), b, r + 1) for r, (_, b) in enumerate(sorted(best)[:5])} or {(str(i), None, 0)}
    made = linking.cross_match(spark.createDataFrame(left, "id int, n string"), spark.createDataFrame(right, "bid int, bn string"), 5, "id", "n", "bid", "bn")
    rows = made.collect()
    assert {(r.ID_ARCHIVO, r.ID_BASE, r.RANKING) for r in rows} == want and len(rows) == len(want)
    assert {r.MOTIVO for r in rows if r.CLAVE_ARCHIVO == "JUAN PEREZ" and r.ID_BASE is not None} == {"IDENTICO", "IDENTICO_NORMALIZADO"}


def test_whole_tables_are_linked_and_compared(spark):
    from contactdq.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert QUERIES["blocking_topk_all"](spark, sf_dir).select("ID_ARCHIVO").distinct().count() == rows("part")
    assert QUERIES["six_metrics_all"](spark, sf_dir).count() == rows("orders")


def test_conflicts(spark):
    rows = [
        (1, "a", "x", "", 1.00, 0.0, "", "SI"), (2, "b", "x", "", 0.95, 0.0, "", "SI"),
        (3, "c", "y", "", 0.98, 0.0, "", "SI"), (4, "d", "y", "", 0.96, 0.0, "", "SI"),
        (5, "e", "z", "Uno", 0.98, 0.0, "", "SI"), (6, "f", "z", "uno", 0.96, 0.0, "", "SI"),
        (7, "g", "p", "", 0.95, 0.0, "", "SI"), (8, "g", "q", "", 0.95, 0.0, "", "SI"),
    ]
    got = {r.ID: (r.COINCIDE, r.MOTIVO) for r in linking.resolved_conflicts(spark.createDataFrame(rows, "ID int, ID_ARCHIVO string, ID_BASE string, USERNAME string, JARO_WINKLER_ORD double, DICE double, MOTIVO string, COINCIDE string")).collect()}
    assert got[1] == ("SI", "GANA_POR_MARGEN(0.0500)") and got[2][0] == "RE"
    assert got[3][0] == got[4][0] == "RE" and got[5][0] == got[6][0] == "SI" and got[7][0] == got[8][0] == "RE"


def test_identity_numbers(spark):
    row = spark.range(1).select(
        identity.check_digit(F.lit("2012345678")).alias("a"), identity.check_digit(F.lit("2712345678")).alias("b"), identity.dni_variants(F.lit("2456884")).alias("v"), identity.dni_reason(F.lit("77777777")).alias("r"), identity.formatted_cuit(F.lit("20123456786")).alias("f")
    ).first()
    assert (row.a, row.b, row.v, row.f) == (6, 0, ["2456884", "02456884"], "20-12345678-6") and "relleno" in row.r


PHONES = {
    "(011) 15-4123-4567": "+541141234567", "011 4123 4567": "+541141234567", "+54 9 11 4123-4567": "+541141234567", "1141234567": "+541141234567",
    "0351 155-123456": "+543515123456", "Cel: 0223 15 4567890": "+542234567890", "+598 91854820": "+59891854820", "": None, "no": None,
}


def test_phones(spark):
    rows = phones.cleaned(spark.createDataFrame(list(PHONES.items()), "t string, e string"), "t").collect()
    assert {r.t: r.E164 for r in rows} == PHONES
    assert phones.cleaned_cells(spark.createDataFrame([(1, "+598 91854820 / +598 47255621"), (2, None)], "i int, t string"), "i", "t").count() == 3
    fill = {"1111111": True, "22222222": True, "12345678": True, "98765432": True, "89012345": True, "12121212": True, "123123123": True, "121212": True, "4123456": False}
    assert {r.n: r.f for r in spark.createDataFrame([(n,) for n in fill], "n string").withColumn("f", phones.is_filler(F.col("n"))).collect()} == fill


def test_normalise(spark):
    rows = normalise.exploded(spark.createDataFrame([("20-1", "111|222", "zona"), ("20-2", None, "sur"), ("20-3", "no tiene", "sur"), ("20-4", "5;5", "este")], "k string, t string, z string"), "k", ["t"], ["z"]).collect()
    assert sorted((r.k, r.t) for r in rows) == [("20-1", "111"), ("20-1", "222"), ("20-2", ""), ("20-3", ""), ("20-4", "5")]


def test_mails(spark):
    from contactdq.operators import mails

    texts = {"José@gmáil.com": "jose@gmail.com", "ana arroba hotmail punto com": "ana@hotmail.com", "luis@gmeil.com": "luis@gmail.com", "notiene@nomail.com": "notiene@nomail.com", "juan@fibertel.com.ar": "juan@fibertel.com.ar", "": "", "user?gmail.com": "user@gmail.com"}
    rows = mails.cleaned(spark.createDataFrame(list(texts.items()), "m string, e string"), "m").collect()
    assert {r.m: r.MAIL_DEPURADO for r in rows} == texts
    states = {"juan.perez@gmail.com": "VALIDO", "notiene@nomail.com": "INVALIDO", "jb1583564@gmail.com": "INVALIDO", "ana?lucia@gmail.com": "REVISION", "x" * 250: "REVISION", "a@b": "INVALIDO"}
    rows = mails.validated(spark.createDataFrame([(m,) for m in states], "m string"), "m").collect()
    assert {r.m: r.ESTADO for r in rows} == states


def test_files(spark, tmp_path):
    assert files.detect_encoding("ñ".encode()) == "utf-8" and files.detect_encoding("ñ".encode("cp1252")) == "cp1252"
    path = tmp_path / "a.csv"
    path.write_text("ID;CORREO;NOMBRE\n1;ana@example.com;Ana\n", encoding="utf-8")
    rows, header, sep = files.read_table(spark, str(path))
    assert (header, sep, rows.collect()[0].CORREO) == (["ID", "CORREO", "NOMBRE"], ";", "ana@example.com")
    path.write_text("Reporte\n\nusername,Nombre\nx,Ana\n,\ny\n", encoding="utf-8")
    assert [(r.username, r.Nombre) for r in files.read_contacts(spark, str(path), "nombre").collect()] == [("x", "Ana"), ("y", "")]
    assert files.normalisation_columns(["CUIT", "TELEFONO", "EMAIL", "ORIGEN"], []) == (0, [1, 2], [3])
    assert files.read_list(spark, str(tmp_path / "none.txt"), ("a",)) == ("a",)
    path.write_text('x;y\nid;"Nombre; completo";nota\n1;"Paz; Ana ""la""";b\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_contacts(spark, str(path), "nota").collect()] == [("1", 'Paz; Ana "la"', "b")]
    path.write_text('id,nombre,nota\n1,Ana,"two\nlines"\n2,Luis,\n', encoding="utf-8")
    assert [r.nota for r in files.read_table(spark, str(path))[0].collect()] == ["two\nlines", None]


def test_columns_by_process():
    """By name, by content, by place; APELLIDO holds "id" but is no key."""
    assert files.is_header(["Titular", "x@y.z"]) and not files.is_header(["a@b.c"]) and not files.is_header(["1", "2"])
    find = files.process_columns
    assert find(["APELLIDO", "CORREO", "ID_CLI"], [], "mails") == (2, 1) and find(None, ["1", "a@b.c"], "osint") == (None, 1)
    assert find(["ID_MAIL", "Email"], [], "mails") == (0, 1)
    assert find(["nombre", "celular"], [], "telefonos") == (None, 1) and find(None, ["Ana", "11 4444", "x"], "telefonos") == (None, 1) and find(None, [], "telefonos") == (None, 0)
    assert find(["Apellido", "Nro_Doc"], [], "cuit") == (1, 0) and find(None, ["Ana Paz", "20-1-2"], "cuit") == (1, 0) and find(None, [], "cuitificacion") == (0, 1)
    assert find(["id", "Nombre", "Razon"], [], "denominacion") == (1, 2) and find(["a", "nombre"], [], "comparacion") == (0, 1)
    assert files.normalisation_columns(["Apellido", "wsp", "x"], []) == (0, [1], [2])
    assert files.normalisation_columns(None, ["7", "a@b.c", "1144445555", "x"]) == (0, [1, 2], [3]) and files.normalisation_columns(["a", "b"], ["1", "c@d"], ("telefonos",)) == (0, [], [1])


def test_encodings_by_all_bytes(spark, tmp_path):
    """The first accent stands far behind the start of the file."""
    path = tmp_path / "late.csv"
    plain = "".join(f"{i};ana{i}@example.com;Ana\n" for i in range(5000))
    for encoding, name in (("cp1252", "Muñoz €"), ("latin-1", "Muñoz \x81"), ("utf-8", "Muñoz €"), ("utf-8-sig", "Muñoz €")):
        path.write_bytes(("ID;CORREO;NOMBRE\n" + plain + f"5000;m@example.com;{name}\n").encode(encoding))
        assert files.file_encoding(spark, str(path), path.read_bytes()[:9]) == encoding
        rows, header, _ = files.read_table(spark, str(path))
        assert header[1:] == ["CORREO", "NOMBRE"] and rows.count() == 5001
        assert [r.NOMBRE for r in rows.filter("CORREO = 'm@example.com'").collect()] == [name]
        assert [r.NOMBRE for r in files.read_contacts(spark, str(path), "nombre").filter("CORREO = 'm@example.com'").collect()] == [name]
    path.write_bytes("ID;CORREO;AÑO\n1;ñ@example.com;x\n".encode("cp1252"))
    rows, header, _ = files.read_table(spark, str(path))
    assert (header, rows.collect()[0].CORREO, files.read_contacts(spark, str(path), "año").columns) == (["ID", "CORREO", "AÑO"], "ñ@example.com", header)


def test_publish(spark, tmp_path):
    assert publish.result_name("Ana", "Cliente Sur", datetime(2026, 8, 4, 16, 30, 5)) == "ANA_CLIENTE_SUR_20260804_163005"
    assert len(publish.result_name("Ana", "Cliente del Sur y Norte", datetime(2026, 8, 4, 16, 30, 5), 30)) == 30
    assert publish.plain_identifier(" José Pérez S.A. ") == "JOSE_PEREZ_S_A"
    with pytest.raises(ValueError):
        publish.checked_identifier("a; drop")
    assert publish.publish(spark.range(7), f"file://{tmp_path}/out") == 7
    with pytest.raises(ValueError):
        publish.publish(spark.range(7), f"file://{tmp_path}/bad", 8)
    assert not (tmp_path / "bad").exists()


def test_stream_catches_up(spark, tmp_path):
    from contactdq.streaming.incremental import caught_up

    source, target, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        caught_up(spark, source, "id long", lambda d: d.withColumn("x", F.col("id") * 2), target, state, "id")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(5))
