"""Processes by name, their counts, and what surrounds a run."""

from datetime import datetime

import pytest

from contactdq.operators import identity, mail_features, phones
from contactdq.plans import processes

NOW = datetime(2026, 8, 4, 16, 30, 5)


def test_processes_give_their_tables(spark):
    rows = spark.createDataFrame([(1, "luis@gmeil.com", "Cel: 0223 15 4567890"), (2, None, None), (3, "nada@nomail.com", "011 4123 4567 / 1")], "id int, mail string, tel string")
    result, counts = processes.run("dep_mails", rows, NOW, id_col="id", column="mail")
    assert result.columns == ["ID_ORIGEN", "MAIL_ORIGINAL", "MAIL_DEPURADO", "FUE_DEPURADO", "CAMBIOS", "FECHA_PROCESO"]
    assert counts.first().asDict() == {"total": 3, "depurados": 1, "sin_cambios": 2}
    result, counts = processes.run("mails", rows, NOW, id_col="id", column="mail")
    assert {r.ID_ORIGEN: r.ESTADO for r in result.collect()} == {"1": "MODIFICADO", "2": "BAJA", "3": "BAJA"}
    with pytest.raises(KeyError):
        processes.run("none", rows, NOW)


def test_phone_verdicts(spark):
    rows = spark.createDataFrame([(1, "011 4123 4567"), (2, None), (3, "no tiene"), (4, "123"), (5, "1111111")], "id int, tel string")
    result, counts = processes.run("telefonos", rows, NOW, id_col="id", column="tel")
    assert result.columns == "ID_ORIGEN TELEFONO_ORIGINAL TELEFONO_NORMALIZADO CODIGO_PAIS PREFIJO TELEFONO TIPO_TELEFONO TIPO_LINEA VALIDO MOTIVO FECHA_BAJA USUARIO_BAJA MOTIVO_BAJA FECHA_PROCESO".split()
    got = {r.ID_ORIGEN: (r.VALIDO, r.PREFIJO, r.MOTIVO, r.FECHA_BAJA) for r in result.collect()}
    assert got == {
        "1": (0, "", phones.NO_PLANS, NOW),
        "2": (0, "", "Teléfono vacío o nulo", NOW),
        "3": (0, "", "Texto corresponde a 'no posee teléfono' (no es un número)", NOW),
        "4": (0, "", "No contiene suficientes dígitos para ser un teléfono", NOW),
        "5": (0, "", "Todos los dígitos son iguales (1111111): número de relleno", NOW),
    }
    assert counts.first().asDict() == {"total": 5, "validos": 0, "bajas": 5, "moviles": 0, "fijos": 0}


REGISTRY = [
    ("20112233442", "PEREZ JUAN", "11223344", "*", "2001-02-03", None),
    ("20223344553", "GOMEZ ANA", "22334455", None, None, "27223344558"),
    ("27223344558", "GOMEZ ANA MARIA", "22334455", "N", "", None),
    ("20334455664", "LOPEZ LUIS", "33445566", "?", None, None),
]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "CUIT string, DENOMINACION string, DNI string, MARCA_BAJA string, FECHA_FALLECIMIENTO string, CUIT_REEMPLAZO string")


def test_numbers_and_names_against_the_registry(spark):
    rows = spark.createDataFrame(
        [
            (1, "20-11223344-2", "11223344", "Juan Perez"), (2, "20-33445566-4", "44556677", "Someone Else"), (3, "20-99887766-1", "22334455", "Gomez Ana"), (4, "20-99887766-1", "33445566", "Luis Lopez"),
            (5, "20-99887766-1", "33445566", "Nobody"), (6, None, "55667788", "Nobody"), (None, "20-11223344-2", "11223344", "Juan Perez"), (1, "20-11223344-2", "11223344", "Juan Perez"),
        ],
        "id int, c string, d string, n string",
    )
    result, counts = processes.run("cuit", rows, NOW, registry=registry(spark), id_col="id", number="c", dni="d", name="n")
    got = {r.id: r for r in result.collect()}
    assert result.count() == 8 and {k: r.ESTADO_VALIDACION for k, r in got.items()} == {
        1: "CUIT Y DENOMINACION COINCIDENTES", None: "CUIT Y DENOMINACION COINCIDENTES", 2: "SOLO CUIT COINCIDENTE", 3: "PENDIENTE DE DECISION" if got[3].CANDIDATOS == 2 and "2 personas" in got[3].ALERTAS else "SOLO DENOMINACION COINCIDENTE",
        4: "SOLO DENOMINACION COINCIDENTE", 5: "NO COINCIDE NINGUN PARAMETRO", 6: "NO COINCIDE NINGUN PARAMETRO",
    }
    assert got[1].ALERTAS == "DADO DE BAJA; FALLECIDO (2001-02-03)" and got[1].PORCENTAJE == 100 and got[1].MARCA_BAJA == "*"
    assert got[2].ALERTAS.startswith("El CUIT del origen (20-33445566-4) contiene el DNI 33445566, pero la columna DNI dice 44556677") and "MARCA_BAJA con valor no reconocido" in got[2].ALERTAS
    assert "20-33445566-4: el CUIT del origen estaría mal cargado" in got[4].ALERTAS and got[5].PORCENTAJE == 0 and got[6].ALERTAS == "Ni el CUIT ni el DNI figuran en el padrón"
    assert counts.first()["validados"] == 3 and counts.first()["no_coincide"] == 2 and counts.first()["con_alerta"] == 8


def test_subjects_and_decisions(spark):
    rows = spark.createDataFrame([(1, "11.223.344", "Perez Juan"), (2, "22334455", "Gomez Ana"), (3, "123", "x"), (4, "66666667", "x"), (5, "33445566", "Otro Nombre"), (6, "22334455", "Gomez Ana")], "id int, d string, n string")
    result, _ = processes.run("cuit_dni", rows, NOW, registry=registry(spark), id_col="id", dni="d", name="n")
    got = {r.id: (r.ESTADO_VALIDACION, r.CUIT_ASIGNADO, r.CANDIDATOS) for r in result.collect()}
    assert got == {
        1: ("VALIDADO (DNI Y NOMBRE COINCIDENTES)", "20-11223344-2", 1), 2: ("PENDIENTE DE DECISION", None, 2), 3: ("DNI INVALIDO", None, 0),
        4: ("DNI NO ENCONTRADO EN PADRON", None, 0), 5: ("NO COINCIDE NOMBRE", "20-33445566-4", 1), 6: ("PENDIENTE DE DECISION", None, 2),
    }
    clear = identity.validated_subjects(rows, identity.registry_snapshot(registry(spark)), "d", "n", "id", settle_clear=True, margin=5.0)
    assert {r.id: r.CUIT_ASIGNADO for r in clear.collect()}[2] == "20-22334455-3"
    told = spark.createDataFrame([(2, "27-22334455-8", "ana", NOW), (6, None, "ana", NOW), (1, None, "ana", NOW)], "id int, CUIT string, USUARIO_DECISION string, FECHA_DECISION timestamp")
    after = {r.id: r for r in identity.with_decisions(result, told, "id").collect()}
    assert after[2].ESTADO_VALIDACION == "VALIDADO MANUAL" and after[2].DENOMINACION_BCRA == "GOMEZ ANA MARIA" and after[2].USUARIO_DECISION == "ana" and after[2].ALERTAS == ""
    assert after[6].ESTADO_VALIDACION == "RECHAZADO MANUAL" and after[6].ALERTAS == "Ninguno de los 2 candidatos fue considerado válido" and after[6].CUIT_ASIGNADO is None
    assert after[1].ESTADO_VALIDACION == "VALIDADO (DNI Y NOMBRE COINCIDENTES)" and after[1].USUARIO_DECISION is None


def test_counts_of_comparisons_and_media(spark):
    rows = spark.createDataFrame([(1, "Ana Paz", "ANA PAZ", "a@b.c; d@e.f"), (2, "Ana Paz", "Otro", "x"), (3, "", "Otro", None)], "id int, a string, b string, m string")
    _, counts = processes.run("comparacion", rows, NOW, id_col="id", left="a", right="b")
    row = counts.first()
    assert row["total"] == 3 and row["exactas"] == 1 and sum(row["por_motivo"].values()) == 3
    result, counts = processes.run("denominacion", rows, NOW, left="a", right="b", least=250.0)
    assert {r.UMBRAL for r in result.collect()} == {100.0} and {r.ANALISIS for r in result.collect()} >= {"DENOMINACION EXACTA", "DENOMINACION VACIA"}
    assert counts.first().asDict() == {"total": 3, "coincidentes": 1, "parciales": 0, "sin_coincidencia": 2}
    _, counts = processes.run("normalizacion", rows, NOW, key="id", media=["m"])
    assert counts.first()["cuit_unicos"] == 3


def test_one_failing_client_stops_nobody(spark):
    def load(client):
        if client["name"] == "b":
            raise RuntimeError("no connection")
        return spark.createDataFrame([(1, "a@gmail.com")], "id int, mail string")

    clients = [{"name": n, "parameters": {"id_col": "id", "column": "mail"}} for n in "abc"]
    assert [t[:2] for t in processes.run_all(clients, load, "dep_mails", NOW)] == [("a", "FINALIZADO"), ("b", "ERROR"), ("c", "FINALIZADO")]


def test_features_and_second_opinion(spark):
    rows = mail_features.features(spark.createDataFrame([("ana12@gmail.com",), ("nothing",), (None,)], "mail string"), "mail").collect()
    by = {r.mail: r for r in rows}
    assert by["ana12@gmail.com"].racha_max_letras_usuario == 3 and by["ana12@gmail.com"].ratio_digitos_usuario == 0.4 and by["ana12@gmail.com"].similitud_max_dominio_conocido == 1.0
    assert by["nothing"].longitud_total == 0 and by[None].tiene_doble_punto == 0
    judged = spark.createDataFrame([("CONSERVADO", "ok", 0.1), ("BAJA", "no", 0.9), ("BAJA", "no", None)], "ESTADO string, MOTIVO string, s double")
    assert [r.ESTADO for r in mail_features.second_opinion(judged, "s").collect()] == ["REVISION MANUAL", "REVISION MANUAL", "BAJA"]


def test_interrupted_runs(spark):
    log = spark.createDataFrame([("1", "EN_CURSO"), ("2", "EN_CURSO"), ("3", "FINALIZADO")], "ID string, ESTADO string")
    assert {r.ID: r.ESTADO for r in processes.run_states(log, ["2"]).collect()} == {"1": "INTERRUMPIDO", "2": "EN_CURSO", "3": "FINALIZADO"}
