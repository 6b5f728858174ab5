"""Result tables, audit columns, the registry's sources and the record of runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contactdq.operators import mail_agent
from contactdq.plans import history, processes, schemas
from contactdq.sources import files, publish, registry
from contactdq.streaming import incremental

NOW = datetime(2026, 8, 4, 16, 30, 5)


def test_results_take_their_types(spark):
    rows = spark.createDataFrame([(1, "luis@gmeil.com " + "x" * 900, "1111111"), (2, None, None)], "id int, mail string, tel string")
    for name in ("dep_mails", "mails"):
        result, counts = processes.run(name, rows, NOW, id_col="id", column="mail")
        table = schemas.typed(result, schemas.columns_of(name))
        assert table.columns == [c for c, _ in schemas.columns_of(name)] and table.count() == 2 and counts.first()["total"] == 2
        assert max(len(r.MAIL_ORIGINAL or "") for r in table.collect()) == {"dep_mails": 320, "mails": 300}[name]
    assert {r.FUE_DEPURADO for r in processes.run("dep_mails", rows, NOW, id_col="id", column="mail")[0].collect()} <= {"SI", "NO"}
    for name, more in (("telefonos", {}), ("dep_telefonos", {})):
        result, _ = processes.run(name, rows, NOW, id_col="id", column="tel", **more)
        assert set(schemas.typed(result, schemas.columns_of(name)).columns) >= set(result.columns)
    result, _ = processes.run("comparacion", rows, NOW, id_col="id", left="mail", right="tel")
    assert schemas.typed(result, schemas.columns_of("comparacion")).columns == result.columns
    spark.sql(schemas.create_table("results_of_phones", schemas.columns_of("telefonos")))
    schemas.typed(processes.run("telefonos", rows, NOW, id_col="id", column="tel")[0], schemas.columns_of("telefonos")).write.insertInto("results_of_phones")
    assert spark.table("results_of_phones").count() == 2
    spark.sql("DROP TABLE results_of_phones")
    assert schemas.normalisation_schema("¡!", ["Teléfono 1"], ["Zona"]) == (("CLAVE", "VARCHAR(300)"), ("TELEFONO_1", "VARCHAR(300)"), ("ZONA", "VARCHAR(300)"))
    with pytest.raises(ValueError):
        schemas.create_table("a; drop", ())


def test_audit_columns_are_found_and_added(spark):
    found, missing = schemas.find_fields(["ID_MAIL", "MAIL_ORIGINAL", "CORREO_MAIL", "BMA_FECHA_BAJA", "user_baja"])
    assert found == {"col_mail": "CORREO_MAIL", "col_fecha_baja": "BMA_FECHA_BAJA", "col_usuario_baja": "user_baja", "col_id": "ID_MAIL"}
    assert missing == ["MOTIVO_BAJA", "FECHA_MOD", "USUARIO_MOD", "MOTIVO_MOD", "NORMALIZADO_LINGUISTICO"]
    rows = spark.createDataFrame([("a@b.c",), (None,), ("d@e.f",)], "mail string").repartition(3)
    table = schemas.traceable(rows, "mail")
    assert table.columns[:2] == ["ID", "MAIL"] and sorted(r.ID for r in table.collect()) == [1, 2, 3] and schemas.find_fields(table.columns)[1] == []
    assert schemas.with_audit_columns(table).columns == table.columns


def test_registry_sources(spark, tmp_path):
    rows = spark.createDataFrame([("20-12345678-3", "PAZ ANA", "12.345.678"), ("27-22334455-8", "GOMEZ", "22334455")], "CUIT string, DENOMINACION string, DNI string")
    path = f"file://{tmp_path}/padron"
    assert registry.write_snapshot(rows, path, NOW, "test") == 2
    rows.createOrReplaceTempView("padron_view")
    for opened in (registry.open_registry(spark, path=path), registry.open_registry(spark, "snapshot", path=path), registry.open_registry(spark, "dblink", table="padron_view"), registry.open_registry(spark, table="padron_view")):
        assert [r.DENOMINACION for r in registry.partial_search(opened, "4567").collect()] == ["PAZ ANA"]
        assert registry.partial_search(opened, "2-2").count() == 1 and registry.partial_search(opened, "x").count() == 0 and registry.partial_search(opened, "3", 1).count() == 1
    assert spark.read.parquet(f"{path}/meta").first()["filas"] == 2
    for mode in ("other", "auto", "remoto"):
        with pytest.raises(ValueError):
            registry.open_registry(spark, mode)


def test_runs_are_recorded(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    first = history.Run(spark, folder, "mails", NOW, usuario="ana")
    second = history.Run(spark, folder, "cuit", NOW + timedelta(seconds=5))
    first.say(NOW, "reading")
    first.end(NOW, "FINALIZADO", {"total": 3}, tabla_resultado="T")
    got = history.history(spark, folder).collect()
    assert [(r.id, r.estado) for r in got] == [(second.row["id"], "EN_CURSO"), (first.row["id"], "FINALIZADO")]
    assert got[1].stats == {"total": "3"} and got[1].log == ["16:30:05  reading"] and history.history(spark, folder, 1).count() == 1


def test_csv_beside_the_table_and_linguistic_log(spark, tmp_path):
    rows = spark.createDataFrame([("ana arroba hotmail punto com",), ("ana arroba hotmail punto com",), ("luis@gmail.com",), (None,)], "m string")
    log = mail_agent.linguistic_log(rows, "m").collect()
    assert [(r.MAIL_ORIGINAL, r.MAIL_NORMALIZADO) for r in log] == [("ana arroba hotmail punto com", "ana@hotmail.com")] and log[0].DETALLE
    assert publish.publish_with_csv(rows, f"file://{tmp_path}/t", f"file://{tmp_path}/c") == 4
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).count() >= 3


def workbook(path, rows, shared=True):
    """A workbook of two sheets; the second, active one has the rows, None for a cell that is not there."""
    import zipfile
    from xml.sax.saxutils import escape

    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings, body = [], ""
    for r, cells in rows:
        body += f'<row r="{r}">'
        for k, c in enumerate(cells):
            if isinstance(c, str) and shared:
                strings.append(c)
                body += f'<c r="{chr(65 + k)}{r}" t="s"><v>{len(strings) - 1}</v></c>'
            elif isinstance(c, str):
                body += f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{escape(c)}</t></is></c>'
            elif c is not None:
                body += f'<c r="{chr(65 + k)}{r}"><v>{c}</v></c>'
        body += "</row>"
    sheet = f'<worksheet xmlns="{main}"><sheetData>{{}}</sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="rId1"/><sheet name="b" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(""))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format(body))
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{escape(x[:2])}</t></r><r><t>{escape(x[2:])}</t></r></si>" for x in strings) + "</sst>")


def test_workbooks(spark, tmp_path):
    for shared in (True, False):
        path = f"{tmp_path}/{shared}.xlsx"
        workbook(path, [(1, ["Reporte"]), (3, ["username", "Nombre", "n"]), (4, ["x", "Ana & Luis", 7]), (6, [None, "Eva"]), (7, [None, None, None])], shared)
        assert [(r.username, r.Nombre, r.n) for r in files.read_contacts(spark, path, "nombre").collect()] == [("x", "Ana & Luis", "7"), ("", "Eva", "")]
        workbook(path, [(1, ["CUIT", "Correo"]), (2, [20123456783, "a@b.c", "more"])], shared)
        rows, header, _ = files.read_table(spark, path)
        assert header == ["CUIT", "Correo"] and [tuple(r) for r in rows.collect()] == [("20123456783", "a@b.c", "more")]
    workbook(f"{tmp_path}/none.xlsx", [])
    assert files.read_table(spark, f"{tmp_path}/none.xlsx")[0].count() == 0


def test_registry_and_mail_files(spark, tmp_path):
    path = f"{tmp_path}/r.csv"
    open(path, "w").write("id,nombre\n7,Ana\n,\n,Luis\n9,\n,Eva\n")
    assert [tuple(r) for r in files.read_registry(spark, path, "id", "nombre").collect()] == [("7", "Ana"), ("3", "Luis"), ("5", "Eva")]
    open(path, "w", encoding="utf-8-sig").write("ID_MAIL;Mail;x\n1;a@b.c;,\n")
    rows, key, mail = files.read_mail_file(spark, path)
    assert (key, mail) == ("ID_MAIL", "Mail") and rows.first().Mail == "a@b.c"
    open(path, "w").write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_mail_file(spark, path)


def test_incremental_stamps(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "id int, v string")
    first = incremental.pending(table)
    assert first.count() == 4 and incremental.new_rows(table, table.filter("id = 2"), "id").count() == 3
    after = incremental.stamped(table, first.filter("v IN ('a', 'c')"), "id", NOW)
    assert sorted(r.v for r in incremental.pending(after).collect()) == ["b", "c"]
    again = incremental.stamped(after, table, "id", NOW + timedelta(days=1))
    assert {r.v: r.FECHA_PROCESADO for r in again.collect()} == {"a": NOW, "d": NOW, "b": NOW + timedelta(days=1), "c": None}
    texts = spark.createDataFrame([("x" * 10,), ("y" * 11,), (None,)], "t string").select(publish.shortened(F.col("t"), 10).alias("s"))
    assert [r.s for r in texts.collect()] == ["x" * 10, "y" * 7 + "...", None]


def test_file_against_file_and_the_second_pass(spark, tmp_path):
    a, b = f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"
    open(a, "w").write("Reporte\nusername,Nombre\nana1,Perez Juan\nana2,Juan Perez\n,Zzz Qqq\n")
    open(b, "w").write("id,denom\n,PEREZ JUAN\n9,GOMEZ ANA\n")
    got = processes.dry_run(spark, a, "nombre", b, "id", "denom", NOW).collect()
    assert {(r.ID_ARCHIVO, r.ID_BASE, r.COINCIDE) for r in got} == {("1", "1", "SI"), ("2", "1", "SI"), ("3", None, "NO")}
    rows, base = files.read_contacts(spark, a, "nombre"), files.read_registry(spark, b, "id", "denom")
    result, _ = processes.run("cruce_denominaciones", rows, NOW, base=base, user="username", left_id="username", left_name="Nombre", right_id="ID_BASE", right_name="DENOM")
    told = {r.ID_ARCHIVO: (r.COINCIDE, r.MOTIVO) for r in result.collect()}
    assert told["ana1"][0] == told["ana2"][0] == "RE" and "CONFLICTO_N1_EMPATE_SIN_EVIDENCIA" in told["ana1"][1] and told[""][0] == "NO"
