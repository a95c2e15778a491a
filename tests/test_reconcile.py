"""The reconciliation on hand-checked cases, with workbooks written and read back."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import columns as C
from loomline.operators import learn
from loomline.operators import reconcile as Q
from loomline.runner import Parameters, layer_report, reconcile
from loomline.sinks.reports import newest_report, rotate
from loomline.sinks.xlsx import Sheet, letters, write_workbook
from loomline.sources.xlsx import column_number, read_workbooks

CONTROLS = [("CODX", "Fijo", "CODIGO", "w1"), ("FEC", "PreFijo", "FECHA", "w2"), ("F", "PreFijo", "FLAG", "w3")]
INVENTORY = [("T1", "CODX", "CODIGO", "2"), ("T1", "FECALTA", "FLAG", "x"), ("T1", "FLGZ", "FLAG", "1"), ("T1", "ZZ1", "X", None)]
LAYER = [(" t1 ", " codx "), ("T1", "SINQA"), ("nan", "..")]


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame(INVENTORY, "TABLA_FISICA string, CAMPO_FISICO string, PARENT_DOMAIN string, ORDEN_FISICO string")


@pytest.fixture(scope="module")
def controls(spark):
    return spark.createDataFrame(CONTROLS, "CONTROL string, LINEAMIENTO string, PARENT_DOMAIN string, WARNING_PARENT_DOMAIN string")


def test_domains(spark, inventory, controls):
    got = {r.CAMPO_FISICO: (r.LINEAMIENTO, r.CONTROL, r.Observaciones) for r in Q.check_domains(inventory, controls).collect()}
    assert got == {"CODX": ("Fijo", "CODX", "OK"), "FECALTA": ("PreFijo", "FEC", "w2"), "FLGZ": ("PreFijo", "F", "OK"), "ZZ1": ("PreFijo", "OBSERVADO", None)}
    none = spark.createDataFrame([], controls.schema)
    assert {r.CONTROL for r in Q.check_domains(inventory, none).collect()} == {"OBSERVADO"}
    twice = inventory.unionByName(inventory)
    assert Q.check_domains(twice, controls).count() == 8


def test_layers(spark, inventory):
    document = spark.createDataFrame([(*r, "f.xlsm", str(i)) for i, r in enumerate(LAYER)], "`TABLA DDV` string, `CAMPO DDV` string, ARCHIVO string, ROW_ID string")
    two = inventory.where("CAMPO_FISICO in ('CODX', 'FECALTA')")
    got = layer_report(document, two, "DDV", ["TABLA DDV", "CAMPO DDV"], ["TABLA DDV", "CAMPO DDV"])
    assert sorted((r.CAMPO, r.QA_Campo, r.ORDEN, r.ARCHIVO) for r in got.collect()) == [("CODX", "OK", "1", "f.xlsm"), ("FECALTA", "En QA pero no en DA", None, None), ("SINQA", "No esta modelado", "2", "f.xlsm")]


def test_nulls_and_fan_out(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    b = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "k string, v int")
    got = Q.compare(a, b, ["k"]).groupBy("QA_Campo").count().collect()
    assert {tuple(r) for r in got} == {("OK", 4), ("No esta modelado", 1), ("En QA pero no en DA", 1)}


def test_order_and_cleaning(spark, inventory):
    assert [r.ORDEN_FISICO for r in Q.in_order(inventory).collect()] == [1, 2, None]
    raw = spark.createDataFrame([(" NaN ", 1.5), ("..", None), (None, 2.0), (" a ", 0.0)], "a string, b double")
    assert [tuple(r) for r in C.clean_all(raw).collect()] == [("", "1.5"), ("", None), (None, "2.0"), ("a", "0.0")]
    assert C.strip_suffix(spark.createDataFrame([], "TABLA_DDV string, `CAMPO DDV` string"), "ddv").columns == ["TABLA", "CAMPO"]
    assert C.strip_suffix(spark.createDataFrame([], "TABLA_DDV string"), "DDV", keep_underscore=True).columns == ["TABLA_"]
    assert C.fold_headers(spark.createDataFrame([], "`Año` string")).columns == ["Ano"]
    with pytest.raises(ValueError, match="missing columns: Z"):
        C.require(raw, ["Z"])


def test_changes(spark):
    before = spark.createDataFrame([("A", "No esta modelado"), ("B", "No esta modelado"), ("C", "OK")], "k string, QA_Campo string")
    now = spark.createDataFrame([("B", "No esta modelado"), ("C", "En QA pero no en DA")], before.schema)
    assert [tuple(r) for r in Q.changes(before, now, ["k"]).collect()] == [("Nuevo", 1, "C"), ("Resuelto", 1, "A"), ("Persistente", 1, "B")]
    empty = before.limit(0)
    assert [r.Cantidad for r in Q.changes(empty, empty, ["k"]).collect()] == [0, 0, 0]


def test_hints(spark):
    rows = spark.createDataFrame([(i, "F1", "No esta modelado") for i in range(3)] + [(9, "F2", "x"), (10, "F2", "x")], "i int, f string, k string")
    assert [tuple(r) for r in learn.error_patterns(rows, "f", "k", "i").collect()] == [("F1", "No esta modelado", 3, "Agregar al modelo")]
    names = spark.createDataFrame([("cliente",), ("fecha",)], "n string")
    known = spark.createDataFrame([("clientes",), ("importe",)], "m string")
    assert [(r.name, r.suggestion, r.confidence) for r in learn.close_names(names, "n", known, "m").collect()] == [("cliente", "clientes", "Alta")]
    few = spark.createDataFrame([("a", "X")], "n string, label string")
    model, accuracy = learn.train_domains(few, ["n"], "label")
    assert model is None and accuracy is None and learn.suggest_domains(few, model, ["n"], "label").first().suggested == "N/A"
    many = spark.createDataFrame([(f"FEC_ALTA_{i % 3}", "FECHA") for i in range(20)] + [(f"COD_{i % 3}", "CODIGO") for i in range(20)], few.schema)
    model, accuracy = learn.train_domains(many, ["n"], "label", trees=5)
    assert accuracy == 1.0
    assert learn.suggest_domains(many, model, ["n"], "label").where("suggested <> label").count() == 0
    assert learn.observed(spark.createDataFrame([("OK",), (None,), ("w",)], "Observaciones string")).count() == 2
    v = learn.name_vectors(spark.createDataFrame([("CODIGO",), ("CODIGOS",), ("FECHA",)], "n string"), "n")
    assert [(r.a, r.b) for r in learn.similar_pairs(v, "n", "vector", 0.6).collect()] == [("CODIGO", "CODIGOS")]


def test_workbooks(spark, tmp_path):
    assert letters(27) == "AB" and column_number("AB3") == 27
    write_workbook(str(tmp_path / "P_a.xlsx"), [Sheet("s", ["x", "Y z"], [("1", "a&<b"), (None, None), (2.0, True)])])
    write_workbook(str(tmp_path / "P_b.xlsx"), [Sheet("s", ["y Z", "w"], [("c", 3)])])
    write_workbook(str(tmp_path / "P_c.xlsx"), [Sheet("other", ["x"], [("c",)])])
    (tmp_path / "P_d.xlsx").write_text("no workbook")
    got = read_workbooks(spark, str(tmp_path), ["P_"], ".xlsx", "s").orderBy("ROW_ID").drop("ROW_ID")
    assert got.columns == ["X", "Y Z", "W", "ARCHIVO"]
    assert [tuple(r) for r in got.collect()] == [("1", "a&<b", None, "P_a.xlsx"), ("2", "True", None, "P_a.xlsx"), (None, "c", "3", "P_b.xlsx")]
    with pytest.raises(FileNotFoundError):
        read_workbooks(spark, str(tmp_path), "P_c", ".xlsx", "s")


def test_whole_run(spark, tmp_path):
    folder = tmp_path / "base" / "Run1"
    folder.mkdir(parents=True)
    control = str(tmp_path / "control.xlsx")
    cell = lambda layer, name, prefix, sheet, check="SI": (layer, check, name, prefix, sheet)
    parameters = [cell("QA", "TABLA_FISICA", "QA_", "m"), cell("QA", "CAMPO_FISICO", "QA_", "m"), cell("DDV", "TABLA DDV", "DA_", "d"), cell("DDV", "CAMPO DDV", "DA_", "d")]
    write_workbook(control, [Sheet("parametros", ["CAPA", "VALIDAR", "NOM_CAMPO_ARCHIVO", "NOM_PREFIJO_ARCHIVO", "NOM_HOJA"], parameters), Sheet("controles", ["CONTROL", "LINEAMIENTO", "PARENT_DOMAIN", "WARNING_PARENT_DOMAIN"], CONTROLS)])
    write_workbook(str(folder / "QA_m.xlsx"), [Sheet("m", ["TABLA_FISICA", "CAMPO_FISICO", "PARENT_DOMAIN", "ORDEN_FISICO"], INVENTORY)])
    banner = [("x", None)] * 4
    write_workbook(str(folder / "DA_d.xlsm"), [Sheet("d", ["b", "b"], [*banner, ("TABLA DDV", "CAMPO DDV"), *LAYER])])
    p = Parameters(str(tmp_path / "base"), "run1", control, "a@b.com", keep_reports=1)
    first = reconcile(spark, p)
    assert {tuple(r) for r in first["report"].groupBy("QA_Campo").count().collect()} == {("OK", 1), ("No esta modelado", 1), ("En QA pero no en DA", 3)}
    assert newest_report(str(folder), p.report_prefix)
    second = reconcile(spark, p)
    assert [r.Cantidad for r in second["changes"].collect()] == [0, 0, 4]
    assert rotate(str(folder), p.report_prefix, 1) == []
    assert Parameters(str(tmp_path / "no"), "x", "no", "bad").problems() == ["not a mail address: bad", f"no such folder: {tmp_path / 'no'}", "no control file no"]


def test_arrival_order_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [r.ORDEN for r in Q.arrival_order(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_hints_of_all_pairs(spark, monkeypatch):
    import numpy as np

    names = spark.createDataFrame([("CODIGO",), ("SALDO",), ("XODIGO",)], "n string")
    known = spark.createDataFrame([("CODIGO",), ("ASLDO",), ("FECHA",)], "k string")
    got = sorted((r.name, r.suggestion, r.place) for r in learn.close_by_edits(names, "n", known, "k", cutoff=0.6).collect())
    assert got == [("SALDO", "ASLDO", 1), ("XODIGO", "CODIGO", 1)]
    monkeypatch.setattr(learn, "BLOCK_ROWS", 7)
    x = np.random.default_rng(1).standard_normal((40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, None), (51, [0.0] * 4), (52, [1.0, None, 1.0, 1.0])]
    got = {(r.a, r.b): r.similarity for r in learn.similar_pairs(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v", 0.5).collect()}
    y = x / np.sqrt((x * x).sum(1))[:, None]
    want = {(i, j): float(y[i] @ y[j]) for i in range(40) for j in range(i + 1, 40) if y[i] @ y[j] > 0.5}
    assert got == pytest.approx(want)


def test_run_names_similar_fields(spark, tmp_path):
    folder = tmp_path / "base" / "Run1"
    folder.mkdir(parents=True)
    control = str(tmp_path / "control.xlsx")
    cell = lambda layer, name, prefix, sheet, check="SI": (layer, check, name, prefix, sheet)
    parameters = [cell("QA", "TABLA_FISICA", "QA_", "m"), cell("QA", "CAMPO_FISICO", "QA_", "m"), cell("DDV", "TABLA DDV", "DA_", "d"), cell("DDV", "CAMPO DDV", "DA_", "d")]
    write_workbook(control, [Sheet("parametros", ["CAPA", "VALIDAR", "NOM_CAMPO_ARCHIVO", "NOM_PREFIJO_ARCHIVO", "NOM_HOJA"], parameters), Sheet("controles", ["CONTROL", "LINEAMIENTO", "PARENT_DOMAIN", "WARNING_PARENT_DOMAIN"], CONTROLS)])
    inventory = [("T", "CODIGO", "X", 1), ("T", "CODIGOS", "X", 2), ("T", "FECHA", "X", 3)]
    write_workbook(str(folder / "QA_m.xlsx"), [Sheet("m", ["TABLA_FISICA", "CAMPO_FISICO", "PARENT_DOMAIN", "ORDEN_FISICO"], inventory)])
    write_workbook(str(folder / "DA_d.xlsm"), [Sheet("d", ["b", "b"], [*[("x", None)] * 4, ("TABLA DDV", "CAMPO DDV"), ("T", "CODIGO")])])
    names = lambda threshold: [(r.a, r.b) for r in reconcile(spark, Parameters(str(tmp_path / "base"), "run1", control, dry_run=False, hints=True, threshold=threshold))["Similares"].collect()]
    assert names(0.6) == [("CODIGO", "CODIGOS")] and names(0.99) == []
