"""Scripts to tables, and the lineage closure, on hand-checked cases."""

import json
import zipfile

import pytest

from loomline.operators import lineage as L
from loomline.plans import graph as G
from loomline.runner import lineage_tables, run_lineage
from loomline.sources.scripts import read_scripts
from loomline.sources.xlsx import read_workbooks

SCRIPT = """-- JOB : @ABC1
/* modified 01/02/2024 and 09/09/2024 */
-- fix 03/05/2024
WHENEVER SQLERROR EXIT 1;
BEGIN SELECT MAX(CODMES) INTO :V_MES FROM DW.CALENDAR WHERE FLAG='A'; END;
INSERT INTO TGT (CODMES, N) SELECT :V_MES, A.N FROM SRC A;
EXEC PKG_CONTROL.RUN('x');
loose words
"""


@pytest.fixture(scope="module")
def tables(spark):
    return lineage_tables(spark.createDataFrame([("/s", "a.sql", SCRIPT), ("/s", "empty.sql", ""), ("/s", "none.sql", None)], "filename_path string, filename string, script string"))


def test_comments_and_codes(spark, tables):
    assert [(r.comment_id, r.job_code, r.last_modif_date) for r in tables["comments"].orderBy("comment_id").collect()] == [(0, "@ABC1", None), (1, None, "01/02/2024"), (2, None, "03/05/2024")]
    assert L.script_codes(tables["comments"]).first()[1:] == ("@ABC1", "03/05/2024")
    odd = spark.createDataFrame([("a", 0, "-- 01-02-2024"), ("a", 1, "-- 01/03/2024")], "filename string, comment_id int, comment string")
    from loomline.functions.columns import job_code, modified
    from pyspark.sql import functions as F

    odd = odd.select("filename", "comment_id", job_code(F.col("comment")).alias("job_code"), modified(F.col("comment")).alias("last_modif_date"))
    assert L.script_codes(odd).first()[1:] == (None, None)


def test_statements_and_coverage(tables):
    rows = tables["statements"].orderBy("statement_id").collect()
    assert [(r.statement_type, r.flag_to_analyze, r.flag_mapping_success) for r in rows] == [("WHENEVER", 0, 0), ("BEGIN_END", 1, 1), ("INSERT_INTO_SELECT", 1, 1), ("EXECUTE_PROCEDURE", 0, 0)]
    general = {r.filename: r for r in tables["general"].collect()}
    assert general["a.sql"]["%_statement_coverage"] == 100.0 and general["a.sql"]["%_lines_coverage"] == 80.0 and general["a.sql"].q_comments == 3
    assert general["empty.sql"]["%_lines_coverage"] is None and general["empty.sql"].q_statements == 0
    assert tables["remainder"].where("filename = 'a.sql'").first().remainder == "loose words"
    assert "-- [loomline] Statement ID: 2 begin" in tables["annotated"].where("filename = 'a.sql'").first().annotated


def test_binds_procedures_and_impact(tables):
    got = {(r.output_field_alias, r.expression_sql, r.input_table_name, r.input_field) for r in tables["field_mapping"].where("statement_type like 'INSERT%'").collect()}
    assert got == {("CODMES", "MAX(CODMES)", "CALENDAR", ""), ("N", "A.N", "SRC", "N")}
    assert tables["procedures"].first().is_control_procedure is True
    assert len(tables["impact"].columns) == 29


def test_sql_functions(spark):
    L.register_functions(spark)
    got = spark.sql("SELECT s.statement_type, m.input_field FROM VALUES ('INSERT INTO T SELECT A.X FROM A;') v(q), LATERAL split_statements(q) s, LATERAL map_fields(s.statement_type, s.statement, s.statement_id) m").collect()
    assert [tuple(r) for r in got] == [("INSERT_INTO_SELECT", "X")]


def test_run(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    out.mkdir()
    (src / "sub" / "a.SQL").write_bytes(SCRIPT.encode() + b"\xff")
    (src / "b.txt").write_text("DROP TABLE X;")
    assert read_scripts(spark, str(tmp_path / "nowhere")).count() == 0
    run_lineage(spark, str(src), str(out), "E1")
    assert (src / "remain" / "a.SQL").read_text().strip() == "loose words"
    assert json.loads(next(out.glob("run_*.json")).read_text())["user"] == "E1"
    book = next(out.glob("lineage_*.xlsx"))
    assert zipfile.is_zipfile(book)
    assert read_scripts(spark, str(src)).count() == 1  # side files are no scripts
    back = read_workbooks(spark, str(out), "lineage_", ".xlsx", "field_mapping_resume")
    assert back.where("CLAUSE = 'select'").count() == 2
    heads = read_workbooks(spark, str(out), "lineage_", ".xlsx", "impact_report", skip_rows=2)
    assert "TIPO PROCESO" in heads.columns


def edges(spark, *pairs):
    return spark.createDataFrame([(f, a, b) for f, a, b in pairs], "filename string, source string, target string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_closure(spark):
    e = edges(spark, ("f", "A", "B"), ("f", "B", "C"), ("f", "A", "C"), ("f", "C", "D"))
    assert rows(G.roots(e), "node") == [("A",)] and rows(G.leaves(e), "node") == [("D",)]
    got = rows(G.forward_tables(e), "level", "source", "target")
    assert got == [(0, "", "A"), (1, "A", "B"), (1, "A", "C"), (2, "B", "C"), (2, "C", "D")]
    assert (0, "D", "") in rows(G.backward_tables(e), "level", "source", "target")
    assert rows(G.table_lineage(e), "origin", "destination", "step", "level")[0][:2] == ("A", "D")


def test_cycles_end(spark):
    e = edges(spark, ("f", "Z", "R"), ("f", "R", "R"), ("f", "R", "S"), ("g", "Z", "A"), ("g", "A", "B"), ("g", "B", "A"))
    got = rows(G.forward_tables(e), "filename", "level", "source", "target")
    assert ("f", 2, "R", "R") in got and ("f", 2, "R", "S") in got and ("g", 3, "B", "A") in got and max(r[1] for r in got) == 3
    assert rows(G.leaves(e), "filename", "node") == [("f", "S")]
    G.backward_tables(e).count()


def test_levels_with_a_shortcut(spark):
    e = edges(spark, ("f", "A", "B"), ("f", "B", "C"), ("f", "A", "C"), ("f", "C", "D"))
    assert rows(G.table_lineage(e), "step", "level") == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    assert rows(G.forward_tables(e, again=True), "level", "source", "target") == [(0, "", "A"), (1, "A", "B"), (1, "A", "C"), (2, "B", "C"), (2, "C", "D"), (3, "C", "D")]
    assert rows(G.backward_tables(e, again=True), "level", "source", "target") == [(-3, "A", "B"), (-2, "A", "C"), (-2, "B", "C"), (-1, "C", "D"), (0, "D", "")]
    c = e.selectExpr("filename", "source", "source || '_k' source_field", "target", "target || '_k' target_field", "'select' clause", "'x' expression_sql")
    assert rows(G.column_lineage(c, e), "step", "level") == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    assert (3, "C", "D") in rows(G.forward_columns(c, G.root_columns(c, e), again=True), "level", "source", "target")
    # a cycle that is entered on two levels is left on two levels, and ends
    e = edges(spark, ("f", "A", "B"), ("f", "A", "P"), ("f", "B", "P"), ("f", "P", "Q"), ("f", "Q", "P"), ("f", "Q", "D"), ("f", "D", "D"), ("f", "D", "E"))
    got = rows(G.forward_tables(e, again=True), "level", "source", "target")
    assert (3, "Q", "D") in got and (4, "Q", "D") in got and (5, "D", "E") in got and max(r[0] for r in got) == 5
    assert dict(rows(G.table_lineage(e), "step", "level"))["A"] == 0


def test_columns(spark):
    c = spark.createDataFrame([("f", "A", "x", "B", "y", "select", "x"), ("f", "B", "y", "C", "z", "select", "y+1")], "filename string, source string, source_field string, target string, target_field string, clause string, expression_sql string")
    t = c.select("filename", "source", "target").distinct()
    got = rows(G.column_lineage(c, t), "origin", "origin_field", "destination", "destination_field", "step", "step_field", "level", "expression_sql")
    assert got == [("A", "x", "C", "z", "A", "x", 0, ""), ("A", "x", "C", "z", "B", "y", 1, "x"), ("A", "x", "C", "z", "C", "z", 2, "y+1")]


def test_versions(spark):
    r = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate([("AUX", "CTAS"), ("CTAS", "AUX"), ("AUX", "FIN")])], "filename string, row_id int, input_table string, output_table string")
    got = [(x.input_table, x.output_table) for x in G.version_cycles(r).orderBy("row_id").collect()]
    assert got == [("AUX", "CTAS"), ("CTAS", "AUX [v2]"), ("AUX [v2]", "FIN")]
    three = spark.createDataFrame([("f", 0, "A", "B"), ("f", 1, "B", "C"), ("f", 2, "C", "A"), ("f", 3, "A", "A"), ("g", 0, "A", "X")], r.schema)
    assert rows(G.mutual(three.selectExpr("input_table source", "output_table target")), "source", "target") == [("A", "B"), ("B", "C"), ("C", "A")]


def test_stream(spark, tmp_path):
    from loomline.streaming.scripts import stream_mapping

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO T SELECT A.X FROM A;")
    stream_mapping(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().flag_mapping_success == 1
