"""Registered queries of the lineage and reconciliation operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import columns as C
from loomline.operators import learn, lineage
from loomline.operators import reconcile as Q
from loomline.plans import graph

FLAGSHIP = "reconcile_full_outer"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- reconciliation ----------------------------------------------------------------------------

#: Whole tables on either side; the keys are spread by 2 and 3, so that each side has some that the other lacks.
_DOCUMENTED = "(SELECT DISTINCT 2 * o_custkey AS k, 'orders' AS src FROM orders)"
_MODELLED = "(SELECT 3 * c_custkey AS k, c_mktsegment AS segment FROM customer)"
_STATE = "CASE WHEN d.k IS NOT NULL AND m.k IS NOT NULL THEN 'OK' WHEN d.k IS NOT NULL THEN 'No esta modelado' ELSE 'En QA pero no en DA' END"
_RECONCILED = f"SELECT coalesce(d.k, m.k) AS k, src, segment, {_STATE} AS \"QA_Campo\" FROM {_DOCUMENTED} d FULL JOIN {_MODELLED} m ON d.k = m.k"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documented = table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("k"), F.lit("orders").alias("src")).distinct()
    modelled = table(spark, sf_dir, "customer").select((3 * F.col("c_custkey")).alias("k"), F.col("c_mktsegment").alias("segment"))
    return documented, modelled


@query(_RECONCILED)
def reconcile_full_outer(spark, sf_dir):
    return Q.compare(*_sides(spark, sf_dir), ["k"])


_NATIONS = "SELECT n_nationkey AS k, n_name FROM nation"


@query(
    f"""SELECT coalesce(d.k, m.k) AS k, layer, n_name, {_STATE} AS "QA_Campo" FROM (SELECT DISTINCT 2 * c_nationkey AS k, 'customer' AS layer FROM customer) d FULL JOIN ({_NATIONS}) m ON d.k = m.k
UNION ALL SELECT coalesce(d.k, m.k) AS k, layer, n_name, {_STATE} AS "QA_Campo" FROM (SELECT DISTINCT 3 * s_nationkey AS k, 'supplier' AS layer FROM supplier) d FULL JOIN ({_NATIONS}) m ON d.k = m.k"""
)
def reconcile_layers_union(spark, sf_dir):
    model = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    layer = lambda t, c, n: table(spark, sf_dir, t).select((n * F.col(c)).alias("k"), F.lit(t).alias("layer")).distinct()
    return Q.all_layers([Q.compare(layer("customer", "c_nationkey", 2), model, ["k"]), Q.compare(layer("supplier", "s_nationkey", 3), model, ["k"])])


@query(
    f"""WITH r AS ({_RECONCILED}), a AS (SELECT count(*) AS total, count(*) FILTER ("QA_Campo" = 'OK') AS ok, count(*) FILTER ("QA_Campo" = 'No esta modelado') AS missing, count(*) FILTER ("QA_Campo" = 'En QA pero no en DA') AS surplus FROM r)
SELECT 'General' AS "Categoría", 'Total' AS "Métrica", CAST(total AS VARCHAR) AS "Valor" FROM a UNION ALL SELECT 'Estado', 'OK', CAST(ok AS VARCHAR) FROM a
UNION ALL SELECT 'Estado', 'No esta modelado', CAST(missing AS VARCHAR) FROM a UNION ALL SELECT 'Estado', 'En QA pero no en DA', CAST(surplus AS VARCHAR) FROM a
UNION ALL SELECT 'General', 'Cobertura', printf('%.2f', 100.0 * ok / total) || '%' FROM a
UNION ALL SELECT 'Recomendación', 'Modelar los campos documentados que faltan', CAST(missing AS VARCHAR) FROM a WHERE missing > 0
UNION ALL SELECT 'Recomendación', 'Documentar los campos que solo estan en el modelo', CAST(surplus AS VARCHAR) FROM a WHERE surplus > 0"""
)
def coverage_summary(spark, sf_dir):
    return Q.summary(Q.compare(*_sides(spark, sf_dir), ["k"]))


_ISSUES = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = {}"


def _issues(spark, sf_dir, year):
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == year)).select(F.col("o_custkey").cast("string").alias("name")).distinct()


@query(f"{_ISSUES.format(1996)} EXCEPT {_ISSUES.format(1995)}")
def change_new(spark, sf_dir):
    return Q.new_issues(_issues(spark, sf_dir, 1995), _issues(spark, sf_dir, 1996))


@query(f"{_ISSUES.format(1995)} EXCEPT {_ISSUES.format(1996)}")
def change_resolved(spark, sf_dir):
    return Q.new_issues(_issues(spark, sf_dir, 1996), _issues(spark, sf_dir, 1995))


@query(f"{_ISSUES.format(1995)} INTERSECT {_ISSUES.format(1996)}")
def change_persistent(spark, sf_dir):
    return Q.persistent_issues(_issues(spark, sf_dir, 1995), _issues(spark, sf_dir, 1996))


@query(
    f"""WITH a AS ({_ISSUES.format(1995)}), b AS ({_ISSUES.format(1996)}), k AS (SELECT name, CASE WHEN a.name IS NULL THEN 'Nuevo' WHEN b.name IS NULL THEN 'Resuelto' ELSE 'Persistente' END AS t FROM a FULL JOIN b USING (name)),
c AS (SELECT t, count(*) AS n, list(name ORDER BY name)[1:10] AS heads FROM k GROUP BY t)
SELECT v.t AS "Tipo", coalesce(n, 0) AS "Cantidad", coalesce(array_to_string(heads, ', '), '') || CASE WHEN coalesce(n, 0) > 10 THEN '...' ELSE '' END AS "Detalle" FROM (VALUES ('Nuevo'), ('Resuelto'), ('Persistente')) v(t) LEFT JOIN c USING (t)"""
)
def change_report(spark, sf_dir):
    state = lambda y: _issues(spark, sf_dir, y).withColumn("QA_Campo", F.lit(Q.NOT_MODELLED))
    return Q.changes(state(1995), state(1996), ["name"])


_CONTROLS = [
    ("STANDARD BRASS", "Fijo", "25", "w0"), ("PROMO COPPER", "Fijo", "7", "w1"), ("ECONOMY", "PreFijo", "12", "w2"), ("ECONOMY B", "PreFijo", "30", "w3"), ("SMALL", "PreFijo", "41", "w4"), ("LARGE COP", "PreFijo", "3", "w5"), ("S", "PreFijo", "9", "w6"),
]
_CONTROL_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _CONTROLS) + ") ct(control, kind, domain, warning)"


def _controls(spark):
    return spark.createDataFrame(_CONTROLS, "CONTROL string, LINEAMIENTO string, PARENT_DOMAIN string, WARNING_PARENT_DOMAIN string")


def _fields(spark, sf_dir):
    metal = F.element_at(F.array(F.lit("BRASS"), F.lit("COPPER"), F.lit("TIN")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.upper("p_type"), metal).alias("CAMPO_FISICO"), F.col("p_size").cast("string").alias("PARENT_DOMAIN"))


_FIELD_SQL = "(SELECT p_partkey, upper(p_type) || ' ' || ['BRASS', 'COPPER', 'TIN'][p_partkey % 3 + 1] AS f, CAST(p_size AS VARCHAR) AS d FROM part) p"
_FIXED = f"""SELECT p_partkey, f AS "CAMPO_FISICO", d AS "PARENT_DOMAIN", CASE WHEN control IS NULL THEN 'PreFijo' ELSE 'Fijo' END AS "LINEAMIENTO", control AS "CONTROL",
CASE WHEN control IS NULL THEN NULL WHEN d = domain THEN 'OK' ELSE warning END AS "Observaciones" FROM {_FIELD_SQL} LEFT JOIN (SELECT * FROM {_CONTROL_SQL} WHERE kind = 'Fijo') c ON p.f = c.control"""
_PREFIX = f"""SELECT p_partkey, f AS "CAMPO_FISICO", d AS "PARENT_DOMAIN", 'PreFijo' AS "LINEAMIENTO", coalesce(control, 'OBSERVADO') AS "CONTROL",
CASE WHEN control IS NULL THEN NULL WHEN d = domain THEN 'OK' ELSE warning END AS "Observaciones" FROM {_FIELD_SQL} LEFT JOIN (SELECT * FROM {_CONTROL_SQL} WHERE kind = 'PreFijo') c ON starts_with(p.f, c.control)
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(control) DESC NULLS LAST) = 1"""


@query(_FIXED)
def fixed_rule_check(spark, sf_dir):
    return Q.check_fixed(_fields(spark, sf_dir), _controls(spark))


@query(_PREFIX)
def longest_prefix_rule(spark, sf_dir):
    return Q.check_prefix(_fields(spark, sf_dir), _controls(spark))


@query(f"""SELECT * FROM ({_FIXED}) WHERE "LINEAMIENTO" = 'Fijo' UNION ALL SELECT * FROM ({_PREFIX}) WHERE "CAMPO_FISICO" NOT IN (SELECT control FROM {_CONTROL_SQL} WHERE kind = 'Fijo')""")
def domain_check(spark, sf_dir):
    return Q.check_domains(_fields(spark, sf_dir), _controls(spark))


_CLEAN = "CASE WHEN lower(trim({0})) IN ('nan', '..') THEN '' ELSE trim({0}) END AS {1}"


@query(f"""SELECT {_CLEAN.format("CASE WHEN c_custkey % 10 = 0 THEN ' NaN ' WHEN c_custkey % 10 = 1 THEN '..' WHEN c_custkey % 10 = 2 THEN NULL ELSE ' ' || c_name || ' ' END", "c_name")}, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer""")
def clean_null_tokens(spark, sf_dir):
    m = F.col("c_custkey") % 10
    raw = table(spark, sf_dir, "customer").select(F.when(m == 0, " NaN ").when(m == 1, "..").when(m == 2, None).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("c_name"), "c_custkey")
    return C.clean_all(raw)


@query("SELECT doc_id, source FROM documents WHERE (lang IS NOT NULL AND trim(lang) <> '') OR (source IS NOT NULL AND trim(source) <> '')")
def any_nonempty_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(C.any_filled(["lang", "source"])).select("doc_id", "source")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def ordered_distinct(spark, sf_dir):
    return Q.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


@query('SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS "ORDEN" FROM supplier')
def arrival_order(spark, sf_dir):
    return Q.arrival_order(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.strip_accents(F.col("text"))).alias("folded"))


@query("SELECT event_id, TRY_CAST(raw AS INTEGER) AS n FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' || CAST(event_id AS VARCHAR) ELSE NULL END AS raw FROM events) WHERE raw IS NOT NULL")
def try_cast_order(spark, sf_dir):
    m = F.col("event_id") % 3
    raw = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.col("event_type")).when(m == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"))).alias("n"))
    return Q.in_order(raw, "n", "event_id")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, upper(trim(event_type)) AS event_type FROM events")
def header_and_case(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.col("event_type").alias(" EVENT TYPE ddv"))
    return C.strip_suffix(C.upper_trim(raw, [" EVENT TYPE ddv"]), "DDV").withColumnRenamed("EVENT_TYPE", "event_type")


# -- scripts -----------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(html, '(?i)</?(html|head|body|table|tr|th|td|b|font|center)\b[^>]*>', '', 'g') AS plain FROM (SELECT page_id AS doc_id, html FROM pages)""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), C.strip_html(F.col("html")).alias("plain"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS q_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS q_filled, round(100.0 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) / len(string_split(text, chr(10))), 1) AS share FROM documents")
def line_coverage(spark, sf_dir):
    lines = F.split("text", "\n")
    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("q_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("q_filled"))
    return counted.withColumn("share", C.percent(F.col("q_filled"), F.col("q_lines")))


@query("SELECT l_suppkey AS filename, CAST(count(*) AS INTEGER) AS q_statements, CAST(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) AS INTEGER) AS q_statements_to_analyze, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INTEGER) AS q_statements_success_analysis, 'x' AS filename_path, CASE WHEN sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) > 0 THEN round(100.0 * sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END), 1) END AS \"%_statement_coverage\" FROM lineitem GROUP BY l_suppkey")
def statement_coverage(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("filename_path"), F.col("l_suppkey").alias("filename"), F.col("l_returnflag").isin("A", "R").cast("int").alias("flag_to_analyze"), (F.col("l_returnflag") == "A").cast("int").alias("flag_mapping_success"))
    return lineage.statement_coverage(flags)


@query("SELECT conv_id, role, text, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def keep_first_mappings(spark, sf_dir):
    return lineage.keep_first_mappings(table(spark, sf_dir, "conversations"), "turn", ("conv_id", "role")).select("conv_id", "role", "text", "turn")


@query("SELECT page_id, string_split(host, '.')[-1] AS name, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[1] END AS schema_name, CASE WHEN starts_with(host, 'SUBQUERY') THEN 'SUBCONSULTA' WHEN host IS NOT NULL THEN 'TABLA' END AS kind FROM (SELECT page_id, string_split(url, '/')[3] AS host FROM pages)")
def name_split(spark, sf_dir):
    host = F.element_at(F.split("url", "/"), 3)
    return table(spark, sf_dir, "pages").select("page_id", C.table_of(host).alias("name"), C.schema_of(host).alias("schema_name"), C.object_type(host).alias("kind"))


_SCRIPTS = [
    ("/s", "a.sql", "-- JOB : @ABC1\n/* modified 01/02/2024 and 09/09/2024 */\n-- fix 03/05/2024\nWHENEVER SQLERROR EXIT 1;\nALTER SESSION SET X=1;\nTRUNCATE TABLE T; DROP TABLE U; EXEC PKG_CONTROL.RUN('x');\n"),
    ("/s", "b.sql", "BEGIN SELECT MAX(CODMES) INTO :V_MES FROM DW.CALENDAR WHERE FLAG='A'; END;\nINSERT INTO TGT (CODMES, N) SELECT :V_MES, A.N FROM SRC A;\n"),
    ("/s", "c.sql", "CREATE TABLE STOCK_T TABLESPACE D_X AS SELECT A.KEY_ID, ROW_NUMBER() OVER(PARTITION BY A.KEY_ID ORDER BY A.KEY_ID) AS NUM\n FROM DW.BALANCES A WHERE PROD_CODE IN ('P1');\nDELETE FROM TGT WHERE KEY_ID IN (SELECT KEY_ID FROM DW.GONE WHERE FLAG='S');\nUPDATE T_A SET FLAG='S' WHERE ID=47;\nEXECUTE IMMEDIATE 'DROP TABLE T_X';\n"),
    ("/s", "d.sql", "MERGE INTO TGT PARTITION (P1) A USING (SELECT DISTINCT C.KEY_ID FROM DW.CONSENTS C WHERE TRIM(C.CONSENT) = 'SI') B\n ON (A.KEY_ID=B.KEY_ID) WHEN MATCHED THEN UPDATE SET A.SENT_FLAG = NULL;\nSPOOL out.txt\nPROMPT ID;NAME\nSELECT A.ID||';'||A.NM FROM DW.CUST A;\nSPOOL OFF;\n"),
]


def _scripts(spark):
    return spark.createDataFrame(_SCRIPTS, "filename_path string, filename string, script string")


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


@query(_values([("a.sql", 0, "@ABC1", None), ("a.sql", 1, None, "01/02/2024"), ("a.sql", 2, None, "03/05/2024")], "filename, comment_id, job_code, last_modif_date"))
def comment_attributes(spark, sf_dir):
    return lineage.comments(_scripts(spark)).drop("comment")


@query(_values([("a.sql", "@ABC1", "03/05/2024")], "filename, job_code, last_modif_date"))
def script_codes(spark, sf_dir):
    return lineage.script_codes(lineage.comments(_scripts(spark)))


@query(
    _values(
        [
            ("a.sql", 0, "WHENEVER", 4, 0), ("a.sql", 1, "ALTER_SESSION", 5, 0), ("a.sql", 2, "TRUNCATE_TABLE", 6, 0), ("a.sql", 3, "DROP_TABLE", 6, 0), ("a.sql", 4, "EXECUTE_PROCEDURE", 6, 0),
            ("b.sql", 0, "BEGIN_END", 1, 1), ("b.sql", 1, "INSERT_INTO_SELECT", 2, 1), ("c.sql", 0, "CREATE_TABLE_AS", 1, 1), ("c.sql", 1, "DELETE", 3, 1), ("c.sql", 2, "UPDATE", 4, 1), ("c.sql", 3, "DROP_TABLE", 5, 0),
            ("d.sql", 0, "MERGE_INTO", 1, 1), ("d.sql", 1, "SPOOL_SELECT", 3, 1),
        ],
        "filename, statement_id, statement_type, start_line, flag_to_analyze",
    )
)
def split_statements(spark, sf_dir):
    return lineage.analysed(lineage.statements(_scripts(spark))).select("filename", "statement_id", "statement_type", "start_line", "flag_to_analyze")


def _mapping(spark):
    scripts = _scripts(spark)
    done = lineage.mapped(lineage.analysed(lineage.statements(scripts)))
    return lineage.propagate_binds(lineage.field_mapping(done, lineage.script_codes(lineage.comments(scripts))))


@query(
    _values(
        [
            ("b.sql", 0, "begin_select_into", "DW", "CALENDAR", "CODMES", None, ":V_MES", "MAX(CODMES)"), ("b.sql", 0, "where", "DW", "CALENDAR", "FLAG", None, None, "FLAG = 'A'"),
            ("b.sql", 1, "select", "DW", "CALENDAR", "", "TGT", "CODMES", "MAX(CODMES)"), ("b.sql", 1, "select", None, "SRC", "N", "TGT", "N", "A.N"),
            ("c.sql", 0, "select", "DW", "BALANCES", "KEY_ID", "STOCK_T", "KEY_ID", "A.KEY_ID"), ("c.sql", 0, "select", "DW", "BALANCES", "KEY_ID", "STOCK_T", "NUM", "ROW_NUMBER() OVER (PARTITION BY A.KEY_ID ORDER BY A.KEY_ID) AS NUM"),
            ("c.sql", 0, "where", "DW", "BALANCES", "PROD_CODE", "STOCK_T", None, "PROD_CODE IN ('P1')"), ("c.sql", 1, "select", "DW", "GONE", "KEY_ID", "TGT", "KEY_ID", None), ("c.sql", 1, "where", "DW", "GONE", "FLAG", "TGT", None, "FLAG = 'S'"),
            ("c.sql", 2, "update_set", None, None, None, "T_A", "FLAG", "FLAG = 'S'"),
            ("d.sql", 0, "select", "DW", "CONSENTS", "KEY_ID", "MERGE_USING_SUBQUERY_000", "KEY_ID", "C.KEY_ID"), ("d.sql", 0, "where", "DW", "CONSENTS", "CONSENT", "MERGE_USING_SUBQUERY_000", None, "TRIM(C.CONSENT) = 'SI'"),
            ("d.sql", 0, "merge_update", "", "", "", "TGT", "SENT_FLAG", "A.SENT_FLAG = NULL"), ("d.sql", 0, "merge_on", "", "MERGE_USING_SUBQUERY_000", "KEY_ID", "TGT", "KEY_ID", "A.KEY_ID = B.KEY_ID"),
            ("d.sql", 1, "select", "DW", "CUST", "ID", "out.txt", "ID", "A.ID"), ("d.sql", 1, "select", "DW", "CUST", "NM", "out.txt", "NM", "A.NM"),
        ],
        "filename, statement_id, clause, input_schema_path, input_table_name, input_field, output_table, output_field_alias, expression_sql",
    )
)
def map_statements(spark, sf_dir):
    return _mapping(spark).select("filename", "statement_id", "clause", "input_schema_path", "input_table_name", "input_field", "output_table", "output_field_alias", "expression_sql")


@query(_values([("a.sql", 4, "EXEC PKG_CONTROL.RUN('x');", 1)], "filename, statement_id, statement, control"))
def procedure_flags(spark, sf_dir):
    found = lineage.procedures(lineage.statements(_scripts(spark)))
    return found.select("filename", "statement_id", "statement", F.col("is_control_procedure").cast("int").alias("control"))


_CUSTOMER_SCRIPT = """-- JOB : @C{k} of 01/02/2024
INSERT INTO TGT{k} (K, N) SELECT A.K, A.N || '--x' FROM DW.SRC{n} A JOIN DW.REF B ON A.K = B.K WHERE A.SEG = 'it''s; {s}';
/* loose
words */
MERGE {k}
"""


def _customer_scripts(spark, sf_dir):
    """A script a customer, with comment signs and a semicolon inside its literals."""
    text = F.lit(_CUSTOMER_SCRIPT)
    for sign, column in (("{k}", "c_custkey"), ("{n}", "c_nationkey"), ("{s}", "c_mktsegment")):
        text = F.replace(text, F.lit(sign), F.col(column).cast("string"))
    return table(spark, sf_dir, "customer").select(F.lit("/c").alias("filename_path"), F.concat(F.col("c_custkey").cast("string"), F.lit(".sql")).alias("filename"), text.alias("script"))


@query("SELECT CAST(c_custkey AS VARCHAR) || '.sql' AS filename, 2 AS q_lines_script, 1 AS q_lines_no_coverage, CAST(50 AS DOUBLE) AS share, 'MERGE ' || CAST(c_custkey AS VARCHAR) AS remainder, 2 AS q_comments FROM customer")
def script_coverage(spark, sf_dir):
    """What no statement covers, in lines, of a script a customer."""
    scripts = _customer_scripts(spark, sf_dir)
    rest = lineage.remainder(scripts, lineage.statements(scripts))
    n = lineage.comments(scripts).groupBy("filename").agg(F.count("*").cast("int").alias("q_comments"))
    covered = lineage.line_coverage(scripts, rest).withColumnRenamed("%_lines_coverage", "share").join(rest.select("filename", "remainder"), "filename")
    return covered.join(n, "filename").drop("filename_path")


_CUSTOMER_ROWS = [
    f"SELECT c_custkey, '{clause}' AS clause, {source} AS t, '{field}' AS f, {output} AS o, {text} AS x FROM customer"
    for clause, source, field, output, text in (
        ("select", "'SRC' || c_nationkey", "K", "'K'", "'A.K'"), ("select", "'SRC' || c_nationkey", "N", "'N'", "'A.N || ''--x'''"),
        ("join_on", "'SRC' || c_nationkey", "K", "NULL", "'A.K = B.K'"), ("join_on", "'REF'", "K", "NULL", "'A.K = B.K'"),
        ("where", "'SRC' || c_nationkey", "SEG", "NULL", "'A.SEG = ''it''''s; ' || c_mktsegment || ''''"),
    )
]


@query(f"SELECT CAST(c_custkey AS VARCHAR) || '.sql' AS filename, '@C' || c_custkey AS job_code, clause, t AS input_table_name, f AS input_field, 'TGT' || c_custkey AS output_table, o AS output_field_alias, x AS expression_sql FROM ({' UNION ALL '.join(_CUSTOMER_ROWS)})")
def script_mappings(spark, sf_dir):
    """The mapping rows of a script a customer: projection, join and filter of an INSERT."""
    scripts = _customer_scripts(spark, sf_dir)
    done = lineage.mapped(lineage.analysed(lineage.statements(scripts)))
    rows = lineage.field_mapping(done, lineage.script_codes(lineage.comments(scripts)))
    return rows.select("filename", "job_code", "clause", "input_table_name", "input_field", "output_table", "output_field_alias", "expression_sql")


# -- closure -----------------------------------------------------------------------------------

#: Suppliers' parts by brand as files: region -> nation -> supplier -> part kind, with short cuts from regions to suppliers and nations to brands.
_EDGE_SQL = """(SELECT DISTINCT 'f' || CAST(n_regionkey % 2 AS VARCHAR) AS filename, 'R' || CAST(n_regionkey AS VARCHAR) AS source, 'N' || CAST(n_nationkey AS VARCHAR) AS target FROM nation
UNION SELECT 'f' || CAST(n_regionkey % 2 AS VARCHAR), 'N' || CAST(n_nationkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'f' || CAST(n_regionkey % 2 AS VARCHAR), 'S' || CAST(l_suppkey AS VARCHAR), 'B' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'f' || CAST(n_regionkey % 2 AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION SELECT 'f' || CAST(n_regionkey % 2 AS VARCHAR), 'N' || CAST(n_nationkey AS VARCHAR), 'B' || p_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _edges(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    file = F.concat(F.lit("f"), (F.col("n_regionkey") % 2).cast("string")).alias("filename")
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    up = nation.select(file, name("R", "n_regionkey").alias("source"), name("N", "n_nationkey").alias("target"))
    mid = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    brands = sold.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    made = brands.join(mid, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = [
        (mid, name("N", "n_nationkey"), name("S", "s_suppkey")), (made, name("S", "l_suppkey"), name("B", "p_brand")),
        (mid, name("R", "n_regionkey"), name("S", "s_suppkey")), (made, name("N", "n_nationkey"), name("B", "p_brand")),
    ]
    out = up
    for rows, source, target in edges:
        out = out.unionByName(rows.select(file, source.alias("source"), target.alias("target")))
    return out.distinct()


@query(f"SELECT * FROM {_EDGE_SQL} e")
def graph_edges(spark, sf_dir):
    return graph.table_edges(_edges(spark, sf_dir).withColumnsRenamed({"source": "input_table", "target": "output_table"}))


@query(f"SELECT DISTINCT filename, source AS node FROM {_EDGE_SQL} e WHERE (filename, source) NOT IN (SELECT (filename, target) FROM {_EDGE_SQL} x)")
def graph_roots(spark, sf_dir):
    return graph.roots(_edges(spark, sf_dir))


@query(f"SELECT DISTINCT filename, target AS node FROM {_EDGE_SQL} e WHERE (filename, target) NOT IN (SELECT (filename, source) FROM {_EDGE_SQL} x)")
def graph_leaves(spark, sf_dir):
    return graph.leaves(_edges(spark, sf_dir))


_FORWARD = f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGE_SQL} x), t AS (
SELECT DISTINCT filename, source AS origin, '' AS source, source AS target, 0 AS level FROM e WHERE (filename, source) NOT IN (SELECT (filename, target) FROM e)
UNION SELECT t.filename, t.origin, e.source, e.target, t.level + 1 FROM t JOIN e ON e.filename = t.filename AND e.source = t.target)"""
_BACKWARD = f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGE_SQL} x), t AS (
SELECT DISTINCT filename, target AS destination, target AS source, '' AS target, 0 AS level FROM e WHERE (filename, target) NOT IN (SELECT (filename, source) FROM e)
UNION SELECT t.filename, t.destination, e.source, e.target, t.level - 1 FROM t JOIN e ON e.filename = t.filename AND e.target = t.source)"""


@query(f"{_FORWARD} SELECT filename, origin, source, target, level FROM t")
def trace_forward_table(spark, sf_dir):
    return graph.forward_tables(durable_edges(spark, sf_dir), again=True)


@query(f"{_BACKWARD} SELECT filename, destination, source, target, level FROM t")
def trace_backward_table(spark, sf_dir):
    return graph.backward_tables(durable_edges(spark, sf_dir), again=True)


def durable_edges(spark, sf_dir):
    """The edges, cut from the tables they come from: a trace reads them at every level."""
    return graph.durable(_edges(spark, sf_dir))


@query(
    f"""{_FORWARD}, ends AS (SELECT DISTINCT filename, origin, target AS destination FROM t WHERE source <> '' AND (filename, target) NOT IN (SELECT (filename, source) FROM e)),
b AS (SELECT filename, origin, destination, destination AS node, 0 AS back FROM ends
UNION SELECT b.filename, b.origin, b.destination, s.source, b.back + 1 FROM b JOIN (SELECT DISTINCT filename, origin, source, target FROM t WHERE source <> '') s ON s.filename = b.filename AND s.origin = b.origin AND s.target = b.node)
SELECT filename, origin, destination, step, min(level) AS level FROM (SELECT filename, origin, destination, node AS step, CAST(dense_rank() OVER (PARTITION BY filename, origin, destination ORDER BY back DESC) - 1 AS INTEGER) AS level FROM b) GROUP BY ALL"""
)
def lineage_table(spark, sf_dir):
    return graph.table_lineage(durable_edges(spark, sf_dir))


_COLUMN_SQL = f"(SELECT filename, source, source || '_k' AS source_field, target, target || '_k' AS target_field, 'select' AS clause, source || '.k' AS expression_sql FROM {_EDGE_SQL} q)"


def _columns(spark, sf_dir):
    e = durable_edges(spark, sf_dir)
    key = lambda c: F.concat(F.col(c), F.lit("_k"))
    return e.select("filename", "source", key("source").alias("source_field"), "target", key("target").alias("target_field"), F.lit("select").alias("clause"), F.concat("source", F.lit(".k")).alias("expression_sql"))


@query(f"{_FORWARD} SELECT filename, origin, origin || '_k' AS origin_field, source, CASE WHEN source = '' THEN '' ELSE source || '_k' END AS source_field, target, target || '_k' AS target_field, CASE WHEN source = '' THEN '' ELSE 'select' END AS clause, CASE WHEN source = '' THEN '' ELSE source || '.k' END AS expression_sql, level FROM t")
def trace_forward_column(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return graph.forward_columns(c, graph.root_columns(c, c.select("filename", "source", "target")), again=True)


@query(f"{_BACKWARD} SELECT filename, destination, destination || '_k' AS destination_field, source, source || '_k' AS source_field, target, CASE WHEN target = '' THEN '' ELSE target || '_k' END AS target_field, CASE WHEN target = '' THEN '' ELSE 'select' END AS clause, CASE WHEN target = '' THEN '' ELSE source || '.k' END AS expression_sql, level FROM t")
def trace_backward_column(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return graph.backward_columns(c, graph.leaf_columns(c), again=True)


@query(
    ORACLE_SQL["lineage_table"].replace("SELECT filename, origin, destination, step, min(level) AS level FROM", "SELECT filename, origin, origin || '_k' AS origin_field, destination, destination || '_k' AS destination_field, step, step || '_k' AS step_field, level, CASE WHEN step = origin THEN '' ELSE 'select' END AS clause, coalesce((SELECT min(t.source) || '.k' FROM t WHERE t.source <> '' AND t.filename = g.filename AND t.origin = g.origin AND t.target = g.step), '') AS expression_sql FROM (SELECT filename, origin, destination, step, min(level) AS level FROM").replace("GROUP BY ALL", "GROUP BY ALL) g")
)
def lineage_column(spark, sf_dir):
    c = _columns(spark, sf_dir)
    return graph.column_lineage(c, c.select("filename", "source", "target"))


_CYCLES = [("f", 0, "AUX", "CTAS"), ("f", 1, "CTAS", "AUX"), ("f", 2, "AUX", "FIN"), ("g", 0, "A", "B"), ("g", 1, "B", "A"), ("g", 2, "B", "C")]


@query(_values([("f", 0, "AUX", "CTAS"), ("f", 1, "CTAS", "AUX [v2]"), ("f", 2, "AUX [v2]", "FIN"), ("g", 0, "A", "B"), ("g", 1, "B", "A [v2]"), ("g", 2, "B", "C")], "filename, row_id, input_table, output_table"))
def version_cycles(spark, sf_dir):
    return graph.version_cycles(spark.createDataFrame(_CYCLES, "filename string, row_id int, input_table string, output_table string"))


# -- hints -------------------------------------------------------------------------------------


@query("WITH c AS (SELECT user_id AS field, event_type AS kind, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL HAVING count(*) >= 3) SELECT field, kind, n, 'Revisar' AS suggestion FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY f DESC, kind DESC) = 1")
def error_patterns(spark, sf_dir):
    return learn.error_patterns(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT a, b, round(s, 9) AS similarity, CASE WHEN s > 0.95 THEN 'Posible Duplicado' ELSE 'Similar' END AS kind, CASE WHEN s > 0.95 THEN 'Alta' ELSE 'Media' END AS confidence, round(100 * s, 1) AS percent FROM p WHERE s > 0.3"""
)
def similar_pairs(spark, sf_dir):
    """Pairs of all rows, whatever their label."""
    return learn.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 9))


@query(
    """WITH a AS (SELECT DISTINCT p_name AS n FROM part),
p AS (SELECT a.n, b.n AS m, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 6) AS r FROM a JOIN a b ON a.n <> b.n)
SELECT n AS name, m AS suggestion, r AS ratio, CAST(row_number() OVER (PARTITION BY n ORDER BY r DESC, m) AS INTEGER) AS place FROM p WHERE r >= 0.7 QUALIFY row_number() OVER (PARTITION BY n ORDER BY r DESC, m) <= 3"""
)
def close_matches(spark, sf_dir):
    """Every name against every other, however it begins."""
    part = table(spark, sf_dir, "part")
    return learn.close_by_edits(part, "p_name", part, "p_name")


@query()
def domain_classifier(spark, sf_dir):
    """Predicted part type by name and brand, with the two next likeliest."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.element_at(F.split("p_type", " "), 1).alias("kind"))
    model, _ = learn.train_domains(rows, ["p_name", "p_brand"], "kind", trees=20)
    return learn.suggest_domains(rows, model, ["p_name", "p_brand"], "kind").withColumn("alternatives", F.array_join("alternatives", ","))
