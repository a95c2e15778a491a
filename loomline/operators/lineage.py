"""Scripts to statements to mapping rows, with coverage; parsing runs in Arrow batches, the rest is DataFrame work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomline import schemas
from loomline.functions.columns import is_control, job_code, modified, percent, with_missing
from loomline.sqlfront.mappers import MAPPERS, map_statement
from loomline.sqlfront.splitter import split, strip_comments

#: A literal (group 1) or a comment (group 2), whichever comes first: what splitter.strip_comments tells apart, as a column.
_LITERAL_OR_COMMENT = r"('(?:[^']++|'')*+')|(--[^\n]*|(?s:/\*.*?\*/))"


def without_comments(script: str | Column) -> Column:
    """The script without its comments; comment signs inside quotes stay."""
    return F.regexp_replace(script, _LITERAL_OR_COMMENT, "$1")


def comments(scripts: DataFrame) -> DataFrame:
    """One row a comment, with its position, job code and date; scripts without comments give none."""
    found = F.filter(F.regexp_extract_all("script", F.lit(_LITERAL_OR_COMMENT), 2), lambda x: x != "")
    rows = scripts.select("filename", F.posexplode(found).alias("comment_id", "comment"))
    return rows.select("filename", job_code(F.col("comment")).alias("job_code"), modified(F.col("comment")).alias("last_modif_date"), F.col("comment_id").cast("int").alias("comment_id"), "comment")


def script_codes(found: DataFrame) -> DataFrame:
    """First job code and latest date of each script; a date that can't be read leaves the script without one."""
    date = F.expr("try_to_date(last_modif_date, 'dd/MM/yyyy')")
    unread = F.col("last_modif_date").isNotNull() & date.isNull()
    return found.groupBy("filename").agg(
        F.min_by("job_code", F.when(F.col("job_code").isNotNull(), F.col("comment_id"))).alias("job_code"),
        F.when(~F.bool_or(unread), F.date_format(F.max(date), "dd/MM/yyyy")).alias("last_modif_date"),
    )


def _statement_rows(filename_path, filename, script, plain_select, drop_quotes) -> list[tuple]:
    found = split(strip_comments(script or "")[1], plain_select, drop_quotes)
    number = {id(s): i for i, s in enumerate(found)}
    out = []
    for i, s in enumerate(found):
        p = s.parent
        parent = (p.kind, p.text, p.start_line, p.end_line, number[id(p)]) if p else (None,) * 5
        out.append((filename_path, filename, i, s.kind, s.text, s.variables, s.start_line, s.end_line, s.raw_kind, s.raw_text, *parent))
    return out


def statements(scripts: DataFrame, *, plain_select: bool = False, drop_quotes: bool = False) -> DataFrame:
    """One row a statement, numbered within its script, children with their parents."""
    names = [c.split()[0] for c in schemas.STATEMENT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for a, b, c in batch.itertuples(index=False) for r in _statement_rows(a, b, c, plain_select, drop_quotes)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("parent_start_line", "parent_end_line", "parent_statement_id"):
                out[c] = out[c].astype("Int32")
            yield out

    return scripts.select("filename_path", "filename", "script").mapInPandas(run, schemas.STATEMENT)


def analysed(rows: DataFrame) -> DataFrame:
    """flag_to_analyze: whether there is a mapper for the statement."""
    return rows.withColumn("flag_to_analyze", F.col("statement_type").isin(*MAPPERS).cast("int"))


def mapped(rows: DataFrame) -> DataFrame:
    """Statements with `mapping` (array of mapping rows), flag_mapping_success and mapping_exception."""
    names = rows.columns
    ints = [f.name for f in rows.schema if f.dataType.simpleString() == "int"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{kinds}, mapping array<{schemas.MAPPING_ITEM}>, flag_mapping_success int, mapping_exception string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [map_statement(k, s, int(i)) for k, s, i in zip(batch["statement_type"], batch["statement"], batch["statement_id"], strict=True)]
            for c in ints:
                batch[c] = batch[c].astype("Int32")
            yield batch[names].assign(mapping=[g[0] for g in got], flag_mapping_success=[g[1] for g in got], mapping_exception=[g[2] for g in got])

    return rows.mapInPandas(run, schema)


def field_mapping(done: DataFrame, codes: DataFrame) -> DataFrame:
    """The fact table: one row a mapping of the statements that succeeded."""
    rows = done.where("flag_mapping_success = 1").select("filename", "statement_type", "statement", "statement_id", F.inline("mapping"))
    return rows.join(codes, "filename", "left").select(*schemas.FIELD_COLUMNS)


def keep_first_mappings(rows: DataFrame, order: str, by: tuple[str, ...] = ("input_table_alias", "input_field", "output_field_alias", "expression_sql")) -> DataFrame:
    """The first of the rows that agree in these columns."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def propagate_binds(mapping: DataFrame) -> DataFrame:
    """Rows whose expression is a `:variable` take what the last SELECT INTO put into it; their field stays."""
    taken = ["expression_sql", "input_table_name", "input_schema_path", "input_object_type"]
    source = mapping.where("clause = 'begin_select_into' and output_field_alias is not null")
    last = source.groupBy(F.col("output_field_alias").alias("_bind")).agg(F.max_by(F.struct(*taken), F.struct("filename", "statement_id", "expression_sql")).alias("_from"))
    hit = F.col("_bind").isNotNull() & F.col("statement_type").startswith("INSERT")
    out = mapping.join(last, (F.col("expression_sql") == F.col("_bind")) & F.col("statement_type").startswith("INSERT"), "left")
    return out.select(*[F.when(hit, F.col("_from")[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in mapping.columns])


def impact(mapping: DataFrame) -> DataFrame:
    return with_missing(mapping, schemas.IMPACT_COLUMNS)


def procedures(rows: DataFrame) -> DataFrame:
    """Calls of procedures, and whether they are control procedures."""
    return rows.where("statement_type = 'EXECUTE_PROCEDURE'").select("filename_path", "filename", "statement_type", "statement", "statement_id", is_control(F.col("statement")).alias("is_control_procedure"))


def remainder(scripts: DataFrame, rows: DataFrame) -> DataFrame:
    """Scripts without comments and top-level statements, blank lines and margins: what no statement covers."""
    top = rows.where("parent_statement_id is null").groupBy("filename_path", "filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("statement_id", "raw_statement"))), lambda s: s["raw_statement"]).alias("found"))
    bare = scripts.withColumn("script", without_comments("script")).join(top, ["filename_path", "filename"], "left")
    rest = F.aggregate(F.coalesce("found", F.array().cast("array<string>")), F.col("script"), lambda text, s: F.replace(text, s, F.lit("")))
    lines = F.filter(F.transform(F.split(rest, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return bare.select("filename_path", "filename", F.array_join(lines, "\n").alias("remainder"))


def annotated(scripts: DataFrame, rows: DataFrame, mark: str = "loomline") -> DataFrame:
    """Scripts without comments, with a line before and after each analysed statement that tells its number."""
    marked = rows.where("flag_to_analyze = 1").groupBy("filename_path", "filename").agg(F.array_sort(F.collect_list(F.struct("statement_id", "raw_statement", F.col("parent_statement_id").alias("parent")))).alias("found"))
    label = lambda s, w: F.concat(F.lit(f"-- [{mark}] "), F.when(s["parent"].isNotNull(), F.concat(F.lit("Parent Statement ID: "), s["parent"].cast("string"), F.lit(", "))).otherwise(""), F.lit("Statement ID: "), s["statement_id"].cast("string"), F.lit(f" {w}"))
    text = F.aggregate(F.coalesce("found", F.array().cast("array<struct<statement_id:int,raw_statement:string,parent:int>>")), without_comments("script"), lambda t, s: F.replace(t, s["raw_statement"], F.concat(label(s, "begin"), F.lit("\n"), s["raw_statement"], F.lit("\n"), label(s, "end"))))
    return scripts.join(marked, ["filename_path", "filename"], "left").select("filename_path", "filename", text.alias("annotated"))


def line_coverage(scripts: DataFrame, rest: DataFrame) -> DataFrame:
    count = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(F.col(c), "\n")))
    filled = F.array_join(F.filter(F.transform(F.split(without_comments("script"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    both = scripts.withColumn("filled", filled).join(rest, ["filename_path", "filename"])
    both = both.select("filename_path", "filename", count("filled").alias("q_lines_script"), count("remainder").alias("q_lines_no_coverage"))
    return both.withColumn("%_lines_coverage", percent(F.col("q_lines_script") - F.col("q_lines_no_coverage"), F.col("q_lines_script")))


def statement_coverage(done: DataFrame) -> DataFrame:
    out = done.groupBy("filename_path", "filename").agg(F.count("*").cast("int").alias("q_statements"), F.sum("flag_to_analyze").cast("int").alias("q_statements_to_analyze"), F.sum("flag_mapping_success").cast("int").alias("q_statements_success_analysis"))
    return out.withColumn("%_statement_coverage", percent(F.col("q_statements_success_analysis"), F.col("q_statements_to_analyze")))


def general(scripts: DataFrame, done: DataFrame, rest: DataFrame, found: DataFrame, codes: DataFrame) -> DataFrame:
    """One row a script: its codes and how much of it is covered."""
    n = found.groupBy("filename").agg(F.count("*").cast("int").alias("q_comments"))
    out = line_coverage(scripts, rest).join(statement_coverage(done), ["filename_path", "filename"], "left").join(codes, "filename", "left").join(n, "filename", "left")
    counts = ["q_statements", "q_statements_to_analyze", "q_statements_success_analysis", "q_comments"]
    return out.na.fill(0, counts).select("filename_path", "filename", "job_code", "last_modif_date", "q_lines_script", "q_lines_no_coverage", *counts, "%_lines_coverage", "%_statement_coverage")


# -- the parsers as table functions of SQL ------------------------------------------------------


@udtf(returnType="statement_id int, statement_type string, statement string, start_line int, end_line int")
class SplitStatements:
    def eval(self, script: str):
        for r in _statement_rows(None, None, script, False, False):
            yield r[2], r[3], r[4], r[6], r[7]


@udtf(returnType="clause string, input_schema_path string, input_table_name string, input_field string, output_table string, output_field_alias string, expression_sql string")
class MapFields:
    def eval(self, kind: str, statement: str, statement_id: int):
        for r in map_statement(kind, statement, statement_id)[0]:
            yield tuple(r[c] for c in ("clause", "input_schema_path", "input_table_name", "input_field", "output_table", "output_field_alias", "expression_sql"))


def register_functions(spark: SparkSession) -> None:
    """split_statements(script) and map_fields(kind, statement, id), for LATERAL joins in SQL."""
    spark.udtf.register("split_statements", SplitStatements)
    spark.udtf.register("map_fields", MapFields)
