"""The two applications from end to end: script lineage, and the reconciliation of documents with a model."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.columns import any_filled, clean_all, missing_columns, reorder, strip_suffix, upper_trim
from loomline.operators import lineage as L
from loomline.operators import reconcile as Q
from loomline.operators.learn import error_patterns, name_vectors, observed, similar_pairs, suggest_domains, train_domains
from loomline.sinks import reports
from loomline.sources.scripts import find_folder, read_scripts
from loomline.sources.xlsx import read_workbooks

VERSION = "0.1.0"


# -- script lineage ----------------------------------------------------------------------------


def lineage_tables(scripts: DataFrame, *, plain_select: bool = False, drop_quotes: bool = False) -> dict[str, DataFrame]:
    """All tables of a lineage run, lazily."""
    found = L.comments(scripts)
    codes = L.script_codes(found)
    rows = L.analysed(L.statements(scripts, plain_select=plain_select, drop_quotes=drop_quotes)).persist()
    done = L.mapped(rows).persist()
    mapping = L.propagate_binds(L.field_mapping(done, codes))
    rest = L.remainder(scripts, rows)
    return {
        "general": L.general(scripts, done, rest, found, codes), "statements": done.drop("mapping"), "field_mapping": mapping, "procedures": L.procedures(rows),
        "comments": found, "impact": L.impact(mapping), "remainder": rest, "annotated": L.annotated(scripts, rows),
    }


def run_lineage(spark: SparkSession, script_path: str, output_path: str, employee: str | None = None, workbook: bool = True) -> dict[str, DataFrame]:
    """Reads scripts, writes Parquet tables, the run log, side scripts and the workbook; returns the tables."""
    began = datetime.now()
    scripts = read_scripts(spark, script_path)
    if scripts.isEmpty():
        return {}
    out = lineage_tables(scripts)
    tables = {k: v for k, v in out.items() if k not in ("remainder", "annotated")}
    reports.write_tables(tables, f"{output_path}/tables")
    if os.path.isdir(script_path):
        for column, folder in (("remainder", "remain"), ("annotated", "analysis")):
            os.makedirs(os.path.join(script_path, folder), exist_ok=True)
            reports.write_scripts(out[column], column, os.path.join(script_path, folder))
    reports.write_run_log(f"{output_path}/run_{began:%Y%m%d_%H%M%S}.json", out["general"], began, VERSION, employee)
    if workbook:
        reports.write_lineage(out, f"{output_path}/lineage_{began:%Y%m%d_%H%M%S}.xlsx")
    return out


# -- reconciliation ----------------------------------------------------------------------------


@dataclass
class Parameters:
    """A reconciliation run."""

    base: str
    folder: str
    control_file: str
    user: str = ""
    dry_run: bool = False
    keep_reports: int = 5
    hints: bool = False
    threshold: float = 0.85
    mail_domain: str = r"[\w.-]+\.\w+"
    layers: tuple[str, ...] = ("DDV", "UDV")
    report_prefix: str = field(default="Reporte_Validacion_QA_")

    def problems(self) -> list[str]:
        """Everything that is wrong with the parameters."""
        out = []
        if self.user and not re.fullmatch(rf"[\w.+-]+@{self.mail_domain}", self.user):
            out.append(f"not a mail address: {self.user}")
        if not os.path.isdir(self.base):
            out.append(f"no such folder: {self.base}")
        elif not self.folder.strip():
            out.append("the folder is empty")
        elif find_folder(self.base, self.folder) is None:
            out.append(f"no folder {self.folder} in {self.base}")
        if not os.path.isfile(self.control_file):
            out.append(f"no control file {self.control_file}")
        return out


def require_files(folder: str, model_prefix: str, document_prefixes: list[str]) -> None:
    """At least one model inventory and one document."""
    names = os.listdir(folder)
    if not any(n.startswith(model_prefix) for n in names):
        raise FileNotFoundError(f"no model inventory {model_prefix}* in {folder}")
    if not any(n.startswith(tuple(document_prefixes)) for n in names):
        raise FileNotFoundError(f"no document {document_prefixes} in {folder}")


def layer_report(document: DataFrame, model: DataFrame, layer: str, fields: list[str], checked: list[str], order: str = "ROW_ID") -> DataFrame:
    """One layer's documented columns against the whole model."""
    numbered = Q.arrival_order(document, [order], "ORDEN").drop(order)
    keep = ["ORDEN", "ARCHIVO", *[c for c in fields if c in numbered.columns]]
    rows = clean_all(numbered.select(*[c for c in keep if c in numbered.columns]))
    rows = rows.where(any_filled([c for c in fields if c in rows.columns]))
    rows = strip_suffix(upper_trim(rows, checked), layer)
    keyed = model.select(F.col("TABLA_FISICA").alias("TABLA"), F.col("CAMPO_FISICO").alias("CAMPO"))
    return reorder(Q.compare(rows, keyed, ["TABLA", "CAMPO"]), ["ORDEN", "ARCHIVO"])


def reconcile(spark: SparkSession, p: Parameters) -> dict[str, DataFrame]:
    """Reads the workbooks of a folder, compares, checks domains, and writes the report."""
    if found := p.problems():
        raise ValueError("; ".join(found))
    folder = find_folder(p.base, p.folder)
    base, control = os.path.split(p.control_file)
    extension = os.path.splitext(control)[1]
    parameters = read_workbooks(spark, base, control, extension, "parametros", only_file=control, add_filename=False)
    controls = read_workbooks(spark, base, control, extension, "controles", only_file=control, add_filename=False).drop("ROW_ID").dropDuplicates()
    cells = parameters.select("CAPA", "VALIDAR", "NOM_CAMPO_ARCHIVO", "NOM_PREFIJO_ARCHIVO", "NOM_HOJA", "ROW_ID").orderBy("ROW_ID").collect()  # the parameter sheet
    of = lambda layer: [r for r in cells if (r.CAPA or "").upper() == layer]
    names = lambda rows: list(dict.fromkeys(r.NOM_CAMPO_ARCHIVO.upper() for r in rows if r.NOM_CAMPO_ARCHIVO))
    first = lambda rows, c: next((r[c] for r in rows if r[c]), None)
    checked = lambda rows: names([r for r in rows if (r.VALIDAR or "").upper() == "SI"])
    qa = of("QA")
    require_files(folder, first(qa, "NOM_PREFIJO_ARCHIVO") or "", [first(of(x), "NOM_PREFIJO_ARCHIVO") or "" for x in p.layers])
    model = read_workbooks(spark, folder, first(qa, "NOM_PREFIJO_ARCHIVO") or "", ".xlsx", first(qa, "NOM_HOJA"))
    if gone := missing_columns(model, ["TABLA_FISICA", "CAMPO_FISICO", "PARENT_DOMAIN", "ORDEN_FISICO"]):
        raise ValueError(f"the model inventory lacks {', '.join(gone)}")
    model = upper_trim(clean_all(model.drop("ROW_ID")), checked(qa) or ["TABLA_FISICA", "CAMPO_FISICO"]).persist()
    layers = []
    for layer in p.layers:
        rows = of(layer)
        if not rows:
            continue
        try:
            document = read_workbooks(spark, folder, first(rows, "NOM_PREFIJO_ARCHIVO") or "", ".xlsm", first(rows, "NOM_HOJA"), skip_rows=5)
        except FileNotFoundError:
            continue
        layers.append(layer_report(document, model, layer, names(rows), checked(rows)))
    report = Q.all_layers(layers).withColumn("ORDEN", F.expr("try_cast(ORDEN as double)")).orderBy(F.col("ORDEN").asc_nulls_last()).persist()
    checks = Q.in_order(Q.check_domains(model, controls))
    out = {"report": report, "model": checks, "summary": Q.summary(report, checks)}
    earlier = reports.newest_report(folder, p.report_prefix)
    if earlier:
        before = read_workbooks(spark, folder, os.path.basename(earlier), ".xlsx", "Consolidado_DA", only_file=os.path.basename(earlier), add_filename=False).withColumnRenamed("QA_CAMPO", "QA_Campo")
        rows = Q.changes(before, report, ["TABLA", "CAMPO"]).collect()  # three rows, taken before the earlier report moves
        out["changes"] = spark.createDataFrame(rows, "Tipo string, Cantidad bigint, Detalle string")
    hints: dict[str, DataFrame] = {}
    if p.hints:
        trained, _ = train_domains(model, ["CAMPO_FISICO", "TABLA_FISICA"], "PARENT_DOMAIN")
        hints["PD_Sugeridos"] = suggest_domains(observed(checks), trained, ["CAMPO_FISICO", "TABLA_FISICA"], "PARENT_DOMAIN").withColumn("alternatives", F.array_join("alternatives", ", "))
        fields = name_vectors(model.select("CAMPO_FISICO").where("CAMPO_FISICO <> ''").distinct(), "CAMPO_FISICO")
        hints["Similares"] = similar_pairs(fields, "CAMPO_FISICO", "vector", p.threshold).orderBy("a", "b")
        hints["Errores"] = error_patterns(report.where(F.col("QA_Campo") != Q.OK), "CAMPO", "QA_Campo", "ORDEN")
    if p.dry_run:
        reports.preview(report).show(truncate=False)
        return out
    name = f"{p.report_prefix}{p.folder}_{datetime.now():%Y%m%d_%H%M%S}.xlsx"
    reports.write_report(report, checks, os.path.join(folder, name), out["summary"], out.get("changes"), hints)
    reports.rotate(folder, p.report_prefix, p.keep_reports)
    reports.closing(out["summary"])
    report.unpersist()
    model.unpersist()
    return out | hints
