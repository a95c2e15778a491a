"""Reports of a run: workbooks, run log, side scripts, rotation."""

from __future__ import annotations

import getpass
import json
import logging
import os
import shutil
from datetime import datetime

from pyspark.sql import DataFrame

from loomline.operators.reconcile import NOT_DOCUMENTED, OK
from loomline.schemas import IMPACT_BANDS, IMPACT_COLUMNS, IMPACT_KINDS, IMPACT_LABELS
from loomline.sinks.xlsx import Sheet, sheet_of, write_workbook

log = logging.getLogger("loomline")


def write_scripts(rows: DataFrame, column: str, folder: str) -> int:
    """One file a script; without the folder nothing is written, only logged."""
    if not os.path.isdir(folder):
        log.error("no such folder: %s", folder)
        return 0
    n = 0
    for r in rows.select("filename", column).toLocalIterator():
        with open(os.path.join(folder, r["filename"]), "w", encoding="utf-8") as f:
            f.write(r[column] or "")
        n += 1
    return n


def write_lineage(result: dict[str, DataFrame], path: str) -> None:
    """The lineage workbook: metrics, statements, mapping, calls, comments, impact with section heads."""
    names = {"general": "general_insights", "statements": "statements", "field_mapping": "field_mapping_resume", "procedures": "procedure_execution", "comments": "comments"}
    sheets = [sheet_of(sheet, result[k]) for k, sheet in names.items()]
    sheets.append(sheet_of("impact_report", result["impact"].select(*IMPACT_COLUMNS), labels=IMPACT_LABELS, bands=IMPACT_BANDS, kinds=IMPACT_KINDS))
    write_workbook(path, sheets)


def write_tables(result: dict[str, DataFrame], folder: str) -> None:
    """The same as Parquet tables, which have no bound."""
    for name, df in result.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def report_style(state_at: int):
    def style(row, i: int) -> str:
        state = row[state_at]
        return "orange" if state == NOT_DOCUMENTED else "yellow" if state != OK else "zebra" if i % 2 else "plain"

    return style


def write_report(report: DataFrame, model: DataFrame, path: str, summary: DataFrame | None = None, changes: DataFrame | None = None, hints: dict[str, DataFrame] | None = None, state_column: str = "QA_Campo") -> None:
    """The reconciliation workbook; hint sheets only if they hold rows, the comparison only after an earlier report."""
    sheets: list[Sheet] = []
    if summary is not None:
        sheets.append(sheet_of("Resumen", summary))
    sheets.append(sheet_of("Consolidado_DA", report, style=report_style(report.columns.index(state_column))))
    at = model.columns.index("Observaciones") if "Observaciones" in model.columns else None
    sheets.append(sheet_of("QA_MODELO", model, **({"style": lambda row, i: "yellow" if row[at] != OK else "zebra" if i % 2 else "plain"} if at is not None else {})))
    if changes is not None:
        sheets.append(sheet_of("Comparacion", changes))
    for name, df in (hints or {}).items():
        sheet = sheet_of(name, df)
        if sheet.rows:
            sheets.append(sheet)
    write_workbook(path, sheets)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    """What a dry run shows."""
    return df.limit(rows)


def newest_report(folder: str, prefix: str) -> str | None:
    """The report whose name sorts last: names end in a time stamp."""
    found = sorted(f for f in os.listdir(folder) if f.startswith(prefix) and f.endswith(".xlsx"))
    return os.path.join(folder, found[-1]) if found else None


def rotate(folder: str, prefix: str, keep: int, archive: str = "archivo") -> list[str]:
    """Keep the newest reports and move the older ones to the archive; tells which."""
    found = sorted((f for f in os.listdir(folder) if f.startswith(prefix) and f.endswith(".xlsx")), reverse=True)
    for f in found[keep:]:
        os.makedirs(os.path.join(folder, archive), exist_ok=True)
        shutil.move(os.path.join(folder, f), os.path.join(folder, archive, f))
    return found[keep:]


def user_name(employee: str | None = None) -> str:
    return employee or getpass.getuser()


def write_run_log(path: str, general: DataFrame, began: datetime, version: str, employee: str | None = None) -> dict:
    """Who ran what and when, with each script's metrics."""
    out = {"user": user_name(employee), "version": version, "start": began.isoformat(timespec="seconds"), "end": datetime.now().isoformat(timespec="seconds"), "scripts": [r.asDict() for r in general.toLocalIterator()]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=1)
    return out


def closing(summary: DataFrame) -> dict[str, str]:
    """The summary's numbers, also logged."""
    out = {f"{r[0]}/{r[1]}": r[2] for r in summary.collect()}
    for k, v in out.items():
        log.info("%s: %s", k, v)
    return out
