"""Workbooks as DataFrames: files are listed and read by Spark, one row a file, and opened where they are read."""

from __future__ import annotations

import io
import logging
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("loomline")
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def column_number(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None) -> list[list[str | None]] | None:
    """Cells of a sheet as text, the first sheet if none is named; None if there is no such sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(f"{_R}id") for s in book.iter(f"{_M}sheet")}
        name = sheet if sheet is not None else next(iter(sheets), None)
        if name not in sheets:
            return None
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[name]].lstrip("/")
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_M}row"):
            at = int(row.get("r", len(out) + 1)) - 1
            while len(out) <= at:
                out.append([])
            for k, c in enumerate(row.iter(f"{_M}c")):
                value, kind = c.find(f"{_M}v"), c.get("t")
                if kind == "inlineStr":
                    text = _text(c)
                elif value is None or value.text is None:
                    text = None
                elif kind == "s":
                    text = shared[int(value.text)]
                elif kind == "b":
                    text = "True" if value.text == "1" else "False"
                else:
                    text = value.text[:-2] if re.fullmatch(r"-?\d+\.0", value.text) else value.text
                n = column_number(c.get("r")) if c.get("r") else k
                cells = out[at]
                cells.extend([None] * (n + 1 - len(cells)))
                cells[n] = text or None
        return out


def _cells(sheet: str | None, skip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                why, header, rows = None, [], []
                try:
                    found = sheet_rows(content, sheet)
                    if found is None:
                        why = f"no sheet {sheet!r}"
                    elif len(found) <= skip:
                        why = "empty"
                    else:
                        header = [(h or f"COLUMN_{i}").strip().upper() for i, h in enumerate(found[skip])]
                        rows = [r + [None] * (len(header) - len(r)) for r in found[skip + 1 :]]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    why = f"unreadable: {e}"
                kept = [(i, r[: len(header)]) for i, r in enumerate(rows) if any(x is not None for x in r)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * (len(kept) + 1)), pa.array([None, *[i for i, _ in kept]], pa.int64()), pa.array([header, *[r for _, r in kept]], pa.list_(pa.string())), pa.array([why, *[None] * len(kept)], pa.string())],
                    ["path", "row", "cells", "why"],
                )

    return run


def read_workbooks(spark: SparkSession, folder: str, prefix: str | list[str] = "", extension: str = ".xlsx", sheet: str | None = None, skip_rows: int = 0, add_filename: bool = True, only_file: str | None = None) -> DataFrame:
    """Rows of all fitting workbooks of a folder, by column name, all text, headers in capitals, rows of nulls left out.

    ARCHIVO is the file, ROW_ID orders the rows. Workbooks without the sheet, empty or broken
    ones are skipped with a message; none that can be used is an error.
    """
    prefixes = [prefix] if isinstance(prefix, str) else list(prefix)
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(folder)
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | name.startswith(p)
    files = files.where(fits & ~name.startswith("~$") & ((name == only_file) if only_file else F.lit(True)))
    cells = files.select("path", "content").repartition("path").mapInArrow(_cells(sheet, skip_rows), "path string, row bigint, cells array<string>, why string")
    heads = cells.where("row is null").select("path", "cells", "why").orderBy("path").collect()  # one header a file
    for h in heads:
        if h.why:
            log.warning("%s is skipped: %s", h.path, h.why)
    usable = [h for h in heads if not h.why]
    if not usable:
        raise FileNotFoundError(f"no usable workbook {prefixes}*{extension} in {folder}")
    columns = list(dict.fromkeys(c for h in usable for c in h.cells))
    rows = cells.where("row is not null").withColumn("file", name)
    by_path = F.create_map(*[x for h in usable for x in (F.lit(h.path), F.array(*[F.lit(c) for c in h.cells]))])
    pairs = F.map_from_entries(F.filter(F.zip_with(by_path[F.col("path")], F.col("cells"), lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda e: e["key"].isNotNull()))
    rows = rows.withColumn("m", pairs)
    order = F.concat_ws("\u0001", F.col("path"), F.format_string("%012d", F.col("row")))
    shown = [F.col("m")[c].alias(c) for c in columns] + ([F.col("file").alias("ARCHIVO")] if add_filename else [])
    return rows.select(*shown, order.alias("ROW_ID"))
