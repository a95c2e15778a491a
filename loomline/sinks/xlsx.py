"""Workbooks written with the standard library: styles, merged section heads, filters, frozen heads."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of one sheet; more don't fit the format.
MOST_ROWS = 1_048_000
# Fills by style number (0: none), as in the style sheet below.
STYLES = {"plain": 0, "head": 1, "zebra": 2, "yellow": 3, "orange": 4, "band": 5}
_FILLS = ("1F4E78", "F2F2F2", "FFFF00", "F4B183", "BDD7EE")


def _styles() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in _FILLS)
    cells = "".join(f'<xf fontId="{1 if i in (1, 5) else 0}" fillId="{i + 1 if i else 0}" borderId="0" applyFill="1" applyFont="1"/>' for i in range(len(_FILLS) + 1))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<fonts count="2"><font><sz val="10"/></font><font><b/><sz val="10"/></font></fonts>'
        f'<fills count="{len(_FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{len(_FILLS) + 1}">{cells}</cellXfs></styleSheet>'
    )


def letters(n: int) -> str:
    """A for 0, AA for 26."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass
class Sheet:
    name: str
    header: Sequence[str]
    rows: Sequence[Sequence]
    style: Callable[[Sequence, int], str] = lambda row, i: "zebra" if i % 2 else "plain"
    #: Section heads above the header: (text, how many columns).
    bands: Sequence[tuple[str, int]] = field(default_factory=list)
    #: A row of heads between the sections and the header.
    kinds: Sequence[str] = field(default_factory=list)
    widest: int = 50


def _cell(ref: str, value, style: int) -> str:
    if value is None:
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, bool):
        return f'<c r="{ref}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    text = "".join(c for c in str(value) if c in "\t\n\r" or ord(c) >= 32)
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet_xml(s: Sheet) -> str:
    widths = [min(s.widest, 2 + max([len(str(h)), *[len(str(r[i])) for r in s.rows[:1000] if r[i] is not None]])) for i, h in enumerate(s.header)]
    out, merges, at = [], [], 1
    if s.bands:
        cells, col = [], 0
        for text, n in s.bands:
            cells += [_cell(f"{letters(col + k)}{at}", text if k == 0 else None, STYLES["band"]) for k in range(n)]
            if n > 1:
                merges.append(f'<mergeCell ref="{letters(col)}{at}:{letters(col + n - 1)}{at}"/>')
            col += n
        out.append(f'<row r="{at}">{"".join(cells)}</row>')
        at += 1
    if s.kinds:
        out.append(f'<row r="{at}">' + "".join(_cell(f"{letters(i)}{at}", h, STYLES["band"]) for i, h in enumerate(s.kinds)) + "</row>")
        at += 1
    head = at
    out.append(f'<row r="{at}">' + "".join(_cell(f"{letters(i)}{at}", h, STYLES["head"]) for i, h in enumerate(s.header)) + "</row>")
    for i, row in enumerate(s.rows):
        at += 1
        style = STYLES[s.style(row, i)]
        out.append(f'<row r="{at}">' + "".join(_cell(f"{letters(k)}{at}", v, style) for k, v in enumerate(row)) + "</row>")
    last = letters(max(len(s.header) - 1, 0))
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{head}" topLeftCell="A{head + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{cols}</cols><sheetData>{"".join(out)}</sheetData><autoFilter ref="A{head}:{last}{max(at, head)}"/>'
        + (f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells>' if merges else "")
        + "</worksheet>"
    )


def write_workbook(path: str, sheets: Sequence[Sheet]) -> None:
    """One workbook with these sheets."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + kinds + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(s.name[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles())
        for i, s in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", _sheet_xml(s))


def sheet_of(name: str, df: DataFrame, **kw) -> Sheet:
    """A report's sheet. Reports are for readers: one with more rows than a sheet holds is refused, its table form has no bound."""
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{name} has more than {MOST_ROWS} rows; write it as a table")
    return Sheet(name, kw.pop("labels", df.columns), rows, **kw)
