"""Arrays (NPZ) and workbooks (XLSX) read as tables of cells and made from tables.

One file is one task's work, as such files are small; many are read and made in parallel.
Files are made as a column of bytes; ``write_files`` puts them under a folder that all
executors see as a plain one.

Defined results: a file that is no archive, and a sheet without cells, give no rows; numbers
of any kind are double, truth values 0 and 1, other arrays and cells are text; null cells
are left out of a workbook and are NaN in an array; names of sheets are cut to the 31
characters the format allows and made different by a number.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARRAY_CELLS = "path string, name string, i bigint, j bigint, value double, text string"
_SHEET_CELLS = "path string, sheet string, row int, col int, value string"
# Fixed values of the Office Open XML format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


# -- arrays ------------------------------------------------------------------------


def array_cells(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """Every cell of the one- and two-dimensional arrays of an archive; more dimensions are folded into j."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return
    with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
        for name in arrays.files:
            a = np.atleast_1d(arrays[name])
            i = np.repeat(np.arange(len(a)), a[0].size if len(a) and a.ndim > 1 else 1)
            j = np.tile(np.arange(a[0].size), len(a)) if len(a) and a.ndim > 1 else np.full(len(i), None)
            number = a.dtype.kind in "biuf"
            flat = a.ravel()
            yield pd.DataFrame(
                {
                    "path": path, "name": name, "i": i, "j": pd.array(j, dtype="Int64"), "value": flat.astype(np.float64) if number else np.full(len(flat), np.nan),
                    "text": np.full(len(flat), None) if number else flat.astype(str),
                }
            )


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """path, name, i, j, value, text of every cell of the ``*.npz`` under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield from array_cells(p, c)

    return _binary(spark, path, "*.npz").mapInPandas(run, _ARRAY_CELLS)


def npz_files(cells: DataFrame, by: str) -> DataFrame:
    """``by``, content: an archive for each key, of the arrays ``name`` with the cells i, j (null: one-dimensional), value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for name, g in pdf.groupby("name"):
            shape = (int(g["i"].max()) + 1,) if g["j"].isna().all() else (int(g["i"].max()) + 1, int(g["j"].max()) + 1)
            a = np.full(shape, np.nan)
            a[tuple(g[c].astype(int).to_numpy() for c in "ij"[: len(shape)])] = g["value"].to_numpy()
            arrays[str(name)] = a
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [out.getvalue()]})

    return cells.select(by, "name", "i", "j", "value").groupBy(by).applyInPandas(run, f"`{by}` {dict(cells.dtypes)[by]}, content binary")


# -- workbooks ---------------------------------------------------------------------


def _letters(col: int) -> str:
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of every cell that is not empty, counted from 0."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return
    tag = f"{{{_MAIN}}}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{tag}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{tag}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{tag}sheet"):
            target = targets[sheet.get(f"{{{_REL}}}id")]
            at = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for cell in ElementTree.fromstring(z.read(at)).iter(f"{tag}c"):
                ref, kind, v = cell.get("r"), cell.get("t"), cell.find(f"{tag}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{tag}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else v.text
                yield sheet.get("name"), int(re.search(r"\d+", ref)[0]) - 1, _column(ref), text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value (text) of every cell of the ``*.xlsx`` under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame([(p, *cell) for cell in sheet_cells(c)], columns=["path", "sheet", "row", "col", "value"])

    return _binary(spark, path, "*.xlsx").mapInPandas(run, _SHEET_CELLS)


def _cell(row: int, col: int, v) -> str:
    ref = f"{_letters(col)}{row + 1}"
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, np.number)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook(sheets: Mapping[str, tuple[Sequence[str], Iterable[Sequence]]]) -> bytes:
    """A workbook of sheets: name -> (header, rows)."""
    names: list[str] = []
    for s in sheets:
        name, k = re.sub(r"[\[\]:*?/\\]", "_", str(s))[:31] or "sheet", 1
        while name.lower() in (n.lower() for n in names):
            k += 1
            name = f"{name[:27]}_{k}"
        names.append(name)
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPES}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>{parts}</Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r + 1}">{"".join(_cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows]))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def xlsx_files(rows: DataFrame, book: str, sheet: str, order: Sequence[str]) -> DataFrame:
    """``book``, content: a workbook for each key of ``book``, with a sheet for each of ``sheet``, rows in ``order``."""
    columns = [c for c in rows.columns if c not in (book, sheet)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([sheet, *order], kind="stable")
        sheets = {s: (columns, g[columns].astype(object).where(g[columns].notna(), None).to_numpy().tolist()) for s, g in pdf.groupby(sheet, sort=True, dropna=False)}
        return pd.DataFrame({book: [pdf[book].iloc[0]], "content": [workbook(sheets)]})

    return rows.groupBy(book).applyInPandas(run, f"`{book}` {dict(rows.dtypes)[book]}, content binary")


def write_files(files: DataFrame, folder: str, name: str, suffix: str) -> None:
    """Writes the bytes ``content`` of each row to ``folder/<name><suffix>``, a folder every executor sees; a file appears whole or not at all."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            to = os.path.join(folder, re.sub(r"[^\w.-]", "_", str(r[name])) + suffix)
            with open(f"{to}.{os.getpid()}.part", "wb") as f:
                f.write(r["content"])
            os.replace(f.name, to)

    files.select(F.col(name), "content").foreachPartition(run)
