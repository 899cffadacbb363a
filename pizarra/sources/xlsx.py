"""S1 + B14: department workbooks (.xlsx) read as a Spark job.

``binaryFile`` lists and reads the workbooks; ``mapInPandas`` turns each one
into typed rows. A workbook is a zip of XML parts; the worksheet is streamed
with ``iterparse``, its rows dropped as they are read, and emitted in batches,
so memory per task is one batch plus the shared-strings table. A workbook is
the unit of work: many workbooks spread over many tasks.

Data sheets are those whose first row carries at least the establishment code
and the outcome, wherever they stand in the workbook (one published workbook
has extra empty sheets); all of them are read, as a sheet ends at 1,048,576
rows and a large department may go on in the next. A workbook without one is
an error. Cells that are not integral numbers of 32 bits in a code column
become null, which the decode then reports as ``Desconocido``.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .fixture import RAW_COLUMNS

# ---------------------------------------------------------------------------
# FIXED VALUES: column headers of the published department workbooks, in
# file order, mapped to the canonical snake_case names used here.
HEADERS = {
    "Año": "anio",
    "CodEstablecimiento": "cod_establecimiento",
    "Departamento_F": "departamento_f",
    "Depto_mupio": "depto_mupio",
    "Sector": "sector",
    "Área": "area",
    "Sexo": "sexo",
    "Grado": "grado",
    "Nivel": "nivel",
    "Pueblo_Per": "pueblo_per",
    "Plan_Est": "plan_est",
    "Jornada_Est": "jornada_est",
    "Resultado_F": "resultado_f",
    "Repitente": "repitente",
    "Graduando": "graduando",
}
# ---------------------------------------------------------------------------

NS = {
    "m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
_M = "{%s}" % NS["m"]
BATCH_ROWS = 50_000

OUTPUT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c == "cod_establecimiento" else T.IntegerType(), True) for c in RAW_COLUMNS]
    + [T.StructField("_path", T.StringType(), True), T.StructField("_sheet", T.StringType(), True)]
)


def canonical(header: str) -> str | None:
    h = (header or "").strip()
    if h in HEADERS:
        return HEADERS[h]
    return h if h in RAW_COLUMNS else None


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, el in ET.iterparse(f):
            if el.tag == _M + "si":
                out.append("".join(t.text or "" for t in el.iter(_M + "t")))
                el.clear()
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(sheet name, part path)`` in workbook order."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", NS)}
    out = []
    for s in wb.find("m:sheets", NS).findall("m:sheet", NS):
        t = target[s.get("{%s}id" % NS["r"])]
        path = t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
        out.append((s.get("name"), path))
    return out


def _rows(z: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[dict[int, object]]:
    with z.open(part) as f:
        holder = None
        for event, el in ET.iterparse(f, ("start", "end")):
            if event == "start":
                holder = el if el.tag == _M + "sheetData" else holder
                continue
            if el.tag != _M + "row":
                continue
            row: dict[int, object] = {}
            for i, c in enumerate(el.findall(_M + "c")):
                ref = c.get("r")
                idx = _col_index(ref) if ref else i
                kind = c.get("t")
                if kind == "inlineStr":
                    row[idx] = "".join(t.text or "" for t in c.iter(_M + "t"))
                    continue
                v = c.find(_M + "v")
                if v is None or v.text is None:
                    continue
                if kind == "s":
                    row[idx] = strings[int(v.text)]
                elif kind in ("str", "e"):
                    row[idx] = v.text
                elif kind == "b":
                    row[idx] = int(v.text)
                else:
                    num = float(v.text)
                    row[idx] = int(num) if num.is_integer() else num
            holder.remove(el)  # else emptied rows stay attached to the sheet
            yield row


def _as_code(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        try:
            v = int(v.strip())
        except ValueError:
            return None
    if isinstance(v, float) and not v.is_integer():
        return None
    return int(v) if -(2**31) <= v < 2**31 else None


def _as_text(v: object) -> object:
    if v is None:
        return None
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def parse_workbook(content: bytes, path: str, batch_rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Typed rows of all data sheets of one workbook, in batches."""
    z = zipfile.ZipFile(io.BytesIO(content))
    strings = _shared_strings(z)
    sheets = 0
    for name, part in _sheets(z):
        rows = _rows(z, part, strings)
        header = next(rows, None)
        if not header:
            continue  # empty sheet: look further
        columns = {idx: canonical(str(h)) for idx, h in header.items()}
        if not {"cod_establecimiento", "resultado_f"} <= set(columns.values()):
            continue  # notes or the like
        sheets += 1
        wanted = {c: idx for idx, c in columns.items() if c is not None}
        batch: dict[str, list] = {c: [] for c in RAW_COLUMNS}
        n = 0
        for row in rows:
            if not row:
                continue
            for c in RAW_COLUMNS:
                idx = wanted.get(c)
                v = row.get(idx) if idx is not None else None
                batch[c].append(_as_text(v) if c == "cod_establecimiento" else _as_code(v))
            n += 1
            if n == batch_rows:
                yield _frame(batch, path, name)
                batch, n = {c: [] for c in RAW_COLUMNS}, 0
        if n:
            yield _frame(batch, path, name)
    if not sheets:
        raise ValueError(f"{path}: no sheet has the columns cod_establecimiento and resultado_f")


def _frame(batch: dict[str, list], path: str, sheet: str) -> pd.DataFrame:
    df = pd.DataFrame({c: pd.array(batch[c], dtype="string" if c == "cod_establecimiento" else "Int32") for c in RAW_COLUMNS})
    df["_path"] = path
    df["_sheet"] = sheet
    return df


def _parse_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from parse_workbook(bytes(content), path)


def read_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw rows (15 columns + ``_path``, ``_sheet``) of every workbook."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_parse_partition, OUTPUT_SCHEMA)
