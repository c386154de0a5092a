"""Workbooks (xlsx, xlsm) as long cells; files are read in parallel, a sheet's cells as they come."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import TabDeltaError
from ..functions.values import BOOLEAN, DATE, EMPTY, ERROR, NUMBER, STRING

#: Guards against archives that grow when opened.
MOST_PARTS, MOST_BYTES = 10_000, 1_500_000_000
#: Number formats of dates and times that have no text.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SCHEMA = "workbook string, sheet string, r int, c int, kind byte, num double, text string, formula string, date1904 boolean"
#: Cells passed on at a time.
_BATCH = 20_000


def is_date_format(code: str) -> bool:
    bare = re.sub(r"\\.|\"[^\"]*\"|\[[^\]]*\]", "", code)
    return bool(re.search("[ymdhs]", bare, re.IGNORECASE))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(data: bytes, name: str) -> Iterator[ElementTree.Element]:
    for _, e in ElementTree.iterparse(io.BytesIO(data), events=("end",)):
        if _local(e.tag) == name:
            yield e
            e.clear()


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")


def open_archive(content: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise TabDeltaError("CORRUPT_FILE", "The file can't be opened.") from e
    parts = archive.infolist()
    if len(parts) > MOST_PARTS or sum(p.file_size for p in parts) > MOST_BYTES:
        raise TabDeltaError("FILE_TOO_LARGE", "The file is too large when opened.")
    return archive


def _address(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", ref).groups()
    c = 0
    for x in letters:
        c = c * 26 + ord(x) - 64
    return int(digits) - 1, c - 1


def _shift(formula: str, dr: int, dc: int) -> str:
    """A shared formula at another cell: references without $ move along."""

    def moved(m: re.Match) -> str:
        if m[0].startswith('"'):
            return m[0]
        col_mark, col, row_mark, row = m.groups()
        r, c = _address(f"{col}{row}")
        r, c = r if row_mark else r + dr, c if col_mark else c + dc
        letters = ""
        while c >= 0:
            letters, c = chr(65 + c % 26) + letters, c // 26 - 1
        return f"{col_mark}{letters}{row_mark}{r + 1}"

    return re.sub(r'"[^"]*"|(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)([1-9][0-9]*)(?![A-Za-z0-9_(])', moved, formula)


def cells_of(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of one workbook; cells with neither value nor formula are left out."""
    archive = open_archive(content)
    parts = set(archive.namelist())
    read = lambda p: archive.read(p) if p in parts else b"<x/>"
    book = ElementTree.fromstring(read("xl/workbook.xml"))
    date1904 = any(e.get("date1904") in ("1", "true") for e in book.iter() if _local(e.tag) == "workbookPr")
    targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(read("xl/_rels/workbook.xml.rels"))}
    strings = [_text(e) for e in _children(read("xl/sharedStrings.xml"), "si")]
    styles = ElementTree.fromstring(read("xl/styles.xml"))
    custom = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
    formats = [int(x.get("numFmtId", 0)) for e in styles.iter() if _local(e.tag) == "cellXfs" for x in e]
    dates = [f in DATE_FORMATS or (f in custom and is_date_format(custom[f])) for f in formats]
    for sheet in (e for e in book.iter() if _local(e.tag) == "sheet"):
        target = next((targets.get(v, "") for k, v in sheet.attrib.items() if _local(k) == "id"), "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: dict[str, tuple[str, int, int]] = {}
        for e in _children(read(path), "c"):
            r, c = _address(e.get("r"))
            found = {_local(x.tag): x for x in e}
            f, v, kind = found.get("f"), found.get("v"), e.get("t", "n")
            formula = f.text if f is not None else None
            if f is not None and f.get("t") == "shared":
                if formula:
                    shared[f.get("si")] = (formula, r, c)
                elif f.get("si") in shared:
                    base, r0, c0 = shared[f.get("si")]
                    formula = _shift(base, r - r0, c - c0)
            raw = v.text if v is not None else None
            code, num, text = EMPTY, None, None
            if kind == "inlineStr":
                text = _text(e)
                code = STRING if text else EMPTY
            elif raw is not None:
                if kind == "s":
                    text = strings[int(raw)]
                elif kind in ("str", "e"):
                    text = raw
                elif kind == "b":
                    num = float(raw in ("1", "true"))
                else:
                    num = float(raw)
                styled = int(e.get("s", 0))
                code = {"b": BOOLEAN, "e": ERROR}.get(kind) or (STRING if text else EMPTY if num is None else DATE if styled < len(dates) and dates[styled] else NUMBER)
            if code != EMPTY or formula:
                yield name, sheet.get("name"), r, c, code, num, text or None, formula or None, date1904


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the workbooks at ``path``: ``workbook, sheet, r, c, kind, num, text, formula, date1904``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                held = []
                for row in cells_of(name.rpartition("/")[2], bytes(content)):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
