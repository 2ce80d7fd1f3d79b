"""Workbooks as a Spark data source.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("table", "cells").load("folder/with/*.xlsx")

Tables: cells, sheets, defined_names. Files are read by Spark (`binaryFile`) when given to workbook_tables(), so any
store that Spark reads will do; the data source form reads files that the executors can open, one partition for each.
Shared formulas are written out for each cell; cached values stand beside formulas.
"""

from __future__ import annotations

import glob
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallygrid.functions.tokens import number_of
from tallygrid.model import CELL, NAME, SHEET

DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
#: Limits and file heads of the gate before reading.
MOST_BYTES = 20 * 1024 * 1024
ZIP_HEAD, OLE_HEAD = "504B0304", "D0CF11E0A1B11AE1"
TABLES = {"cells": CELL, "sheets": SHEET, "defined_names": NAME}
ADDRESS = re.compile(r"^([A-Z]+)(\d+)$")
MOVABLE = re.compile(r"(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])")


def letters_of(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shifted(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it stands rows and cols further on; string literals stay."""

    def move(m: re.Match) -> str:
        col = m[2] if m[1] else letters_of(max(1, number_of(m[2]) + cols))
        return m[1] + col + m[3] + (m[4] if m[3] else str(max(1, int(m[4]) + rows)))

    parts = formula.split('"')
    return '"'.join(p if k % 2 else MOVABLE.sub(move, p) for k, p in enumerate(parts))


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out: list[str] = []
    for _, e in iterparse(book.open("xl/sharedStrings.xml")):
        if _tag(e) == "si":
            out.append("".join(t.text or "" for t in e.iter() if _tag(t) == "t"))
            e.clear()
    return out


def _styles(book: zipfile.ZipFile) -> list[dict]:
    """For each style: number format, font and fill colours, locked, hidden, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    formats, fonts, fills, out = {}, [], [], []
    path: list[str] = []
    for event, e in iterparse(book.open("xl/styles.xml"), ("start", "end")):
        if event == "start":
            path.append(_tag(e))
            continue
        path.pop()
        tag, parent = _tag(e), path[-1] if path else ""
        if tag == "numFmt":
            formats[int(e.get("numFmtId"))] = e.get("formatCode")
        elif tag == "font" and parent == "fonts":
            fonts.append(next((c.get("rgb") for c in e if _tag(c) == "color"), None))
        elif tag == "fill" and parent == "fills":
            fills.append(next((c.get("rgb") for c in e.iter() if _tag(c) == "fgColor"), None))
        elif tag == "xf" and parent == "cellXfs":
            lock = next((c for c in e if _tag(c) == "protection"), None)
            n = int(e.get("numFmtId", 0))
            code = formats.get(n)
            pick = lambda items, key: items[int(e.get(key, 0))] if int(e.get(key, 0)) < len(items) else None  # noqa: E731, B023
            out.append({
                "num_fmt": code, "font_argb": pick(fonts, "fontId"), "fill_argb": pick(fills, "fillId"),
                "locked": None if lock is None or lock.get("locked") is None else lock.get("locked") not in ("0", "false"),
                "formula_hidden": None if lock is None else lock.get("hidden") in ("1", "true"),
                "date": n in DATE_FORMATS or bool(code and re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I) and "0" not in code),
            })
    return out


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in tab order."""
    to = {}
    for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")):
        if _tag(e) == "Relationship":
            target = e.get("Target")
            to[e.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    out = []
    for _, e in iterparse(book.open("xl/workbook.xml")):
        if _tag(e) == "sheet":
            key = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            if to.get(key) in book.namelist():
                out.append((e.get("name"), to[key]))
    return out


def read_names(book: zipfile.ZipFile, workbook_id: str) -> Iterator[tuple]:
    for _, e in iterparse(book.open("xl/workbook.xml")):
        if _tag(e) == "definedName":
            yield (workbook_id, e.get("name"), [r.strip() for r in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)", e.text or "") if r.strip()])


def _covers(ranges: str, row: int, col: int) -> bool:
    for part in ranges.split():
        a, _, b = part.replace("$", "").partition(":")
        m, n = ADDRESS.match(a), ADDRESS.match(b or a)
        if m and n and int(m[2]) <= row <= int(n[2]) and number_of(m[1]) <= col <= number_of(n[1]):
            return True
    return False


def raw_cell(c, shared: dict) -> tuple | None:
    """row, col, formula, its kind and the stored value of a cell's element; shared holds formula, row and column of the
    shared formulas so far."""
    m = ADDRESS.match(c.get("r", ""))
    if not m:
        return None
    row, col = int(m[2]), number_of(m[1])
    formula = kind_of = None
    value = next((x.text for x in c if _tag(x) == "v"), None)
    for x in c:
        if _tag(x) == "f":
            kind_of, formula = x.get("t", "normal"), x.text
            if kind_of == "shared":
                if formula:
                    shared[x.get("si")] = (formula, row, col)
                elif x.get("si") in shared:
                    base, r0, c0 = shared[x.get("si")]
                    formula = shifted(base, row - r0, col - c0)
        elif _tag(x) == "is":
            value = "".join(t.text or "" for t in x.iter() if _tag(t) == "t")
    return row, col, formula, kind_of, value


def read_sheet(book: zipfile.ZipFile, workbook_id: str, idx: int, name: str, file: str, texts: list[str], styles: list[dict]) -> tuple[tuple, list[tuple]]:
    """(row of sheets, rows of cells) of one sheet."""
    cells, shared, merges, validations = [], {}, [], []
    hidden_rows, hidden_cols, protected = [], [], False
    for event, e in iterparse(book.open(file), ("start", "end")):
        tag = _tag(e)
        if event == "start":
            continue
        if tag == "col" and e.get("hidden") in ("1", "true"):
            hidden_cols += range(int(e.get("min")), int(e.get("max")) + 1)
        elif tag == "sheetProtection":
            protected = e.get("sheet") in ("1", "true")
        elif tag == "mergeCell":
            merges.append(e.get("ref"))
        elif tag == "dataValidation":
            validations.append(e.get("sqref", ""))
        elif tag == "row":
            if e.get("hidden") in ("1", "true"):
                hidden_rows.append(int(e.get("r")))
            for c in e:
                raw = raw_cell(c, shared)
                if raw is None:
                    continue
                row, col, formula, kind_of, value = raw
                style = styles[int(c.get("s", 0))] if int(c.get("s", 0)) < len(styles) else {}
                kind, num, txt, flag, when, err = "blank", None, None, None, None, None
                t = c.get("t", "n")
                if value is not None:
                    if t == "s":
                        kind, txt = "text", texts[int(value)]
                    elif t in ("str", "inlineStr"):
                        kind, txt = "text", value
                    elif t == "b":
                        kind, flag = "bool", value == "1"
                    elif t == "e":
                        kind, err = "error", value
                    elif style.get("date"):
                        kind = "date"
                        try:
                            when = datetime(1899, 12, 30) + timedelta(days=float(value))
                        except OverflowError:
                            when = None
                    else:
                        kind, num = "number", float(value)
                if kind == "blank" and formula is None:
                    continue
                cells.append((workbook_id, idx, name, row, col, kind, num, txt, flag, when, err, formula, kind_of if formula else None, style.get("num_fmt"), style.get("font_argb"), style.get("fill_argb"), style.get("locked"), style.get("formula_hidden")))
            e.clear()
    inner = [(r.replace("$", ""), r.split(":")[0]) for r in merges]
    rows = [(*c, any(_covers(v, c[3], c[4]) for v in validations), any(_covers(r, c[3], c[4]) and first != f"{letters_of(c[4])}{c[3]}" for r, first in inner)) for c in cells]
    return (workbook_id, idx, name, protected, merges, hidden_rows, hidden_cols), rows


def read_table(content: bytes, workbook_id: str, table: str) -> Iterator[tuple]:
    """Rows of one table of a workbook; a file that is no workbook gives none."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        sheets = _sheets(book) if table != "defined_names" else []
        if table == "defined_names":
            yield from read_names(book, workbook_id)
            return
        texts, styles = _texts(book), _styles(book)
    except (zipfile.BadZipFile, KeyError):
        return
    for idx, (name, file) in enumerate(sheets):
        head, cells = read_sheet(book, workbook_id, idx, name, file, texts, styles)
        if table == "sheets":
            yield head
        else:
            yield from cells


class WorkbookSource(DataSource):
    """Workbooks under a path of this machine (or one that is mounted on all), as tables. For stores that only Spark reads,
    and for many tables at once, see workbook_tables()."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        return TABLES[self.options.get("table", "cells")]

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"]))
        self.table = options.get("table", "cells")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from read_table(f.read(), partition.value.rsplit("/", 1)[-1], self.table)


def workbook_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells, sheets and defined_names of the workbooks at a path that Spark can read, and `skipped`: path, length and state
    of the files that the gate doesn't pass. A workbook is one row of bytes (up to 20 MB pass), so a task holds one at a
    time."""
    found = spark.read.format("binaryFile").load(path)
    files = found.where(F.col("length") <= MOST_BYTES).select(F.element_at(F.split("path", "/"), -1).alias("id"), "content")

    def rows(table: str):
        def run(batches):
            import pandas as pd

            names = [f.name for f in TABLES[table]]
            for batch in batches:
                for file, content in zip(batch["id"], batch["content"], strict=True):
                    got = list(read_table(bytes(content), file, table))
                    if got:
                        yield pd.DataFrame(got, columns=names).astype(object)

        return run

    return {t: files.mapInPandas(rows(t), s) for t, s in TABLES.items()} | {"skipped": gate(found).where("state <> 'ok'")}


def gate(files: DataFrame, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """What `binaryFile` rows are: ok, empty, too large (no file is without a limit), encrypted (an OLE file by the name of a zip one) or not a
    workbook. (Spark's binary source itself leaves out files of no bytes.)"""
    head = F.hex(F.substring("content", 1, 8))
    modern = F.lower("path").rlike(r"\.(xlsx|xlsm)$")
    state = (
        F.when(F.col("length") == 0, "empty").when(F.lit(False) if most_bytes is None else F.col("length") > most_bytes, "too large").when(modern & F.startswith(head, F.lit(OLE_HEAD)), "encrypted")
        .when(F.startswith(head, F.lit(ZIP_HEAD)) | F.startswith(head, F.lit(OLE_HEAD)), "ok").otherwise("not a workbook")
    )
    return files.select("path", "length", state.alias("state"))


def header_row(cells: DataFrame) -> DataFrame:
    """The header of each sheet: of its first 10 rows, that of the most texts (counted twice) less numbers; the first of
    equal ones. Members of merged ranges don't count."""
    rows = cells.where("row <= 10 AND coalesce(merged, false) = false").groupBy("workbook_id", "sheet", "row").agg((2 * F.count_if(F.col("kind").isin("text", "date")) - F.count_if(F.col("kind") == "number")).alias("score"))
    return rows.groupBy("workbook_id", "sheet").agg(F.min_by("row", F.struct(-F.col("score"), "row")).alias("header_row"))


def records(cells: DataFrame) -> DataFrame:
    """Rows other than the header as maps from header to plain value (as text). Blank headers are col{n}; headers are cut
    at 40 characters and repeated ones get _{n}."""
    value = F.coalesce("err", "txt", F.col("num").cast("string"), F.col("bool").cast("string"), F.date_format("dt", "MMM yyyy"))
    rows = cells.join(header_row(cells), ["workbook_id", "sheet"]).withColumn("value", value)
    heads = rows.where("row = header_row").select("workbook_id", "sheet", "col", F.left(F.btrim("value"), F.lit(40)).alias("head"))
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("workbook_id", "sheet", "head").orderBy("col"))
    heads = heads.where("head <> ''").withColumn("head", F.when(k > 1, F.concat_ws("_", "head", F.col("col").cast("string"))).otherwise(F.col("head")))
    body = rows.where("row <> header_row AND value IS NOT NULL").join(heads, ["workbook_id", "sheet", "col"], "left")
    name = F.coalesce("head", F.concat(F.lit("col"), F.col("col").cast("string")))
    return body.groupBy("workbook_id", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct(name, "value"))).alias("record"))
