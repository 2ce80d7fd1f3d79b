"""Small workbooks for tests."""

import re
from datetime import datetime

from tallygrid.functions.tokens import number_of
from tallygrid.model import Model


def model(spark, sheets, names=(), **more):
    """sheets: {sheet: {address: value}}; a value is a number, text, bool, date, `=formula`, or a tuple of formula and
    cached value. more: columns of sheets by name."""
    cells, tabs = [], []
    for idx, (sheet, content) in enumerate(sheets.items()):
        tabs.append({"workbook_id": "w", "sheet_idx": idx, "sheet": sheet, **{k: v.get(sheet) for k, v in more.items()}})
        for addr, value in content.items():
            extra = {}
            if isinstance(value, dict):
                extra = {k: v for k, v in value.items() if k != "value"}
                value = value.get("value")
            formula = None
            if isinstance(value, tuple):
                formula, value = value
            elif isinstance(value, str) and value.startswith("="):
                formula, value = value, None
            m = re.match(r"([A-Z]+)(\d+)$", addr)
            row = {"workbook_id": "w", "sheet_idx": idx, "sheet": sheet, "row": int(m[2]), "col": number_of(m[1]), "formula": formula.lstrip("=") if formula else None}
            if isinstance(value, bool):
                row |= {"kind": "bool", "bool": value}
            elif isinstance(value, (int, float)):
                row |= {"kind": "number", "num": float(value)}
            elif isinstance(value, datetime):
                row |= {"kind": "date", "dt": value}
            elif isinstance(value, str) and value.startswith("#"):
                row |= {"kind": "error", "err": value}
            elif isinstance(value, str):
                row |= {"kind": "text", "txt": value}
            else:
                row |= {"kind": "blank"}
            cells.append(row | extra)
    from tallygrid.model import CELL, NAME, SHEET

    frame = lambda rows, schema: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return Model.of(spark, frame(cells, CELL), frame(tabs, SHEET), frame([{"workbook_id": "w", "name": n, "ranges": r} for n, r in names], NAME))


def places(df):
    return sorted((r["sheet"], r["row"], r["col"]) for r in df.collect())
