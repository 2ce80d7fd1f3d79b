"""Calls, references and relative forms of formulas.

Balanced parentheses aren't regular, so this is the part that needs Python. It runs once over distinct formulas, in
Arrow batches, and gives tables that all other checks join with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*)\s*\(")
REF = re.compile(
    r"(?:(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_.]*(?::[A-Za-z_][A-Za-z0-9_.]*)?))!)?"
    r"(?:(\$?)([A-Z]{1,3})(\$?)(\d{1,7})(?::(\$?)([A-Z]{1,3})(\$?)(\d{1,7}))?|(\$?)([A-Z]{1,3}):(\$?)([A-Z]{1,3})|(\$?)(\d{1,7}):(\$?)(\d{1,7}))(?![A-Za-z0-9_(])"
)
CALLS = "formula string, pos int, fn string, depth int, open_at int, end_at int, args array<string>"
REFS = "formula string, pos int, kind string, tgt_sheet string, r1 int, c1 int, r2 int, c2 int, abs_r1 boolean, abs_c1 boolean, abs_r2 boolean, abs_c2 boolean, raw string"
LAST_ROW, LAST_COL = 1048576, 16384


def number_of(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def extent(formula: str, opened: int) -> int:
    """The place after the parenthesis that closes the one at `opened`; -1 if none does. Strings aren't looked at."""
    depth = 0
    for k in range(opened, len(formula)):
        depth += (formula[k] == "(") - (formula[k] == ")")
        if depth == 0:
            return k + 1
    return -1


def top_level_args(inner: str) -> list[str]:
    """Arguments split at commas outside parentheses, trimmed; an empty last one is left out."""
    out, depth, at = [], 0, 0
    for k, ch in enumerate(inner):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(inner[at:k].strip())
            at = k + 1
    last = inner[at:].strip()
    return [*out, last] if last else out


def calls_of(formula: str) -> list[tuple]:
    """Every call with balanced parentheses: (formula, pos, fn, depth, open_at, end_at, args)."""
    out = []
    for m in CALL.finditer(formula):
        end = extent(formula, m.end() - 1)
        if end > 0:
            before = formula[: m.start()]
            out.append((formula, m.start(), m[1].upper(), before.count("(") - before.count(")"), m.end() - 1, end, top_level_args(formula[m.end() : end - 1])))
    return out


def refs_of(formula: str) -> list[tuple]:
    """Every reference: a cell, a range, whole columns or whole rows, with corners in order. The sheet of one over several
    sheets is `first:last`."""
    out = []
    blank = re.sub(r'"[^"]*"', lambda m: " " * len(m[0]), formula)
    for m in REF.finditer(blank):
        if m.start() and (blank[m.start() - 1].isalnum() or blank[m.start() - 1] in "_.$!'"):
            continue
        sheet = m[1] or m[2]
        if m[4]:
            a, b = (int(m[6]), number_of(m[4])), (int(m[10]), number_of(m[8])) if m[8] else (int(m[6]), number_of(m[4]))
            kind, marks = ("range", (m[5], m[3], m[9], m[7])) if m[8] else ("cell", (m[5], m[3], m[5], m[3]))
        elif m[12]:
            kind, marks = "wholecol", ("", m[11], "", m[13])
            a, b = (1, number_of(m[12])), (LAST_ROW, number_of(m[14]))
        else:
            kind, marks = "wholerow", (m[15], "", m[17], "")
            a, b = (int(m[16]), 1), (int(m[18]), LAST_COL)
        out.append((formula, m.start(), kind, sheet.strip() if sheet else None, min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1]), *(x == "$" for x in marks), m[0]))
    return out


def relative_form(formula: str, row: int, col: int) -> str:
    """The formula with addresses relative to its cell: R[-1]C[0], and R5C3 for absolute ones."""

    def part(mark: str, letters: str, mark2: str, digits: str) -> str:
        c, r = number_of(letters), int(digits)
        return ("R" + (str(r) if mark2 else f"[{r - row}]")) + ("C" + (str(c) if mark else f"[{c - col}]"))

    def whole(m: re.Match) -> str:
        first = part(m["a"], m["b"], m["c"], m["d"])
        return (m["sheet"] or "") + first + (":" + part(m["e"], m["f"], m["g"], m["h"]) if m["f"] else "")

    return RELATIVE.sub(whole, formula)


RELATIVE = re.compile(
    r"(?P<sheet>(?:'[^']+'|[A-Za-z0-9_]+)!)?(?<![A-Za-z0-9_])(?P<a>\$?)(?P<b>[A-Z]{1,3})(?P<c>\$?)(?P<d>\d+)(?::(?P<e>\$?)(?P<f>[A-Z]{1,3})(?P<g>\$?)(?P<h>\d+))?(?![A-Za-z0-9_(])"
)


def _explode(df: DataFrame, column: str, one, schema: str) -> DataFrame:
    names = [x.strip().split()[0] for x in re.sub(r"array<string>", "array", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for f in batch[column] for r in one(f)], columns=names)

    return df.select(F.col(column).alias(column)).where(F.col(column).isNotNull()).distinct().mapInPandas(run, schema)


def calls(cells: DataFrame) -> DataFrame:
    """The calls of the distinct formulas of cells; an empty table gives none."""
    return _explode(cells, "formula", calls_of, CALLS)


def refs(cells: DataFrame) -> DataFrame:
    """The references of the distinct formulas of cells; those inside string literals don't count."""
    return _explode(cells, "formula", refs_of, REFS)


CORNER = "struct<before: string, row: int, fixed_row: boolean, col: int, fixed_col: boolean>"


def corners_of(formula: str) -> tuple[list[dict], str]:
    """A formula as its corners of references, each with the text before it, and the text after the last."""
    out, at = [], 0
    for m in RELATIVE.finditer(formula):
        for letters, digits, mark, mark2 in (("b", "d", "a", "c"), ("f", "h", "e", "g")):
            if m[letters]:
                before = formula[at : m.start("a")] if letters == "b" else ":"
                out.append({"before": before, "row": int(m[digits]), "fixed_row": bool(m[mark2]), "col": number_of(m[letters]), "fixed_col": bool(m[mark])})
        at = m.end()
    return out, formula[at:]


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    corner = pa.struct([("before", pa.string()), ("row", pa.int32()), ("fixed_row", pa.bool_()), ("col", pa.int32()), ("fixed_col", pa.bool_())])
    for batch in batches:
        found = [corners_of(f) for f in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.list_(corner)), pa.array([tail for _, tail in found], pa.string())], names=["formula", "_corners", "_tail"])


def with_relative_form(cells: DataFrame) -> DataFrame:
    """Adds template, the formula relative to the cell's row and col (see relative_form); null without a formula.

    Distinct formulas are taken apart once; a cell's form is then put together from the corners and its place.
    """
    parts = cells.select("formula").where("formula IS NOT NULL").distinct().mapInArrow(_corners, f"formula string, _corners array<{CORNER}>, _tail string")
    at = lambda mark, fixed, there, here: F.concat(F.lit(mark), F.when(fixed, there.cast("string")).otherwise(F.concat(F.lit("["), (there - here).cast("string"), F.lit("]"))))
    one = lambda c: F.concat(c["before"], at("R", c["fixed_row"], c["row"], F.col("row")), at("C", c["fixed_col"], c["col"], F.col("col")))
    template = F.concat(F.array_join(F.transform("_corners", one), ""), "_tail")
    return cells.join(parts, "formula", "left").select(*cells.columns, template.alias("template"))
