"""Large workbooks in several tasks: a zip file is split into its parts, a sheet into pieces of rows.

1. Each file's directory gives its parts, which travel on their own, still compressed. Where the directory is broken (a
   truncated or damaged file) the parts are found by the heads that stand before each of them.
2. Sheets are unpacked in a stream and cut between rows into pieces of about PIECE_BYTES of XML. A piece carries the
   shared formulas that it refers to and the merged and validated ranges that touch its rows, so it is read by itself.
3. Cells refer to shared texts and styles by number; these are tables of their own, joined by equality.

So a task holds one file's compressed bytes at most, or one piece. What Spark reads (`binaryFile`) is all that is opened.

Comments and CDATA in a sheet end the cutting: the rest of that sheet is one piece.
"""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree.ElementTree import ParseError, iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.tokens import number_of
from tallygrid.model import CELL, NAME, SHEET, conform
from tallygrid.operators.graph import cut
from tallygrid.sources import xlsx

#: Unpacked bytes of a sheet in a piece; bytes unpacked at once.
PIECE_BYTES, STEP = 4 << 20, 1 << 18
#: The head before each part of a zip file, its length, the length of a directory's entry.
PART_HEAD, HEAD_BYTES = b"PK\x03\x04", 30
STORED, DEFLATED = 0, 8
WORKBOOK, LINKS, TEXTS, STYLES = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/styles.xml"
SHEET_PART = "^xl/(?:work|chart|dialog|macro)sheets/[^/]+[.]xml$"
ROW = re.compile(rb"<((?:\w+:)?)row(?=[\s/>])[^>]*>")
ROOT = re.compile(rb"<((?:\w+:)?worksheet)\b[^>]*>")
DATA = re.compile(rb"<(?:\w+:)?sheetData\s*(/?)>")
DATA_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")
FIRST_SHARED = re.compile(rb'<(?:\w+:)?c\s[^>]*?\br="([A-Z]+)(\d+)"[^>]*>\s*<(?:\w+:)?f\s([^>]*)>([^<]+)</')
SHARED = re.compile(rb'\bsi="(\d+)"')
NUMBER, HIDDEN = re.compile(rb'\sr="(\d+)"'), re.compile(rb'\shidden="(?:1|true)"')
UNCUT = re.compile(rb"<!--|<!\[CDATA\[")
LAST_DATE = 2_958_465  # the last day that the format knows
RAW = "workbook_id string, part string, row int, col int, type string, value string, style int, formula string, formula_kind string, has_dv boolean, merged boolean"


def inflated(body: bytes, method: int) -> Iterator[bytes]:
    """The bytes of a part, in steps; of a broken one those before the break."""
    if method == STORED:
        yield from (body[k : k + STEP] for k in range(0, len(body), STEP))
        return
    unpack, rest = zlib.decompressobj(-15), body
    while rest and not unpack.eof:
        try:
            out = unpack.decompress(rest, STEP)
        except zlib.error:
            return
        rest = unpack.unconsumed_tail
        if out:
            yield out
        elif not rest:
            return


def found_parts(content: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """name, state (recovered, or truncated if the file ends within it), method and compressed bytes of the parts whose
    heads stand in a file, whatever its directory says; of equal names the last."""
    at = content.find(PART_HEAD)
    while 0 <= at <= len(content) - HEAD_BYTES:
        flags, method, _, _, _, packed, _, n_name, n_extra = struct.unpack("<HHHHIIIHH", content[at + 6 : at + HEAD_BYTES])
        name = content[at + HEAD_BYTES : at + HEAD_BYTES + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        start = at + HEAD_BYTES + n_name + n_extra
        if method not in (STORED, DEFLATED) or start > len(content):
            at = content.find(PART_HEAD, at + 4)
            continue
        if flags & 8 or packed == 0xFFFFFFFF:  # the length stands behind the part
            end, whole = content.find(PART_HEAD, start), True
            end = len(content) if end < 0 else end
            if method == DEFLATED:
                unpack = zlib.decompressobj(-15)
                try:
                    rest = content[start:]
                    while rest and not unpack.eof:
                        unpack.decompress(rest, STEP)
                        rest = unpack.unconsumed_tail
                except zlib.error:
                    pass
                whole = unpack.eof
                end = len(content) - len(unpack.unused_data) if unpack.eof else end
        else:
            end = start + packed
            whole = end <= len(content)
        yield name, "recovered" if whole else "truncated", method, content[start : min(end, len(content))]
        at = content.find(PART_HEAD, min(end, len(content)))


def listed_parts(content: bytes) -> list[tuple[str, str, int, bytes]]:
    """name, state, method and compressed bytes of the parts that a file's directory lists, or else of those found in it."""
    try:
        out = []
        for info in zipfile.ZipFile(io.BytesIO(content)).infolist():
            head = content[info.header_offset : info.header_offset + HEAD_BYTES]
            start = info.header_offset + HEAD_BYTES + sum(struct.unpack("<HH", head[26:30]))
            if head[:4] != PART_HEAD or start + info.compress_size > len(content) or info.compress_type not in (STORED, DEFLATED):
                raise zipfile.BadZipFile
            out.append((info.filename, "ok", info.compress_type, content[start : start + info.compress_size]))
        return out
    except (zipfile.BadZipFile, struct.error, NotImplementedError, ValueError):
        return list({x[0]: x for x in found_parts(content)}.values())


class Parts:
    """The small parts of a workbook, opened as those of a zip file are."""

    def __init__(self, rows: pd.DataFrame):
        self.parts = {r.part: b"".join(inflated(bytes(r.body), r.method)) for r in rows.itertuples()}

    def namelist(self) -> list[str]:
        return list(self.parts)

    def open(self, name: str) -> io.BytesIO:
        return io.BytesIO(self.parts[name])


def parts_of(files: DataFrame) -> DataFrame:
    """workbook_id, part, state, method and body (compressed) of what is read of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for part in listed_parts(bytes(content)):
                    if part[0] in (WORKBOOK, LINKS, TEXTS, STYLES) or re.match(SHEET_PART, part[0]):
                        yield pd.DataFrame([(path.rsplit("/", 1)[-1], *part)], columns=["workbook_id", "part", "state", "method", "body"])

    return cut(files.select("path", "content").mapInPandas(run, "workbook_id string, part string, state string, method int, body binary"))


def sheet_names(parts: DataFrame) -> DataFrame:
    """workbook_id, part, sheet_idx, sheet and state of the sheets whose part is there, in tab order. Sheets that no
    readable directory of the workbook names follow by the names of their parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        book = Parts(rows[rows["part"].isin([WORKBOOK, LINKS])])
        have = dict(zip(rows["part"], rows["state"], strict=True))
        to, named = {}, []
        try:
            for _, e in iterparse(book.open(LINKS)):
                if xlsx._tag(e) == "Relationship":
                    target = e.get("Target", "")
                    to[e.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
        except (KeyError, ParseError):
            pass
        try:
            for _, e in iterparse(book.open(WORKBOOK)):
                if xlsx._tag(e) == "sheet":
                    named.append((to.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None)), e.get("name")))
        except (KeyError, ParseError):
            pass
        listed = [(p, n) for p, n in named if p in have]
        others = sorted((p for p in have if re.match(SHEET_PART, p) and p not in dict(listed)), key=lambda p: (len(p), p))
        if have.get(WORKBOOK) == have.get(LINKS) == "ok":
            others = []  # nothing is lost, so no tab shows them
        listed += [(p, p.rsplit("/", 1)[-1].rsplit(".", 1)[0]) for p in others]
        return pd.DataFrame([(rows["workbook_id"].iloc[0], p, k, n, have[p]) for k, (p, n) in enumerate(listed)], columns=["workbook_id", "part", "sheet_idx", "sheet", "state"])

    small = parts.withColumn("body", F.when(F.col("part").isin(WORKBOOK, LINKS), F.col("body")))
    return small.groupBy("workbook_id").applyInPandas(run, "workbook_id string, part string, sheet_idx int, sheet string, state string")


def box(ref: str) -> tuple[int, int, int, int] | None:
    """Rows and columns of a range."""
    a, _, b = ref.replace("$", "").partition(":")
    m, n = xlsx.ADDRESS.match(a), xlsx.ADDRESS.match(b or a)
    return (int(m[2]), int(n[2]), number_of(m[1]), number_of(n[1])) if m and n else None


class SheetXml:
    """A sheet's XML in a stream: what stands around its rows, and pieces of whole rows."""

    def __init__(self, body: bytes, method: int, piece_bytes: int = PIECE_BYTES):
        self.body, self.method, self.piece_bytes = body, method, piece_bytes
        self.protected, self.merges, self.validations, self.hidden_rows, self.hidden_cols = False, [], [], [], []
        for piece in self._rows():
            for m in ROW.finditer(piece):
                n = NUMBER.search(m[0])
                if n and HIDDEN.search(m[0]):
                    self.hidden_rows.append(int(n[1]))
        self._frame(self.before)
        self._frame(self.open + self.after)

    def _frame(self, xml: bytes) -> None:
        try:
            for _, e in iterparse(io.BytesIO(xml)):
                tag = xlsx._tag(e)
                if tag == "col" and e.get("hidden") in ("1", "true"):
                    self.hidden_cols += range(int(e.get("min")), int(e.get("max")) + 1)
                elif tag == "sheetProtection":
                    self.protected = e.get("sheet") in ("1", "true")
                elif tag == "mergeCell":
                    self.merges.append(e.get("ref"))
                elif tag == "dataValidation":
                    self.validations.append(e.get("sqref", ""))
        except ParseError:  # both frames are open at one end
            pass

    def _rows(self) -> Iterator[bytes]:
        """Whole rows, in pieces; sets open (the root's tag), before and after."""
        self.open = self.before = self.after = b""
        held, inside, uncut = b"", False, False
        stream = inflated(self.body, self.method)
        for got in stream:
            held += got
            if not inside:
                m = DATA.search(held)
                if not m:
                    continue
                root = ROOT.search(held)
                self.open, self.before = root[0] if root else b"<worksheet>", held[: m.start()]
                held, inside = held[m.end() :], True
                if m[1]:
                    self.after = held + b"".join(stream)
                    return
            if len(held) < self.piece_bytes and not DATA_END.search(held, max(0, len(held) - len(got) - 20)):
                continue
            end = DATA_END.search(held)
            uncut = uncut or bool(UNCUT.search(held))
            if end:
                yield held[: end.start()]
                self.after = held[end.end() :] + b"".join(stream)
                return
            if not uncut:
                at = max(held.rfind(b"<row"), max((m.start() for m in re.finditer(rb"<\w+:row\b", held)), default=-1))
                if at > 0:
                    yield held[:at]
                    held = held[at:]
        if inside and held:  # a truncated sheet
            yield held

    def pieces(self) -> Iterator[tuple[bytes, list, list]]:
        """XML of some rows (whole but for its last tags), formulas that are shared with earlier rows, and ranges that
        touch the rows: (validated, rows, columns, first cell)."""
        ranges = [(True, *b) for v in self.validations for b in map(box, v.split()) if b] + [(False, *b) for b in map(box, self.merges) if b]
        shared: dict = {}
        for xml in self._rows():
            rows = [int(n[1]) for m in ROW.finditer(xml) if (n := NUMBER.search(m[0]))]
            needs = {m[1] for m in SHARED.finditer(xml)} & set(shared)
            yield self.open + xml, [(k.decode(), *shared[k]) for k in sorted(needs)], [r for r in ranges if rows and r[1] <= rows[-1] and r[2] >= rows[0]]
            for m in FIRST_SHARED.finditer(xml):
                k = SHARED.search(m[3])
                if k and b'"shared"' in m[3]:
                    shared[k[1]] = (html.unescape(m[4].decode()), int(m[2]), number_of(m[1].decode()))


def cell_elements(xml: bytes) -> Iterator:
    """The cells of rows; what follows a break is left out."""
    try:
        for _, e in iterparse(io.BytesIO(xml)):
            if xlsx._tag(e) == "row":
                yield from e
                e.clear()
    except ParseError:
        return


def raw_cells(xml: bytes, shared: list, ranges: list) -> Iterator[tuple]:
    """row, col, type, value, style, formula, its kind, has_dv and merged of the cells of a piece."""
    formulas = {k: (f, r, c) for k, f, r, c in shared}
    for c in cell_elements(xml):
        raw = xlsx.raw_cell(c, formulas)
        if raw is None or raw[2] is None and raw[4] is None:
            continue
        row, col, formula, kind, value = raw
        here = [(dv, a, d) for dv, a, b, d, e in ranges if a <= row <= b and d <= col <= e]
        yield row, col, c.get("t", "n"), value, int(c.get("s", 0)), formula, kind if formula else None, any(x[0] for x in here), any(not x[0] and x[1:] != (row, col) for x in here)


def sheet_tables(parts: DataFrame, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(what stands around the rows, cells by numbers of texts and styles) of sheet parts."""
    bodies = parts.where(F.col("part").rlike(SHEET_PART)).select("workbook_id", "part", "method", "body")
    spread = bodies.repartition("workbook_id", "part")

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                s = SheetXml(bytes(r.body), r.method)
                yield pd.DataFrame([(r.workbook_id, r.part, s.protected, s.merges, s.hidden_rows, s.hidden_cols)], columns=["workbook_id", "part", "protected", "merges", "hidden_rows", "hidden_cols"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for k, (xml, shared, ranges) in enumerate(SheetXml(bytes(r.body), r.method, piece_bytes).pieces()):
                    yield pd.DataFrame([(r.workbook_id, r.part, k, zlib.compress(xml, 1), shared, ranges)], columns=["workbook_id", "part", "piece", "xml", "shared", "ranges"])

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RAW.split(", ")]
        for batch in batches:
            for r in batch.itertuples():
                found = raw_cells(zlib.decompress(bytes(r.xml)), [tuple(x.values()) for x in r.shared], [tuple(x.values()) for x in r.ranges])
                rows = [(r.workbook_id, r.part, *x) for x in found]
                for lo in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[lo : lo + 20_000], columns=names).astype(object)

    kinds = "workbook_id string, part string, piece int, xml binary, shared array<struct<si string, formula string, row int, col int>>, ranges array<struct<dv boolean, r1 int, r2 int, c1 int, c2 int>>"
    framed = spread.mapInPandas(frames, "workbook_id string, part string, protected boolean, merges array<string>, hidden_rows array<int>, hidden_cols array<int>")
    return framed, spread.mapInPandas(pieces, kinds).repartition("workbook_id", "part", "piece").mapInPandas(cells, RAW)


def side_table(parts: DataFrame, part: str, rows, kinds: str) -> DataFrame:
    """workbook_id and the rows of one small part of each workbook."""
    names = ["workbook_id", *(x.split()[0] for x in kinds.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                try:
                    found = [(r.workbook_id, *x) for x in rows(Parts(pd.DataFrame([r])), r.workbook_id)]
                except (KeyError, ParseError):
                    continue
                for lo in range(0, len(found), 20_000):
                    yield pd.DataFrame(found[lo : lo + 20_000], columns=names).astype(object)

    return parts.where(F.col("part") == part).select("workbook_id", "part", "method", "body").mapInPandas(run, f"workbook_id string, {kinds}")


def shared_texts(book: Parts, _) -> Iterator[tuple]:
    try:
        k = 0
        for _, e in iterparse(book.open(TEXTS)):
            if xlsx._tag(e) == "si":
                yield str(k), "".join(t.text or "" for t in e.iter() if xlsx._tag(t) == "t")
                k += 1
                e.clear()
    except ParseError:  # what stands before a break counts
        return


def styles(book: Parts, _) -> Iterator[tuple]:
    for k, s in enumerate(xlsx._styles(book)):
        yield k, s["num_fmt"], s["font_argb"], s["fill_argb"], s["locked"], s["formula_hidden"], s["date"]


def split_tables(spark: SparkSession, path: str, most_bytes: int | None = None, permissive: bool = False, piece_bytes: int = PIECE_BYTES) -> dict[str, DataFrame]:
    """cells, sheets and defined_names of the workbooks at a path that Spark reads, as xlsx.workbook_tables() gives them,
    with `sheet_names` (workbook_id, part, sheet_idx, sheet, state) and `skipped` (path, length, state).

    Files of any size, or of up to most_bytes. If permissive, files that the gate refuses are searched for parts too:
    state says whether a sheet was ok, recovered (the directory is broken) or truncated (its rows before the break are
    there). Files without any part are skipped. A text or style whose number isn't known is null.
    """
    found = spark.read.format("binaryFile").load(path)
    gated = xlsx.gate(found, most_bytes)
    passed = found if permissive else found.join(gated.where("state = 'ok'").select("path"), "path", "left_semi")
    parts = parts_of(passed if most_bytes is None else passed.where(F.col("length") <= most_bytes))
    names = sheet_names(parts)
    framed, raw = sheet_tables(parts, piece_bytes)
    sheets = framed.join(names, ["workbook_id", "part"])
    texts = side_table(parts, TEXTS, shared_texts, "value string, shared string")
    styled = side_table(parts, STYLES, styles, "style int, num_fmt string, font_argb string, fill_argb string, locked boolean, formula_hidden boolean, date boolean")
    rows = raw.join(names, ["workbook_id", "part"]).join(styled, ["workbook_id", "style"], "left")
    rows = rows.join(texts.withColumn("type", F.lit("s")), ["workbook_id", "type", "value"], "left")
    t, value, number = F.col("type"), F.col("value"), F.expr("try_cast(value AS double)")
    kind = F.when(value.isNull(), "blank").when(t.isin("s", "str", "inlineStr"), "text").when(t == "b", "bool").when(t == "e", "error").when(F.coalesce("date", F.lit(False)), "date").otherwise("number")
    day = F.expr(f"CASE WHEN num BETWEEN 0 AND {LAST_DATE} THEN CAST(TIMESTAMP_NTZ'1899-12-30 00:00:00' + make_dt_interval(CAST(floor(num) AS INT), 0, 0, CAST(round((num - floor(num)) * 86400, 6) AS DECIMAL(18, 6))) AS TIMESTAMP) END")
    rows = rows.withColumn("kind", kind).withColumn("num", F.when(F.col("kind").isin("number", "date"), number))
    rows = rows.withColumns({
        "dt": F.when(F.col("kind") == "date", day), "num": F.when(F.col("kind") == "number", F.col("num")), "bool": F.when(F.col("kind") == "bool", value == "1"),
        "err": F.when(F.col("kind") == "error", value), "txt": F.when(F.col("kind") == "text", F.when(t == "s", F.col("shared")).otherwise(value)),
    })
    defined = side_table(parts, WORKBOOK, lambda book, name: (x[1:] for x in xlsx.read_names(book, name)), "name string, ranges array<string>")
    empty = found.join(names.select(F.col("workbook_id").alias("id")).distinct(), F.element_at(F.split("path", "/"), -1) == F.col("id"), "left_anti").select("path")
    skipped = gated.join(empty, "path", "left_semi")
    return {"cells": conform(rows, CELL), "sheets": conform(sheets, SHEET), "defined_names": conform(defined, NAME), "sheet_names": names, "skipped": skipped}
