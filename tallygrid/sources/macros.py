"""Macro projects of workbooks: modules with their source, and what a reviewer should know of them.

A project is a compound file (in an .xlsm part of the zip, in an .xls the file itself): sectors in chains, a directory of
storages and streams. The `dir` stream names the modules; it and their sources are run-length compressed. Files are read
by Spark (`binaryFile`) and taken apart in Arrow batches; comments and findings are columns over the sources.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.finding import finding
from tallygrid.sources.xlsx import MOST_BYTES, OLE_HEAD, ZIP_HEAD

MODULES = "workbook_id string, state string, module string, stream string, module_type string, lines int, source string"
#: Sector numbers of compound files, and records of the `dir` stream.
LAST_SECTOR, FREE = 0xFFFFFFFA, 0xFFFFFFFF
CODE_PAGE, VERSION, NAME, STREAM, OFFSET, PROCEDURAL, CLASS, MODULE_END = 0x03, 0x09, 0x19, 0x1A, 0x31, 0x21, 0x22, 0x2B
MINI_LIMIT, ENTRY = 4096, 128

#: Check -> what it is about; calculation patterns with the names they are reported by.
CALCULATION = (
    (r"Application\.Calculation\s*=", "Application.Calculation (mode change)"),
    (r"Application\.Iteration\s*=\s*True", "Application.Iteration = True"),
    (r"Application\.(MaxIterations|MaxChange)\s*=", "Application.MaxIterations / MaxChange"),
    (r"Application\.CalculateFull(Rebuild)?\b", "Application.CalculateFull(Rebuild)"),
    (r"\.Calculate\b", "Explicit .Calculate call"),
    (r"\b\w[\w.]*\.Value2?\s*=\s*\w[\w.]*\.Value2?\b", "Copy-as-values pattern"),
)
#: Procedures that run without being called, and words for what reaches outside the workbook.
AUTOMATIC = ("Auto_Open", "Auto_Close", "AutoOpen", "AutoExec", "AutoClose", "Workbook_Open", "Workbook_Activate", "Workbook_BeforeClose", "Workbook_BeforeSave", "Workbook_SheetChange", "Worksheet_Change", "Worksheet_Calculate", "Worksheet_Activate")
REACHING = ("Shell", "CreateObject", "GetObject", "WScript.Shell", "ShellExecute", "Environ", "Kill", "FileCopy", "CreateTextFile", "ADODB.Stream", "SaveToFile", "URLDownloadToFile", "MSXML2.XMLHTTP", "SendKeys", "PowerShell", "CallByName", "VirtualAlloc", "RegWrite", "SaveSetting")
#: Addresses, hosts by number, and programs by name.
OUTSIDE = r"(?i)\b(?:https?|ftp)://[^\s\"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[\w-]+\.(?:exe|dll|bat|cmd|ps1|vbs|scr|msi)\b"
BOILERPLATE = r"(?im)^Attribute\s+VB_(Name|Base|GlobalNameSpace|Creatable|PredeclaredId|Exposed|TemplateDerived|Customizable)\s*=.*$"


class Malformed(ValueError):
    """A file that breaks the rules of its format."""


class CompoundFile:
    """Streams of a compound file by their path."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8].hex().upper() != OLE_HEAD:
            raise Malformed("no compound file")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini > 12:
            raise Malformed("sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini
        n_fat, directory = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        first_mini, _, first_more, n_more = struct.unpack_from("<4I", data, 60)
        fats = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_more, len(data) // self.size)):
            if first_more >= LAST_SECTOR:
                break
            *part, first_more = struct.unpack(f"<{self.size // 4}I", self.sector(first_more))
            fats += part
        self.fat: list[int] = []
        for at in [x for x in fats if x < LAST_SECTOR][: n_fat or None]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(at))
        table = self.chain(first_mini) if first_mini < LAST_SECTOR else b""
        self.mini_fat = struct.unpack(f"<{len(table) // 4}I", table)
        self.entries = [self.entry(x) for x in self.cut(self.chain(directory))]
        if not self.entries:
            raise Malformed("no directory")
        _, _, _, _, _, start, length = self.entries[0]
        self.mini = self.chain(start)[:length] if start < LAST_SECTOR else b""
        self.paths: dict[str, int] = {}
        self.walk(self.entries[0][4], "", set())

    def sector(self, k: int) -> bytes:
        out = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if len(out) < self.size:
            out = out.ljust(self.size, b"\0") if out else b""
        if not out:
            raise Malformed("a sector beyond the end")
        return out

    @staticmethod
    def cut(data: bytes) -> Iterator[bytes]:
        return (data[k : k + ENTRY] for k in range(0, len(data) - ENTRY + 1, ENTRY))

    @staticmethod
    def entry(x: bytes) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, bytes)"""
        n, kind = struct.unpack_from("<HB", x, 64)
        left, right, child = struct.unpack_from("<3I", x, 68)
        return (x[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, *struct.unpack_from("<II", x, 116))

    def chain(self, at: int) -> bytes:
        out, seen = [], 0
        while at < LAST_SECTOR:
            if at >= len(self.fat) or seen > len(self.fat):
                raise Malformed("a chain of sectors that doesn't end")
            out.append(self.sector(at))
            at, seen = self.fat[at], seen + 1
        return b"".join(out)

    def walk(self, at: int, above: str, seen: set[int]) -> None:
        """Entries below a storage: a tree of siblings each."""
        todo = [(at, above)]
        while todo:
            at, above = todo.pop()
            if at == FREE:
                continue
            if at in seen or at >= len(self.entries):
                raise Malformed("a directory that doesn't end")
            seen.add(at)
            name, kind, left, right, child, _, _ = self.entries[at]
            todo += [(left, above), (right, above)]
            if kind == 1:
                todo.append((child, f"{above}{name}/"))
            elif kind == 2:
                self.paths[above + name] = at

    def read(self, path: str) -> bytes:
        _, _, _, _, _, at, length = self.entries[self.paths[path]]
        if length >= MINI_LIMIT:
            return self.chain(at)[:length]
        out, seen = [], 0
        while at < LAST_SECTOR and length:
            if at >= len(self.mini_fat) or seen > len(self.mini_fat):
                raise Malformed("a chain of small sectors that doesn't end")
            out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
            at, seen = self.mini_fat[at], seen + 1
        return b"".join(out)[:length]


def expanded(data: bytes) -> bytes:
    """A run-length compressed container as it was."""
    if not data or data[0] != 1:
        raise Malformed("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack_from("<H", data, at)[0]
        end, at, start = min(len(data), at + (head & 0xFFF) + 3), at + 2, len(out)
        if not head & 0x8000:
            out += data[at : at + 4096]
            at = end
            continue
        while at < end:
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end or len(out) == start:
                    raise Malformed("a copy of nothing")
                token, at = struct.unpack_from("<H", data, at)[0], at + 2
                bits = max(4, (len(out) - start - 1).bit_length())
                back, n = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if back > len(out) - start:
                    raise Malformed("a copy from before the chunk")
                for _ in range(n):
                    out.append(out[-back])
        at = end
    return bytes(out)


def named_modules(records: bytes) -> tuple[str, list[dict]]:
    """(code page, modules) of the `dir` stream."""
    at, page, out, now = 0, "cp1252", [], {}
    while at + 6 <= len(records):
        kind, n = struct.unpack_from("<HI", records, at)
        n = 6 if kind == VERSION else n
        value, at = records[at + 6 : at + 6 + n], at + 6 + n
        if kind == CODE_PAGE and len(value) == 2:
            number = struct.unpack("<H", value)[0]
            page = {10000: "mac_roman", 65001: "utf-8"}.get(number, f"cp{number}")
        elif kind == NAME:
            now = {"name": value}
        elif kind == STREAM:
            now["stream"] = value
        elif kind == OFFSET and len(value) == 4:
            now["offset"] = struct.unpack("<I", value)[0]
        elif kind in (PROCEDURAL, CLASS):
            now["type"] = "bas" if kind == PROCEDURAL else "cls"
        elif kind == MODULE_END and "stream" in now and "offset" in now:
            out.append(now)
            now = {}
    return page, out


def project_rows(content: bytes, workbook_id: str) -> Iterator[tuple]:
    """MODULES rows of one file; one row without a module if it has none. State: ok, no project, encrypted, malformed, or
    partial for a module that can't be read (others can)."""
    nothing = lambda state: (workbook_id, state, None, None, None, None, None)
    try:
        if content[:4].hex().upper() == ZIP_HEAD:
            book = zipfile.ZipFile(io.BytesIO(content))
            part = next((n for n in book.namelist() if n.lower().endswith("vbaproject.bin")), None)
            if part is None:
                yield nothing("no project")
                return
            content = book.read(part)
        file = CompoundFile(content)
        if "EncryptedPackage" in file.paths:
            yield nothing("encrypted")
            return
        listing = next((p for p in file.paths if p.upper().endswith("VBA/DIR")), None)
        if listing is None:
            yield nothing("no project")
            return
        page, modules = named_modules(expanded(file.read(listing)))
        project = next((p for p in file.paths if p.upper() == listing.upper().removesuffix("VBA/DIR") + "PROJECT"), None)
        forms = [x[10:].strip() for x in file.read(project).splitlines() if x.startswith(b"BaseClass=")] if project else []
    except (Malformed, zipfile.BadZipFile, struct.error, KeyError, EOFError, RuntimeError, NotImplementedError):
        yield nothing("malformed")
        return
    if not modules:
        yield nothing("no project")
    for m in modules:
        text = lambda x: x.decode(page, "replace")  # noqa: E731, B023
        try:
            stream = listing[:-3] + text(m["stream"])
            at = {p.lower(): p for p in file.paths}[stream.lower()]
            source = text(expanded(file.read(at)[m["offset"] :])).replace("\r\n", "\n")
            kind = "frm" if m["name"] in forms else m.get("type", "unknown")
            yield (workbook_id, "ok", text(m["name"]), stream, kind, source.count("\n") + 1, source)
        except (Malformed, struct.error, KeyError, LookupError):
            yield (workbook_id, "partial", m["name"].decode("latin-1"), None, m.get("type", "unknown"), None, None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in MODULES.split(", ")]
    kinds = [pa.int32() if n == "lines" else pa.string() for n in names]
    for batch in batches:
        for k in range(batch.num_rows):
            rows = list(project_rows(batch.column(1)[k].as_py() or b"", batch.column(0)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def modules(spark: SparkSession, path: str) -> DataFrame:
    """MODULES rows of the workbooks at a path that Spark can read: each module, or a row that says why there is none (see
    project_rows; `too large` beyond 20 MB)."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    large = files.where(F.col("length") > MOST_BYTES).select(name.alias("workbook_id"), F.lit("too large").alias("state"))
    return files.where(F.col("length") <= MOST_BYTES).select(name, "content").mapInArrow(_rows, MODULES).unionByName(large, allowMissingColumns=True)


def without_comments(source: Column) -> Column:
    """Source without comments: from an apostrophe outside a string to the end of its line."""
    return F.regexp_replace(source, r"""(?m)^((?:[^"'\n]++|"[^"\n]*+(?:"|$))*+)'[^\n]*""", "$1")


def _words(source: Column, words: tuple[str, ...]) -> Column:
    return F.filter(F.array(*(F.when(source.rlike(rf"(?i)(?<![\w.]){w.replace('.', '[.]')}(?!\w)"), F.lit(w)) for w in words)), lambda w: w.isNotNull())


def signals(rows: DataFrame) -> DataFrame:
    """workbook_id, module, check_id and keyword: what stands in each module outside its boilerplate, once for each keyword."""
    code = rows.where("source IS NOT NULL").withColumn("code", F.regexp_replace("source", BOILERPLATE, ""))
    live = without_comments(F.col("code"))
    calc = F.filter(F.array(*(F.when(F.col("live").rlike(f"(?i){p}"), F.lit(name)) for p, name in CALCULATION)), lambda w: w.isNotNull())
    kinds = [("T0-VBA-002", _words(F.col("code"), AUTOMATIC)), ("T0-VBA-003", _words(F.col("code"), REACHING)), ("T0-VBA-004", F.array_distinct(F.regexp_extract_all("code", F.lit(OUTSIDE), F.lit(0)))), ("T0-VBA-005", calc)]
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("check_id"), k.alias("keywords")) for c, k in kinds))).alias("f")
    return code.withColumn("live", live).select("workbook_id", "module", found).select("workbook_id", "module", "f.check_id", F.explode("f.keywords").alias("keyword"))


def macro_findings(rows: DataFrame) -> DataFrame:
    """Findings on MODULES rows, one for each workbook and kind: that there is a project (001), procedures that run by
    themselves (002), words that reach outside (003), addresses and programs (004), control of calculation (005)."""
    named = rows.where("module IS NOT NULL")
    projects = named.groupBy("workbook_id").agg(F.concat_ws(": ", F.count("*").cast("string"), F.array_join(F.array_sort(F.collect_list("module")), ", ")).alias("detail")).withColumn("check_id", F.lit("T0-VBA-001"))
    each = signals(rows).groupBy("workbook_id", "check_id", "module").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ", ").alias("keywords"))
    said = each.groupBy("workbook_id", "check_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("module", F.lit(" ("), "keywords", F.lit(")")))), "; ").alias("detail"))
    both = projects.unionByName(said).withColumns({"sheet": F.lit("N/A"), "row": F.lit(1), "col": F.lit(1), "addr": F.lit("A1")})
    out = None
    for k in range(1, 6):
        check = f"T0-VBA-00{k}"
        part = finding(both.where(F.col("check_id") == check), check, F.col("detail"))
        out = part if out is None else out.union(part)
    return out
