"""Workbooks read in pieces, and what is left of broken ones."""

import zipfile

import pytest

from tallygrid.sources import parts, xlsx
from tests.test_sources import MAIN, RELS, SHEET, write_book


def rows_of(df):
    return sorted(map(repr, df.collect()))


def large_book(path, n=400, sheets=2):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tabs = "".join(f'<sheet name="Tab {k}" sheetId="{k}" r:id="r{k}"/>' for k in range(1, sheets + 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="/xl/worksheets/sheet{k}.xml"/>' for k in range(1, sheets + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>text {k}</t></si>" for k in range(50)) + "</sst>")
        for k in range(1, sheets + 1):
            first = f'<row r="1"><c r="A1" t="s"><v>3</v></c><c r="B1"><f t="shared" ref="B1:B{n}" si="0">IF(A1&gt;{k},"A1",A1)</f><v>1</v></c></row>'
            rest = "".join(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r % 50 == 0 else ""}><c r="A{r}" t="s"><v>{r % 50}</v></c><c r="B{r}"><f t="shared" si="0"/><v>{r}.5</v></c></row>' for r in range(2, n + 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {MAIN}><sheetData>{first}{rest}</sheetData><mergeCells><mergeCell ref="A{n - 3}:B{n - 2}"/></mergeCells><dataValidations><dataValidation sqref="A5:A9 B{n}"/></dataValidations></worksheet>')


@pytest.mark.parametrize("piece_bytes", [1, 500, 1 << 20])
def test_pieces_give_what_whole_files_give(spark, tmp_path, piece_bytes):
    write_book(tmp_path / "a.xlsx", SHEET, '<definedName name="rate">Data!$B$2</definedName>')
    large_book(tmp_path / "b.xlsx")
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    got, want = parts.split_tables(spark, f"{tmp_path}/*.xlsx", piece_bytes=piece_bytes), xlsx.workbook_tables(spark, f"{tmp_path}/*.xlsx")
    for name in ("cells", "sheets", "defined_names"):
        assert rows_of(got[name]) == rows_of(want[name]), name
    assert {r["sheet"]: r["state"] for r in got["sheet_names"].collect()} == {"Data": "ok", "Tab 1": "ok", "Tab 2": "ok"}
    assert [(r["path"][-6:], r["state"]) for r in got["skipped"].collect()] == [("c.xlsx", "not a workbook")]


def test_sheets_are_cut_between_rows(tmp_path):
    large_book(tmp_path / "b.xlsx", 3000, 1)
    found = {p[0]: p for p in parts.listed_parts((tmp_path / "b.xlsx").read_bytes())}
    _, state, method, body = found["xl/worksheets/sheet1.xml"]
    sheet = parts.SheetXml(body, method, 20_000)
    pieces = list(sheet.pieces())
    # A step of unpacking may bring more than a piece; cells keep their order and none is lost.
    cells = [c[:2] for xml, shared, ranges in pieces for c in parts.raw_cells(xml, shared, ranges)]
    assert state == "ok" and len(pieces) >= 2 and cells == [(r, c) for r in range(1, 3001) for c in (1, 2)]
    assert sheet.hidden_rows == list(range(50, 3001, 50)) and not pieces[0][1] and all(shared for _, shared, _ in pieces[1:])


def test_comments_end_the_cutting():
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{"<![CDATA[<row r=1>]]>" if k == 2 else "x"}</t></is></c></row>' for k in range(1, 9))
    sheet = parts.SheetXml(f"<worksheet><sheetData>{rows}</sheetData></worksheet>".encode(), parts.STORED, 10)
    cells = [c for xml, shared, ranges in sheet.pieces() for c in parts.raw_cells(xml, shared, ranges)]
    assert [c[0] for c in cells] == list(range(1, 9)) and cells[1][3] == "<row r=1>"


def test_broken_files_give_what_is_left(spark, tmp_path):
    large_book(tmp_path / "whole.xlsx", 4000)
    whole = (tmp_path / "whole.xlsx").read_bytes()
    with zipfile.ZipFile(tmp_path / "whole.xlsx") as z:
        second = z.getinfo("xl/worksheets/sheet2.xml")
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "nodirectory.xlsx").write_bytes(whole[: second.header_offset + 60 + second.compress_size])
    (folder / "cut.xlsx").write_bytes(whole[: second.header_offset + 60 + second.compress_size // 2])
    (folder / "noworkbook.xlsx").write_bytes(b"junk" + whole[whole.index(b"PK\x03\x04", whole.index(b"sharedStrings") - 40) :][: second.header_offset - 800])
    (folder / "nothing.xlsx").write_bytes(b"PK\x03\x04 but no more")
    got = parts.split_tables(spark, f"{folder}/*.xlsx", permissive=True)
    states = {(r["workbook_id"], r["sheet"]): r["state"] for r in got["sheet_names"].collect()}
    assert states["nodirectory.xlsx", "Tab 1"] == states["nodirectory.xlsx", "Tab 2"] == states["cut.xlsx", "Tab 1"] == "recovered"
    assert states["cut.xlsx", "Tab 2"] == "truncated" and ("noworkbook.xlsx", "sheet1") in states
    cells = {(r["workbook_id"], r["sheet"]): r["n"] for r in got["cells"].groupBy("workbook_id", "sheet").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert cells["nodirectory.xlsx", "Tab 2"] == cells["cut.xlsx", "Tab 1"] == 8000 and 0 < cells["cut.xlsx", "Tab 2"] < 8000
    assert [r["path"].rsplit("/", 1)[-1] for r in got["skipped"].collect()] == ["nothing.xlsx"]
    assert not parts.split_tables(spark, f"{folder}/noworkbook.xlsx")["cells"].count()  # the gate refuses it


def test_lengths_behind_parts_are_found(tmp_path):
    with open(tmp_path / "s.xlsx", "wb") as f:

        class Pipe:
            """A file that can't be wound back: its zip file states lengths behind the parts."""

            write, flush = f.write, f.flush

        with zipfile.ZipFile(Pipe(), "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", "<worksheet/>" * 50)
            z.writestr("xl/styles.xml", "<styleSheet/>")
    found = {p[0]: p for p in parts.found_parts((tmp_path / "s.xlsx").read_bytes())}
    assert {n: (p[1], b"".join(parts.inflated(p[3], p[2]))) for n, p in found.items()} == {"xl/worksheets/sheet1.xml": ("recovered", b"<worksheet/>" * 50), "xl/styles.xml": ("recovered", b"<styleSheet/>")}
