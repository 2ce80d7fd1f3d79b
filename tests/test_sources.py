"""Workbook files and streams of them."""

import zipfile

from pyspark.sql import functions as F

from tallygrid.model import Model
from tallygrid.operators import predicates
from tallygrid.sources import xlsx
from tallygrid.streaming import arrivals

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_book(path, sheet_xml, names=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets><definedNames>{names}</definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Name</t></si><si><r><t>Va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><fonts><font/><font><color rgb="FF0000FF"/></font></fonts><fills><fill/></fills><cellXfs><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="14" fontId="1" fillId="0"><protection locked="0"/></xf></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}>{sheet_xml}</worksheet>")


SHEET = """<cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>When</t></is></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><f t="shared" ref="B2:B3" si="0">C2*$D$1+"A1"</f><v>4</v></c><c r="C2" s="1"><v>45292</v></c></row>
<row r="3" hidden="1"><c r="A3" t="b"><v>1</v></c><c r="B3"><f t="shared" si="0"/><v>6</v></c><c r="C3" t="e"><v>#REF!</v></c><c r="D3"/></row></sheetData>
<sheetProtection sheet="1"/><mergeCells><mergeCell ref="A1:B1"/></mergeCells><dataValidations><dataValidation sqref="C2:C9"/></dataValidations>"""


def test_workbooks(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", SHEET, '<definedName name="rate">Data!$B$2</definedName>')
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    tables = xlsx.workbook_tables(spark, f"{tmp_path}/*.xlsx")
    cells = {(r["row"], r["col"]): r for r in tables["cells"].collect()}
    assert cells[1, 2]["txt"] == "Value" and cells[1, 2]["merged"] and not cells[1, 1]["merged"]
    assert cells[2, 2]["formula"] == 'C2*$D$1+"A1"' and cells[3, 2]["formula"] == 'C3*$D$1+"A1"' and cells[3, 2]["num"] == 6
    assert cells[2, 3]["dt"].year == 2024 and cells[2, 3]["has_dv"] and cells[2, 3]["locked"] is False and cells[2, 3]["font_argb"] == "FF0000FF"
    assert cells[3, 1]["bool"] is True and cells[3, 3]["err"] == "#REF!" and (3, 4) not in cells
    sheet = tables["sheets"].first()
    assert sheet["protected"] and sheet["hidden_rows"] == [3] and sheet["hidden_cols"] == [3] and sheet["merges"] == ["A1:B1"]
    assert [(r["name"], r["ranges"]) for r in tables["defined_names"].collect()] == [("rate", ["Data!$B$2"])]
    assert xlsx.header_row(tables["cells"]).first()["header_row"] == 1
    assert {r["row"]: r["record"] for r in xlsx.records(tables["cells"]).collect()}[2]["Name"] == "x"
    m = Model.of(spark, tables["cells"], tables["sheets"], tables["defined_names"])
    assert predicates.merged_and_hidden(m).count() == 2


def test_data_source_and_gate(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", SHEET)
    (tmp_path / "b.xlsx").write_bytes(bytes.fromhex(xlsx.OLE_HEAD))
    (tmp_path / "d.xlsx").write_bytes(b"text")
    spark.dataSource.register(xlsx.WorkbookSource)
    assert spark.read.format("workbook").load(f"{tmp_path}/a.xlsx").count() == 9
    assert spark.read.format("workbook").option("table", "sheets").load(f"{tmp_path}/a.xlsx").first()["sheet"] == "Data"
    states = {r["path"][-6:]: r["state"] for r in xlsx.gate(spark.read.format("binaryFile").load(f"{tmp_path}/*.xlsx")).collect()}
    assert states == {"a.xlsx": "ok", "b.xlsx": "encrypted", "d.xlsx": "not a workbook"}
    odd = spark.createDataFrame([("e.xlsx", 0, b""), ("f.xlsx", xlsx.MOST_BYTES + 1, b"PK")], "path string, length long, content binary")
    assert [r["state"] for r in xlsx.gate(odd).collect()] == ["empty", "too large"]


def test_stream_keeps_history(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def found(files):
        return files.select(F.concat(F.lit("A::"), F.element_at(F.split("path", "/"), -1)).alias("fingerprint"))

    for k in (1, 2):
        write_book(folder / f"{k}.xlsx", SHEET)
        arrivals.audit_stream(arriving_files := arrivals.arriving_files(spark, str(folder)), found, str(tmp_path / "history"), str(tmp_path / "checkpoint")).awaitTermination()
        assert arriving_files.isStreaming
    got = {r["fingerprint"]: r["status"] for r in arrivals.with_history(spark, str(tmp_path / "history")).collect()}
    assert got == {"A::1.xlsx": "closed", "A::2.xlsx": "open"}
