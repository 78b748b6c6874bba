import zipfile

import pytest
from tilesmith.sources import files, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = """
<row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t> patient_fnr </t></is></c><c r="E1" t="s"><v>1</v></c><c r="AA1" t="s"><v>4</v></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>42</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" s="1"><v>43831</v></c><c r="AA2"><v>0.1</v></c></row>
<row r="3"/>
<row r="4"><c r="D4" t="s"><v>3</v></c><c r="E4" s="2"><v>43831.75</v></c><c r="AA4" t="b"><v>1</v></c></row>
<row><c/><c><v>1.0E3</v></c><c/><c t="str"><v>07</v></c><c s="3"><v>5</v></c></row>
<row r="9"><c r="B9" t="e"><v>#N/A</v></c><c r="D9"><f>1+1</f><v>2</v></c><c r="E9" s="1"><v>1</v></c></row>
"""


def book(path, sheet=SHEET, shared=True, target="worksheets/sheet7.xml", props=""):
    texts = ["<t>patient_id</t>", "<r><t>da</t></r><r><t>te</t></r><rPh><t>x</t></rPh>", "<t>01017012345</t>", '<t xml:space="preserve"> æ&amp;b </t>', "<t>more</t>"]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{RELS}">{props}<sheets><sheet name="a" sheetId="3" r:id="rId9"/><sheet name="b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/sheet7.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/worksheets/other.xml", "<worksheet/>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy&quot;s&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{t}</si>' for t in texts)}</sst>")


def test_cells_are_found_by_reference_and_kept_as_text(spark, tmp_path):
    book(tmp_path / "r.xlsx")
    want = [("42", "01017012345", "2020-01-01 00:00:00", "0.1"), (None, " æ&b ", "2020-01-01 18:00:00", "True"), ("1000", "07", "5", None), (None, "2", "1900-01-01 00:00:00", None)]
    df = workbooks.sheet(spark, str(tmp_path / "r.xlsx"), "patient_id string, patient_fnr string, date string, more string, none int")
    assert [tuple(r) for r in df.collect()] == [(*r, None) for r in want]
    assert [tuple(r) for r in files.register(spark, str(tmp_path / "r.xlsx")).collect()] == [r[:2] for r in want]
    typed = workbooks.sheet(spark, str(tmp_path / "r.xlsx"), "date date, patient_id long").collect()
    assert [(r.date and str(r.date), r.patient_id) for r in typed] == [("2020-01-01", 42), ("2020-01-01", None), (None, 1000), ("1900-01-01", None)]


def test_other_forms(spark, tmp_path, monkeypatch):
    plain = '<row r="1"><c r="A1" t="inlineStr"><is><t>n</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row>' + "".join(f'<row><c><v>{i}</v></c><c><v>9</v></c></row>' for i in range(25))
    monkeypatch.setattr(workbooks, "BATCH", 10)
    (tmp_path / "many").mkdir()
    for k in range(3):
        book(tmp_path / "many" / f"{k}.xlsx", plain, shared=False, target="/xl/worksheets/sheet7.xml")
    got = workbooks.sheet(spark, str(tmp_path / "many"), "n int")
    assert sorted(r.n for r in got.collect()) == sorted([*range(25)] * 3)
    book(tmp_path / "empty.xlsx", "", shared=False)
    assert files.register(spark, str(tmp_path / "empty.xlsx")).count() == 0
    book(tmp_path / "late.xlsx", '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>0</v></c></row>', props='<workbookPr date1904="1"/>')
    assert workbooks.sheet(spark, str(tmp_path / "late.xlsx"), "d string").first().d == "1904-01-01 00:00:00"
    (tmp_path / "no.xlsx").write_bytes(b"no workbook")
    with pytest.raises(Exception, match="zip"):
        files.register(spark, str(tmp_path / "no.xlsx")).count()
    with pytest.raises(ValueError, match="old workbook"):
        files.register(spark, "x.xls")


def test_references():
    assert [workbooks.column_of(x) for x in ("A1", "Z9", "AA1", "AB22", "XFD1")] == [0, 25, 26, 27, 16383]
    assert [workbooks.date_of(x) for x in (1, 59, 61, 36526.5)] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "2000-01-01 12:00:00"]
