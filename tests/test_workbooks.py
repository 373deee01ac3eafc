"""Workbooks as other programs write them: shared and rich texts, ragged rows, both calendars, several sheets, broken files."""

import datetime
import io
import zipfile

import pytest
from probitas.sources import readers, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets, shared="", styles="", properties=""):
    """A workbook by hand, with a prefix for its names and absolute targets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<x:sheet name="{n}" sheetId="{i}" r:id="s{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<x:workbook xmlns:x="{MAIN}" xmlns:r="{LINK}">{properties}<x:sheets>{names}</x:sheets></x:workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{LINK}/worksheet" Target="/xl/worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        links += f'<Relationship Id="a" Type="{LINK}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="b" Type="{LINK}/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


SHARED = "<si><t>id</t></si><si><r><t>na</t></r><r><rPr/><t>me</t></r><rPh><t>reading</t></rPh></si><si><t xml:space='preserve'> a_x000A_b </t></si>"
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[Red]&quot;day&quot; yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;hours&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
FIRST = (
    '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="D3" t="inlineStr"><is><t>born</t></is></c><c r="E3" t="str"><v>name</v></c></row>'
    '<row r="4"><c r="B4"><v>1.0</v></c><c r="C4" t="s"><v>2</v></c><c r="D4" s="1"><v>36526</v></c><c r="AA4"><v>2.5E-1</v></c></row><row r="5"/>'
    '<row><c/><c><v>2</v></c><c t="e"><v>#N/A</v></c><c s="2"><v>36526.5</v></c><c t="b"><v>1</v></c></row>'
    '<row r="9"><c r="B9" s="3"><v>12345678901234</v></c><c r="D9" s="1"><v>1</v></c></row>'
)


def test_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([("One", FIRST), ("Two", '<row><c t="str"><v>id</v></c></row><row><c><v>7</v></c></row>')], SHARED, STYLES))
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    got = workbooks.read_workbook(spark, str(tmp_path))
    assert got.columns == ["id", "name", "born", "name_2"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [("1", " a\nb ", "2000-01-01", None), ("12345678901234", None, "1900-01-01", None), ("2", None, "2000-01-01 12:00:00", "true")]
    typed = workbooks.read_workbook(spark, str(tmp_path), "One", "ID int, id int, born date, column_27 double, absent string").collect()
    assert sorted((r[1], r[2], r[3], r[4]) for r in typed if r[1]) == [(1, datetime.date(2000, 1, 1), 0.25, None), (2, datetime.date(2000, 1, 1), None, None)]
    assert [tuple(r) for r in workbooks.read_workbook(spark, str(tmp_path), 1).collect()] == [("7",)]
    assert sorted(r["id"] for r in workbooks.read_workbook(spark, str(tmp_path), None, "id long").collect()) == [1, 2, 7, 12345678901234]


def test_calendar_of_1904(spark, tmp_path):
    rows = '<row><c t="str"><v>at</v></c></row><row><c s="1"><v>0</v></c></row><row><c s="1"><v>35064.25</v></c></row>'
    (tmp_path / "a.xlsx").write_bytes(workbook([("One", rows)], "", STYLES, '<x:workbookPr date1904="1"/>'))
    assert [r["at"] for r in workbooks.read_workbook(spark, str(tmp_path)).collect()] == ["1904-01-01", "2000-01-01 06:00:00"]


@pytest.mark.parametrize(("code", "want"), [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ("[h]:mm", True), ('0 "days"', False), ("[Red]0", False), ("\\d0", False), ("h:mm AM/PM", True)])
def test_date_formats(code, want):
    assert workbooks.is_date_format(code) == want


def test_broken_files(spark, tmp_path):
    whole = workbook([("One", FIRST)], SHARED, STYLES)
    bad = {"none": b"", "text": b"not a zip", "half": whole[: len(whole) // 2], "index": workbook([("One", FIRST)], "", STYLES)}
    for name, content in bad.items():
        (tmp_path / f"{name}.xlsx").write_bytes(content)
    errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in workbooks.read_rows(spark, str(tmp_path)).collect()}
    assert sorted(errors) == ["half.xlsx", "index.xlsx", "text.xlsx"] and all(errors.values())
    table = workbooks.read_workbook(spark, str(tmp_path))
    assert table.columns == [] and readers.ixi_demographics(table).count() == 0
    with pytest.raises(Exception, match="xlsx"):
        workbooks.read_workbook(spark, str(tmp_path), schema="id int", mode="FAILFAST").collect()


def test_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "SHARED_TEXTS", 3)
    target = io.BytesIO()
    book = workbooks.Book(target, ["t", "n", "d"])
    odd = ["", " x ", "_x0041_", "a\x00\r\n\tb", "<&>\"'", "𝄞é"]
    for t in odd:
        book.add([t, -1.5, datetime.date(1900, 1, 1)])
    book.add([None, float("nan"), None])
    book.close()
    got = list(workbooks.sheets(target.getvalue()))
    assert [cells[0]["value"] for _, _, cells in got] == odd
    assert {cells[1]["value"] for _, _, cells in got} == {"-1.5"} and {float(cells[2]["value"]) for _, _, cells in got} == {1.0}
    with pytest.raises(ValueError, match="characters"):
        workbooks.Book(io.BytesIO(), ["x" * 40000]).close()
    assert [workbooks.letters(i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbooks._column(workbooks.letters(i) + "1") == i for i in range(1, 20000, 7))
    workbooks.register(spark)
    path = str(tmp_path / "books")
    for mode in ("append", "append", "overwrite"):
        spark.range(10).write.format("workbook").mode(mode).save(path)
    assert sorted(r["id"] for r in workbooks.read_workbook(spark, path, schema="id long").collect()) == list(range(10))


def test_files_hold_so_many_rows(spark, tmp_path, monkeypatch):
    """One task's rows become files of a bounded size, so that what a reader holds does not grow with the table."""
    workbooks.register(spark)
    one = spark.range(250001).coalesce(1)
    one.write.format("workbook").mode("append").save(str(tmp_path / "a"))
    one.filter("id < 25").write.format("workbook").option("rowsPerFile", 10).mode("append").save(str(tmp_path / "b"))
    for name, want in (("a", [50001, 100000, 100000]), ("b", [5, 10, 10])):
        got = workbooks.read_rows(spark, str(tmp_path / name)).groupBy("path").count().collect()
        assert sorted(r["count"] for r in got) == want
        assert workbooks.read_workbook(spark, str(tmp_path / name), schema="id long").distinct().count() == sum(want)
    with pytest.raises(Exception, match="rowsPerFile"):
        one.write.format("workbook").option("rowsPerFile", 0).mode("append").save(str(tmp_path / "c"))
