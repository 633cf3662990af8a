"""Workbooks as a data source."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tables, workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def foreign(path, shared=True):
    """A workbook as other programs write it: shared strings with runs, cell references, several sheets, the first one not sheet1."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="urn:r"><sheets><sheet name="b" sheetId="2" r:id="rId2"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="urn:rel"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si><si><t>n</t></si><si><t>a_x000A_b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS}"><sheetData><row><c><v>0</v></c></row></sheetData></worksheet>')
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.5</v></c></row><row r="3"/><row r="4"><c r="AB4"><v>9</v></c><c r="A4" t="s"><v>3</v></c></row>'
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{NS}"><sheetViews/><sheetData>{rows}</sheetData></worksheet>')


def test_other_programs_workbooks(spark, tmp_path):
    foreign(tmp_path / "f.xlsx")
    df = tables.read_xlsx(spark, str(tmp_path / "f.xlsx"), rows=1)
    assert df.columns == ["name", "unnamed_1", "n"] and df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("two runs", None, "1.5"), (None, None, None), ("a\nb", None, None)], key=repr)


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_written_and_read_by_ranges(spark, tmp_path, rows):
    odd = [None, "", "a<b>&\"c'", " two  blanks ", "é日本\n\tx", "_x0041_", "\x01\x0b", "x" * 9000, "1e5"]
    data = [(str(k), odd[k % len(odd)]) for k in range(60)]
    tables.write_workbooks(spark.createDataFrame(data, "k string, v string").repartition(3), f"{tmp_path}/w")
    back = tables.read_xlsx(spark, f"{tmp_path}/w", rows=rows)
    assert sorted(map(tuple, back.collect())) == sorted((k, v or None) for k, v in data) or sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame([(k, v or None) for k, v in data], "k string, v string").collect()))
    assert back.rdd.getNumPartitions() == (60 if rows == 1 else back.rdd.getNumPartitions())
    some = tables.read_xlsx(spark, f"{tmp_path}/w", ["v"], rows)
    assert some.columns == ["v"] and some.where("v = '1e5'").count() == sum(v == "1e5" for _, v in data)
    with pytest.raises(Exception, match="other columns"):
        tables.read_xlsx(spark, f"{tmp_path}/w", ["nope"]).count()


def test_no_rows_and_other_columns(spark, tmp_path):
    workbooks.write(str(tmp_path / "a.xlsx"), ["p"], [])
    assert tables.read_xlsx(spark, str(tmp_path / "a.xlsx")).count() == 0
    with pytest.raises(tables.UploadError):
        tables.parse_upload(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(Exception, match="nothere"):
        tables.read_xlsx(spark, f"{tmp_path}/nothere.xlsx")
    workbooks.write(str(tmp_path / "b.xlsx"), ["q"], [("1",)])
    with pytest.raises(Exception, match="other columns"):
        tables.read_xlsx(spark, str(tmp_path)).agg(F.count("*"), F.max("p")).collect()


def test_counting_rows_across_blocks(tmp_path):
    workbooks.write(str(tmp_path / "c.xlsx"), ["p", "q"], [("x" * (k % 700), str(k)) for k in range(5000)])
    with zipfile.ZipFile(tmp_path / "c.xlsx") as z:
        assert workbooks.row_count(z) == 5001
        assert [r[1] for r in workbooks.rows_of(z, 4990, 4995)] == ["4989", "4990", "4991", "4992", "4993"]
