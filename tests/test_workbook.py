import zipfile
from datetime import date

import pytest
from pyspark.sql import types as T

from dalyworks.sources import readers, schemas, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, texts=(), properties=""):
    """A workbook as spreadsheet programs write them, by hand."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k + 5}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}">{properties}<sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        if texts:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{t}</si>' for t in texts)}</sst>")


HISTORY = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="AA1"><v>2018</v></c><c r="AB1"><v>2019</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c><c r="AA2" t="str"><v>L</v></c><c r="AB2" t="s"><v>3</v></c></row>'
    '<row r="3"/>'
    '<row r="5"><c r="A5" t="s"><v>4</v></c><c r="AB5" t="e"><v>#N/A</v></c></row>'
    '<row r="6"><c r="A6" t="s"><v>5</v></c><c r="AB6" t="s"><v>6</v></c></row>'
)
TEXTS = ["<t>iso_code</t>", "<t>name</t>", "<t>AFG</t>", "<r><t>U</t></r><r><t>M</t></r><rPh><t>no</t></rPh>", "<t>ALB</t>", "<t>NA</t>", "<t>H</t>"]


def test_income_history_on_the_second_sheet(spark, tmp_path):
    book(tmp_path / "h.xlsx", {"notes": "<row><c><v>1</v></c></row>", "Country &amp; lists": HISTORY}, TEXTS)
    path = str(tmp_path / "h.xlsx")
    wide = readers.read_wide(spark, path, "xlsx", sheet=2)
    assert wide.columns == ["iso_code", "name", "2018", "2019"]
    got = readers.income_levels(wide).collect()
    assert sorted(map(tuple, got), key=str) == [("AFG", "UM"), ("ALB", None), (None, "H")]
    assert [r.sheet for r in workbook.sheet_names(spark, path).orderBy("position").collect()] == ["notes", "Country & lists"]
    assert readers.read_wide(spark, path, "xlsx", sheet="Country & lists").count() == 3


def test_declared_types_and_errors(spark, tmp_path):
    body = (
        '<row><c t="inlineStr"><is><t>location_id</t></is></c><c t="inlineStr"><is><t>iso_code</t></is></c><c t="inlineStr"><is><t>location_name</t></is></c><c t="inlineStr"><is><t>day</t></is></c></row>'
        '<row><c><v>7</v></c><c t="str"><v>ABC</v></c><c><v>12.5</v></c><c><v>43831</v></c></row>'
        '<row><c><v>8.0</v></c><c/><c t="b"><v>1</v></c><c><v>1</v></c></row>'
    )
    path = str(tmp_path / "c.xlsx")
    book(path, {"a": body})
    assert sorted(map(tuple, readers.read_crosswalk(spark, path, "xlsx").collect())) == [(7, "ABC", "12.5"), (8, None, "TRUE")]
    days = T.StructType([T.StructField("day", T.DateType())])
    assert sorted(r.day for r in workbook.read_sheet(spark, path, days).collect()) == [date(1900, 1, 1), date(2020, 1, 1)]
    book(str(tmp_path / "d.xlsx"), {"a": body}, properties='<workbookPr date1904="1"/>')
    assert max(r.day for r in workbook.read_sheet(spark, str(tmp_path / "d.xlsx"), days).collect()) == date(2024, 1, 2)
    wrong = T.StructType([T.StructField("location_name", T.IntegerType())])
    for schema, sheet, said in ((wrong, 1, "is no int"), (schemas.REGION, 1, "no column who_region"), (days, 2, "no sheet 2"), (days, "b", "no sheet 'b'")):
        with pytest.raises(Exception, match=said):
            workbook.read_sheet(spark, path, schema, sheet).collect()


def test_written_sheets_read_back(spark, tmp_path):
    schema = T.StructType([T.StructField("iso_code", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("b", T.BooleanType())])
    rows = [("A<&>\"'", 0.1 + 0.2, 2**52, True), (" é\n", -1e300, None, False), (None, None, 5, None)] + [(f"k{i}", float(i), i, None) for i in range(12_000)]
    regions = spark.createDataFrame([("ABC", "AFRICA", "AFRICA-1"), ("DEF", None, None)], schemas.REGION)
    path = str(tmp_path / "out.xlsx")
    workbook.write_workbook({"facts": spark.createDataFrame(rows, schema), "re&gions": regions}, path)
    back = workbook.read_sheet(spark, path, schema, "facts")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, readers.read_region(spark, path, "xlsx", sheet=2).collect()), key=str) == [("ABC", "AFRICA", "AFRICA-1"), ("DEF", None, None)]
    first = (tmp_path / "out.xlsx").read_bytes()
    workbook.write_workbook({"facts": spark.createDataFrame(rows[::-1], schema), "re&gions": regions}, path)
    assert (tmp_path / "out.xlsx").read_bytes() == first
    with pytest.raises(ValueError, match="more than 100 rows"):
        workbook.write_workbook({"facts": back}, path, most_rows=100)


def test_several_sheets_are_partitions_of_their_own(spark, tmp_path):
    one = spark.createDataFrame([("A", 1.0)], "iso_code string, x double")
    path = str(tmp_path / "many.xlsx")
    workbook.write_workbook({"a": one, "b": one.selectExpr("iso_code", "x + 1 AS x"), "c": one.limit(0)}, path)
    both = workbook.read_sheet(spark, path, one.schema, ["a", 2, "c"])
    assert both.rdd.getNumPartitions() == 3 and sorted(map(tuple, both.collect())) == [("A", 1.0), ("A", 2.0)]
