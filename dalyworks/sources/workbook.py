"""Sheets of .xlsx workbooks: a scan of declared columns, and a sink for dimension tables.

Workbooks are read through Spark's binary files, so they may lie in any store that Spark
reads. Each file and sheet is parsed in its own task, cell by cell, and only the cells of the
asked columns are turned into values: what leaves the task is the pruned sheet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a batch that leaves the parser.
BATCH = 5_000
#: Rows of a sheet that is written; the format itself ends at 2**20.
MOST_ROWS = 100_000
MISSING = ("", "NA")


def _part(book: zipfile.ZipFile, name: str):
    """Root element of a part of the workbook."""
    with book.open(name) as part:
        return ElementTree.parse(part).getroot()


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part of the archive), in the order of the tabs."""
    targets = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    sheets = _part(book, "xl/workbook.xml").find(f"{MAIN}sheets")
    found = []
    for s in sheets if sheets is not None else []:
        target = targets[s.get(LINK)]
        found.append((s.get("name"), target[1:] if target.startswith("/") else f"xl/{target}"))
    return found


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The shared texts; rich runs are joined, phonetic guides left out."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_joined(item) for item in _part(book, "xl/sharedStrings.xml")]


def _joined(item) -> str:
    runs = [item, *item.findall(f"{MAIN}r")]
    return "".join(t.text or "" for r in runs for t in r.findall(f"{MAIN}t"))


def column_number(reference: str) -> int:
    """Column of a cell reference, from 0: A1 is 0, AA7 is 26."""
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = 26 * number + ord(letter) - 64
    return number - 1


def cells(book: zipfile.ZipFile, part: str, texts: list[str], wanted=None) -> Iterator[tuple[int, dict[int, object]]]:
    """(row number from 1, values by column from 0), row by row; ``wanted`` limits the columns.

    Texts are str, numbers float, truth values bool; errors and empty cells are absent.
    """
    row, at = 0, 0
    with book.open(part) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag != f"{MAIN}row":
                continue
            row, at, values = int(element.get("r") or row + 1), -1, {}
            for cell in element.findall(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else at + 1
                if wanted is not None and at not in wanted:
                    continue
                kind, raw = cell.get("t", "n"), cell.find(f"{MAIN}v")
                if kind == "inlineStr":
                    inline = cell.find(f"{MAIN}is")
                    values[at] = _joined(inline) if inline is not None else ""
                elif raw is not None and raw.text is not None and kind != "e":
                    values[at] = {"s": lambda x: texts[int(x)], "b": lambda x: x == "1", "n": float}.get(kind, str)(raw.text)
            element.clear()
            yield row, values


def _position(book: zipfile.ZipFile, sheet: int | str) -> tuple[str, str]:
    found = sheet_parts(book)
    for place, (name, part) in enumerate(found, 1):
        if sheet in (name, place):
            return name, part
    raise ValueError(f"no sheet {sheet!r}; there are {', '.join(n for n, _ in found)}")


def _header(book: zipfile.ZipFile, part: str, texts: list[str], header: int) -> dict[str, int]:
    """Column by name in row ``header``; a number is named as whole number where it is one."""
    for row, values in cells(book, part, texts):
        if row == header:
            names: dict[str, int] = {}
            for at in sorted(values):
                names.setdefault(_text(values[at]), at)
            return names
        if row > header:
            break
    return {}


def _text(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 else str(value)


def convert(value, kind: T.DataType, early: bool = False):
    """A cell as a value of the declared type; ``early`` is the calendar that begins in 1904."""
    if value is None or (isinstance(value, str) and value.strip() in MISSING):
        return None
    if isinstance(kind, T.StringType):
        return _text(value)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (T.DateType, T.TimestampType)) and isinstance(value, float):
        days = value + (1462 if early else 0)
        moment = datetime(1899, 12, 30 if days >= 60 else 31) + timedelta(days=days)  # 1900 counts a day too many
        return moment.date() if isinstance(kind, T.DateType) else moment
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return date.fromisoformat(value.strip())
    number = float(value) if not isinstance(value, bool) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)) and number is not None:
        return number
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)) and number is not None and number.is_integer():
        return int(number)
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, sheet) of the workbooks at ``path``, positions from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    names = [n for n, _ in sheet_parts(book)]
                yield pa.RecordBatch.from_arrays([pa.array([where.as_py()] * len(names), pa.string()), pa.array(range(1, len(names) + 1), pa.int32()), pa.array(names, pa.string())], ["path", "position", "sheet"])

    return _files(spark, path).mapInArrow(run, "path string, position int, sheet string")


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, sheet: int | str | Sequence[int | str] = 1, header: int = 1) -> DataFrame:
    """The columns of ``schema``, found by their names in row ``header``, of one or more sheets.

    ``sheet`` is a position from 1, a name, or several of these, whose rows are put together; a
    path of many files puts these together too. Every file and sheet is a partition. ``NA`` and
    nothing are missing values, and rows that miss all columns are left out; a column or sheet
    that is not there and a cell that is not of the declared type are errors.
    """
    sheets = [sheet] if isinstance(sheet, (int, str)) else list(sheet)
    kinds = [f.dataType for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(k) for k in kinds]
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    _, part = _position(book, sheets[place])
                    texts = _texts(book)
                    properties = _part(book, "xl/workbook.xml").find(f"{MAIN}workbookPr")
                    early = properties is not None and properties.get("date1904") in ("1", "true")
                    names = _header(book, part, texts, header)
                    absent = [f.name for f in schema.fields if f.name not in names]
                    if absent:
                        raise ValueError(f"sheet {sheets[place]!r} has no column {', '.join(absent)}; it has {', '.join(names)}")
                    at = [names[f.name] for f in schema.fields]
                    held: list[list] = []
                    for row, values in cells(book, part, texts, set(at)):
                        if row > header:
                            made = [convert(values.get(a), k, early) for a, k in zip(at, kinds, strict=True)]
                            if any(x is not None for x in made):
                                held.append(made)
                        if len(held) == BATCH:
                            yield _batch(held, types, schema)
                            held = []
                    if held:
                        yield _batch(held, types, schema)

    asked = _files(spark, path).select(F.explode(F.array(*[F.lit(k) for k in range(len(sheets))])).alias("place"), "content")
    return (asked.repartitionById(len(sheets), "place") if len(sheets) > 1 else asked).mapInArrow(run, schema)


def _batch(rows: list[list], types: list, schema: T.StructType) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])


def read_wide_sheet(spark: SparkSession, path: str, sheet: int | str = 1, header: int = 1) -> DataFrame:
    """A whole sheet, every column as text: for tables with a column a year.

    The names are read first, which takes one pass over the head of the sheet.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as book:
                    found = list(_header(book, _position(book, sheet)[1], _texts(book), header))
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.string()))], ["names"])

    found = _files(spark, path).limit(1).mapInArrow(names, "names array<string>").first()
    if found is None:
        raise ValueError(f"no workbook at {path}")
    return read_sheet(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in found.names]), sheet, header)


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    raise ValueError(f"{value!r} has no cell type")


def _sheet_xml(names: list[str], rows: list) -> str:
    def row(number: int, values) -> str:
        found = []
        for at, value in enumerate(values):
            text = _cell(value)
            if text:
                letters, n = "", at + 1
                while n:
                    n, rest = divmod(n - 1, 26)
                    letters = chr(65 + rest) + letters
                found.append(text.replace("<c", f'<c r="{letters}{number}"', 1))
        return f'<row r="{number}">{"".join(found)}</row>'

    body = "".join(row(k, values) for k, values in enumerate([names, *rows], 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def write_workbook(tables: dict[str, DataFrame], path: str, most_rows: int = MOST_ROWS) -> None:
    """Writes finished dimension tables as the sheets of one workbook, through Spark's file system.

    A workbook is one file that one process writes, so its sheets come to the driver: a table of
    more than ``most_rows`` rows is an error. Rows are sorted by all columns, for equal files.
    """
    package, office = "http://schemas.openxmlformats.org/package/2006", LINK[1:-3]
    spark = next(iter(tables.values())).sparkSession
    parts = {}
    for k, df in enumerate(tables.values(), 1):
        rows = df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"a sheet of more than {most_rows} rows")
        parts[f"xl/worksheets/sheet{k}.xml"] = _sheet_xml(df.columns, rows)
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1))
    sheets = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for name in parts)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    parts |= {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>',
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in sorted(parts.items()):
            book.writestr(zipfile.ZipInfo(name), text)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(held.getvalue()))
    finally:
        stream.close()
