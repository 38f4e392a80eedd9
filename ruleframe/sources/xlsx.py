"""Spreadsheets with the standard library only: a reader (also as a Spark data source) and writers."""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ruleframe.errors import RuleError

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Number formats that are built in and show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    """A workbook file; formulas give their cached values."""

    def __init__(self, path: str) -> None:
        self.zip = zipfile.ZipFile(path)
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): "xl/" + links[s.get(_R + "id")].removeprefix("/xl/").removeprefix("xl/") for s in book.iter(_M + "sheet")}
        names = self.zip.namelist()
        self.texts = [self._text(si) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(_M + "si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()
        prop = book.find(_M + "workbookPr")
        late = prop is not None and prop.get("date1904") in ("1", "true")
        self.epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)

    @staticmethod
    def _text(node: ET.Element) -> str:
        return "".join(t.text or "" for child in node for t in ([child] if child.tag == _M + "t" else child.iter(_M + "t") if child.tag == _M + "r" else []))

    def _date_styles(self) -> set[int]:
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in root.iter(_M + "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        xfs = root.find(_M + "cellXfs")
        return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", "0")) in _DATE_FORMATS | own}

    def _value(self, c: ET.Element) -> Any:
        kind, v = c.get("t", "n"), c.find(_M + "v")
        if kind == "inlineStr":
            node = c.find(_M + "is")
            return self._text(node) if node is not None else None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.texts[int(v.text)]
        if kind in ("str", "e"):
            return v.text
        if kind == "b":
            return v.text == "1"
        if kind == "d":
            return dt.datetime.fromisoformat(v.text)
        x = float(v.text)
        if int(c.get("s", "0")) in self.dates:
            return self.epoch + dt.timedelta(days=x)
        return int(x) if x.is_integer() and abs(x) < 2**53 and not re.search(r"[.eE]", v.text) else x

    def rows(self, sheet: str | None = None) -> Iterator[list[Any]]:
        if sheet is None:
            if len(self.sheets) != 1:
                raise RuleError(f"name one of the sheets {list(self.sheets)}")
            sheet = next(iter(self.sheets))
        if sheet not in self.sheets:
            raise RuleError(f"there is no sheet {sheet!r}, but {list(self.sheets)}")
        expected = 1
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ET.iterparse(f):
                if node.tag != _M + "row":
                    continue
                at = int(node.get("r", expected))
                for _ in range(at - expected):
                    yield []
                expected = at + 1
                row: list[Any] = []
                for c in node.iter(_M + "c"):
                    i = _column(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (i - len(row)) + [self._value(c)]
                yield row
                node.clear()


def read_rows(path: str, sheet: str | None = None) -> tuple[list[str], list[list[Any]]]:
    """Header and rows of a sheet: empty columns at the right go, short rows are filled, blank rows stay as nulls."""
    rows = list(Workbook(path).rows(sheet))
    if not rows:
        raise RuleError("the sheet is empty")
    width = max((i + 1 for r in rows for i, v in enumerate(r) if v is not None and v != ""), default=0)
    if not width:
        raise RuleError("the sheet is empty")
    header = [("" if v is None else str(v)).strip() for v in rows[0][:width]]
    used = next((i for i in range(len(header), 0, -1) if header[i - 1]), 0)
    if width > len(header) or used < len(header):
        raise RuleError("a row is longer than the header")
    if "" in header:
        raise RuleError(f"header cell {header.index('') + 1} is blank")
    again = {h for h in header if header.count(h) > 1}
    if again:
        raise RuleError(f"the header repeats {sorted(again)}")
    return header, [[None if v == "" else v for v in r[:width]] + [None] * (width - len(r)) for r in rows[1:]]


def _kind(values: Iterable[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType()
    return T.TimestampNTZType() if kinds == {dt.datetime} else T.StringType()


def _typed(path: str, sheet: str | None) -> tuple[T.StructType, list[tuple]]:
    header, rows = read_rows(path, sheet)
    kinds = [_kind(r[i] for r in rows) for i in range(len(header))]

    def fit(v: Any, k: T.DataType) -> Any:
        if v is None or not isinstance(k, (T.StringType, T.DoubleType)):
            return v
        return float(v) if isinstance(k, T.DoubleType) else v if isinstance(v, str) else str(v)

    return T.StructType([T.StructField(h, k) for h, k in zip(header, kinds)]), [tuple(fit(v, k) for v, k in zip(r, kinds)) for r in rows]


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", name).load(path)``; types are inferred over all rows."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        return _typed(self.options["path"], self.options.get("sheet"))[0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], self.options.get("sheet"))


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None) -> None:
        self.path, self.sheet = path, sheet

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _typed(self.path, self.sheet)[1]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx")
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>{more}</Relationships>'
#: Cell formats: 0 plain, 1 date and time, 2 date, 3 yellow (a fixed value).
_STYLES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFF59D"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf numFmtId="22" applyNumberFormat="1"/><xf numFmtId="14" applyNumberFormat="1"/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>'


def _cell(at: str, v: Any, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if v is None:
        return f'<c r="{at}"{s}/>' if style else ""
    if isinstance(v, bool):
        return f'<c r="{at}"{s} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (dt.datetime, dt.date)):
        when = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        days = (when.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{at}" s="{style or (1 if isinstance(v, dt.datetime) else 2)}"><v>{days!r}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{at}"{s}><v>{v!r}</v></c>'
    text = escape(_BAD.sub("", v if isinstance(v, str) else str(v)))
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_rows(path: str, header: list[str], rows: Iterable[Iterable[Any]], sheet: str = "Sheet1", captions: dict[str, str] | None = None, filtered: bool = False, marked: Callable[[tuple], set[int]] | None = None, progress: Callable[[int, int | None], None] | None = None, total: int | None = None, batch: int = 10_000) -> str:
    """Write one sheet row by row. ``captions``: a second row with a caption a column (else its name); ``filtered``: a
    frozen header and first column, with a filter if there are rows; ``marked``: the columns of a row to colour; ``progress``: called with the rows written and
    ``total`` each ``batch`` rows and at the end."""
    if not path.lower().endswith((".xlsx", ".xlsm")):
        raise RuleError("only .xlsx and .xlsm can be written")
    if batch <= 0:
        raise RuleError("the batch size must be positive")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.replace("officedocument.spreadsheetml.sheet.main", "ms-excel.sheet.macroEnabled.main").replace("vnd.openxmlformats-ms-excel", "vnd.ms-excel") if path.lower().endswith(".xlsm") else _TYPES)
        z.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml", more=""))
        style = '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml", more=style))
        name = escape(sheet, {'"': "&quot;"})
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", _STYLES)
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            put = lambda s: out.write(s.encode())
            put('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">')
            if filtered:
                put('<sheetViews><sheetView workbookViewId="0"><pane xSplit="1" ySplit="1" topLeftCell="B2" state="frozen"/></sheetView></sheetViews>')
            put("<sheetData>")
            n = 0

            def line(values: Iterable[Any], colour: set[int] = frozenset()) -> None:
                nonlocal n
                n += 1
                cells = "".join(_cell(f"{_letters(i)}{n}", v, 3 if i in colour else 0) for i, v in enumerate(values))
                put(f'<row r="{n}">{cells}</row>')

            line(header)
            if captions is not None:
                line([captions.get(h, h) for h in header])
            done = 0
            for r in rows:
                values = tuple(r)
                line(values, marked(values) if marked else frozenset())
                done += 1
                if progress and done % batch == 0:
                    progress(done, total)
            put("</sheetData>")
            if filtered and header and done:
                put(f'<autoFilter ref="A1:{_letters(len(header) - 1)}{n}"/>')
            put("</worksheet>")
            if progress:
                progress(done, total)
    return path


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", captions: dict[str, str] | None = None, progress: Callable[[int, int | None], None] | None = None, batch: int = 10_000) -> str:
    """A table as one sheet, streamed through the driver partition by partition; a sheet is one file by nature."""
    return write_rows(path, df.columns, df.toLocalIterator(prefetchPartitions=True), sheet, captions, progress=progress, total=df.count() if progress else None, batch=batch)


# The column that tells the kind of a difference, its kinds, and the prefixes of both sides.
DIFF_KIND, DIFF_KINDS, DIFF_FIELDS, OLD, NEW = "差异类型", ("增", "删", "改"), "变更字段", "旧", "新"


def write_diff(reported: DataFrame, path: str, sheet: str = "差异明细") -> str:
    """A side-by-side difference report: the kind first, then keys, all old and all new values; changed cells coloured,
    filter, frozen panes, and the number of each kind in the file's name. The report is run once: rows are counted while
    they are written, and the file gets its name afterwards. Other endings than .xlsx and .xlsm become .xlsx."""
    stem, suffix = os.path.splitext(path)
    if suffix.lower() not in (".xlsx", ".xlsm"):
        suffix = ".xlsx"
    sides = [[c for c in reported.columns if c.startswith(f"{p}_")] for p in (OLD, NEW)]
    keys = [c for c in reported.columns if c not in (DIFF_KIND, DIFF_FIELDS, *sides[0], *sides[1])]
    header = [DIFF_KIND, *keys, *sides[0], *sides[1]]
    at = {h: i for i, h in enumerate(header)}
    order, fields, kind = [reported.columns.index(h) for h in header], reported.columns.index(DIFF_FIELDS), reported.columns.index(DIFF_KIND)
    counts = dict.fromkeys(DIFF_KINDS, 0)
    pending: list[set[int]] = []

    def rows() -> Iterator[tuple]:
        for r in reported.toLocalIterator(prefetchPartitions=True):
            counts[r[kind]] += 1
            pending.append({at[f"{side}_{f}"] for f in r[fields] for side in (OLD, NEW)})
            yield tuple(r[i] for i in order)

    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    staged = os.path.join(folder, f".{uuid.uuid4().hex}{suffix}")
    try:
        write_rows(staged, header, rows(), sheet, filtered=True, marked=lambda _: pending.pop(0))
        named = f"{stem}({'_'.join(f'{k}{n}' for k, n in counts.items())}){suffix}"
        os.replace(staged, named)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return named
