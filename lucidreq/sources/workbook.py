"""Workbooks (zip archives of XML) read and written by tasks.

Reading: Spark hands a task the bytes of a workbook; its sheet is parsed as a stream of rows.
Writing: tasks format the rows of each table as XML; one task, in the tables' order, streams
them through the archive. The archive's bytes leave that task through Spark's text writer, cut at their line feeds
(the writer puts one after each piece), so the file can lie in any store that Spark reaches; a comment of
one line feed makes the archive end in one.

A sheet holds at most ROWS rows, and more than ``writers.PART_BYTES`` of XML are too much for a task: such tables become a folder of
workbooks, each complete in itself, with all sheets and their first rows and consecutive rows of the tables, each written by a task of
its own. The reader takes a folder as one workbook. Cells are written as text, numbers or booleans, and null as an empty cell;
characters that XML can't hold are written as _xHHHH_, and read back.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

#: Rows that stay together, as a power of two.
CHUNK_BITS = 10
#: Fixed values of the format: rows of a sheet, namespaces, parts of the archive.
ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

_BAD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


def _coded(text: str) -> str:
    return escape(_BAD.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


def _decoded(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m.group(1), 16)), text)


def _cell(value: object) -> str:
    if value is None or (isinstance(value, float) and value != value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_coded(str(value))}</t></is></c>'


def _row(values: list[object]) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


class _Sink:
    """What an archive is written to: gives away the pieces between line feeds."""

    def __init__(self):
        self.rest, self.pieces = b"", []

    def write(self, data: bytes) -> int:
        *whole, self.rest = (self.rest + bytes(data)).split(b"\n")
        self.pieces += whole
        return len(data)

    def flush(self) -> None:
        pass

    def taken(self) -> list[bytes]:
        out, self.pieces = self.pieces, []
        return out


def _archive(names: list[str]):
    """A function from batches of (sheet, xml) in order to batches of the archive's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(sink.taken(), pa.binary())], names=["piece"])
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as book:
            book.comment = b"\n"
            sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names))
            links = "".join(f'<Relationship Id="rId{k + 1}" Type="{_RELS}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names)))
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in range(len(names)))
            book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
            book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{sheets}</sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            now, part, rows = None, None, 0

            def ended() -> None:
                if part is not None:
                    part.write(b"</sheetData></worksheet>")
                    part.close()

            for batch in batches:
                for sheet, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if sheet != now:
                        ended()
                        now, rows = sheet, 0
                        part = book.open(f"xl/worksheets/sheet{sheet + 1}.xml", "w")
                        part.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    rows += 1
                    if rows > ROWS:
                        raise ValueError(f"sheet {names[sheet]} has more than {ROWS} rows")
                    part.write(xml.encode())
                yield give()
            ended()
        yield give()

    return run


def write_workbook(sheets: dict[str, DataFrame], path: str | Path) -> None:
    """One workbook with a sheet for each table, its columns' names in the first row, its rows in the table's order; a folder of such if it is too large."""
    from . import writers

    spark = next(iter(sheets.values())).sparkSession

    def formatted(kinds: list[str]):
        """Rows as XML; numbers come as text, so nulls don't turn whole numbers into fractions."""
        number = [k in ("tinyint", "smallint", "int", "bigint") for k in kinds]

        @F.pandas_udf("string")
        def run(rows: pd.DataFrame) -> pd.Series:
            own = rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)
            return pd.Series([_row([int(v) if n and v is not None else v for v, n in zip(r, number, strict=True)]) for r in own], dtype=object)

        return run

    lines = spark.createDataFrame([], "sheet int, at long, xml string")
    for k, df in enumerate(sheets.values()):
        own = F.struct(*[(F.col(f"`{c}`") if t in ("double", "float", "boolean") else F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])
        rows = df.select(F.monotonically_increasing_id().alias("at"), own.alias("r"))
        spool = materialize(rows.select("at", formatted([t for _, t in df.dtypes])("r").alias("xml")), "sheet-rows")
        lines = lines.unionByName(spool.select(F.lit(k).alias("sheet"), "at", "xml"))
    lines = lines.withColumn("chunk", F.shiftrightunsigned("at", CHUNK_BITS))
    # A row for each chunk.
    sizes = lines.groupBy("sheet", "chunk").agg(F.sum(F.octet_length("xml")).alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("sheet", "chunk").collect()
    part, filled, now, rows, dealt = 0, 0, None, 0, []
    for r in sizes:
        if r.sheet != now:
            now, rows = r.sheet, 0
        if (filled and filled + r.n > writers.PART_BYTES) or rows + r.rows > ROWS - 1:
            part, filled, rows = part + 1, 0, 0
        filled, rows = filled + r.n, rows + r.rows
        dealt.append((r.sheet, r.chunk, part))
    lines = lines.join(F.broadcast(spark.createDataFrame(dealt, "sheet int, chunk long, part int")), ["sheet", "chunk"]).select("part", "sheet", "at", "xml")
    heads = [(p, k, -1, _row(list(df.columns))) for p in range(part + 1) for k, df in enumerate(sheets.values())]
    lines = lines.unionByName(spark.createDataFrame(heads, "part int, sheet int, at long, xml string"))
    place = writers.placed_path(path)
    pieces = lines.repartitionById(part + 1, F.col("part")).sortWithinPartitions("sheet", "at").select("sheet", "xml").mapInArrow(_archive(list(sheets)), "piece binary")
    folder = f"{place}.parts"
    pieces.select(F.col("piece").cast("string").alias("value")).write.mode("overwrite").text(folder)
    if not part:
        writers.renamed(spark, folder, place)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(hadoop(folder)) if x.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        fs.rename(hadoop(f"{folder}/{name}"), hadoop(f"{folder}/part-{k:05d}.xlsx"))
    fs.delete(hadoop(place), True)
    fs.rename(hadoop(folder), hadoop(place))


def _rows(data: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    """The cells of a sheet (the first unless named) as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [(s.get("name"), links[s.get(f"{{{_RELS}}}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]
        target = next((t for n, t in found if sheet is None or n == sheet), None)
        if target is None:
            raise ValueError(f"the workbook has no sheet {sheet}")
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        text = lambda e: _decoded("".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t")))
        shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")] if "xl/sharedStrings.xml" in names else []
        with book.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{{{_MAIN}}}c"):
                    at = re.match("[A-Z]+", c.get("r") or "")
                    if at:
                        k = 0
                        for letter in at.group():
                            k = 26 * k + ord(letter) - 64
                        cells += [None] * (k - 1 - len(cells))
                    kind, v = c.get("t"), c.find(f"{{{_MAIN}}}v")
                    if kind == "inlineStr":
                        cells.append(text(c))
                    elif v is None or v.text is None:
                        cells.append(None)
                    elif kind == "s":
                        cells.append(shared[int(v.text)])
                    elif kind == "b":
                        cells.append("True" if v.text == "1" else "False")
                    else:
                        cells.append(_decoded(v.text) if kind == "str" else v.text)
                yield cells
                row.clear()


def read_workbook(spark: SparkSession, path: str, names: list[str], optional: dict[str, str] | None = None, sheet: str | None = None, place: str = "pos") -> DataFrame:
    """place and the named columns, as text, of a sheet (the first unless named) of the workbook, or of a folder of workbooks in the order of their names; a workbook is a task's.

    Columns are found by the first row; ``optional`` ones get their default where the sheet lacks them.
    Empty cells are null, rows without any value are left out. Lacking columns fail.
    """
    wanted = [*names, *(optional or {})]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = _rows(data, sheet)
                head = next(rows, [])
                lacking = [n for n in names if n not in head]
                if lacking:
                    raise ValueError(f"columns that the sheet lacks: {', '.join(lacking)}")
                at = [head.index(n) if n in head else None for n in wanted]
                out, k = [], 0
                for r in rows:
                    if any(v is not None for v in r):
                        out.append((file, k, *[(optional or {})[n] if i is None else r[i] if i < len(r) else None for n, i in zip(wanted, at, strict=True)]))
                        k += 1
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=["__file", place, *wanted])
                        out = []
                yield pd.DataFrame(out, columns=["__file", place, *wanted])

    schema = f"__file string, {place} int, " + ", ".join(f"`{n}` string" for n in wanted)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return rows.drop("__file")
    rows = materialize(rows, "workbooks")
    before, base = 0, []
    for r in rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).orderBy("__file").collect():  # a row for each workbook
        base.append((r["__file"], before))
        before += r.n
    rows = rows.join(F.broadcast(spark.createDataFrame(base, "__file string, __base int")), "__file")
    return rows.withColumn(place, F.col(place) + F.col("__base")).drop("__file", "__base")
