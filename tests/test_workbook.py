"""Workbooks: what is written is read back, and foreign ones with shared strings and cell references too."""

import io
import zipfile

import pytest

from lucidreq.plans import registry
from lucidreq.sources import workbook as W
from lucidreq.sources import writers

from .conftest import DATA, duck_rows, rows_of


def test_round_trip(spark, tmp_path):
    rows = [(1, "a<b>&\"c\"", 1.5, True), (None, "ñ\n\tü", None, None), (3, "", -2e-7, False), (2**40, "_x0041_ \x01\r\n\x0b end ", 0.0, True), (None, None, None, None), (5, None, float("nan"), None), (6, "😀" * 9, 7.0, True)]
    df = spark.createDataFrame(rows, "k long, `té xt` string, x double, flag boolean").repartition(3).orderBy("k")
    W.write_workbook({"One & two": df, "Empty": df.where("false"), "More": spark.range(3000).orderBy("id")}, tmp_path / "w.xlsx")
    assert zipfile.ZipFile(tmp_path / "w.xlsx").testzip() is None
    back = W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["té xt", "k", "x", "flag"]).collect()
    text = lambda v: None if v is None or v != v else str(v)
    want = [(r[1], text(r[0]), text(r[2]), text(r[3])) for r in df.collect() if any(text(v) is not None for v in r)]
    assert [(r["té xt"], r.k, r.x, r.flag) for r in back] == want and [r.pos for r in back] == list(range(len(want)))
    assert W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["k"], sheet="Empty").count() == 0
    assert [int(r.id) for r in W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["id"], sheet="More").collect()] == list(range(3000))
    got = W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["k"], {"none": "default"}).first()
    assert got.none == "default"
    with pytest.raises(Exception, match="lacks: nothing"):
        W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["nothing"]).collect()
    with pytest.raises(Exception, match="no sheet"):
        W.read_workbook(spark, str(tmp_path / "w.xlsx"), ["k"], sheet="Absent").collect()


def test_shared_strings_and_gaps(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="{rel}/worksheet" Target="/xl/worksheets/x.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>ID</t></si><si><r><t>Tex</t></r><r><t>to</t></r></si><si><t>é</t></si></sst>")
        z.writestr("xl/worksheets/x.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/><row r="5"><c r="C5" t="s"><v>2</v></c></row><row r="6"><c r="A6"><v>7</v></c><c r="C6" t="str"><f>1</f><v>f</v></c></row></sheetData></worksheet>')
    (tmp_path / "s.xlsx").write_bytes(held.getvalue())
    rows = W.read_workbook(spark, str(tmp_path / "s.xlsx"), ["ID", "Texto"]).collect()
    assert [(r.pos, r.ID, r.Texto) for r in rows] == [(0, None, "é"), (1, "7", "f")]


def test_large_tables_become_a_folder(spark, tmp_path, monkeypatch):
    """Neither a task nor a sheet has to hold a table whole."""
    monkeypatch.setattr(W, "CHUNK_BITS", 4)
    few = spark.createDataFrame([("a", 1), (None, 2)], "name string, k int")
    for rows, size, least in ((W.ROWS, 20000, 3), (101, 1 << 30, 10)):
        monkeypatch.setattr(writers, "PART_BYTES", size)
        monkeypatch.setattr(W, "ROWS", rows)
        path = tmp_path / f"w{rows}.xlsx"
        W.write_workbook({"Few": few.orderBy("k"), "Many": spark.range(1000).repartition(7).selectExpr("id", "repeat('x', cast(id % 90 as int)) as text").orderBy("id")}, path)
        files = sorted(path.iterdir())
        files = [f for f in files if f.suffix == ".xlsx"]
        assert len(files) >= least and all(zipfile.ZipFile(f).testzip() is None for f in files)
        assert all(sum(1 for _ in W._rows(f.read_bytes(), "Many")) <= rows for f in files)
        back = W.read_workbook(spark, str(path), ["id", "text"], sheet="Many", place="line").orderBy("line").collect()
        assert [(r.line, r.id, r.text) for r in back] == [(k, str(k), "x" * (k % 90)) for k in range(1000)]
        assert [(r.pos, r.name, r.k) for r in W.read_workbook(spark, str(path), ["name", "k"]).orderBy("pos").collect()] == [(0, "a", "1"), (1, None, "2")]


@pytest.mark.parametrize("name", ["requirements_workbook", "references_workbook", "report_workbook"])
def test_workbooks_in_parts_equal_sql(spark, duck, monkeypatch, name):
    monkeypatch.setattr(writers, "PART_BYTES", 20000)
    monkeypatch.setattr(W, "CHUNK_BITS", 3)
    assert rows_of(registry.queries()[name](spark, f"{DATA}/sf0.001")) == duck_rows(duck, registry.oracle_sql()[name])
