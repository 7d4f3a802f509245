"""The matrix's file: the same cells whatever strips it is written in, and nothing of it sent or kept beside."""

import os

import numpy as np

from lucidreq.operators import redundancy
from lucidreq.plans import registry
from lucidreq.sources import writers

from .conftest import DATA
from .test_vector_blocks import shuffled, table


def vectors(n=23):
    vec = list(np.random.default_rng(3).normal(size=(n, 5)))
    vec[1], vec[4], vec[7], vec[n - 1] = np.zeros(5), None, np.full(5, np.nan), np.eye(5)[0] * 1e-9
    return vec


def cells(path):
    """Lines of all files by id; each file begins with the head."""
    files = [path] if path.is_file() else sorted(path.glob("part-*"))
    heads, rows = set(), []
    for f in files:
        head, *lines = f.read_text("utf-8").splitlines()
        heads.add(head)
        rows += [line.split(";") for line in lines]
    (head,) = heads
    return len(files), head, rows


def test_missing_vectors_have_empty_fields(spark, tmp_path):
    """Fields after them stay in their columns."""
    vec = vectors(8)
    v = table(spark, vec)
    writers.single_matrix_csv(redundancy.similarity_cells(v, block=3), tmp_path / "m.csv")
    _, head, rows = cells(tmp_path / "m.csv")
    assert head == "\ufeff;" + ";".join(f"i{k}" for k in range(8))
    assert all(len(r) == 9 for r in rows) and rows[0][5] == "" and rows[0][4] != ""


def test_strips_give_the_same_file(spark, tmp_path, monkeypatch):
    vec = vectors()
    v = table(spark, vec)
    writers.single_matrix_csv(redundancy.similarity_cells(v), tmp_path / "want.csv")
    _, head, want = cells(tmp_path / "want.csv")
    for part, strip, name in ((1 << 27, 1 << 27, "one"), (1, 1 << 27, "lines"), (23 * 21 * 4, 23 * 8 * 6, "parts"), (23 * 21 * 2, 23 * 8 * 7, "small"), (23 * 21 * 9, 1, "rows")):
        monkeypatch.setattr(writers, "PART_BYTES", part)
        monkeypatch.setattr(writers, "STRIP_BYTES", strip)
        writers.vectors_matrix_csv(v, tmp_path / name)
        files, top, rows = cells(tmp_path / name)
        assert (files > 1) == (name != "one") and top == head and [r[0] for r in rows] == [r[0] for r in want]
        for got, old in zip(rows, want, strict=True):
            assert len(got) == 24
            for a, b in zip(got[1:], old[1:], strict=True):
                assert a == b or abs(float(a) - float(b)) < 1e-12
    writers.vectors_matrix_csv(v.where("false"), tmp_path / "none")
    assert (tmp_path / "none").read_text("utf-8") == "\ufeff;\n"
    writers.vectors_matrix_csv(table(spark, [None, None]), tmp_path / "nulls")
    assert cells(tmp_path / "nulls")[2] == [["i0", "", ""], ["i1", "", ""]]


def test_fields_are_pythons_shortest_form():
    x = [1.0, 0.0, -0.0, 1e-5, 1.5e-7, 0.0001234, 9.9e14, 1e15, 1.25e15, 1e16, 1e22, -2.5e-9, 0.1 + 0.2, float("nan"), float("inf"), -3.0, 0.125]
    assert writers._scores(np.array(x)).as_py() == ";".join("" if v != v else repr(v) for v in x)


def test_nothing_of_the_matrix_is_shuffled(spark):
    """Before, rows, lines and read lines went through shuffles, over 50 bytes a cell."""
    query = registry.queries()["matrix_file"]
    _, sent = shuffled(spark, lambda: query(spark, f"{DATA}/sf0.001").write.format("noop").mode("overwrite").save())
    assert sent < 4 * 500 * 500


def test_lines_wait_in_groups_of_few_rows(spark, tmp_path, monkeypatch):
    """A reader takes up to 4096 rows of a group at once, however little compressed ones take."""
    import pyarrow.parquet as pq
    import pyspark.sql.functions as F

    spools, inner = [], writers.materialize
    monkeypatch.setattr(writers, "materialize", lambda *a: spools.append(inner(*a)) or spools[-1])
    rows = spark.range(0, 5000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 2000)).alias("line"))
    writers.ordered_file(rows, F.col("line"), tmp_path / "lines")
    (spool,) = spools
    for f in os.listdir(spool.scratch):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(f"{spool.scratch}/{f}").metadata
            assert all(meta.row_group(k).num_rows <= 1024 for k in range(meta.num_row_groups))
    assert len((tmp_path / "lines").read_text().splitlines()) == 5000
