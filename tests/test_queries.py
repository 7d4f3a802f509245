"""Every registered query of the requirement operators against its SQL, and the entry."""

import os

import pytest

from lucidreq.plans import registry

from .conftest import DATA, duck_rows, rows_of


def test_all_have_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = rows_of(registry.queries()[name](spark, f"{DATA}/sf0.001"))
    want = duck_rows(duck, registry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_row_wise_plans_have_no_shuffle(spark):
    for name in ("readability_en", "readability_es", "smell_findings", "cleaned_texts"):
        plan = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["catalog_file", "cleaned_file", "pairs_file", "report_files", "smell_input_file", "matrix_file"])
def test_files_in_parts_equal_sql(spark, duck, monkeypatch, name):
    """Many lines become a folder of files, none of which a single task has to write or read whole."""
    from lucidreq.sources import writers

    counts = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions of few rows
    monkeypatch.setattr(writers, "PART_BYTES", 20000 if name != "pairs_file" else 200)
    inner = writers.ordered_file

    def seen(rows, line, path, *rest):
        inner(rows, line, path, *rest)
        place = writers.local_path(writers.placed_path(path))
        counts.append(len([f for f in os.listdir(place) if f.startswith("part-")]) if os.path.isdir(place) else 1)

    monkeypatch.setattr(writers, "ordered_file", seen)
    try:
        assert rows_of(registry.queries()[name](spark, f"{DATA}/sf0.001")) == duck_rows(duck, registry.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(counts) > 1
