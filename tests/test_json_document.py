"""Documents read by ranges: any range size gives the elements and the rest of the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lucidreq.sources import json_document as J
from lucidreq.sources import writers


def value(r, depth=0):
    k = r.random()
    if k < 0.5:
        return "".join(r.choice(["a", "}", "{", '"', "\\", "[", "]", ",", ":", "é", "\n", '"id"', '\\"', "x" * 30]) for _ in range(r.randrange(12)))
    if k < 0.6:
        return r.choice([None, True, 1, 2.5, -3e9])
    if depth < 2 and k < 0.8:
        return {r.choice(["id", "list", "b"]): value(r, depth + 1) for _ in range(3)}
    return [value(r, depth + 1) for _ in range(r.randrange(4))] if depth < 2 else "z"


@pytest.mark.parametrize("size, entry, indent", [(101, "list", None), (311, "list", 2), (197, None, 0), (10**6, None, None)])
def test_ranges(spark, tmp_path, size, entry, indent):
    r = random.Random(size)
    items = [{"id": str(k), "t": value(r), "list": value(r)} if r.random() < 0.9 else r.choice([None, 1, "s}{", [1, {"a": 2}], []]) for k in range(24)]
    doc = {"catalog_id": "C", "meta": {"list": [{"q": 1}], "z": value(r)}, "other": [{"a": "}"}, value(r)], "list": items, "after": {"list": [1, {}]}}
    text = json.dumps(doc if entry else items, ensure_ascii=size % 2 == 0, indent=indent)
    path = tmp_path / "d.json"
    path.write_text("﻿ " + text + ("\n" if size % 3 else ""), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = J.read_document(spark, str(path), entry)
        rows = found.elements.orderBy("place").collect()
        rest = json.loads(found.rest.first().value)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [x.place for x in rows] == list(range(len(items))) and found.found
    assert [json.loads(x.json) for x in rows] == items
    assert rest == ({**doc, "list": []} if entry else [])


def test_many_tasks_and_small_rows(spark, tmp_path):
    """Eight ranges are read by eight tasks, and no row is longer than an element."""
    rows = spark.range(8_000).selectExpr("id", "repeat('text } ', 20) as t")
    writers.single_document(rows.orderBy("id"), F.to_json(F.struct("id", "t")), tmp_path / "big.json", "list", {"catalog_id": "C"})
    size = (tmp_path / "big.json").stat().st_size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 8)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "big.json")).rdd.getNumPartitions() >= 8
        found = J.read_document(spark, str(tmp_path / "big.json"), "list")
        got = found.elements.selectExpr("place", "get_json_object(json, '$.id') as id", "length(json) as n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.place, int(r.id)) for r in got) == [(k, k) for k in range(8_000)]
    assert max(r.n for r in got) < 300


def test_incomplete_and_absent(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"list": [{"a": 1}')
    with pytest.raises(ValueError, match="complete"):
        J.read_document(spark, str(tmp_path / "a.json"), "list")
    (tmp_path / "b.json").write_text('{"x": {"list": [{"a": 1}]}}')
    found = J.read_document(spark, str(tmp_path / "b.json"), "list")
    assert not found.found and found.elements.count() == 0 and json.loads(found.rest.first().value) == {"x": {"list": [{"a": 1}]}}
    (tmp_path / "c.json").write_text(" [] ")
    assert J.read_document(spark, str(tmp_path / "c.json")).elements.count() == 0


def test_files_equal_those_of_plain_python(spark, tmp_path):
    """The bytes of one file, whatever the partitions: order, quoting, numbers, nulls, line ends, non-ASCII text."""
    import pandas as pd

    rows = [(k, f'n;"{k}"\né' if k % 3 == 0 else None if k % 5 == 0 else "plain", k / 7 if k % 4 else None, k % 2 == 0, 1e-7 * k) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, text string, x double, flag boolean, small double").repartition(7).orderBy("k")
    writers.single_csv(df, tmp_path / "a.csv")
    want = pd.DataFrame(rows, columns=df.columns)
    assert (tmp_path / "a.csv").read_bytes() == want.to_csv(sep=";", index=False, lineterminator="\n").encode("utf-8-sig")
    for ascii_only in (False, True):
        writers.single_json(df.drop("small"), tmp_path / "a.json", ascii_only)
        records = [dict(zip(df.columns[:4], r, strict=False)) for r in rows]
        assert (tmp_path / "a.json").read_text("utf-8") == json.dumps(records, ensure_ascii=ascii_only, indent=2) + "\n"
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
