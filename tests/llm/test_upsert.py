"""op13: the copy-on-write upsert against plain Python, over given and odd tables."""

import hashlib
import math
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lucidreq.llm import keyed_upsert as U

from ..conftest import DATA

COLUMNS = ["source", "segment", "city", "balance"]


def crc(v):
    return zlib.crc32(str(v).encode())


def plain(clients, changes, names):
    """The contract in lists; clients and changes are dicts. Returns (rows of each file, rewritten) in order of first id."""
    m = 1 + len(clients) // 1000
    rows = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [rows[k : k + m] for k in range(0, len(rows), m)]
    best = {}
    low = lambda v: (v is not None, v or 0)
    for c in changes:
        if c["client_id"] is not None:
            rank = (low(c["seq"]), low(c["change_id"]))
            if c["client_id"] not in best or rank > best[c["client_id"]][0]:
                best[c["client_id"]] = (rank, c)
    homes = [{r["client_id"]: dict(r) for r in f} for f in files]
    before = [dict(h) for h in homes]
    for k, (_, c) in best.items():
        if not files:
            break
        home = max((i for i, f in enumerate(files) if f[0]["client_id"] <= k), default=0)
        h = crc(files[home][0]["client_id"]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
            homes[home].pop(k, None)
        else:
            homes[home][k] = {**homes[home].get(k, {**dict.fromkeys(names), "client_id": k}), **{x: c[x] for x in COLUMNS}}
    out = []
    for was, now in zip(before, homes, strict=True):
        own = [now[k] for k in sorted(now)]
        if was == now:
            out.append((own, False))
            continue
        n = -(-len(own) // m)
        at = 0
        for k in range(n):
            size = len(own) // n + (k < len(own) % n)
            piece, at = own[at : at + size], at + size
            if out and out[-1][1] and len(out[-1][0]) + size <= m:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    return out


def figures(rows, rewritten, names):
    cents = sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in rows)
    own = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows)
    ids = ",".join(str(r["client_id"]) for r in rows)
    return (rows[0]["client_id"], len(rows), cents, own, hashlib.sha256(ids.encode()).hexdigest(), ",".join(names), rewritten)


def check(spark, folder):
    clients, changes = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("clients", "client_changes"))
    names = clients.columns
    want = [figures(rows, new, names) for rows, new in plain([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()], names)]
    got = U.query(spark, folder).collect()
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got) == sorted(want)
    return got


def test_given_tables(spark):
    got = check(spark, f"{DATA}/sf0.01")
    assert {r.rewritten for r in got} == {True, False}
    # The files hold what the rows say, and nothing else lies in the folder.
    paths = [r.path.removeprefix("file:") for r in got]
    assert [pq.read_table(p).column("client_id")[0].as_py() for p in paths] == [r.first_id for r in got]
    import os

    assert {os.path.join(os.path.dirname(paths[0]), x) for x in os.listdir(os.path.dirname(paths[0])) if x.endswith(".parquet")} == set(paths)


CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, home long, `odd name` string"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, k int"


def _write(spark, tmp_path, clients, changes):
    full = [(c, None, s, None, "n", None, t, 1, None, b, c, "x") for c, s, t, b in clients]
    spark.createDataFrame(full, CLIENT).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame(changes, CHANGE).write.parquet(f"{tmp_path}/client_changes.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", range(2))
def test_odd_tables(spark, tmp_path, seed):
    """Files of several rows; nulls everywhere; most ids inserted beyond either end; repeated changes."""
    r = random.Random(seed)
    ids = r.sample(range(-3000, 6000), 2500) if seed else range(2500)
    clients = [(i, r.choice(["a", None, "ü|x"]), r.choice(["c", None, ""]), r.choice([1.005, -2.5, None, -0.0, 1e12])) for i in ids]
    changes = []
    for n in range(3000):
        k = r.choice([r.randrange(-4000, 9000), r.randrange(200), 7, None])
        row = (n, k, r.randrange(5) if r.random() < 0.9 else None, r.choice(["U", "I", "D", None]), None, r.choice(["a", None]), None, r.choice(["c", ""]), r.choice([1.005, None]), 1)
        changes += [row] * r.choice([1, 1, 2])
    check(spark, _write(spark, tmp_path, clients, changes))


def test_nothing_changes_and_empty_tables(spark, tmp_path):
    clients = [(i, "a", "c", 0.0) for i in range(40)]
    same = [(i, i, 0, "U", None, "a", None, "c", -0.0, 1) for i in range(40)]
    got = U.create(spark.createDataFrame([(i, 0.0, None) for i in range(40)], "client_id long, balance double, city string"), "client_id", 7)
    keep = lambda first, change: F.lit("set")
    assert U.upsert(spark, got, spark.createDataFrame([(i, -0.0) for i in range(40)], "client_id long, balance double"), keep, ["balance"]) == []
    assert len(U._listed(spark, got.path)) == 6
    check(spark, _write(spark, tmp_path / "a", clients, same))
    check(spark, _write(spark, tmp_path / "b", clients, []))
    assert check(spark, _write(spark, tmp_path / "c", [], same)) == []


def test_repeated_keys_and_all_gone(spark):
    rows = spark.createDataFrame([(k // 3, float(k)) for k in range(30)], "client_id long, balance double")
    layout = U.create(rows, "client_id", 4)
    ops = spark.createDataFrame([(2, 1.0, "set"), (5, None, "delete"), (None, 1.0, "set"), (99, 5.0, "set")], "client_id long, balance double, what string")
    new = U.upsert(spark, layout, ops, lambda first, change: change["what"], ["balance"])
    left = sorted((r.client_id, r.balance) for r in U.read(spark, layout).collect())
    assert left == sorted([(k // 3, 1.0 if k // 3 == 2 else float(k)) for k in range(30) if k // 3 != 5] + [(99, 5.0)])
    assert new and set(new) <= set(U._listed(spark, layout.path))
    every = spark.createDataFrame([(k,) for k in range(100)], "client_id long")
    fresh = U.create(rows, "client_id", 4)
    assert U.upsert(spark, fresh, every, lambda first, change: F.lit("delete"), []) == []
    assert U._listed(spark, fresh.path) == [] and U.read(spark, fresh).count() == 0


def test_plan_joins_by_shuffled_hash(spark):
    layout = U.create(spark.range(50).selectExpr("id as client_id", "1.0D as balance"), "client_id", 10)
    files = U.ends(spark, layout)
    assert [f[1:] for f in files] == [(0, 9), (10, 19), (20, 29), (30, 39), (40, 49)]
    got = spark.createDataFrame([(k,) for k in (-5, 0, 9, 10, 49, 1000)], "k long").select(U.home_of(files)(F.col("k")).alias("h")).collect()
    assert [r.h for r in got] == [0, 0, 0, 1, 4, 4]


def test_pieces():
    assert U.pieces_of([(0, 3), (1, 4), (2, None), (3, 0), (4, 21), (5, 2)], 10) == [(0, 0, 0), (1, 0, 0), (4, 0, 1), (4, 1, 2), (4, 2, 3), (5, 0, 3)]
    assert U.pieces_of([(0, None), (1, 0), (2, None)], 10) == []
