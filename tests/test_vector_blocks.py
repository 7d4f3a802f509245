"""Pruned comparison of vectors: equal to all products, and few of them on clustered vectors."""

import numpy as np
import pyarrow as pa
import pytest

from lucidreq.operators import redundancy
from lucidreq.operators import vector_blocks as V

KIND = "pos long, id string, vec array<double>"


def table(spark, vec, places=None):
    places = range(len(vec)) if places is None else places
    return spark.createDataFrame([(int(p), f"i{p}", None if v is None else [float(x) for x in v]) for p, v in zip(places, vec, strict=True)], KIND)


def clustered(seed, clusters, each, dims=24, spread=0.05, shells=True):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    vec = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], each, axis=0) + r.normal(size=(clusters * each, dims)) * spread
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    return vec[r.permutation(len(vec))]


def odd(seed):
    """Vectors of several lengths, zeros, repeats, opposites, next to a null."""
    r = np.random.default_rng(seed)
    vec = list(r.normal(size=(60, 5)) * r.choice([0.1, 1.0, 7.0], size=(60, 1)))
    return [*vec, np.zeros(5), np.zeros(5), vec[0], vec[0], -vec[1], vec[2] * 3, None]


@pytest.mark.parametrize("threshold", [0.9, 0.35, 0.0, -0.5, 2.0])
def test_pairs_equal_all_products(spark, threshold):
    for vec in (clustered(1, 9, 14), odd(2)):
        places = [7 * k % 1009 for k in range(len(vec))]
        got = redundancy.similar_pairs(table(spark, vec, places), threshold, block=8)
        rows = {(r.pos_a, r.pos_b): r.score for r in got.collect()}
        own = [(p, v) for p, v in zip(places, vec, strict=True) if v is not None]
        want = {(min(p, q), max(p, q)): float(v @ w) for k, (p, v) in enumerate(own) for q, w in own[k + 1 :] if v @ w >= threshold}
        assert set(rows) == set(want) and got.count() == len(want)
        assert all(abs(rows[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("k", [1, 4, 500])
def test_neighbours_equal_all_products(spark, k):
    for vec in (clustered(3, 8, 12), odd(4)):
        own = [(p, v) for p, v in enumerate(vec) if v is not None]
        rows = redundancy.neighbour_ranks(table(spark, vec), k, block=8).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.rank):
            got.setdefault(r.pos, []).append(r.other)
        for p, v in own:
            others = sorted((-round(float(v @ w), 9), q) for q, w in own if q != p)[:k]
            assert got[p] == [q for _, q in others]


def test_few_block_pairs_meet(spark):
    vec = clustered(5, 64, 32)
    blocks = V.blocks_of(table(spark, vec), block=16)
    n = blocks.table.count()
    every = n * (n + 1) // 2
    pairs = V.block_pairs(blocks, np.full(len(blocks.cells), 0.9))
    assert pairs.count() < 0.05 * every
    assert pairs.distinct().count() == pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_second_round_of_neighbours_is_small(spark, monkeypatch):
    seen = []
    inner = V.block_pairs
    monkeypatch.setattr(redundancy, "block_pairs", lambda *a: seen.append(inner(*a)) or seen[-1])
    vec = clustered(6, 64, 32)
    df = table(spark, vec)
    redundancy.neighbour_ranks(df, 5, block=16).count()
    n = V.blocks_of(df, block=16).table.count()
    assert seen[0].count() < 0.5 * n * n


def test_pivots_and_nothing(spark):
    assert len(V.choose_pivots(np.zeros((3, 2)), 4)) == 0
    assert len(V.choose_pivots(np.array([[1.0, 0], [2.0, 0], [0, 1.0]]), 5)) == 2
    assert redundancy.similar_pairs(table(spark, []), 0.5).count() == 0
    assert redundancy.neighbour_ranks(table(spark, [None]), 3).count() == 0
    assert redundancy.similar_pairs(table(spark, [np.zeros(3), np.zeros(3)]), 0.0).count() == 1


def test_blocks_are_sent_once_to_a_tile(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUPS", 3)
    vec = clustered(7, 2, 120, spread=2.0)
    blocks = V.blocks_of(table(spark, vec), block=4)
    pairs = V.block_pairs(blocks, np.full(len(blocks.cells), -np.inf))

    class Count(V.Work):
        def met(self, own, others):
            yield pa.RecordBatch.from_arrays([pa.array([own.number]), pa.array([len(others)])], names=["x", "n"])

    rows = V.on_tiles(blocks, pairs, False, Count, "x long, n long").collect()
    n = blocks.table.count()
    assert sum(r.n for r in rows) == n * (n + 1) // 2 and len(rows) <= 3 * n


@pytest.mark.parametrize("threshold", [0.9, 0.35, -0.5])
def test_links_say_what_all_pairs_say(spark, threshold):
    for vec in (clustered(8, 9, 14), odd(9)):
        v = table(spark, vec)
        pairs = redundancy.redundant_pairs(v, threshold, block=8)
        got = redundancy.links(v, threshold, block=8)
        for f in (redundancy.requirement_metrics, redundancy.clusters, redundancy.redundancy_summary):
            assert sorted(map(repr, f(v, got).collect())) == sorted(map(repr, f(v, pairs).collect()))
    assert redundancy.links(table(spark, []), 0.5).forest.count() == 0


def test_cells_are_the_whole_matrix(spark):
    """Every cell once, those of missing vectors (without a score) and of vectors that aren't numbers too."""
    vec = [*odd(10), np.full(5, np.nan)]
    for rows in (vec, [None, None], []):
        got = redundancy.similarity_cells(table(spark, rows), block=8).collect()
        want = {(f"i{p}", f"i{q}"): None if v is None or w is None else float(np.dot(v, w)) for p, v in enumerate(rows) for q, w in enumerate(rows)}
        assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == set(want)
        assert all((r.pos_a, r.pos_b) == (int(r.id_a[1:]), int(r.id_b[1:])) for r in got)
        for r in got:
            x = want[r.id_a, r.id_b]
            assert r.score == x or abs(r.score - x) < 1e-9 or (np.isnan(x) and np.isnan(r.score))


def test_both_orders_meet_in_one_tile(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUPS", 3)
    blocks = V.blocks_of(table(spark, clustered(11, 2, 60, spread=2.0)), block=4)
    pairs = V.block_pairs(blocks, np.full(len(blocks.cells), -np.inf), True)

    class Count(V.Search):
        def met(self, own, others, there, back):
            yield pa.RecordBatch.from_arrays([pa.array([len(others)]), pa.array([sum(there) + sum(back)])], names=["met", "ways"])

    rows = V.on_tiles(blocks, pairs, True, Count, "met long, ways long").collect()
    n = blocks.table.count()
    assert sum(r.met for r in rows) == n * (n + 1) // 2 and sum(r.ways for r in rows) == n * n and len(rows) <= 3 * n


def test_floats_travel_as_floats(spark):
    vec = clustered(12, 6, 14).astype(np.float32)
    doubles = table(spark, vec)
    floats = doubles.withColumn("vec", doubles.vec.cast("array<float>"))
    assert "vec:array<float>" in dict(V.blocks_of(floats, block=8).table.dtypes)["rows"]
    assert sorted(redundancy.similar_pairs(floats, 0.35, block=8).collect()) == sorted(redundancy.similar_pairs(doubles, 0.35, block=8).collect())


def shuffled(spark, run):
    """Rows and bytes that the stages of ``run`` shuffle."""
    new, lists = spark._sc._gateway.new_array, spark._jvm.java.util.ArrayList
    stages = lambda: spark._jsc.sc().statusStore().stageList(None, False, False, new(spark._jvm.double, 0), lists())
    last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    ran = stages()
    ran = [s for s in map(ran.apply, range(ran.size())) if s.stageId() > last]
    return sum(s.shuffleWriteRecords() for s in ran), sum(s.shuffleWriteBytes() for s in ran)


def test_bounds_are_sent_a_fixed_number_of_times(spark):
    """Not once for each cell that a block's own can reach."""
    blocks = V.blocks_of(table(spark, clustered(13, 40, 12, spread=1.0)), block=4)
    n = blocks.table.count()
    assert len(blocks.cells) > 4 * V.SALT
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = shuffled(spark, lambda: V.block_pairs(blocks, np.full(len(blocks.cells), -np.inf)).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows <= 2 * V.SALT * n + 100


def test_a_block_is_sent_to_as_many_tiles_as_there_are_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUPS", 3)
    vec = np.random.default_rng(14).normal(size=(240, 512))
    blocks = V.blocks_of(table(spark, vec), block=8)
    pairs = V.block_pairs(blocks, np.full(len(blocks.cells), -np.inf))
    pairs = spark.createDataFrame(pairs.collect(), pairs.schema)

    class Nothing(V.Work):
        def met(self, own, others):
            yield from ()

    _, sent = shuffled(spark, lambda: V.on_tiles(blocks, pairs, False, Nothing, "x long").count())
    assert blocks.groups == 3 and sent < 3.5 * vec.nbytes
