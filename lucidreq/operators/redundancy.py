"""Redundancy of requirements from their embeddings.

Input everywhere: pos (the requirement's place in the catalog), id, vec (length 1).
Pairs are compared by blocks of vectors, one matrix product for a pair of blocks that can
reach what is asked (see :mod:`.vector_blocks`), so that only pairs over the threshold
become rows. Means over all pairs need no pairs: they are products with the sum of
all vectors. What needs only how many links a vector has and which vectors are linked
(:class:`Links`) needs no pairs either: tiles count the one and keep a forest of the other.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import connected_components
from .vector_blocks import BLOCK, Block, Blocks, Search, Work, block_pairs, blocks_of, on_tiles, reaching

THRESHOLD = 0.90


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds the rows' places (from 0) in an order, without gathering them in one task.

    Ranges are sorted apart and written; the counts of earlier ranges, one for each
    partition, are added.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    part = F.shiftrightunsigned("__at", 33)
    ends = rows.groupBy(part.alias("__p")).agg((F.max(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ends.select("__p", before.alias("__base"))  # a row for each partition
    out = rows.withColumn("__p", part).join(F.broadcast(base), "__p")
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__base")


_PAIR = "pos_a long, pos_b long, id_a string, id_b string, score double"


def _hits(own: Block, other: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the pairs of two blocks over the threshold."""
    x, y, score = reaching(own, other, lambda _: np.float64(threshold))
    hit = score >= threshold
    if own.number == other.number:
        hit &= own.pos[x] < other.pos[y]  # a block with itself
    return x[hit], y[hit], score[hit]


def _ordered(own: Block, other: Block, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Pairs with the smaller place first."""
    a, b = own.pos[x], other.pos[y]
    ids = own.ids.take(pa.array(x)), other.ids.take(pa.array(y))
    first = pa.array(a < b)
    named = [pc.if_else(first, ids[0], ids[1]), pc.if_else(first, ids[1], ids[0])]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *named, pa.array(score)], names=["pos_a", "pos_b", "id_a", "id_b", "score"])


class _Pairs(Work):
    def __init__(self, threshold: float):
        self.threshold = threshold

    def met(self, own, others):
        for other in others:
            x, y, score = _hits(own, other, self.threshold)
            if len(x):
                yield _ordered(own, other, x, y, score)


_GRID = "pos_a array<long>, id_a array<string>, pos_b array<long>, id_b array<string>, score array<double>"


class _Grids(Work):
    """The product of two blocks as one row, in both orders: names of either side once, scores row by row."""

    def met(self, own, others):
        for other in others:
            score = own.vec @ other.vec.T
            for a, b, s in ((own, other, score), (other, own, score.T))[: 1 if own.number == other.number else 2]:
                yield pa.RecordBatch.from_arrays([_one(x) for x in (pa.array(a.pos), a.ids, pa.array(b.pos), b.ids, pa.array(s.ravel()))], names=["pos_a", "id_a", "pos_b", "id_b", "score"])


def _one(values: pa.Array) -> pa.Array:
    """All values as the array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Links(Work):
    """Links of each vector in a tile, and a forest that links what the tile's pairs link."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.start: dict[int, int] = {}
        self.pos = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.root = np.zeros(0, np.int64)

    def _place(self, block: Block) -> int:
        if block.number not in self.start:
            n = len(self.pos)
            self.start[block.number] = n
            self.pos = np.concatenate([self.pos, block.pos])
            self.count = np.concatenate([self.count, np.zeros(len(block.pos), np.int64)])
            self.root = np.concatenate([self.root, np.arange(n, n + len(block.pos))])
        return self.start[block.number]

    def _joined(self, x: np.ndarray, y: np.ndarray) -> None:
        """Roots are each vector's own between calls, so only links between two trees are left to follow."""
        u, v = self.root[x], self.root[y]
        apart = u != v
        if not apart.any():
            return
        up: dict[int, int] = {}

        def top(k: int) -> int:
            while k in up:
                k = up[k]
            return k

        for p, q in set(zip(u[apart].tolist(), v[apart].tolist(), strict=True)):
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
        to = np.arange(len(self.root))
        to[list(up)] = [top(k) for k in up]
        self.root = to[self.root]

    def met(self, own, others):
        a = self._place(own)
        for other in others:
            b = self._place(other)
            x, y, _ = _hits(own, other, self.threshold)
            if len(x):
                self.count[a : a + len(own.pos)] += np.bincount(x, minlength=len(own.pos))
                self.count[b : b + len(other.pos)] += np.bincount(y, minlength=len(other.pos))
                self._joined(x + a, y + b)
        yield from ()

    def ended(self):
        own = np.nonzero(self.count)[0]
        child = np.nonzero(self.root != np.arange(len(self.root)))[0]
        for a, b, n in ((self.pos[own], self.pos[own], self.count[own]), (self.pos[child], self.pos[self.root[child]], np.zeros(len(child), np.int64))):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


class _Nearest(Search):
    """Of each vector of a block the k best of the others that it meets in the tile, ties at nine decimals by place."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _floors(self, own: Block) -> np.ndarray:
        none = (own.pos, np.full((len(own.pos), self.k), -np.inf), np.full((len(own.pos), self.k), np.iinfo(np.int64).max))
        return self.best.setdefault(own.number, none)[1][:, -1]

    def _least(self, score: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """What a row's scores have to reach: its floor, and its k-th best if the floor is lower. Equal at nine decimals may be on either side."""
        new = np.isneginf(floor)
        if score.shape[1] > self.k and new.any():
            floor = floor.copy()
            floor[new] = np.partition(score[new], -self.k, axis=1)[:, -self.k]
        return floor - 2e-9

    def _take(self, own: Block, other: Block, r: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
        _, score_of, other_of = self.best[own.number]
        ok = np.isfinite(value) & (own.pos[r] != other.pos[c]) & (value >= score_of[r, -1] - 2e-9)
        if not ok.any():
            return
        r, c, value = r[ok], c[ok], value[ok]
        some = np.unique(r)
        row = np.concatenate([np.repeat(some, self.k), r])
        value = np.concatenate([score_of[some].ravel(), value])
        place = np.concatenate([other_of[some].ravel(), other.pos[c]])
        order = np.lexsort((place, -np.round(value, 9), row))
        best = order[np.searchsorted(row[order], some)[:, None] + np.arange(self.k)[None, :]]
        score_of[some], other_of[some] = value[best], place[best]

    def met(self, own, others, there, back):
        for other, to, fro in zip(others, there, back, strict=True):
            # Either side's floors are lifted by the product itself where there are none yet.
            mine, theirs = self._floors(own) if to else None, self._floors(other) if fro else None
            same = own.pos[:, None] == other.pos[None, :] if own.number == other.number else None

            def floor(score, mine=mine, theirs=theirs, same=same):
                if same is not None:
                    score[same] = -np.inf
                if score.dtype == np.float64:  # single precision is for numbers only
                    score[np.isnan(score)] = -np.inf
                if theirs is None:
                    return self._least(score, mine)[:, None]
                if mine is None:
                    return self._least(score.T, theirs)[None, :]
                return np.minimum(self._least(score, mine)[:, None], self._least(score.T, theirs)[None, :])

            r, c, value = reaching(own, other, floor)
            if to:
                self._take(own, other, r, c, value)
            if fro:
                self._take(other, own, c, r, value)
        yield from ()

    def ended(self):
        for number, (pos, score_of, other_of) in self.best.items():
            r, c = np.nonzero(np.isfinite(score_of))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), number, np.int64)), pa.array(pos[r]), pa.array(other_of[r, c]), pa.array(score_of[r, c])], names=["x", "pos", "other", "score"])


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, blocks: Blocks | None = None) -> DataFrame:
    """pos_a < pos_b, id_a, id_b and score of all pairs with score >= threshold. Only blocks that can reach it are multiplied."""
    blocks = blocks or blocks_of(vectors, block)
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], _PAIR)
    pairs = block_pairs(blocks, np.full(len(blocks.cells), threshold))
    return on_tiles(blocks, pairs, False, lambda: _Pairs(threshold), _PAIR)


@dataclass
class Links:
    """``degrees``: pos, degree_t of those with links; ``forest``: pos_a, pos_b, links that connect what all pairs connect."""

    degrees: DataFrame
    forest: DataFrame


def links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> Links:
    """The links of all pairs with score >= threshold, without a row for each pair."""
    blocks = blocks_of(vectors, block)
    kind = "a long, b long, n long"
    if blocks is None:
        found = vectors.sparkSession.createDataFrame([], kind)
    else:
        pairs = block_pairs(blocks, np.full(len(blocks.cells), threshold))
        found = materialize(on_tiles(blocks, pairs, False, lambda: _Links(threshold), kind), "links")
    degrees = found.where("n > 0").groupBy(F.col("a").alias("pos")).agg(F.sum("n").alias("degree_t"))
    return Links(degrees, found.where("n = 0").select(F.col("a").alias("pos_a"), F.col("b").alias("pos_b")))


def _ranked(vectors: DataFrame, k: int, block: int, blocks: Blocks | None) -> DataFrame:
    """pos, other, rank, score of the k nearest others of each."""
    kind = "x long, pos long, other long, score double"
    blocks = blocks or blocks_of(vectors, block)
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], "pos long, other long, rank int, score double")
    best = lambda: _Nearest(k)
    # The blocks of a cell are numbered by its vectors' places, so the next one is ``block`` further on.
    near = blocks.table.select(F.col("block").alias("x"), F.explode(F.array(F.col("block"), F.col("block") + block)).alias("y"))
    near = near.join(blocks.table.select(F.col("block").alias("y")), "y", "left_semi").select("x", "y")
    first = materialize(on_tiles(blocks, near, True, best, kind), "near-neighbours")
    # Of each vector the k-th best so far; a block with a vector that has fewer than k has no floor.
    kth = first.groupBy("x", "pos").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("kth"))
    floors = kth.groupBy("x").agg(F.min("kth").alias("floor"), F.count("kth").alias("full"))
    sizes = blocks.table.select("cell", F.col("block").alias("x"), F.size("rows").alias("n"))
    floor = F.when(F.col("full") == F.col("n"), F.col("floor")).otherwise(F.lit(-np.inf))
    floors = materialize(sizes.join(floors, "x", "left").select("cell", F.col("x").alias("block"), floor.alias("floor")), "near-floors")
    least = {r.cell: r.f for r in floors.groupBy("cell").agg(F.min("floor").alias("f")).collect()}  # a row for each cell
    pairs = block_pairs(blocks, np.array([least[c] for c in blocks.cells]), True, floors.select("block", "floor")).join(near, ["x", "y"], "left_anti")
    found = first.unionAll(on_tiles(blocks, pairs, True, best, kind))
    # Products of different shapes may differ in the last bits; ties are judged at nine decimals.
    w = Window.partitionBy("pos").orderBy(F.desc(F.round("score", 9)), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pos", "other", "rank", "score")


def neighbour_ranks(vectors: DataFrame, k: int, block: int = BLOCK, blocks: Blocks | None = None) -> DataFrame:
    """pos, other, rank: the k nearest others of each, ties by place.

    Two rounds: blocks with themselves and the one after them give each vector a
    k-th best score; then only blocks that can reach the least of a block's k-th
    best scores are multiplied with it. Each tile sends its k best.
    """
    return _ranked(vectors, k, block, blocks).select("pos", "other", "rank")


def redundant_pairs(vectors: DataFrame, threshold: float = THRESHOLD, top_k: int | None = None, block: int = BLOCK) -> DataFrame:
    """pos_a, pos_b, id_a, id_b, score, rank_from_a, rank_from_b.

    With top_k a pair stays if either is among the other's k nearest; without,
    ranks are 0.
    """
    if top_k is None:
        return similar_pairs(vectors, threshold, block).withColumns({"rank_from_a": F.lit(0), "rank_from_b": F.lit(0)})
    # What stays is among the nearest of one of the two: at most k for each vector.
    ranks = _ranked(vectors, top_k, block, None)
    of = lambda end: F.coalesce(F.max(F.when(F.col("pos") == F.col(end), F.col("rank"))), F.lit(0))
    ends = ranks.select(F.least("pos", "other").alias("pos_a"), F.greatest("pos", "other").alias("pos_b"), "pos", "rank", "score")
    pairs = ends.groupBy("pos_a", "pos_b").agg(F.max("score").alias("score"), of("pos_a").alias("rank_from_a"), of("pos_b").alias("rank_from_b")).where(F.col("score") >= threshold)
    ids = vectors.select("pos", "id")
    named = pairs.join(ids.select(F.col("pos").alias("pos_a"), F.col("id").alias("id_a")), "pos_a").join(ids.select(F.col("pos").alias("pos_b"), F.col("id").alias("id_b")), "pos_b")
    return named.select("pos_a", "pos_b", "id_a", "id_b", "score", "rank_from_a", "rank_from_b")


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """By falling score, then by place."""
    return pairs.orderBy(F.desc("score"), "pos_a", "pos_b")


def vector_sums(vectors: DataFrame, *by: str) -> DataFrame:
    """n and the summed vector (array total), overall or by group; partial sums first."""
    dims = vectors.select(*by, F.posexplode(F.col("vec").cast("array<double>")).alias("d", "x"))
    summed = dims.groupBy(*by, "d").agg(F.sum("x").alias("s"))
    packed = summed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda v: v["s"]).alias("total"))
    counts = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(packed, list(by)) if by else counts.crossJoin(F.broadcast(packed))


def requirement_metrics(vectors: DataFrame, pairs: DataFrame | Links) -> DataFrame:
    """pos, id, mean_sim (to all others, whatever the threshold) and degree_t (redundant pairs it is in)."""
    from .vectors import dot

    if isinstance(pairs, Links):
        ends = pairs.degrees
    else:
        ends = pairs.select(F.explode(F.array("pos_a", "pos_b")).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("degree_t"))
    own = vectors.crossJoin(F.broadcast(vector_sums(vectors)))
    mean = F.when(F.col("n") > 1, (dot(F.col("vec"), F.col("total")) - dot(F.col("vec"), F.col("vec"))) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return own.select("pos", "id", mean.alias("mean_sim")).join(ends, "pos", "left").select("pos", "id", "mean_sim", F.coalesce("degree_t", F.lit(0)).alias("degree_t"))


def membership(vectors: DataFrame, pairs: DataFrame | Links) -> DataFrame:
    """pos, id, vec, root: the smallest place of the component; those without pairs are their own."""
    pairs = pairs.forest if isinstance(pairs, Links) else pairs
    found = connected_components(pairs.select(F.col("pos_a").alias("a"), F.col("pos_b").alias("b"))).withColumnRenamed("node", "pos")
    return vectors.join(found, "pos", "left").select("pos", "id", "vec", F.coalesce("component", "pos").alias("root"))


def clusters(vectors: DataFrame, pairs: DataFrame | Links) -> DataFrame:
    """cluster_id, size, representative, members: by size, then by first member.

    The representative has the largest mean similarity to the other members,
    the first of equals; a cluster's means come from its vector sum.
    """
    from .vectors import dot

    members = materialize(membership(vectors, pairs), "members")
    several = members.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    large = members.join(several, "root", "left_semi")
    sums = vector_sums(large, "root")
    score = large.join(sums, "root").withColumn("mean", (dot(F.col("vec"), F.col("total")) - dot(F.col("vec"), F.col("vec"))) / (F.col("n") - 1))
    best = score.groupBy("root").agg(F.min(F.struct((-F.round("mean", 9)).alias("m"), "pos", "id")).alias("b")).select("root", F.col("b.id").alias("rep"))
    grouped = members.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("members"))
    out = grouped.join(best, "root", "left").withColumn("representative", F.coalesce("rep", F.col("members")[0]))
    ids = numbered(out.select("size", "root"), "cluster_id", F.desc("size"), F.col("root")).select("root", (F.col("cluster_id") + 1).cast("int").alias("cluster_id"))
    return out.join(ids, "root").select("cluster_id", "size", "representative", "members", "root")


def redundancy_summary(vectors: DataFrame, pairs: DataFrame | Links) -> DataFrame:
    """n_requirements, n_pairs_total, n_pairs_redundant, n_clusters, redundant_requirements, redundancy_rate."""
    members = membership(vectors, pairs).groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    m = members.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_requirements"), F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("redundant_requirements")
    )
    if isinstance(pairs, Links):
        p = pairs.degrees.agg((F.coalesce(F.sum("degree_t"), F.lit(0)) / 2).cast("long").alias("n_pairs_redundant"))
    else:
        p = pairs.agg(F.count(F.lit(1)).alias("n_pairs_redundant"))
    n = F.col("n_requirements")
    return m.crossJoin(F.broadcast(p)).select(
        "n_requirements",
        ((n * (n - 1)) / 2).cast("long").alias("n_pairs_total"),
        "n_pairs_redundant",
        "n_clusters",
        "redundant_requirements",
        F.when(n > 0, F.col("redundant_requirements") / n).otherwise(F.lit(0.0)).alias("redundancy_rate"),
    )


def similarity_cells(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """id_a, id_b, score of the whole matrix, diagonal included, as cells.

    Workers give a row for two blocks; cells are made of it where they are used, and nothing of the matrix is shuffled.
    """
    named = vectors.select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("string").alias("id"), "vec")
    parts = []
    blocks = blocks_of(vectors, block)
    if blocks is not None:
        grids = on_tiles(blocks, block_pairs(blocks, np.full(len(blocks.cells), -np.inf)), False, _Grids, _GRID)
        cells = grids.select("pos_a", "id_a", "pos_b", "id_b", F.posexplode("score").alias("k", "score"))
        n = F.size("pos_b")
        a, b = (F.col("k") / n).cast("int"), F.col("k") % n
        parts.append(cells.select(F.get("pos_a", a).alias("pos_a"), F.get("pos_b", b).alias("pos_b"), F.get("id_a", a).alias("id_a"), F.get("id_b", b).alias("id_b"), "score"))
    if blocks is None or not vectors.where("vec is null").isEmpty():
        # Cells of a missing vector have no score, but the matrix has them.
        x, y = (named.select(F.col("pos").alias(f"pos_{e}"), F.col("id").alias(f"id_{e}"), F.col("vec").isNull().alias(f"no_{e}")) for e in "ab")
        parts += [
            m.select("pos_a", "pos_b", "id_a", "id_b", F.lit(None).cast("double").alias("score"))
            for m in (x.where("no_a").crossJoin(y), x.where("not no_a").crossJoin(y.where("no_b")))
        ]
    return functools.reduce(DataFrame.unionByName, parts)
