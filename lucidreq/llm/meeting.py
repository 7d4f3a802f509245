"""Rows that share a key, met without all pairs and without a large key in one task.

A frequency sketch of a fixed size tells which keys stand out; the rows of such a
key are dealt by a salt. Rows are sorted by key and salt and read as a stream, in
which the first row of each key and salt leads the others and only it is held; the
leaders of a split key are led by the first of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_worker_cache
from .shingles import mix

#: Slots of the frequency sketch, and how many of them travel together.
SLOT_BITS, SLOTS_A_ROW = 21, 1 << 16
#: Rows of one key that a task meets, about; beyond, the key is split.
SPLIT = 1 << 18
#: Keys of a row that travel together.
SLICE = 128
_MOST = np.uint64((1 << 32) - 1)


class Slots:
    """How many rows have a key of each slot (the leading bits of the key's hash)."""

    def __init__(self, counts: np.ndarray, split: int = SPLIT):
        # What stands out of twice the mean is one key in many rows, more or less.
        self.counts, self.usual, self.split = counts, 2 * int(counts.mean()), split
        self._sent = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_sent": None}

    def shared(self, spark: SparkSession):
        """Sent to the workers once, whatever uses it."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def discard(self) -> None:
        """Called when all that uses it is written."""
        if self._sent is not None:
            self._sent.destroy()
        self._sent = self.counts = None

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.counts[(keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]

    def salts(self, keys: np.ndarray) -> np.ndarray:
        """Over how many tasks the rows of each key are dealt."""
        return 1 + np.maximum(0, self.count(keys).astype(np.int64) - self.usual) // self.split


def sketch(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The counts of all slots over all rows; ``keys`` gives the hashes that a batch holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        total = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        held, size = [], 0

        def add():
            slots = np.concatenate([*held, np.zeros(0, np.uint64)]) >> np.uint64(64 - SLOT_BITS)
            total[:] += np.bincount(slots.astype(np.int32), minlength=len(total)).astype(np.uint32)

        for batch in batches:
            for s in keys(batch):
                held.append(s)
                size += len(s)
                if size >= 2_000_000:
                    add()
                    held, size = [], 0
        add()
        kind = "<u1" if total.max() < 256 else "<u4"
        parts = [(k, x) for k, x in enumerate(total.reshape(-1, SLOTS_A_ROW)) if x.any()]
        blobs = [kind[2:].encode() + zlib.compress(x.astype(kind).tobytes(), 1) for _, x in parts]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], names=["row", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = blob.as_py()
                own = sums.setdefault(k, np.zeros(SLOTS_A_ROW, np.uint64))
                own += np.frombuffer(zlib.decompress(memoryview(blob)[1:]), f"<u{blob[:1].decode()}")
        blobs = [zlib.compress(np.minimum(x, _MOST).astype("<u4").tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["row", "counts"])

    kind = "row int, counts binary"
    rows = df.mapInArrow(count, kind).repartition("row").mapInArrow(add_up, kind)
    out = np.zeros((1 << SLOT_BITS) // SLOTS_A_ROW * SLOTS_A_ROW, dtype=np.uint32).reshape(-1, SLOTS_A_ROW)
    for r in rows.collect():  # at most one row for each of the sketch's rows
        out[r.row] = np.frombuffer(zlib.decompress(r.counts), "<u4")
    return out.ravel()


def postings(lists: DataFrame, slots: Slots, central: bool = False) -> DataFrame:
    """key, salt, node, n, pos from rows of node, n and an array of keys.

    pos is a key's place in its array, or, for ``central``, less the more rows have
    the array's keys (the same for ``SLICE`` of them). Long arrays go to the workers
    in slices, so a batch is of bounded size whatever the arrays' lengths.
    """
    shared = slots.shared(lists.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                own = batch.slice(a, 1000)
                col, base = own.column(2), own.column(3).to_numpy()
                key = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                size = np.diff(col.offsets.to_numpy())
                node = np.repeat(own.column(0).to_numpy(), size)
                salt = mix(node.view(np.uint64)) % slots.salts(key).astype(np.uint64)
                if central:
                    total = np.concatenate([[0], np.cumsum(np.minimum(slots.count(key), 1 << 20).astype(np.int64))])
                    stop = np.cumsum(size)
                    pos = np.repeat(np.maximum(total[stop - size] - total[stop], -(1 << 31)), size)
                else:
                    pos = np.arange(len(key)) + np.repeat(base - (np.cumsum(size) - size), size)
                arrays = (key.view(np.int64), salt.astype(np.int32), node, np.repeat(own.column(1).to_numpy(), size).astype(np.int32), pos.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_MET)

    node, n, keys = lists.columns
    starts = F.sequence(F.lit(0), F.floor((F.size(keys) - 1) / SLICE).cast("int"))
    parts = F.transform(starts, lambda i: F.struct(F.slice(keys, i * SLICE + 1, SLICE).alias("keys"), (i * SLICE).alias("base")))
    rows = lists.where(F.size(keys) > 0).select(node, n, F.explode(parts).alias("p")).select(node, n, "p.keys", "p.base")
    return rows.mapInArrow(run, "key long, salt int, node long, n int, pos int")


_MET = ["key", "salt", "node", "n", "pos"]


def met(rows: DataFrame, slots: Slots) -> DataFrame:
    """The :func:`postings` of keys that several rows have, each with the first row of its key and salt: a, an, ap.

    They are sorted by key, salt, pos and node and read as a stream in which only
    the first row of the current key and salt is held.
    """
    shared = slots.shared(rows.sparkSession)
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, told = None, None, True  # the last row; the first row of the key at the end of the last batch, and whether it was given out

        def out(c: list[np.ndarray], keep: np.ndarray, first: np.ndarray):
            arrays = [x[keep] for x in c] + [c[i][first[keep]] for i in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[*_MET, "a", "an", "ap"])

        def alone(c: list[np.ndarray]) -> np.ndarray:
            """Rows of split keys stay even where a salt has no other."""
            return shared.value.salts(c[0].view(np.uint64)) > 1

        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            # A row that repeats counts once.
            again = [np.concatenate([[last is not None and x[0] == v], x[1:] == x[:-1]]) if len(x) else np.zeros(0, bool) for x, v in zip(c, last or [None] * 5)]
            fresh = ~np.logical_and.reduce([again[0], again[1], again[2]])
            if len(fresh):
                last = [x[-1] for x in c]
            c = [x[fresh] for x in c]
            if not len(c[0]):
                continue
            goes_on = head is not None and head[0] == c[0][0] and head[1] == c[1][0]
            if head is not None and not goes_on and not told:
                own = [np.array([v], x.dtype) for v, x in zip(head, c)]
                if alone(own)[0]:
                    yield out(own, np.array([True]), np.array([0]))
            if goes_on:
                c = [np.concatenate([np.array([v], x.dtype), x]) for v, x in zip(head, c)]
            new = np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(new)))
            first = np.repeat(start, size)
            keep = np.repeat(size > 1, size) | alone(c)
            end = start[-1]
            if size[-1] == 1:
                keep[end] = False
            if goes_on and told:
                keep[0] = False
            head, told = [x[end] for x in c], bool(size[-1] > 1 or (goes_on and told and end == 0))
            yield out(c, keep, first)
        if head is not None and not told:
            own = [np.array([v], x.dtype) for v, x in zip(head, c)]
            if alone(own)[0]:
                yield out(own, np.array([True]), np.array([0]))

    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "pos", "node")
    return dealt.mapInArrow(run, f"{fields}, a long, an int, ap int")


def votes(met: DataFrame) -> DataFrame:
    """a, an, ap, node, n: each row with the leader of its key and salt, and those leaders with the first of their key."""
    split = met.where("salt > 0").select("key").distinct()
    heads = met.where("a = node").join(split, "key", "left_semi").select("key", "node", "n", "pos")
    top = heads.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("t")).select("key", F.col("t.node").alias("a"), F.col("t.n").alias("an"), F.col("t.pos").alias("ap"))
    columns = ["a", "an", "ap", "node", "n"]
    return met.select(*columns).unionByName(heads.join(top, "key").select(*columns)).where("a <> node")
