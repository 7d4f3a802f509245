"""Greedy matching of token vectors as products of matrices.

``consistency.greedy_match`` is a column expression for a handful of tokens. Here
the pairs' ragged matrices come in Arrow batches, which Spark closes by rows and
by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), and are multiplied in
tiles of bounded size, so memory doesn't grow with the number of tokens of a pair
squared. No shuffle: a pair is scored where its row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Products of a tile.
TILE = 1 << 20


def match(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """precision, recall and f1: the mean best product of a's rows over b's, of b's over a's, their harmonic mean."""
    if not len(a) or not len(b):
        return 0.0, 0.0, 0.0
    step = max(1, TILE // len(b))
    mine, theirs = 0.0, np.full(len(b), -np.inf)
    for at in range(0, len(a), step):
        products = a[at : at + step] @ b.T
        mine += products.max(axis=1).sum()
        np.maximum(theirs, products.max(axis=0), out=theirs)
    p, r = float(mine / len(a)), float(theirs.mean())
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row of a list of lists of numbers as a matrix of doubles, read from the buffers; null and empty rows have no tokens."""
    outer, tokens = column.offsets.to_numpy(), column.values
    inner, numbers = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        begin, end = (outer[i], outer[i + 1]) if there[i] else (0, 0)
        if begin == end:
            yield np.empty((0, 0))
            continue
        sizes = np.diff(inner[begin : end + 1])
        if (sizes != sizes[0]).any():
            raise ValueError("token vectors of one text must have one length, and none may be null")
        yield np.asarray(numbers[inner[begin] : inner[end]], dtype=np.float64).reshape(end - begin, -1)


def match_pairs(pairs: DataFrame, candidate: str, reference: str, out: str = "match") -> DataFrame:
    """The rows of ``pairs`` with a struct of precision, recall and f1; both matrices stay behind.

    candidate and reference: arrays of token vectors of length 1, any number of
    tokens on either side. A side that is null or empty scores 0. Repeated rows
    stay, a column named as the result is replaced, other names don't matter.
    """
    own = [F.col(f"`{c}`") for c in pairs.columns if c not in (candidate, reference, out)]
    as_numbers = lambda c: F.col(f"`{c}`").cast("array<array<double>>")
    kept = pairs.select(F.struct(*own, F.lit(0).alias("none")).alias("row"), as_numbers(candidate).alias("a"), as_numbers(reference).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [match(a, b) for a, b in zip(matrices(batch.column(1)), matrices(batch.column(2)))]
            columns = [pa.array([s[k] for s in scores], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "precision", "recall", "f1"])

    schema = StructType([kept.schema["row"], *[StructField(n, DoubleType()) for n in ("precision", "recall", "f1")]])
    found = kept.mapInArrow(run, schema)
    names = [c for c in pairs.columns if c not in (candidate, reference, out)]
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], F.struct("precision", "recall", "f1").alias(out))
