"""Shared helpers: reading tables, texts and keys, batch sizes; tables in the shared folder come from ``storage``."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch_path, shared_dir  # noqa: F401

#: The six ASCII white-space characters U+0020, U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch: Spark bounds batches by rows only, so those that hold whole texts are small.
TEXT_ROWS, NUMBER_ROWS = 256, 20_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def same(a: Column, b: Column) -> Column:
    """Null-safe equality, which Spark still uses as a hash key."""
    return a.eqNullSafe(b)


def text_batches(spark: SparkSession) -> None:
    """From now on this session's batches are small enough for whole texts (results that are planned later too)."""
    if int(spark.conf.get(_BATCH, "10000")) != TEXT_ROWS:
        spark.conf.set(_BATCH, TEXT_ROWS)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, changed where the table has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def number_batches(spark: SparkSession) -> Iterator[None]:
    """Larger batches for steps whose rows are a few numbers each."""
    before = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, NUMBER_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_held: list = [None, None]


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """One object for a worker's lifetime, shared by its tasks until another operator asks for its own."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


def drop_worker_cache() -> None:
    """Called where a task begins that has no use for what an earlier operator left in its worker."""
    worker_cache(None, lambda: None)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done."""
    gc.collect()
    spark._jvm.System.gc()
