"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs on one machine (tests) a
    temporary folder is made and set; a cluster has to name its folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lucidreq-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lucidreq/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None, group_rows: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    Readers take thousands of rows of a row group at once; ``group_rows`` and ``group_bytes`` (as stored) make the groups smaller where rows are long.
    """
    path = scratch_path(df.sparkSession, name)
    options = {"compression": compression, "parquet.block.row.count.limit": group_rows, "parquet.block.size": group_bytes}
    df.write.options(**{k: v for k, v in options.items() if v}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables written by :func:`materialize` that no plan reads any more."""
    for df in dfs:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
