"""Exact deduplication by a log-structured merge index of text digests.

Every input task is a memtable: its digests are sorted and flushed as one
immutable run (a Parquet file whose footer carries the digest range and a Bloom
filter). Compaction merges all runs into the next level: one row for each digest
with the identifier of the row that stays and the number of rows, in files of
ranges that don't overlap, each sorted and with a filter too. A point lookup reads
only row groups whose range and filter may hold the digest.

A hit - a digest with more than one row - is only believed after the bytes of its
rows were compared: the least and the greatest text of each hit's rows must be the
same. That is an aggregation with map-side combine over rows that have a hit, so
a digest of a third of all rows is a few texts from each task. Rows of a digest that
fails (a collision) are grouped by their bytes instead.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, same, scratch_path, table, text_or_empty


def squeeze(text: Column) -> Column:
    """The text without its ASCII white space."""
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def sha256_hex(normal: Column) -> Column:
    return F.sha2(normal, 256)


class DigestIndex:
    """Sorted digest runs, and the levels they are merged into, in the shared folder.

    ``flush`` adds the rows of a DataFrame as runs, ``compact`` merges what there is
    into the next level, ``level`` is the last one, and ``lookup`` finds the keepers
    of some digests.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.levels = spark, path or scratch_path(spark, "digest-index"), 0

    def _write(self, rows: DataFrame, *order, to: str) -> None:
        rows.sortWithinPartitions(*order).write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").parquet(f"{self.path}/{to}")

    def flush(self, hashed: DataFrame) -> None:
        """Columns doc_id, digest, n_cp; one sorted run for each task."""
        self._write(hashed.select("doc_id", "digest", "n_cp"), "digest", F.desc("n_cp"), "doc_id", to="runs")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs")

    def compact(self) -> DataFrame:
        """Merge all runs: digest, keep_id, keep_n, group_size; most code points, then smallest id.

        Partial aggregation shrinks every run before the shuffle, so a digest
        that holds a third of all rows costs one row for each run.
        """
        rank = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id")
        merged = (
            self.runs()
            .groupBy("digest")
            .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"), "group_size")
        )
        self.levels += 1
        self._write(merged.repartitionByRange("digest"), "digest", to=f"level={self.levels}")
        return self.level()

    def level(self) -> DataFrame:
        return self.spark.read.schema("digest string, keep_id long, keep_n long, group_size long").parquet(f"{self.path}/level={self.levels}")

    def lookup(self, digests: list[str]) -> DataFrame:
        """The level's rows of some digests, given one by one: ranges and filters skip what can't hold them."""
        wanted = F.lit(False)
        for d in digests:
            wanted = wanted | (F.col("digest") == d)
        return self.level().where(wanted)


def collided(hashed: DataFrame, level: DataFrame) -> DataFrame:
    """Digests of which not all rows have the same bytes."""
    hits = level.where("group_size > 1").select("digest")
    rows = hashed.select("digest", "normal").join(hits, "digest", "left_semi")
    return rows.groupBy("digest").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).where("lo <> hi").select("digest")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical without ASCII white space; of equal texts
    the row with the most code points, then the smallest doc_id, stays (a null
    doc_id comes last). Null counts as empty; empty texts are equal to each
    other. Of rows that repeat both doc_id and text exactly one is kept. Other
    columns of ``docs`` play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_cp"), squeeze(text).alias("normal"))
    hashed = hashed.select("doc_id", "n_cp", "normal", digest(F.col("normal")).alias("digest"))
    lsm = DigestIndex(spark)
    lsm.flush(hashed)
    index = lsm.compact()
    bad = materialize(collided(hashed, index), "digest-collisions")
    rows = lsm.runs()
    if bad.isEmpty():
        return _decide(rows, index, ["digest"])
    # Bytes decide where a digest can't.
    told = hashed.join(bad, "digest", "left_semi").select("doc_id", "n_cp", "digest", "normal")
    rank = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id")
    by_bytes = (
        told.groupBy("digest", "normal")
        .agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "normal", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"), "group_size")
    )
    good = _decide(rows.join(bad, "digest", "left_anti"), index, ["digest"])
    return good.unionByName(_decide(told.select("doc_id", "n_cp", "digest", "normal"), by_bytes, ["digest", "normal"]))


def _decide(rows: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Rows that repeat doc_id and text count as one entry with a multiplicity."""
    entries = rows.groupBy(*key, "doc_id", "n_cp").agg(F.count(F.lit(1)).alias("m"))
    joined = entries.join(index, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    stays = same(F.col("doc_id"), F.col("keep_id")) & (F.col("n_cp") == F.col("keep_n")) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: see the contract in :func:`exact_dedup`."""
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("digest", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)
"""
