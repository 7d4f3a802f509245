"""Token ids in a compressed binary format that decodes in parallel.

Texts are tokenised where they lie and kept as packed ids, with each task's counts
of ids; the counts give one static frequency table for the whole corpus (at most
one entry for each id of the vocabulary, which bounds what the driver holds). The
packed ids are then dealt by ranges of doc_id, and blocks of whole documents are
coded independently (see ``rans``) in ascending order of doc_id.

A folder of token files needs nothing else to be read:

    about/         one row: version, tokenizer (file name), end_id, vocabulary, block_tokens
    frequencies/   id, count: the table that all blocks share
    parts/         part, base (tokens before the part), n_tokens
    blocks/part=N/ start (in the part), n_tokens, doc_ids, lengths, block

Any block decodes alone; inside a block, checkpoints let a reader start near the
tokens it wants (:func:`read_tokens`).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import discard, materialize, release, scratch_path, table, text_batches, text_or_empty, worker_cache
from .word_tokenizer import WordTokenizer, default_path

BLOCK_TOKENS = 1 << 19
VERSION = 2
_BLOCKS = "part int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, block binary"


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _binary(flat: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Pieces of an array as binary values, without copying each."""
    offsets = (np.concatenate([[0], stops]) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def tokenised(docs: DataFrame, path: str, size: int, end_id: int = 1) -> DataFrame:
    """doc_id, h (hash of the text), n_tokens, ids (packed u16, or u32 for large vocabularies), counts.

    The last row of a task has no n_tokens; its counts (id and number of each id
    that the task saw) are those of the rows before it.
    """
    kind = _kind(size)
    pairs = np.dtype([("id", "<u4"), ("n", "<u8")])
    names = ["doc_id", "h", "n_tokens", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = worker_cache((path, end_id), lambda: WordTokenizer(path, end_id))
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for first, ids, counts in tk.encode(batch.column(1).to_pylist()):
                n = len(counts)
                total += np.bincount(ids, minlength=size)
                columns = [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(counts.astype(np.int64)), _binary(ids.astype(kind), np.cumsum(counts)), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        seen = np.flatnonzero(total)
        own = np.empty(len(seen), dtype=pairs)
        own["id"], own["n"] = seen, total[seen]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([own.tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, n_tokens long, ids binary, counts binary")


def id_counts(spool: DataFrame) -> DataFrame:
    """id, count over the whole corpus; a task sends at most one row for each id."""
    pairs = np.dtype([("id", "<u4"), ("n", "<u8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = np.frombuffer(blob, pairs)
                for i, n in zip(own["id"].tolist(), own["n"].tolist()):
                    sums[i] = sums.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["id", "count"])

    rows = spool.where("n_tokens is null").select("counts").mapInArrow(run, "id int, count long")
    return rows.groupBy("id").agg(F.sum("count").alias("count"))


def frequency_table(counts: DataFrame, size: int) -> rans.Table:
    out = np.zeros(size, dtype=np.int64)
    for r in counts.collect():  # bounded by the vocabulary
        out[r.id] = r["count"]
    return rans.Table(out)


def write_blocks(spool: DataFrame, freq: rans.Table, size: int, path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Blocks of whole documents in ascending order of (doc_id, hash of the text), null first, under part=N folders."""
    kind = _kind(size)
    shared = spool.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size_held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held]).astype(np.uint32)
            doc_ids, lengths = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            offsets = pa.array([0, len(doc_ids)], pa.int32())
            columns = [
                pa.array([part], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.ListArray.from_arrays(offsets, doc_ids),
                pa.ListArray.from_arrays(offsets, pa.array(lengths)),
                pa.array([rans.encode(ids, shared.value)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "start", "n_tokens", "doc_ids", "lengths", "block"])

        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            col = batch.column(2)
            lo = np.frombuffer(col.buffers()[1], "<i4")[col.offset] // kind.itemsize
            flat = np.frombuffer(col.buffers()[2], kind, int(n.sum()), int(lo) * kind.itemsize)
            stop = np.cumsum(n)
            a = 0
            while a < len(n):
                # As many documents as fill the block.
                done = int(stop[a - 1]) if a else 0
                b = min(len(n), int(np.searchsorted(stop, done + block_tokens - size_held)) + 1)
                held.append((batch.column(0).slice(a, b - a), n[a:b], flat[done : int(stop[b - 1])].copy()))
                size_held += int(stop[b - 1]) - done
                a = b
                if size_held >= block_tokens:
                    yield flush()
                    start, held, size_held = start + size_held, [], 0
        if held:
            yield flush()

    # The text's hash splits one doc_id that repeats very often, and orders its rows.
    rows = spool.where("n_tokens is not null").select("doc_id", "n_tokens", "ids", "h")
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "n_tokens", "ids")
    dealt.mapInArrow(run, _BLOCKS).write.partitionBy("part").option("compression", "uncompressed").parquet(path)


def write_corpus(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenise every text and write the token files to the folder ``out``."""
    spark, path = docs.sparkSession, path or default_path()
    text_batches(spark)
    size = WordTokenizer(path, end_id).size
    spool = materialize(tokenised(docs, path, size, end_id), "token-spool", compression="zstd")
    id_counts(spool).write.parquet(f"{out}/frequencies")
    freq = frequency_table(spark.read.schema("id int, count long").parquet(f"{out}/frequencies"), size)
    write_blocks(spool, freq, size, f"{out}/blocks", block_tokens)
    release(spark)
    discard(spool)
    totals = _blocks(spark, out).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part
    rows, at = [], 0
    for r in totals:
        rows.append((r.part, at, r.n))
        at += r.n
    spark.createDataFrame(rows, "part int, base long, n_tokens long").write.parquet(f"{out}/parts")
    about = [(VERSION, os.path.basename(path), end_id, size, block_tokens)]
    spark.createDataFrame(about, "version int, tokenizer string, end_id int, vocabulary int, block_tokens long").coalesce(1).write.parquet(f"{out}/about")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def _opened(spark: SparkSession, folder: str) -> tuple[rans.Table, DataFrame]:
    """The frequency table and the blocks with their part's base, from the folder alone."""
    about = spark.read.parquet(f"{folder}/about").first()
    if about.version != VERSION:
        raise ValueError(f"token files of version {about.version}")
    freq = frequency_table(spark.read.schema("id int, count long").parquet(f"{folder}/frequencies"), about.vocabulary)
    parts = spark.read.schema("part int, base long, n_tokens long").parquet(f"{folder}/parts").select("part", "base")
    return freq, _blocks(spark, folder).join(parts, "part").withColumn("start", F.col("base") + F.col("start"))


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of every document, read from the token files alone."""
    text_batches(spark)
    freq, blocks = _opened(spark, folder)
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, block = (batch.column(k)[i] for k in range(4))
                ids = rans.decode(block.as_buffer(), shared.value).astype("<u4", copy=False)
                n = lengths.values.to_numpy()
                stop = np.cumsum(n)
                spans = list(zip((stop - n).tolist(), stop.tolist()))
                cols = [doc_ids.values, pa.array(start.as_py() + stop - n), pa.array(n), pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("start", "doc_ids", "lengths", "block").mapInArrow(run, kind)


def read_tokens(spark: SparkSession, folder: str, first: int, stop: int) -> DataFrame:
    """start, ids: the tokens of the corpus from ``first`` up to ``stop`` in pieces, one for each checkpoint that holds some.

    Only blocks that overlap are decoded, each from the last checkpoint before the
    tokens that are wanted up to the first one behind them.
    """
    text_batches(spark)
    freq, blocks = _opened(spark, folder)
    shared = spark.sparkContext.broadcast(freq)
    near = blocks.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first)).select("start", "n_tokens", "block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, block in zip(batch.column(0).to_pylist(), batch.column(2)):
                for k, (a, b) in enumerate(rans.checkpoints(block.as_buffer())):
                    lo, hi = max(first, start + a), min(stop, start + b)
                    if lo < hi:
                        ids = rans.decode(block.as_buffer(), shared.value, k)[lo - start - a : hi - start - a]
                        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["start", "ids"])

    return near.mapInArrow(cut, "start long, ids array<long>")


def encode_corpus(docs: DataFrame, path: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False, out: str | None = None) -> DataFrame:
    """Write the token files (to the folder ``out``, or a new one in the shared folder) and return one row per document, read back from them.

    doc_id, start, n_tokens, ids_crc32 (and ids). Null text counts as empty (only
    the end id). A null doc_id sorts first; rows that repeat a doc_id are
    documents of their own, in an order given by their texts. Other columns play
    no part; an empty table gives an empty result. A block holds whole documents,
    so a document's length bounds its task's memory.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "token-files")
    write_corpus(docs, out, path, end_id, block_tokens)
    return read_corpus(spark, out, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, start, n_tokens, ids_crc32 of every document."""
    return encode_corpus(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
