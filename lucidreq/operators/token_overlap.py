"""Best reference of each requirement by token matching, where many references share an id with many requirements.

``consistency.token_match`` scores a pair in its row, so an id with m requirements and n references
costs m * n rows of both texts. Here both sides of an id are dealt to parts of PART bytes of text; a part of
the one with a part of the other is a task's tile. Rows are packed before they are sent: those of a part become records with a list of
tokens, each once, and how often every row has which. The task holds the references' tokens as numbers of its own and reads the
requirements as a stream. How many tokens of the one the other holds is a product of two sparse matrices: the most
frequent tokens are multiplied as dense columns, the others by their lists of references. A tile gives
each requirement's best reference and those that rounding may put beside it, so no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

#: Bytes of text that a part of a side holds, and what a row counts beside its text; bytes of tokens that a task packs at once.
PART, ROW, PACK = 32 << 20, 2048, 64 << 20
#: Tokens that are dense columns; scores of a step.
DENSE, STEP = 512, 1 << 18
#: Scores nearer to the best than this may be equal to it at twelve decimals.
NEAR = 2e-12


def _counted(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of the distinct codes of each row, ordered by row and code; codes below 0 don't count."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = codes >= 0
    key, count = np.unique(row[ok] * max(width, 1) + codes[ok], return_counts=True)
    return key // max(width, 1), key % max(width, 1), count


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of an array column one after the other, and how many each row has; null has none."""
    return column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _narrow(numbers: np.ndarray) -> pa.Array:
    """Whole numbers in the narrowest type; an Arrow stream says which."""
    return pa.array(numbers.astype(np.min_scalar_type(numbers.max(initial=0))))


def _pack(rows: pa.Table) -> bytes:
    """Rows of a part (place, title, tokens) as an Arrow stream of one row.

    Tokens are numbered from the one that most rows have; a row's distinct ones are ascending numbers, each as what it is
    above the one before, with how often the row has it.
    """
    values, sizes = _lists(rows.column(2).combine_chunks())
    coded = values.dictionary_encode()
    row, code, count = _counted(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), sizes, len(coded.dictionary))
    by = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    code = rank[code]
    order = np.lexsort((code, row))
    code, count = code[order], count[order]  # rows stay in order
    above = code.copy()
    above[1:] -= np.where(np.diff(row) == 0, code[:-1], 0)
    words = coded.dictionary.take(pa.array(by))
    letters = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    each = np.bincount(row, minlength=len(sizes))
    lists = {"place": rows.column(0).combine_chunks(), "title": rows.column(1).combine_chunks(), **{k: _narrow(v) for k, v in (("size", sizes), ("distinct", each), ("above", above), ("count", count), ("letters", letters))}}
    columns = [*(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists.values()), pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b"")]
    batch = pa.RecordBatch.from_arrays(columns, names=[*lists, "words"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class Pack:
    """Rows as :func:`_pack` packed them: ``row``, ``code`` (a place in ``words``) and ``count`` of the tokens, by row."""

    def __init__(self, data: pa.Buffer):
        batch = pa.ipc.open_stream(data).read_next_batch()
        self.place, self.title = (batch.column(k).flatten() for k in ("place", "title"))
        self.sizes, each, above, self.count, letters = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in ("size", "distinct", "above", "count", "letters"))
        self.ends = np.concatenate([[0], np.cumsum(each)])
        self.row = np.repeat(np.arange(len(each)), each)
        # Sums of a row are those up to it less.
        total = np.concatenate([[0], np.cumsum(above)])
        self.code = total[1:] - total[self.ends[:-1]][self.row]
        ends = np.concatenate([[0], np.cumsum(letters)]).astype(np.int32)
        self.words = pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), batch.column("words")[0].as_buffer())


class References:
    """The references of a tile in the order of their places."""

    def __init__(self, packs: list[Pack], dense: int = DENSE):
        places = pa.concat_arrays([p.place for p in packs])
        order = pc.sort_indices(places).to_numpy()
        self.pos = places.take(pa.array(order))
        self.sizes = np.concatenate([p.sizes for p in packs])[order]
        n = len(order)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        words = pa.concat_arrays([p.words for p in packs]).dictionary_encode()
        self.vocabulary, number = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = lambda lengths: np.cumsum([0, *lengths[:-1]])
        row = rank[np.concatenate([p.row + s for p, s in zip(packs, starts([len(p.sizes) for p in packs]), strict=True)])]
        code = number[np.concatenate([p.code + s for p, s in zip(packs, starts([len(p.words) for p in packs]), strict=True)])]
        count, width = np.concatenate([p.count for p in packs]), len(self.vocabulary)
        often = np.bincount(code, minlength=width)
        columns = np.argsort(-often, kind="stable")[:dense]
        self.column = np.full(width, -1)
        self.column[columns] = np.arange(len(columns))
        # Whole numbers up to 2^24 are exact in single precision.
        self.kind = np.float32 if self.sizes.max(initial=0) < 1 << 24 else np.float64
        self.count = np.zeros((n, len(columns)), self.kind)
        here = self.column[code] >= 0
        self.count[row[here], self.column[code[here]]] = count[here]
        self.there = (self.count > 0).astype(self.kind)
        by = np.argsort(code[~here], kind="stable")
        self.listed, self.times = row[~here][by], count[~here][by]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code[~here], minlength=width))])

    def codes(self, words: pa.Array) -> np.ndarray:
        """Each word's number here, -1 if no reference holds it."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        return pc.index_in(words, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def hits(self, row: np.ndarray, code: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of some requirements with each reference: tokens that the reference holds, and the reference's that it holds."""
        m, n = len(sizes), len(self.sizes)
        row, code, count = (x[code >= 0] for x in (row, code, count))
        here = self.column[code] >= 0 if len(code) else np.zeros(0, bool)
        kind = self.kind if sizes.max(initial=0) < 1 << 24 else np.float64
        own = np.zeros((m, self.count.shape[1]), kind)
        own[row[here], self.column[code[here]]] = count[here]
        mine, theirs = own @ self.there.T, (own > 0).astype(kind) @ self.count.T
        row, code, count = row[~here], code[~here], count[~here]
        length = self.ends[code + 1] - self.ends[code]
        at = np.arange(length.sum()) + np.repeat(self.ends[code] - (np.cumsum(length) - length), length)
        cell = np.repeat(row * n, length) + self.listed[at]
        add = lambda weight: np.bincount(cell, weight, minlength=m * n).reshape(m, n)
        return mine + add(np.repeat(count, length)), theirs + add(self.times[at])

    def best(self, own: Pack) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Requirement (its row), reference, precision, recall and f1 of each requirement's best references, the first of equal ones."""
        code = self.codes(own.words)[own.code]
        step = max(1, STEP // max(1, len(self.sizes)))
        for lo in range(0, len(own.sizes), step):
            sizes = own.sizes[lo : lo + step]
            some = slice(own.ends[lo], own.ends[lo + len(sizes)])
            mine, theirs = self.hits(own.row[some] - lo, code[some], own.count[some], sizes)
            p, r = mine / np.maximum(sizes, 1)[:, None], theirs / np.maximum(self.sizes, 1)[None, :]
            f = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1.0), 0.0)
            x, y = np.nonzero(f >= f.max(axis=1, keepdims=True) - NEAR)
            order = np.lexsort((f[x, y], x))  # stable, so the first place of equal scores comes first
            x, y = x[order], y[order]
            first = np.ones(len(x), bool)
            first[1:] = (np.diff(x) != 0) | (f[x[1:], y[1:]] != f[x[:-1], y[:-1]])
            x, y = x[first], y[first]
            yield x + lo, y, p[x, y], r[x, y], f[x, y]


def _packed(rows: DataFrame) -> DataFrame:
    """id, part, others, pack: the rows (id, part, others, place, title, tokens) of each part in records, as many as tasks fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = [], 0

        def records() -> Iterator[pa.RecordBatch]:
            nonlocal filled
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()  # copied
            filled = 0
            ids = table.column(0).combine_chunks().dictionary_encode()
            id_of, part = ids.indices.to_numpy(), table.column(1).to_numpy()
            order = np.lexsort((part, id_of))
            table = table.take(pa.array(order))
            cuts = [0, *(np.flatnonzero((np.diff(id_of[order]) != 0) | (np.diff(part[order]) != 0)) + 1).tolist(), len(order)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                some = table.slice(i, j - i)
                first = [some.column(k).combine_chunks().slice(0, 1) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*first, pa.array([_pack(some.select([3, 4, 5]))], pa.binary())], names=["id", "part", "others", "pack"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                filled += batch.nbytes
            if filled > PACK:
                yield from records()
        if held:
            yield from records()

    kind = StructType([*[rows.schema[c] for c in ("id", "part", "others")], StructField("pack", BinaryType())])
    return rows.mapInArrow(run, kind)


def best_overlaps(requirements: DataFrame, references: DataFrame, part: int = PART, dense: int = DENSE) -> DataFrame:
    """pos, id, title, ref_pos and s (precision, recall, f1): each requirement's best references by tokens with its id, one or a few.

    requirements: pos, id, title, text, tokens; references: ref_pos, id, text, tokens. Null ids meet nothing. The last choice
    (by f1 at twelve decimals, then place) is the caller's.
    """
    size = lambda df, k: df.where("id is not null").select("id", *[(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW if i == k else F.lit(0)).cast("long").alias(c) for i, c in enumerate(("q", "r"))])
    parts = size(requirements, 0).unionByName(size(references, 1)).groupBy("id").agg(*[F.greatest(F.lit(1), F.ceil(F.sum(c) / part)).cast("int").alias(c) for c in ("q", "r")])
    # Ids of several parts: no more of them than parts.
    large = F.broadcast(parts.where("q > 1 or r > 1"))
    split = lambda df: df.where("id is not null").join(large, "id", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("q", "r")})
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    tokens = F.col("tokens").cast("array<string>").alias("tokens")
    held = _packed(split(references).select("id", dealt("ref_pos", "r").alias("part"), F.col("q").alias("others"), F.col("ref_pos").alias("place"), F.lit(None).cast("string").alias("title"), tokens))
    own = _packed(split(requirements).select("id", dealt("pos", "q").alias("part"), F.col("r").alias("others"), F.col("pos").alias("place"), "title", tokens))
    each = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    held = held.select("id", each.alias("i"), F.col("part").alias("j"), F.lit(0).alias("role"), "pack")
    own = own.select("id", F.col("part").alias("i"), each.alias("j"), F.lit(1).alias("role"), "pack")
    rows = held.unionByName(own)
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(count, "id", "i", "j").sortWithinPartitions("id", "i", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, here = None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                tile, role = tuple(batch.column(k)[at].as_py() for k in range(3)), batch.column(3)[at].as_py()
                if tile != now:
                    now, packs, here = tile, [], None
                if role == 1 and here is None and not packs:
                    continue
                pack = Pack(batch.column(4)[at].as_buffer())
                if role == 0:
                    packs.append(pack)
                    continue
                if here is None:
                    here, packs = References(packs, dense), []
                for x, y, *scores in here.best(pack):
                    rows = pa.array(x)
                    ids = batch.column(0).take(pa.array(np.full(len(x), at)))
                    yield pa.RecordBatch.from_arrays([pack.place.take(rows), ids, pack.title.take(rows), here.pos.take(pa.array(y)), *map(pa.array, scores)], names=["pos", "id", "title", "ref_pos", "precision", "recall", "f1"])

    of = {"pos": requirements, "id": rows, "title": requirements, "ref_pos": references}
    kind = StructType([*[of[c].schema[c] for c in of], *[StructField(c, DoubleType()) for c in ("precision", "recall", "f1")]])
    return rows.mapInArrow(run, kind).select("pos", "id", "title", "ref_pos", F.struct("precision", "recall", "f1").alias("s"))
