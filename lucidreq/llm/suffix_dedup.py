"""Repeated passages by longest-previous-factor arrays.

A window is a byte string of ``min_bytes`` (400). Sorting all windows of a corpus
would move hundreds of bytes for each byte, so windows are first gathered by
content-defined anchors: in each window the ``GRAM``-byte gram of least hash.
Equal windows have equal anchors at the same place, and neighbouring windows
share one, so about one anchor for 150 bytes stands for all windows. Anchors
whose gram occurs once hold no repeated window. Of the rest:

* anchors with the same context (all bytes of their windows) are one class; in a
  class of two or more, every window is repeated, without comparing anything;
* one representative of each class goes, with the other classes of its gram, to a
  suffix array over their windows: in suffix order, previous and next smaller
  positions give each window's longest previous factor, and in the mirrored order
  of positions its longest following one. A window with a previous factor of
  ``min_bytes`` has an earlier occurrence, one with either has any other.

Contexts are the same class when the 64-bit hashes of their anchor and of all their
bytes are: 128 bits together.

A gram with more than ``HOT_CLASSES`` classes (a common passage in changing
surroundings) isn't gathered in a task: its windows are counted by their 128-bit
digests in an aggregation with map-side combine instead. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, same, table, text_batches, text_or_empty
from .shingles import _BASE, _INVERSE, _power, mix

MIN_BYTES = 400
GRAM = 96
HOT_CLASSES = 2000
#: Classes that one task sorts together, about.
BUCKET_CLASSES = 8000
PIECE_BYTES = 2 << 20


def find_anchors(data: np.ndarray, bounds: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first and last start of the windows it stands for, gram hash) over texts laid end to end.

    ``bounds`` holds each text's begin and the end of the last one.
    """
    width = min_bytes - gram + 1
    n = len(data) - gram + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    full = mix((total[gram:] - total[:n]) * _power(_INVERSE, n))
    # The high half of the hash, then the place: ties go to the leftmost gram.
    key = (full >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - min_bytes + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)
    valid = np.zeros(starts + 1, dtype=np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= min_bytes:
            valid[a] += 1
            valid[b - min_bytes + 1] -= 1
    ok = np.flatnonzero(np.cumsum(valid[:-1]))
    at = least[ok].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(ok) != 1)])) if len(ok) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(ok)]])[: len(new)] - 1
    return at[new], ok[new], ok[last], full[at[new]]


def anchors(docs: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """doc_id, th (hash of the text), lo, hi (starts of the windows), gram, ctx (hash of all their bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                # A long text goes in pieces that share min_bytes - 1 bytes, so each window is in one.
                for a in range(0, max(1, len(raw) - min_bytes + 1), PIECE_BYTES):
                    piece = raw[a : a + PIECE_BYTES + min_bytes - 1]
                    if len(piece) >= min_bytes:
                        held.append((i, a, piece))
                        size += len(piece)
                    if size >= PIECE_BYTES:
                        yield found(batch, held)
                        held, size = [], 0
            if held:
                yield found(batch, held)

    def found(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        buffer = b"".join(x[2] for x in held)
        bounds = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])
        at, lo, hi, full = find_anchors(np.frombuffer(buffer, np.uint8), bounds, min_bytes, gram)
        digest = xxhash.xxh3_64_intdigest
        ctx = np.array([digest(buffer[a : b + min_bytes], s) for a, b, s in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())], dtype=np.uint64)
        piece = np.searchsorted(bounds, lo, side="right") - 1
        shift = np.array([x[1] for x in held], dtype=np.int64)[piece] - bounds[piece]
        own = pa.array(np.array([x[0] for x in held], dtype=np.int64)[piece])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(own), batch.column(1).take(own), pa.array(lo + shift), pa.array(hi + shift), pa.array(full.view(np.int64)), pa.array(ctx.view(np.int64))],
            names=["doc_id", "th", "lo", "hi", "gram", "ctx"],
        )

    rows = _rows(docs).where(F.octet_length("text") >= min_bytes)
    return rows.mapInArrow(run, "doc_id long, th long, lo long, hi long, gram long, ctx long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


# ---------------------------------------------------------------- suffix arrays


def longest_previous(position: list, lcp: list[int]) -> list[int]:
    """Longest previous factor of each suffix, in suffix order.

    ``position`` holds the suffixes' places in the corpus, ``lcp[i]`` the common
    prefix of suffix i with the one before it. The nearest suffix before and
    after with a smaller position, found with one stack, gives the longest match
    that starts earlier.
    """
    n = len(position)
    out = [0] * n
    stack: list[list[int]] = []  # suffix, common prefix with the smaller one below it in the stack
    for i in range(n + 1):
        common = lcp[i] if i < n else 0
        while stack and (i == n or position[stack[-1][0]] > position[i]):
            j, left = stack.pop()
            # left: match with its previous smaller position; common: with its next smaller one.
            out[j] = max(left, common if i < n else 0)
            common = min(common, left)
        if i < n:
            stack.append([i, common if stack else 0])
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    """Equal leading bytes of two strings of one length."""
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def repeated_windows(classes: list[tuple[bytes, int, tuple]], min_bytes: int, both: bool = True) -> list[tuple[list, list]]:
    """For classes of one gram - (context, size, place of its first window) - the repeated windows of each.

    Returns, for each class, the runs of offsets with an earlier occurrence, and
    with any other occurrence outside the class: a longest previous factor, or, in
    the mirrored order of places, a longest following one, of ``min_bytes``.
    Without ``both`` the following ones aren't computed.
    """
    windows = [(ctx[o : o + min_bytes], k, o) for k, (ctx, _, _) in enumerate(classes) for o in range(len(ctx) - min_bytes + 1)]
    windows.sort(key=lambda w: w[0])
    # Suffixes are compared up to min_bytes.
    lcp = [0] + [common_prefix(a[0], b[0]) for a, b in zip(windows, windows[1:])]
    flags: list[tuple[set, set]] = [(set(), set()) for _ in classes]
    if max(lcp, default=0) < min_bytes:
        return [([], []) for _ in classes]  # no factor is as long
    # A window is in one context, so contexts in order of place, and their windows in turn, are all windows in order.
    base, at = [0] * len(classes), 0
    for k in sorted(range(len(classes)), key=lambda k: classes[k][2]):
        base[k], at = at, at + len(classes[k][0])
    place = [base[k] + o for _, k, o in windows]
    previous = longest_previous(place, lcp)
    following = longest_previous([-p for p in place], lcp) if both else previous
    for (_, k, o), before, after in zip(windows, previous, following):
        if before >= min_bytes:
            flags[k][0].add(o)
        if before >= min_bytes or after >= min_bytes:
            flags[k][1].add(o)
    return [(_runs(a), _runs(b)) for a, b in flags]


def _runs(offsets: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for o in sorted(offsets):
        if out and out[-1][1] == o - 1:
            out[-1] = (out[-1][0], o)
        else:
            out.append((o, o))
    return out


# ---------------------------------------------------------------- plans


def duplicate_windows(docs: DataFrame, keep: str = "none", min_bytes: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT_CLASSES) -> DataFrame:
    """doc_id, th, lo, hi: runs of starts of the windows to remove.

    keep="none": every window that occurs anywhere else; keep="first": those
    with an earlier occurrence in the order of (doc_id, text hash, place).
    """
    found = materialize(anchors(docs, min_bytes, gram), "anchors")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th", "lo")
    classes = found.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"), F.max(F.col("hi") - F.col("lo")).alias("span"))
    classes = materialize(classes, "classes")
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = materialize(several, "grams")
    # Classes of two or more: each window is repeated (and all but the first occurrence have an earlier one).
    big = classes.where("size > 1").select("gram", "ctx", "first")
    members = found.join(big, ["gram", "ctx"])
    if keep == "first":
        members = members.where(~(same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("lo") == F.col("first.lo"))))
    copies = members.select("doc_id", "th", "lo", "hi")
    # One representative of each class of a gram with several.
    chosen = classes.join(several, "gram").select("gram", "ctx", "size", "span", "kinds", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.col("first.lo").alias("lo"))
    with_text = materialize(_contexts(docs, materialize(chosen, "chosen"), min_bytes), "contexts")
    ordinary = _by_suffix_order(with_text.where(F.col("kinds") <= hot), keep, min_bytes)
    common = _by_digest(with_text.where(F.col("kinds") > hot), keep, min_bytes)
    return copies.unionByName(ordinary).unionByName(common)


def _contexts(docs: DataFrame, chosen: DataFrame, min_bytes: int) -> DataFrame:
    """Adds the bytes of each representative's windows."""
    per_doc = chosen.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "ctx", "size", "span", "kinds", "lo")).alias("c"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "c")
    joined = _rows(docs).join(per_doc, same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, th, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    values = (doc_id, th, w["lo"], w["gram"], w["ctx"], w["size"], w["kinds"], raw[w["lo"] : w["lo"] + w["span"] + min_bytes])
                    for col, v in zip(out, values):
                        col.append(v)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "th", "lo", "gram", "ctx", "size", "kinds", "bytes"])

    return joined.select("doc_id", "th", "text", "c").mapInArrow(run, "doc_id long, th long, lo long, gram long, ctx long, size long, kinds long, bytes binary")


def _by_suffix_order(contexts: DataFrame, keep: str, min_bytes: int) -> DataFrame:
    buckets = max(1, -(-contexts.count() // BUCKET_CLASSES))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("gram", "ctx", "doc_id", "th", "lo", "size", "bytes"))), key=lambda r: r[:2])
        out: list[list] = [[], [], [], []]
        a = 0
        while a < len(rows):
            b = a
            own: dict[int, tuple] = {}
            while b < len(rows) and rows[b][0] == rows[a][0]:
                own.setdefault(rows[b][1], rows[b])  # a row of documents that repeats is one class still
                b += 1
            own_rows = list(own.values())
            flags = repeated_windows([(r[6], r[5], (r[2] is None, r[2] or 0, r[3], r[4])) for r in own_rows], min_bytes, keep == "none")
            for r, (earlier, other) in zip(own_rows, flags):
                if keep == "none" and r[5] > 1:
                    continue  # removed as copies already
                for x, y in earlier if keep == "first" else other:
                    for col, v in zip(out, (r[2], r[3], r[4] + x, r[4] + y)):
                        col.append(v)
            a = b
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["doc_id", "th", "lo", "hi"])

    dealt = contexts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "doc_id long, th long, lo long, hi long")


def _by_digest(contexts: DataFrame, keep: str, min_bytes: int) -> DataFrame:
    """Windows of hot grams, counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, th, lo, gram, size, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                n = len(raw) - min_bytes + 1
                d = [xxhash.xxh3_128_intdigest(raw[o : o + min_bytes]) for o in range(n)]
                halves = np.array([(x >> 64, x & (1 << 64) - 1) for x in d], dtype=np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array(np.full(n, th)),
                        pa.array(np.arange(lo, lo + n)),
                        pa.array(np.full(n, gram)),
                        pa.array(np.full(n, size)),
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                    ],
                    names=["doc_id", "th", "lo", "gram", "size", "w1", "w2"],
                )

    # A row of documents that repeats would count its own windows twice.
    rows = contexts.select("doc_id", "th", "lo", "gram", "ctx", "size", "bytes").dropDuplicates(["gram", "ctx"]).select("doc_id", "th", "lo", "gram", "size", "bytes")
    windows = materialize(rows.mapInArrow(run, "doc_id long, th long, lo long, gram long, size long, w1 long, w2 long"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th", "lo")
    key = ["gram", "w1", "w2"]
    counted = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    hit = windows.join(counted, key)
    if keep == "first":
        hit = hit.where(~(same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("lo") == F.col("first.lo"))))
    else:
        hit = hit.where("size = 1")
    return hit.select("doc_id", "th", "lo", F.col("lo").alias("hi"))


def remove_repeats(docs: DataFrame, keep: str = "first", min_bytes: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT_CLASSES) -> DataFrame:
    """One row per input row: doc_id, spans (begin, end in bytes), kept (the other bytes), n_bytes, n_removed.

    Texts are UTF-8 bytes, null is empty; matches never cross documents; texts
    of fewer than ``min_bytes`` bytes lose nothing. keep="none" removes every
    byte covered by a string of ``min_bytes`` that starts anywhere else,
    keep="first" only those with an earlier occurrence. Rows that repeat doc_id
    and text are copies of each other for "none" and one document for "first".
    Other columns of ``docs`` play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    runs = duplicate_windows(docs, keep, min_bytes, gram, hot)
    runs = materialize(runs, "runs")
    release(spark)
    spans = runs.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "runs")
    joined = _rows(docs).join(spans, same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for r in sorted(runs or [], key=lambda r: r["lo"]):
                    if merged and r["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["hi"] + min_bytes)
                    else:
                        merged.append([r["lo"], r["hi"] + min_bytes])
                cuts = [0, *(x for m in merged for x in m), len(raw)]
                spans.append([{"begin": a, "end": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                sizes.append(len(raw))
            removed = [n - len(k) for n, k in zip(sizes, kept)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())],
                names=["doc_id", "spans", "kept", "n_bytes", "n_removed"],
            )

    return joined.mapInArrow(run, "doc_id long, spans array<struct<begin:long,end:long>>, kept binary, n_bytes long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, all copies removed."""
    out = remove_repeats(table(spark, sf_dir, "documents"), keep="none")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM
       (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) THEN 1 ELSE 0 END AS new FROM r)),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 400 AS e FROM g GROUP BY doc_id, span),
cut AS (SELECT doc_id, list(b ORDER BY b) AS b, list(e ORDER BY e) AS e, sum(e - b) AS removed FROM spans GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(len(c.b), 0) AS n_spans,
           CASE WHEN c.b IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(c.b) + 1), lambda j: substr(h,
             2 * CASE WHEN j = 0 THEN 0 ELSE c.e[j] END + 1, 2 * (CASE WHEN j = len(c.b) THEN len(h) // 2 ELSE c.b[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE c.e[j] END))), '') END AS h
         FROM d LEFT JOIN cut c USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""
