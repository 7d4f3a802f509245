"""Fuzzy line deduplication.

Lines are normalised (case, punctuation, white space; digits stay as they are).
Two different lines link when their edit similarity is at least 0.8. Candidates
share a key:

* Lines of ``FEW_WORDS`` distinct words or more have a SimHash in blocks: the
  distinct words are dealt to the blocks by their hashes, and a block's 64 bits are
  the majority over its own words. A change of few words leaves the other blocks as
  they were (pigeonhole), so lines are joined on each block's bits; longer lines
  have more blocks, and lengths near a bound have those of both sides.
* Shorter lines have too few words for that and are joined on what is left when one
  or two of their words, or of their characters, are left out.

Of every connected group the first occurrence stays.

As groups are all that matters, a line is first verified against two leaders, the
lines with which it shares the most keys among those that lead a key; then all pairs that share a key and lie in
different components are verified, so no link between candidates is lost and a
group of many variants never makes all its pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components, merged_components
from .common import materialize, number_batches, release, same, table, text_batches, text_or_empty
from .meeting import SPLIT, Slots, met, postings, sketch, votes
from .shingles import CHUNK_BYTES, _power, all_words, mix

MIN_SIMILARITY = 0.8
#: Lines of at least so many distinct words have a SimHash.
FEW_WORDS = 8
#: (blocks, fewest and most distinct words, fewest bytes of a block's words); the ranges overlap.
FAMILIES = ((6, FEW_WORDS, 20, 12), (7, 16, 38, 16), (8, 30, 1 << 62, 20))
#: Most words of lines that are joined by leaving out one word, or two; most characters, for characters.
LEAVE_WORDS = (12, 7)
LEAVE_CHARACTERS = (24, 14)
#: Lines that are fetched to be verified are broadcast by place up to so many; beyond, they are joined by a shuffle.
BROADCAST_PLACES = 500_000

#: Leaders that a line is verified against first.
LEADERS = 2
#: Lines that a task remembers to have given the keys of.
SEEN_LINES = 200_000

_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_KEPT = bytes(c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in range(256))
_STEP, _BACK = 0x9E3779B97F4A7C55 | 1, pow(0x9E3779B97F4A7C55 | 1, -1, 1 << 64)


def _bytes(text: str) -> bytes:
    """The text in lower case, letters and digits and line ends only, words still apart."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    return (raw if raw.isascii() else _SPACES.sub(b" ", raw)).translate(_KEPT)


def normalise(line: str) -> str:
    return b" ".join(_bytes(line).split()).decode("utf-8", "surrogatepass")


class Lines:
    """The lines of normalised bytes: which words they hold, what they are called, and their keys.

    ``place`` (the line's number), ``name`` (a hash of its words in order) and ``size``
    (characters) of the lines that aren't blank.
    """

    def __init__(self, buffer: bytes):
        self.buffer = buffer
        data = np.frombuffer(buffer + b"\n", np.uint8)
        word, self.begin, self.end = all_words(buffer)
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        of = np.searchsorted(starts, self.begin, side="right") - 1
        self.first = np.flatnonzero(np.diff(of, prepend=-1))
        self.words = np.diff(np.append(self.first, len(of)))
        self.place = of[self.first]
        self.word, self.line = word, np.repeat(np.arange(len(self.first)), self.words)
        more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that go on a character
        width = self.end - self.begin - (more[self.end] - more[self.begin])
        self.size = (np.add.reduceat(width, self.first) if len(self.first) else width) + self.words - 1
        self.name = self._names()

    def _names(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.word)) - self.first[self.line]
        h = self.word * _power(_STEP, int(at.max()) + 1)[at]
        return mix(np.add.reduceat(h, self.first) + self.words.astype(np.uint64))

    def keys(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) pairs, sorted by line, of the given lines (numbers among those that aren't blank)."""
        wanted = np.zeros(len(self.first), dtype=bool)
        wanted[lines] = True
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        parts = [none, *self._simhashes(wanted), *self._left_words(wanted), *self._left_characters(wanted)]
        line = np.concatenate([x[0] for x in parts])
        key = np.concatenate([x[1] for x in parts])
        order = np.lexsort((key, line))
        line, key = line[order], key[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
        return line[new], key[new]

    def _simhashes(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = np.flatnonzero(wanted[self.line])
        # Distinct words of each line: line, 44 bits of the word and its length (up to 15) in one number.
        width = np.minimum((self.end - self.begin)[own], 15).astype(np.uint64)
        for low in range(0, max(1, len(wanted)), 1 << 16):
            near = (self.line[own] >= low) & (self.line[own] < low + (1 << 16)) if len(wanted) > 1 << 16 else slice(None)
            packed = (self.line[own][near] - low).astype(np.uint64) << np.uint64(48) | self.word[own][near] >> np.uint64(20) << np.uint64(4) | width[near]
            packed.sort()
            packed = packed[np.flatnonzero(np.diff(packed, prepend=~packed[:1]))]
            line = (packed >> np.uint64(48)).astype(np.int64) + low
            word, size = packed >> np.uint64(4) & np.uint64((1 << 44) - 1), (packed & np.uint64(15)).astype(np.int64)
            bits = mix(word)
            distinct = np.bincount(line, minlength=len(wanted))
            for blocks, fewest, most, least in FAMILIES:
                of = np.flatnonzero((distinct[line] >= fewest) & (distinct[line] <= most))
                if len(of):
                    # Words are in order of their hashes, so a block, a range of them, is a run.
                    block = line[of] * blocks + (word[of] * np.uint64(blocks) >> np.uint64(44)).astype(np.int64)
                    yield _block_keys(block, bits[of], size[of], blocks, least)

    def _left_words(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in range(1, LEAVE_WORDS[0] + 1):
            own = np.flatnonzero(wanted & (self.words == n))
            if len(own):
                rows = self.word[self.first[own][:, None] + np.arange(n)]
                yield from _left_out(own, rows, 2 if 4 <= n <= LEAVE_WORDS[1] else 1, 1)

    def _left_characters(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = np.flatnonzero(wanted & (self.size <= LEAVE_CHARACTERS[0]))
        texts = [b" ".join(self.buffer[a:b].split()).decode("utf-8", "replace") for a, b in zip(self.begin[self.first[own]].tolist(), self.end[(self.first + self.words)[own] - 1].tolist())]
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        for n in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == n)
            rows = np.frombuffer("".join(texts[i] for i in of.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            # 0.8 allows no edit below five characters, one below ten.
            out = 0 if n < 4 else 2 if 9 <= n <= LEAVE_CHARACTERS[1] else 1
            yield from _left_out(own[of], mix(rows.astype(np.uint64)), out, 2)


#: A byte's bits, each in a byte of its own.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None] * np.array([1] + [0] * 7, np.uint8), axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


def _block_keys(block: np.ndarray, word: np.ndarray, size: np.ndarray, blocks: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """line and key of each block (in order) whose words have ``least`` bytes: the majority of each bit over the block's words."""
    start = np.flatnonzero(np.diff(block, prepend=-1))
    count = np.diff(np.append(start, len(block)))
    if count.max() < 256:  # eight counters in a number
        raw = word.view(np.uint8).reshape(-1, 8)
        sums = np.empty((len(start), 8), dtype=np.uint64)
        for k in range(8):
            sums[:, k] = np.add.reduceat(_SPREAD[raw[:, k]], start)
        ones = sums.view(np.uint8)
    else:
        ones = np.add.reduceat(np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), start, axis=0, dtype=np.int32)
    sim = np.packbits(ones > (count // 2)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    kept = np.add.reduceat(size, start) >= least
    block = block[start][kept]
    return block // blocks, mix(sim[kept] + (block % blocks + 100 * blocks).astype(np.uint64) * np.uint64(_STEP))


def _left_out(line: np.ndarray, rows: np.ndarray, most: int, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the sequences in ``rows`` with up to ``most`` of their members left out."""
    n = rows.shape[1]
    power = _power(_STEP, n)
    total = np.zeros((len(rows), n + 1), dtype=np.uint64)
    np.cumsum(rows * power, axis=1, out=total[:, 1:])
    back, twice = np.uint64(_BACK), np.uint64(_BACK * _BACK % (1 << 64))
    whole = total[:, -1]
    for k in range(most + 1):
        if k >= n:
            return
        for out in combinations(range(n), k):
            if k == 0:
                h = whole
            elif k == 1:
                h = total[:, out[0]] + (whole - total[:, out[0] + 1]) * back
            else:
                i, j = out
                h = total[:, i] + (total[:, j] - total[:, i + 1]) * back + (whole - total[:, j + 1]) * twice
            yield line, mix(h + np.uint64(1000 * kind + n - k))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, line (a hash of the normalised line), n (characters), keys of every line that isn't blank.

    keys is null where the task has given the line's keys already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows(batch: pa.RecordBatch, own: list[int], first: list[int], raws: list[bytes]) -> pa.RecordBatch:
            found = Lines(b"\n".join(raws))
            piece = np.searchsorted(np.cumsum([x.count(b"\n") + 1 for x in raws]), found.place, side="right")
            before = np.concatenate([[0], np.cumsum([x.count(b"\n") + 1 for x in raws])])
            pos = found.place - before[piece] + np.array(first, dtype=np.int64)[piece]
            _, once = np.unique(found.name, return_index=True)
            new = np.array([i for i, x in zip(once.tolist(), found.name[once].tolist()) if x not in seen], dtype=np.int64)
            if len(seen) > SEEN_LINES:
                seen.clear()
            seen.update(found.name[new].tolist())
            line, key = found.keys(new)
            size = np.bincount(line, minlength=len(found.place))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))
            of = pa.array(np.array(own, dtype=np.int64)[piece])
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(pos.astype(np.int64)), pa.array(found.name.view(np.int64)), pa.array(found.size.astype(np.int32)), lists]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "pos", "line", "n", "keys"])

        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            size = 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw, a, pos = _bytes(text), 0, 0
                while a <= len(raw):  # a long text goes in pieces that end at line ends
                    b = raw.find(b"\n", a + CHUNK_BYTES) if len(raw) - a > CHUNK_BYTES else -1
                    piece = raw[a : b if b >= 0 else len(raw)]
                    if size + len(piece) > CHUNK_BYTES and size:
                        yield rows(batch, *held)
                        held, size = ([], [], []), 0
                    for col, v in zip(held, (i, pos, piece)):
                        col.append(v)
                    size += len(piece) + 1
                    pos += piece.count(b"\n") + 1
                    a = b + 1 if b >= 0 else len(raw) + 1
            if size:
                yield rows(batch, *held)

    return _rows(docs).mapInArrow(run, "doc_id long, th long, pos long, line long, n int, keys array<long>")


def _near_sizes(a: str, b: str):
    """What of the longer line may differ, if the lengths' difference is within it."""
    most = F.floor(F.greatest(a, b) * (1 - MIN_SIMILARITY) + 1e-9).cast("int")
    return F.abs(F.col(a) - F.col(b)) <= most


def verified(pairs: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b of line hashes) whose normalised lines' edit similarity is enough."""
    pairs = materialize(pairs, "line-pairs")
    wanted = pairs.select(F.col("a").alias("line")).unionAll(pairs.select(F.col("b").alias("line"))).distinct()
    places = materialize(wanted.join(lines, "line").select("line", "first.doc_id", "first.th", "first.pos"), "line-places")
    per_doc = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "pos")).alias("c")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "c")
    side = F.broadcast(per_doc) if places.count() <= BROADCAST_PLACES else per_doc
    rows = _rows(docs).join(side, same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, str] = {}
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = text.split("\n")
                found.update((w["line"], normalise(own[w["pos"]])) for w in wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["line", "text"])

    texts = rows.select("text", "c").mapInArrow(run, "line long, text string").groupBy("line").agg(F.min("text").alias("text"))
    texts = materialize(texts, "line-texts")
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "line-links")


def edit_distance(a: str, b: str) -> int:
    """Exact, a column of the table at a time in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(zero | up)), up & zero
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more = more << 1 | 1
        up, down = (less << 1 | (full & ~(zero | more))) & full, more & zero & full
    return score


def _cost(x: list[str], y: list[str]) -> int:
    """At most so many edits turn the words x into y."""
    a, b = len(" ".join(x)), len(" ".join(y))
    return max(a, b) + (1 if not x or not y else 0) if x or y else 0


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity is at least MIN_SIMILARITY: by alignments of words that can't be too good, and exactly where they don't tell."""
    most = int(max(len(a), len(b)) * (1 - MIN_SIMILARITY) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    i, n = 0, min(len(x), len(y))
    while i < n and x[i] == y[i]:
        i += 1
    j = 0
    while j < n - i and x[-1 - j] == y[-1 - j]:
        j += 1
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if _cost(x, y) <= most:
        return True
    if len(x) == len(y) and sum([max(len(p), len(q)) for p, q in zip(x, y) if p != q]) <= most:
        return True
    if _aligned(x, y) <= most:
        return True
    # What both begin and end with plays no part in the distance.
    return edit_distance(" ".join(x), " ".join(y)) + (1 if not x or not y else 0) <= most


def _aligned(x: list[str], y: list[str]) -> int:
    """The cost of keeping words that occur once on either side, as many as stand in the same order."""
    once: dict[str, int] = {}
    for k, w in enumerate(y):
        once[w] = -1 if w in once else k
    seen: dict[str, int] = {}
    for k, w in enumerate(x):
        seen[w] = -1 if w in seen else k
    ends: list[int] = []  # the last place in y of the best chain of each length, and its links
    chain: list[tuple[int, int, int]] = []
    tops: list[int] = []
    for k, w in enumerate(x):
        p = once.get(w, -1)
        if p < 0 or seen[w] < 0:
            continue
        at = bisect_left(ends, p)
        chain.append((k, p, tops[at - 1] if at else -1))
        if at == len(ends):
            ends.append(p)
            tops.append(len(chain) - 1)
        else:
            ends[at], tops[at] = p, len(chain) - 1
    total, i, j = 0, len(x), len(y)
    at = tops[-1] if tops else -1
    while at >= 0:
        k, p, before = chain[at]
        total += _cost(x[k + 1 : i], y[p + 1 : j])
        i, j, at = k, p, before
    return total + _cost(x[:i], y[:j])


def line_groups(docs: DataFrame, occurrences: DataFrame, lines: DataFrame, split: int = SPLIT) -> DataFrame:
    """line, component of the lines that link with another one."""
    spark = docs.sparkSession
    lists = occurrences.where("size(keys) > 0").select(F.col("line").alias("node"), "n", "keys")
    with number_batches(spark):
        slots = Slots(sketch(lists.select("keys"), lambda batch: iter([batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)])), split)
        # The line whose keys are the most common leads: of near copies, the one that most resemble.
        shared = materialize(met(postings(lists, slots, central=True), slots), "line-postings")
    slots.discard()
    release(spark)
    pairs = votes(shared).where(_near_sizes("n", "an")).groupBy("a", "node").agg(F.count(F.lit(1)).alias("both"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("both", "a")), False), 1, LEADERS)  # a line has few keys
    best = pairs.groupBy("node").agg(best.alias("m")).select(F.explode("m.a").alias("a"), F.col("node").alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(best, docs, lines)
    so_far = materialize(connected_components(links), "line-components")
    rows = shared.select("key", "node", "n").join(so_far, "node", "left").withColumn("c", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rows = materialize(rows.join(mixed, "key", "left_semi").select("key", "node", "n", "c"), "line-cross")
    a = rows.select("key", F.col("c").alias("ca"), F.col("node").alias("a"), F.col("n").alias("an"))
    b = rows.select("key", F.col("c").alias("cb"), F.col("node").alias("b"), F.col("n").alias("bn"))
    apart = a.join(b, "key").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _near_sizes("an", "bn"))
    apart = apart.select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
    more = verified(apart, docs, lines)
    return merged_components(so_far, more).withColumnRenamed("node", "line")


def dedup_lines(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_groups (groups that its removed lines are in), kept_text.

    Lines end at \\n. Of all lines that are equal when normalised, or linked, the
    first occurrence in the order of (doc_id, text hash, place) stays, null
    doc_id last. Lines without letters or digits, null and empty texts lose
    nothing. Rows that repeat doc_id and text have the same result. Other
    columns of ``docs`` play no part; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    occurrences = materialize(line_rows(docs), "line-rows")
    place = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th", "pos")
    lines = materialize(occurrences.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    groups = materialize(line_groups(docs, occurrences, lines, split), "line-groups")
    # Lines by their group; most groups are one line that never repeats.
    grouped = lines.join(groups, "line", "left").where("n > 1 or component is not null").withColumn("g", F.coalesce("component", "line"))
    keeper = grouped.groupBy("g").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    told = materialize(grouped.select("line", "g").join(keeper, "g").select("line", "g", "keep"), "line-keepers")
    gone = occurrences.select("doc_id", "th", "pos", "line").join(told, "line").where(~(same(F.col("doc_id"), F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th")) & (F.col("pos") == F.col("keep.pos"))))
    per_doc = gone.groupBy("doc_id", "th").agg(F.collect_set(F.col("pos").cast("int")).alias("gone"), F.count_distinct("g").alias("groups")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "gone", "groups")
    rows = _rows(docs).join(per_doc, same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t")), "left")
    split_ = F.split("text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split_, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    return rows.select(
        "doc_id",
        F.size(split_).cast("long").alias("n_lines"),
        F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("groups", F.lit(0)).cast("long").alias("n_groups"),
        kept.alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, n_lines, n_removed, n_groups, kept_sha256 of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_groups", F.sha2("kept_text", 256).alias("kept_sha256"))
