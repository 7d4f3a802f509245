"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, numbers with a unit, units after a number
and names (capitalised inside a sentence) turn into typed placeholders, all other
words lose case and outer punctuation. Windows of five template tokens are
hash-joined with the windows of the benchmark's items; hits on one diagonal grow
into runs, in which every token is compared and the slots must be consistent:
one value of the item always stands for one value of the document and back. So a
copy with other numbers or names is caught, and a chance mix of them isn't. Items so
full of placeholders that no such window has enough words of its own are joined on
longer windows, from one word to the second word after it, whatever lies between.

The benchmark's windows are the hash side. They are sent to the workers only up
to ``MAX_ITEM_TOKENS`` tokens at a time; a larger benchmark takes several passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, table, text_batches, worker_cache

WINDOW = 5
#: Fewest words, other than placeholders, in a window that may start a match.
LEAST_WORDS = 3
#: An item is found when a consistent run has so many tokens (or all of a shorter item) ...
LEAST_RUN = 13
#: ... or when its consistent runs cover this share of its tokens.
LEAST_COVER = 0.8
MAX_ITEM_TOKENS = 2_000_000

NUM, UNIT, NUM_UNIT, NAME = (np.uint64(k) for k in (1, 2, 3, 4))
#: Units of measure and currency.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l ms s sec min h hr hrs d day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw mw kwh v a k c f % usd eur gbp dollars euros pounds cents mph kmh percent degrees meters metres kilometers kilometres miles feet inches grams kilograms liters litres seconds minutes hours".split()
)
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,/:]*")
_NUMBER_UNIT = re.compile(r"[$€£+-]?\d[\d.,/:]*([^\W\d]+|%)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Words that a worker remembers the template tokens of.
CACHE_WORDS = 200_000

_LOWER, _TITLE, _ENDS, _UNITLIKE, _NUMBERLIKE = 0, 1, 2, 4, 8


def _packed(low: str, flags: int) -> int:
    return (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 4 | 16) << 4 | flags


def _word(raw: str) -> int:
    """A hash of 60 bits of one word and, below it, four flags."""
    if raw.isalpha():
        low = raw.lower()
        flags = (_UNITLIKE if low in UNITS else 0) | (_TITLE if raw[0].isupper() and raw[1:] == low[1:] else 0)
        return _packed(low, flags)
    flags = _ENDS if re.search(r"[.!?:][\"'”’)\]]*$", raw) else 0
    bare = raw.strip("\"'“”‘’()[]{}<>;,.!?:")
    if _NUMBER.fullmatch(bare):
        return int(NUM) << 4 | flags | _NUMBERLIKE
    m = _NUMBER_UNIT.fullmatch(bare)
    if m and m.group(1).lower() in UNITS:
        return int(NUM_UNIT) << 4 | flags | _NUMBERLIKE
    w = _EDGE.sub("", raw)
    low = w.lower()
    if low in UNITS or bare == "%":
        flags |= _UNITLIKE
    if w[:1].isupper() and w[1:] == w[1:].lower():
        flags |= _TITLE
    return _packed(low, flags)


class Canonical:
    """Template tokens of texts, with a cache of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words as they stand, and the template token of each."""
        words = text.split()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        pairs = list(map(known.get, words))
        if None in pairs:
            for i, w in enumerate(words):
                if pairs[i] is None:
                    pairs[i] = known[w] = _word(w)
        packed = np.fromiter(pairs, dtype=np.uint64, count=len(pairs))
        out, flags = packed >> np.uint64(4), (packed & np.uint64(15)).astype(np.uint8)
        before = np.concatenate([[_ENDS], flags[:-1]]) if len(flags) else flags
        out[(flags & _TITLE > 0) & (before & _ENDS == 0)] = NAME
        out[(flags & _UNITLIKE > 0) & (before & _NUMBERLIKE > 0)] = UNIT
        return words, out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(tokens: np.ndarray) -> np.ndarray:
    """One hash for each window; 0 where it holds too few words."""
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ tokens[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    is_word = np.concatenate([[0], np.cumsum(tokens > NAME)])
    h[is_word[WINDOW:] - is_word[:-WINDOW] < LEAST_WORDS] = 0
    return h


#: Odd, so that its powers have inverses modulo 2**64: the hash of a stretch comes from two sums of a text's prefixes.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: The template token of marks alone.
_MARKS = np.uint64(_packed("", 0) >> 4)


def spans(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the stretches that begin and end with a word, hold ``LEAST_WORDS`` of them and are longer than a window.

    Marks that stand alone aren't words here: arithmetic is no question's wording.
    """
    words = np.flatnonzero((tokens > NAME) & (tokens != _MARKS))
    first, last = words[: len(words) - LEAST_WORDS + 1], words[LEAST_WORDS - 1 :]
    first, last = first[last - first >= WINDOW], last[last - first >= WINDOW]
    if not len(first):
        return first, np.zeros(0, np.uint64)
    powers = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(tokens) - 1, base))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * powers(_BASE))])
    return first, (sums[last + 1] - sums[first]) * powers(_INVERSE)[first]


def _bare(word: str) -> str:
    return _EDGE.sub("", word).lower()


def _verbatim(words: list[str], tokens: np.ndarray) -> list[tuple]:
    """Template token and value of each word: what a window is hashed by where its template alone says too little."""
    return [(t, _bare(w)) for t, w in zip(tokens.tolist(), words)]


class Items:
    """The benchmark's side of the hash join.

    Items in which no window may start a match (fewer than five words, or too few
    that are no placeholders) are met by windows that hold the item's own values;
    of an item of fewer than five words the window is the whole item. Those of five
    words or more are met by their spans too, whose values may all be others.
    """

    def __init__(self, rows: list[tuple[int, str | None]]):
        canon = Canonical()
        self.plain: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        self.spans: dict[int, list[tuple[int, int]]] = {}
        self.ids, self.words, self.tokens, hashes, owner, pos = [], [], [], [], [], []
        for i, text in rows:
            words, tokens = canon(text or "")
            if not words:
                continue
            h = windows(tokens)
            if not h.any():
                size, own = min(WINDOW, len(words)), _verbatim(words, tokens)
                for k in range(len(own) - size + 1):
                    self.plain.setdefault(size, {}).setdefault(tuple(own[k : k + size]), []).append((len(self.ids), k))
                for k, x in zip(*(a.tolist() for a in spans(tokens))):
                    self.spans.setdefault(x, []).append((len(self.ids), k))
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            pos.append(np.arange(len(h)))
            self.ids.append(i)
            self.words.append([_bare(w) for w in words])
            self.tokens.append(tokens)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        order = order[np.searchsorted(h[order], 1) :]
        self.hash, self.owner, self.pos = h[order], cat(owner, np.int64)[order], cat(pos, np.int64)[order]
        self.span_hashes = np.array(sorted(self.spans), dtype=np.uint64)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hash & np.uint64((1 << 22) - 1)] = True

    def hits(self, words: list[str], tokens: np.ndarray) -> list[tuple[int, int, float]]:
        """(item_id, longest consistent run, share of the item covered) of each item found."""
        h = windows(tokens)
        at = np.flatnonzero(self.bits[h & np.uint64((1 << 22) - 1)])
        at = at[h[at] > 0]
        diagonals: set[tuple[int, int]] = set()
        if self.plain:
            doc = _verbatim(words, tokens)
            for size, seeds in self.plain.items():
                for p in range(len(doc) - size + 1):
                    diagonals.update((item, p - k) for item, k in seeds.get(tuple(doc[p : p + size]), ()))
        if self.spans:
            first, h_spans = spans(tokens)
            for p, x in zip(*(a[np.isin(h_spans, self.span_hashes)].tolist() for a in (first, h_spans))):
                diagonals.update((item, p - k) for item, k in self.spans[x])
        if not len(at) and not diagonals:
            return []
        a, b = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        for p, x, y in zip(at.tolist(), a.tolist(), b.tolist()):
            diagonals.update(zip(self.owner[x:y].tolist(), (p - self.pos[x:y]).tolist()))
        pieces: dict[int, list] = {}
        for item, diagonal in diagonals:
            own = self.tokens[item]
            first, last = max(0, diagonal), min(len(tokens), diagonal + len(own))
            equal = tokens[first:last] == own[first - diagonal : last - diagonal]
            runs = np.flatnonzero(np.diff(np.concatenate([[0], equal, [0]])))
            for s, e in zip(runs[::2].tolist(), runs[1::2].tolist()):
                if e - s >= min(WINDOW, len(own)):
                    pieces.setdefault(item, []).extend(self._consistent(words, tokens, item, first + s, first + e, diagonal))
        out = []
        for item, found in pieces.items():
            found.sort(key=lambda x: (x[0] - x[1], x[0]))
            covered, there, back = np.zeros(len(self.tokens[item]), bool), {}, {}
            # From the longest on, pieces count that agree with those before.
            for c, d, slots in found:
                if all(there.get(own, doc) == doc and back.get(doc, own) == own for own, doc in slots.items()):
                    there.update(slots)
                    back.update((doc, own) for own, doc in slots.items())
                    covered[c:d] = True
            run, share = max((d - c for c, d, _ in found), default=0), float(covered.mean())
            if run >= min(LEAST_RUN, len(covered)) or share >= LEAST_COVER:
                out.append((self.ids[item], run, share))
        return sorted(out, key=lambda x: (-x[2], -x[1], str(x[0])))

    def _consistent(self, words, tokens, item, a, b, diagonal):
        """Pieces of a run (places in the item, slots) in each of which slots map one to one."""
        there, back, start, out = {}, {}, a, []
        least = min(WINDOW, len(self.words[item]))
        for i in range(a, b):
            if tokens[i] <= NAME:
                doc, own = _EDGE.sub("", words[i]).lower(), self.words[item][i - diagonal]
                if there.get(own, doc) != doc or back.get(doc, own) != own:
                    if i - start >= least:
                        out.append((start - diagonal, i - diagonal, there))
                    there, back, start = {}, {}, i
                there[own], back[doc] = doc, own
        if b - start >= least:
            out.append((start - diagonal, b - diagonal, there))
        return out


def _passes(benchmark: DataFrame, max_tokens: int) -> int:
    size = benchmark.agg(F.sum(F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"\S+")))).first()[0] or 0
    return max(1, -(-size // max_tokens))


def find_items(docs: DataFrame, benchmark: DataFrame, max_tokens: int = MAX_ITEM_TOKENS, name: str = "hits") -> DataFrame:
    """The rows of ``docs`` with hits (or another ``name``): array of (item_id, run, cover), best first.

    Null and empty texts, and items without words, give no hits. Items of fewer
    than five words, or with fewer than three that are no placeholders, need a window
    with their own values to start a match. Repeated rows are judged alike. A column named
    hits is replaced. No shuffle of the documents; where the benchmark takes several
    passes, each is written before the next, so a worker holds one pass's items.
    """
    spark = docs.sparkSession
    text_batches(spark)
    passes = _passes(benchmark, max_tokens)
    kept = docs.drop(name)
    kind = "array<struct<item_id:long,run:int,cover:double>>"
    out = kept.withColumn(name, F.array().cast(kind))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        shared = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            canon, side = worker_cache("canonical", Canonical), shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
                earlier = batch.column(batch.num_columns - 1).to_pylist()
                found = []
                for text, old in zip(texts, earlier):
                    new = [{"item_id": i, "run": r, "cover": c} for i, r, c in (side.hits(*canon(text)) if text else [])]
                    found.append(sorted((old or []) + new, key=lambda x: (-x["cover"], -x["run"], str(x["item_id"]))))
                hit = pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("run", pa.int32()), ("cover", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], hit], names=batch.schema.names)

        out = out.mapInArrow(run, f"{fields}, `{name}` {kind}")
        if k + 1 < passes:
            out = materialize(out, "decontaminate-pass")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with their own columns."""
    [name] = free_names(docs, ["hits"])
    return find_items(docs, benchmark, name=name).where(F.size(f"`{name}`") == 0).select([F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, contaminated, n_items, and the best item with its run and cover, of every document."""
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.get("hits", F.lit(0))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").alias("n_items"),
        best["item_id"].alias("item_id"),
        best["run"].alias("run"),
        best["cover"].alias("cover"),
    )
