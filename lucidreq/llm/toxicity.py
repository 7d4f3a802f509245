"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. A sentence's
score is a logistic function of the telling fragments in it, the document's
score is the noisy-or of its sentences', and both are trained together from
document labels alone; afterwards the sentence scores locate what offended. A
sentence without any telling fragment has a fixed score of nearly 0, so length
alone never makes a document toxic.

Fragments are whole words and their inner 3- to 5-grams, so spelling variants
and compounds share weight. Which fragments enter the model is decided by their
document frequencies under either label, counted on the executors.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_worker_cache, free_names, materialize, table, text_batches, text_or_empty

#: Labelled rows the classifier is fitted on, at most so many of either label (the
#: rows with the smallest hash of doc_id); everything else covers all rows.
FIT_ROWS_PER_LABEL = 4000
#: The sample is written once, in so many files.
SAMPLE_FILES = 64
#: Fragments in the model, at most.
FRAGMENTS = 1024
THRESHOLD = 0.3
#: Score of a sentence without a telling fragment.
QUIET = 1e-7
#: Least log-likelihood ratio (G squared) between a fragment and the label; a quarter
#: of what a perfect fragment reaches is enough where few rows are labelled.
EVIDENCE = 20.0

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Words that a task remembers the fragments of.
CACHE_WORDS = 150_000


#: Longer words are marked by a digest and kept out of caches.
LONG_WORD = 200


def _stream(word: str) -> Iterator[str]:
    if len(word) <= LONG_WORD:
        w = _EDGE.sub("", word)
    else:  # the expression takes quadratic time on long punctuation
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        w = word[a:b]
    if w:
        yield f"={w}" if len(w) <= LONG_WORD else "=#" + hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    for n in (3, 4, 5):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


def fragments(word: str) -> set[str]:
    """The word itself (marked) and its 3- to 5-grams, without outer punctuation."""
    return set(_stream(word))


def pieces(word: str) -> list[str]:
    """What of a word as it stands lies in one sentence or another, in lower case."""
    return [p.lower() for p in _SENTENCE.findall(word)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def sentence_logit(self, hits: set[str]) -> float:
        return self.bias + sum(self.weights[f] for f in hits)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold anything but white space."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """doc_id, text and toxic of the rows to fit on; the labels of the sample are bounded, so they are broadcast."""
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    ranked = [
        own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label) for k in (0, 1)
    ]
    sample = ranked[0].unionByName(ranked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    # A doc_id that repeats counts once, with its text of the smallest hash, so the sample stays bounded.
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r.toxic")


def held_out(doc_id: str):
    """Rows whose crc32 of the decimal doc_id leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fragment_counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        counts: tuple[Counter, Counter] = Counter(), Counter()
        rows, cache = [0, 0], {}

        def out():
            names = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["", *names]),
                    pa.array([rows[0], *(counts[0][x] for x in names)], pa.int64()),
                    pa.array([rows[1], *(counts[1][x] for x in names)], pa.int64()),
                ],
                names=["fragment", "clean", "toxic"],
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows[toxic] += 1
                seen: set[str] = set()
                for w in set(text.split()):
                    f = cache.get(w)
                    if f is None:
                        f = {x for p in pieces(w) for x in _stream(p)}
                        if len(w) <= LONG_WORD:
                            cache[w] = f
                    seen |= f
                counts[toxic].update(seen)
                if len(cache) > 10_000:
                    cache.clear()
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
                    counts, rows = (Counter(), Counter()), [0, 0]
        yield out()

    counted = sample.select("text", "toxic").mapInArrow(run, "fragment string, clean long, toxic long")
    return counted.groupBy("fragment").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose_fragments(sample: DataFrame, most: int = FRAGMENTS) -> tuple[list[str], int, int]:
    """The fragments that most set toxic documents apart, and the rows of either label."""
    counts = _fragment_counts(sample)
    total = counts.where("fragment = ''").first()
    clean, toxic = (total.clean, total.toxic) if total else (0, 0)
    if not clean or not toxic:
        return [], clean, toxic
    def part(k, n, m, of):  # one cell of G squared: k of n rows, where m of all rows are expected to share out
        return F.when(k > 0, 2 * k * F.log(k * float(of) / (n * m))).otherwise(0.0)

    x, y, rows = F.col("toxic"), F.col("clean"), clean + toxic
    have = x + y
    gain = part(x, float(toxic), have, rows) + part(y, float(clean), have, rows)
    gain += part(toxic - x, float(toxic), rows - have, rows) + part(clean - y, float(clean), rows - have, rows)
    perfect = 2 * (toxic * math.log(rows / toxic) + clean * math.log(rows / clean))
    best = (
        counts.where(f"fragment <> '' and toxic * {clean}D > 4 * clean * {toxic}D")
        .withColumn("gain", gain)
        .where(F.col("gain") >= min(EVIDENCE, perfect / 4))
        .orderBy(F.col("gain").desc(), "fragment")
        .limit(most)
    )
    return [r.fragment for r in best.select("fragment").collect()], clean, toxic


class _Finder:
    """Which of the model's fragments a word holds; most words hold none."""

    def __init__(self, names):
        self.names, self.cache, self.raw = frozenset(names), {}, {}

    def word(self, w: str) -> frozenset:
        hit = self.cache.get(w)
        if hit is None:
            hit = frozenset(self.names.intersection(_stream(w))) or _NONE
            if len(w) <= LONG_WORD:
                if len(self.cache) > CACHE_WORDS:
                    self.cache.clear()
                self.cache[w] = hit
        return hit

    def text(self, text: str) -> bool:
        """Whether any word of any sentence holds a fragment."""
        raw = self.raw
        for w in set(text.split()):
            hit = raw.get(w)
            if hit is None:
                hit = any(map(self.word, pieces(w)))
                if len(w) <= LONG_WORD:
                    if len(raw) > CACHE_WORDS:
                        raw.clear()
                    raw[w] = hit
            if hit:
                return True
        return False

    def sentence(self, part: str) -> set[str]:
        found: set[str] = set()
        for w in part.lower().split():
            found |= self.word(w)
        return found


_NONE: frozenset = frozenset()


def _bags(sample: DataFrame, names: list[str]) -> list:
    """For each document of the sample: label, sentences without a fragment, fragment sets of the others."""
    place = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(names)
        for batch in batches:
            toxics, rests, bags = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kinds: Counter = Counter(tuple(sorted(place[f] for f in finder.sentence(text[a:b]))) for a, b in sentences(text))
                toxics.append(toxic)
                rests.append(kinds.pop((), 0))
                bags.append([list(k) for k in kinds])
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxics, pa.int32()), pa.array(rests, pa.int64()), pa.array(bags, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "rest", "bag"],
            )

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, rest long, bag array<array<int>>").collect()


def train_noisy_or(bags: list, n_fragments: int, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Penalised maximum likelihood of the document labels under the noisy-or, by Adam on all bags.

    ``bags`` holds (toxic, sentences without a fragment, fragment sets of the others).
    """
    y = np.array([b[0] for b in bags], dtype=np.float64)
    rest = np.array([b[1] for b in bags], dtype=np.float64) * np.log1p(-QUIET)
    inst_doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], dtype=np.int64)
    ref = [(i, f) for i, fs in enumerate(fs for b in bags for fs in b[2]) for f in fs]
    rows = np.array([r[0] for r in ref], dtype=np.int64)
    cols = np.array([r[1] for r in ref], dtype=np.int64)
    theta = np.zeros(n_fragments + 1)
    theta[-1] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, weights=theta[cols], minlength=len(inst_doc))
        log_no = rest - np.bincount(inst_doc, weights=np.logaddexp(0, z), minlength=len(y))
        no = np.exp(np.minimum(log_no, -1e-9))
        # d loss / d log_no: clean documents want log_no high, toxic ones low.
        g_doc = np.where(y == 1, no / (1 - no), -1.0) / len(y)
        g_z = -g_doc[inst_doc] / (1 + np.exp(-z))
        grad = l2 / len(y) * theta
        grad[:-1] += np.bincount(cols, weights=g_z[rows], minlength=n_fragments)
        grad[-1] += g_z.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = FIT_ROWS_PER_LABEL, most_fragments: int = FRAGMENTS) -> ToxicityModel:
    """Fit on labelled rows that aren't held out; without both labels the model scores everything near 0."""
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, rows_per_label).repartition(SAMPLE_FILES, "doc_id")
    sample = materialize(sample.select("text", "toxic"), "toxicity-sample")
    names, clean, toxic = choose_fragments(sample, most_fragments)
    if not clean or not toxic or not names:
        return ToxicityModel({}, -20.0)
    weights, bias = train_noisy_or(_bags(sample, names), len(names))
    return ToxicityModel({f: float(w) for f, w in zip(names, weights)}, bias)


ADDED = ["toxicity", "predicted", "n_sentences", "offending"]


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, names: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with toxicity, predicted, n_sentences and offending (or other ``names`` for the four).

    toxicity is the noisy-or over all sentences of the whole text (0 for an empty
    or null text, which has none); offending lists the spans (code points) and
    scores of sentences that reach the threshold on their own. Every row stays,
    repeated rows and rows without doc_id included; columns of the same names
    are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    text_batches(spark)
    added = names or ADDED
    kept = docs.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        model = shared.value
        finder = _Finder(model.weights)
        quiet = -float(np.log1p(-QUIET))
        for batch in batches:
            scores, counts, found = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist():
                spans = sentences(text or "")
                log_no, hot = -quiet * len(spans), []
                if spans and finder.text(text):
                    for a, b in spans:
                        hits = finder.sentence(text[a:b])
                        if hits:
                            z = model.sentence_logit(hits)
                            log_no += quiet - float(np.logaddexp(0, z))
                            p = 1 / (1 + np.exp(-z))
                            if p >= threshold:
                                hot.append({"begin": a, "end": b, "score": float(p)})
                scores.append(min(1.0, max(0.0, -float(np.expm1(log_no)))))
                counts.append(len(spans))
                found.append(hot)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                ],
                names=[*batch.schema.names, *added],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    kinds = ["double", "int", "long", "array<struct<begin:long,end:long,score:double>>"]
    return kept.mapInArrow(run, ", ".join([fields, *(f"`{c}` {k}" for c, k in zip(added, kinds))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, score, predicted (and sentence counts) of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        "predicted",
        "n_sentences",
        F.size("offending").alias("n_offending"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the fitted model doesn't reject, with their own columns."""
    names = free_names(docs, ADDED)
    return score(docs, fit(docs, labels), threshold, names).where(F.col(f"`{names[1]}`") == 0).select([F.col(f"`{c}`") for c in docs.columns])
