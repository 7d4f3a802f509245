"""Vector expressions, pooling, and encoders of texts.

An encoder is anything with ``encode(df, text, out)``. Language models aren't part
of this library; :class:`HashingEncoder` is a deterministic stand-in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors of any length; 0 if one is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.greatest(n, F.lit(1e-12)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1 (the count is at least 1e-9), scaled to length 1."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v.cast("array<double>"), lambda x: x * m.cast("double")))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    zero = F.transform(tokens[0].cast("array<double>"), lambda x: F.lit(0.0))
    summed = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return normalised(F.transform(summed, lambda x: x / count))


def preprocess(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words without stop words, joined by a space: what remains of the preprocessing without a lemmatiser."""
    words = F.regexp_extract_all(F.lower(T.squeeze(text)), F.lit(f"{T.WORD}+"), F.lit(0))
    return F.array_join(F.filter(words, lambda x: ~F.array_contains(F.array(*[F.lit(w) for w in stop_words]), x)), " ")


#: Model names by purpose, used by callers that bring a model.
DEFAULT_MODELS = {"redundancy": "bert-base-multilingual-cased", "consistency": "sentence-transformers/LaBSE"}
LANGUAGE_MODELS = {"es": "es_core_news_sm", "en": "en_core_web_sm"}


def language_model(lang: str) -> str:
    if lang not in LANGUAGE_MODELS:
        raise ValueError("lang must be either 'es' or 'en'")
    return LANGUAGE_MODELS[lang]


class Encoder(Protocol):
    def encode(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEncoder:
    """Signed hashing of words into a fixed number of dimensions, scaled to length 1; the zero vector for texts without words."""

    def __init__(self, dims: int = 256, max_words: int | None = None):
        self.dims, self.max_words = dims, max_words

    def encode(self, df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"{T.WORD}+"), F.lit(0))
        if self.max_words:
            words = F.slice(words, 1, self.max_words)
        # The leading 60 bits of a word's MD5 give its place, the next bit its sign. A word is its place + 1, with the sign.
        place = lambda m: (F.conv(F.substring(m, 1, 15), 16, 10).cast("long") % self.dims + 1).cast("int")
        code = F.transform(F.transform(words, F.md5), lambda m: F.when(F.substring(m, 16, 1) >= "8", place(m)).otherwise(-place(m)))
        sums = lambda c, i: F.size(F.filter(c, lambda v: v == i + 1)) - F.size(F.filter(c, lambda v: v == -i - 1))
        vec = F.transform(F.array(code), lambda c: F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: sums(c, i).cast("double")))[0]
        return df.withColumn(out, vec).withColumn(out, normalised(F.col(out)))


def token_encoder(load, max_length: int = 256):
    """A loader for :class:`ModelEncoder` from one that gives (tokenize, model).

    tokenize(text) is a list of token ids; they are cut to ``max_length`` and padded
    with 0 to the batch's longest. model(ids, mask) is an array of (texts, tokens,
    dimensions); the tokens under the mask are averaged and scaled to length 1.
    """

    def made():
        tokenize, model = load()

        def run(texts: list[str]) -> np.ndarray:
            ids = [list(tokenize(t))[:max_length] for t in texts]
            wide = max(1, max(map(len, ids), default=1))
            padded = np.array([x + [0] * (wide - len(x)) for x in ids], dtype=np.int64).reshape(len(ids), wide)
            mask = np.array([[1] * len(x) + [0] * (wide - len(x)) for x in ids], dtype=np.int64).reshape(len(ids), wide)
            hidden = np.asarray(model(padded, mask), dtype=np.float64)
            pooled = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1e-9)[:, None]
            return pooled / np.maximum(np.linalg.norm(pooled, axis=1), 1e-12)[:, None]

        return run

    return made


class ModelEncoder:
    """Wraps a function that loads a model and returns texts -> matrix; loaded once for each worker."""

    def __init__(self, load, dims_type: str = "array<float>", batch_size: int = 32):
        self.load, self.kind, self.batch_size = load, dims_type, batch_size

    def encode(self, df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
        load, size = self.load, self.batch_size

        @F.pandas_udf(self.kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                parts = [np.asarray(model(list(texts[a : a + size]))) for a in range(0, len(texts), size)]
                yield pd.Series([list(map(float, v)) for m in parts for v in m])

        return df.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))
