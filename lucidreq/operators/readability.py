"""Readability counts and indices of English and Spanish texts.

Row-wise column expressions: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_WORDS = 10
EN_COUNTS = ["words", "sentences", "chars", "syllables", "polysyllables"]
EN_METRICS = ["flesch", "fkgl", "fog", "smog", "ari", "coleman_liau"]
ES_COUNTS = [*EN_COUNTS, "mean_letters", "var_letters"]
ES_METRICS = ["ifsz", "inflesz", "fernandez_huerta", "smog", "gutierrez_polini", "mu"]


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _smog() -> Column:
    return F.when(F.col("polysyllables") > 0, F.lit(1.043) * F.sqrt(_d("polysyllables") * F.lit(30.0) / _d("sentences")) + F.lit(3.1291))


def _gated(metrics: dict[str, Column], min_words: int) -> dict[str, Column]:
    """Short texts and texts without words or sentences have counts but no metrics."""
    ok = (F.col("words") >= min_words) & (F.col("sentences") > 0) & (F.col("words") > 0)
    return {k: F.when(ok, v) for k, v in metrics.items()}


def readability_en(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds counts and FLESCH, FKGL, FOG, SMOG, ARI and Coleman-Liau; null text counts as empty."""
    df = df.withColumn("__t", T.squeeze(F.col(text)))
    df = df.withColumn("__k", T.tokens_en(F.col("__t")))
    df = df.withColumn("__l", T.letters_en(F.col("__k")))
    df = df.withColumns(
        {
            "words": F.size("__k"),
            "sentences": T.sentence_count(F.col("__t")),
            "chars": F.length(F.regexp_replace(F.array_join("__k", ""), "[^A-Za-z0-9]", "")),
            "syllables": T.syllable_total_en(F.col("__l")),
            "polysyllables": T.polysyllables_en(F.col("__l")),
        }
    ).drop("__t", "__k", "__l")
    w, s, c, y, p = (_d(x) for x in EN_COUNTS)
    metrics = {
        "flesch": F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (y / w),
        "fkgl": F.lit(0.39) * (w / s) + F.lit(11.8) * (y / w) - F.lit(15.59),
        "fog": F.lit(0.4) * ((w / s) + F.lit(100.0) * (p / w)),
        "smog": _smog(),
        "ari": F.lit(4.71) * (c / w) + F.lit(0.5) * (w / s) - F.lit(21.43),
        "coleman_liau": F.lit(0.0588) * ((c / w) * F.lit(100.0)) - F.lit(0.296) * ((s / w) * F.lit(100.0)) - F.lit(15.8),
    }
    return df.withColumns(_gated(metrics, min_words))


def readability_es(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds counts, letters per word, and IFSZ, INFLESZ, Fernandez-Huerta, SMOG, Gutierrez-Polini and mu."""
    df = df.withColumn("__t", T.squeeze(F.col(text)))
    df = df.withColumn("__k", T.tokens_es(F.col("__t")))
    df = df.withColumns({"__s": F.transform("__k", T.syllables_es), "__n": F.transform("__k", F.length)})
    zero = F.lit(0.0)
    mean = F.when(F.size("__k") > 0, T.total(F.col("__n")).cast("double") / F.size("__k")).otherwise(zero)
    df = df.withColumns(
        {
            "words": F.size("__k"),
            "sentences": T.sentence_count(F.col("__t")),
            "chars": T.total(F.col("__n")),
            "syllables": T.total(F.col("__s")),
            "polysyllables": F.size(F.filter("__s", lambda x: x >= 3)),
            "mean_letters": mean,
        }
    )
    # Two passes, as a sum of squares would lose digits.
    square = F.aggregate("__n", zero, lambda a, x: a + (x - F.col("mean_letters")) * (x - F.col("mean_letters")))
    df = df.withColumn("var_letters", F.when(F.col("words") > 0, square / F.col("words")).otherwise(zero)).drop("__t", "__k", "__s", "__n")
    w, s, c, y, _ = (_d(x) for x in EN_COUNTS)
    ifsz = F.lit(206.835) - F.lit(62.3) * (y / w) - (w / s)
    metrics = {
        "ifsz": ifsz,
        "inflesz": ifsz,
        "fernandez_huerta": F.lit(206.84) - F.lit(60.0) * (y / w) - F.lit(1.02) * (w / s),
        "smog": _smog(),
        "gutierrez_polini": F.lit(95.2) - F.lit(9.7) * (c / w) - F.lit(0.35) * (w / s),
        "mu": F.when(
            (F.col("words") > 1) & (F.col("mean_letters") > 0) & (F.col("var_letters") > 0),
            (w / (w - F.lit(1.0))) * (F.col("mean_letters") / F.col("var_letters")) * F.lit(100.0),
        ),
    }
    return df.withColumns(_gated(metrics, min_words))


def nested_record(df: DataFrame, counts: list[str], metrics: list[str]) -> DataFrame:
    """catalog_id, id, title and the struct readability.description, for JSON output."""
    return df.select("catalog_id", "id", "title", F.struct(F.struct(*counts, *metrics).alias("description")).alias("readability"))


def flat_record(df: DataFrame, counts: list[str], metrics: list[str]) -> DataFrame:
    """catalog_id, id, title and one upper-case column for each metric."""
    return df.select("catalog_id", "id", "title", *[F.col(c).alias(c.upper()) for c in [*counts, *metrics]])
