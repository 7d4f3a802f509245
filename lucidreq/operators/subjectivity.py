"""Subjectivity of a text from opinion words in their context.

Every opinion word or phrase has a weight. Its context are the tokens before it, at
most ``SCOPE``, back to the nearest mark or contrasting word: the nearest degree
word in it multiplies the weight (at most 1 is left), a negation halves it. The
score is the mean over all opinions. Row-wise columns: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import opinions as O
from ..functions import text as T

#: Words with a negated ending, and the marks that end a scope.
TOKEN = rf"{T.WORD}+(?:'t{T.WORD}*)?|[.!?;:,]"
PHRASES = {w.replace("_", " "): w for w in O.WEIGHTS if "_" in w}


def _numbers(table: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def _context(tokens: Column, at: Column) -> list[Column]:
    """The tokens before a place, nearest first; null before the text's start and beyond a break."""
    out, inside = [], None
    for k in range(1, O.SCOPE + 1):
        token = F.get(tokens, at - k)
        ends = F.coalesce(token.isin(*O.BREAKS), F.lit(True))
        inside = ~ends if inside is None else inside & ~ends
        out.append(F.when(inside, token))
    return out


def _weight(tokens: Column, at: Column, word: Column) -> Column:
    context = _context(tokens, at)
    degrees = _numbers(O.DEGREES)
    degree = F.coalesce(*[F.when(t.isin(*O.DEGREES), F.try_element_at(degrees, t)) for t in context], F.lit(1.0))
    negated = F.lit(False)
    for t in context:
        negated |= F.coalesce(t.isin(*O.NEGATIONS) | t.endswith(O.NEGATED_END), F.lit(False))
    return F.least(F.lit(1.0), F.try_element_at(_numbers(O.WEIGHTS), word) * degree) * F.when(negated, F.lit(O.NEGATED)).otherwise(F.lit(1.0))


def opinions(text: Column) -> Column:
    """Array of (place, word, weight) of a text's opinions in text order; empty for null and empty texts.

    Places count tokens from 0; a phrase is one token. A word that occurs twice is two opinions.
    """
    low = F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{T.WS}+|_", " "))
    for phrase, joined in PHRASES.items():
        low = F.replace(low, F.lit(phrase), F.lit(joined))
    tokens = F.regexp_extract_all(F.replace(low, F.lit("’"), F.lit("'")), F.lit(TOKEN), F.lit(0))

    def found(tokens: Column) -> Column:
        numbered = F.transform(tokens, lambda w, i: F.struct(i.alias("place"), w.alias("word")))
        own = F.filter(numbered, lambda s: s["word"].isin(*O.WEIGHTS))
        return F.transform(own, lambda s: F.struct(s["place"].alias("place"), s["word"].alias("word"), _weight(tokens, s["place"], s["word"]).alias("weight")))

    # The one-element array keeps the tokens from being computed again at each use.
    return F.transform(F.array(tokens), found)[0]


def mean_weight(found: Column) -> Column:
    """The score of a text's opinions; 0 if it has none."""
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, o: s + o["weight"]) / F.size(found)).otherwise(F.lit(0.0))


def contextual_score(text: Column) -> Column:
    """Between 0 and 1: a score for ``detect_smells(..., subjectivity=contextual_score)``."""
    return F.transform(F.array(opinions(text)), mean_weight)[0]
