"""Column functions on text: white space, tokens, sentences, syllables.

Java's own classes (``\\w``, ``\\b``, ``\\s``) treat combining marks and white space
differently from the rules asked for, so all classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, word characters, and what counts as a token in either language.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
TOKEN_EN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_./-]*[\p{L}\p{N}_])?"
TOKEN_ES = r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*"
LETTERS_ES = "a-zA-ZáéíóúÁÉÍÓÚüÜñÑ"
SENTENCE_END = r"(?<=[^0-9])[.!?]+(?![0-9])"
VOWELS_EN = "[aeiouy]+"
VOWELS_ES = "[aeiouáéíóúü]+"


def strip(c: Column) -> Column:
    """Null becomes empty; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"{WS}+", " "))


def tokens_en(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_EN), F.lit(0))


def tokens_es(text: Column) -> Column:
    """Tokens reduced to Spanish letters; those without any drop out."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN_ES), F.lit(0))
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, f"[^{LETTERS_ES}]", "")), lambda x: x != "")


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between sentence ends, at least 1 if the text isn't empty."""
    pieces = F.size(F.filter(F.split(text, SENTENCE_END, -1), lambda x: F.trim(x) != ""))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(pieces, F.lit(1)))


def syllables_en(token: Column) -> Column:
    """Vowel groups of the token's a-z, without a final silent e, at least 1; 0 without letters."""
    w = F.regexp_replace(F.lower(token), "[^a-z]", "")
    n = F.regexp_count(w, F.lit(VOWELS_EN))
    return F.when(w == "", F.lit(0)).otherwise(F.greatest(F.lit(1), n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0)))


def letters_en(tokens: Column) -> Column:
    """The tokens' a-z in lower case, a space between tokens: what the counts of whole texts below are taken from."""
    return F.regexp_replace(F.lower(F.array_join(tokens, " ")), "[^a-z ]", "")


#: A word of :func:`letters_en` without a vowel, one whose final e is silent, and one of three syllables or more.
_NO_VOWEL = "(?<![a-z])[^aeiouy ]++(?![a-z])"
_SILENT_E = "[aeiouy]++[^aeiouy ]++[a-z]*e(?![a-z])"
_THREE = "(?<![a-z])[^aeiouy ]*+(?:(?:[aeiouy]++[^aeiouy ]++){3}[aeiouy][a-z]*+|(?:[aeiouy]++[^aeiouy ]++){2}[aeiouy][a-z]*+(?<!e))"


def syllable_total_en(letters: Column) -> Column:
    """The sum of :func:`syllables_en` over all words of :func:`letters_en`, by three searches of the whole text."""
    count = lambda p: F.regexp_count(letters, F.lit(p))
    return count(VOWELS_EN) - count(_SILENT_E) + count(_NO_VOWEL)


def polysyllables_en(letters: Column) -> Column:
    """Words of three syllables or more."""
    return F.regexp_count(letters, F.lit(_THREE))


def syllables_es(token: Column) -> Column:
    w = F.regexp_replace(F.lower(token), "[^a-záéíóúüñ]", "")
    return F.when(w == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.regexp_count(w, F.lit(VOWELS_ES))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)
