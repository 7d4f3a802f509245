"""Smell rules over requirement texts, as nullable columns: null means the rule didn't fire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .readability import readability_en


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the lower-case text holds any phrase, also inside words."""
    return F.transform(F.array(F.lower(text)), lambda low: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p)))[0]


def phrase_count(text: Column, phrase: Column | str) -> Column:
    """Non-overlapping, case-sensitive occurrences."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    # Bytes, whose number is known, instead of characters, which would be counted.
    return ((F.octet_length(text) - F.octet_length(F.replace(text, p, F.lit("")))) / F.octet_length(p)).cast("int")


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """phrase and its count n of all distinct phrases that occur, sorted by phrase: one pass of counting for all rules."""
    found = F.filter(F.array(*[F.lit(p) for p in sorted(set(phrases))]), lambda p: F.contains(text, p))
    return F.transform(found, lambda p: F.struct(p.alias("phrase"), phrase_count(text, p).alias("n")))


def hit_lines(hits: Column, phrases: list[str]) -> Column:
    """Lines "phrase: n" of the hits that a rule's list has; null if it has none."""
    own = F.filter(hits, lambda h: h["phrase"].isin(*sorted(set(phrases))))
    return F.nullif(F.array_join(F.transform(own, lambda h: F.concat(h["phrase"], F.lit(": "), h["n"].cast("string"))), "\n"), F.lit(""))


def counted_phrases(text: Column, phrases: list[str]) -> Column:
    """Lines "phrase: n" of the phrases that occur, sorted by phrase; null if none does. Only those that occur are counted."""
    return hit_lines(phrase_hits(text, phrases), phrases)


def ambiguous_words(text: Column) -> Column:
    """Words, as they stand and in text order, that are in the list of ambiguous words; its phrases never match a word."""
    words = F.regexp_extract_all(text, F.lit(f"{T.WORD}+"), F.lit(0))
    return F.nullif(F.array_join(F.filter(words, lambda x: F.lower(x).isin(*L.AMBIGUOUS)), ", "), F.lit(""))


def subjectivity_score(text: Column) -> Column:
    """Stand-in for a sentiment model: the share of tokens that are single words of the subjectivity list, five times, at most 1."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"{T.WORD}+"), F.lit(0))
    n = F.size(words)
    # A text that doesn't even hold a listed word as a part needs no words.
    return F.when(contains_any(text, [p for p in L.SUBJECTIVITY if " " not in p]) & (n > 0), F.least(F.lit(1.0), F.size(F.filter(words, lambda x: x.isin(*L.SUBJECTIVITY))) * F.lit(5.0) / n)).otherwise(F.lit(0.0))


def two_decimals(value: Column) -> Column:
    """A number with two decimals, rounded by its exact binary value, halves to the even digit; Java's formats round its shortest decimal form."""
    low, half = F.lit((1 << 30) - 1), 1 << 29

    def text(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        # The fraction in units of 2^-60: whole for all doubles that can be near half a hundredth. A hundred times that in two words.
        m = ((F.abs(v) - whole) * F.lit(float(1 << 60))).cast("long")
        rest = m.bitwiseAND(low) * 100
        high = F.shiftright(m, 30) * 100 + F.shiftright(rest, 30)
        cents, over = F.shiftright(high, 30), high.bitwiseAND(low)
        up = (over > half) | ((over == half) & ((rest.bitwiseAND(low) > 0) | (cents % 2 == 1)))
        total = whole * 100 + cents + up.cast("long")
        return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))

    return F.transform(F.array(value), text)[0]


_EXTRA: dict[str, Callable[[Column], Column]] = {}


def register_rule(header: str, rule: Callable[[Column], Column]) -> None:
    """Add a rule: a function from the text column to a message column (null if it doesn't fire)."""
    _EXTRA[header] = rule


def detect_smells(df: DataFrame, id_col: str = "req_id", text_col: str = "text", all_checks: bool = True, hide_clean: bool = True, subjectivity: Callable[[Column], Column] = subjectivity_score) -> DataFrame:
    """ID, Requirement and a column for each rule; rows without text go, clean rows too unless kept.

    Low Readability uses this library's Flesch index and Subjectivity Detected
    the given score; both stand in for models that aren't part of it.
    """
    base = df.select(F.col(id_col).cast("string").alias("ID"), F.col(text_col).cast("string").alias("Requirement")).where("Requirement is not null")
    scored = readability_en(base, "Requirement", min_words=1)
    text, flesch = F.col("Requirement"), F.coalesce("flesch", F.lit(206.835))
    s = subjectivity(text)
    rules = {
        "Ambiguity Detected": ambiguous_words(text),
        "Low Readability": F.when(flesch < L.LOW_READABILITY_BELOW, F.concat(F.lit("Flesch Reading Ease: "), two_decimals(flesch))),
        "Subjectivity Detected": F.when(s > L.SUBJECTIVITY_ABOVE, F.concat(F.lit("Subjectivity Score: "), two_decimals(s))),
        "Security Related": F.when(contains_any(text, L.SECURITY), F.lit(True)),
        "Not a Requirement": F.when(~contains_any(text, L.REQUIREMENT), F.lit(True)),
    }
    if all_checks:
        # The hits of all lists' phrases are found once, below the rules; the generator keeps them from being put into each rule.
        every = sorted({p for phrases in L.COUNTERS.values() for p in phrases})
        scored = scored.select("ID", "Requirement", "flesch", F.inline(F.array(F.struct(phrase_hits(text, every).alias("__hits")))))
        rules |= {header: hit_lines(F.col("__hits"), phrases) for header, phrases in L.COUNTERS.items()}
    rules |= {header: rule(text) for header, rule in _EXTRA.items()}
    # A filter on computed columns would be pushed below them and compute every rule again; it isn't pushed below inline.
    out = scored.select("ID", "Requirement", F.inline(F.array(F.struct(*[v.alias(k) for k, v in rules.items()]))))
    if hide_clean:
        out = out.where(F.coalesce(*[F.col(f"`{k}`").cast("string") for k in rules]).isNotNull())
    return out
