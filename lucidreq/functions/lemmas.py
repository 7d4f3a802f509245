"""Tokens and lemmas of English and Spanish by rules, as column expressions.

A word's lemma comes from the table of exceptions, else from the first rule whose
ending it has with enough letters before it, else it is the word. Rules are tried by
the word's last letter, so most words meet few of them. Both tables are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Abbreviations that keep their stops.
ABBREVIATIONS = {"en": ["e.g.", "i.e.", "etc.", "cf.", "vs."], "es": ["p.ej.", "etc.", "art.", "núm.", "pág.", "ss."]}


#: What tokens other than marks begin with.
WORDLIKE = r"^[\p{L}\p{M}\p{N}_]"


@dataclass(frozen=True)
class Rule:
    """Words with ``ending`` and ``least`` characters or more before it end in ``to`` instead."""

    ending: str
    to: str
    least: int = 2


def _doubled(ending: str) -> list[Rule]:
    return [Rule(c + c + ending, c) for c in "bdgmnprt"]


#: Irregular forms.
EXCEPTIONS = {
    "en": {
        "am": "be", "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "having": "have",
        "does": "do", "did": "do", "done": "do", "doing": "do", "goes": "go", "went": "go", "gone": "go", "made": "make", "making": "make",
        "given": "give", "gave": "give", "taken": "take", "took": "take", "taking": "take", "kept": "keep", "held": "hold", "sent": "send",
        "built": "build", "found": "find", "shown": "show", "known": "know", "written": "write", "writing": "write", "using": "use", "used": "use",
        "chosen": "choose", "met": "meet", "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "criteria": "criterion",
        "better": "good", "best": "good", "worse": "bad", "worst": "bad", "can't": "can", "won't": "will", "aren't": "be", "isn't": "be", "wasn't": "be", "weren't": "be",
        "don't": "do", "doesn't": "do", "didn't": "do", "hasn't": "have", "haven't": "have", "agreed": "agree", "this": "this", "its": "its", "as": "as",
        "always": "always", "during": "during", "nothing": "nothing", "something": "something", "anything": "anything", "need": "need", "indeed": "indeed",
    },
    "es": {
        "es": "ser", "son": "ser", "fue": "ser", "era": "ser", "sido": "ser", "será": "ser", "serán": "ser", "ha": "haber", "han": "haber", "hay": "haber",
        "está": "estar", "están": "estar", "puede": "poder", "pueden": "poder", "podrá": "poder", "podrán": "poder", "debe": "deber", "deben": "deber",
        "tiene": "tener", "tienen": "tener", "tendrá": "tener", "hace": "hacer", "hacen": "hacer", "hecho": "hacer", "da": "dar", "dan": "dar",
        "la": "el", "los": "el", "las": "el", "una": "uno", "unos": "uno", "unas": "uno", "esta": "este", "estos": "este", "estas": "este",
        "mes": "mes", "meses": "mes", "país": "país", "países": "país", "más": "más", "menos": "menos", "además": "además", "lunes": "lunes",
    },
}
#: Endings, the first that fits counts.
RULES = {
    "en": [
        Rule("'s", ""), Rule("n't", ""), Rule("ies", "y"), Rule("sses", "ss"), Rule("xes", "x"), Rule("ches", "ch"), Rule("shes", "sh"), Rule("zes", "ze"),
        Rule("ss", "ss", 0), Rule("us", "us", 0), Rule("is", "is", 0), Rule("s", ""),
        Rule("stored", "store", 0), Rule("storing", "store", 0), Rule("eed", "eed", 0), Rule("ied", "y"), *[Rule(s + "ed", s + "e") for s in ("at", "iz", "is", "id", "v", "c", "g", "ur", "u", "bl", "as", "os")], *_doubled("ed"), Rule("ed", "", 3),
        *[Rule(s + "ing", s + "e") for s in ("at", "iz", "is", "id", "v", "c", "g", "ur", "u", "bl", "as", "os")], *_doubled("ing"), Rule("ing", "", 3),
    ],
    "es": [
        Rule("ciones", "ción"), Rule("siones", "sión"), Rule("iones", "ión"), Rule("ades", "ad"), Rule("ales", "al"), Rule("iles", "il"), Rule("ores", "or"), Rule("ces", "z"),
        Rule("adas", "ado"), Rule("ados", "ado"), Rule("idas", "ido"), Rule("idos", "ido"), Rule("sis", "sis", 0), Rule("as", "a"), Rule("os", "o"), Rule("es", "e"), Rule("s", ""),
        Rule("ando", "ar"), Rule("iendo", "er"), Rule("ada", "ado"), Rule("ida", "ido"),
        Rule("arán", "ar"), Rule("erán", "er"), Rule("irán", "ir"), Rule("ará", "ar"), Rule("erá", "er"), Rule("irá", "ir"),
    ],
}


def word_pattern(lang: str) -> str:
    """In order: abbreviations, numbers with inner marks, words with inner apostrophes."""
    short = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "[.]" for c in a) for a in ABBREVIATIONS[lang])
    return rf"(?:{short})|\p{{N}}+(?:[.,:]\p{{N}}+)*|[\p{{L}}\p{{M}}_][\p{{L}}\p{{M}}\p{{N}}_]*(?:['’][\p{{L}}\p{{M}}]+)*"


def token_pattern(lang: str) -> str:
    """Words, then any other mark."""
    return word_pattern(lang) + rf"|[^\p{{L}}\p{{M}}\p{{N}}_{T.WS[1:-1]}]"


def tokens(text: Column, lang: str) -> Column:
    """All tokens of a text in order, marks too; none for null. Hyphens, slashes and marks at either end part words."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(token_pattern(lang)), F.lit(0))


def _rewritten(word: Column, rules: list[Rule]) -> Column:
    out = None
    for r in rules:
        fits = word.endswith(r.ending) & (F.length(word) >= len(r.ending) + r.least)
        new = F.concat(F.substring(word, F.lit(1), F.length(word) - len(r.ending)), F.lit(r.to))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(word)


def lemma(word: Column, rules: list[Rule], exceptions: dict[str, str]) -> Column:
    """The lemma of a lower-case word; null for null."""
    by_last: dict[str, list[Rule]] = {}
    for r in rules:
        by_last.setdefault(r.ending[-1], []).append(r)
    out = None
    if exceptions:
        table = F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair])
        out = F.when(word.isin(*exceptions), F.try_element_at(table, word))
    for last, own in by_last.items():
        ends = word.endswith(last)
        out = F.when(ends, _rewritten(word, own)) if out is None else out.when(ends, _rewritten(word, own))
    return word if out is None else out.otherwise(word)


def lemmas(text: Column, lang: str, stop_words: list[str] = (), rules: list[Rule] | None = None, exceptions: dict[str, str] | None = None) -> Column:
    """Lemmas of a text's words and numbers in order, without marks and stop words (judged before they are rewritten)."""
    rules = RULES[lang] if rules is None else rules
    exceptions = EXCEPTIONS[lang] if exceptions is None else exceptions
    low = F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("’"), F.lit("'"))
    words = F.regexp_extract_all(low, F.lit(word_pattern(lang)), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return F.transform(words, lambda w: lemma(w, rules, exceptions))


def preprocess(text: Column, lang: str, stop_words: list[str] = ()) -> Column:
    """What is encoded for the search of redundant requirements: lemmas joined by a space; empty for null."""
    return F.array_join(lemmas(text, lang, stop_words), " ")
