"""Cleaning of normative texts by an ordered chain of replacements, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS

S, NS = WS, "[^" + WS[1:]
N = r"\p{Nd}"
D = r"[\-\x{2013}\x{2014}]"
B = rf"(?:[A-Za-z0-9][).]|{N}+\.{S}*[ºª])"
LET = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
_OPEN, _SHUT = "\ue000", "\ue001"

#: The replacements in their order; $1 and $2 are groups.
STEPS: list[tuple[str, str]] = [
    (r"\*{2,}", ""),
    (rf"^{S}*(?:(?i:art[íÍ]culo|art\.?|article)){S}+{N}+(?:\.{N}+)?{S}*[.:,-]*{S}*", ""),
    (r"\[[^\]]*\]", " "),
    (rf"^{D}{S}*", ""),
    (rf"[\r\n]+{D}{S}*", " "),
    (r"\(([^)]*)\)", f"{_OPEN}$1{_SHUT}"),
    (rf"\x{{e000}}[^\x{{e001}}{LET}]*\x{{e001}}", " "),
    (r"\x{e000}", "("),
    (r"\x{e001}", ")"),
    (rf"^{S}*(?:(?i:refuerzo){S}+[Rr]{N}+{S}*{D}{S}*|(?i:reinforcement){S}+[Rr]{N}+{S}*{D}{S}*)", ""),
    (rf"^{S}*{B}{S}+", " "),
    (rf"([:;]){S}*{B}{S}+", "$1 "),
    (rf"([\r\n\-\x{{2022}}\x{{2013}}\x{{2014}}]){S}*{B}{S}+", "$1 "),
    (rf"([.!?]){S}*{B}{S}+", "$1 "),
    (rf"{S}+[A-Za-z]\){S}+", " "),
    (rf"{S}+\({S}*[A-Za-z]{S}*\){S}+", " "),
    (rf"{S}+{N}+\.{S}+([A-ZÁÉÍÓÚÜÑ])", " $1"),
    (r"[\r\n]+", " "),
    (rf"({NS}){S}*{D}{S}+({NS})", "$1 $2"),
    (rf"([:.,]){S}*{D}{S}*", "$1 "),
    (rf"{D}{S}*([.,])", "$1"),
    (rf";{S}*$", "."),
    (rf";{S}*([\"»”]){S}*$", ".$1"),
    (r";", ","),
    (rf":{S}*$", "."),
    (rf"{S}+", " "),
    (rf"{S}+([,.:)])", "$1"),
    (r"([(\[]) +", "$1"),
    (rf",{S}*\.", "."),
    (rf":{S}*\.", "."),
    (r"\.{2,}", "."),
    (rf"^{S}+|{S}+$", ""),
]


#: What a text must hold for a step to change it, where a step has such a character: the steps' places and any of these.
_DASHES = ["-", "\u2013", "\u2014"]
NEEDS: dict[int, list[str]] = {0: ["**"], 2: ["["], 3: _DASHES, 4: _DASHES, 5: ["("], 6: [_OPEN], 7: [_OPEN], 8: [_SHUT], 11: [":", ";"], 14: [")"], 15: ["("], 17: ["\n", "\r"], 18: _DASHES, 19: _DASHES, 20: _DASHES, 21: [";"], 22: [";"], 23: [";"], 24: [":"], 26: [" ,", " .", " :", " )"], 27: ["(", "["], 28: [",.", ", ."], 29: [":.", ": ."], 30: [".."]}  # from step 26 on all white space is single spaces


#: White space that few texts hold; without any, ``\s`` finds the same as WS, and the same replacements take a fraction of the time.
RARE = [chr(k) for k in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
PLAIN = [(pattern.replace(NS, r"\S").replace(S, r"\s"), replacement) for pattern, replacement in STEPS]
PLAIN[25] = (r"\s{2,}|[^\S ]", " ")  # leaves single spaces where they are


def _holds(t: Column, some: list[str]) -> Column:
    held = F.contains(t, F.lit(some[0]))
    for x in some[1:]:
        held = held | F.contains(t, F.lit(x))
    return held


def _chain(t: Column, steps: list[tuple[str, str]]) -> Column:
    """All steps in their order; each one's input is bound once, so a step that can't change a text costs a search for a character."""

    def step(k: int, pattern: str, replacement: str):
        def run(t: Column) -> Column:
            new = F.regexp_replace(t, pattern, replacement)
            if k == len(steps) - 1:
                return F.trim(t)  # all white space is spaces by now
            return F.when(_holds(t, NEEDS[k]), new).otherwise(t) if k in NEEDS else new

        return run

    out = F.array(t)
    for k, (pattern, replacement) in enumerate(steps):
        out = F.transform(out, step(k, pattern, replacement))
    return out[0]


def clean_text(c: Column) -> Column:
    """Null becomes empty; a text that is left ends in a full stop, exclamation or question mark."""
    out = F.array(F.coalesce(c.cast("string"), F.lit("")))
    out = F.transform(out, lambda t: F.when(_holds(t, RARE), _chain(t, STEPS)).otherwise(_chain(t, PLAIN)))
    return F.transform(out, lambda t: F.when((t != "") & ~t.rlike(r"[.!?]\z"), F.concat(t, F.lit("."))).otherwise(t))[0]


def clean_references(refs: DataFrame) -> DataFrame:
    """Cleans texto_normativo_es and texto_normativo_en; a null text stays null (the key is absent)."""
    names = [c for c in ("texto_normativo_es", "texto_normativo_en") if c in refs.columns]
    return refs.withColumns({c: F.when(F.col(c).isNotNull(), clean_text(F.col(c))) for c in names})


def clean_counts(refs: DataFrame) -> DataFrame:
    """total, cleaned_es, cleaned_en."""
    return refs.agg(F.count(F.lit(1)).alias("total"), F.count("texto_normativo_es").alias("cleaned_es"), F.count("texto_normativo_en").alias("cleaned_en"))


def sql(expr: str) -> str:
    """The same chain as DuckDB SQL."""
    out = f"coalesce({expr}, '')"
    for pattern, replacement in STEPS:
        rep = replacement.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{rep}', 'g')"
    return out
