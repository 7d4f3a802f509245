"""Lemmas by hand-made cases; subjectivity in context against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lucidreq.functions import lemmas
from lucidreq.functions import opinions as O
from lucidreq.operators import smells, subjectivity


def column(spark, texts, expr):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expr(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


ENGLISH = {
    "The user's requests aren't processed.": "the user request be process",
    "policies classes boxes analysis status": "policy class box analysis status",
    "storing, creating; stopped (planned) agreed": "store create stop plan agree",
    "thing bring red need during": "thing bring red need during",
    "well-known / e.g. v2 3.5 can’t": "well know e.g. v2 3.5 can",
    "": "",
    "!!": "",
}
SPANISH = {
    "Las obligaciones están definidas": "el obligación estar definido",
    "Los responsables informarán (art. 5) de los fines": "el responsable informar art. 5 de el fine",
    "procesando datos personales, más países": "procesar dato personal más país",
    "dos luces": "do luz",
}


@pytest.mark.parametrize("lang, cases", [("en", ENGLISH), ("es", SPANISH)])
def test_lemmas(spark, lang, cases):
    assert dict(zip(cases, column(spark, cases, lambda c: lemmas.preprocess(c, lang)))) == cases


def test_lemmas_of_null_long_and_own_tables(spark):
    assert column(spark, [None, "runs " * 200_000], lambda c: F.size(lemmas.lemmas(c, "en"))) == [0, 200_000]
    own = column(spark, ["foxen ran", "oxen"], lambda c: lemmas.lemmas(c, "en", rules=[lemmas.Rule("en", "")], exceptions={"ran": "run"}))
    assert own == [["fox", "run"], ["ox"]]
    assert column(spark, ["the cats"], lambda c: lemmas.preprocess(c, "en", ["the"])) == ["cat"]


def plain_opinions(text):
    low = re.sub(r"\s+|_", " ", text or "").lower()
    for phrase, joined in subjectivity.PHRASES.items():
        low = low.replace(phrase, joined)
    tokens = re.findall(r"\w+(?:'t\w*)?|[.!?;:,]", low.replace("’", "'"))
    out = []
    for i, w in enumerate(tokens):
        if w not in O.WEIGHTS:
            continue
        degree, negated = None, False
        for t in reversed(tokens[max(0, i - O.SCOPE) : i]):
            if t in O.BREAKS:
                break
            if degree is None and t in O.DEGREES:
                degree = O.DEGREES[t]
            negated = negated or t in O.NEGATIONS or t.endswith(O.NEGATED_END)
        out.append((i, w, min(1.0, O.WEIGHTS[w] * (degree or 1.0)) * (O.NEGATED if negated else 1.0)))
    return out


def test_opinions_equal_plain_python(spark):
    rng = random.Random(5)
    parts = [*list(O.WEIGHTS)[::4], *list(O.DEGREES)[::3], *O.NEGATIONS, *O.BREAKS, "isn't", "can’t", "system", "Señal", "take into account", "as possible", "mistake into account", "\n"]
    texts = [None, "", "good", "GOOD good", *[" ".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]]
    got = column(spark, texts, subjectivity.opinions)
    for text, own in zip(texts, got):
        want = plain_opinions(text)
        assert [(o.place, o.word) for o in own] == [w[:2] for w in want], text
        assert [o.weight for o in own] == pytest.approx([w[2] for w in want]), text
    scores = column(spark, texts, subjectivity.contextual_score)
    assert scores == pytest.approx([sum(w[2] for w in x) / len(x) if x else 0.0 for x in map(plain_opinions, texts)])


def test_context_matters(spark):
    scores = column(spark, ["very good", "good", "slightly good", "not good", "not so, good", "not now or then good"], subjectivity.contextual_score)
    assert scores == pytest.approx([0.78, 0.6, 0.36, 0.3, 0.6, 0.6])


def test_as_a_rule_of_smells(spark):
    rows = spark.createDataFrame([("a", "The tool shall be very good."), ("b", "The tool shall not be good.")], "req_id string, text string")
    out = smells.detect_smells(rows, hide_clean=False, subjectivity=subjectivity.contextual_score).select("ID", F.col("`Subjectivity Detected`").alias("s"))
    assert {r.ID: r.s for r in out.collect()} == {"a": "Subjectivity Score: 0.78", "b": None}
