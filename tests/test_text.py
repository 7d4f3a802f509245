"""Hand-made cases of tokens, sentences, syllables, readability and cleaning."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucidreq.functions import text as T
from lucidreq.operators import cleaning
from lucidreq.operators.readability import readability_en, readability_es


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, n",
    [("Use AES-256 and TLS 1.3. Next step", 1), ("v1..5", 1), ("...", 1), ("One. Two! Three?", 3), ("", 0), ("no end", 1), ("a?! b", 2)],
)
def test_sentences(spark, text, n):
    assert one(spark, text, lambda c: T.sentence_count(T.squeeze(c))) == n


@pytest.mark.parametrize("text, tokens", [("ISO/IEC-27001 v1.3.", ["ISO/IEC-27001", "v1.3"]), ("½ litre", ["½", "litre"]), ("-a- b", ["a", "b"]), ("", [])])
def test_tokens_en(spark, text, tokens):
    assert one(spark, text, T.tokens_en) == tokens


def test_tokens_es_lose_numbers(spark):
    assert one(spark, "año 2024 a-1 x_y", T.tokens_es) == ["año", "a", "xy"]


@pytest.mark.parametrize("word, n", [("the", 1), ("make", 1), ("apple", 1), ("rhythm", 1), ("2024", 0), ("security", 4), ("reading", 2)])
def test_syllables_en(spark, word, n):
    assert one(spark, word, T.syllables_en) == n


@pytest.mark.parametrize("word, n", [("país", 1), ("año", 2), ("y", 1), ("seguridad", 4), ("2024", 0)])
def test_syllables_es(spark, word, n):
    assert one(spark, word, T.syllables_es) == n


def test_white_space(spark):
    assert one(spark, " a  b\n", T.squeeze) == "a b"
    assert one(spark, " a  b\n", T.strip) == "a  b"
    assert one(spark, None, T.squeeze) == ""


def test_short_texts_have_no_metrics(spark):
    nine, ten = " ".join(["word"] * 9) + ".", " ".join(["word"] * 10) + "."
    rows = readability_en(spark.createDataFrame([(nine,), (ten,), (None,), ("",)], "text string")).collect()
    assert [r.words for r in rows] == [9, 10, 0, 0]
    assert [r.flesch is None for r in rows] == [True, False, True, True]
    assert [r.sentences for r in rows] == [1, 1, 0, 0]
    es = readability_es(spark.createDataFrame([(ten,), (None,)], "text string")).collect()
    assert es[0].ifsz == es[0].inflesz and es[0].mu is None and es[1].words == 0


@pytest.mark.parametrize(
    "text, want",
    [
        (None, ""),
        ("  ", ""),
        ("Artículo 33.1 - (1) Texto;", "Texto."),
        ("[op.pl.2] a) Uno; b) Dos:", "Uno, Dos."),
        ("Refuerzo R1- x", "x."),
        ("**Fin**", "Fin."),
        ("Ya!", "Ya!"),
    ],
)
def test_cleaning(spark, text, want):
    assert one(spark, text, cleaning.clean_text) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aeyBcé 1.!?-_/\n (;:)", max_size=40), min_size=1, max_size=40))
def test_cleaning_equals_sql(spark, texts):
    import duckdb

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cleaning.clean_text(F.col("t")).alias("c"))
    con = duckdb.connect()
    con.execute("create table d (i int, t varchar)")
    con.executemany("insert into d values (?, ?)", list(enumerate(texts)))
    sql = f"select i, case when c <> '' and not regexp_matches(c, '[.!?]$') then c || '.' else c end as c from (select i, {cleaning.sql('t')} as c from d) order by i"
    assert [(r.i, r.c) for r in rows.orderBy("i").collect()] == con.execute(sql).fetchall()


def test_whole_text_counts_equal_those_of_single_tokens(spark):
    """Syllables and long words by searches of the whole text, against the token-wise rule, on all short words and fuzzed texts."""
    import itertools
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("aeyb", repeat=n)]
    texts = [(w,) for w in words] + [(" ".join("".join(r.choice("aeiouyzbcdéE1-./_ ") for _ in range(r.randrange(30))) for _ in range(6)),) for _ in range(2000)] + [("",), ("é 1 ½",), ("İzmir queue agree the",)]
    df = spark.createDataFrame(texts, "t string").withColumn("k", T.tokens_en(F.col("t")))
    df = df.select("t", F.transform("k", T.syllables_en).alias("s"), T.letters_en(F.col("k")).alias("l"))
    bad = df.select("t", T.total(F.col("s")).alias("a"), T.syllable_total_en(F.col("l")).alias("b"), F.size(F.filter("s", lambda x: x >= 3)).alias("c"), T.polysyllables_en(F.col("l")).alias("d")).where("a <> b or c <> d")
    assert bad.collect() == []
