"""The chain of replacements: the same whatever white space a text holds, and worked out once when it is written."""

import random

import pyspark.sql.functions as F

from lucidreq.operators import cleaning
from lucidreq.sources import writers


def plain(c):
    """Every step on every text."""
    out = F.array(F.coalesce(c, F.lit("")))
    for pattern, replacement in cleaning.STEPS:
        out = F.transform(out, (lambda p, r: lambda t: F.regexp_replace(t, p, r))(pattern, replacement))
    return F.transform(out, lambda t: F.when((t != "") & ~t.rlike(r"[.!?]\z"), F.concat(t, F.lit("."))).otherwise(t))[0]


def test_any_white_space(spark):
    r = random.Random(5)
    bits = ["a", "B", "1", "2.", " ", "  ", "\n", "\t", "\x0b", ",", ".", ":", ";", "(", ")", "[", "]", "-", "–", "**", "!", "º", "x)", "Refuerzo R1- ", "Artículo 3.1: "]
    texts = ["", " ", None, *("".join(r.choice([*bits, *rare]) for _ in range(r.randint(1, 25))) for rare in ([], cleaning.RARE[:6], cleaning.RARE) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(~cleaning.clean_text(F.col("text")).eqNullSafe(plain(F.col("text")))).count() == 0


def test_written_texts_are_cleaned_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    own = spark.range(200).repartition(5).selectExpr("cast(id as int) ref_pos", "'a; ' texto_normativo_es").mapInPandas(counted, "ref_pos int, texto_normativo_es string")
    refs = cleaning.clean_references(own.selectExpr("ref_pos", "parse_json('{\"id\": 1}') reference", "texto_normativo_es", "'b ' texto_normativo_en"))
    head = spark.sql("select parse_json('{}') document")
    writers.write_cleaned(head, refs, f"file:{tmp_path}/clean.json", f"{tmp_path}/x.json")
    assert (tmp_path / "clean.json").read_text().count('"a."') == 200 and seen.value == 200
