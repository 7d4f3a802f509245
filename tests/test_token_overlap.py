"""Token matching in tiles: the same best references as scoring every pair in a row."""

import random

import pyspark.sql.functions as F
import pytest

from lucidreq.operators import consistency
from lucidreq.operators import token_overlap as V

from .test_vector_blocks import shuffled


def sides(spark, n=160):
    r = random.Random(7)
    words = [chr(97 + k % 26) * (1 + k // 26) for k in range(60)]
    some = lambda: [r.choice(words[: r.choice([4, 20, 60])]) for _ in range(r.choice([0, 1, 5, 30]))]
    ids = lambda: r.choice(["hot", "hot", "hot", "a", "b", "only", None])
    token_lists = [some() for _ in range(n)] + [None, [None, "a"], ["zz"]]
    reqs = [(k, ids(), f"t{k % 3}", r.choice([None, " \n", *["x"] * 8]), r.choice(token_lists)) for k in range(n)]
    refs = [(7 * k % 1009, r.choice(["hot", "hot", "a", "b", "other", None]), r.choice([None, *["text"] * 6]), f"law {k}", r.choice(token_lists)) for k in range(n)]
    return spark.createDataFrame(reqs, "pos long, id string, title string, text string, tokens array<string>"), spark.createDataFrame(refs, "ref_pos long, id string, text string, legal_reference string, tokens array<string>")


def every_pair(reqs, refs):
    return consistency.best_by_token_match(reqs, refs, lambda a, b: consistency.token_match(a, b))


def test_tiles_equal_every_pair(spark):
    reqs, refs = sides(spark)
    want = sorted(map(repr, every_pair(reqs, refs).collect()))
    assert len(want) > 80
    assert sorted(map(repr, consistency.best_by_token_match(reqs, refs).collect())) == want
    own = reqs.where("id is not null and trim(translate(text, '\n', '')) <> ''")
    for part, dense in ((6000, 0), (20000, 3), (1 << 30, 512)):
        found = V.best_overlaps(own, refs.where("text is not null"), part, dense)
        rank = F.struct((-F.round("s.f1", 12)).alias("f"), "ref_pos")
        best = found.groupBy("pos").agg(F.min_by(F.struct("s", "ref_pos"), rank).alias("b")).join(refs, F.col("b.ref_pos") == F.col("ref_pos"))
        got = {r.pos: (r.precision, r.recall, r.f1, r.legal_reference) for r in best.select("pos", "b.s.*", "legal_reference").collect()}
        assert got == {r.pos: (r.precision, r.recall, r.f1, r.best_legal_reference) for r in every_pair(reqs, refs).collect()}


def test_no_row_for_a_pair(spark, monkeypatch):
    """Requirements and references of one id meet in tiles; the scorer of single pairs isn't called."""
    reqs, refs = sides(spark)
    monkeypatch.setattr(consistency, "salted_join", lambda *a: pytest.fail("a row for each pair"))
    assert consistency.best_by_token_match(reqs, refs).count() > 80


def test_a_pack_holds_what_its_rows_hold():
    import collections

    import pyarrow as pa

    rows = [["b", "a", "b", None], [], None, ["a"], ["c", "a", "b"], [None], ["ñ", "", "ñ"]]
    table = pa.table({"place": pa.array(range(9, 2, -1), pa.int64()), "title": ["t", None, *"abcde"], "tokens": pa.array(rows, pa.list_(pa.string()))})
    pack = V.Pack(pa.py_buffer(V._pack(table.slice(0, 3))))
    assert (pack.place.to_pylist(), pack.title.to_pylist(), pack.sizes.tolist()) == ([9, 8, 7], ["t", None, "a"], [4, 0, 0])
    pack = V.Pack(pa.py_buffer(V._pack(table)))
    for k, tokens in enumerate(rows):
        some = slice(pack.ends[k], pack.ends[k + 1])
        got = dict(zip(pack.words.take(pa.array(pack.code[some])).to_pylist(), pack.count[some].tolist(), strict=True))
        assert got == collections.Counter(t for t in tokens or [] if t is not None) and pack.sizes[k] == len(tokens or []) and (pack.row[some] == k).all()


def test_packs_are_sent_and_texts_that_nobody_chose_are_not(spark):
    """Before, the tokens went to each tile one by one and every reference's text was shuffled: 6 MB here."""
    r = random.Random(8)
    words = [f"{r.getrandbits(64):016x}" for _ in range(400)]
    lists = [[r.choice(words) for _ in range(300)] for _ in range(640)]
    row = lambda k, kind: (k, "one", f"{kind} {k}", f"{r.getrandbits(32000):x}", lists[k])
    reqs = spark.createDataFrame([row(k, "t") for k in range(40)], "pos long, id string, title string, text string, tokens array<string>")
    refs = spark.createDataFrame([row(k, "law") for k in range(40, 640)], "ref_pos long, id string, legal_reference string, text string, tokens array<string>")
    rows = []
    _, sent = shuffled(spark, lambda: rows.extend(consistency.best_by_token_match(reqs, refs).collect()))
    assert len(rows) == 40 and sent < 1_500_000


def test_results_stay_in_partitions(spark):
    """Few chosen texts come in many results; adaptive execution may not put them into one partition for the texts' size."""
    reqs, refs = sides(spark)
    assert consistency.best_by_token_match(reqs, refs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
