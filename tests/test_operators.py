"""Smells, reports, redundancy, consistency, files: hand-made cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lucidreq.operators import consistency, order_statistics, redundancy, smell_report, smells, vectors
from lucidreq.operators.graph import connected_components, merged_components
from lucidreq.sources import readers, writers


def test_smells(spark):
    rows = [("1", "The system shall secure the data, e.g. a table and MAY be normal."), ("2", None), ("3", "It provides a thing"), ("4", "It shall do x")]
    out = {r.ID: r for r in smells.detect_smells(spark.createDataFrame(rows, "req_id string, text string")).collect()}
    assert set(out) <= {"1", "3", "4"}
    one = out["1"]
    assert one["Ambiguity Detected"] == "MAY, normal" and one["Security Related"] is True and one["Not a Requirement"] is None
    assert one["References"] == "e.g.: 1\ntable: 1" and one["Vagueness"] == "normal: 1" and one["Conjunction"] == "and: 1\nnor: 1\nor: 1"
    assert one["Optionality"] is None  # counters tell upper from lower case
    assert out["3"]["Not a Requirement"] is True


def test_smells_default_rules_and_extra_rule(spark):
    df = spark.createDataFrame([("1", "shall TODO")], "req_id string, text string")
    smells.register_rule("Todo", lambda t: F.when(t.contains("TODO"), F.lit("open")))
    try:
        row = smells.detect_smells(df, all_checks=False).first()
        assert row["Todo"] == "open" and "Optionality" not in row.asDict()
    finally:
        smells._EXTRA.clear()


@pytest.mark.parametrize("n, at", [(1, 0), (5, 3), (7, 5), (11, 9)])
def test_floor_percentile(spark, n, at):
    df = spark.createDataFrame([(i * 2,) for i in range(n)], "v int")
    assert order_statistics.floor_percentile(df, "v", 0.9, "p").first().p == at * 2


def test_matrices_match_as_the_column_expression_does(spark):
    """Ragged sides, empty and null ones, columns of any name; and real sizes against the plain formula."""
    import random

    import numpy as np

    from lucidreq.operators import token_matrices

    rng = random.Random(2)
    side = lambda: rng.choice([None, []]) if rng.random() < 0.2 else [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(rng.randint(1, 6))]
    rows = spark.createDataFrame([(i, "x", side(), side()) for i in range(60)], "`a.b` int, row string, a array<array<float>>, b array<array<float>>")
    want = {r[0]: r[1] for r in rows.select("`a.b`", consistency.greedy_match(F.col("a"), F.col("b"))).collect()}
    out = token_matrices.match_pairs(rows.repartition(3), "a", "b")
    assert out.columns == ["a.b", "row", "match"]
    for r in out.collect():
        assert r["row"] == "x" and tuple(r["match"]) == pytest.approx(tuple(want[r["a.b"]]), abs=1e-9)
    assert token_matrices.match_pairs(rows.where("false"), "a", "b").count() == 0
    gen = np.random.default_rng(1)
    a, b = gen.normal(size=(256, 768)), gen.normal(size=(8200, 768))
    p, r, _ = token_matrices.match(a, b)
    assert (p, r) == pytest.approx(((a @ b.T).max(axis=1).mean(), (a @ b.T).max(axis=0).mean()))
    with pytest.raises(Exception, match="one length"):
        token_matrices.match_pairs(spark.createDataFrame([([[1.0], [1.0, 2.0]], [[1.0]])], "a array<array<double>>, b array<array<double>>"), "a", "b").collect()


def test_order_statistics_of_many_values(spark):
    """Doubles with ties, both zeros, nulls and extreme sizes, and longs beyond the precision of doubles, against a sort."""
    import numpy as np

    x = F.rand(3)
    rows = spark.range(150_000).select(
        F.when(x < 0.1, F.lit(None)).when(x < 0.4, F.lit(1.5)).when(x < 0.41, F.lit(-0.0)).when(x < 0.7, F.exp(F.randn(5) * 90)).otherwise(-F.exp(F.randn(6))).alias("a.x"),
        (F.lit(2**60) + F.pmod(F.col("id") * 7919, F.lit(20_011))).alias("big"),
        F.lit(None).cast("double").alias("none"),
    )
    rows = rows.persist()
    try:
        got = {r.metric: r for r in order_statistics.order_statistics(rows, ["a.x", "big", "none"], {"low": 0.05, "p90": 0.9, "most": 1.0}).collect()}
        own = np.sort(np.array([r[0] for r in rows.select("`a.x`").where("`a.x` is not null").collect()]))
        n = len(own)
        assert got["a.x"].n == n
        assert [got["a.x"].low, got["a.x"].p90, got["a.x"].most] == [own[int(0.05 * (n - 1))], own[int(0.9 * (n - 1))], own[-1]]
        assert got["a.x"].median == (own[(n - 1) // 2] + own[n // 2]) / 2
        big = np.sort(np.array([r[0] for r in rows.select("big").collect()]))
        places = [0, 23_456, 75_000, 149_999]
        found = order_statistics.values_at(rows, {"big": places}, {"big": 150_000})
        assert [found[("big", k)] for k in places] == [int(big[k]) for k in places]
        assert tuple(got["none"]) == ("none", 0, None, None, None, None)
    finally:
        rows.unpersist()


def test_order_statistics_of_little(spark):
    rows = spark.createDataFrame([(float("nan"),), (2.0,), (None,), (1.0,)], "v double")
    r = order_statistics.order_statistics(rows, ["v"], {"p0": 0.0, "p1": 1.0}).first()
    assert (r.n, r.median, r.p0) == (3, 2.0, 1.0) and math.isnan(r.p1)
    assert order_statistics.order_statistics(rows.where("false"), ["v"], {"p": 0.9}).collect() == [("v", 0, None, None)]
    assert order_statistics.floor_percentile(rows.where("false"), "v", 0.9, "p").first().p is None


def test_report(spark):
    reqs = spark.createDataFrame([(0, "a", "x"), (1, "b", ""), (2, "a", "y"), (3, "c", "z")], "pos int, req_id string, text string")
    found = spark.createDataFrame(
        [(0, "a", "own a", None, None), (1, "b", " own b ", "may: 1", True), (2, None, "no id", "may: 1", True), (3, "a", "last a", "can: 1", None)],
        "n int, ID string, Requirement string, Optionality string, `Security Related` boolean",
    )
    rows = {r.req_id: r for r in smell_report.by_requirement(reqs, found, order="n").collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].text, rows["a"].issues_count, rows["a"].negative_smells_list) == ("y", 1, "Optionality")
    assert (rows["b"].text, rows["b"].security_related) == ("own b", True)
    assert (rows["c"].issues_count, rows["c"].in_output) == (0, False)
    s = smell_report.summary(smell_report.by_requirement(reqs, found, order="n")).first()
    assert (s.total_requirements, s.missing_in_output, s.total_issues, s.clean_count, s.issues_p90) == (3, 1, 2, 1, 1)
    only = smell_report.by_requirement(None, found, ["Conjunction", "Conjunction"], order="n")
    assert only.count() == 2 and [c for c in only.columns if c.startswith("smell__")] == ["smell__Conjunction"]
    assert smell_report.parse_names(" a, ,b,a") == ["a", "b"]
    assert smell_report.summary_pairs(smell_report.summary(only)).count() == 13


def test_report_without_findings(spark):
    reqs = spark.createDataFrame([(0, "a", "x")], "pos int, req_id string, text string")
    none = smells.detect_smells(reqs.where("false"))
    s = smell_report.summary(smell_report.by_requirement(reqs, none)).first()
    assert (s.total_requirements, s.missing_in_output, s.clean_percent) == (1, 1, 100.0)


def _unit(*xs):
    n = math.sqrt(sum(x * x for x in xs))
    return [x / n for x in xs]


def test_redundancy(spark):
    # a-b and b-c are close, a-c is not: one chain; d is alone; ids repeat on purpose.
    vec = [_unit(1, 0), _unit(1, 0.45), _unit(1, 1), _unit(-1, 0)]
    v = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(zip(["a", "b", "b", "d"], vec))], "pos long, id string, vec array<double>")
    pairs = redundancy.redundant_pairs(v, 0.9, block=2)
    assert sorted((r.pos_a, r.pos_b) for r in pairs.collect()) == [(0, 1), (1, 2)]
    metrics = {r.pos: r for r in redundancy.requirement_metrics(v, pairs).collect()}
    assert [metrics[i].degree_t for i in range(4)] == [1, 2, 1, 0]
    want = sum(sum(x * y for x, y in zip(vec[0], vec[j])) for j in (1, 2, 3)) / 3
    assert metrics[0].mean_sim == pytest.approx(want)
    found = redundancy.clusters(v, pairs).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.size, r.representative, r.members) for r in found] == [(1, 3, "b", ["a", "b", "b"]), (2, 1, "d", ["d"])]
    s = redundancy.redundancy_summary(v, pairs).first()
    assert (s.n_requirements, s.n_pairs_total, s.n_pairs_redundant, s.n_clusters, s.redundant_requirements, s.redundancy_rate) == (4, 6, 2, 2, 3, 0.75)
    top = redundancy.redundant_pairs(v, -1.0, top_k=1, block=3).collect()
    assert {(r.pos_a, r.pos_b): (r.rank_from_a, r.rank_from_b) for r in top} == {(0, 1): (1, 0), (1, 2): (1, 1), (2, 3): (0, 0)} or all(r.rank_from_a or r.rank_from_b for r in top)
    assert redundancy.similarity_cells(v, block=3).count() == 16
    wide = redundancy.neighbour_ranks(v, 10, block=3).groupBy("pos").count().collect()
    assert all(r["count"] == 3 for r in wide)


def test_redundancy_of_nothing(spark):
    v = spark.createDataFrame([], "pos long, id string, vec array<double>")
    pairs = redundancy.redundant_pairs(v)
    assert pairs.count() == 0 and redundancy.clusters(v, pairs).count() == 0
    assert redundancy.redundancy_summary(v, pairs).first().redundancy_rate == 0.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 300), (500, 501)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 0 and got[100] == 100 and got[501] == 500


def test_merged_components(spark):
    """Components in two steps are those of all links at once, new nodes included."""
    import random

    r = random.Random(3)
    for _ in range(3):
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)]
        more = [(r.randrange(80), r.randrange(80)) for _ in range(12)]
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        once = {(x.node, x.component) for x in connected_components(frame(edges + more)).collect()}
        assert {(x.node, x.component) for x in merged_components(connected_components(frame(edges)), frame(more)).collect()} == once


def test_consistency(spark):
    reqs = spark.createDataFrame([(0, "1", "t", "x", [1.0, 0.0]), (1, "2", "t", "x", [1.0, 0.0]), (2, "1", "t", None, [0.0, 2.0])], "pos int, id string, title string, text string, vec array<double>")
    refs = spark.createDataFrame(
        [(0, "1", "first", "L0", "es", [2.0, 0.0]), (1, "1", "tie", "L1", "en", [4.0, 0.0]), (2, "1", " ", "L2", "en", [0.0, 1.0])],
        "ref_pos int, id string, text string, legal_reference string, original_language string, vec array<double>",
    )
    got = {r.pos: r for r in consistency.best_by_similarity(reqs, refs).collect()}
    assert (got[0].num_valid_references, got[0].best_legal_reference, got[0].best_cosine_similarity) == (2, "L0", 1.0)
    assert (got[1].num_valid_references, got[1].best_cosine_similarity) == (0, None)
    assert got[2].best_cosine_similarity == 0.0
    tok = F.split(F.coalesce("text", F.lit("")), " ")
    best = consistency.best_by_token_match(reqs.withColumn("tokens", tok), refs.withColumn("tokens", tok)).collect()
    assert [(r.pos, r.best_legal_reference) for r in best] == [(0, "L0")]


def test_hot_ids_are_split(spark):
    """One id with half of all references: the rows of the plain rule, and no part of the join over three times the median."""
    import random

    from lucidreq.operators.skew import salted_join

    r = random.Random(5)
    refs = [(k, "hot" if k % 2 else r.choice(["a", "b", None, f"n{r.randrange(300)}"]), f"t{k}", f"L{k}", "es", [float(r.randrange(1, 4)), float(r.randrange(4))]) for k in range(4000)]
    reqs = [(k, i, "t", "x", [1.0, float(k)]) for k, i in enumerate(["hot", "a", "hot", "none", None, "b", *[f"n{k}" for k in range(100)]])]
    left = spark.createDataFrame(reqs, "pos int, id string, title string, text string, vec array<double>")
    right = spark.createDataFrame(refs, "ref_pos int, id string, text string, legal_reference string, original_language string, vec array<double>")
    got = {x.pos: x for x in consistency.best_by_similarity(left, right).collect()}
    cos = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5
    for pos, i, _, _, v in reqs:
        own = [x for x in refs if x[1] == i and i is not None]
        best = min(own, key=lambda x: (-round(cos(v, x[5]), 12), x[0]), default=None)
        assert (got[pos].num_valid_references, got[pos].best_legal_reference) == (len(own), best and best[3])
    one = left.where("pos = 0").select("pos", "id")
    parts = salted_join(one.withColumn("x", F.lit(1)), right.select(F.col("id").alias("__id"), "ref_pos"), "id", "__id", "ref_pos", "inner")
    sizes = sorted(n for (n,) in parts.groupBy(F.pmod(F.xxhash64("ref_pos"), F.lit(32))).agg(F.count(F.lit(1)).alias("n")).select("n").collect())
    assert sum(sizes) == 2000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_greedy_match_of_one_hot_vectors_is_token_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]], ["a", "b"], ["a"])], "x array<array<double>>, y array<array<double>>, s array<string>, t array<string>")
    row = df.select(consistency.greedy_match(F.col("x"), F.col("y")).alias("g"), consistency.token_match(F.col("s"), F.col("t")).alias("m")).first()
    assert row.g == row.m and row.g.precision == 0.5 and row.g.recall == 1.0
    assert df.select(consistency.rescaled(F.lit(0.75), 0.5).alias("r")).first().r == 0.5


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0], [3.0, 4.0])], "t array<array<double>>, m array<int>, v array<double>")
    row = df.select(vectors.mean_pool(F.col("t"), F.col("m")).alias("p"), vectors.norm(F.col("v")).alias("n"), vectors.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert row.p == pytest.approx(_unit(1, 1)) and row.n == 5.0 and row.c == pytest.approx(1.0)
    texts = spark.createDataFrame([("The cat sat",), ("the CAT sat",), (None,)], "text string")
    a, b, c = (r.vec for r in vectors.HashingEncoder(16).encode(texts).collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1.0) and not any(c)
    model = vectors.ModelEncoder(lambda: lambda batch: [[float(len(t)), 1.0] for t in batch], batch_size=2)
    assert [list(r.vec) for r in model.encode(texts).collect()] == [[11.0, 1.0], [11.0, 1.0], [0.0, 1.0]]
    assert texts.select(vectors.preprocess(F.col("text"), ["the"]).alias("p")).first().p == "cat sat"
    with pytest.raises(ValueError):
        vectors.language_model("fr")


def _write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_catalog_files(spark, tmp_path):
    cat = _write(tmp_path / "c.json", {"catalog_id": "C", "requisitos": [{"id": 7, "titulo": "t", "descripcion": " d "}, {"id": "x"}, {"id": ""}]})
    rows = readers.read_catalog(spark, cat).collect()
    assert [(r.pos, r.id, r.title, r.text) for r in rows] == [(0, "7", "t", " d "), (1, "x", None, None), (2, "", None, None)]
    assert [r.text for r in readers.read_requirements(spark, cat).collect()] == [" d ", "", ""]
    assert [r.req_id for r in readers.smell_input(readers.read_catalog(spark, cat)).collect()] == ["7", "x", "REQ-0003"]
    bad = _write(tmp_path / "b.json", {"catalog_id": "C", "requisitos": [{"titulo": "no id"}]})
    with pytest.raises(Exception, match="id"):
        readers.read_catalog(spark, bad).collect()
    with pytest.raises(Exception, match="requisitos"):
        readers.read_catalog(spark, _write(tmp_path / "n.json", {"catalog_id": "C"})).collect()
    with pytest.raises(ValueError):
        readers.read_requirements(spark, "c.txt")


def test_reference_files(spark, tmp_path):
    ref = lambda i, lang, es, en: {"id": i, "referencia_normativa": "L", "idioma_normativo_original": lang, "texto_normativo_es": es, "texto_normativo_en": en}
    path = _write(tmp_path / "r.json", {"catalog_id": "C", "idioma_catalogo": "es", "referencias": [ref("1", "es", "hola", "hi"), ref("2", "en", "dos", "two"), ref("3", "desconocido", "tres", "x")]})
    assert [r.text for r in readers.read_references(spark, path).collect()] == ["hola", "two", ""]
    rows, lang = readers.read_references_strict(spark, path)
    assert lang == "es" and [r.text for r in rows.collect()] == ["hola", "dos", "tres"]
    assert readers.read_references_strict(spark, path, "en")[1] == "en"
    blank = _write(tmp_path / "k.json", {"catalog_id": "C", "idioma_catalogo": "en", "referencias": [ref("1", "es", "a", " ")]})
    with pytest.raises(Exception, match="lacks its text"):
        readers.read_references_strict(spark, blank)[0].collect()
    with pytest.raises(ValueError):
        readers.resolve_language("fr", None)
    assert readers.resolve_language("es", "en") == ("en", True)
    from lucidreq.operators.cleaning import clean_references

    doc, refs = readers.read_traceability(spark, path)
    out = writers.write_cleaned(doc, clean_references(refs), None, path)
    data = json.loads(out.read_text(encoding="utf-8"))
    assert out.name == "r_clean.json" and data["catalog_id"] == "C" and data["referencias"][0]["texto_normativo_es"] == "hola."


def test_rows_findings_and_writers(spark, tmp_path):
    rows = readers.read_rows(spark, _write(tmp_path / "i.json", [{"ID": "1", "Requirement": "shall x"}, {"ID": 2, "Requirement": None}]))
    assert [(r.req_id, r.text) for r in rows.collect()] == [("1", "shall x"), ("2", None)]
    found = readers.read_findings(spark, _write(tmp_path / "f.json", [{"ID": "1", "Requirement": "r", "Security Related": True, "Vagueness": "may: 1"}]))
    assert found.first()["Vagueness"] == "may: 1" and found.first()["Weakness"] is None
    pairs = spark.createDataFrame([(0, 1, "a", "ñ", 0.91, 0, 0), (0, 2, "a", "c", 0.95, 0, 0)], "pos_a int, pos_b int, id_a string, id_b string, score double, rank_from_a int, rank_from_b int")
    writers.single_csv(writers.pair_rows(pairs), tmp_path / "p.csv")
    raw = (tmp_path / "p.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines()[1] == "a;c;0.950000;0;0"
    writers.single_csv(writers.pair_rows(pairs.where("false")), tmp_path / "e.csv")
    assert (tmp_path / "e.csv").read_text("utf-8-sig").startswith("id_a;id_b")
    writers.single_json(found, tmp_path / "o.json", drop_null=True)
    assert json.loads((tmp_path / "o.json").read_text())[0] == {"ID": "1", "Requirement": "r", "Security Related": True, "Vagueness": "may: 1"}
    writers.single_json(found.where("false"), tmp_path / "n.json")
    assert json.loads((tmp_path / "n.json").read_text()) == []
    v = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "pos long, id string, vec array<double>")
    cells = redundancy.similarity_cells(v)
    writers.single_matrix_csv(cells, tmp_path / "m.csv")
    assert (tmp_path / "m.csv").read_text("utf-8-sig").splitlines() == [";a;b", "a;1.0;0.0", "b;0.0;1.0"]
    assert writers.matrix(cells).count() == 2
    writers.write_csv(pairs, str(tmp_path / "dir"))
    assert spark.read.csv(str(tmp_path / "dir"), sep=";", header=True).count() == 2
    assert writers.run_dir(tmp_path, "x").is_dir()
    m = writers.with_run_columns(redundancy.requirement_metrics(v, redundancy.redundant_pairs(v)), "C", "es", 0.9, None).first()
    assert (m.catalog_id, m.top_k, m.degree_t) == ("C", -1, 0)
    writers.single_record(redundancy.redundancy_summary(v, redundancy.redundant_pairs(v)), tmp_path / "s.json", params={"threshold": 0.9})
    assert json.loads((tmp_path / "s.json").read_text())["params"] == {"threshold": 0.9}


def test_two_decimals_follow_the_exact_value(spark):
    values = [0.125, 0.375, 0.715, 0.555, 0.545, 1.005, -3.145, 29.995, 0.996, -0.001, 0.005, 0.015, 0.0, 1.0, -12.5, 0.1 + 0.2, 28.275, 2.675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", smells.two_decimals(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.2f}" for r in got]
