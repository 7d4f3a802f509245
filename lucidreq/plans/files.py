"""Registered queries of readers and writers: files made from the tables, written, read back, held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import cleaning, consistency, readability, redundancy, smell_report, smells, token_matrices, vectors
from ..sources import readers, writers
from ..sources.json_document import read_document
from ..sources.workbook import read_workbook, write_workbook
from ..storage import materialize, scratch_path
from . import catalog as C

#: Token ids kept of a text, the dimensions and the batch of the query that runs a model function.
MAX_LENGTH, DIMS, BATCH = 256, 4, 32


def _folder(spark: SparkSession) -> str:
    return scratch_path(spark, "files")


def _docs(spark, sf_dir) -> DataFrame:
    return C._table(spark, sf_dir, "documents")


def _place() -> F.Column:
    return F.col("doc_id")


def _document(rows: DataFrame, spark: SparkSession, entry: str, item: F.Column, **keys) -> str:
    """The path of a JSON document with a list of items in order of doc_id."""
    path = f"{_folder(spark)}/document.json"
    writers.single_document(rows.orderBy("doc_id"), F.to_json(item), path, entry, keys)
    return path


def _lines(spark: SparkSession, path: str, head: str | None = None) -> DataFrame:
    """line_no and line of a text file or a folder of such, in its order; ``head`` is a line that each file begins with, and counts once."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    if head is not None:
        first = F.element_at(F.split(F.lit(writers.first_file(spark, path)), "/"), -1)
        rows = rows.where((F.col("line") != head) | F.endswith("file", first))
    return redundancy.numbered(rows, "line_no", F.col("file"), F.col("block"), F.col("at")).select(F.col("line_no").cast("int").alias("line_no"), "line")


def _marked(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with the byte-order mark of UTF-8."""
    at = spark._jvm.org.apache.hadoop.fs.Path(writers.first_file(spark, path))
    data = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return [data.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        data.close()


# ------------------------------------------------------------------- catalogs and references


def _catalog_file(spark, sf_dir) -> str:
    item = F.struct(
        F.concat(F.lit("R"), _place()).alias("id"),
        F.when(_place() % 4 != 0, F.concat(F.lit("title "), _place())).alias("titulo"),
        F.when(_place() % 5 != 0, F.col("text")).alias("descripcion"),
    )
    return _document(_docs(spark, sf_dir), spark, "requisitos", item, catalog_id="C1")


def catalog_file(spark, sf_dir):
    rows = readers.read_catalog(spark, _catalog_file(spark, sf_dir))
    return rows.select("catalog_id", "pos", "id", "title", F.md5("text").alias("text_md5"))


def requirements_file(spark, sf_dir):
    """Absent titles and texts are empty."""
    path = _catalog_file(spark, sf_dir)
    rows = readers.read_catalog(spark, path, strict=False)
    own = readers.requirement_rows(rows)
    return own.select("pos", "id", "title", F.md5("text").alias("text_md5"))


def _reference_item(lenient: bool) -> F.Column:
    lang = F.when(_place() % 3 == 0, F.lit("es")).when(_place() % 3 == 1, F.lit("en"))
    return F.struct(
        F.concat(F.lit("G"), _place() % 50).alias("id"),
        (F.when(_place() % 7 != 0, F.concat(F.lit("law "), _place())) if lenient else F.concat(F.lit("law "), _place())).alias("referencia_normativa"),
        (lang if lenient else F.coalesce(lang, F.lit("desconocido"))).alias("idioma_normativo_original"),
        (F.when(_place() % 6 != 0, F.concat(F.lit("es "), F.col("text"))) if lenient else F.concat(F.lit("es "), F.col("text"))).alias("texto_normativo_es"),
        F.concat(F.lit("en "), F.col("text")).alias("texto_normativo_en"),
    )


def references_file(spark, sf_dir):
    """In the original language; unknown languages and absent texts are empty."""
    path = _document(_docs(spark, sf_dir), spark, "referencias", _reference_item(True), catalog_id="C1", idioma_catalogo="es")
    return readers.read_references(spark, path).select("ref_pos", "id", "legal_reference", "original_language", F.md5("text").alias("text_md5"))


def references_file_in_use(spark, sf_dir):
    """All in the language asked for, whatever the catalog's."""
    path = _document(_docs(spark, sf_dir), spark, "referencias", _reference_item(False), catalog_id="C1", idioma_catalogo="es")
    rows, lang = readers.read_references_strict(spark, path, "en")
    return rows.select("ref_pos", "id", "legal_reference", "original_language", F.md5("text").alias("text_md5"), F.lit(lang).alias("used"))


def cleaned_file(spark, sf_dir):
    """The cleaned document keeps keys that nobody knows beforehand."""
    norm = C._norms(spark, sf_dir).withColumn("note", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("note "), F.col("doc_id"))))
    item = F.struct(
        F.concat(F.lit("G"), F.col("doc_id")).alias("id"),
        F.when(F.col("lang") == "es", F.col("text")).alias("texto_normativo_es"),
        F.when(F.col("lang") != "es", F.col("text")).alias("texto_normativo_en"),
        F.struct(F.col("note").alias("nested")).alias("extra"),
    )
    path = _document(norm, spark, "referencias", item, catalog_id="C1", unknown="kept")
    head, refs = readers.read_traceability(spark, path)
    clean = f"{path.removesuffix('.json')}_clean.json"
    writers.write_cleaned(head, cleaning.clean_references(refs), clean, path)
    again = read_document(spark, clean, "referencias")
    own = lambda k: F.get_json_object("json", f"$.{k}")
    out = again.elements.select(F.col("place").alias("ref_pos"), own("id").alias("id"), own("extra.nested").alias("note"), F.md5(own("texto_normativo_es")).alias("es_md5"), F.md5(own("texto_normativo_en")).alias("en_md5"))
    return out.crossJoin(F.broadcast(again.rest.select(F.get_json_object("value", "$.unknown").alias("unknown"))))  # one row


def requirements_workbook(spark, sf_dir):
    """A sheet of requirements; empty cells are null."""
    rows = _docs(spark, sf_dir).orderBy("doc_id").select(
        F.concat(F.lit("R"), _place()).alias("ID"), F.when(_place() % 4 != 0, F.concat(F.lit("title "), _place())).alias("Título"), (_place() % 7).alias("other"), F.when(_place() % 5 != 0, F.col("text")).alias("Texto")
    )
    path = f"{_folder(spark)}/requirements.xlsx"
    write_workbook({"Hoja 1": rows}, path)
    return readers.read_requirements(spark, path).select("pos", "id", "title", F.md5("text").alias("text_md5"))


def references_workbook(spark, sf_dir):
    """A sheet of references that lacks a column, which gets its default."""
    rows = _docs(spark, sf_dir).orderBy("doc_id").select(F.concat(F.lit("es "), F.col("text")).alias("Texto"), F.concat(F.lit("law "), _place()).alias("Referencia_normativa"), _place().alias("ID"))
    path = f"{_folder(spark)}/references.xlsx"
    write_workbook({"Referencias": rows}, path)
    return readers.read_references(spark, path).select("ref_pos", "id", "legal_reference", "original_language", F.md5("text").alias("text_md5"))


def pairs_workbook(spark, sf_dir):
    path = f"{_folder(spark)}/pairs.xlsx"
    writers.write_pairs_workbook(C._pairs(spark, sf_dir, C.TOP_K)[1], path)
    rows = read_workbook(spark, path, ["id_a", "id_b", "score", "rank_from_a", "rank_from_b"], place="line_no")
    return rows.select("line_no", "id_a", "id_b", F.round(F.col("score").cast("double"), 6).alias("score"), F.col("rank_from_a").cast("int").alias("rank_from_a"), F.col("rank_from_b").cast("int").alias("rank_from_b"))


def report_workbook(spark, sf_dir):
    """The report's four sheets as (file, name, value)."""
    rows = materialize(C._report(spark, sf_dir), "report")
    path = f"{writers.write_report(rows, writers.local_path(_folder(spark)), 'smells', workbook=True)}/smells_report.xlsx"
    sheet = lambda name, columns: read_workbook(spark, f"file:{path}", columns, sheet=name)
    stats = sheet("SmellStats", ["smell", "count"]).select(F.lit("stats").alias("file"), F.col("smell").alias("name"), F.col("count").alias("value"))
    by = sheet("ByRequirement", ["req_id", "issues_count", "negative_smells_list"]).select(F.lit("requirement").alias("file"), F.col("req_id").alias("name"), F.concat_ws("|", "issues_count", F.coalesce("negative_smells_list", F.lit(""))).alias("value"))
    total = sheet("Summary", ["metric", "value"]).where(F.col("metric").isin("total_requirements", "total_issues", "clean_count", "issues_max", "issues_p90")).select(F.lit("summary").alias("file"), F.col("metric").alias("name"), "value")
    notes = sheet("Notes", ["note"]).select(F.lit("notes").alias("file"), F.lit("").alias("name"), F.col("note").alias("value"))
    return stats.unionByName(by).unionByName(total).unionByName(notes)


# ------------------------------------------------------------------- smells


def smell_rows_file(spark, sf_dir):
    """An array of objects with headers of one's own; rows without text drop out of the rules' input."""
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("R"), _place()).alias("Req Id"), F.when(_place() % 5 != 0, F.col("text")).alias("Body"))
    path = f"{_folder(spark)}/rows.json"
    writers.single_json(rows, path)
    found = smells.detect_smells(readers.read_rows(spark, path, "Req Id", "Body"), all_checks=False, hide_clean=False)
    return found.select(F.col("ID").alias("req_id"), F.md5("Requirement").alias("text_md5"))


def smell_messages(spark, sf_dir):
    """The messages of the rules that use a score, and the text, of every requirement that any rule found."""
    out = smells.detect_smells(C.requirements(spark, sf_dir))
    return out.select("ID", F.md5("Requirement").alias("requirement_md5"), F.col("Low Readability").alias("readability"), F.col("Subjectivity Detected").alias("subjectivity"))


def _findings_file(spark, sf_dir) -> str:
    """Findings with repeated ids (the later one has another text) and without some ids."""
    found = smells.detect_smells(C.requirements(spark, sf_dir), hide_clean=False).where(F.col("ID").cast("long") % 6 != 5)
    again = found.where(F.col("ID").cast("long") % 4 == 1).select(*[F.concat(F.lit(" again "), F.col("Requirement")).alias(c) if c == "Requirement" else F.lit(None).cast(t).alias(c) if c == "Weakness" else F.col(f"`{c}`") for c, t in found.dtypes])
    rows = found.withColumn("__o", F.lit(0)).unionByName(again.withColumn("__o", F.lit(1)))
    path = f"{_folder(spark)}/findings.json"
    writers.single_json(rows.orderBy("__o", F.col("ID").cast("long")).drop("__o"), path, ascii_only=True, drop_null=True)
    return path


def findings_file(spark, sf_dir):
    """Each record of the file, with its place."""
    out = readers.read_findings(spark, _findings_file(spark, sf_dir), "place")
    return out.select("place", "ID", F.md5("Requirement").alias("requirement_md5"), "Weakness", "Optionality", F.col("Security Related").alias("security"))


def report_from_files(spark, sf_dir):
    """Requirements with repeated ids (first place, last text), some with an empty text, some only under id; findings with repeated ids (the last counts)."""
    path = _findings_file(spark, sf_dir)
    docs = C.requirements(spark, sf_dir)
    empty = F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("first "), F.col("text")))
    given = F.when(F.col("pos") % 2 == 0, F.col("req_id"))
    rows = docs.select(F.lit(0).alias("o"), "pos", given.alias("req_id"), F.when(F.col("pos") % 2 == 1, F.col("req_id")).alias("id"), empty.alias("text"))
    last = docs.where("pos % 10 = 7").select(F.lit(1).alias("o"), "pos", F.col("req_id"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("last "), F.col("text")).alias("text"))
    writers.single_json(rows.unionByName(last).orderBy("o", "pos").drop("o", "pos"), f"{path.rsplit('/', 1)[0]}/nalabs_input.json")
    reqs = readers.requirements_or_findings(spark, path)
    out = smell_report.by_requirement(reqs, readers.read_findings(spark, path, "place"), order="place")
    return out.select("req_id", F.md5("text").alias("text_md5"), "security_related", "issues_count", "negative_smells_list", "in_output")


def report_from_findings(spark, sf_dir):
    """Without an input the findings' own ids are counted."""
    path = _findings_file(spark, sf_dir)
    reqs = readers.requirements_or_findings(spark, path)
    out = smell_report.by_requirement(reqs, readers.read_findings(spark, path, "place"), smell_report.parse_names("Weakness, ,Conjunction,Weakness"), order="place")
    return out.select("req_id", F.md5("text").alias("text_md5"), "issues_count", "negative_smells_list")


def report_files(spark, sf_dir):
    """The tables of the report's files as (file, name, value), and what its summary says of the settings."""
    rows = materialize(C._report(spark, sf_dir), "report")
    out = writers.write_report(rows, writers.local_path(_folder(spark)), "smells")
    stats = spark.read.csv(f"file://{out}/smells_SmellStats.csv", sep=";", header=True)
    stats = stats.select(F.lit("stats").alias("file"), F.col("smell").alias("name"), F.col("count").alias("value"))
    text = spark.read.csv(f"file://{out}/smells_ByRequirement.csv", sep=";", header=True, multiLine=True, quote='"', escape='"')
    by = text.select(F.lit("requirement").alias("file"), F.col("req_id").alias("name"), F.concat_ws("|", "issues_count", F.coalesce("negative_smells_list", F.lit(""))).alias("value"))
    total = spark.read.csv(f"file://{out}/smells_Summary.csv", sep=";", header=True).where(F.col("metric").isin("total_requirements", "total_issues", "clean_count", "issues_max", "issues_p90"))
    total = total.select(F.lit("summary").alias("file"), F.col("metric").alias("name"), "value")
    notes = spark.read.csv(f"file://{out}/smells_Notes.csv", sep=";", header=True).select(F.lit("notes").alias("file"), F.lit("").alias("name"), F.col("note").alias("value"))
    used = spark.read.json(f"file://{out}/smells_summary.json", multiLine=True)
    used = used.select(F.lit("json").alias("file"), F.lit("excluded_fields").alias("name"), F.array_join("excluded_fields", ",").alias("value"))
    return stats.unionByName(by).unionByName(total).unionByName(notes).unionByName(used)


def smell_input_file(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select(_place().alias("pos"), F.when(_place() % 3 > 0, F.concat(F.lit("R"), _place())).alias("id"), "text")
    path = f"{_folder(spark)}/nalabs_input.json"
    writers.single_json(readers.smell_input(rows).orderBy("pos").drop("pos"), path)
    return readers.requirements_or_findings(spark, "/none/findings.json", path).select("pos", "req_id", F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------- redundancy


def pairs_file(spark, sf_dir):
    """The lines of the pairs' file."""
    path = f"{_folder(spark)}/pairs.csv"
    writers.single_csv(writers.pair_rows(C._pairs(spark, sf_dir, C.TOP_K)[1]), path)
    mark = F.when((F.col("line_no") == 0) & F.lit(_marked(spark, path)), F.lit("BOM:")).otherwise(F.lit(""))  # readers of text skip it
    return _lines(spark, path, "id_a;id_b;score;rank_from_a;rank_from_b").select("line_no", F.concat(mark, "line").alias("line"))


def clusters_file(spark, sf_dir):
    path = f"{_folder(spark)}/clusters.json"
    writers.single_json(redundancy.clusters(*C._links(spark, sf_dir)).drop("root").orderBy("cluster_id"), path)
    rows = spark.read.schema("cluster_id int, size int, representative string, members array<string>").json(path, multiLine=True)
    return rows.withColumn("members", F.array_join("members", ","))


def redundancy_summary_file(spark, sf_dir):
    path = f"{_folder(spark)}/summary.json"
    writers.single_record(redundancy.redundancy_summary(*C._links(spark, sf_dir)), path, params={"threshold": C.PAIR_THRESHOLD, "top_k": None})
    rows = spark.read.json(path, multiLine=True)
    return C._rounded(rows.select("n_requirements", "n_pairs_total", "n_pairs_redundant", "n_clusters", "redundant_requirements", "redundancy_rate", F.col("params.threshold").alias("threshold")))


def matrix_file(spark, sf_dir):
    """The cells of the labelled matrix file. Heads are the lines with an empty first field; no id is empty here."""
    path = f"{_folder(spark)}/matrix.csv"
    writers.vectors_matrix_csv(C.vectors_of(spark, sf_dir), path)
    is_head = lambda df: df.withColumn("head", F.ltrim("line", F.lit("\ufeff")).startswith(";"))
    lines = is_head(spark.read.text(path).withColumnRenamed("value", "line")).where("not head").select(F.split("line", ";").alias("f"))
    # One row: all heads are the same.
    head = is_head(spark.read.text(writers.first_file(spark, path)).withColumnRenamed("value", "line")).where("head").limit(1).select(F.split("line", ";").alias("names"))
    cells = lines.crossJoin(F.broadcast(head)).select(F.col("f")[0].alias("id_a"), "names", F.posexplode("f").alias("k", "x")).where("k > 0")
    return cells.select("id_a", F.get("names", F.col("k")).alias("id_b"), F.round(F.nullif(F.col("x"), F.lit("")).cast("double"), 6).alias("score"))


def metrics_file(spark, sf_dir):
    v, p = C._links(spark, sf_dir)
    path = f"{_folder(spark)}/metrics.csv"
    writers.single_csv(writers.with_run_columns(redundancy.requirement_metrics(v, p), "C1", "en", C.PAIR_THRESHOLD, None), path)
    rows = spark.read.schema("catalog_id string, lang_used string, threshold double, top_k int, req_id string, mean_sim double, degree_t long").csv(path, sep=";", header=True)
    return C._rounded(rows)


# ------------------------------------------------------------------- readability and consistency


def readability_file(spark, sf_dir):
    """The nested records as read back, beside the flat ones."""
    docs = _docs(spark, sf_dir).where("lang = 'en'").select(F.lit("C1").alias("catalog_id"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), "text")
    rows = readability.readability_en(docs)
    metrics = ["flesch", "fkgl"]
    path = f"{_folder(spark)}/readability.json"
    writers.single_json(readability.nested_record(rows, readability.EN_COUNTS, metrics), path)
    back = spark.read.json(path, multiLine=True).select("id", "catalog_id", F.col("readability.description.words").alias("words"), F.round(F.round("readability.description.flesch", 9), 6).alias("flesch"))
    flat = readability.flat_record(rows, readability.EN_COUNTS, metrics).select(F.col("id").alias("i"), F.round(F.round("FKGL", 9), 6).alias("flat_fkgl"), F.col("SENTENCES").cast("long").alias("flat_sentences"))
    return back.join(flat, F.col("id") == F.col("i")).drop("i")


def similarity_file(spark, sf_dir):
    """Best references that have a similarity, from the results' file."""
    path = f"{_folder(spark)}/similarity.json"
    writers.single_json(C.best_reference_similarity(spark, sf_dir), path)
    kind = "id string, title string, num_valid_references int, best_cosine_similarity double, best_legal_reference string, best_reference_language string, best_reference_text string"
    return spark.read.schema(kind).json(path, multiLine=True).where("best_cosine_similarity is not null")


def token_match_file(spark, sf_dir):
    """Requirements without id or with a blank text and references without text drop out."""
    docs = _docs(spark, sf_dir)
    reqs = docs.where(_place() % 4 == 0).select(
        _place().alias("pos"), F.when(_place() % 12 != 0, _place() % 100).cast("string").alias("id"), F.lit("t").alias("title"), F.when(_place() % 20 == 4, F.lit(" \n")).when(_place() % 20 != 8, F.col("text")).alias("text")
    )
    refs = docs.where(_place() % 4 != 0).select(
        _place().alias("ref_pos"), (_place() % 100 - _place() % 4).cast("string").alias("id"), F.when(_place() % 5 != 0, F.col("text")).alias("text"), F.concat(F.lit("law "), _place()).alias("legal_reference")
    )
    own = lambda d: d.withColumn("tokens", T.tokens_en(F.lower("text")))
    path = f"{_folder(spark)}/tokens.json"
    writers.single_json(consistency.best_by_token_match(own(reqs), own(refs)), path)
    kind = "pos long, id string, precision double, recall double, f1 double, best_legal_reference string, best_normative_excerpt string"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    return C._rounded(rows.withColumn("best_normative_excerpt", F.md5("best_normative_excerpt")), 9)


def _tokens(vec: str) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: vectors.normalised(F.slice(vec, 8 * k + 1, 8)))


def token_vectors_match(spark, sf_dir):
    """Greedy matching of neighbouring embeddings read as eight token vectors each, rescaled by a baseline."""
    v = C.vectors_of(spark, sf_dir).select("pos", "vec")
    pairs = v.join(v.select((F.col("pos") - 1).alias("pos"), F.col("vec").alias("next")), "pos").select("pos", _tokens("vec").alias("a"), _tokens("next").alias("b"))
    scored = pairs.select("pos", consistency.greedy_match(F.col("a"), F.col("b")).alias("s"))
    return C._rounded(scored.select("pos", "s.precision", "s.recall", consistency.rescaled(F.col("s.f1"), 0.1).alias("f1")), 9)


def ragged_vectors_match(spark, sf_dir):
    """The same as products of matrices, with one to eight tokens on either side."""
    v = C.vectors_of(spark, sf_dir).select("pos", "vec")
    some = lambda c, k: F.slice(_tokens(c), 1, (k % 8 + 1).cast("int"))
    pairs = v.join(v.select((F.col("pos") - 1).alias("pos"), F.col("vec").alias("next")), "pos").select("pos", some("vec", F.col("pos")).alias("a"), some("next", F.col("pos") * 3 + 1).alias("b"))
    return C._rounded(token_matrices.match_pairs(pairs, "a", "b").select("pos", "match.precision", "match.recall", "match.f1"), 9)


def _toy_model():
    """Token ids are characters' code points; a token's vector is what remains of its id."""
    import numpy as np

    return (lambda text: [ord(c) % 50 for c in text]), (lambda ids, mask: np.stack([ids % (d + 2) for d in range(DIMS)], axis=2))


def encoded_texts(spark, sf_dir):
    """A model's token vectors: cut to the most tokens, pooled under the mask, scaled to length 1, in batches."""
    docs = _docs(spark, sf_dir).select("doc_id", F.trim("text").alias("text"))
    coder = vectors.ModelEncoder(vectors.token_encoder(_toy_model, MAX_LENGTH), "array<double>", BATCH)
    out = coder.encode(docs, "text", "vec")
    return out.select("doc_id", *[F.round(F.get("vec", F.lit(k)), 9).alias(f"x{k}") for k in range(DIMS)])


def defaults(spark, sf_dir):
    """The language model that each language of the documents is given, and whether the language differs from one asked for; others have none."""
    used = {lang: readers.resolve_language(lang, "en") for lang in vectors.LANGUAGE_MODELS}
    langs = _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda value: F.coalesce(*[F.when(F.col("lang") == lang, F.lit(value(lang))) for lang in sorted(used)])
    return langs.select("lang", "n", pick(vectors.language_model).alias("model"), pick(lambda x: used[x][0]).alias("used"), pick(lambda x: used[x][1]).alias("differs"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_file,
        requirements_file,
        references_file,
        references_file_in_use,
        cleaned_file,
        requirements_workbook,
        references_workbook,
        pairs_workbook,
        report_workbook,
        smell_rows_file,
        smell_messages,
        findings_file,
        report_from_files,
        report_from_findings,
        report_files,
        smell_input_file,
        pairs_file,
        clusters_file,
        redundancy_summary_file,
        matrix_file,
        metrics_file,
        readability_file,
        similarity_file,
        token_match_file,
        token_vectors_match,
        ragged_vectors_match,
        encoded_texts,
        defaults,
    )
}


# ------------------------------------------------------------------- SQL


def _pos(order: str = "doc_id") -> str:
    return f"(row_number() OVER (ORDER BY {order}) - 1)::INT"


def _flag(k: str, weakness: str) -> str:
    if k in ("Low Readability", "Not a Requirement"):
        return f'coalesce("{k}", false)'
    if k == "Subjectivity Detected":
        return "subj_score > 0.5"
    if k == "Weakness":
        return f"({weakness})"
    return f'"{k}" IS NOT NULL'


def _findings(names: list[str]) -> str:
    """o: the last record of each id: its text, flags of the smells, security."""
    again = '"ID"::BIGINT % 4 = 1'
    flags = ", ".join(f'({_flag(k, f"""NOT ({again}) AND "Weakness" IS NOT NULL""")}) AS "smell__{k}"' for k in names)
    return f"""{C._findings_ctes()}, o AS (SELECT "ID" AS id, CASE WHEN {again} THEN ' again ' || text ELSE text END AS own, coalesce("Security Related", false) AS sec, {flags}
      FROM f WHERE "ID"::BIGINT % 6 <> 5)"""


def _issues(names: list[str], prefix: str = "") -> str:
    count = " + ".join(f'coalesce({prefix}"smell__{k}", false)::INT' for k in names)
    listed = ", ".join(f'CASE WHEN coalesce({prefix}"smell__{k}", false) THEN {C._q(k)} END' for k in names)
    return f"({count})::INT AS issues_count, array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ';') AS negative_smells_list"


def oracle_sql() -> dict[str, str]:
    lang = "CASE doc_id % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' ELSE 'desconocido' END"
    cleaned = f"WITH c AS (SELECT doc_id, lang, {cleaning.sql(C._NORM_TEXT)} AS c FROM documents), k AS (SELECT doc_id, lang, CASE WHEN c <> '' AND NOT regexp_matches(c, '[.!?]$') THEN c || '.' ELSE c END AS c FROM c)"
    negative = list(L.NEGATIVE)
    two = ["Weakness", "Conjunction"]
    base = C.oracle_sql()
    parts = [f"[{', '.join(f'vec[{8 * t + d + 1}]' for d in range(8))}]" for t in range(8)]
    unit = "list_transform({v}, lambda x: list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-12)))"
    best = "list_avg(list_transform({x}, lambda p: list_max(list_transform({y}, lambda q: list_dot_product(p, q)))))"
    pooled = [f"list_avg(list_transform(c, lambda v: (v % {d + 2})::DOUBLE))" for d in range(DIMS)]
    report_values = [f"SELECT 'stats' AS file, smell AS name, count::VARCHAR AS value FROM ({base['report_stats']})", f"SELECT 'requirement', req_id, issues_count || '|' || negative_smells_list FROM ({base['report_by_requirement']})"]
    report_values += [f"SELECT 'summary', '{m}', {m}::VARCHAR FROM ({base['report_summary']})" for m in ("total_requirements", "total_issues", "clean_count", "issues_max", "issues_p90")]
    report_values += [f"SELECT 'notes', '', {C._q(n)}" for n in smell_report.NOTES] + [f"SELECT 'json', 'excluded_fields', {C._q(','.join(sorted(L.EXCLUDED)))}"]
    fired = " OR ".join([f"{h} IS NOT NULL" for h in C._HEADERS if h != '"Low Readability"'] + ['"Low Readability"', "subj_score > 0.5"])
    return {
        "catalog_file": f"SELECT 'C1' AS catalog_id, {_pos()} AS pos, 'R' || doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'title ' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS text_md5 FROM documents",
        "requirements_file": f"SELECT {_pos()} AS pos, 'R' || doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'title ' || doc_id ELSE '' END AS title, md5(CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END) AS text_md5 FROM documents",
        "references_file": f"""SELECT {_pos()} AS ref_pos, 'G' || (doc_id % 50) AS id, CASE WHEN doc_id % 7 <> 0 THEN 'law ' || doc_id ELSE '' END AS legal_reference, {lang} AS original_language,
            md5(CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 6 <> 0 THEN 'es ' || text ELSE '' END WHEN 1 THEN 'en ' || text ELSE '' END) AS text_md5 FROM documents""",
        "references_file_in_use": f"SELECT {_pos()} AS ref_pos, 'G' || (doc_id % 50) AS id, 'law ' || doc_id AS legal_reference, {lang} AS original_language, md5('en ' || text) AS text_md5, 'en' AS used FROM documents",
        "cleaned_file": f"""{cleaned} SELECT {_pos()} AS ref_pos, 'G' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'note ' || doc_id END AS note,
            CASE WHEN lang = 'es' THEN md5(c) END AS es_md5, CASE WHEN lang <> 'es' THEN md5(c) END AS en_md5, 'kept' AS unknown FROM k""",
        "requirements_workbook": f"SELECT {_pos()} AS pos, 'R' || doc_id AS id, CASE WHEN doc_id % 4 <> 0 THEN 'title ' || doc_id END AS title, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS text_md5 FROM documents",
        "references_workbook": f"SELECT {_pos()} AS ref_pos, doc_id::VARCHAR AS id, 'law ' || doc_id AS legal_reference, 'desconocido' AS original_language, md5('es ' || text) AS text_md5 FROM documents",
        "pairs_workbook": f"WITH {C._TOP} SELECT (row_number() OVER (ORDER BY score DESC, pos_a, pos_b) - 1)::INT AS line_no, id_a, id_b, round(score, 6) AS score, rank_from_a, rank_from_b FROM r",
        "report_workbook": " UNION ALL ".join(x for x in report_values if "'json'" not in x),
        "smell_rows_file": "SELECT 'R' || doc_id AS req_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL",
        "smell_messages": f"""WITH {C._findings_ctes().replace("< 30 AS", "AS flesch_score, coalesce(CASE WHEN words > 0 AND sentences > 0 THEN " + C._FLESCH + " END, 206.835::DOUBLE) < 30 AS")} SELECT "ID", md5(text) AS requirement_md5, CASE WHEN "Low Readability" THEN 'Flesch Reading Ease: ' || printf('%.2f', flesch_score) END AS readability,
            CASE WHEN subj_score > 0.5 THEN 'Subjectivity Score: ' || printf('%.2f', subj_score) END AS subjectivity FROM f WHERE {fired}""",
        "findings_file": f"""WITH {C._findings_ctes()}, a AS (SELECT *, 0 AS o FROM f WHERE "ID"::BIGINT % 6 <> 5 UNION ALL SELECT *, 1 FROM f WHERE "ID"::BIGINT % 6 <> 5 AND "ID"::BIGINT % 4 = 1)
            SELECT {_pos('o, "ID"::BIGINT')} AS place, "ID", md5(CASE WHEN o = 1 THEN ' again ' || text ELSE text END) AS requirement_md5, CASE WHEN o = 0 THEN "Weakness" END AS "Weakness", "Optionality", "Security Related" AS security FROM a""",
        "report_from_files": f"""WITH {_findings(negative)}, i AS (SELECT req_id, CASE WHEN pos % 10 = 7 THEN 'last ' || text WHEN pos % 3 = 0 THEN '' ELSE 'first ' || text END AS text FROM r)
            SELECT req_id, md5(CASE WHEN i.text <> '' THEN i.text ELSE coalesce({C._strip('own')}, '') END) AS text_md5, coalesce(sec, false) AS security_related, {_issues(negative)}, o.id IS NOT NULL AS in_output FROM i LEFT JOIN o ON o.id = i.req_id""",
        "report_from_findings": f"WITH {_findings(two)} SELECT id AS req_id, md5({C._strip('own')}) AS text_md5, {_issues(two)} FROM o",
        "report_files": " UNION ALL ".join(report_values),
        "smell_input_file": f"SELECT {_pos()} AS pos, CASE WHEN doc_id % 3 > 0 THEN 'R' || doc_id ELSE printf('REQ-%04d', doc_id + 1) END AS req_id, md5({C._strip('text')}) AS text_md5 FROM documents",
        "pairs_file": f"""WITH {C._TOP}, l AS (SELECT row_number() OVER (ORDER BY score DESC, pos_a, pos_b) AS line_no, id_a || ';' || id_b || ';' || printf('%.6f', score) || ';' || rank_from_a || ';' || rank_from_b AS line FROM r)
            SELECT 0 AS line_no, 'BOM:id_a;id_b;score;rank_from_a;rank_from_b' AS line UNION ALL SELECT line_no::INT, line FROM l""",
        "clusters_file": base["requirement_clusters"],
        "redundancy_summary_file": base["redundancy_summary"].replace("AS redundancy_rate", f"AS redundancy_rate, {C.PAIR_THRESHOLD}::DOUBLE AS threshold"),
        "matrix_file": base["similarity_cells"],
        "metrics_file": f"SELECT 'C1' AS catalog_id, 'en' AS lang_used, {C.PAIR_THRESHOLD}::DOUBLE AS threshold, -1 AS top_k, id AS req_id, mean_sim, degree_t FROM ({base['requirement_metrics']})",
        "readability_file": f"SELECT doc_id::VARCHAR AS id, 'C1' AS catalog_id, words::BIGINT AS words, round(flesch, 6) AS flesch, round(fkgl, 6) AS flat_fkgl, sentences::BIGINT AS flat_sentences FROM ({base['readability_en']})",
        "similarity_file": f"SELECT * EXCLUDE (requirement_text) FROM ({base['best_reference_similarity']}) WHERE best_cosine_similarity IS NOT NULL",
        "token_match_file": f"""WITH q AS (SELECT doc_id AS pos, (doc_id % 100)::VARCHAR AS id, CASE WHEN doc_id % 20 = 4 THEN ' ' || chr(10) WHEN doc_id % 20 <> 8 THEN text END AS text FROM documents WHERE doc_id % 4 = 0 AND doc_id % 12 <> 0),
            ref AS (SELECT doc_id AS ref_pos, (doc_id % 100 - doc_id % 4)::VARCHAR AS id, text FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0),
            j AS (SELECT q.pos, q.id, ref_pos, ref.text AS excerpt, regexp_extract_all(lower(q.text), '{T.TOKEN_EN}') AS a, regexp_extract_all(lower(ref.text), '{T.TOKEN_EN}') AS b FROM q JOIN ref USING (id) WHERE {C._strip('q.text')} <> '' AND ref.text IS NOT NULL),
            s AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda t: list_contains(b, t))) / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN len(list_filter(b, lambda t: list_contains(a, t))) / len(b) ELSE 0 END AS r FROM j),
            w AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(f, 12) DESC, ref_pos) AS rn FROM w)
            SELECT pos, id, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, 'law ' || ref_pos AS best_legal_reference, md5(excerpt) AS best_normative_excerpt FROM n WHERE rn = 1""",
        "token_vectors_match": f"""WITH v AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS vec FROM embeddings), t AS (SELECT pos, {unit.format(v='[' + ', '.join(parts) + ']')} AS x FROM v),
            s AS (SELECT a.pos, {best.format(x='a.x', y='b.x')} AS p, {best.format(x='b.x', y='a.x')} AS r FROM t a JOIN t b ON b.pos = a.pos + 1)
            SELECT pos, round(p, 9) AS precision, round(r, 9) AS recall, round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END - 0.1::DOUBLE) / (1 - 0.1::DOUBLE), 9) AS f1 FROM s""",
        "ragged_vectors_match": f"""WITH v AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS vec FROM embeddings), t AS (SELECT pos, {unit.format(v='[' + ', '.join(parts) + ']')} AS x FROM v),
            w AS (SELECT a.pos, a.x[1:a.pos % 8 + 1] AS x, b.x[1:(a.pos * 3 + 1) % 8 + 1] AS y FROM t a JOIN t b ON b.pos = a.pos + 1),
            s AS (SELECT pos, {best.format(x='x', y='y')} AS p, {best.format(x='y', y='x')} AS r FROM w)
            SELECT pos, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s""",
        "encoded_texts": f"""WITH t AS (SELECT doc_id, list_transform(string_split(substr(trim(text), 1, {MAX_LENGTH}), ''), lambda x: unicode(x) % 50) AS c FROM documents),
            p AS (SELECT doc_id, [{', '.join(pooled)}] AS x FROM t), n AS (SELECT doc_id, x, greatest(sqrt(list_dot_product(x, x)), 1e-12) AS l FROM p)
            SELECT doc_id, {', '.join(f'round(x[{d + 1}] / l, 9) AS x{d}' for d in range(DIMS))} FROM n""",
        "defaults": """SELECT lang, count(*) AS n, CASE lang WHEN 'es' THEN 'es_core_news_sm' WHEN 'en' THEN 'en_core_web_sm' END AS model, CASE WHEN lang IN ('es', 'en') THEN 'en' END AS used,
            CASE lang WHEN 'es' THEN true WHEN 'en' THEN false END AS differs FROM documents GROUP BY lang""",
    }
