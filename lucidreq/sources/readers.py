"""Readers of catalogs, references and findings, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .json_document import Document, read_document
from .workbook import read_workbook

REQUIREMENT = "id string, titulo string, descripcion string"
REFERENCE = "id string, referencia_normativa string, idioma_normativo_original string, texto_normativo_es string, texto_normativo_en string"
FINDINGS = ", ".join(["ID string", "Requirement string", *[f"`{k}` {'boolean' if k in ('Security Related', 'Not a Requirement') else 'string'}" for k in [*L.SMELLS, *L.COUNTERS]]])


def _elements(document: Document, schema: str, place: str) -> DataFrame:
    """The list's elements as columns of a schema, with their places."""
    return document.elements.select(F.col("place").alias(place), F.from_json("json", schema).alias("r")).select(place, "r.*")


def _require(df: DataFrame, ok, message: str) -> DataFrame:
    """Fails when a row that doesn't meet ``ok`` is read."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """catalog_id, pos, id, title, text in list order; strict: the list and every id must be there."""
    document = read_document(spark, path, "requisitos")
    if strict and not document.found:
        raise ValueError("the catalog must hold a list requisitos")
    head = document.rest.select(F.from_json("value", "catalog_id string").alias("h")).select("h.catalog_id")
    rows = _elements(document, REQUIREMENT, "pos").crossJoin(F.broadcast(head))  # one row
    rows = rows.select("catalog_id", "pos", "id", F.col("titulo").alias("title"), F.col("descripcion").alias("text"))
    return _require(rows, F.col("id").isNotNull(), "each requirement must have an id") if strict else rows


def requirement_rows(catalog: DataFrame) -> DataFrame:
    """pos, id, title, text of a catalog; absent titles and texts are empty."""
    return catalog.select("pos", "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """pos, id, title, text from JSON or a workbook, told by the ending; absent titles and texts are empty."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "json":
        return requirement_rows(read_catalog(spark, path, strict=False))
    if kind == "xlsx":
        return read_workbook(spark, path, ["ID", "Título", "Texto"]).withColumnsRenamed({"ID": "id", "Título": "title", "Texto": "text"})
    raise ValueError(f"unknown kind of file: {path}")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: ref_pos, id, legal_reference, original_language, text in the original language.

    A missing language is "desconocido"; texts of unknown languages and null texts are empty.
    """
    if path.lower().endswith(".xlsx"):
        out = read_workbook(spark, path, ["ID", "Texto"], {"Referencia_normativa": "", "Idioma_normativo_original": "desconocido"}, place="ref_pos")
        return out.withColumnsRenamed({"ID": "id", "Texto": "text", "Referencia_normativa": "legal_reference", "Idioma_normativo_original": "original_language"})
    rows = _elements(read_document(spark, path, "referencias"), REFERENCE, "ref_pos")
    lang = F.coalesce("idioma_normativo_original", F.lit("desconocido"))
    text = F.when(lang == "es", F.col("texto_normativo_es")).when(lang == "en", F.col("texto_normativo_en"))
    return rows.select("ref_pos", "id", F.coalesce("referencia_normativa", F.lit("")).alias("legal_reference"), lang.alias("original_language"), F.coalesce(text, F.lit("")).alias("text"))


def resolve_language(catalog_language: str | None, asked: str | None) -> tuple[str, bool]:
    """The language to use and whether it differs from the catalog's."""
    lang = asked or catalog_language
    if lang not in ("es", "en"):
        raise ValueError("the language must be es or en")
    return lang, bool(asked and catalog_language and asked != catalog_language)


def read_references_strict(spark: SparkSession, path: str, lang: str | None = None) -> tuple[DataFrame, str]:
    """References in the language of use, and that language; anything missing fails."""
    document = read_document(spark, path, "referencias")
    head = document.rest.select(F.from_json("value", "idioma_catalogo string").alias("h")).first().h
    if head is None or not document.found or head.idioma_catalogo not in ("es", "en"):
        raise ValueError("the file needs idioma_catalogo (es or en) and a list referencias")
    used, _ = resolve_language(head.idioma_catalogo, lang)
    rows = _elements(document, REFERENCE, "ref_pos")
    complete = F.col("id").isNotNull() & F.col("referencia_normativa").isNotNull() & F.col("idioma_normativo_original").isNotNull()
    rows = _require(rows, complete, "a reference lacks a key")
    rows = _require(rows, T.strip(F.col(f"texto_normativo_{used}")) != "", f"a reference lacks its text in {used}")
    return rows.select("ref_pos", "id", F.col("referencia_normativa").alias("legal_reference"), F.col("idioma_normativo_original").alias("original_language"), F.col(f"texto_normativo_{used}").alias("text")), used


def read_rows(spark: SparkSession, path: str, id_header: str = "ID", text_header: str = "Requirement") -> DataFrame:
    """req_id, text of an array of objects with the given keys."""
    rows = _elements(read_document(spark, path), f"`{id_header}` string, `{text_header}` string", "__place")
    return rows.select(F.col(f"`{id_header}`").alias("req_id"), F.col(f"`{text_header}`").alias("text"))


def read_findings(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """Smell findings as written, with their places in the file if a name for them is given; absent headers are null."""
    rows = _elements(read_document(spark, path), FINDINGS, place or "__place")
    return rows if place else rows.drop("__place")


def smell_input(requirements: DataFrame) -> DataFrame:
    """req_id and text of a catalog; a missing id becomes REQ-0001 and so on by place."""
    own = F.nullif(T.strip(F.col("id")), F.lit(""))
    own = F.when(own != "0", own)
    return requirements.select("pos", F.coalesce(own, F.format_string("REQ-%04d", F.col("pos") + 1)).alias("req_id"), T.strip(F.col("text")).alias("text"))


def read_traceability(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The document (one row, column ``document``) and its references (ref_pos, column ``reference``).

    Both are variants, so keys that nobody knows beforehand stay; the document is
    without its references. The known texts of a reference are columns besides: null
    where the key is absent, empty where it is null.
    """
    document = read_document(spark, path, "referencias")
    own = document.rest.select(F.from_json("value", "map<string,variant>").alias("m"))
    head = own.select(F.parse_json(F.to_json(F.map_filter("m", lambda k, _: k != "referencias"))).alias("document"))
    refs = document.elements.select(F.col("place").alias("ref_pos"), F.from_json("json", "map<string,variant>").alias("r"))
    known = lambda c: F.when(F.map_contains_key("r", c), F.coalesce(F.try_variant_get(F.col("r")[c], "$", "string"), F.lit("")))
    names = ["texto_normativo_es", "texto_normativo_en"]
    return head, refs.select("ref_pos", F.parse_json(F.to_json("r")).alias("reference"), *[known(c).alias(c) for c in names])


def requirements_or_findings(spark: SparkSession, findings_path: str, input_path: str | None = None) -> DataFrame | None:
    """The rows a report counts: those of the input (by default the file nalabs_input.json beside the findings), or none if there is no such file.

    The id is req_id, or else id where that is absent or empty.
    """
    path = input_path or f"{findings_path.rsplit('/', 1)[0]}/nalabs_input.json"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = read_document(spark, path).elements.select(F.col("place").alias("pos"), F.from_json("json", "req_id string, id string, text string").alias("r"))
    key = F.coalesce(F.nullif(F.col("r.req_id"), F.lit("")), F.col("r.id"))
    return rows.select("pos", key.alias("req_id"), F.coalesce("r.text", F.lit("")).alias("text")).where("req_id is not null")
