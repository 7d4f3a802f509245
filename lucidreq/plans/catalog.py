"""All registered queries of the requirement operators, with their SQL.

The tables stand in for catalogs: documents are requirements, embeddings are
encoded requirements, benchmark items are reference texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lemmas
from ..functions import lexicons as L
from ..functions import opinions as O
from ..functions import text as T
from ..operators import cleaning, consistency, order_statistics, readability, redundancy, smell_report, smells, subjectivity, vectors
from ..sources import readers

#: No pair of the test embeddings reaches the default threshold of 0.90.
PAIR_THRESHOLD = 0.35
TOP_K = 5
#: Dimensions of the stand-in encoder's vectors.
HASHED = 16
STOP_WORDS = ["the", "of", "and", "a", "to", "in", "is", "was", "that", "for", "on", "with", "as", "by", "be", "are", "this", "it", "from", "or", "an"]
_MODALS = ["shall", "may", "will", "should", "Could", "is required to", "provides", "might"]
_PHRASES = ["ensure security of", "as appropriate use", "be able to audit", "support e.g. a table of", "take into account similarly", "whenever willing", ""]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], key) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as requirements: pos, req_id, text."""
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'")
    text = F.concat(F.lit("The system "), _pick(_MODALS, F.col("doc_id")), F.lit(" "), _pick(_PHRASES, F.col("doc_id")), F.lit(" "), F.col("text"))
    return docs.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("req_id"), text.alias("text"))


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("R"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vec"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ------------------------------------------------------------------- readability


def readability_en(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")
    return _rounded(readability.readability_en(docs).drop("text"), 9)


def readability_es(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id", "text")
    return _rounded(readability.readability_es(docs).drop("text"), 6)


#: Places that the order statistics report beside the median.
QUANTILES = {"least": 0.0, "p10": 0.1, "p90": 0.9, "most": 1.0}
_READABILITY = ["flesch", "fkgl", "fog", "smog", "ari", "coleman_liau"]
_AMOUNTS = ["quantity", "amount", "discount"]


def readability_statistics(spark, sf_dir):
    """Median and floor percentiles of each index over the English documents that have it."""
    return order_statistics.order_statistics(readability_en(spark, sf_dir), _READABILITY, QUANTILES)


def amount_statistics(spark, sf_dir):
    """The same of the amounts of a shop's sale lines, which have nulls and many ties."""
    return order_statistics.order_statistics(_table(spark, sf_dir, "sale_lines"), _AMOUNTS, QUANTILES)


# ------------------------------------------------------------------- smells


def smell_findings(spark, sf_dir):
    out = smells.detect_smells(requirements(spark, sf_dir))
    return out.drop("Requirement", "Subjectivity Detected").withColumn("Low Readability", F.col("`Low Readability`").isNotNull())


def smell_subjectivity(spark, sf_dir):
    rows = requirements(spark, sf_dir)
    return rows.select("req_id", F.round(smells.subjectivity_score(F.col("text")), 9).alias("subjectivity"))


_OPINIONS = ["is not very good", "isn't slow, but nice", "as fast as possible", "extremely easy; never obvious", "similar", "", "not intuitive and slightly better"]


def _judged(spark, sf_dir) -> DataFrame:
    """English documents that open with an opinion or none."""
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select("doc_id", F.concat(F.lit("It "), _pick(_OPINIONS, F.col("doc_id")), F.lit(" "), F.col("text")).alias("text"))


def subjectivity_in_context(spark, sf_dir):
    """Opinions of each text, weighed by degrees and negations before them, and whether the smell rule would fire."""
    rows = _judged(spark, sf_dir).select("doc_id", subjectivity.opinions(F.col("text")).alias("found"))
    rows = rows.withColumn("score", F.round(subjectivity.mean_weight(F.col("found")), 9))
    words = F.array_join(F.transform("found", lambda o: o["word"]), " ")
    return rows.select("doc_id", F.size("found").alias("opinions"), words.alias("words"), F.col("score").alias("subjectivity"), (F.col("score") > L.SUBJECTIVITY_ABOVE).alias("subjective"))


def smell_default_rules(spark, sf_dir):
    out = smells.detect_smells(requirements(spark, sf_dir), all_checks=False)
    return out.select("ID", F.col("`Ambiguity Detected`").alias("ambiguity"), F.coalesce("`Security Related`", F.lit(False)).alias("security"), F.coalesce("`Not a Requirement`", F.lit(False)).alias("not_a_requirement"))


def _report(spark, sf_dir) -> DataFrame:
    rows = requirements(spark, sf_dir)
    return smell_report.by_requirement(rows, smells.detect_smells(rows))


def report_by_requirement(spark, sf_dir):
    return _report(spark, sf_dir).drop("text")


def report_stats(spark, sf_dir):
    return _rounded(smell_report.smell_stats(_report(spark, sf_dir)))


def report_summary(spark, sf_dir):
    return _rounded(smell_report.summary(_report(spark, sf_dir)))


def smell_input(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("R"), F.col("doc_id"))).alias("id"), "text")
    return readers.smell_input(rows).select("req_id", F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------- cleaning

_HEADS = ["", "Artículo 33.1 - ", "[op.pl.2] a) ", "Refuerzo R1- ", "(1) ", "- ", "Reinforcement R2 – "]


def _norms(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(_pick(_HEADS, F.col("doc_id")), F.col("text"), F.lit(" (a) b; 2. C (3);")).alias("text"), "lang")


def cleaned_texts(spark, sf_dir):
    return _norms(spark, sf_dir).select("doc_id", cleaning.clean_text(F.col("text")).alias("cleaned"))


def cleaned_counts(spark, sf_dir):
    rows = _norms(spark, sf_dir).select("doc_id", F.when(F.col("lang") == "es", F.col("text")).alias("texto_normativo_es"), F.when(F.col("lang") == "en", F.col("text")).alias("texto_normativo_en"))
    return cleaning.clean_counts(cleaning.clean_references(rows))


# ------------------------------------------------------------------- redundancy


def _pairs(spark, sf_dir, top_k=None):
    v = vectors_of(spark, sf_dir)
    return v, redundancy.redundant_pairs(v, PAIR_THRESHOLD, top_k)


def _links(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return v, redundancy.links(v, PAIR_THRESHOLD)


def redundant_pairs(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir)[1].drop("pos_a", "pos_b"))


def redundant_pairs_top_k(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir, TOP_K)[1].drop("pos_a", "pos_b"))


def neighbour_ranks(spark, sf_dir):
    return redundancy.neighbour_ranks(vectors_of(spark, sf_dir), TOP_K)


def requirement_metrics(spark, sf_dir):
    v, p = _links(spark, sf_dir)
    return _rounded(redundancy.requirement_metrics(v, p).drop("pos"))


def requirement_metrics_top_k(spark, sf_dir):
    """Degrees counted from the pairs that one of the two has among its nearest."""
    v, p = _pairs(spark, sf_dir, TOP_K)
    return _rounded(redundancy.requirement_metrics(v, p).drop("pos"))


def requirement_clusters(spark, sf_dir):
    out = redundancy.clusters(*_links(spark, sf_dir))
    return out.select("cluster_id", "size", "representative", F.array_join("members", ",").alias("members"))


def redundancy_summary(spark, sf_dir):
    return _rounded(redundancy.redundancy_summary(*_links(spark, sf_dir)))


def similarity_cells(spark, sf_dir):
    return _rounded(redundancy.similarity_cells(vectors_of(spark, sf_dir)).drop("pos_a", "pos_b"))


def pooled_vectors(spark, sf_dir):
    """Each embedding read as eight token vectors of eight dimensions; the mask leaves every third token out."""
    v = vectors_of(spark, sf_dir)
    tokens = F.array(*[F.slice("vec", 8 * k + 1, 8) for k in range(8)])
    mask = F.array(*[F.lit(0 if k % 3 == 2 else 1) for k in range(8)])
    pooled = vectors.mean_pool(tokens, mask)
    return _rounded(v.select("id", *[F.get(pooled, F.lit(k)).alias(f"x{k}") for k in range(8)]), 9)


def preprocessed_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", vectors.preprocess(F.col("text"), STOP_WORDS).alias("words"))


#: Spanish words that the lemmas leave out, as STOP_WORDS are in English.
STOP_WORDS_ES = ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para", "al", "lo", "como"]
_INFLECTED = {
    "en": ["The user's requests aren't processed", "Well-known policies, e.g. 3.5 criteria", "Storing/creating cities stopped", "", "Children were using boxes"],
    "es": ["Las obligaciones están definidas", "Los responsables informarán (art. 5) de los fines", "Procesando datos personales", "", "Estos países"],
}


def _inflected(spark, sf_dir, lang: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(F.col("lang") == lang)
    return docs.select("doc_id", "lang", F.concat(_pick(_INFLECTED[lang], F.col("doc_id")), F.lit(" "), F.col("text")).alias("text"))


def lemmatised_texts(spark, sf_dir):
    """Lemmas of English and Spanish texts without stop words, each by its language's rules."""
    one = lambda lang, stop: _inflected(spark, sf_dir, lang).select("doc_id", "lang", lemmas.lemmas(F.col("text"), lang, stop).alias("k"))
    both = one("en", STOP_WORDS).unionByName(one("es", STOP_WORDS_ES))
    return both.select("doc_id", "lang", F.size("k").alias("n_words"), F.array_join("k", " ").alias("lemmas"))


def hashed_texts(spark, sf_dir):
    """The stand-in encoder's vectors of all documents, and their norms (1, or 0 for texts without words)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = vectors.HashingEncoder(HASHED).encode(docs, "text")
    return coded.select("doc_id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"), *[F.round(F.get("vec", F.lit(k)), 9).alias(f"x{k}") for k in range(HASHED)])


# ------------------------------------------------------------------- consistency


def best_reference_similarity(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    group = lambda shift: F.concat(F.lit("G"), F.floor((F.col("vec_id") + shift) / 4).cast("string"))
    reqs = e.select(F.col("vec_id").alias("pos"), group(0).alias("id"), F.concat(F.lit("T"), F.col("vec_id")).alias("title"), F.lit("").alias("text"), F.col("embedding").alias("vec"))
    refs = e.select(
        F.col("vec_id").alias("ref_pos"),
        group(6).alias("id"),
        F.when(F.col("label") == 9, F.lit("  ")).otherwise(F.concat(F.lit("text "), F.col("vec_id"))).alias("text"),
        F.concat(F.lit("law "), F.col("label")).alias("legal_reference"),
        F.when(F.col("label") % 2 == 0, F.lit("es")).otherwise(F.lit("en")).alias("original_language"),
        F.col("embedding").alias("vec"),
    )
    return _rounded(consistency.best_by_similarity(reqs, refs).drop("pos"), 9)


def best_reference_tokens(spark, sf_dir):
    reqs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").alias("id"), F.lit("item").alias("title"), "text")
    # Every document is a reference of one of the items.
    items = reqs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("items"))
    docs = _table(spark, sf_dir, "documents").crossJoin(F.broadcast(items))
    refs = docs.select(F.col("doc_id").alias("ref_pos"), (F.col("doc_id") % F.col("items")).alias("id"), "text", F.concat(F.lit("doc "), F.col("doc_id")).alias("legal_reference"))
    own = lambda d: d.withColumn("tokens", T.tokens_en(F.lower("text")))
    out = consistency.best_by_token_match(own(reqs), own(refs)).drop("pos")
    return _rounded(out.withColumn("best_normative_excerpt", F.md5("best_normative_excerpt")), 9)


def f1_histogram(spark, sf_dir):
    rows = best_reference_tokens(spark, sf_dir)
    return consistency.histogram(rows, "f1")


def match_series(spark, sf_dir):
    """The lines of precision, recall and F1 over the requirements, and of the similarities."""
    tokens = consistency.series(best_reference_tokens(spark, sf_dir), "id", ["precision", "recall", "f1"])
    e = best_reference_similarity(spark, sf_dir).withColumn("pos", F.substring("title", 2, 20).cast("long"))
    return tokens.unionByName(consistency.series(e, "pos", ["best_cosine_similarity"]))


_QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        readability_en,
        readability_es,
        readability_statistics,
        amount_statistics,
        smell_findings,
        smell_subjectivity,
        subjectivity_in_context,
        smell_default_rules,
        report_by_requirement,
        report_stats,
        report_summary,
        smell_input,
        cleaned_texts,
        cleaned_counts,
        redundant_pairs,
        redundant_pairs_top_k,
        neighbour_ranks,
        requirement_metrics,
        requirement_metrics_top_k,
        requirement_clusters,
        redundancy_summary,
        similarity_cells,
        pooled_vectors,
        preprocessed_texts,
        lemmatised_texts,
        hashed_texts,
        best_reference_similarity,
        best_reference_tokens,
        f1_histogram,
        match_series,
    )
}


def queries() -> dict:
    return dict(_QUERIES)


# ------------------------------------------------------------------- SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{T.WS}+', ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{T.WS}+|{T.WS}+$', '', 'g')"


def _sentences(t: str) -> str:
    # RE2 has no look-around: a mark ends a sentence if it follows a character other than a digit and no digit comes next.
    chars = f"string_split({t}, '')"
    return f"""CASE WHEN {t} = '' THEN 0 ELSE greatest(1, len(list_filter(string_split(array_to_string(list_transform(
      list_zip({chars}, list_concat([''], {chars}), list_concat({chars}[2:], [''])),
      lambda z: CASE WHEN z[1] IN ('.', '!', '?') AND z[2] <> '' AND NOT regexp_matches(z[2], '[0-9]') AND NOT regexp_matches(coalesce(z[3], ''), '[0-9]')
                THEN chr(1) ELSE z[1] END), ''), chr(1)), lambda x: trim(x) <> ''))) END"""


def _metrics(pairs: dict[str, str], digits: int) -> str:
    return ",\n".join(f"round(CASE WHEN words >= 10 AND sentences > 0 THEN {v} END, {digits}) AS {k}" for k, v in pairs.items())


_W, _S, _C, _Y, _P = (f"{x}::DOUBLE" for x in readability.EN_COUNTS)
_SMOG = f"CASE WHEN polysyllables > 0 THEN 1.043::DOUBLE * sqrt({_P} * 30::DOUBLE / {_S}) + 3.1291::DOUBLE END"


def _en_counts(source: str, keep: str) -> str:
    return f"""
  t AS (SELECT {keep}, {_squeeze('text')} AS t FROM {source}),
  k AS (SELECT *, regexp_extract_all(t, '{T.TOKEN_EN}') AS k FROM t),
  y AS (SELECT *, list_transform(list_filter(list_transform(k, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> ''),
          lambda c: greatest(1, len(regexp_extract_all(c, '{T.VOWELS_EN}')) - CASE WHEN c LIKE '%e' AND len(regexp_extract_all(c, '{T.VOWELS_EN}')) > 1 THEN 1 ELSE 0 END)) AS y FROM k),
  c AS (SELECT {keep}, t, len(k)::INT AS words, ({_sentences('t')})::INT AS sentences, length(regexp_replace(array_to_string(k, ''), '[^A-Za-z0-9]', '', 'g'))::INT AS chars,
          coalesce(list_sum(y), 0)::INT AS syllables, len(list_filter(y, lambda n: n >= 3))::INT AS polysyllables FROM y)"""


_FLESCH = f"206.835::DOUBLE - 1.015::DOUBLE * ({_W} / {_S}) - 84.6::DOUBLE * ({_Y} / {_W})"


def _sql_order(columns: list[str], table: str) -> str:
    places = ", ".join(f"x[1 + floor({p} * (n - 1))::BIGINT] AS {k}" for k, p in QUANTILES.items())
    one = [f"SELECT '{c}' AS metric, count({c}) AS n, list_sort(list({c}::DOUBLE) FILTER ({c} IS NOT NULL)) AS x FROM t" for c in columns]
    return f"WITH t AS ({table}), v AS ({' UNION ALL '.join(one)}) SELECT metric, n, (x[1 + (n - 1) // 2] + x[1 + n // 2]) / 2 AS median, {places} FROM v"


def _chosen(values: list[str]) -> str:
    return f"{_list(values)}[doc_id % {len(values)} + 1]"


def _values(table: dict) -> str:
    return ", ".join(f"({_q(k)}, {_q(v) if isinstance(v, str) else f'{v}::DOUBLE'})" for k, v in table.items())


def _sql_subjectivity() -> str:
    low = f"lower(regexp_replace('It ' || {_chosen(_OPINIONS)} || ' ' || text, '{T.WS}+|_', ' ', 'g'))"
    for phrase, joined in subjectivity.PHRASES.items():
        low = f"replace({low}, {_q(phrase)}, {_q(joined)})"
    low = f"replace({low}, '’', {_q(chr(39))})"
    negative = f"t.w IN ({', '.join(map(_q, O.NEGATIONS))}) OR t.w LIKE {_q('%' + O.NEGATED_END)}"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({low}, {_q(subjectivity.TOKEN)}) AS k FROM documents WHERE lang = 'en'),
  t AS (SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS i FROM d),
  weight(w, x) AS (VALUES {_values(O.WEIGHTS)}), degree(w, x) AS (VALUES {_values(O.DEGREES)}),
  o AS (SELECT doc_id, i, w, x FROM t JOIN weight USING (w)),
  c AS (SELECT o.doc_id, o.i, o.w, o.x, t.i AS j, {negative} AS negative, degree.x AS degree, t.w IN ({", ".join(map(_q, O.BREAKS))}) AS ends
          FROM o LEFT JOIN t ON t.doc_id = o.doc_id AND t.i BETWEEN o.i - {O.SCOPE} AND o.i - 1 LEFT JOIN degree ON degree.w = t.w),
  s AS (SELECT *, coalesce(max(CASE WHEN ends THEN j END) OVER (PARTITION BY doc_id, i), -1) AS border FROM c),
  g AS (SELECT doc_id, i, w, least(1, any_value(x) * coalesce(arg_max(degree, j) FILTER (j > border AND degree IS NOT NULL), 1))
          * CASE WHEN coalesce(bool_or(negative) FILTER (j > border), false) THEN {O.NEGATED}::DOUBLE ELSE 1 END AS x FROM s GROUP BY doc_id, i, w),
  a AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words, round(avg(x), 9) AS score FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS opinions, coalesce(words, '') AS words, coalesce(score, 0) AS subjectivity, coalesce(score, 0) > {L.SUBJECTIVITY_ABOVE} AS subjective FROM documents LEFT JOIN a USING (doc_id) WHERE lang = 'en'"""


def _sql_lemmas() -> str:
    def one(lang: str, stop: list[str]) -> str:
        rules = " ".join(f"WHEN w LIKE {_q('%' + r.ending)} AND length(w) >= {len(r.ending) + r.least} THEN substr(w, 1, length(w) - {len(r.ending)}) || {_q(r.to)}" for r in lemmas.RULES[lang])
        text = _squeeze(f"{_chosen(_INFLECTED[lang])} || ' ' || text")
        return f"""(WITH d AS (SELECT doc_id, regexp_extract_all({text}, {_q(lemmas.token_pattern(lang))}) AS k FROM documents WHERE lang = '{lang}'),
  t AS (SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS i FROM d),
  l AS (SELECT doc_id, i, replace(lower(w), '’', {_q(chr(39))}) AS w FROM t), x(w, own) AS (VALUES {_values(lemmas.EXCEPTIONS[lang])}),
  r AS (SELECT doc_id, i, coalesce(own, CASE {rules} ELSE w END) AS w FROM l LEFT JOIN x USING (w) WHERE regexp_matches(w, {_q(lemmas.WORDLIKE)}) AND w NOT IN ({", ".join(map(_q, stop))})),
  a AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS s FROM r GROUP BY doc_id)
SELECT doc_id, lang, coalesce(n, 0)::INT AS n_words, coalesce(s, '') AS lemmas FROM documents LEFT JOIN a USING (doc_id) WHERE lang = '{lang}')"""

    return one("en", STOP_WORDS) + " UNION ALL " + one("es", STOP_WORDS_ES)


def _sql_readability_en() -> str:
    m = {
        "flesch": _FLESCH,
        "fkgl": f"0.39::DOUBLE * ({_W} / {_S}) + 11.8::DOUBLE * ({_Y} / {_W}) - 15.59::DOUBLE",
        "fog": f"0.4::DOUBLE * (({_W} / {_S}) + 100::DOUBLE * ({_P} / {_W}))",
        "smog": _SMOG,
        "ari": f"4.71::DOUBLE * ({_C} / {_W}) + 0.5::DOUBLE * ({_W} / {_S}) - 21.43::DOUBLE",
        "coleman_liau": f"0.0588::DOUBLE * (({_C} / {_W}) * 100::DOUBLE) - 0.296::DOUBLE * (({_S} / {_W}) * 100::DOUBLE) - 15.8::DOUBLE",
    }
    return f"WITH d AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), {_en_counts('d', 'doc_id')} SELECT doc_id, {', '.join(readability.EN_COUNTS)}, {_metrics(m, 9)} FROM c"


def _sql_readability_es() -> str:
    ifsz = f"206.835::DOUBLE - 62.3::DOUBLE * ({_Y} / {_W}) - ({_W} / {_S})"
    m = {
        "ifsz": ifsz,
        "inflesz": ifsz,
        "fernandez_huerta": f"206.84::DOUBLE - 60::DOUBLE * ({_Y} / {_W}) - 1.02::DOUBLE * ({_W} / {_S})",
        "smog": _SMOG,
        "gutierrez_polini": f"95.2::DOUBLE - 9.7::DOUBLE * ({_C} / {_W}) - 0.35::DOUBLE * ({_W} / {_S})",
        "mu": f"CASE WHEN words > 1 AND mean_letters > 0 AND var_letters > 0 THEN ({_W} / ({_W} - 1)) * (mean_letters / var_letters) * 100::DOUBLE END",
    }
    return f"""WITH d AS (SELECT doc_id, text FROM documents WHERE lang = 'es'),
  t AS (SELECT doc_id, {_squeeze('text')} AS t FROM d),
  k AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '{T.TOKEN_ES}'), lambda x: regexp_replace(x, '[^{T.LETTERS_ES}]', '', 'g')), lambda x: x <> '') AS k FROM t),
  y AS (SELECT *, list_transform(k, lambda x: length(x)) AS n,
          list_transform(list_filter(list_transform(k, lambda x: regexp_replace(lower(x), '[^a-záéíóúüñ]', '', 'g')), lambda x: x <> ''), lambda c: greatest(1, len(regexp_extract_all(c, '{T.VOWELS_ES}')))) AS y FROM k),
  m AS (SELECT *, CASE WHEN len(k) > 0 THEN list_sum(n)::DOUBLE / len(k) ELSE 0 END AS mean_letters FROM y),
  c AS (SELECT doc_id, len(k)::INT AS words, ({_sentences('t')})::INT AS sentences, coalesce(list_sum(n), 0)::INT AS chars, coalesce(list_sum(y), 0)::INT AS syllables,
          len(list_filter(y, lambda v: v >= 3))::INT AS polysyllables, mean_letters,
          CASE WHEN len(k) > 0 THEN list_sum(list_transform(n, lambda x: (x - mean_letters) * (x - mean_letters))) / len(k) ELSE 0::DOUBLE END AS var_letters FROM m)
SELECT doc_id, words, sentences, chars, syllables, polysyllables, round(mean_letters, 6) AS mean_letters, round(var_letters, 6) AS var_letters, {_metrics(m, 6)} FROM c"""


_REQ = f"""r AS (SELECT doc_id AS pos, doc_id::VARCHAR AS req_id,
    'The system ' || ({_list(_MODALS)})[(doc_id % {len(_MODALS)}) + 1] || ' ' || ({_list(_PHRASES)})[(doc_id % {len(_PHRASES)}) + 1] || ' ' || text AS text
  FROM documents WHERE lang = 'en')"""


def _counted(phrases: list[str]) -> str:
    lines = ", ".join(
        f"CASE WHEN contains(text, {_q(p)}) THEN {_q(p + ': ')} || ((length(text) - length(replace(text, {_q(p)}, ''))) // {len(p)})::VARCHAR END" for p in sorted(set(phrases))
    )
    return f"nullif(array_to_string(list_filter([{lines}], lambda x: x IS NOT NULL), chr(10)), '')"


def _any(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {_q(p)})" for p in phrases) + ")"


def _findings_ctes() -> str:
    ambiguous = f"nullif(array_to_string(list_filter(regexp_extract_all(text, '{T.WORD}+'), lambda x: list_contains({_list(L.AMBIGUOUS)}, lower(x))), ', '), '')"
    words = f"regexp_extract_all(lower(text), '{T.WORD}+')"
    share = f"CASE WHEN len({words}) > 0 THEN least(1::DOUBLE, len(list_filter({words}, lambda x: list_contains({_list(L.SUBJECTIVITY)}, x))) * 5::DOUBLE / len({words})) ELSE 0::DOUBLE END"
    counters = ", ".join(f'{_counted(p)} AS "{h}"' for h, p in L.COUNTERS.items())
    return f"""{_REQ}, {_en_counts('r', 'req_id, text')},
  f AS (SELECT req_id AS "ID", text, {ambiguous} AS "Ambiguity Detected",
          coalesce(CASE WHEN words > 0 AND sentences > 0 THEN {_FLESCH} END, 206.835::DOUBLE) < 30 AS "Low Readability",
          CASE WHEN {_any(L.SECURITY)} THEN true END AS "Security Related", CASE WHEN NOT {_any(L.REQUIREMENT)} THEN true END AS "Not a Requirement",
          {share} AS subj_score, {counters} FROM c)"""


_HEADERS = ['"Ambiguity Detected"', '"Low Readability"', '"Security Related"', '"Not a Requirement"', *[f'"{h}"' for h in L.COUNTERS]]


def _sql_smell_findings() -> str:
    fired = " OR ".join([f"{h} IS NOT NULL" for h in _HEADERS if h != '"Low Readability"'] + ['"Low Readability"', "subj_score > 0.5"])
    return f'WITH {_findings_ctes()} SELECT "ID", {", ".join(_HEADERS)} FROM f WHERE {fired}'


def _report_ctes() -> str:
    flag = {k: f'coalesce("{k}", false)' if k in ("Low Readability", "Not a Requirement") else ("subj_score > 0.5" if k == "Subjectivity Detected" else f'"{k}" IS NOT NULL') for k in L.NEGATIVE}
    fired = " OR ".join([f"{h} IS NOT NULL" for h in _HEADERS if h != '"Low Readability"'] + ['"Low Readability"', "subj_score > 0.5"])
    flags = ", ".join(f'({v}) AS "smell__{k}"' for k, v in flag.items())
    names = ", ".join(f'CASE WHEN "smell__{k}" THEN {_q(k)} END' for k in L.NEGATIVE)
    count = " + ".join(f'"smell__{k}"::INT' for k in L.NEGATIVE)
    return f"""{_findings_ctes()},
  g AS (SELECT "ID" AS req_id, coalesce("Security Related", false) AS security_related, {flags}, ({fired}) AS in_output FROM f),
  b AS (SELECT req_id, security_related, ({count})::INT AS issues_count, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ';') AS negative_smells_list,
          {", ".join(f'"smell__{k}"' for k in L.NEGATIVE)}, in_output FROM g)"""


def _sql_report_summary() -> str:
    return f"""WITH {_report_ctes()}, s AS (SELECT list_sort(list(issues_count)) AS v FROM b)
SELECT count(*) AS total_requirements, count(*) FILTER (NOT in_output) AS missing_in_output, sum(issues_count)::BIGINT AS total_issues,
  count(*) FILTER (issues_count > 0) AS requirements_with_issues, count(*) FILTER (issues_count = 0) AS clean_count,
  round(count(*) FILTER (issues_count = 0) / count(*) * 100::DOUBLE, 6) AS clean_percent, round(count(*) FILTER (issues_count > 0) / count(*) * 100::DOUBLE, 6) AS any_issue_percent,
  round(avg(issues_count), 6) AS issues_mean, median(issues_count)::DOUBLE AS issues_median, max(issues_count) AS issues_max,
  count(*) FILTER (security_related) AS security_related_count, round(count(*) FILTER (security_related) / count(*) * 100::DOUBLE, 6) AS security_related_percent,
  (SELECT v[floor(0.9::DOUBLE * (len(v) - 1))::INT + 1] FROM s) AS issues_p90 FROM b"""


def _sql_report_stats() -> str:
    return f"WITH {_report_ctes()} " + " UNION ALL ".join(
        f'SELECT {_q(k)} AS smell, count(*) FILTER ("smell__{k}") AS count, round(count(*) FILTER ("smell__{k}") / count(*) * 100::DOUBLE, 6) AS percent FROM b' for k in L.NEGATIVE
    )


_NORM_TEXT = f"({_list(_HEADS)})[(doc_id % {len(_HEADS)}) + 1] || text || ' (a) b; 2. C (3);'"


def _sql_cleaned() -> str:
    return f"WITH c AS (SELECT doc_id, {cleaning.sql(_NORM_TEXT)} AS c FROM documents) SELECT doc_id, CASE WHEN c <> '' AND NOT regexp_matches(c, '[.!?]$') THEN c || '.' ELSE c END AS cleaned FROM c"


_VEC = "v AS (SELECT vec_id AS pos, 'R' || vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_ALL = f"""{_VEC}, p AS (SELECT a.pos AS pos_a, b.pos AS pos_b, a.id AS id_a, b.id AS id_b, list_dot_product(a.vec, b.vec) AS score FROM v a JOIN v b ON a.pos < b.pos)"""
_BOTH = f"""{_ALL.replace("p AS (", "p AS MATERIALIZED (")}, d AS MATERIALIZED (SELECT pos_a AS pos, pos_b AS other, score FROM p UNION ALL SELECT pos_b, pos_a, score FROM p),
  n AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(score, 9) DESC, other) AS rank FROM d)"""
_TOP = f"""{_BOTH}, k AS MATERIALIZED (SELECT * FROM n WHERE rank <= {TOP_K}), e AS MATERIALIZED (SELECT * FROM p WHERE score >= {PAIR_THRESHOLD}::DOUBLE),
  r AS (SELECT e.*, coalesce(ka.rank, 0)::INT AS rank_from_a, coalesce(kb.rank, 0)::INT AS rank_from_b FROM e
    LEFT JOIN k ka ON ka.pos = pos_a AND ka.other = pos_b LEFT JOIN k kb ON kb.pos = pos_b AND kb.other = pos_a WHERE ka.rank IS NOT NULL OR kb.rank IS NOT NULL)"""
_RED = f"{_ALL}, e AS (SELECT * FROM p WHERE score >= {PAIR_THRESHOLD}::DOUBLE)"
_CC = f"""WITH RECURSIVE {_RED}, x AS (SELECT pos_a AS a, pos_b AS b FROM e UNION ALL SELECT pos_b, pos_a FROM e),
  reach AS (SELECT pos AS node, pos AS root FROM v UNION SELECT x.b, reach.root FROM reach JOIN x ON x.a = reach.node WHERE reach.root < x.b),
  m AS (SELECT node AS pos, min(root) AS root FROM reach GROUP BY node)"""


def oracle_sql() -> dict:
    best_sim = """
WITH q AS (SELECT vec_id AS pos, 'G' || (vec_id // 4) AS id, 'T' || vec_id AS title, embedding::DOUBLE[] AS vec FROM embeddings),
r AS (SELECT vec_id AS ref_pos, 'G' || ((vec_id + 6) // 4) AS id, 'text ' || vec_id AS text, 'law ' || label AS legal, CASE WHEN label % 2 = 0 THEN 'es' ELSE 'en' END AS lang, embedding::DOUBLE[] AS vec
      FROM embeddings WHERE label <> 9),
s AS (SELECT q.pos, q.id, q.title, r.*, CASE WHEN r.vec IS NOT NULL THEN list_dot_product(q.vec, r.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(r.vec, r.vec))) END AS sim FROM q LEFT JOIN r ON q.id = r.id),
w AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(sim, 12) DESC, ref_pos) AS rn, count(ref_pos) OVER (PARTITION BY pos) AS n FROM s)
SELECT id, title, '' AS requirement_text, n::INT AS num_valid_references, round(sim, 9) AS best_cosine_similarity, legal AS best_legal_reference, lang AS best_reference_language, text AS best_reference_text FROM w WHERE rn = 1"""
    best_tok = f"""
WITH q AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{T.TOKEN_EN}') AS k FROM benchmark WHERE text IS NOT NULL),
r AS (SELECT doc_id AS ref_pos, doc_id % (SELECT greatest(count(*), 1) FROM benchmark) AS id, regexp_extract_all(lower(text), '{T.TOKEN_EN}') AS k, md5(text) AS excerpt FROM documents WHERE text IS NOT NULL),
j AS (SELECT q.id, r.ref_pos, r.excerpt, q.k AS a, r.k AS b, list_distinct(q.k) AS da, list_distinct(r.k) AS db FROM q JOIN r ON q.id = r.id),
s AS (SELECT id, ref_pos, excerpt, CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda t: list_contains(db, t))) / len(a) ELSE 0 END AS p, CASE WHEN len(b) > 0 THEN len(list_filter(b, lambda t: list_contains(da, t))) / len(b) ELSE 0 END AS r FROM j),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(f1, 12) DESC, ref_pos) AS rn FROM f),
o AS (SELECT id, 'item' AS title, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, 'doc ' || ref_pos AS best_legal_reference, excerpt AS best_normative_excerpt FROM w WHERE rn = 1)"""
    words = f"list_filter(regexp_extract_all(lower({_squeeze('text')}), '{T.WORD}+'), lambda x: NOT list_contains({_list(STOP_WORDS)}, x))"
    share = f"regexp_extract_all(lower(text), '{T.WORD}+')"
    kept = [k for k in range(8) if k % 3 != 2]
    pool = [f"(({' + '.join(f'vec[{8 * t + d + 1}]' for t in kept)}) / {len(kept)}::DOUBLE)" for d in range(8)]
    return {
        "readability_en": _sql_readability_en(),
        "readability_es": _sql_readability_es(),
        "readability_statistics": _sql_order(_READABILITY, _sql_readability_en()),
        "amount_statistics": _sql_order(_AMOUNTS, "SELECT * FROM sale_lines"),
        "smell_findings": _sql_smell_findings(),
        "smell_subjectivity": f"WITH {_REQ} SELECT req_id, round(CASE WHEN len({share}) > 0 THEN least(1::DOUBLE, len(list_filter({share}, lambda x: list_contains({_list(L.SUBJECTIVITY)}, x))) * 5::DOUBLE / len({share})) ELSE 0 END, 9) AS subjectivity FROM r",
        "subjectivity_in_context": _sql_subjectivity(),
        "smell_default_rules": f"""WITH {_findings_ctes()} SELECT "ID", "Ambiguity Detected" AS ambiguity, coalesce("Security Related", false) AS security, coalesce("Not a Requirement", false) AS not_a_requirement FROM f
            WHERE "Ambiguity Detected" IS NOT NULL OR "Low Readability" OR subj_score > 0.5 OR "Security Related" IS NOT NULL OR "Not a Requirement" IS NOT NULL""",
        "report_by_requirement": f"WITH {_report_ctes()} SELECT * FROM b",
        "report_stats": _sql_report_stats(),
        "report_summary": _sql_report_summary(),
        "smell_input": f"SELECT CASE WHEN doc_id % 3 > 0 THEN 'R' || doc_id ELSE printf('REQ-%04d', doc_id + 1) END AS req_id, md5({_strip('text')}) AS text_md5 FROM documents",
        "cleaned_texts": _sql_cleaned(),
        "cleaned_counts": "SELECT count(*) AS total, count(*) FILTER (lang = 'es') AS cleaned_es, count(*) FILTER (lang = 'en') AS cleaned_en FROM documents",
        "redundant_pairs": f"WITH {_RED} SELECT id_a, id_b, round(score, 6) AS score, 0 AS rank_from_a, 0 AS rank_from_b FROM e",
        "redundant_pairs_top_k": f"WITH {_TOP} SELECT id_a, id_b, round(score, 6) AS score, rank_from_a, rank_from_b FROM r",
        "requirement_metrics_top_k": f"""WITH {_TOP}, s AS (SELECT pos, sum(score) AS s FROM d GROUP BY pos), g AS (SELECT pos, count(*) AS n FROM (SELECT pos_a AS pos FROM r UNION ALL SELECT pos_b FROM r) GROUP BY pos)
            SELECT id, round(coalesce(s, 0) / (SELECT count(*) - 1 FROM v), 6) AS mean_sim, coalesce(n, 0) AS degree_t FROM v LEFT JOIN s USING (pos) LEFT JOIN g USING (pos)""",
        "neighbour_ranks": f"WITH {_BOTH} SELECT pos, other, rank::INT AS rank FROM n WHERE rank <= {TOP_K}",
        "requirement_metrics": f"""WITH {_RED}, d AS (SELECT pos_a AS pos, score FROM p UNION ALL SELECT pos_b, score FROM p),
            s AS (SELECT pos, sum(score) AS s FROM d GROUP BY pos), g AS (SELECT pos, count(*) AS n FROM (SELECT pos_a AS pos FROM e UNION ALL SELECT pos_b FROM e) GROUP BY pos)
            SELECT id, round(coalesce(s, 0) / (SELECT count(*) - 1 FROM v), 6) AS mean_sim, coalesce(n, 0) AS degree_t FROM v LEFT JOIN s USING (pos) LEFT JOIN g USING (pos)""",
        "requirement_clusters": f"""{_CC}, sc AS (SELECT a.pos, a.root, avg(list_dot_product(va.vec, vb.vec)) AS mean FROM m a JOIN m b ON a.root = b.root AND a.pos <> b.pos JOIN v va ON va.pos = a.pos JOIN v vb ON vb.pos = b.pos GROUP BY a.pos, a.root),
            rep AS (SELECT root, arg_min(pos, (-round(mean, 9), pos)) AS pos FROM (SELECT root, pos, mean FROM sc) GROUP BY root),
            g AS (SELECT root, count(*) AS size, string_agg('R' || pos, ',' ORDER BY pos) AS members FROM m GROUP BY root)
            SELECT (row_number() OVER (ORDER BY size DESC, root))::INT AS cluster_id, size::INT AS size, 'R' || coalesce(rep.pos, g.root) AS representative, members FROM g LEFT JOIN rep USING (root)""",
        "redundancy_summary": f"""{_CC}, g AS (SELECT root, count(*) AS n FROM m GROUP BY root)
            SELECT (SELECT count(*) FROM v) AS n_requirements, (SELECT count(*) * (count(*) - 1) // 2 FROM v) AS n_pairs_total, (SELECT count(*) FROM e) AS n_pairs_redundant, count(*) AS n_clusters,
            coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS redundant_requirements, round(coalesce(sum(n) FILTER (n > 1), 0) / (SELECT count(*) FROM v), 6) AS redundancy_rate FROM g""",
        "similarity_cells": f"WITH {_VEC} SELECT a.id AS id_a, b.id AS id_b, round(list_dot_product(a.vec, b.vec), 6) AS score FROM v a CROSS JOIN v b",
        "pooled_vectors": f"WITH {_VEC}, m AS (SELECT id, [{', '.join(pool)}] AS x FROM v), n AS (SELECT id, x, greatest(sqrt(list_dot_product(x, x)), 1e-12) AS l FROM m) SELECT id, {', '.join(f'round(x[{d + 1}] / l, 9) AS x{d}' for d in range(8))} FROM n",
        "preprocessed_texts": f"SELECT doc_id, array_to_string({words}, ' ') AS words FROM documents",
        "lemmatised_texts": _sql_lemmas(),
        "hashed_texts": f"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}+'), lambda x: (('0x' || substr(md5(x), 1, 15))::BIGINT % {HASHED} + 1) * CASE WHEN substr(md5(x), 16, 1) >= '8' THEN 1 ELSE -1 END) AS h FROM documents),
            s AS (SELECT doc_id, [{", ".join(f"len(list_filter(h, lambda v: v = {k + 1})) - len(list_filter(h, lambda v: v = -{k + 1}))" for k in range(HASHED))}]::DOUBLE[] AS x FROM c),
            n AS (SELECT doc_id, x, sqrt(list_dot_product(x, x)) AS l FROM s)
            SELECT doc_id, CASE WHEN l > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS norm, {", ".join(f"round(x[{k + 1}] / greatest(l, 1e-12), 9) AS x{k}" for k in range(HASHED))} FROM n""",
        "best_reference_similarity": best_sim,
        "best_reference_tokens": best_tok + " SELECT * FROM o",
        "match_series": f"""SELECT place, metric, value FROM (SELECT row_number() OVER (ORDER BY id) AS place, precision, recall, f1 FROM ({best_tok} SELECT * FROM o)) UNPIVOT (value FOR metric IN (precision, recall, f1))
            UNION ALL SELECT place, 'best_cosine_similarity', s FROM (SELECT row_number() OVER (ORDER BY substr(title, 2)::BIGINT) AS place, best_cosine_similarity AS s FROM ({best_sim})) WHERE s IS NOT NULL""",
        "f1_histogram": best_tok
        + ", e AS (SELECT min(f1) AS lo, max(f1) AS hi FROM o) SELECT (CASE WHEN hi > lo THEN least(19, floor((f1 - lo) / (hi - lo) * 20)) ELSE 0 END)::INT AS bin, count(*) AS count FROM o, e GROUP BY 1",
    }
