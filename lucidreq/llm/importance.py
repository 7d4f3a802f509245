"""Target-distribution importance resampling with hashed n-grams from a position table.

Every text's words are exploded with their places; for each order above one,
``lead()`` over a text's places gives the following words, so a row of the
position table becomes the runs that begin there. Runs are hashed into buckets,
counted on both sides, and the buckets' gains (how much likelier the target makes
a bucket than the corpus does) are joined back and summed for each text. With
noise of a Gumbel distribution on the sums, the best k are a sample without
replacement in proportion to the exponentiated sums.

The table of buckets has a fixed number of rows and is the only thing broadcast.
Texts are explicit rows of their own (``row``), so identifiers may repeat. Drawing
sorts ranges apart and adds their sizes: no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.redundancy import numbered
from .common import materialize, table, text_or_empty

#: Fixed values of the contract: orders of the runs, buckets, least words of a document that may be drawn, percent drawn, seed.
ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits; only A to Z are lower-cased; everything outside ASCII counts as a letter."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def positions(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, word: a row for each word of column ``text``, one with nulls for a text without words."""
    return texts.select(*keys, F.posexplode_outer(words_of(text_or_empty())).alias("pos", "word"))


def features(table_: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, keys: tuple[str, ...] = ("row",)) -> DataFrame:
    """keys, size, bucket of every run of 1 to ``orders`` words that begins at a place of the position table.

    A text without words keeps one row with nulls. Orders above one look ahead
    by windows over a text's places; a text's last words have fewer runs.
    """
    bucket = lambda r: F.pmod(F.crc32(r.cast("binary")), F.lit(buckets)).cast("int")
    if orders == 1:
        return table_.select(*keys, F.when(F.col("word").isNotNull(), F.lit(1)).alias("size"), bucket(F.col("word")).alias("bucket"))
    ahead = Window.partitionBy(*keys).orderBy("pos")
    table_ = table_.withColumns({f"w{k}": F.lead("word", k).over(ahead) for k in range(1, orders)})
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.col(f"w{k}")))  # null past the text's end
    listed = F.array(*[F.when(r.isNotNull(), F.struct(F.lit(k + 1).alias("size"), bucket(r).alias("bucket"))) for k, r in enumerate(runs)])
    return table_.select(*keys, F.explode_outer(F.array_compact(listed)).alias("f")).select(*keys, "f.size", "f.bucket")


def counts(rows: DataFrame, name: str) -> DataFrame:
    """bucket and how many features it has; combined before the shuffle to a row for each bucket and task."""
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln) of the ratio of smoothed shares; at most ``buckets`` rows."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    own = every.join(counts(corpus, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = own.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * (d("all_s") + float(buckets)) / ((d("s") + 1.0) * (d("all_t") + float(buckets)))
    return own.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))  # one row beside


def noise(key: Column, seed: int) -> Column:
    """floor(1000 Gumbel) from the first 32 bits of sha256('seed:key')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_features, weight, score, n_words of every row of ``docs`` (doc_id, text), against the texts of ``target``.

    Null texts count as empty; a text without words has no features, weight 0 and
    the score of its noise. Rows that repeat a doc_id stay apart and share their
    noise; a null doc_id has the noise of an empty one. An empty target makes all
    buckets equally likely there; an empty corpus gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if orders > 1:
        # The window deals the words anew, so rows are given their numbers once, in a table.
        rows = materialize(rows, "importance-rows")
    at = positions(rows, "row", "doc_id")
    # Hashed runs, a number each, are written once; both the counts and the sums read them.
    own = materialize(features(at, orders, buckets, ("row", "doc_id")), "importance-features")
    aim = features(positions(target.select(F.monotonically_increasing_id().alias("row"), "text"), "row"), orders, buckets)
    gain = materialize(gains(own, aim, buckets), "importance-gains")
    # The gains have a fixed number of rows, whatever the input.
    summed = (
        own.join(F.broadcast(gain), "bucket", "left")
        .groupBy("row", "doc_id")
        .agg(F.count("bucket").alias("n_features"), F.count_if(F.col("size") == 1).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    )
    score = F.col("weight") + noise(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    return summed.select("row", "doc_id", "n_features", "weight", score.alias("score"), "n_words")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the N documents with ``least_words`` words the best floor(percent N / 100) are drawn and ranked.

    Ties go to the smaller doc_id (a null one comes last); documents that aren't drawn have no rank. See :func:`weighed` for odd rows.
    """
    rows = materialize(weighed(docs, target, orders, buckets, seed), "importance-scores")
    may = rows.where(F.col("n_words") >= least_words)
    drawn = percent * may.count() // 100
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    placed = numbered(may, "place", *order).select("row", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")).where("rank is not null")
    return rows.join(placed, "row", "left").select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents against all benchmark texts, words as features."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_sql(word: str) -> str:
    """SQL for the unsigned crc32 of a string: eight shifts for each of its bytes."""
    data = f"list_transform(range(0, octet_length(encode({word}))), lambda i: ('0x' || substr(hex(encode({word})), 2 * i + 1, 2))::BIGINT)"
    byte = "list_reduce([1,2,3,4,5,6,7,8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(list_reduce({data}, lambda c, b: {byte}, 4294967295::BIGINT), 4294967295)"


def _words_sql(text: str) -> str:
    return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}'))"


SQL = f"""
WITH dw AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
bw AS (SELECT {_words_sql("text")} AS w FROM benchmark),
v AS (SELECT w, {_crc_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket), sums),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN f USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT {PERCENT} * count(*) // 100 FROM r WHERE n_features >= {LEAST_WORDS}) THEN place END AS rank
FROM k
"""
