"""Best normative reference of each requirement, and token-matching scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize
from .skew import salted_join
from .token_overlap import best_overlaps
from .vectors import cosine

#: Pairs of a requirement and a reference, for each row of either, up to which a row is made for each pair.
FEW_PAIRS = 4


def best_by_similarity(requirements: DataFrame, references: DataFrame) -> DataFrame:
    """Each requirement with its reference of largest cosine, the first of equals, and how many it has.

    requirements: pos, id, title, text, vec; references: ref_pos, id, text,
    legal_reference, original_language, vec. Blank references don't count; a
    requirement without any has 0 and nulls. Requirements that repeat stay apart.
    """
    refs = references.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "").select(
        F.col("id").alias("__id"), F.col("text").alias("__text"), "legal_reference", "original_language", "ref_pos", F.col("vec").alias("__vec")
    )
    own = salted_join(requirements, refs, "id", "__id", "ref_pos", "left").withColumn("sim", F.when(F.col("__id").isNotNull(), cosine(F.col("vec"), F.col("__vec"))))
    # Best first: each part of a hot id has its best, combined before the shuffle, with the tie-break inside.
    rank = F.struct((-F.round("sim", 12)).alias("s"), "ref_pos")
    best = own.groupBy("pos", "id", "title", "text").agg(
        F.count("__id").cast("int").alias("num_valid_references"), F.min_by(F.struct("sim", "legal_reference", "original_language", "__text"), F.when(F.col("__id").isNotNull(), rank)).alias("b")
    )
    return best.select(
        "pos",
        "id",
        "title",
        F.col("text").alias("requirement_text"),
        "num_valid_references",
        F.col("b.sim").alias("best_cosine_similarity"),
        F.col("b.legal_reference").alias("best_legal_reference"),
        F.col("b.original_language").alias("best_reference_language"),
        F.col("b.__text").alias("best_reference_text"),
    )


def token_match(candidate: Column, reference: Column) -> Column:
    """precision, recall and f1 of greedy matching with an encoder under which only equal tokens are alike.

    Each token takes its best partner; with one-hot vectors that is 1 if the
    other side holds the token. Empty sides score 0.
    """
    # The tokens of both sides are found once; what is bound in a lambda isn't computed anew for each element.
    both = F.array(F.array_intersect(candidate, reference))
    hit = lambda x: F.transform(both, lambda c: F.size(F.filter(x, lambda t: F.array_contains(c, t))))[0] / F.size(x)
    p = F.when(F.size(candidate) > 0, hit(candidate)).otherwise(F.lit(0.0))
    r = F.when(F.size(reference) > 0, hit(reference)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def greedy_match(candidate: Column, reference: Column) -> Column:
    """precision, recall and f1 of greedy matching of token vectors (arrays of vectors of length 1)."""
    from .vectors import dot

    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    ok = (F.size(candidate) > 0) & (F.size(reference) > 0)
    p, r = (F.when(ok, best(a, b)).otherwise(F.lit(0.0)) for a, b in ((candidate, reference), (reference, candidate)))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def rescaled(score: Column, baseline: Column | float) -> Column:
    """(score - baseline) / (1 - baseline)."""
    b = F.lit(baseline) if isinstance(baseline, float) else baseline
    return (score - b) / (1 - b)


def best_by_token_match(requirements: DataFrame, references: DataFrame, scorer=token_match) -> DataFrame:
    """id, title, precision, recall, f1, best_legal_reference, best_normative_excerpt of requirements that have references.

    requirements: pos, id, title, text, tokens; references: ref_pos, id, text,
    legal_reference, tokens. Requirements without id or text and references
    without text drop out; the first of equal references wins.
    """
    reqs = requirements.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (T.strip(F.col("text")) != ""))
    refs = references.where(F.col("text").isNotNull())
    rank = F.struct((-F.round("s.f1", 12)).alias("f"), "ref_pos")
    if scorer is token_match and _many_pairs(reqs, refs):
        found = best_overlaps(reqs, refs).groupBy("pos", "id", "title").agg(F.min_by(F.struct("s", "ref_pos"), rank).alias("b"))
        # Written, so that Spark knows their size: the texts that nobody chose stay where they are if the chosen keys fit a broadcast.
        found = materialize(found.select("pos", "id", "title", "b.s", "b.ref_pos"), "token-matches")
        texts = refs.select("id", "ref_pos", "legal_reference", F.col("text").alias("__text")).join(found.select("id", "ref_pos"), ["id", "ref_pos"], "left_semi")
        # A text comes once for each requirement that chose it, so partitions as small as what is shuffled would be too few.
        texts = texts.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "ref_pos")
        best = found.join(texts.dropDuplicates(["id", "ref_pos"]), ["id", "ref_pos"]).select("pos", "id", "title", F.struct("s", "legal_reference", "__text").alias("b"))
    else:
        refs = refs.select(F.col("id").alias("__id"), F.col("text").alias("__text"), "legal_reference", "ref_pos", F.col("tokens").alias("__tokens"))
        own = salted_join(reqs, refs, "id", "__id", "ref_pos", "inner").withColumn("s", scorer(F.col("tokens"), F.col("__tokens")))
        best = own.groupBy("pos", "id", "title").agg(F.min_by(F.struct("s", "legal_reference", "__text"), rank).alias("b"))
    return best.select("pos", "id", "title", "b.s.precision", "b.s.recall", "b.s.f1", F.col("b.legal_reference").alias("best_legal_reference"), F.col("b.__text").alias("best_normative_excerpt"))


def _many_pairs(reqs: DataFrame, refs: DataFrame) -> bool:
    """Whether the pairs with equal ids are many more than the rows; one row of counts."""
    counts = reqs.select("id", F.lit(1).alias("q"), F.lit(0).alias("r")).unionByName(refs.where("id is not null").select("id", F.lit(0).alias("q"), F.lit(1).alias("r")))
    counts = counts.groupBy("id").agg(F.sum("q").alias("q"), F.sum("r").alias("r"))
    n = counts.agg(F.sum(F.col("q").cast("double") * F.col("r")).alias("pairs"), F.sum(F.col("q") + F.col("r")).alias("rows")).first()
    return (n.pairs or 0) > FEW_PAIRS * (n.rows or 0)


def series(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """place (from 1, in the given order), metric, value: the lines of a plot; rows without a value drop out."""
    from .redundancy import numbered

    rows = numbered(df, "place", F.col(order)).withColumn("place", (F.col("place") + 1).cast("long"))
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in values]))
    return rows.select("place", points.alias("p")).select("place", "p.metric", "p.value").where("value is not null")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, count of equal-width bins between the least and the largest value; the last bin holds its right end."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width * bins))).otherwise(F.lit(0))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
