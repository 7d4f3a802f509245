"""Mixing sources to target weights by temperature.

A source's share of tokens is raised to an exponent between 0 (all sources alike)
and 1 (as they are); the exponent is bisected until the weights meet a target
entropy or a limit on how often a source repeats. The weights are realised as
block permutations: a source's documents are dealt into blocks by a hash, each
epoch permutes the blocks and the documents in them, and the last epoch is cut
where the source's token budget is spent. A document's place in an epoch is a
64-bit number whose upper half permutes the blocks, its lower half the documents
of a block; the places are given out, so sorting by (epoch, place) plays a source.

Everything is aggregates: per-source totals, and for the cut a descent by the
places' digits, 4096 sums for each source at a time. The decision for a document
needs only its source's row, so documents are never shuffled by source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, same, table, text_or_empty

#: A source is repeated at most so often.
MAX_REPETITION = 2.0
#: About so many tokens make a block.
BLOCK_TOKENS = 1 << 16
SEED = 17
GRID, PASSES = 32, 5


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass
class Mixture:
    """exponent, and weights: source, tokens, rows, weight, repetition."""

    exponent: float
    weights: DataFrame


def _measured(totals: DataFrame, exponents: list[float], budget: float | None) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and the largest repetition for several exponents, in one aggregation."""
    peak, floor = totals.agg(F.max("tokens"), F.min("tokens")).first()
    x = F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("x")
    share = F.col("tokens") / F.lit(float(peak))
    rows = (
        totals.select(x, share.alias("p"))
        .groupBy("x")
        .agg(F.sum(F.pow("p", "x")).alias("z"), F.sum(F.pow("p", "x") * F.log("p")).alias("zl"))
        .collect()
    )
    out = {}
    for r in rows:
        entropy = _ln(r.z) - r.x * r.zl / r.z
        # weight / tokens is largest for the smallest source, smallest for the largest.
        low, high = 1.0 / r.z / peak, (floor / peak) ** r.x / r.z / floor
        out[r.x] = (entropy, high * (budget if budget else 1.0 / low))
    return out


def _ln(v: float) -> float:
    import math

    return math.log(v)


def mixture(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget_tokens: float | None = None) -> Mixture:
    """Bisect the exponent: the smallest one whose largest repetition is within the limit,
    or the largest one whose entropy reaches the target (as a share of the largest possible).

    Without a budget it is the least one that uses every document once, so the
    largest source is taken once and the others once or more. Each pass of the
    bisection tries 31 inner points, five halvings, in one small job. Sources without
    tokens have no weight and repetition 1.
    """
    own = totals.where("tokens > 0")
    n = own.count()
    exponent = 1.0
    if n:

        def enough(m: tuple[float, float]) -> bool:  # whether a larger exponent may be tried (entropy) or is not needed (repetition)
            return m[0] >= target_entropy * _ln(n) - 1e-12 if target_entropy is not None else m[1] > max_repetition + 1e-12

        low, high = 0.0, 1.0
        ends = _measured(own, [low, high], budget_tokens)
        if enough(ends[high]):
            exponent = high
        elif not enough(ends[low]):
            exponent = low
        else:
            for _ in range(PASSES):
                grid = [low + (high - low) * k / GRID for k in range(1, GRID)]
                m = _measured(own, grid, budget_tokens)
                fine = [x for x in grid if enough(m[x])]
                low, high = max(fine, default=low), min([x for x in grid if not enough(m[x])], default=high)
            exponent = low if target_entropy is not None else high
    z = own.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent))), F.max("tokens")).first()
    weight = F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(float(z[0] or 1))
    budget = budget_tokens or (z[1] * z[0] / z[1] ** exponent if n else 0.0)
    repetition = F.when(F.col("tokens") > 0, weight * F.lit(float(budget)) / F.col("tokens")).otherwise(F.lit(1.0))
    # Rounding must not take a copy from a source that is meant to appear a whole number of times.
    snapped = F.when(F.abs(repetition - F.round(repetition)) < 1e-9, F.round(repetition)).otherwise(repetition)
    return Mixture(exponent, totals.select("source", "tokens", "rows", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"), snapped.alias("repetition")))


def _hash(*parts) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts])


def _place(source: Column, block: Column, key: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch of its source; signed order is the order of play."""
    upper = _hash(seed + 2, source, block, epoch).bitwiseAND(F.lit(-(1 << 32)))
    return upper.bitwiseOR(_hash(seed + 3, key, epoch).bitwiseAND(F.lit((1 << 32) - 1)))


def _block(key: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(_hash(seed + 1, key), n_blocks)


def plan(docs: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, **target) -> tuple[Mixture, DataFrame]:
    """The mixture, and for each source its repetition, blocks and where its last epoch is cut."""
    text = text_or_empty()
    rows = materialize(
        docs.select(F.col("source").cast("string").alias("source"), token_count(text).alias("tokens"), _hash(seed, F.col("doc_id"), text).alias("key")), "mixing"
    )
    totals = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mixing-totals")
    mix = mixture(totals, **target)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long")
    whole = F.floor("repetition").cast("int")
    # Tokens of the last, partial epoch.
    source = mix.weights.select("source", "weight", "repetition", n_blocks.alias("n_blocks"), whole.alias("whole"), ((F.col("repetition") - whole) * F.col("tokens")).alias("rest"))
    source = materialize(source, "mixing-sources")
    cut = _cuts(rows, source, seed).withColumnRenamed("source", "s")
    out = source.join(cut, same(F.col("source"), F.col("s")), "left")
    return mix, materialize(out.select("source", "weight", "repetition", "n_blocks", "whole", "rest", "cut"), "mixing-plan")


def _cuts(rows: DataFrame, source: DataFrame, seed: int) -> DataFrame:
    """source and cut: the first place up to which the last epoch's documents have ``rest`` tokens.

    Digit by digit: of each source's rows that begin as the cut does, the sums by
    the next twelve bits tell the next digit. Most sources are done when one place is
    left, after about log(rows) / 12 bits; none takes more than six rounds.
    """
    state = source.where("rest > 0").select(F.col("source").alias("s"), "n_blocks", "whole", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    found, shift = [], 64
    while shift:
        wide = min(12, shift)
        own = rows.join(state, same(F.col("source"), F.col("s")))
        own = own.withColumn("place", _place(F.col("source"), _block(F.col("key"), F.col("n_blocks"), seed), F.col("key"), F.col("whole"), seed))
        bits = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
        if shift < 64:
            own = own.where(F.shiftrightunsigned(bits, shift) == F.col("prefix"))
        shift -= wide
        sums = own.groupBy("source", "n_blocks", "whole", "left", "prefix", F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << wide) - 1)).alias("digit")).agg(
            F.sum("tokens").alias("tokens"), F.min("place").alias("lo"), F.max("place").alias("hi")
        )
        w = Window.partitionBy("source").orderBy("digit")
        at = sums.withColumn("done", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("done >= left")
        at = at.withColumn("k", F.row_number().over(w)).where("k = 1")
        after = (F.col("left") - F.col("done") + F.col("tokens")).alias("left")
        state = at.select(F.col("source").alias("s"), "n_blocks", "whole", after, (F.shiftleft("prefix", wide) + F.col("digit")).alias("prefix"), "lo", "hi")
        state = materialize(state, "mixing-cuts")
        found.append(state.where("lo = hi").select(F.col("s").alias("source"), F.col("lo").alias("cut")))
        state = state.where("lo < hi").drop("lo", "hi")
        if state.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def apply_plan(docs: DataFrame, steps: DataFrame, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` with __block, __weight, __repetition, __copies and __places (one for each copy); nothing but a join with one row for each source."""
    side = steps.select([F.col(c).alias(f"__{c}") for c in steps.columns])
    own = docs.select([F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])
    out = own.withColumn("__key", _hash(seed, F.col("doc_id"), text_or_empty()))
    out = out.join(side, same(F.col("source").cast("string"), F.col("__source")))
    out = out.withColumn("__block", _block(F.col("__key"), F.col("__n_blocks"), seed))
    place = lambda e: _place(F.col("__source"), F.col("__block"), F.col("__key"), e, seed)
    more = (F.col("__rest") > 0) & F.coalesce(place(F.col("__whole")) <= F.col("__cut"), F.lit(True))
    out = out.withColumn("__copies", F.col("__whole") + more.cast("int"))
    epochs = F.filter(F.sequence(F.lit(0), F.col("__copies")), lambda e: e < F.col("__copies"))
    return out.withColumn("__places", F.transform(epochs, place))


def mixed(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it, with their own columns.

    A null source is a source of its own; a null or empty text has no tokens and
    stays once for each whole epoch; rows that repeat doc_id and text share one
    decision. Columns whose names begin with two underscores stay too. An empty
    table gives an empty result.
    """
    # The operator's own columns begin with two underscores; those of the input go along in one struct.
    held = docs.select("doc_id", F.col("text"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    _, steps = plan(docs, seed, **target)
    out = apply_plan(held, steps, seed)
    return out.select(F.explode("__places"), "row").select([F.col("row").getField(c).alias(c) for c in docs.columns])


def scheduled(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """source, epoch, place, block, doc_id: the order in which each source's documents are played, a row for each copy."""
    _, steps = plan(docs, seed, **target)
    out = apply_plan(docs.select("doc_id", "text", "source"), steps, seed)
    return out.select("source", F.posexplode("__places").alias("epoch", "place"), F.col("__block").alias("block"), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, source, n_tokens, block, weight, repetition, copies and places (in the permutation of each epoch) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    _, steps = plan(docs)
    return apply_plan(docs, steps).select(
        "doc_id",
        "source",
        token_count(text_or_empty()).alias("n_tokens"),
        F.col("__block").alias("block"),
        F.col("__weight").alias("weight"),
        F.col("__repetition").alias("repetition"),
        F.col("__copies").alias("copies"),
        F.array_join(F.transform("__places", lambda x: x.cast("string")), ",").alias("places"),
    )
