"""Exact order statistics of numeric columns without sorting them.

A sketch of quantiles brackets each wanted place between two values, and one
aggregation counts what lies below, on and between them; whatever the sketch's
error, the counts tell on which side the place is. Rounds go on inside the bracket
until few values are left, which are counted one by one. A round is two
aggregations for all places of all columns together, and it leaves some 4 of
10,000 values, so a column of 100 billion values takes three.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructField, StructType

from ..storage import discard, materialize

#: Brackets of so many values are counted value by value; the driver holds no more for each place.
FEW = 4096
#: Of the sketch: its ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


@dataclass
class _Place:
    """The value at a place of a column's sorted values; it lies between low and high, both excluded."""

    column: str
    place: int
    inside: int
    below: int = 0
    low: object = None
    high: object = None
    found: object = None
    done: bool = False
    stuck: bool = False

    def within(self) -> Column:
        c = F.col(self.column)
        ok = c.isNotNull()
        if self.low is not None:
            ok = ok & (c > F.lit(self.low))
        if self.high is not None:
            ok = ok & (c < F.lit(self.high))
        return ok

    def narrow(self, a, b, under: int, on_a: int, between: int, on_b: int) -> None:
        at = self.place - self.below
        before = (self.low, self.high)
        if at < under:
            self.high, self.inside = a, under
        elif at < under + on_a:
            self.found, self.done = a, True
        elif at < under + on_a + between:
            self.low, self.high, self.below, self.inside = a, b, self.below + under + on_a, between
        elif at < under + on_a + between + on_b:
            self.found, self.done = b, True
        else:
            passed = under + on_a + between + on_b
            self.low, self.below, self.inside = b, self.below + passed, self.inside - passed
        self.stuck = before == (self.low, self.high)


def _split(rows: DataFrame, open_: list[_Place]) -> list[tuple]:
    """Two values for each place that lie near it on either side."""
    exprs = []
    for i, p in enumerate(open_):
        own = F.when(p.within(), F.col(p.column))
        if p.stuck:  # the sketch's numbers are doubles; beyond their precision the middle of the range splits
            exprs += [F.min(own).alias(f"a{i}"), F.max(own).alias(f"b{i}")]
            continue
        at = (p.place - p.below + 0.5) / p.inside
        sides = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
        both = F.percentile_approx(own, sides, ACCURACY)
        exprs += [both[0].alias(f"a{i}"), both[1].alias(f"b{i}")]
    got = rows.agg(*exprs).first()
    out = []
    for i, p in enumerate(open_):
        a, b = got[f"a{i}"], got[f"b{i}"]
        if p.stuck and isinstance(a, int):
            a = b = (a + b) // 2
        out.append((a, b))
    return out


def _count(rows: DataFrame, open_: list[_Place], ends: list[tuple]) -> None:
    exprs = []
    for i, (p, (a, b)) in enumerate(zip(open_, ends)):
        c, own = F.col(p.column), p.within()
        exprs += [
            F.count(F.when(own & (c < F.lit(a)), 1)).alias(f"u{i}"),
            F.count(F.when(own & (c == F.lit(a)), 1)).alias(f"a{i}"),
            F.count(F.when(own & (c > F.lit(a)) & (c < F.lit(b)), 1)).alias(f"m{i}"),
            F.count(F.when(own & (c == F.lit(b)) & (F.lit(b) > F.lit(a)), 1)).alias(f"b{i}"),
        ]
    got = rows.agg(*exprs).first()
    for i, (p, (a, b)) in enumerate(zip(open_, ends)):
        p.narrow(a, b, got[f"u{i}"], got[f"a{i}"], got[f"m{i}"], got[f"b{i}"])


def _finish(rows: DataFrame, column: str, left: list[_Place]) -> None:
    """Counts the values in a column's last brackets in one pass; places that share a bracket share its counts."""
    brackets = list({(p.low, p.high): p for p in left}.values())
    if not brackets:
        return
    held = F.array_compact(F.array(*[F.when(p.within(), F.lit(i)) for i, p in enumerate(brackets)]))
    counts = rows.select(F.col(column).alias("v"), F.explode(held).alias("i")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("k"))
    lists: dict[tuple, list] = {(p.low, p.high): [] for p in brackets}
    for i, v, k in counts.orderBy("i", "v").collect():  # FEW rows at most for each bracket
        lists[(brackets[i].low, brackets[i].high)].append((v, k))
    for p in left:
        seen = p.below
        for v, k in lists[(p.low, p.high)]:
            seen += k
            if p.place < seen:
                p.found = v
                break


def values_at(rows: DataFrame, places: dict[str, list[int]], sizes: dict[str, int]) -> dict[tuple[str, int], object]:
    """The values at 0-based places among each column's sorted values.

    sizes: how many values each column has, nulls not counted. Places outside
    have no value. NaN is the greatest number, as everywhere in Spark.
    """
    states = {(c, k): _Place(c, k, sizes[c]) for c, ks in places.items() for k in ks if 0 <= k < sizes[c]}
    while True:
        open_ = [p for p in states.values() if not p.done and p.inside > FEW]
        if not open_:
            break
        _count(rows, open_, _split(rows, open_))
    for column in places:
        _finish(rows, column, [p for p in states.values() if p.column == column and not p.done])
    return {key: p.found for key, p in states.items()}


def quantile_place(p: float, n: int) -> int:
    return floor(p * (n - 1))


def order_statistics(rows: DataFrame, columns: list[str], quantiles: dict[str, float]) -> DataFrame:
    """One row for each column: metric, n, median, and a column for each quantile.

    A quantile p is the value at place floor(p (n - 1)) of the sorted values, the
    median the mean of both middle ones. Nulls don't count; a column without
    values has n 0 and nulls. The columns alone are written to the shared folder
    once, so that no round computes them anew.
    """
    spark = rows.sparkSession
    safe = {c: f"c{i}" for i, c in enumerate(columns)}
    kept = materialize(rows.select([F.col(f"`{c}`").alias(s) for c, s in safe.items()]), "order")
    counted = kept.agg(*[F.count(s).alias(s) for s in safe.values()]).first()
    sizes = counted.asDict()
    wanted = {s: sorted({(n - 1) // 2, n // 2, *(quantile_place(p, n) for p in quantiles.values())}) if n else [] for s, n in sizes.items()}
    got = values_at(kept, wanted, sizes)
    discard(kept)
    out = []
    for c, s in safe.items():
        n = sizes[s]
        value = lambda k: float(got[(s, k)])  # noqa: B023, E731
        middle = (value((n - 1) // 2) + value(n // 2)) / 2 if n else None
        out.append((c, n, middle, *[value(quantile_place(p, n)) if n else None for p in quantiles.values()]))
    fields = [StructField("metric", StringType()), StructField("n", LongType()), *[StructField(k, DoubleType()) for k in ("median", *quantiles)]]
    return spark.createDataFrame(out, StructType(fields))


def floor_percentile(rows: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """One row with sorted(values)[floor(p (n - 1))], of the column's type; null for no values."""
    own = rows.select(F.col(f"`{value}`").alias("v"))
    n = own.agg(F.count("v")).first()[0]
    place = quantile_place(p, n) if n else 0
    found = values_at(own, {"v": [place]}, {"v": n}).get(("v", place))
    kind = own.schema["v"].dataType
    return rows.sparkSession.createDataFrame([(float(found) if isinstance(kind, (DoubleType, FloatType)) and found is not None else found,)], StructType([StructField(name, kind)]))
