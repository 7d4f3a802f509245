"""Joins in which a few keys hold a large part of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with a share of 1 / HOT of a side's rows are split; there are HOT of them at most, each in HOT parts at most.
HOT = 64


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, how: str) -> DataFrame:
    """Join on equal keys in which the right side's hot keys are split by ``order``, a column that tells its rows apart.

    A left row of a hot key meets each part once: with a left join it comes once for each part
    without a partner, so what follows has to aggregate. The hot keys are counted first, and are few: a
    bounded table is broadcast to either side.
    """
    counts = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * HOT >= F.col("__total"))  # one row beside
    hot = hot.select("__key", F.least(F.lit(HOT), F.ceil(F.col("__n") * HOT / F.col("__total"))).cast("int").alias("__parts"))

    def dealt(df: DataFrame, key: str, part: Column, name: str) -> DataFrame:
        own = df.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
        return own.withColumn(name, part).drop("__key", "__parts")

    parts = F.coalesce("__parts", F.lit(1))
    a = dealt(left, left_key, F.explode(F.sequence(F.lit(0), parts - 1)), "__left")
    b = dealt(right, right_key, F.pmod(F.xxhash64(order), parts).cast("int"), "__right")
    return a.join(b, (F.col(left_key) == F.col(right_key)) & (F.col("__left") == F.col("__right")), how).drop("__left", "__right")
