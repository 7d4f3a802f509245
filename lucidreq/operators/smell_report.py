"""Reports over smell findings: by requirement, by smell, and one summary row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .order_statistics import floor_percentile  # noqa: F401


def is_present(df: DataFrame, name: str) -> Column:
    """Booleans count as they are, texts if not blank, numbers always (0 too), collections if not empty."""
    if name not in df.columns:
        return F.lit(False)
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(T.strip(c) != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def parse_names(option: str) -> list[str]:
    """Names of a comma-separated option, trimmed, without empty ones and repeats."""
    return list(dict.fromkeys(x.strip() for x in option.split(",") if x.strip()))


def last_records(findings: DataFrame, order: str | None = None) -> DataFrame:
    """One record for each ID, the last one; null IDs drop out."""
    own = findings.where("ID is not null")
    if order is None:
        return own.dropDuplicates(["ID"])
    w = Window.partitionBy("ID").orderBy(F.desc(order))
    return own.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def input_rows(requirements: DataFrame) -> DataFrame:
    """req_id and text by first occurrence of the id; the text is that of the last one. Needs pos."""
    return requirements.groupBy("req_id").agg(F.min("pos").alias("pos"), F.max_by("text", "pos").alias("text"))


def by_requirement(requirements: DataFrame | None, findings: DataFrame, negative: list[str] | None = None, order: str | None = None) -> DataFrame:
    """req_id, text, security_related, issues_count, negative_smells_list and one flag for each negative smell.

    Requirements (req_id, text, pos) without findings are clean; without a table
    of requirements the findings' own IDs stand in.
    """
    names = list(dict.fromkeys(negative or L.NEGATIVE))
    out = last_records(findings, order)
    flags = {k: is_present(out, k) for k in names}
    secure = F.coalesce(F.col("`Security Related`"), F.lit(False)) if "Security Related" in out.columns else F.lit(False)
    found = out.select(F.col("ID").alias("req_id"), F.col("Requirement").alias("__own"), secure.alias("security_related"), *[v.alias(f"smell__{k}") for k, v in flags.items()], F.lit(True).alias("__hit"))
    if requirements is None:
        rows = found.withColumn("text", F.lit(None).cast("string"))
    else:
        rows = input_rows(requirements).select("req_id", "text").join(found, "req_id", "left")
    own = [F.coalesce(F.col(f"`smell__{k}`"), F.lit(False)) for k in names]
    return rows.select(
        "req_id",
        F.coalesce(F.nullif(F.coalesce("text", F.lit("")), F.lit("")), T.strip(F.col("__own"))).alias("text"),
        F.coalesce("security_related", F.lit(False)).alias("security_related"),
        sum((c.cast("int") for c in own), F.lit(0)).alias("issues_count"),
        F.concat_ws(";", *[F.when(c, F.lit(k)) for k, c in zip(names, own)]).alias("negative_smells_list"),
        *[c.alias(f"smell__{k}") for k, c in zip(names, own)],
        F.coalesce("__hit", F.lit(False)).alias("in_output"),
    )


def smell_stats(rows: DataFrame, negative: list[str] | None = None) -> DataFrame:
    """smell, count, percent of all requirements."""
    names = list(dict.fromkeys(negative or L.NEGATIVE))
    agg = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(f"`smell__{k}`").cast("long")), F.lit(0)).alias(f"c{i}") for i, k in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("smell"), F.col(f"c{i}").alias("count")) for i, k in enumerate(names)]))
    return agg.select("n", pairs.alias("p")).select("p.smell", "p.count", F.when(F.col("n") > 0, F.col("p.count") / F.col("n") * 100.0).otherwise(F.lit(0.0)).alias("percent"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: totals, clean and any-issue rates, issues per requirement, security label.

    The 90th percentile is the value at floor(0.9 (n - 1)) of the sorted counts,
    found from the counts' histogram, whose size is the number of smells + 1, in the
    same pass as the rest.
    """
    most = sum(c.startswith("smell__") for c in rows.columns)
    n, issues = F.count(F.lit(1)), F.col("issues_count")
    clean = F.coalesce(F.sum((issues == 0).cast("long")), F.lit(0))
    percent = lambda c: F.when(n > 0, c / n * 100.0).otherwise(F.lit(0.0))
    secure = F.coalesce(F.sum(F.col("security_related").cast("long")), F.lit(0))
    main = rows.agg(
        n.alias("total_requirements"),
        F.coalesce(F.sum((~F.col("in_output")).cast("long")), F.lit(0)).alias("missing_in_output"),
        F.coalesce(F.sum(issues), F.lit(0)).alias("total_issues"),
        (n - clean).alias("requirements_with_issues"),
        clean.alias("clean_count"),
        percent(clean).alias("clean_percent"),
        percent(n - clean).alias("any_issue_percent"),
        F.coalesce(F.avg(issues), F.lit(0.0)).alias("issues_mean"),
        F.coalesce(F.median(issues), F.lit(0.0)).alias("issues_median"),
        F.coalesce(F.max(issues), F.lit(0)).alias("issues_max"),
        secure.alias("security_related_count"),
        percent(secure).alias("security_related_percent"),
        *[F.sum((issues <= k).cast("long")).alias(f"__upto{k}") for k in range(most + 1)],
    )
    at = (F.lit(0.9) * (F.col("total_requirements") - 1)).cast("long")
    p90 = F.coalesce(*[F.when(F.col(f"__upto{k}") > at, F.lit(k)) for k in range(most + 1)])
    return main.withColumn("issues_p90", p90).drop(*[f"__upto{k}" for k in range(most + 1)])


def summary_pairs(row: DataFrame) -> DataFrame:
    """The summary as metric, value rows."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("p")).select("p.metric", "p.value")


def excluded_fields() -> list[str]:
    """What is left out by design, sorted."""
    return sorted(L.EXCLUDED)


NOTES = [
    "Security Related is a label: it changes neither the clean nor the any-issue rate.",
    "Conjunction, Continuances, Imperatives and References are left out by design.",
    "Without a table of requirements their number is taken from the findings, which may miss clean ones.",
]
