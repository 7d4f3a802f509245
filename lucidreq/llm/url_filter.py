"""URL filters: rules on hosts and path prefixes, and a path-template tree for what no rule decides.

Each host's paths form a tree of segments. Segments with digits or long hexadecimal
runs are typed at once; going down from the root, a literal segment that few of its node's
urls have becomes a wildcard, so a host has few templates however many paths. Branches
that differ in one literal segment are merged, but for those whose labelled share
differs significantly (Hoeffding's bound) from the others'. A template is rejected when the share of bad urls
among its labelled ones, smoothed by the shares of its branch, its host and all urls,
reaches a threshold. Labels are the rules' own verdicts, and a column of labels where there is one.

Urls are counted by host and typed path first, so a host with a third of all urls
is as many rows as it has different typed paths. Verdicts go back to the urls by a join on
those: the at most ``HOT`` keys with a thousandth of all urls each are broadcast, all others are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values of the contract: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A literal segment needs so many urls, and this share of its node's: a node has 1 / SHARE literal children at most.
LEAST, SHARE = 20, 0.01
#: Error of the test whether two branches differ; weight of the prior, in urls; least share of bad urls to reject.
ALPHA, PRIOR, PURITY = 0.05, 10.0, 0.7
#: Keys with a share of 1 / HOT of all urls; there are no more than HOT of them.
HOT = 1000
WILD = "{*}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Thresholds:
    least: int = LEAST
    share: float = SHARE
    alpha: float = ALPHA
    prior: float = PRIOR
    purity: float = PURITY


def host_of(url: Column) -> Column:
    """After the first :// up to the path, query, fragment or end; A to Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to the query, fragment or end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (its host and path, joined) and its verdict; null where none fits.

    A rule fits its host and all subdomains, and paths that start with its own.
    Of equally long rules the earlier one wins. The list is tried in order of length.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # what comes later stands outside and decides
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def typed(path: Column) -> Column:
    """The segments of a path after its first slash; digits and long hexadecimal runs typed, braces told apart from types."""
    own = F.replace(F.replace(path, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))
    own = F.regexp_replace(own, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F-]*[0-9])(?=[0-9a-fA-F-]*[a-fA-F])[0-9a-fA-F-]{16,}(?![0-9A-Za-z])", "{x}")
    own = F.regexp_replace(own, r"[0-9]+", "{n}")
    return F.split(F.regexp_replace(own, r"^/", ""), "/")


def _literal(segment: Column) -> Column:
    return ~F.contains(segment, F.lit("{")) & (segment != "")


def templates(shapes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """host, shape, template of every typed path: ``shapes`` has host, shape (its segments, joined) and n (its urls).

    Level by level from the root, one round for each level that a node with
    ``least`` urls still reaches; below smaller nodes every literal becomes a wildcard at once.
    """
    now = shapes.select("host", "shape", "n", F.lit("").alias("prefix"), F.split("shape", "/").alias("rest"))
    now = materialize(now, "url-level")
    done = []
    closed = lambda c: F.array_join(F.transform(c, lambda s: F.when(_literal(s), F.lit(WILD)).otherwise(s)), "/")
    while True:
        nodes = now.groupBy("host", "prefix").agg(F.sum("n").alias("total"), F.max(F.exists("rest", _literal)).alias("literal"))
        large = nodes.where((F.col("total") >= t.least) & F.col("literal")).select("host", "prefix", "total")
        met = now.join(large, ["host", "prefix"], "left")
        ended = met.where("total is null").select("host", "shape", F.concat("prefix", closed(F.col("rest"))).alias("template"))
        done.append(materialize(ended, "url-templates"))
        child = F.get("rest", F.lit(0))
        going = materialize(met.where("total is not null").withColumn("child", child), "url-going")
        if going.isEmpty():
            break
        kids = going.where(_literal(F.col("child"))).groupBy("host", "prefix", "child").agg(F.sum("n").alias("own"), F.first("total").alias("total"))
        kept = kids.where((F.col("own") >= t.least) & (F.col("own") >= t.share * F.col("total"))).select("host", "prefix", "child", F.lit(True).alias("kept"))
        named = going.join(kept, ["host", "prefix", "child"], "left")
        step = F.when(_literal(F.col("child")) & F.col("kept").isNull(), F.lit(WILD)).otherwise(F.col("child"))
        last = F.size("rest") == 1
        after = named.select("host", "shape", "n", F.concat("prefix", step, F.when(last, F.lit("")).otherwise(F.lit("/"))).alias("prefix"), F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"))
        now = materialize(after, "url-level")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judged(own: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """host, template, bad_share, rejected of every template: ``own`` has host, template and its labelled urls, bad and good.

    A branch is what lies below a literal segment with nothing but types and
    wildcards after it. A host's branches that differ in that segment only are merged,
    except those whose labelled share differs from that of all the others by more than
    Hoeffding's bound. A template's share is smoothed by its branch's, that one by its host's, that by all.
    """
    last = r"((?:^|/))([^/{]+)((?:/[^/]*\{[^/]*|/)*)$"
    place = lambda to: F.when(F.col("template").rlike(last), F.regexp_replace("template", last, to)).otherwise(F.lit(""))
    rows = own.select("host", "template", place("$1{*}").alias("stem"), place("$1$2").alias("branch"), "bad", (F.col("bad") + F.col("good")).alias("own"))
    sums = lambda df, keys, a: df.groupBy(*keys).agg(F.sum("bad").alias(f"bad_{a}"), F.sum("own").alias(f"n_{a}"))
    branches = rows.groupBy("host", "stem", "branch").agg(F.sum("bad").alias("bad"), F.sum("own").alias("own"))
    met = branches.join(sums(branches, ["host", "stem"], "s"), ["host", "stem"])
    rest = F.col("n_s") - F.col("own")
    gap = F.abs(F.col("bad") / F.nullif(F.col("own"), F.lit(0)) - (F.col("bad_s") - F.col("bad")) / F.nullif(rest, F.lit(0)))
    bound = F.sqrt(F.lit(0.5) * F.log(F.lit(2.0 / t.alpha))) * (1 / F.sqrt(F.nullif(F.col("own"), F.lit(0))) + 1 / F.sqrt(F.nullif(rest, F.lit(0))))
    merged = F.when(F.coalesce(gap >= bound, F.lit(False)), F.col("branch")).otherwise(F.lit(None).cast("string"))
    branches = materialize(met.select("host", "stem", "branch", merged.alias("merged"), "bad", "own"), "url-branches")
    groups = sums(branches.withColumn("group", F.coalesce("merged", F.lit(WILD))), ["host", "stem", "group"], "b")
    of = branches.select("host", "stem", "branch", F.coalesce("merged", F.lit(WILD)).alias("group"))
    out = rows.join(of, ["host", "stem", "branch"]).join(groups, ["host", "stem", "group"]).join(sums(branches, ["host"], "h"), "host")
    out = out.crossJoin(F.broadcast(sums(branches, [], "a")))  # one row
    share = (F.col("bad_a") + 1) / (F.col("n_a") + 2)
    for bad, n in (("bad_h", "n_h"), ("bad_b", "n_b"), ("bad", "own")):
        share = (F.col(bad) + F.lit(t.prior) * share) / (F.col(n) + F.lit(t.prior))
    return out.select("host", "template", share.alias("bad_share"), (share >= t.purity).alias("rejected"))


def share_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join with a table that has one row for each key and its number of rows on the left, ``n``.

    Keys with a thousandth of all rows are few, so they are broadcast; the rest is shuffled.
    """
    hot = F.col(n) * HOT >= total
    a = left.join(F.broadcast(right.where(hot).drop(n)), keys)
    cold = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return a.unionByName(cold.join(right.where(~hot).drop(n), keys))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, label: str | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share of every row of ``pages`` (page_id, url).

    ``label`` names a column with 1 for bad and 0 for good urls, null where unknown;
    it counts before the rules' verdicts as a label, not as a verdict. A null url and one
    without :// have an empty host and path, which no rule fits unless its path is empty too. Rows
    that repeat stay apart. Other columns play no part; an empty table gives an empty result.
    """
    known = F.col(f"`{label}`").cast("double") if label else F.lit(None).cast("double")
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), known.alias("known"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), "known", F.array_join(typed(F.col("path")), "/").alias("shape"))
    bad = F.coalesce(F.col("known") > 0, F.col("ruled") == "block")
    rows = materialize(rows.withColumn("bad", bad), "url-rows")
    shapes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    shapes = materialize(shapes, "url-shapes")
    found = materialize(shapes.join(templates(shapes, t), ["host", "shape"]), "url-found")
    own = materialize(judged(found.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), t), "url-judged")
    known_ = materialize(found.select("host", "shape", "template", "n").join(own, ["host", "template"]), "url-verdicts")
    out = share_join(rows, known_, ["host", "shape"], "n", rows.count())
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every page's url; the rules are the contract's, and their verdicts the labels."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
