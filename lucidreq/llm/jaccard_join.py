"""N-gram Jaccard join by grouped prefix filtering.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of at least 0.8. Exact copies of a set collapse into one node. Shingles are put
in one global order, those whose slot of a frequency sketch counts few first; two
sets that link share a shingle in their prefixes of that order. Nodes with the
same prefix and size collapse into one group; group pairs are found through
shared prefix shingles and filtered by size, position and overlap; the pairs that
are left are expanded to their members and verified on the whole texts.

What is asked for is connectivity, so no group emits all its pairs. First every
group is verified against one leader, the group with which it shares the most
prefix shingles. Then all pairs that share a prefix shingle *and lie in different
components so far* are filtered and verified, so no link between components is
lost, and pairs inside a component, of which a group of near copies has a number
that grows with its square, are never made.

Sizes: the sketch, of a fixed size, is all that goes to every worker. Rows of one
shingle are met in sorted order, one held at a time, and a shingle that the sketch
finds in very many documents is split by a salt; a leader's members are verified
one after the other against its set, in portions. Shingles are 64-bit hashes and
sets are compared by them: two different shingles of a corpus of n have a chance
of about n * n / 2**65 to be taken for one another, which only moves one count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, merged_components
from .common import discard, drop_worker_cache, materialize, number_batches, release, same, table, text_batches, text_or_empty
from .meeting import SPLIT, Slots, met, postings, sketch, votes
from .shingles import set_hash, shingle_sets

#: Link when THRESHOLD[1] * intersection >= THRESHOLD[0] * union.
THRESHOLD = (80, 100)
#: Members that are verified against one copy of their leader's text, about.
PORTION = 256
#: Wanted documents are broadcast by id up to so many; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def prefix_size(n, num: int = THRESHOLD[0], den: int = THRESHOLD[1]):
    """Shingles of the prefix of a set of n: n - ceil(num n / den) + 1."""
    return n - (num * n + den - 1) // den + 1


# ---------------------------------------------------------------- global order


class Order(Slots):
    """Puts a set's shingles in the global order: rare slots first, then by hash."""

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        return tokens[np.argsort(self.count(tokens), kind="stable")[: prefix_size(len(tokens))]]


def document_counts(docs: DataFrame) -> np.ndarray:
    """How many documents have a shingle of each slot, over all documents."""
    return sketch(docs.select(text_or_empty().alias("text")), lambda batch: shingle_sets(batch.column(0).to_pylist()))


def prefixes(docs: DataFrame, order: Order) -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the set), n, group (hash of prefix and n), prefix; node 0 is the empty set."""
    shared = order.shared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        order = shared.value
        for batch in batches:
            nodes, ns, groups, parts = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                p = order.prefix(s) if len(s) else s
                nodes.append(set_hash(s))
                ns.append(len(s))
                groups.append(set_hash(np.sort(p)) ^ len(s) * 0x9E3779B9)
                parts.append(p)
            flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(ns, pa.int64()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "th", "node", "n", "group", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, node long, n long, group long, prefix array<long>")


# ---------------------------------------------------------------- candidates


def size_ok(a: str, b: str) -> str:
    return f"{THRESHOLD[1]} * least({a}, {b}) >= {THRESHOLD[0]} * greatest({a}, {b})"


def _overlap_sql(a: str, b: str) -> str:
    """The smallest intersection with which sets of a and b link."""
    num, den = THRESHOLD
    return f"cast(ceil({num} * ({a} + {b}) / {num + den}D - 1e-9) as int)"


def _prefix_sql(n: str) -> str:
    num, den = THRESHOLD
    return f"({n} - cast(ceil({num} * {n} / {den}D - 1e-9) as int) + 1)"


def leader_pairs(met: DataFrame) -> DataFrame:
    """For each group another one, that leads most of the prefix shingles they share: a, b.

    A shingle's leader is the group in whose prefix it comes first: fewer rare
    shingles precede it, so of near copies it is the one with the fewest changes.
    """
    pairs = votes(met).where(size_ok("n", "an")).groupBy("a", "node").agg(F.count(F.lit(1)).alias("both"), F.max("n").alias("n"), F.min("ap").alias("ap"))
    best = pairs.groupBy("node").agg(F.max(F.struct("both", (-F.col("ap")).alias("early"), "a")).alias("m"), F.max("n").alias("n"))
    return best.where(f"4 * m.both >= {_prefix_sql('n')}").select(F.col("m.a").alias("a"), F.col("node").alias("b"))


def cross_pairs(shared: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that may link: a, b.

    Keys that are in one component alone drop out first, so a group of near
    copies that is linked already makes no pairs. A pair meets at a shingle that
    is in the shorter set's indexing prefix and from which on both sets can still
    reach the overlap they need; a pair that links has such a shingle, the first
    that they share. Then all their common prefix shingles are counted: with
    everything that could follow them, they must reach that overlap too. ``weight``
    is the number of prefix shingles a row stands for: 1, or the whole prefix for
    a group's own key, as its members share all of it, postings or not.
    """
    own = shared.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    own = materialize(own.join(mixed, "key", "left_semi"), "cross-postings")
    a = own.where(f"pos <= n - {_overlap_sql('n', 'n')}").select("key", F.col("c").alias("ca"), F.col("node").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    b = own.select("key", F.col("c").alias("cb"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"))
    fits = F.expr(f"ca <> cb and an <= bn and {size_ok('an', 'bn')} and least(an - ap, bn - bp) >= {_overlap_sql('an', 'bn')}")
    met = a.join(b, (a["key"] == b["key"]) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = materialize(met, "met")
    post = own.select("key", "node", "n", "pos", "weight")
    rows = met.join(post.select(F.col("node").alias("a"), "key", F.col("n").alias("an"), F.col("pos").alias("ap"), "weight"), "a")
    rows = rows.join(post.select(F.col("node").alias("b"), "key", F.col("n").alias("bn"), F.col("pos").alias("bp")), ["b", "key"])
    pairs = rows.groupBy("a", "b").agg(F.sum("weight").alias("both"), F.max("an").alias("an"), F.max("bn").alias("bn"), F.max("ap").alias("ap"), F.max("bp").alias("bp"))
    after = f"least(least(an - 1 - ap, bn - 1 - bp), greatest(an - {_prefix_sql('an')}, bn - {_prefix_sql('bn')}))"
    return pairs.where(f"both + {after} >= {_overlap_sql('an', 'bn')}").select("a", "b")


# ---------------------------------------------------------------- verification


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b of nodes) whose whole texts' sets link.

    Each b comes with its text after its a, whose set alone is held: an a with many
    partners is copied for every ``PORTION`` of them, so no key is large.
    """
    pairs = materialize(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    firsts = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    roles = firsts.unionByName(pairs.join(many, "a").select("a", salt.alias("salt"), "b", F.col("b").alias("node")))
    roles = materialize(roles.join(nodes.select("node", "doc_id", "th"), "node").select("a", "salt", "b", F.col("doc_id").alias("d"), F.col("th").alias("t")), "roles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("th"))
    side = F.broadcast(roles) if roles.count() <= BROADCAST_IDS else roles
    rows = rows.join(side, same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t"))).select("a", "salt", "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = THRESHOLD
        own, held = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for (a, salt, b), s in zip(keys, shingle_sets(batch.column(3).to_pylist())):
                if b is None:
                    own, held = (a, salt), s
                elif own == (a, salt):
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if den * both >= num * (len(held) + len(s) - both):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return materialize(dealt.mapInArrow(check, "a long, b long"), "links")


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per input row: doc_id, th, n_shingles, component_id, component.

    component_id is the smallest doc_id reachable by links, the own one included.
    Null, empty and blank texts have no shingles and link with nothing; texts of
    one to four words have one shingle. Rows that repeat a text are in one
    component. A null doc_id is never the smallest unless a component has no
    other. Rows of one doc_id with different texts are judged apart; th is the
    text's hash and component tells components apart even so (null without
    shingles). Other columns of ``docs`` play no part; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    order = Order(document_counts(docs), split)
    sets = materialize(prefixes(docs, order), "prefixes")
    first = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th")
    nodes = sets.where("n > 0").groupBy("node").agg(F.min(first).alias("f"), F.max("n").alias("n"), F.max("group").alias("group"))
    nodes = materialize(nodes.select("node", "f.doc_id", "f.th", "n", "group"), "nodes")
    lead = nodes.groupBy("group", "n").agg(F.min("node").alias("lead"))
    members = materialize(nodes.join(lead, ["group", "n"]).select("node", "lead", "n"), "members")
    leaders = nodes.join(members.where("node = lead").select("node"), "node", "left_semi").select(F.col("node").alias("l"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    of_leader = sets.join(leaders, (F.col("node") == F.col("l")) & same(F.col("doc_id"), F.col("d")) & (F.col("th") == F.col("t"))).select("node", "n", "prefix")
    # A row of documents that repeats would meet itself; the first of a key passes over equal nodes.
    with number_batches(spark):
        shared = materialize(met(postings(of_leader.select("node", F.col("n").cast("int").alias("n"), "prefix"), order), order), "postings")
    order.discard()
    release(spark)
    # One leader for each group, and the group's own for each member.
    inside = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = verified(leader_pairs(shared).unionByName(inside), docs, nodes)
    so_far = materialize(connected_components(links), "components")
    # All that may still link components: shared shingles of groups, expanded to members, and groups' own members.
    several = members.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("lead")
    expanded = shared.select("key", F.col("node").alias("lead"), "n", "pos").join(members.select("node", "lead"), "lead").select("key", "node", "n", "pos", F.lit(1).alias("weight"))
    # Members are different sets of one size, so they can link only where one may lack a shingle of the other.
    own = members.join(several, "lead", "left_semi").where(f"n > {_overlap_sql('n', 'n')}")
    own = own.select((-F.abs(F.col("lead")) - 1).alias("key"), "node", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos"), F.expr(f"cast({_prefix_sql('n')} as int)").alias("weight"))
    more = verified(cross_pairs(expanded.unionByName(own), so_far), docs, nodes)
    release(spark)
    component = merged_components(so_far, more)
    label = nodes.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = materialize(label.join(least, "component").select(F.col("node").alias("k"), "component", "component_id"), "labels")
    discard(shared)
    out = sets.select("doc_id", "th", "node", "n").join(label, F.col("node") == F.col("k"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component (smallest doc_id, then text hash), with their own columns.

    Rows without shingles all stay; of rows that repeat doc_id and text one stays.
    """
    rows = jaccard_components(docs)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "th")).alias("k"))
    keep = first.select("k.doc_id", "k.th").unionAll(rows.where("component is null").select("doc_id", "th").distinct())
    # The input's columns travel in one struct, so no name of theirs can clash.
    keep = keep.select(F.col("doc_id").alias("k"), F.col("th").alias("t"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_or_empty()).alias("h"))
    out = own.join(keep, same(F.col("d"), F.col("k")) & (F.col("h") == F.col("t")))
    return out.dropDuplicates(["d", "h"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, n_shingles, component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
