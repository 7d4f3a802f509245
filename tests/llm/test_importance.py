"""op12: hashed n-gram gains and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lucidreq.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, orders):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, orders + 1) for k in range(len(w) - n + 1)]


def plain(docs, target, percent, least, orders, buckets):
    of = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(t, orders)]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, x in docs:
        own = of(x)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = may[: percent * len(may) // 100]
    out = [(*r[:4], None) for r in rows]
    for k, r in enumerate(drawn):
        out.remove((*r[:4], None))
        out.append((*r[:4], k + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("orders, buckets", [(1, 10_000), (1, 7), (3, 500), (2, 13)])
def test_resample(docs_of, spark, orders, buckets):
    r = random.Random(orders)
    make = lambda n: " ".join(r.choice(["a", "B", "é", "x9", "Ünder_score", "don't", "ДА", "w%d" % r.randrange(40)]) for _ in range(n))
    docs = [(k, make(r.choice([0, 1, 2, 3, 5, 19, 20, 21, 60]))) for k in range(120)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (8, "other " * 30), (None, "a b"), (None, "q " * 25), (500, None), (501, ""), (502, " \n.,"), (503, "long " * 40_000), (504, "\U0001f600 \U0001f600x")]
    target = [make(30), None, "", "A a é"]
    aim = spark.createDataFrame([(k, x, 1) for k, x in enumerate(target)], "item_id long, text string, row long")
    got = I.resample(docs_of(docs).repartition(3), aim, 25, 20, orders, buckets).collect()
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in got), key=repr) == plain(docs, target, 25, 20, orders, buckets)


def test_empty_tables(docs_of, spark):
    aim = spark.createDataFrame([], "item_id long, text string")
    got = I.resample(docs_of([(1, "a " * 30), (2, None)]), aim, 100).collect()
    want = plain([(1, "a " * 30), (2, None)], [], 100, 20, 1, 10_000)
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in got), key=repr) == want
    assert I.resample(docs_of([(1, "a")]).where("false"), aim).count() == 0


def test_only_bounded_tables_are_broadcast(docs_of, spark):
    aim = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = I.weighed(docs_of([(1, "a b c")]), aim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Python" not in plan
