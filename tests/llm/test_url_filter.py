"""op11: hosts, paths, rules and the template tree against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lucidreq.llm import url_filter as U

from ..conftest import DATA

RULES = U.RULES


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    return host, re.split(r"[?#]", rest[at:], maxsplit=1)[0]


def ruled(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def kind(path):
    path = path.replace("{", "%7B").replace("}", "%7D")
    out = []
    for seg in re.split("/", path[1:] if path.startswith("/") else path):
        tokens = re.split(r"(?<![0-9A-Za-z])([0-9a-fA-F-]{16,})(?![0-9A-Za-z])", seg)
        tokens = ["{x}" if k % 2 and re.search("[0-9]", x) and re.search("[a-fA-F]", x) else re.sub("[0-9]+", "{n}", x) for k, x in enumerate(tokens)]
        out.append("".join(tokens))
    return out


def literal(s):
    return s != "" and "{" not in s


def plain(urls, labels, rules, t):
    """verdict and share of each url, with a recursive tree for each host."""
    rows = [(*parsed(u), label) for u, label in zip(urls, labels, strict=True)]
    rows = [(h, p, *ruled(h, p, rules), kind(p), label) for h, p, label in rows]
    template = {}

    def grow(members, depth, prefix):
        """members: (row, segments) that share the generalised prefix."""
        rest = [(i, s[depth:]) for i, s in members]
        if len(rest) < t.least or not any(literal(x) for _, r in rest for x in r):
            for i, r in rest:
                template[i] = "/".join([*prefix, *["{*}" if literal(x) else x for x in r]]) if r else "/".join(prefix)
            return
        n = Counter(r[0] for _, r in rest if r)
        groups, over = defaultdict(list), []
        for (i, s), (_, r) in zip(members, rest, strict=True):
            if not r:
                over.append(i)
                continue
            c = r[0]
            keep = not literal(c) or (n[c] >= t.least and n[c] >= t.share * len(rest))
            groups[c if keep else "{*}", len(r) > 1].append((i, s))
        for i in over:
            template[i] = "/".join(prefix)
        for (c, more), own in groups.items():
            if more:
                grow(own, depth + 1, [*prefix, c])
            else:
                for i, _ in own:
                    template[i] = "/".join([*prefix, c])

    hosts = defaultdict(list)
    for i, r in enumerate(rows):
        hosts[r[0]].append((i, r[4]))
    for own in hosts.values():
        grow(own, 0, [])
    bad_of = lambda r: r[5] > 0 if r[5] is not None else None if r[3] is None else r[3] == "block"
    count = defaultdict(lambda: [0, 0])
    for i, r in enumerate(rows):
        b = bad_of(r)
        count[r[0], template[i]]
        if b is not None:
            count[r[0], template[i]][0] += b
            count[r[0], template[i]][1] += 1

    def branch(name):
        """The branch and what it has in common with its siblings."""
        parts = name.split("/")
        at = max((k for k, x in enumerate(parts) if literal(x)), default=None)
        return ("", "") if at is None else ("/".join(parts[: at + 1]), "/".join([*parts[:at], "{*}"]))

    def total(pick):
        own = [v for k, v in count.items() if pick(k)]
        return sum(v[0] for v in own), sum(v[1] for v in own)

    group = {}
    for h, name in count:
        b, stem = branch(name)
        x, n = total(lambda k: k[0] == h and branch(k[1]) == (b, stem))
        y, m = total(lambda k: k[0] == h and branch(k[1])[1] == stem and branch(k[1])[0] != b)
        apart = n and m and abs(x / n - y / m) >= math.sqrt(0.5 * math.log(2 / t.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        group[h, name] = (h, stem, b if apart else "{*}")
    sums = {g: total(lambda k: group[k] == g) for g in set(group.values())}
    hosts_ = {h: total(lambda k: k[0] == h) for h, _ in count}
    share = {}
    for h, name in count:
        b, n = total(lambda k: True)
        p = (b + 1) / (n + 2)
        for b, n in (hosts_[h], sums[group[h, name]], count[h, name]):
            p = (b + t.prior * p) / (n + t.prior)
        share[h, name] = p
    return [(h, p, rule, v or ("block" if share[h, template[i]] >= t.purity else "allow"), template[i], round(share[h, template[i]], 9)) for i, (h, p, rule, v, _, _) in enumerate(rows)]


def got(df):
    return [(r.host, r.path, r.rule, r.verdict, r.template, round(r.bad_share, 9)) for r in sorted(df.collect(), key=lambda r: r.page_id)]


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").select("page_id", "url").orderBy("page_id").collect()
    want = plain([r.url for r in pages], [None] * len(pages), RULES, U.Thresholds())
    assert [r.page_id for r in pages] == list(range(len(pages)))
    assert got(U.query(spark, f"{DATA}/sf0.1")) == want
    assert {w[3] for w in want} == {"allow", "block"}


@pytest.mark.parametrize("seed", range(2))
def test_generated_urls(spark, seed):
    """Typed, rare and frequent segments, deep paths, labels that depend on a branch, hot and single hosts, odd urls."""
    r = random.Random(seed)
    odd = [None, "", "x", "://", "http://", "http://H.Org", "http://a.b?x/y", "http://a.b#/de/", "http://ORG/es/1", "http://Example.ORG/es/", "http://xexample.org/es/", "http://u@com:80/de/", "http://com/de/x://y", "a\nb://É.com/de/\nz", "http://com//de/", "http://com/{n}/x", "http://com/de/" + "a/" * 30 + "9"]
    urls = list(odd)
    for _ in range(2500):
        host = r.choice(["Hot.example.net"] * 6 + ["b.example.com", "c.example.org", f"h{r.randrange(400)}.net", "d.com"])
        a = r.choice(["news", "shop", "spam", "junk", "tag", f"u{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}x", "de", "fr", "es", str(r.randrange(99)), "0a1b2c3d-4e5f-6789-abcd"])
        b = r.choice([str(r.randrange(10**6)), f"item-{r.randrange(99)}.html", "", "list", "x" * r.randrange(1, 9)])
        urls.append(f"http://{host}/{a}/{b}" + r.choice(["", "/", "?q=/de/", "#z", "/more/deep/7"]))
    labels = [(1 if r.random() < (0.95 if "/spam/" in u or "/junk/" in u else 0.1) else 0) if u and r.random() < 0.5 else None for u in urls]
    df = spark.createDataFrame([(k, u, label, "x", 1) for k, (u, label) in enumerate(zip(urls, labels, strict=True))], "page_id long, url string, seen int, host string, n int")
    t = U.Thresholds(least=10, share=0.02)
    want = plain(urls, labels, RULES, t)
    assert got(U.judge(df.repartition(5), RULES, "seen", t)) == want
    ours = [w for w in want if w[0] == "hot.example.net" and w[4] == "spam/{n}"]
    assert ours and all(w[3] == "block" for w in ours)
    assert all(w[3] == "allow" for w in want if w[0] == "hot.example.net" and w[4].startswith("news/"))


def test_rules_and_nothing(spark):
    rules = [("a", "/", "allow"), ("a", "/", "block"), ("b.a", "/x", "block"), ("", "", "block")]
    df = spark.createDataFrame([(1, "http://b.a/xy"), (2, "http://b.a/y"), (None, None), (1, "http://b.a/xy")], "page_id long, url string")
    rows = sorted((str(r.page_id), r.rule, r.verdict) for r in U.judge(df, rules).collect())
    assert rows == [("1", "b.a/x", "block")] * 2 + [("2", "a/", "allow"), ("None", "", "block")]
    assert U.judge(df.where("false")).count() == 0
