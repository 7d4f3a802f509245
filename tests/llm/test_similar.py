"""op1, op3, op4: against brute force, with odd rows and hot groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lucidreq.llm import jaccard_join, line_dedup, meeting, shingles, suffix_dedup


def union_find(nodes, links):
    par = {x: x for x in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = text(70)
    rows, base = [], text(120)
    for i in range(60):  # a group of near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    for _ in range(60):  # a passage in changing surroundings, some of them short
        rows.append(" ".join(text(r.randint(0, 40)) + passage + text(r.randint(0, 40))))
    for _ in range(30):
        rows.append("\n".join(" ".join(text(r.randint(1, 12))) for _ in range(r.randint(1, 9))))
    rows += rows[:3] + ["Abc d E f g", "aBC D e F G", "one two", "one  two", None, "", " \n "] + [" ".join(text(4000))]
    r.shuffle(rows)
    return list(enumerate(rows))


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingles_are_sets_of_words():
    texts = [t for _, t in corpus()]
    for t, s in zip(texts, shingles.shingle_sets(texts)):
        assert len(s) == len(shingle_set(t))
    a, b, c = shingles.shingle_sets(["A b c d e f", "a  b\tc d\ne f", "a b c d e g"])
    assert (a == b).all() and len(np.intersect1d(a, c)) == 1


@pytest.mark.parametrize("hot", [64, 5])
def test_jaccard_components(docs_of, hot):
    rows = corpus()
    sets = {d: shingle_set(t) for d, t in rows}
    ids = [d for d, s in sets.items() if s]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 200
    want = union_find(list(sets), links)
    got = jaccard_join.jaccard_components(docs_of(rows), hot).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in sets}


def test_jaccard_odd_rows(docs_of):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (4, "other words here"), (4, "quite different text"), (5, None), (5, None), (None, "alone")]
    got = jaccard_join.jaccard_components(docs_of(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(
        {(3, 3, 3): 2, (None, 3, 3): 1, (4, 1, 4): 2, (5, 0, 5): 2, (None, 1, None): 1}
    )
    kept = jaccard_join.deduplicate(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(3, "a b c d e f g"): 1, (4, "other words here"): 1, (4, "quite different text"): 1, (5, None): 1, (None, "alone"): 1})
    assert jaccard_join.jaccard_components(docs_of(rows).where("false")).count() == 0


def brute_spans(rows, size, keep):
    count, first = Counter(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            count[b[i : i + size]] += 1
            first.setdefault(b[i : i + size], (d, i))
    out = {}
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1 and (keep == "none" or first[b[i : i + size]] != (d, i)):
                gone.update(range(i, i + size))
        out[d] = (len(b), len(gone), bytes(x for i, x in enumerate(b) if i not in gone))
    return out


@pytest.mark.parametrize("keep, hot", [("none", 2000), ("first", 2000), ("none", 1), ("first", 1)])
def test_suffix_dedup(docs_of, keep, hot):
    rows = corpus(2)
    got = suffix_dedup.remove_repeats(docs_of(rows), keep, min_bytes=100, gram=24, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in got} == brute_spans(rows, 100, keep)
    for r in got:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed


def test_suffix_dedup_long_text_in_pieces(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    rows = corpus(3)[:40]
    found = suffix_dedup.remove_repeats(docs_of(rows), "none", min_bytes=100, gram=24)
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in found.collect()} == brute_spans(rows, 100, "none")
    odd = [(1, "é" * 300), (1, "é" * 300), (None, "é" * 299), (2, None), (2, "")]
    out = suffix_dedup.remove_repeats(docs_of(odd), "none").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in out) == Counter({(1, 600, 600): 2, (None, 598, 598): 1, (2, 0, 0): 2})
    assert suffix_dedup.remove_repeats(docs_of(odd).where("false")).count() == 0


def test_common_prefix():
    r = random.Random(2)
    for _ in range(300):
        a, b = (bytes(r.choices([0, 1, 255], k=9)) for _ in range(2))
        assert suffix_dedup.common_prefix(a, b) == next((i for i in range(9) if a[i] != b[i]), 9)


def test_longest_previous_factor():
    text = b"abracadabraabra"
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), len(text))
    lcp = [0] + [common(a, b) for a, b in zip(sa, sa[1:])]
    got = dict(zip(sa, suffix_dedup.longest_previous(sa, lcp)))
    assert got == {i: max([common(i, j) for j in range(i)], default=0) for i in range(len(text))}


def edit(a, b):
    """Edit distance, a column of the table at a time in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    at, full = defaultdict(int), (1 << len(a)) - 1
    for i, x in enumerate(a):
        at[x] |= 1 << i
    up, down, score, last = full, 0, len(a), 1 << (len(a) - 1)
    for x in b:
        eq = at[x] | down
        zero = ((((at[x] & up) + up) ^ up) | at[x] | down) & full
        right_up, right_down = (down | ~(zero | up)) & full, up & zero
        score += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = (right_down | ~(zero | right_up)) & full, right_up & zero
    return score


def near(a, b):
    most = int(max(len(a), len(b)) * 0.2 + 1e-9)
    return abs(len(a) - len(b)) <= most and edit(a, b) <= most


def test_edit():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        assert edit(a, b) == p[-1]


def test_similar_is_edit_similarity():
    r = random.Random(4)
    for _ in range(1500):
        a = ["".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(r.randint(1, 14))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 2)] = ["".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(r.randint(0, 2))]
            b = b or ["x"]
        if r.random() < 0.2:
            r.shuffle(b)
        x, y = " ".join(a), " ".join(b)
        assert line_dedup.edit_distance(x, y) == edit(x, y)
        assert line_dedup.similar(x, y) == near(x, y), (x, y)


def brute_lines(rows):
    """(n_lines, n_removed, kept_text) of each document, by comparing all lines."""
    occ = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normalise(x):
                occ[n].append((d, i))
    lines = sorted(occ)
    links = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if near(a, b)]
    groups = defaultdict(list)
    for n, root in union_find(lines, links).items():
        groups[root] += occ[n]
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [y for i, y in enumerate(own) if (d, i) not in gone]
        out[d] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("split, places", [(1 << 18, 500_000), (2, 0)])
def test_line_dedup(docs_of, monkeypatch, split, places):
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", places)
    r = random.Random(5)
    line = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(i, "\n".join(r.sample([line, line.upper() + "!", line.replace("fox", "cat"), line + " 12", f"own line {i} of text {i * 7}", "", "short", "Short.", "shart", "1999", "2004", "a 1", "a 2"], 8))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "--\n\n.."), (93, "Ünï\xa0cödé\u2003x\n\nünï cödé x"), (94, "\n")]
    got = line_dedup.dedup_lines(docs_of(rows), split).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed, x.kept_text) for x in got} == brute_lines(rows)
    assert len(got) == len(rows) and line_dedup.dedup_lines(docs_of(rows).where("false")).count() == 0
    twice = line_dedup.dedup_lines(docs_of([(1, "same line here"), (1, "same line here"), (None, "same line here")])).collect()
    assert sorted((str(x.doc_id), x.n_removed) for x in twice) == [("1", 0), ("1", 0), ("None", 1)]


def test_line_candidates_against_all_pairs():
    """Of lines changed in up to a tenth of their words, at least 0.95 share a key; of those changed in up to a fifth, 0.8."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    for share, least in ((0.1, 0.95), (0.2, 0.8)):
        found = total = 0
        for _ in range(2000):
            a = [word() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 16, 20, 28, 40, 60]))]
            b = list(a)
            for _ in range(r.randint(1, max(1, int(len(a) * share)))):
                kind, k = r.random(), r.randrange(len(b))
                if kind < 0.7:
                    b[k] = word() if r.random() < 0.6 else b[k][:1] + "z" + b[k][2:]
                elif kind < 0.85:
                    b.insert(k, word())
                elif len(b) > 1:
                    del b[k]
            if not near(" ".join(a), " ".join(b)) or a == b:
                continue
            line, key = line_dedup.Lines(" ".join(a).encode() + b"\n" + " ".join(b).encode()).keys(np.arange(2))
            total += 1
            found += len(np.intersect1d(key[line == 0], key[line == 1])) > 0
        assert total > 500 and found >= least * total, (share, found, total)


def test_long_lines_go_in_pieces(docs_of, monkeypatch):
    r = random.Random(3)
    text = "\n".join(" ".join(r.choices(["a", "bb", "ccc", "x" * 300], k=r.randint(0, 30))) for _ in range(60))
    want = [(x.pos, x.line, x.n) for x in line_dedup.line_rows(docs_of([(1, text)])).orderBy("pos").collect()]
    assert [n for _, _, n in want] == [len(line_dedup.normalise(x)) for x in text.split("\n") if x.strip()]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 200)
    monkeypatch.setattr(line_dedup, "CHUNK_BYTES", 200)
    found = line_dedup.Lines(line_dedup._bytes(text))
    assert [(int(p), int(x), int(n)) for p, x, n in zip(found.place, found.name.view(np.int64), found.size)] == want


def test_sketch_counts_all_documents(docs_of):
    rows = [(i, "a b c d e f g") for i in range(30)] + [(100, "p q r s t u"), (101, None)]
    counts = jaccard_join.document_counts(docs_of(rows))
    want = Counter(int(t) >> (64 - meeting.SLOT_BITS) for _, x in rows for t in next(shingles.shingle_sets([x])))
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == want
    order = jaccard_join.Order(counts, 10)
    both = next(shingles.shingle_sets(["a b c d e f g p q r s t u"]))
    assert sorted(order.count(both))[: len(order.prefix(both))] == order.count(order.prefix(both)).tolist()


@pytest.mark.parametrize("split, ids", [(2, 0), (1 << 18, 0)])
def test_jaccard_components_by_other_plans(docs_of, monkeypatch, split, ids):
    """Shingles split over many salts, leaders' members in portions of three, and texts joined by a shuffle."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jaccard_join, "PORTION", 3)
    monkeypatch.setattr(meeting, "SLICE", 5)
    test_jaccard_components(docs_of, split)


def test_shingles_of_long_texts(monkeypatch):
    r = random.Random(9)
    texts = [" ".join("".join(r.choices("abC", k=r.choice([1, 3, 40, 900]))) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["x" * 5000, " " + "y" * 4000 + "\tz", ""]
    want = [x.tolist() for t in texts for x in shingles.shingle_sets([t])]
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 100)
    assert [x.tolist() for x in shingles.shingle_sets(texts)] == want


def test_jaccard_members_link_without_their_leader(docs_of):
    """Isolated triples: B and C link, A doesn't; in some A leads a group of all three, so B and C meet in it alone."""
    rows, alone = [], 0
    for k in range(200):
        base = [f"w{k}x{i}" for i in range(24)]
        texts = [" ".join(base[: 24 - d] + [f"{c}{k}x{i}" for i in range(d)]) for c, d in (("a", 3), ("b", 0), ("c", 1))]
        rows += [(3 * k + i, t) for i, t in enumerate(texts)]
        sets = list(shingles.shingle_sets(texts))
        same_group = len({bytes(np.sort(s)[: jaccard_join.prefix_size(len(s))]) for s in sets}) == 1
        alone += same_group and min(sets, key=shingles.set_hash) is sets[0]
    assert alone >= 3
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == {d: d - (d % 3 == 2) for d, _ in rows}
