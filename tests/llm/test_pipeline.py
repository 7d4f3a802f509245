"""The pipeline's rows against the same five stages in plain Python."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from lucidreq.llm import decontaminate, mixing, toxicity, word_tokenizer

from .test_similar import shingle_set, union_find


def fixture(seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghilmnoprst", k=r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(20)) for i in range(4)] + [(4, None), (5, "")]
    rows, labels = [], []
    for i in range(260):
        body = text(r.randint(5, 60))
        kind = i % 20
        if kind == 3:
            body += f" {items[i % 4][1]} " + text(4)
        toxic = kind in (5, 6)
        if toxic:
            body += ". You utter gromblewit, go away"
        rows.append((i, body, "en", r.choice(["big"] * 5 + ["mid"] * 2 + ["small"]), len(body)))
        if i < 220:
            labels.append((i, 1, int(toxic)))
    for i in range(260, 300):  # exact and near copies
        words = rows[r.randrange(200)][1].split()
        if i % 2 and len(words) > 45:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "mid", 0))
    rows += [(300, None, "en", "small", 0), (301, "", None, None, None), (302, " \n", "en", "big", 3)]
    return rows, labels, items


def sentence_scores(text, model):
    """Scores of the sentences by a plain search for each of the model's fragments."""
    out = []
    for m in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
        if not m.group().strip():
            continue
        hits = set()
        for w in m.group().lower().split():
            w = re.sub(r"^[\W_]+|[\W_]+$", "", w)
            hits |= {f for f in model.weights if (f == f"={w}" if f.startswith("=") else len(f) <= len(w) and f in w)}
        out.append(1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in hits)))) if hits else toxicity.QUIET)
    return out


def spark_hash(*values):
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, I32) else "<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


class I32(int):
    pass


def plain_mixed(rows, seed=mixing.SEED):
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for row in rows:
        totals[row[3]] += tokens(row[1])
    live = {s: n for s, n in totals.items() if n}
    top, least = max(live.values()), min(live.values())
    exponent = max(0.0, 1 - math.log(mixing.MAX_REPETITION) / math.log(top / least)) if top > least else 1.0
    out = []
    for source, total in totals.items():
        repetition = (top / total) ** (1 - exponent) if total else 1.0
        if abs(repetition - round(repetition)) < 1e-9:
            repetition = float(round(repetition))
        whole, blocks = int(repetition + 1e-9), max(1, math.ceil(total / mixing.BLOCK_TOKENS))
        rest = (repetition - whole) * total
        own = [r for r in rows if r[3] == source]

        def place(row):
            key = spark_hash(I32(seed), row[0], row[1] or "")
            block = spark_hash(I32(seed + 1), key) % blocks
            upper = spark_hash(I32(seed + 2), source, block, I32(whole)) & ~0xFFFFFFFF
            return upper | spark_hash(I32(seed + 3), key, I32(whole)) & 0xFFFFFFFF

        done, cut = 0, None
        for row in sorted(own, key=place):
            done += tokens(row[1])
            if rest > 1e-6 and done >= rest - 1e-6 * total:
                cut = place(row)
                break
        for row in own:
            out += [row] * (whole + (rest > 1e-6 and (cut is None or place(row) <= cut)))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as c

    rows, labels, items = fixture()
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    label_rows.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    # 1. Documents that the model rejects go; the model is fitted on the same labels.
    model = toxicity.fit(docs, label_rows)
    kept = [r for r in rows if 1 - math.prod(1 - s for s in sentence_scores(r[1], model)) < toxicity.THRESHOLD]
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert gone and all(i >= 260 or i % 20 in (5, 6) for i in gone) and {i for i in range(260) if i % 20 in (5, 6)} <= gone
    # 2. One document of each group stays.
    sets = {r[0]: shingle_set(r[1]) for r in kept}
    ids = sorted(d for d, s in sets.items() if s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(list(sets), links)
    assert len(links) > 20
    kept = [r for r in kept if root[r[0]] == r[0]]
    # 3. Documents with an item of the benchmark go.
    words = lambda t: " ".join(w.lower() for w in (t or "").split())
    leaks = {r[0] for r in kept if any(i and words(i) in words(r[1]) for _, i in items)}
    assert leaks
    kept = [r for r in kept if r[0] not in leaks]
    # 4. Small sources repeat. 5. Token files in the order of doc_id.
    mixed = plain_mixed(kept)
    assert len(mixed) > len(kept)
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path()).tk
    want, at = [], 0
    for row in sorted(mixed, key=lambda r: r[0]):
        ids = [*tk.encode(row[1] or "", add_special_tokens=False).ids, 1]
        want.append((row[0], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = sorted(tuple(x) for x in c.run(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)


def test_stages_keep_columns_of_any_name(spark, docs_of):
    """Columns that operators use for their own results go through the stages as they are."""
    names = ["hits", "toxicity", "predicted", "n_sentences", "offending", "node", "th", "__copies", "__key"]
    base = spark.createDataFrame([(1, "clean words of one document", "s"), (2, "quite another text here", "s"), (3, None, None)], "doc_id long, text string, source string")
    docs = base.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    from lucidreq.llm import jaccard_join

    for out in (toxicity.clean_documents(docs, labels), jaccard_join.deduplicate(docs), decontaminate.decontaminate(docs, bench), mixing.mixed(docs)):
        assert out.columns == docs.columns
        got = defaultdict(set)
        for x in out.collect():
            got[x.doc_id] |= {x[n] == f"{n}-{x.doc_id}" for n in names}
        assert dict(got) == {1: {True}, 2: {True}, 3: {True}}


def test_very_long_texts(spark, docs_of):
    """Texts of a few megabytes, several in a batch, in one line or many, with and without white space."""
    from lucidreq.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup, token_output

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000)]
    long = [r.choice(words) for _ in range(300_000)]
    near = [w if i % 997 else "changed" for i, w in enumerate(long)]
    lines = "\n".join(" ".join(long[i : i + 40]) for i in range(0, 200_000, 40))
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, lines), (4, "x" * 1_500_000), (5, "short"), (6, "x" * 1_500_000), (7, None)]
    docs = docs_of(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs).collect()}
    assert got == {d: (len(shingle_set(t)), {2: 1, 6: 4}.get(d, d)) for d, t in rows}
    assert {x.doc_id: x.kept for x in exact_dedup.exact_dedup(docs).collect()} == {d: d != 6 for d, _ in rows}
    n_lines = {x.doc_id: (x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(docs).collect()}
    assert n_lines[2] == (1, 1) and n_lines[6] == (1, 1) and n_lines[1] == (1, 0) and n_lines[3][0] == 5000
    kept = {x.doc_id: (x.n_bytes, x.n_removed) for x in suffix_dedup.remove_repeats(docs, "none").collect()}
    assert kept[4] == kept[6] == (1_500_000, 1_500_000) and kept[5] == (5, 0) and kept[1][1] > 1_000_000
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path()).tk
    tokens = {x.doc_id: x.n_tokens for x in token_output.encode_corpus(docs.where("doc_id in (1, 3, 5, 7)")).collect()}
    assert tokens == {d: len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows if d in (1, 3, 5, 7)}


def test_join_stage_keeps_names_of_any_kind(spark):
    from lucidreq.llm import jaccard_join

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "mine", 5, "k"), (2, text, "yours", 6, "k"), (3, None, "n", 7, None)], "doc_id long, text string, `__d` string, `__h` int, `__k.x` string")
    out = jaccard_join.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, text, "mine", 5, "k"), (3, None, "n", 7, None)]
