"""op9 and op10: brute force, odd rows, damaged blocks."""

import hashlib
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucidreq.llm import exact_dedup, rans, token_output, word_tokenizer

ODD = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \n"), (7, "x" * 5000), (None, "ab"), (2, "ab"), (9, "q"), (9, "r"), (9, "q"), (10, "á b")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, own in groups.items():
        own.sort(key=lambda x: x[:3])
        for k, x in enumerate(own):
            out.append((x[3], own[0][3], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(docs_of, digest):
    got = exact_dedup.exact_dedup(docs_of(ODD), digest)
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr)
    assert rows == sorted((x[:4] for x in brute(ODD)), key=repr)


def test_exact_dedup_of_nothing(docs_of):
    assert exact_dedup.exact_dedup(docs_of([(1, "a")]).where("false")).count() == 0


def test_index_lookup_and_no_python(docs_of, spark):
    df = docs_of(ODD)
    text = F.coalesce("text", F.lit(""))
    hashed = df.select("doc_id", F.char_length(text).cast("long").alias("n_cp"), exact_dedup.squeeze(text).alias("normal"))
    hashed = hashed.withColumn("digest", F.sha2("normal", 256))
    index = exact_dedup.DigestIndex(spark)
    index.flush(hashed.where("doc_id < 3"))
    index.flush(hashed.where("doc_id >= 3"))
    index.compact()
    ab = hashlib.sha256(b"ab").hexdigest()
    found = index.lookup([ab, "none"])
    assert [(r.digest, r.keep_id, r.group_size) for r in found.collect()] == [(ab, 3, 4)]
    # The reader gets the digests, so it can skip by range and filter.
    assert "PushedFilters: [Or(EqualTo(digest" in found._jdf.queryExecution().executedPlan().toString()
    more = index.compact()
    assert index.levels == 2 and more.count() == hashed.where("doc_id is not null").select("digest").distinct().count()
    plan = exact_dedup.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000))
def test_rans_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    table = rans.Table(np.bincount(ids, minlength=301))
    assert (rans.decode(rans.encode(ids, table), table) == ids).all()


def test_rans_checkpoints_and_checksums():
    ids = np.random.default_rng(0).integers(0, 5000, 700_000).astype(np.uint32)
    table = rans.Table(np.bincount(ids, minlength=5000))
    block = rans.encode(ids, table)
    parts = [rans.decode(block, table, k) for k in range(3)]
    assert (np.concatenate(parts) == ids).all()
    damaged = bytearray(block)
    damaged[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(damaged), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([5001], np.uint32), rans.Table(np.ones(6000) * (np.arange(6000) < 5000)))


TEXTS = [None, "", " ", "It's ''s .'s we'll Å naïve ½ 12 x", "İstanbul Σας <|endoftext|> a\x1cb", "x́ combining", "word " * 3000, "...!!?? 'twas don't", "日本語 mixed text", "a\xa0b\x85c"]


def test_words_equal_the_tokenizer():
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path())
    got = []
    for _, ids, counts in tk.encode(TEXTS):
        got += [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*e.ids, 1] for e in tk.tk.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_token_files(docs_of):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS * 3)] + [(7, "same"), (7, "same"), (None, "no id")]
    out = token_output.encode_corpus(docs_of(rows), block_tokens=2000, with_ids=True).collect()
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path()).tk
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*tk.encode(t or "", add_special_tokens=False).ids, 1])
    out.sort(key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at and r.ids in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        want[r.doc_id].remove(r.ids)
        at += r.n_tokens
    assert not any(want.values())
    ids = [r.doc_id for r in out]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_output.encode_corpus(docs_of(rows).where("false")).count() == 0


def test_token_files_are_read_from_their_folder_alone(docs_of, tmp_path):
    """In a session of its own, by another process: all documents, and any range of tokens from its checkpoint on."""
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices("abcdefghij", k=4)) for _ in range(r.randint(0, 400)))) for i in range(300)]
    out = f"file://{tmp_path}/files"
    token_output.write_corpus(docs_of(rows), out, block_tokens=30_000)
    code = f"""
from lucidreq.session import local_session
from lucidreq.llm import token_output
spark = local_session("2", 2)
rows = token_output.read_corpus(spark, {out!r}, with_ids=True).orderBy("start").collect()
stream = [i for x in rows for i in x.ids]
assert [x.doc_id for x in rows] == list(range(300)) and [x.start for x in rows][1] == rows[0].n_tokens
for a, b in ((0, 1), (5_000, 90_001), (29_999, 30_001), (len(stream) - 3, len(stream) + 9)):
    assert [i for x in token_output.read_tokens(spark, {out!r}, a, b).orderBy("start").collect() for i in x.ids] == stream[a:b]
print("SUM", sum(stream), len(stream))
"""
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path()).tk
    want = [i for _, t in rows for i in [*tk.encode(t, add_special_tokens=False).ids, 1]]
    top = Path(token_output.__file__).parents[2]
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=top, timeout=300)
    assert f"SUM {sum(want)} {len(want)}" in done.stdout, done.stderr[-3000:]


def test_long_plain_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(word_tokenizer, "CHUNK_BYTES", 100)
    r = random.Random(4)
    texts = [" ".join(r.choice(["the", "École", "naïve.\xa0It's", "x" * 300]) for _ in range(r.randint(0, 200))) for _ in range(20)]
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path())
    got = [p.tolist() for _, ids, n in tk.encode(texts) for p in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*tk.tk.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(word_tokenizer, "CACHE_WORDS", 50)
    r = random.Random(6)
    tk = word_tokenizer.WordTokenizer(word_tokenizer.default_path())
    texts = [" ".join(r.choice(["the", "of", "and", "".join(r.choices("xyzuvw", k=3))]) for _ in range(30)) for _ in range(200)]
    for a in range(0, 200, 10):
        got = [p.tolist() for _, ids, n in tk.encode(texts[a : a + 10]) for p in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [[*tk.tk.encode(t, add_special_tokens=False).ids, 1] for t in texts[a : a + 10]]
