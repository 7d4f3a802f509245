"""op2, op5, op6, op7, op8 and the pipeline: hand-made cases, brute force, held-out accuracy."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidreq.llm import chat_format, decontaminate, html_extract, mixing, toxicity

from ..conftest import DATA

# ------------------------------------------------------------------- mixing


def test_mixing(docs_of):
    r = random.Random(3)
    rows = [(i, " ".join("w" * (i % 4 + 1) for _ in range(r.randint(1, 30))), "big" if i < 700 else "mid" if i < 900 else "small") for i in range(1000)]
    rows += [(2000, None, "big"), (2001, "", "empty"), (2002, "a b", None), (5, rows[5][1], "big")]
    docs = docs_of(rows)
    mix, steps = mixing.plan(docs, block_tokens=64, max_repetition=3.0)
    w = {x.source: x for x in mix.weights.collect()}
    tokens = Counter()
    for d, t, s in rows:
        tokens[s] += len((t or "").split())
    live = {s: n for s, n in tokens.items() if n}
    top = max(live.values())
    # With the least budget that uses everything once, a source repeats (top / n) ** (1 - exponent) times.
    for s, n in live.items():
        assert w[s].repetition == pytest.approx((top / n) ** (1 - mix.exponent), rel=1e-6)
    assert max(x.repetition for x in w.values()) == pytest.approx(3.0, rel=1e-4) and w["big"].repetition == 1.0
    assert sum(x.weight for x in w.values()) == pytest.approx(1.0)
    out = mixing.apply_plan(docs, steps)
    got = Counter()
    longest = max(len((t or "").split()) for _, t, _ in rows)
    for x in out.collect():
        assert x["__copies"] >= 1
        got[x.source] += x["__copies"] * len((x.text or "").split())
    for s, n in live.items():
        budget = w[s].repetition * n
        assert budget - 1e-6 <= got[s] <= budget + 2 * longest


@pytest.mark.parametrize("block_tokens", [1, 64, 1 << 16])
def test_mixing_is_cut_where_the_budget_is_spent(docs_of, block_tokens):
    """By plain Python: each epoch's order from the places, whole blocks together, and the last one cut at the first document that spends the budget."""
    r = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["a"] * 6 + ["b"] * 3 + ["c"])) for i in range(1500)]
    docs = docs_of(rows)
    mix, steps = mixing.plan(docs, block_tokens=block_tokens, max_repetition=3.0)
    w = {x.source: x for x in mix.weights.collect()}
    got = mixing.apply_plan(docs, steps).select("doc_id", "source", "text", "__block", "__copies", "__places").collect()
    assert len(got) == len(rows)
    for source in "abc":
        own = [x for x in got if x.source == source]
        whole, total = int(w[source].repetition), w[source].tokens
        rest = (w[source].repetition - whole) * total
        orders = []
        for epoch in range(whole):
            orders.append([x.doc_id for x in sorted(own, key=lambda x: x["__places"][epoch])])
            blocks = [x["__block"] for x in sorted(own, key=lambda x: x["__places"][epoch])]
            runs = [b for i, b in enumerate(blocks) if not i or blocks[i - 1] != b]
            assert len(runs) == len(set(runs))
        assert len({tuple(o) for o in orders}) == whole
        last = sorted((x for x in own if x["__copies"] > whole), key=lambda x: x["__places"][whole])
        spent = [len(x.text.split()) for x in last]
        if rest > 0:
            assert sum(spent) >= rest - 1e-6 > sum(spent[:-1]) - 1e-6
        else:
            assert not last
    assert {x["__copies"] for x in got} <= {1, 2, 3, 4}
    played = mixing.scheduled(docs, max_repetition=3.0).collect()
    assert Counter(x.doc_id for x in played) == Counter({x.doc_id: x["__copies"] for x in mixing.apply_plan(docs, mixing.plan(docs, max_repetition=3.0)[1]).collect()})


def test_mixing_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, 6), (2, None, None, 7, 8)], "doc_id long, text string, source string, __copies int, __key int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted((x.doc_id, x["__copies"], x["__key"]) for x in out.collect()) == [(1, 5, 6), (2, 7, 8)]


def test_mixing_targets_and_nothing(docs_of):
    docs = docs_of([(i, "w " * 10, "a" if i < 90 else "b") for i in range(100)])
    totals = docs.groupBy("source").agg(F.sum(F.lit(10).cast("long")).alias("tokens"), F.count("*").alias("rows"))
    mix = mixing.mixture(totals, target_entropy=0.8, max_repetition=None)
    p = np.array([x.weight for x in mix.weights.collect()])
    assert -(p * np.log(p)).sum() == pytest.approx(0.8 * np.log(2), abs=1e-5)
    assert mixing.mixture(totals, target_entropy=0.1).exponent == 1.0 and mixing.mixture(totals, max_repetition=100.0).exponent == 0.0
    assert mixing.mixed(docs.where("false")).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


# ------------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "toxic", "predicted", "toxicity", "offending", "text", toxicity.held_out("doc_id").alias("h")).collect()
    own = [r for r in scored if r.h]
    tp = sum(r.toxic and r.predicted for r in own)
    assert tp >= 0.6 * sum(r.toxic for r in own) and sum(not r.toxic and r.predicted for r in own) <= 0.06 * len(own)
    for r in scored:
        assert 0 <= r.toxicity <= 1
        for s in r.offending:
            assert r.text[s.begin : s.end].strip() and s.score >= 0.3


def test_toxicity_odd_rows(docs_of, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    docs = docs_of([(1, "x"), (None, "y"), (2, None), (3, ""), (3, "")])
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == 5 and all(r.predicted == 0 for r in out.collect() if not r.text)
    assert toxicity.clean_documents(docs, labels).columns == docs.columns
    assert toxicity.score(docs.where("false"), toxicity.ToxicityModel({}, -5.0)).count() == 0


def test_noisy_or_finds_the_telling_fragment():
    bags = [(1, 3, [[0], [1]])] * 20 + [(0, 3, [[1]])] * 40
    w, b = toxicity.train_noisy_or(bags, 2)
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert sig(w[0] + b) > 0.8 and sig(w[1] + b) < 0.1
    assert toxicity.sentences("One. Two!\n\nThree") == [(0, 4), (4, 9), (11, 16)]


# ------------------------------------------------------------------- decontamination

ITEM = "A train leaves the station at 60 km and after 3 hours Maria counts 12 apples in the old wooden basket near home."


def hits(text, items=((1, ITEM),), docs_of=None):
    side, canon = decontaminate.Items(list(items)), decontaminate.Canonical()
    return side.hits(*canon(text)) if text else []


@pytest.mark.parametrize(
    "text, found",
    [
        (ITEM, True),
        (f"before it {ITEM} after it", True),
        (ITEM.replace("60 km", "75 km").replace("3 hours", "5 hours").replace("Maria", "Peter").replace("12", "90"), True),
        (ITEM.upper().lower(), True),
        (" ".join(ITEM.split()[:9]), False),
        ("nothing of it at all in this sentence of some words", False),
        ("", False),
    ],
)
def test_templates(text, found):
    assert bool(hits(text)) == found


def test_slots_must_be_consistent():
    item = "add 5 to the sum and then 5 to the rest and then 5 to the end of all"
    good = item.replace("5", "8")
    bad = "add 5 to the sum and then 6 to the rest and then 7 to the end of all"
    assert hits(good, [(1, item)]) and hits(good, [(1, item)])[0][1] == len(item.split())
    assert not hits(bad, [(1, item)])


def test_decontaminate(docs_of, spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    docs = docs_of([(1, f"x y {ITEM}"), (1, f"x y {ITEM}"), (2, None), (None, "clean text of no interest to anyone"), (4, "")])
    for tokens in (1_000_000, 10):  # in one pass and in several
        rows = decontaminate.find_items(docs, bench, tokens).collect()
        assert sorted((str(r.doc_id), [h.item_id for h in r.hits]) for r in rows) == [("1", [1]), ("1", [1]), ("2", []), ("4", []), ("None", [])]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 3
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 5 and decontaminate.decontaminate(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize(
    "item, text, found",
    [
        ("Add 12, 47 and 90 to 33.", "they say: Add 12, 47 and 90 to 33. And more", True),
        # The same question with other numbers; then one number stands for two, another order of words, and a part of it.
        ("Add 12, 47 and 90 to 33.", "they say: Add 13, 48 and 91 to 34. And more", True),
        ("Add 12, 47 and 90 to 33.", "they say: Add 13, 48 and 13 to 34. And more", False),
        ("Add 12, 47 and 90 to 33.", "they say: Add 13, 48 to 91 and 34. And more", False),
        ("Add 12, 47 and 90 to 33.", "they say: 48 and 91 to 34. And more", False),
        ("Sum 1 2 3 4 5 plus 6 7 8 9 10 minus 11 12 13 14 15", "so: Sum 21 22 23 24 25 plus 26 27 28 29 30 minus 31 32 33 34 35", True),
        ("12 47 59 and 3 or 4", "so 13 48 61 and 5 or 6", False),
        ("Who wrote Hamlet?", "a list. Who wrote Hamlet? Someone did", True),
        ("Who wrote Hamlet?", "a list. Who wrote Faust? Someone did", False),
        ("12 47", "there were 12 47 of them", True),
        ("12 47", "there were 13 48 of them", False),
    ],
)
def test_items_without_a_seeding_window(item, text, found):
    assert bool(hits(text, [(1, item), (2, ITEM)])) == found


def plain_hits(items, text):
    """(item, longest run, share) by trying every diagonal of every item, without windows or hashes."""
    words, tokens = decontaminate.Canonical()(text)
    tokens, out = tokens.tolist(), []
    bare = decontaminate._bare
    for item, own_text in items:
        own_words, own = decontaminate.Canonical()(own_text or "")
        own, pieces = own.tolist(), []
        plain = lambda t: sum(x > 4 for x in t) >= decontaminate.LEAST_WORDS
        seeded = any(plain(own[k : k + 5]) for k in range(len(own) - 4))
        for shift in range(1 - len(own), len(tokens)):
            pairs = [(k, k + shift) for k in range(len(own)) if 0 <= k + shift < len(tokens)]
            size = min(5, len(own))
            meets = False
            for at in range(len(pairs) - size + 1):
                part = pairs[at : at + size]
                if all(own[a] == tokens[b] for a, b in part):
                    meets |= plain([own[a] for a, _ in part]) if seeded else all(bare(own_words[a]) == bare(words[b]) for a, b in part)
            there_is = dict(pairs)
            stops = [k for k, t in enumerate(own) if t > 4 and t != decontaminate._MARKS] if not seeded and len(own) >= 5 else []
            for a, c in zip(stops, stops[decontaminate.LEAST_WORDS - 1 :]):
                meets |= all(k in there_is and own[k] == tokens[there_is[k]] for k in range(a, c + 1))
            run: list = []
            for a, b in [*pairs, (None, None)] if meets else []:
                if a is not None and own[a] == tokens[b]:
                    run.append((a, b))
                    continue
                if len(run) >= size:
                    there, back, start = {}, {}, 0
                    for n, (x, y) in enumerate(run):
                        if own[x] <= 4:
                            mine, other = bare(own_words[x]), bare(words[y])
                            if there.get(mine, other) != other or back.get(other, mine) != mine:
                                if n - start >= size:
                                    pieces.append((run[start][0], run[n - 1][0] + 1, there))
                                there, back, start = {}, {}, n
                            there[mine], back[other] = other, mine
                    if len(run) - start >= size:
                        pieces.append((run[start][0], run[-1][0] + 1, there))
                run = []
        covered, there, back = set(), {}, {}
        for c, d, slots in sorted(pieces, key=lambda x: (x[0] - x[1], x[0])):
            if all(there.get(k, v) == v and back.get(v, k) == k for k, v in slots.items()):
                there.update(slots)
                back.update((v, k) for k, v in slots.items())
                covered |= set(range(c, d))
        longest = max((d - c for c, d, _ in pieces), default=0)
        if own and (longest >= min(decontaminate.LEAST_RUN, len(own)) or len(covered) / len(own) >= decontaminate.LEAST_COVER):
            out.append((item, longest, len(covered) / len(own)))
    return out


def test_templates_against_every_diagonal():
    r = random.Random(12)
    plain = ["train", "leaves", "the", "station", "after", "basket", "old", "wooden", "counts", "near", "home", "and", "of"]
    slot = lambda: r.choice([str(r.randint(1, 99)), r.choice(["Maria", "Peter", "Ann"]), f"{r.randint(1, 9)} km", f"{r.randint(1, 9)}kg"])
    make = lambda n, share: " ".join(slot() if r.random() < share else r.choice(plain) for _ in range(n))
    items = [(k, make(r.choice([3, 6, 12, 25]), r.choice([0.1, 0.3, 0.7]))) for k in range(30)]
    side, found = decontaminate.Items(items), 0
    for _ in range(300):
        words = items[r.randrange(30)][1].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice([slot().split()[0], r.choice(plain)])
        cut = r.randint(0, len(words) // 3)
        text = f"{make(r.randint(0, 6), 0.2)} {' '.join(words[cut:])} {make(r.randint(0, 6), 0.2)}"
        got = {i: (run, round(share, 9)) for i, run, share in side.hits(*decontaminate.Canonical()(text))}
        want = {i: (run, round(share, 9)) for i, run, share in plain_hits(items, text)}
        # An item may share a diagonal's run without a seed of its own elsewhere; what is found must be the same.
        assert got == want, text
        found += bool(got)
    assert found > 100


# ------------------------------------------------------------------- toxicity, long and joined words


def test_toxicity_reads_long_and_joined_words(docs_of, spark):
    model = toxicity.ToxicityModel({"=fool": 9.0, "idio": 9.0}, -2.0)
    joined = "-".join(f"plain{i}" for i in range(60))
    texts = ["you fool.You are", "a.b.c.fool." + "x." * 200, f"{joined}-idiot-{joined}", joined, "-" * 300_000 + "a" + "-" * 300_000 + "b", "no harm. None"]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(list(enumerate(texts))), model).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    r = random.Random(4)
    rows = [(i, "_".join(r.choices(["tree", "house", "river", "stone"], k=60) + ["gromble"] * (i % 2))) for i in range(80)]
    sample = spark.createDataFrame([(t, i % 2) for i, t in rows], "text string, toxic int")
    assert "gromb" in toxicity.choose_fragments(sample)[0]


# ------------------------------------------------------------------- chats


def call(*calls):
    return json.dumps({"content": "c", "tool_calls": list(calls)})


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi", "x"),
        (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": {"query": "q", "limit": 3}}, {"id": "b", "name": "search", "arguments": {"limit": "three"}, "after": ["a"]}), "x"),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ok"}), "x"),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"}), "x"),
        (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": "early"}), "x"),
        (2, 5, "assistant", call({"id": "k", "name": "calculator", "arguments": {"expression": "1+1"}}), "x"),
        (2, 6, "assistant", call({"id": "m", "name": "unknown", "arguments": {}, "after": ["k"]}), "x"),
        (2, 7, "assistant", "{not json", "x"),
        (None, 0, None, None, "x"),
        (3, 0, "user", "same", "x"),
        (3, 0, "user", "same", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, level string")
    tools = spark.createDataFrame(chat_format.DEFAULT_TOOLS, chat_format.TOOL_SCHEMA)
    out = chat_format.format_chats(df, tools)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert json.loads(by[1, 0].json) == {"content": "hi", "role": "user"}
    # The call waits for its own message's result: the two depend on each other.
    assert by[1, 1].level is None and by[1, 2].level is None
    assert (by[1, 1].n_calls, by[1, 1].n_invalid) == (2, 1)
    assert by[1, 1].json == '{"content":"c","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search"},{"after":["a"],"arguments":{"limit":"three"},"id":"b","name":"search"}]}'
    assert by[1, 2].linked is True and by[1, 3].linked is False and by[1, 0].linked is None
    order = sorted((r for r in got if r.conv_id == 2), key=lambda r: (r.order_turn, r.level, r.turn))
    assert [r.turn for r in order] == [5, 0, 6, 7]
    assert (by[2, 6].n_invalid, by[2, 5].n_invalid, by[2, 7].n_calls) == (1, 0, 0)
    assert json.loads(by[2, 0].json) == {"content": "early", "role": "tool", "tool_call_id": "k"}
    assert json.loads(by[None, 0].json) == {"content": "", "role": ""}
    assert chat_format.format_chats(df.where("false"), tools).count() == 0
    plain = chat_format.format_chats(df.where("role = 'user'"), tools).collect()
    assert len(plain) == 3 and all(r.n_calls == 0 and r.level == 0 for r in plain)


def plain_chats(rows, tools):
    """The same by plain Python: (conv_id, turn, json, n_calls, n_invalid, linked, level, order_turn) of each row."""
    last = 1 << 62
    kinds = {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object", type(None): "null"}
    info = {}
    for conv, turn, role, text in rows:
        role, text = (role or "").strip().lower(), text or ""
        try:
            obj = json.loads(text) if text.lstrip().startswith("{") and role in ("assistant", "tool") else None
        except ValueError:
            obj = None
        calls = obj.get("tool_calls") if role == "assistant" and isinstance(obj, dict) else None
        result = obj.get("tool_call_id") if role == "tool" and isinstance(obj, dict) else None
        if calls is not None:
            for c in calls:
                if isinstance(c.get("arguments"), str):
                    try:
                        c["arguments"] = json.loads(c["arguments"])
                    except ValueError:
                        pass
        known = obj if calls is not None or result is not None else {"content": text}
        line = json.dumps({"content": "", **known, "role": role}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        info[conv, turn, role, text] = {"at": last if turn is None else turn, "calls": calls or [], "result": result, "json": line, "conv": conv}
    first, done = {}, {}
    for k, m in sorted(info.items(), key=lambda x: x[1]["at"]):
        for c in m["calls"]:
            if m["conv"] is not None and c.get("id") is not None:
                first.setdefault((m["conv"], c["id"]), k)
        if m["result"] is not None and m["conv"] is not None:
            done.setdefault((m["conv"], m["result"]), []).append(k)
    before = {k: set() for k in info}
    for k, m in info.items():
        if m["result"] is not None and (s := first.get((m["conv"], m["result"]))):
            before[k].add(s)
        for c in m["calls"]:
            for i in c.get("after", []):
                before[k].update(done.get((m["conv"], i), []))
    odd = {info[k]["conv"] for k, own in before.items() for s in own if info[s]["at"] >= info[k]["at"]}
    place = {}
    for _ in info:
        for k, own in before.items():
            if k not in place and all(s in place for s in own):
                place[k] = max([(info[k]["at"], 0), *((place[s][0], place[s][1] + 1) for s in own)])
    schema = {n: {p: (t, r) for m, p, t, r in tools if m == n} for n, *_ in tools}

    def invalid(c):
        own, args = schema.get(c.get("name")), c.get("arguments")
        if own is None or not isinstance(args, dict) or any(r and p not in args for p, (_, r) in own.items()):
            return True
        return any(p not in own or (kinds[type(v)] != own[p][0] and (kinds[type(v)], own[p][0]) != ("integer", "number")) for p, v in args.items())

    out = []
    for conv, turn, role, text in rows:
        k = conv, turn, (role or "").strip().lower(), text or ""
        m = info[k]
        at, level = place.get(k, (m["at"], None)) if conv in odd and (before[k] or any(k in b for b in before.values())) else (m["at"], 0)
        out.append((conv, turn, m["json"], len(m["calls"]), sum(map(invalid, m["calls"])), None if m["result"] is None else (conv, m["result"]) in first, level, None if at == last else at))
    return out


def test_chats_against_plain_python(spark):
    r = random.Random(11)
    tools = [*chat_format.DEFAULT_TOOLS, ("mix", "x", "number", True), ("mix", "flag", "boolean", False)]
    rows = []
    for conv in [*range(60), None]:
        turns = list(range(12))
        if conv is not None and conv % 3 == 0:
            r.shuffle(turns)  # out of order, some of them in cycles
        ids = [f"c{i}" for i in range(4)]
        for k in range(12):
            turn, at = (None if r.random() < 0.05 else turns[k]), r.random()
            if at < 0.35:
                calls = []
                for i in r.sample(ids, r.randint(1, 2)):
                    args = r.choice([{"query": "q"}, {"query": 3}, {}, {"x": 1}, {"x": 1.5, "flag": True}, {"x": "s", "z": [1]}, '{"query":"é"}', "no json", {"expression": "1", "n": {"b": 1, "a": None}}])
                    call_ = {"id": i, "name": r.choice(["search", "mix", "calculator", "none"]), "arguments": args, "extra": {"z": 1, "a": [2]}}
                    if r.random() < 0.4:
                        call_["after"] = r.sample(ids, 1)
                    if r.random() < 0.1:
                        del call_["id"]
                    calls.append(call_)
                calls += calls[:1] * (r.random() < 0.2)
                rows.append((conv, turn, " Assistant", json.dumps({"tool_calls": calls, "meta": k}, ensure_ascii=False)))
            elif at < 0.7:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": r.choice(ids), "content": f"r{k}", "ok": True})))
            else:
                rows.append((conv, turn, r.choice(["user", "assistant", "tool", None]), r.choice([f"text {k}", "{broken", '["x"]', None, '{"a": 1}'])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = [tuple(x) for x in chat_format.format_chats(df, spark.createDataFrame(tools, chat_format.TOOL_SCHEMA)).drop("role").collect()]
    want = plain_chats(rows, tools)
    assert len(got) == len(rows) and any(x[6] is None for x in want) and any(x[6] for x in want)
    assert Counter(got) == Counter(want)


# ------------------------------------------------------------------- pages


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>just text", "just text"),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p><b>One.<br><p>Two,\n two</p></article><footer>&copy; f</footer>", "T & t\nOne.\nTwo, two"),
        ("<body><div class='cookie-notice'>We use cookies, fine.</div><div id=content><p>Body text, long enough.</p><ul><li>a<li>b</ul></div><div class=comments><p>First! A comment, quite long too.</p></div>", "Body text, long enough.\na\nb"),
        ("<main><form><p>Name, please.</p></form><p>Text, here.</p><script>var a = '<p>no</p>';</script><!-- <p>no</p> --></main>", "Text, here."),
        ("<article><p>Kept, yes.</p></article><p>cut &am", "Kept, yes."),
    ],
)
def test_pages(page, text):
    assert html_extract.main_text(page) == text


def test_generated_pages():
    """Articles of random blocks among menus, adverts, forms, notices and comments come out whole."""
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))
    sentence = lambda: f"{words(r.randint(6, 20)).capitalize()}, {words(r.randint(3, 9))}."
    for _ in range(150):
        blocks, html = [], []
        for k in range(r.randint(3, 12)):
            kind = r.choice(["p", "p", "p", "h2", "ul", "blockquote", "links", "figure", "warning", "inline"])
            t = sentence()
            blocks += [t] if kind not in ("ul", "links") else [t, "other one"]
            html.append(
                {
                    "p": f"<p>{t}</p>",
                    "h2": f"<h2>{t}</h2>",
                    "ul": f"<ul><li>{t}<li>other   one</ul>",
                    "links": f'<ul><li><a href="/x">{t}</a></li><li><a href=/y>other one</a></li></ul>',
                    "blockquote": f"<blockquote>{t}</blockquote>",
                    "figure": f"<figure><img src=a.png><figcaption>{t}</figcaption></figure>",
                    "warning": f'<p class="warning">{t}</p>',
                    "inline": "<p>" + t.replace(", ", ", <b>", 1).replace(".", "</b>.") + "</p>",
                }[kind]
            )
        title = words(4)
        head = f"<header><h1>{title}</h1></header>" if r.random() < 0.5 else f"<h1>{title}</h1>"
        around = [
            f"<nav><ul>{''.join(f'<li><a href=/{i}>{words(1)}</a>' for i in range(5))}</ul></nav>",
            f'<div class="ad">{sentence()}</div>',
            f"<form><p>{sentence()}</p><select><option>{words(2)}</select></form>",
            f'<div id="cookie-notice"><p>{sentence()}</p></div>',
            f"<aside><p>{sentence()}</p></aside>",
            f"<script>var a = '<p>{words(3)}</p>';</script>",
        ]
        r.shuffle(around)
        comments = f'<section class="comments"><p>{sentence()}</p></section>'
        inside = comments if r.random() < 0.5 else ""
        page = f"<html><head><title>{title}</title></head><body><header>{words(3)}</header>{''.join(around[:3])}<article>{head}{''.join(html)}{inside}</article>{''.join(around[3:])}{comments}<footer>{words(4)}</footer></body></html>"
        assert html_extract.main_text(page) == "\n".join([title, *blocks])


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Formula <math><mi>x</mi></math> here. <a href="x>link</a> two, three.</p></article>', "Formula x here. link two, three."),
        ("<article><address>By me, there.</address><p>Text, long enough.</p><canvas>no</canvas><noscript>no</noscript></article>", "By me, there.\nText, long enough."),
        ("<header>Site</header><main><p>One, two.</p></main>", "One, two."),
    ],
)
def test_pages_keep_what_the_article_holds(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        # Readers' comments, however they are marked up.
        ('<article><p>Own text, long.</p><article class="comment"><p>I agree, fully.</p></article></article>', "Own text, long."),
        ('<article><p>Own text, long.</p><ol><li class="comment even" id="comment-7">I agree, fully.</li></ol></article>', "Own text, long."),
        ('<article><p>Own text, long.</p><div class="commentSection"><p>I agree, fully.</p></div></article>', "Own text, long."),
        ('<article><p>Own text, long.</p><section itemprop="comment"><p>I agree, fully.</p></section></article>', "Own text, long."),
        # Adverts and notices of the site.
        ('<article><p>Own text, long.</p><p class="advert">Buy this, now.</p><p class="cookie-notice">We use cookies, yes.</p></article>', "Own text, long."),
        ('<article><p>Own text, long.</p><div class="adBox">Buy this, now.</div></article>', "Own text, long."),
        ('<article><p>Own text, long.</p><div class="share"><a>Post</a> <a>Mail</a></div><div class="related"><a>Other news, here</a></div></article>', "Own text, long."),
        # Names that only hold such a word, or also name a topic.
        ('<article><p>Own text.</p><div class="market share"><p>The market share of the firm grew by a third in one year, to a half.</p></div></article>', "Own text.\nThe market share of the firm grew by a third in one year, to a half."),
        ('<article><div class="tags-explained"><p>Own text, long.</p></div></article>', "Own text, long."),
        ('<article><section class="related-work"><h2>Related work</h2><p>Others did this.</p></section></article>', "Related work\nOthers did this."),
        ('<article><section id="search"><p>The search reads the index from its end, and stops where nothing is left of it.</p></section></article>', "The search reads the index from its end, and stops where nothing is left of it."),
        ('<body><div class="header-image-story"><p>Own text, long.</p></div></body>', "Own text, long."),
        ('<body><div class="has-sidebar"><p>Own text, long.</p></div></body>', "Own text, long."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p class="tag">Own text, long.</p></article>', "Title\nOwn text, long."),
        # Bare containers.
        ("<body><div><a>Home</a> <a>About</a></div><div>Own text, long, of the page.</div><div>It goes on, so it does.</div><div>Copyright 2020 the firm.</div></body>", "Own text, long, of the page.\nIt goes on, so it does."),
        # Other articles.
        ('<article><p>Own text, long, of the page.</p></article><article class="teaser"><p>Another text, which is long as well.</p></article>', "Own text, long, of the page."),
        ("<article><p>First part, of the page.</p></article><article><p>Second part, of the page.</p></article>", "First part, of the page.\nSecond part, of the page."),
        ("<body><p><a>A paragraph, all of it a link.</a></p></body>", "A paragraph, all of it a link."),
        ("<body><nav><a>Home</a></nav><div><a>Home</a> <a>About</a></div></body>", ""),
    ],
)
def test_pages_by_names_and_ratios(page, text):
    assert html_extract.main_text(page) == text


def test_generated_pages_without_loss():
    """Every part of an article and no part beside it, on pages put together at random."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("stone river cold long north house walked seven".split()) for _ in range(n))
    for _ in range(300):
        own, html = [], []

        def add(shape):
            text = f"{words(rng.randint(14, 40)).capitalize()}, {words(4)}."
            own.append(text)
            return shape % text

        innocent = ['<div class="market share"><p>%s</p></div>', '<section class="related-work"><p>%s</p></section>', '<section id="search"><p>%s</p></section>', '<p class="note">%s</p>', "<p>%s</p>", "<ul><li>%s</li></ul>", '<div class="tags-explained"><p>%s</p></div>', "<blockquote>%s</blockquote>"]
        foreign = ['<article class="comment"><p>%s</p></article>', '<ul><li class="comment">%s</li></ul>', '<div class="commentList"><p>%s</p></div>', '<p class="advert">%s</p>', '<div class="adSlot">%s</div>', '<div class="cookieNotice"><p>%s</p></div>', '<aside>%s</aside>', '<div class="share"><a href="/">%s</a></div>', '<form><p>%s</p></form>', '<div class="newsletter-signup"><p>%s</p></div>']
        for _ in range(rng.randint(3, 9)):
            html.append(add(rng.choice(innocent)))
            if rng.random() < 0.5:
                html.append(rng.choice(foreign) % f"Strange {words(8)}, {words(3)}.")
        holder = rng.choice(["<article>%s</article>", "<main>%s</main>", '<main><article class="post tag-news">%s</article></main>'])
        page = f'<html><body><div class="top-nav"><a>{words(2)}</a></div>{holder % "".join(html)}<article class="teaser"><p>{words(30)}, {words(9)}.</p></article><footer>{words(9)}</footer></body></html>'
        assert html_extract.main_text(page) == "\n".join(own)


def test_extract_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "mine", "<p>A, b.</p>")], "`__page` long, `a.b` string, html string")
    assert html_extract.extract(pages).collect() == [(1, "mine", "A, b.", 5)]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>A, b.</p></article>", "x"), (1, "u", None, "y")], "page_id long, url string, html string, n_chars string")
    out = html_extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("A, b.", 5)]
    assert html_extract.extract(pages.where("false")).count() == 0


# ------------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    sf = f"{DATA}/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if name != "token_output":
            assert docs.columns == first.columns
    # Each filter removes some, mixing repeats some, and every row is encoded.
    assert counts[0] > counts[1] > counts[2] > counts[3] <= counts[4] == counts[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
