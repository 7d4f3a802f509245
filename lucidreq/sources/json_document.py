"""One JSON document with a long list of objects, read by many tasks.

Spark's text source splits the file at byte ranges and cuts it at closing braces. Whether
such a piece begins inside a string, and at what depth, depends on all that is before
it; so a first pass gives each range's effect on both states (under either
assumption about strings), the ranges' effects are composed in order, and a second
pass, which then knows its state, cuts out the list's elements. Elements that cross ranges
come in fragments and are put together by a small aggregation. What the driver holds is a
row of numbers for each range.

A piece never ends in an open escape: a backslash before a brace isn't valid JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

_STRING = re.compile(r'"(?:[^"\\]+|\\.)*+(?:"|\Z)', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]+|\\.)*+(?:"|\Z)|[{}\[\]]', re.S)
_BRACKET = re.compile(r"[{}\[\]]")
_ESCAPE = re.compile(r"\\.", re.S)


@dataclass
class Document:
    """``elements``: place, json of the list's elements in list order; ``rest``: value, the document with an empty list (one row); ``found``: whether the list is there."""

    elements: DataFrame
    rest: DataFrame
    found: bool


def _step(text: str, inside: bool) -> tuple[int, int, bool]:
    """How far ``text`` changes the depth, the least change on the way, and whether it ends inside a string."""
    text = f'"{text}' if inside else text
    change = least = 0
    for c in _BRACKET.findall(_STRING.sub("", text)):
        change += 1 if c in "{[" else -1
        least = min(least, change)
    return change, least, _ESCAPE.sub("", text).count('"') % 2 == 1


def _ranges(pieces: DataFrame) -> DataFrame:
    """file, block, flips (whether the range changes being inside a string), out, in (depth changes if it begins outside or inside one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            for file, block, text in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if now is None or now[0] != file or now[1] != block:
                    now = [file, block, [False, True], [0, 0]]
                    out.append(now)
                for k in (0, 1):
                    change, _, now[2][k] = _step(text + "}", now[2][k])
                    now[3][k] += change
        yield pd.DataFrame([(f, b, s[0], *d) for f, b, s, d in out], columns=["file", "block", "flips", "out", "in"])

    return pieces.mapInPandas(run, "file string, block long, flips boolean, out long, in long")


def _fragments(pieces: DataFrame, states: dict[tuple[str, int], tuple[bool, int]], entry: str | None) -> DataFrame:
    """file, block, seq, listed (in the list; null: as the range began), kind, text.

    kind: 'whole' element, 'head', 'middle' or 'tail' of one that crosses ranges, 'open' and 'close' of
    the list, 'rest' of the document. Elements carry what stands before them since the last one.
    """
    base = 1 if entry is None else 2

    def cut(text: str, inside: bool, depth: int, key: str | None) -> Iterator[tuple[str, str, int, str | None]]:
        """Pieces of a text that touches the document's own level: (what ends the piece, piece, depth after it, last key)."""
        shift = 1 if inside else 0
        at = 0
        for m in _TOKEN.finditer(f'"{text}' if inside else text):
            token, end = m.group(), m.end() - shift
            if token[0] == '"':
                if depth == base - 1:
                    key = token
                continue
            depth += 1 if token in "{[" else -1
            opens = token == "[" and depth == base and (entry is None or (key is not None and _same(key, entry)))
            if opens or (token == "]" and depth == base - 1) or (token == "}" and depth == base):
                yield ("open" if opens else "close" if token == "]" else "end"), text[at:end], depth, key
                at = end
        if at < len(text):
            yield "", text[at:], depth, key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        held: list[str] = []
        first = True
        listed: bool | None = None
        key = None

        def closed(kind_whole: bool) -> list[tuple]:
            """What is held, as the end (or not) of an element."""
            nonlocal held, first
            if not held:
                return []
            kind = ("tail" if first else "whole") if kind_whole else ("middle" if first else "head")
            row = (*now, listed, kind, "".join(held))
            held, first = [], first and not kind_whole
            return [row]

        for batch in batches:
            out: list[tuple] = []
            for file, block, text in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if now != (file, block):
                    if now is not None:
                        out += closed(False)
                    now = (file, block)
                    inside, depth = states[now]
                    # A range that begins at the document's own level is outside the list.
                    listed = None if depth >= base else False
                    first, key = listed is None, None
                text += "}"
                change, least, ends = _step(text, inside)
                if depth + least >= base and listed is not False:
                    held.append(text)
                    if depth + change == base and not ends:
                        out += closed(True)
                    depth += change
                elif depth + least >= base:
                    out.append((*now, False, "rest", text))
                    depth += change
                else:
                    for what, piece, depth, key in cut(text, inside, depth, key):
                        if what == "open":
                            out += [(*now, listed, "rest", piece), (*now, True, "open", "")]
                            listed, first = True, False
                        elif what == "close":
                            # The list ends, or another one (told by what the range began as).
                            out += [*_last(now, listed, held + [piece[:-1]], first), (*now, listed, "close", ""), (*now, False, "rest", piece[-1])]
                            listed, held, first = False, [], False
                        elif listed is False or depth < base:
                            out.append((*now, listed if depth >= base else False, "rest", piece))
                        else:
                            held.append(piece)
                            if what == "end":
                                out += closed(True)
                inside = ends
            yield _frame(out)
        if now is not None:
            yield _frame(closed(False))

    kind = "file string, block long, listed boolean, kind string, text string"
    return pieces.mapInPandas(run, kind)


def _last(now: tuple, listed: bool | None, held: list[str], first: bool) -> list[tuple]:
    """What stands between the last element and the list's end."""
    text = "".join(held)
    return [(*now, listed, "tail" if first and text.strip() else "after", text)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "block", "listed", "kind", "text"]).astype({"listed": "object"})


def _same(token: str, entry: str) -> bool:
    return token == f'"{entry}"' or ("\\" in token and json.loads(token) == entry)


def values_of(text: str) -> list[str]:
    """The JSON values in a stretch of a list, with or without commas around them."""
    out, at, decoder = [], 0, json.JSONDecoder(strict=False)
    while True:
        while at < len(text) and text[at] in " \t\r\n,\ufeff":
            at += 1
        if at == len(text):
            return out
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end


def read_document(spark: SparkSession, path: str, entry: str | None = None) -> Document:
    """The list under the key ``entry`` of the document's object (or the document itself, if it is a list), element by element.

    Elements keep their text as written; values that aren't objects are elements
    too. A folder of documents, as the writers make of many rows, is read as one: the lists follow each other in the order
    of the files' names, the rest is that of the first. Splits follow ``spark.sql.files.maxPartitionBytes``. A text that
    isn't one complete document fails.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = sorted(_ranges(pieces).collect(), key=lambda r: (r.file, r.block))  # a few numbers for each range
    states, final, inside, depth, file = {}, {}, False, 0, None
    for r in ranges:
        if r.file != file:
            inside, depth, file = False, 0, r.file
        states[r.file, r.block] = (inside, depth)
        depth += r["in"] if inside else r.out
        inside = inside != r.flips
        final[r.file] = (inside, depth)
    # After the last brace there may be a piece that none closes.
    if any(i or d not in (0, -1) for i, d in final.values()):
        raise ValueError(f"not one complete JSON document: {path}")
    open_end = any(d for _, d in final.values())
    found = materialize(_fragments(pieces, states, entry).withColumn("seq", F.monotonically_increasing_id()), "json-fragments")
    # Where the list begins and ends: two rows for each file.
    marks = {}
    for r in found.where("kind in ('open', 'close')").select("file", "block", "seq", "kind", "listed").orderBy("file", "block", "seq").collect():
        marks.setdefault(r.file, []).append(r)
    open_at, state = {}, {}
    for f, b in sorted(states):
        state.setdefault(f, False)
        open_at[f, b] = state[f]
        for r in [m for m in marks.get(f, []) if m.block == b]:
            state[f] = r.kind == "open"
    began = spark.createDataFrame([(f, b, o) for (f, b), o in open_at.items()], "file string, block long, began boolean")
    own = found.join(F.broadcast(began), ["file", "block"]).withColumn("in_list", F.coalesce("listed", "began") & ~F.col("kind").isin("open", "close", "rest"))
    elements = own.where("in_list")
    # Fragments of an element share the range in which it ends.
    order = sorted(states)
    tails = {(r.file, r.block) for r in elements.where("kind = 'tail'").select("file", "block").collect()}
    ends_in, last = [], {}
    for f, b in reversed(order):
        if (f, b) in tails:
            last[f] = b
        ends_in.append((f, b, b if (f, b) in tails else None, last.get(f)))
        # What a range's head belongs to ends in a later range.
    following: dict[tuple[str, int], int | None] = {}
    for (f, b), nxt in zip(order, [*order[1:], (None, None)], strict=True):
        following[f, b] = next((e for ff, bb, _, e in ends_in if (ff, bb) == nxt), None) if nxt[0] == f else None
    to = spark.createDataFrame([(f, b, e, following[f, b]) for f, b, _, e in ends_in], "file string, block long, mine long, later long")
    parts = elements.where("kind in ('head', 'middle', 'tail')").join(F.broadcast(to), ["file", "block"])
    parts = parts.withColumn("at", F.when(F.col("kind") == "head", F.col("later")).otherwise(F.col("mine")))
    joined = parts.groupBy("file", F.col("at").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(parts["block"], "seq", "text"))), lambda x: x["text"]), "").alias("text")).withColumn("seq", F.lit(-1).cast("long"))
    whole = elements.where("kind in ('whole', 'after')").select("file", "block", "seq", "text")
    listed = whole.unionByName(joined.select("file", "block", "seq", "text"))
    values = F.udf(values_of, "array<string>", useArrow=True)
    listed = materialize(listed.select("file", "block", "seq", F.posexplode(values("text")).alias("k", "json")), "json-elements")
    counts = listed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, base = 0, {}
    for r in sorted(counts, key=lambda r: (r.file, r.block)):
        base[r.file, r.block] = before
        before += r.n
    offset = spark.createDataFrame([(f, b, n) for (f, b), n in base.items()], "file string, block long, base long")
    from pyspark.sql import Window

    own_place = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq", "k")) - 1  # a range's elements
    placed = listed.withColumn("own", own_place).join(F.broadcast(offset), ["file", "block"]).select((F.col("base") + F.col("own")).cast("int").alias("place"), "json")
    rest = own.where("not in_list and kind not in ('open', 'close')").where(F.col("file") == F.lit(order[0][0] if order else ""))
    text = rest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "block", "seq", "text"))), lambda x: x["text"]), "").alias("value"))
    whole_text = F.expr("substring(value, 1, char_length(value) - 1)") if open_end else F.col("value")
    text = text.select(F.regexp_replace(whole_text, "^\\x{feff}", "").alias("value"))
    return Document(placed, text, any(m.kind == "open" for f in marks.values() for m in f))
