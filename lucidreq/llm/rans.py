"""Range asymmetric numeral system over a static table, vectorised over lanes.

A block is a run of token ids dealt round-robin over ``lanes`` interleaved
coder states that share one stream of 32-bit words. All blocks use one static
frequency table, so any block decodes on its own; checkpoints inside a block
(stream position and lane states every ``CHECK_STEPS`` steps) let several
decoders share one block. Little-endian layout of a block:

    magic "RANB", u32 lanes, u64 ids, u32 words, u32 checkpoints,
    u32 crc32 of the ids (as u32), u32 crc32 of all bytes after this header,
    u64 states[lanes], then for each checkpoint u32 step, u32 word, u64 states[lanes],
    u32 words[words]
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
MASK = np.uint64((1 << SCALE_BITS) - 1)
WORD = np.uint64(32)
SHIFT = np.uint64(SCALE_BITS)
MAX_LANES = 4096
CHECK_STEPS = 64
_HEAD = struct.Struct("<4sIQIIII")


class Table:
    """Frequencies scaled to 2**SCALE_BITS; every id that occurs keeps at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.float64)
        if np.count_nonzero(counts) > (1 << SCALE_BITS):
            raise ValueError("more ids than the scale has slots")
        freq = np.zeros(len(counts), dtype=np.int64)
        if counts.sum():
            freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * (1 << SCALE_BITS))), 0).astype(np.int64)
            # The rest goes to, or comes from, the most frequent ids in turn.
            order = np.argsort(-freq, kind="stable")
            rest = (1 << SCALE_BITS) - int(freq.sum())
            while rest:
                take = order[freq[order] > 1] if rest < 0 else order[counts[order] > 0]
                step = take[: abs(rest)]
                freq[step] += 1 if rest > 0 else -1
                rest = (1 << SCALE_BITS) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    states = np.full(lanes, LOW, dtype=np.uint64)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id that the table lacks")
    limit = freq << np.uint64(63 - SCALE_BITS)
    groups, marks, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x, f = states[: b - a], freq[a:b]
        full = x >= limit[a:b]
        if full.any():
            out = x[full].astype(np.uint32)
            groups.append(out)
            written += len(out)
            x = np.where(full, x >> WORD, x)
        q = x // f
        states[: b - a] = (q << SHIFT) + (x - q * f) + cum[a:b]
        if t and t % CHECK_STEPS == 0:
            marks.append((t, written, states.copy()))
    words = np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32)
    body = [states.astype("<u8").tobytes()]
    for t, done, kept in reversed(marks):
        body += [struct.pack("<II", t, written - done), kept.astype("<u8").tobytes()]
    body.append(words.astype("<u4").tobytes())
    body = b"".join(body)
    crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
    return _HEAD.pack(b"RANB", lanes, n, len(words), len(marks), crc, zlib.crc32(body)) + body


def _opened(block) -> tuple:
    """lanes, ids, words, crc, where the words begin, and (step, word, states) of the start and each checkpoint."""
    magic, lanes, n, n_words, n_marks, crc, body_crc = _HEAD.unpack_from(block)
    if magic != b"RANB" or zlib.crc32(memoryview(block)[_HEAD.size :]) != body_crc:
        raise ValueError("damaged block")
    starts = [(0, 0, np.frombuffer(block, "<u8", lanes, _HEAD.size))]
    at = _HEAD.size + 8 * lanes
    for _ in range(n_marks):
        t, word = struct.unpack_from("<II", block, at)
        starts.append((t, word, np.frombuffer(block, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return lanes, n, n_words, crc, at, starts


def checkpoints(block) -> list[tuple[int, int]]:
    """The first id and the end of what each checkpoint decodes (see :func:`decode`)."""
    lanes, n, _, _, _, starts = _opened(block)
    edges = [min(n, t * lanes) for t, _, _ in starts] + [n]
    return list(zip(edges[:-1], edges[1:]))


def decode(block, table: Table, checkpoint: int | None = None) -> np.ndarray:
    """All ids, or those from one checkpoint up to the next (0 is the block's start)."""
    lanes, n, n_words, crc, at, starts = _opened(block)
    words = np.frombuffer(block, "<u4", n_words, at)
    steps = -(-n // lanes)
    first, word, states = starts[checkpoint or 0]
    last = steps if checkpoint is None or checkpoint + 1 >= len(starts) else starts[checkpoint + 1][0]
    x = states.astype(np.uint64)
    out = np.empty(min(n, last * lanes) - first * lanes, dtype=np.uint32)
    for t in range(first, last):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y = x[: b - a]
        slot = y & MASK
        s = table.symbol[slot]
        out[a - first * lanes : b - first * lanes] = s
        y = table.freq[s] * (y >> SHIFT) + slot - table.cum[s]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << WORD) | words[word : word + len(low)]
            word += len(low)
        x[: b - a] = y
    if checkpoint is None and zlib.crc32(out.astype("<u4", copy=False)) != crc:
        raise ValueError("ids don't match their checksum")
    return out
