"""Hashed sets of word shingles, vectorised over the bytes of many texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[int, np.ndarray] = {}
#: Bytes that are hashed at a time; a longer text goes in pieces, so memory is bounded whatever its length.
CHUNK_BYTES = 1 << 19


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]


def hashed_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, its begin and end: its bytes as a polynomial, shifted back to its own start."""
    data = np.frombuffer(buffer + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_INVERSE, len(data))[begin] + (end - begin).astype(np.uint64)), begin, end


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(buffer.translate(_LOWER))[:2]


def _giant(word: bytes) -> np.ndarray:
    """The hash of one word of any length, the same as in :func:`hashed_words`."""
    total = 0
    for a in range(0, len(word), CHUNK_BYTES):
        data = np.frombuffer(word[a : a + CHUNK_BYTES], dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        total += int(np.add.reduce(data * _power(_BASE, len(data)))) * pow(_BASE, a, 1 << 64)
    return mix(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))


def all_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`hashed_words` of a buffer of any length, piece by piece; pieces end at white space."""
    if len(buffer) <= 2 * CHUNK_BYTES:
        return hashed_words(buffer)
    parts, a = [], 0
    while a < len(buffer):
        b = a + CHUNK_BYTES
        gap = _GAP.search(buffer, b)
        end = gap.start() if gap else len(buffer)
        if end - b <= CHUNK_BYTES:
            parts.append((a, hashed_words(buffer[a:end])))
        else:  # a word longer than a chunk crosses the cut
            start = max(buffer.rfind(bytes([c]), a, b) for c in b" \t\n\x0b\x0c\r") + 1 or a
            parts += [(a, hashed_words(buffer[a:start])), (start, (_giant(buffer[start:end]), np.array([0]), np.array([end - start])))]
        a = end
    return np.concatenate([x[0] for _, x in parts]), np.concatenate([x[1] + a for a, x in parts]), np.concatenate([x[2] + a for a, x in parts])


def _rolled(word: np.ndarray) -> np.ndarray:
    """The hash of the five words from each place on."""
    n = max(0, len(word) - WORDS + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS if n else 0):
        out += word[k : k + n] * _PLACE[k]
    return mix(out)


def _few(word: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle has: the whole sequence is one."""
    if not len(word):
        return np.zeros(0, dtype=np.uint64)
    h = np.array([len(word)], dtype=np.uint64)
    for k in range(len(word)):
        h = mix(h + word[k : k + 1] * _PLACE[k])
    return h


def _chunk(raws: list[bytes]) -> list[np.ndarray]:
    if len(raws) == 1 and len(raws[0]) > 2 * CHUNK_BYTES:
        word = all_words(raws[0].translate(_LOWER))[0]
        return [np.unique(_rolled(word)) if len(word) >= WORDS else _few(word)]
    word, begin = _words(b" ".join(raws))
    shingle = _rolled(word)
    stops = np.cumsum([len(x) + 1 for x in raws])
    bounds = np.searchsorted(begin, np.concatenate([[0], stops])).tolist()
    return [np.unique(shingle[a : b - WORDS + 1]) if b - a >= WORDS else _few(word[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in turn."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) > CHUNK_BYTES and held:
            yield from _chunk(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from _chunk(held)


def set_hash(tokens: np.ndarray) -> int:
    """A signed 64-bit identifier of the set; 0 for the empty one."""
    if not len(tokens):
        return 0
    total = np.array([np.add.reduce(mix(tokens + np.uint64(0x2545F4914F6CDD1D))) + np.uint64(len(tokens))], dtype=np.uint64)
    return int(mix(total).view(np.int64)[0]) or 1
