"""Token ids of whole texts, equal to the tokenizer's own, with a cache of words.

The tokenizer drops white space and its merges never cross a unit of its splitting
pattern. Texts of plain Latin characters are therefore split at white space here,
the units of each new word go straight to the tokenizer's model (spelled in its
byte alphabet), and the ids are gathered; any other text goes to the tokenizer as
it is. Words are known by a 64-bit hash of their bytes and length, in arrays: a
word that isn't among n known ones is taken for one with a chance of n / 2**64.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shingles import hashed_words

#: The letters, numbers and white space of the characters up to U+017F, and the splitting pattern over them.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t-\r\xa0"
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Bytes of plain texts: white space, printable ASCII, and what codes U+0080 to U+017F.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC2, 0xC3, 0xC4, 0xC5])
_CONTROL = re.compile(b"\xc2[\x80-\x9f]")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LOW = re.compile(b"[\x00-\x08\x0e-\x1f\x7f]")


#: The byte alphabet: a byte that prints stands for itself, the others for the characters from U+0100 on, in turn.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def is_odd(raw: bytes) -> bool:
    """Whether a text holds characters (or a special token) that need the tokenizer itself.

    Plain texts are in composed form already, for they hold no combining marks.
    """
    return not raw.isascii() and (bool(raw.translate(None, _PLAIN)) or b"\xc4\xb0" in raw or (b"\xc2" in raw and bool(_CONTROL.search(raw)))) or b"<|" in raw or bool(_LOW.search(raw))


#: Words that are remembered; then those that came again stay.
CACHE_WORDS = 1_000_000
CHUNK_BYTES = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    def __init__(self, path: str, end_id: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self._reset()

    def _reset(self) -> None:
        self.first, self.count, self.uses, self.flat = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, np.int64, np.uint32))
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slots = np.zeros(1 << 18, np.int32)  # words by hash; 0 is free
        self.n, self.n_ids = 1, 1
        self.flat[0], self.count[0] = self.end_id, 1  # word 0 ends a text

    def _forget(self) -> None:
        """Keep the words that came twice or more since the last time, half of the cache at most."""
        often = self.uses[: self.n]
        least = max(2, int(np.partition(often, -CACHE_WORDS // 2)[-CACHE_WORDS // 2]) + 1)
        kept = np.flatnonzero(often >= least)
        kept = kept[kept > 0]
        keys, count, first, flat = self.keys[kept], self.count[kept], self.first[kept], self.flat
        ids = flat[np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)]
        self._reset()
        self._add(keys, ids, count)

    def _add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Remember words (distinct and new) by their hashes."""
        n, n_ids = self.n + len(keys), self.n_ids + len(ids)
        for name, need in (("first", n), ("count", n), ("uses", n), ("keys", n), ("flat", n_ids)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.keys[self.n : n] = keys
        self.first[self.n : n] = self.n_ids + np.cumsum(count) - count
        self.count[self.n : n] = count
        self.flat[self.n_ids : n_ids] = ids
        new, self.n, self.n_ids = np.arange(self.n, n), n, n_ids
        if 2 * n > len(self.slots):
            self.slots, new = np.zeros(4 * len(self.slots), np.int32), np.arange(1, n)
        last = np.uint64(len(self.slots) - 1)
        at = (self.keys[new] & last).astype(np.int64)
        while len(new):
            free = self.slots[at] == 0
            self.slots[at[free]] = new[free]
            lost = self.slots[at] != new  # taken before, or by another of these
            new, at = new[lost], (at[lost] + 1) & int(last)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Which word each hash is; -1 for new ones."""
        last = len(self.slots) - 1
        at = (keys & np.uint64(last)).astype(np.int64)
        out = self.slots[at].astype(np.int64)
        wrong = np.flatnonzero((out > 0) & (self.keys[out] != keys))
        out[out == 0] = -1
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & last
            word = self.slots[at[wrong]]
            out[wrong] = np.where(word > 0, word, -1)
            wrong = wrong[(word > 0) & (self.keys[word] != keys[wrong])]
        return out

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, unit by unit, and how many each has."""
        model, ids, counts = self.tk.model, [], []
        for word in words:
            before = len(ids)
            for unit in (word,) if word.isascii() and word.isalpha() else _UNIT.findall(word):
                spelled = unit if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTES)
                ids += [t.id for t in model.tokenize(spelled)]
            counts.append(len(ids) - before)
        return np.array(ids, dtype=np.uint32), np.array(counts, dtype=np.int64)

    def _plain(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts in lower case, end to end, and how many each has; every text ends with the end id."""
        buffer = b" ".join(raws)
        keys, begin, end = hashed_words(buffer)
        if self.n > CACHE_WORDS:
            self._forget()
        at = self._places(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            own, where = np.unique(keys[new], return_index=True)
            where = new[where]
            self._add(own, *self._learn([buffer[a:b].decode() for a, b in zip(begin[where].tolist(), end[where].tolist())]))
            at[new] = self._places(keys[new])
        stops = np.cumsum([len(x) + 1 for x in raws])
        words = np.searchsorted(begin, stops)  # words up to each text's end
        at = np.insert(at, words, 0)
        self.uses[: self.n] += np.bincount(at, minlength=self.n)
        count = self.count[at]
        ends = np.cumsum(count)
        place = np.arange(int(ends[-1])) + np.repeat(self.first[at] - (ends - count), count)
        return self.flat[place], np.diff(ends[words + np.arange(len(words))], prepend=0)

    def _pieces(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long text, a part at a time; parts end at white space."""
        parts, a = [], 0
        while a < len(raw):
            gap = _GAP.search(raw, a + CHUNK_BYTES)
            b = gap.start() if gap else len(raw)
            parts.append(self._plain([raw[a:b]])[0][:-1])
            a = b
        ids = np.concatenate([*parts, [np.uint32(self.end_id)]]).astype(np.uint32)
        return ids, np.array([len(ids)])

    def encode(self, texts: list[str | None]):
        """Yields (first text, ids of some texts in turn, ids of each text); each text ends with the end id."""
        held: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            odd = is_odd(raw)
            if held and (odd or size + len(raw) > CHUNK_BYTES):
                yield i - len(held), *self._plain(held)
                held, size = [], 0
            if odd:
                ids = self.tk.encode(text, add_special_tokens=False).ids
                yield i, np.array([*ids, self.end_id], dtype=np.uint32), np.array([len(ids) + 1])
                continue
            raw = raw.lower() if raw.isascii() else text.lower().replace("\xa0", " ").encode()
            if len(raw) > 2 * CHUNK_BYTES:
                yield i, *self._pieces(raw)
            else:
                held.append(raw)
                size += len(raw) + 1
        if held:
            yield len(texts) - len(held), *self._plain(held)
