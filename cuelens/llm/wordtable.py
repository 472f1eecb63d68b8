"""Words of whole Arrow batches as token ids: found in the bytes, looked up by hash, learned once a task's process.

No text and no known word becomes a Python object. Words are spans of the UTF-8 bytes; a span's 64-bit hash leads
to its ids in an open table; spans that are new are handed to ``learn`` and kept. Two words are taken for one if
their hashes agree, which for words of one length up to eight bytes can't happen; a table of a million words
gives a new word another's ids with a chance below 1e-13.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from cuelens.llm.textkit import Texts, hash_spans

#: Words that a process keeps; beyond them it starts anew.
MEMORY_WORDS = 1 << 19
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4


@cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            shift = 0x800 if m.start() >= 0xD800 else 0
            out[m.start() + shift : m.end() + shift] = kind
    return out


def byte_classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the code point that each byte of valid UTF-8 belongs to, and which bytes begin one."""
    table = classes()
    out = table[:256][buf]
    lead = np.ones(len(buf), bool)
    if not len(buf) or buf.max() < 0x80:
        return out, lead
    lead = (buf & 0xC0) != 0x80
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((buf >= low) & (buf < high))
        at = at[at + size <= len(buf)]
        point = buf[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            point = point << 6 | (buf[at + k] & 0x3F)
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(size):
            out[at + k] = kind
    return out, lead


def _contract(buf: np.ndarray, kind: np.ndarray, edge: np.ndarray, begins: np.ndarray) -> None:
    """``'s 't 'm 'd 're 've 'll`` are words where a word begins at their apostrophe; letters behind them begin another."""
    n = len(buf)
    mark = np.flatnonzero((buf == 0x27) & begins[:n])
    mark = mark[mark + 1 < n]
    mark = mark[begins[mark + 1] & ~edge[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        padded = np.concatenate([buf, np.zeros(4, np.uint8)])
        one = np.isin(padded[mark + 1], np.frombuffer(b"stmd", np.uint8))
        two = ((padded[mark + 1] == ord("r")) | (padded[mark + 1] == ord("v"))) & (padded[mark + 2] == ord("e")) | (padded[mark + 1] == ord("l")) & (padded[mark + 2] == ord("l"))
        two &= ~one & ~edge[np.minimum(mark + 2, n)]
        begins[mark[one | two] + 1] = False
        begins[mark[one] + 2] = True
        begins[mark[two] + 3] = True


def split_spaced(texts: Texts, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of byte-level BPE, and the first word of each text.

    The words are the matches, in order, of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!\\S)|S+`` for letters L,
    numbers N, white space S and other characters O. Nothing is left out, so a word ends where the next starts.
    Each occurrence of ``special`` is a word, and no word goes over its ends.
    """
    buf, off = texts.buf, texts.off
    n = len(buf)
    kind, lead = byte_classes(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    inside = []
    if special and n:
        raw, at = buf.tobytes(), -1
        while (at := raw.find(special, at + 1)) >= 0:
            if not edge[at + 1 : at + len(special)].any():
                edge[[at, at + len(special)]] = True
                inside.append(at)
                at += len(special) - 1
    begins = edge.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    # the last white space before another character is a word of its own, or, if it is a blank, belongs to that word
    after = np.flatnonzero(begins[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    before = after - 1
    for _ in range(3):
        before -= ~lead[before]
    begins[before] = True
    begins[after[buf[before] == 0x20]] = False
    _contract(buf, kind, edge, begins)
    for at in inside:
        begins[at + 1 : at + len(special)] = False
    start = np.flatnonzero(begins[:n])
    return start, np.searchsorted(start, off)


def split_plain(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the matches, in order, of ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|O+``, and the first of each text; white space is left out."""
    buf, off = texts.buf, texts.off
    n = len(buf)
    kind, lead = byte_classes(buf)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = edge.copy()
    begins[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) & lead[1:]
    _contract(buf, kind, edge, begins)
    start = np.flatnonzero(begins[:n])
    end = np.append(start, n)[1:]
    some = kind[start] != SPACE
    start, end = start[some], end[some]
    return start, end, np.searchsorted(start, off)


class WordTable:
    """Ids of words by hash. ``learn`` takes words as bytes and gives their numbers of ids and all ids in order."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MEMORY_WORDS):
        self.learn, self.most = learn, most
        self._forget()

    def _forget(self) -> None:
        self.bits = 16
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.n, self.used = 0, 0
        self.known, self.at, self.count, self.pool = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is not known."""
        at = self._slot(key)
        out = self.values[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != key))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != key[open_])]
        return out

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        at = self._slot(key)
        while len(key):
            free = self.values[at] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def _keep(self, key: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(key), self.used + len(ids)
        grow = lambda a, size: np.concatenate([a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)]) if size > len(a) else a
        self.known, self.at, self.count, self.pool = grow(self.known, n), grow(self.at, n), grow(self.count, n), grow(self.pool, used)
        new = slice(self.n, n)
        self.known[new], self.count[new] = key, count
        self.at[new] = self.used + np.cumsum(count) - count
        self.pool[self.used : used] = ids
        numbers = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        if 2 * n > len(self.keys):
            while 2 * n > 1 << self.bits:
                self.bits += 2
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            key, numbers = self.known[:n], np.arange(n, dtype=np.int32)
        self._put(key, numbers)

    def encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words in order."""
        if self.n > self.most:
            self._forget()
        key = hash_spans(buf, start, end)
        number = self.find(key)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, first = np.unique(key[missing], return_index=True)
            raw = buf.tobytes()
            spans = missing[first]
            self._keep(fresh, *self.learn([raw[a:b] for a, b in zip(start[spans].tolist(), end[spans].tolist(), strict=True)]))
            number[missing] = self.find(key[missing])
        count = self.count[number].astype(np.int64)
        stop = np.cumsum(count)
        return count, self.pool[np.repeat(self.at[number] - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)]


def joined(library, vocabulary_starts: np.ndarray, words: list[bytes], size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words by the ``tokenizers`` library.

    Words of a blank and letters are encoded as one text, in which each of them is a word again and begins with
    one of ``vocabulary_starts``; all others one by one.
    """
    order = np.arange(len(words))
    text = [w.decode() for w in words]
    simple = np.array([len(w) > 1 and w[0] == " " and w[1:].isalpha() for w in text], bool)
    counts, ids = [], []
    for k in range(0, int(simple.sum()), size):
        part = [text[i] for i in order[simple][k : k + size]]
        got = np.array(library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        first = np.flatnonzero(vocabulary_starts[got])
        if len(first) != len(part):
            raise ValueError("the tokenizer splits words in another way than its pattern says")
        counts.append(np.diff([*first, len(got)])), ids.append(got)
    rest = [text[i] for i in order[~simple]]
    for k in range(0, len(rest), size):
        for got in library.encode_batch_fast(rest[k : k + size], add_special_tokens=False):
            counts.append(np.array([len(got.ids)])), ids.append(np.array(got.ids, np.uint32))
    count, flat = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*ids, np.zeros(0, np.uint32)])
    back = np.empty(len(words), np.int64)
    back[np.concatenate([order[simple], order[~simple]])] = order
    stop = np.cumsum(count)
    own = count[back]
    ends = np.cumsum(own)
    return own, flat[np.repeat((stop - count)[back] - (ends - own), own) + np.arange(len(flat))]
