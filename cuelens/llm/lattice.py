"""Unigram subword lattice: the probability of a word over all its segmentations into pieces.

Pieces and their first weights come from an existing vocabulary; every single byte is a piece too,
so each word has a segmentation. A word is written with a space before it, and no piece holds a
space elsewhere, so the segmentations of a text are those of its words apart. Words are handled as
byte matrices: from each start the pieces' trie is walked for all words at once, and the forward
recursion adds in log space.

Defined cases: an empty word is the space before it; words of any length and any bytes have a probability above 0;
words may repeat; no words give no numbers.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WIDE = (8, 16, 32, 64)
CHUNK = 1 << 15


class Pieces:
    """The byte strings of a vocabulary that can occur in lower-cased words, their trie and first weights."""

    def __init__(self, pieces: dict[bytes, float]):
        for b in range(256):
            pieces.setdefault(bytes([b]), min(pieces.values(), default=1.0))
        self.names = sorted(pieces)
        self.weight = np.array([pieces[x] for x in self.names])
        self.longest = max(map(len, self.names))
        self.ids = {x: i for i, x in enumerate(self.names)}
        nodes: dict[bytes, int] = {b"": 0}
        for x in self.names:
            for n in range(1, len(x) + 1):
                nodes.setdefault(x[:n], len(nodes))
        self.step = np.full((len(nodes), 256), -1, np.int32)
        self.piece = np.full(len(nodes), -1, np.int32)
        for x, k in nodes.items():
            if x:
                self.step[nodes[x[:-1]], x[-1]] = k
        for x, i in self.ids.items():
            self.piece[nodes[x]] = i


@cache
def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece file; its scores order the pieces, and the weight of the r-th is 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: list[tuple[float, bytes]] = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        x = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in x[1:] and not any(65 <= b <= 90 or 9 <= b <= 13 for b in x):
            scored.append((-model.get_score(i), x))
    return Pieces({x: 1 / (r + 10) for r, (_, x) in enumerate(sorted(scored))})


def _matrix(words: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) + 1 for w in words])
    raw = np.frombuffer(b"".join([(b" " + w).ljust(wide, b"\0") for w in words]), np.uint8)
    return raw.reshape(-1, wide), size


def _groups(words: list[bytes]):
    size = np.array([len(w) + 1 for w in words])
    lo = 0
    for wide in WIDE:
        rows = np.flatnonzero((size > lo) & (size <= wide))
        for k in range(0, len(rows), CHUNK):
            part = rows[k : k + CHUNK]
            yield wide, part, [words[i] for i in part]
        lo = wide
    for i in np.flatnonzero(size > WIDE[-1]):
        yield 0, np.array([i]), [words[i]]


class Lattice:
    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        """log_p: natural logarithm of each piece's probability."""
        self.pieces, self.log_p = pieces, log_p

    def _forward(self, raw: np.ndarray, size: np.ndarray, arcs: list | None) -> np.ndarray:
        t, log_p = self.pieces, self.log_p
        n, wide = raw.shape
        alpha = np.full((n, wide + 1), -np.inf)
        alpha[:, 0] = 0
        for s in range(wide):
            rows = np.flatnonzero(size > s)
            node = np.zeros(len(rows), np.int32)
            for e in range(s + 1, min(wide, s + t.longest) + 1):
                node = t.step[node, raw[rows, e - 1]]
                go = (node >= 0) & (size[rows] >= e)
                rows, node = rows[go], node[go]
                if not len(rows):
                    break
                piece = t.piece[node]
                hit = piece >= 0
                w, i = rows[hit], piece[hit]
                if len(w):
                    alpha[w, e] = np.logaddexp(alpha[w, e], alpha[w, s] + log_p[i])
                    if arcs is not None:
                        arcs.append((s, e, w, i))
        return alpha

    def _long(self, word: bytes, expect: np.ndarray | None = None, count: float = 0.0) -> float:
        t, log_p, x = self.pieces, self.log_p, b" " + word
        n = len(x)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        arcs = []
        for s in range(n):
            node = 0
            for e in range(s + 1, min(n, s + t.longest) + 1):
                node = t.step[node, x[e - 1]]
                if node < 0:
                    break
                if (i := t.piece[node]) >= 0:
                    alpha[e] = np.logaddexp(alpha[e], alpha[s] + log_p[i])
                    if expect is not None:
                        arcs.append((s, e, i))
        if expect is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0
            for s, e, i in reversed(arcs):
                beta[s] = np.logaddexp(beta[s], log_p[i] + beta[e])
            for s, e, i in arcs:
                expect[i] += count * np.exp(alpha[s] + log_p[i] + beta[e] - alpha[n])
        return float(alpha[n])

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability, all segmentations together."""
        out = np.zeros(len(words))
        for wide, rows, part in _groups(words):
            if not wide:
                out[rows] = self._long(part[0])
                continue
            raw, size = _matrix(part, wide)
            out[rows] = self._forward(raw, size, None)[np.arange(len(part)), size]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in ``counts`` of each word, in expectation (forward and backward)."""
        out = np.zeros(len(self.log_p))
        for wide, rows, part in _groups(words):
            if not wide:
                self._long(part[0], out, float(counts[rows[0]]))
                continue
            raw, size = _matrix(part, wide)
            arcs: list = []
            alpha = self._forward(raw, size, arcs)
            n = np.arange(len(part))
            total, c = alpha[n, size], counts[rows]
            beta = np.full(alpha.shape, -np.inf)
            beta[n, size] = 0
            for s, e, w, i in reversed(arcs):
                tail = self.log_p[i] + beta[w, e]
                beta[w, s] = np.logaddexp(beta[w, s], tail)
                np.add.at(out, i, c[w] * np.exp(alpha[w, s] + tail - total[w]))
        return out
