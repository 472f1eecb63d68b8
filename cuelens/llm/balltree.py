"""A ball tree over integer vectors: best inner products inside score windows, by branch and bound.

A node is a ball round the mean of its rows. For a query q, centre c and radius r every row x of the node has
``q.c - |q| r <= q.x <= q.c + |q| r``, so a node bounds its rows' scores above and below. All queries of a
batch go down the tree together; a query leaves a node that lies outside its window, or strictly beneath the
worst score it would still take (a tie may still win by its id).

Scores are exact: products run in doubles where no sum can reach 2**53, in 64-bit integers otherwise.
"""

from __future__ import annotations

import numpy as np

#: Rows of a leaf.
LEAF = 128
#: Components beyond this are clipped: inner products of up to 8,192 components then fit 64 bits.
MOST = 1 << 24
#: A score below all scores.
NONE = -(1 << 62)


def quantize(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in doubles, clipped to MOST."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST)


class Tree:
    """Rows in order of the leaves, and for each node its rows ``start:stop``, children, centre, radius and labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        n = len(ids)
        order = np.arange(n)
        self.start, self.stop, self.left, self.right, centre, radius = [], [], [], [], [], []
        todo = [(0, n, -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            here = len(self.start)
            if parent >= 0:
                (self.right if side else self.left)[parent] = here
            own = vectors[order[lo:hi]]
            middle = own.mean(0)
            off = np.sqrt(((own - middle) ** 2).sum(1))
            self.start.append(lo), self.stop.append(hi), self.left.append(-1), self.right.append(-1)
            centre.append(middle), radius.append(off.max())
            if hi - lo > LEAF:
                # the farthest row from the middle and the farthest from that one give the direction of the cut
                first = own[off.argmax()]
                far = own[((own - first) ** 2).sum(1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own @ (far - first), half)]
                todo += [(lo, lo + half, here, 0), (lo + half, hi, here, 1)]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.reach = np.sqrt((self.centre**2).sum(1)) + self.radius
        self.low = [self.labels[a:b].min() for a, b in zip(self.start, self.stop, strict=True)]
        self.high = [self.labels[a:b].max() for a, b in zip(self.start, self.stop, strict=True)]
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0


class Search:
    """The best ``k`` rows of each query's windows, over one or more trees.

    ``own_ids`` are never a query's result. ``same``: rows of the query's label, else rows of any other. Window j
    of query i takes scores from ``low[i, j]`` to ``high[i, j]``. Higher scores come first, ties by smaller id; an
    id that repeats counts once, with its best score.
    """

    def __init__(self, own_ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.own_ids, self.labels, self.vectors, self.k, self.same = own_ids, labels, vectors, k, same
        self.low, self.high = low, high
        self.norm = np.sqrt((vectors**2).sum(1))
        self.worst, self.worst_id = np.full(low.shape, NONE), np.full(low.shape, np.iinfo(np.int64).max)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.visited = 0

    def run(self, tree: Tree) -> None:
        if self.vectors.shape[1] != tree.vectors.shape[1] or not len(self.vectors):
            return
        largest = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        exact = largest * tree.largest * self.vectors.shape[1] < 1 << 53
        rows, queries = (tree.vectors, self.vectors) if exact else (tree.vectors.astype(np.int64), self.vectors.astype(np.int64))
        todo = [(0, np.arange(len(self.vectors)))]
        while todo:
            node, who = todo.pop()
            who = who[self._open(tree, node, who)]
            if not len(who):
                continue
            self.visited += 1
            if tree.left[node] < 0:
                self._leaf(tree, node, who, (queries[who] @ rows[tree.start[node] : tree.stop[node]].T).astype(np.int64))
                continue
            pair = sorted((tree.left[node], tree.right[node]), key=lambda c: float((self.vectors[who] @ tree.centre[c]).mean()))
            todo += [(c, who) for c in pair]  # the better one is taken first

    def _open(self, tree: Tree, node: int, who: np.ndarray) -> np.ndarray:
        middle = self.vectors[who] @ tree.centre[node]
        span = self.norm[who] * tree.radius[node]
        slack = 1e-9 * self.norm[who] * tree.reach[node] + 1e-6  # for rounding
        above, below = (middle + span + slack)[:, None], (middle - span - slack)[:, None]
        open_ = ((above >= np.maximum(self.low[who], self.worst[who])) & (below <= self.high[who])).any(1)
        own = self.labels[who]
        return open_ & ((own >= tree.low[node]) & (own <= tree.high[node]) if self.same else (own != tree.low[node]) | (own != tree.high[node]))

    def _leaf(self, tree: Tree, node: int, who: np.ndarray, scores: np.ndarray) -> None:
        at = slice(tree.start[node], tree.stop[node])
        may = (self.labels[who][:, None] == tree.labels[at]) == self.same
        may &= self.own_ids[who][:, None] != tree.ids[at]
        windows = self.low.shape[1]
        found = []
        for j in range(windows):
            worst = self.worst[who, j][:, None]
            better = (scores > worst) | (scores == worst) & (tree.ids[at] < self.worst_id[who, j][:, None])
            q, r = np.nonzero(may & better & (scores >= self.low[who, j][:, None]) & (scores <= self.high[who, j][:, None]))
            if len(q):
                found.append((who[q] * windows + j, scores[q, r], tree.ids[at][r]))
        if found:
            self._take(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.zeros(self.low.size, bool)
        touched[query] = True
        old = touched[self.query]
        q, s, i = (np.concatenate([a[old], b]) for a, b in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((-s, i, q))
        q, s, i = q[order], s[order], i[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, s, i = q[once], s[once], i[once]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.worst.reshape(-1)[q[last]], self.worst_id.reshape(-1)[q[last]] = s[last], i[last]
        best = place < self.k
        self.query, self.score, self.id = (np.concatenate([a[~old], b[best]]) for a, b in ((self.query, q), (self.score, s), (self.id, i)))
