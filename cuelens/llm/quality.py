"""Quality rules: gradient-boosted trees over document statistics.

The statistics are counted in numpy for whole batches. The trees are fitted on the driver to the
statistics of a bounded sample of labelled rows (``SAMPLE``), flattened into node arrays, broadcast
and walked level by level for a whole batch. On the features in ``FALLING`` the score can only fall
as the feature rises: a split that would break this is not taken, and the children's values are
bounded by the split's midpoint.

Defined cases: a null or empty text has no words and fails the base rule; a null label teaches
nothing, of several labels of a document the largest holds; with no labelled rows of both kinds the
verdict is the base rule's; rows that repeat are judged alike, and of several texts with one id that with the
smallest hash teaches; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.rows import sample_fraction
from cuelens.llm.session import worker_imports
from cuelens.llm.textkit import Texts, hash_spans, mix, slices, windows

#: The most labelled rows that are learned from, about.
SAMPLE = 40_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share", "log_lines", "long_bar_share"]
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "upper_share"]

_IS = {c: np.zeros(256, bool) for c in ("symbol", "upper", "digit", "stop", "bar")}
for _name, _bytes in (("symbol", b"#*$%&|<>"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("stop", b".!?,;:"), ("bar", b"|")):
    _IS[_name][list(_bytes)] = True


def _repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another of the same document, and which equal an earlier one."""
    own = mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    some, later = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = some[order[:-1][same]] = True
    return some, later


def statistics(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The columns of COUNTS as integers and of FEATURES as floats, one row a text."""
    texts = Texts(array)
    words = texts.words()
    buf, n = texts.buf, words.count
    owner, hashes = words.owner(), words.hashes(9)
    cover = np.zeros(len(buf) + 1, np.int8)
    cover[words.start] += 1
    np.add.at(cover, words.end, -1)
    lead = (buf & 0xC0) != 0x80
    chars = texts.per_text(lead & (np.cumsum(cover[:-1], dtype=np.int32) > 0))
    symbols = texts.per_text(_IS["symbol"][buf])

    feed = np.append(np.flatnonzero(buf == 0x0A), len(buf))
    begin = np.unique(np.concatenate([feed + 1, texts.off[:-1]]))
    begin = begin[begin < len(buf)]
    line_doc = np.searchsorted(texts.off, begin, "right") - 1
    end = np.minimum(feed[np.searchsorted(feed, begin)], texts.off[line_doc + 1])
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, line_doc = begin[worded], end[worded], line_doc[worded]
    dup = _repeated(hash_spans(buf, begin, end, 10), line_doc)[1]
    lines, dups = (np.bincount(x, minlength=texts.n) for x in (line_doc, line_doc[dup]))

    grams, at = windows(words, hashes, 3)
    again = at[_repeated(grams, owner[at])[0]]
    covered = np.zeros(len(hashes) + 1, bool)
    for k in range(3):
        covered[again + k] = True
    repeats = np.bincount(owner[covered[:-1]], minlength=texts.n)

    letters = np.maximum(chars, 1)
    counts = np.stack([n, chars, symbols, dups, repeats], 1).astype(np.int64)
    some = np.maximum(n, 1)
    feats = [
        np.log1p(n), chars / some, symbols / letters, dups / np.maximum(lines, 1), repeats / some,
        *(texts.per_text(_IS[c][buf]) / letters for c in ("upper", "digit", "stop")), np.log1p(lines), texts.per_text(_IS["bar"][buf]) / some,
    ]
    return counts, np.stack(feats, 1).astype(np.float64)


class Trees:
    """Node arrays of all trees in one: a leaf points at itself."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def node(self) -> int:
        k = len(self.value)
        for column, x in ((self.feature, 0), (self.cut, np.inf), (self.left, k), (self.right, k), (self.value, 0.0)):
            column.append(x)
        return k

    def flat(self) -> Trees:
        for name in ("feature", "cut", "left", "right", "value"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 2.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss on binned features; signs: -1 where the score may only fall, 1 rise, 0 free."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(float(np.log(mean / (1 - mean))), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    wide = max(len(c) for c in cuts) + 1
    margin = np.full(len(x), trees.base)

    def value(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def grow(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, left_depth: int) -> None:
        total = np.array([g[rows].sum(), h[rows].sum()])
        trees.value[k] = value(*total, lo, hi) * rate
        margin_rows[rows] = trees.value[k]
        if not left_depth or len(rows) < 2 * least:
            return
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f, c in enumerate(cuts):
            gs, hs, ns = (np.cumsum(np.bincount(coded[rows, f], w, wide))[: len(c)] for w in (g[rows], h[rows], np.ones(len(rows))))
            if not len(c):
                continue
            wl, wr = -gs / (hs + ridge), -(total[0] - gs) / (total[1] - hs + ridge)
            gain = gs**2 / (hs + ridge) + (total[0] - gs) ** 2 / (total[1] - hs + ridge) - total[0] ** 2 / (total[1] + ridge)
            bad = (ns < least) | (len(rows) - ns < least) | (signs[f] * (wr - wl) < 0)
            gain[bad] = -1
            if gain[i := int(gain.argmax())] > best[0]:
                best = (float(gain[i]), f, i, float(np.clip(wl[i], lo, hi)), float(np.clip(wr[i], lo, hi)))
        if best[1] < 0:
            return
        _, f, i, wl, wr = best
        under = coded[rows, f] <= i
        mid = (wl + wr) / 2
        trees.feature[k], trees.cut[k] = f, float(cuts[f][i])
        trees.left[k], trees.right[k] = trees.node(), trees.node()
        bounds = {-1: ((mid, hi), (lo, mid)), 1: ((lo, mid), (mid, hi)), 0: ((lo, hi), (lo, hi))}[signs[f]]
        for child, part, (a, b) in ((trees.left[k], rows[under], bounds[0]), (trees.right[k], rows[~under], bounds[1])):
            grow(child, part, g, h, a, b, left_depth - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        margin_rows = np.zeros(len(x))
        trees.roots.append(root := trees.node())
        grow(root, np.arange(len(x)), p - y, p * (1 - p), -np.inf, np.inf, depth)
        margin = margin + margin_rows
    return trees.flat()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        _, x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from documents (doc_id, text) and their marks (doc_id, label 0 or 1, an id once).

    The marks are sampled before their texts are looked up, so their broadcast is bounded by ``sample``
    and no text is shuffled; only the sampled rows' statistics reach the driver.
    """
    worker_imports(docs.sparkSession)
    known = marks.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    chosen = sample_fraction(known, F.lit(min(1.0, sample / max(1, known.count()))), salt=9)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = picked.mapInArrow(_features, "label int, x array<double>").toArrow()
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(got["x"].to_pylist())
    order = np.lexsort((y, *x.T))  # the same trees however the rows arrive
    return fit_trees(x[order], y[order], [-1 if f in FALLING else 0 for f in FEATURES])


def judge(docs: DataFrame, model: Trees | None, keep: list[str], least: float = 0.5) -> DataFrame:
    """``keep`` and the base counts, base_failed, score, kept of every row; columns of ``keep`` with these names are replaced."""
    worker_imports(docs.sparkSession)
    keep = [c for c in keep if c not in (*COUNTS, "base_failed", "score", "kept")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_quality_text"):
            counts, x = statistics(batch.column("_quality_text"))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = np.where(failed, 0.0, 1.0) if shared.value is None else shared.value.score(x)
            columns = [*(batch.column(i) for i in range(len(keep))), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS, "base_failed", "score", "kept"])

    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    return docs.select(*keep, F.col("text").alias("_quality_text")).mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' score of every document."""
    rows = docs.select("doc_id", "text")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    return judge(rows, fit(rows, marks, sample), ["doc_id"])
