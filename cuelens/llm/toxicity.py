"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is logistic in hashed features, its words and their first four and five bytes; a document's is the
noisy-or of its sentences'. Weights are trained from document labels on a bounded sample
(``PER_CLASS`` rows of each label, one of each id, weighted back to their shares); the sentence scores then
locate what offends.

Defined cases: null, empty and wordless texts score as a document without sentences (0);
a null label teaches nothing, of several labels of a document the largest holds; a null doc_id counts
as held out; with no labelled rows every score is 0; rows that repeat score alike, and of several texts with one id
that with the smallest hash teaches; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cuelens.llm.rows import bucket_of_id, sample_fraction
from cuelens.llm.session import store, worker_imports
from cuelens.llm.textkit import Texts, hash_spans, slices

#: The most labelled rows of each label that are learned from, about.
PER_CLASS = 6000
BUCKETS = 1 << 18
#: A feature has a weight if its documents' labels are so much likelier (in nats) given it: chance alone reaches 12 once in a million.
LEAST_GAIN = 12.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


_OFFENDING = ArrayType(StructType().add("start", "long").add("end", "long").add("score", "double"))


class Sentences:
    """Feature buckets of all sentences that have a word, in order; sentences end at . ! ? and line feeds."""

    def __init__(self, array: pa.Array):
        texts = Texts(array)
        stops = np.concatenate([[0], np.cumsum(_STOP[texts.buf])])
        texts.buf = _LOWER[texts.buf]
        words = texts.words(_GAP)
        hashes, owner = words.hashes(5), words.owner()
        label = owner * (len(texts.buf) + 1) + stops[words.start]
        fresh = np.ones(len(label), bool)
        fresh[1:] = label[1:] != label[:-1]
        first = np.flatnonzero(fresh)
        self.n_docs, self.n = texts.n, len(first)
        sentence = np.cumsum(fresh) - 1
        kinds, places = [hashes], [sentence]
        for n in (4, 5):
            longer = np.flatnonzero(words.end - words.start > n)
            at = words.start[longer]
            kinds.append(hash_spans(texts.buf, at, at + n, n))
            places.append(sentence[longer])
        feature = np.concatenate(kinds) >> np.uint64(64 - 18)
        where = np.concatenate(places)
        order = np.argsort(where, kind="stable")
        self.feature, self.sentence = feature[order].astype(np.int32), where[order].astype(np.int32)
        self.owner = owner[first]
        edge = np.searchsorted(self.owner, np.arange(self.n_docs + 1))
        self.first = edge
        self.start = words.start[first] - texts.off[self.owner]
        last = np.append(first[1:], len(label)) - 1
        self.end = words.end[last] - texts.off[self.owner]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, s: Sentences) -> np.ndarray:
        z = np.bincount(s.sentence, self.weights[s.feature], s.n) if s.n else np.zeros(0)
        return _sigmoid(z + self.bias)

    def documents(self, s: Sentences, p: np.ndarray) -> np.ndarray:
        none = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
        return np.clip(-np.expm1(none[s.first[1:]] - none[s.first[:-1]]), 0.0, 1.0)


def select(often: np.ndarray, bad: np.ndarray, docs: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose documents prefer a label beyond chance, and their first weights, from document counts."""
    share = toxic / docs
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(bad * np.log(bad / (often * share))) + np.nan_to_num((often - bad) * np.log((often - bad) / (often * (1 - share))))
    odds = (bad + 0.5) / (toxic + 1) / ((often - bad + 0.5) / (docs - toxic + 1))
    names = np.flatnonzero(gain >= LEAST_GAIN)
    return names, np.clip(np.log(odds[names]), -6, 6)


def train(names: np.ndarray, first: np.ndarray, feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 120) -> Model:
    """Adam on the weighted likelihood of the noisy-or, with a slight L1 shrink, from the first weights of the features ``names``."""
    n, docs = len(owner), len(label)
    f, s = np.searchsorted(names, feature), sentence
    per_doc = max(1.0, n / docs)
    prior = np.average(label, weights=weight)
    bias, w = float(np.log(0.1 * prior / per_doc)), first.copy()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = weight / weight.sum()
    least = 0.3 * weight[label > 0].mean()
    for t in range(1, rounds + 1):
        p = _sigmoid(np.bincount(s, w[f], n) + bias)
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), docs)
        p_doc = -np.expm1(none)
        pull = np.where(label > 0, np.exp(none) / np.maximum(p_doc, 1e-9), -1.0) * weight
        g = -pull[owner] * p
        gw, gb = np.bincount(f, g[s], len(w)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.3 if t < rounds * 0.6 else 0.1
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + least)
        w -= step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * least, 0)
        bias -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + least)
    full = np.zeros(BUCKETS)
    full[names] = w
    return Model(full, bias)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        s = Sentences(batch.column("text"))
        label = batch.column("label").to_numpy()
        seen = np.unique(s.feature.astype(np.int64) * s.n_docs + s.owner[s.sentence])
        of, doc = seen // s.n_docs, seen % s.n_docs
        often = np.bincount(of, minlength=BUCKETS)
        bad = np.bincount(of, label[doc], BUCKETS).astype(np.int64)
        at = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(often[at]), pa.array(bad[at])], ["feature", "often", "bad"])


def _chosen(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(BUCKETS, bool)
        keep[names.value] = True
        for batch in slices(batches, "text", 4 << 20):
            s = Sentences(batch.column("text"))
            mine = keep[s.feature]
            feature, sentence = s.feature[mine], s.sentence[mine]
            edge = np.searchsorted(sentence, s.first)
            rows = [(feature[a:b].tobytes(), (sentence[a:b] - k).astype("<i4").tobytes()) for a, b, k in zip(edge[:-1], edge[1:], s.first[:-1], strict=True)]
            columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns, pa.array(np.diff(s.first), pa.int32())], ["label", "feature", "sentence", "n"])

    return run


def fit(docs: DataFrame, marks: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from documents (doc_id, text) and their marks (doc_id, label 0 or 1, an id once).

    The marks are sampled before their texts are looked up, so their broadcast is bounded by
    ``per_class`` and no text is shuffled. The driver gets two counts a bucket, and the chosen features
    of the sampled rows.
    """
    spark = docs.sparkSession
    worker_imports(spark)
    known = marks.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(BUCKETS), -40.0 if 1 not in sizes else 40.0)
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    chosen = sample_fraction(known, F.when(F.col("label") == 1, share[1]).otherwise(share[0]), salt=5)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label")
    picked = store(picked, "toxicity-sample")
    drawn = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    found = picked.mapInArrow(_counts, "feature int, often long, bad long").groupBy("feature").agg(F.sum("often").alias("often"), F.sum("bad").alias("bad")).toArrow()
    often, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    often[found["feature"].to_numpy()], bad[found["feature"].to_numpy()] = found["often"].to_numpy(), found["bad"].to_numpy()
    if len(drawn) < 2:
        return Model(np.zeros(BUCKETS), -40.0 if 1 not in drawn else 40.0)
    names, first = select(often, bad, sum(drawn.values()), drawn[1])
    got = picked.mapInArrow(_chosen(spark.sparkContext.broadcast(names)), "label int, feature binary, sentence binary, n int").toArrow()
    got = got.sort_by([("label", "ascending"), ("n", "ascending"), ("feature", "ascending"), ("sentence", "ascending")])  # the same model however the rows arrive
    n, label = got["n"].to_numpy().astype(np.int64), got["label"].to_numpy()
    base = np.concatenate([[0], np.cumsum(n)])
    feature = [np.frombuffer(x.as_buffer(), "<i4") for x in got["feature"]]
    sentence = [np.frombuffer(x.as_buffer(), "<i4") + base[i] for i, x in enumerate(got["sentence"])]
    weight = np.array([1 / share[int(x)] for x in label])
    none = [np.zeros(0, np.int64)]
    return train(names, first, np.concatenate(feature or none), np.concatenate(sentence or none), np.repeat(np.arange(len(n)), n), label, weight)


def _scored(model, keep: list[str], most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_tox_text", 4 << 20):
            s = Sentences(batch.column("_tox_text"))
            p = model.value.sentences(s)
            spans: list[list[dict]] = [[] for _ in range(s.n_docs)]
            for i in np.flatnonzero(p >= most):
                spans[s.owner[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "score": float(p[i])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.value.documents(s, p)), pa.array(spans, kind)], [*keep, "score", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], most: float = 0.5) -> DataFrame:
    """``keep`` and score, offending: the byte spans of sentences that alone reach ``most``, with their scores.

    Columns of ``keep`` with these two names are replaced.
    """
    worker_imports(docs.sparkSession)
    keep = [c for c in keep if c not in ("score", "offending")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("offending", _OFFENDING)
    return docs.select(*keep, F.col("text").alias("_tox_text")).mapInArrow(_scored(shared, keep, most), schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending; learned from labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = fit(rows, marks.where(bucket_of_id(F.col("doc_id"), 5) != 0), per_class)
    return score_toxicity(rows, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )
