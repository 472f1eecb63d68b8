"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded sample of labelled rows (``PER_LANG`` of each language, chosen by hash),
summed in Spark; the log-probability matrix is broadcast and batches are scored sparsely in numpy.

Memory follows the languages: the matrix has ``BUCKETS`` times as many numbers, and a batch looks up ``GATHERED``
of them at once, whatever its texts' lengths.

Defined cases: null or letterless text is ``und`` with score 0; so is every text where no row is
labelled; a null doc_id counts as held out; rows that repeat are predicted alike; of languages with
equal probability the first by name wins; columns other than doc_id, text, lang are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.rows import bucket_of_id, sample_fraction
from cuelens.llm.session import worker_imports
from cuelens.llm.textkit import Texts, let_go, mix, slices

#: The most labelled rows of a language that are learned from, about.
PER_LANG = 4000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
UNKNOWN = "und"
#: Log-probabilities looked up at once.
GATHERED = 1 << 22


@cache
def _folded() -> np.ndarray:
    """Each code point's letter in lower case where that is simple, or a space for what is no letter."""
    table = np.full(sys.maxunicode + 1, 0x20, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: Texts) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and their n+1 offsets by text; which texts have a letter.

    Runs of other characters than letters count as one space; n-grams do not cross texts.
    """
    lead = (texts.buf & 0xC0) != 0x80
    off = np.concatenate([[0], np.cumsum(lead)])[texts.off]
    points = np.frombuffer(texts.buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    c = _folded()[points]
    letter = c != 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    has = np.diff(np.concatenate([[0], np.cumsum(letter)])[off]) > 0
    c, off = c[keep].astype(np.uint64), total[off]
    found, key = [], np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = (key[: len(c) - n + 1] if n > 1 else key) * np.uint64(0x100000001B3) + c[n - 1 :] if len(c) >= n else np.zeros(0, np.uint64)
        if n not in ORDERS:
            continue
        fits = np.ones(len(key), bool)
        for back in range(1, n):
            at = off[1:] - back
            fits[at[(at >= off[:-1]) & (at < len(key))]] = False
        bucket = (mix(key[fits] + np.uint64(n)) >> np.uint64(40)).astype(np.int64) % BUCKETS
        found.append((bucket, np.concatenate([[0], np.cumsum(fits)])[np.minimum(off, len(key))]))
    return found, has


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        langs = batch.column("lang").dictionary_encode()
        names, ids = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        total = np.zeros(len(names) * BUCKETS, np.int64)
        for bucket, off in grams(Texts(batch.column("text")))[0]:
            total += np.bincount(np.repeat(ids, np.diff(off)) * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names).take(pa.array(at // BUCKETS)), pa.array(at % BUCKETS, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"]
        )


class Model:
    """Languages in order of name, a (bucket, language) matrix of log-probabilities with the prior apart, and by language the buckets seen."""

    def __init__(self, langs: list[str], prior: np.ndarray, matrix: np.ndarray, seen: np.ndarray):
        self.langs, self.prior, self.matrix, self.seen = langs, prior, matrix, seen

    def predict(self, array: pa.Array, share_known: bool = False) -> tuple[list[str], np.ndarray, np.ndarray | None]:
        """Language and its probability among the learned ones; if asked, the share of the n-grams seen in that language."""
        texts = Texts(array)
        found, has = grams(texts)
        if not self.langs:
            return [UNKNOWN] * texts.n, np.zeros(texts.n), np.zeros(texts.n) if share_known else None
        total = np.tile(self.prior, (texts.n, 1))
        room = max(1, GATHERED // len(self.langs))
        for bucket, off in found:
            # a text ends a stretch of n-grams, and so does a look-up that is full
            cuts = np.union1d(off[:-1][np.diff(off) > 0], np.arange(0, len(bucket), room))
            owner = np.searchsorted(off, cuts, "right") - 1
            for lo in range(0, len(bucket), room):
                here = slice(*np.searchsorted(cuts, (lo, lo + room)))
                np.add.at(total, owner[here], np.add.reduceat(self.matrix[bucket[lo : lo + room]], cuts[here] - lo, axis=0, dtype=np.float64))
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        langs = [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return langs, np.where(has, share, 0.0), np.where(has, self._known(found, best), 0.0) if share_known else None

    def _known(self, found: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> np.ndarray:
        every, known = np.zeros(len(best)), np.zeros(len(best))
        for bucket, off in found:
            every += np.diff(off)
            # text by text: an index for all n-grams at once would be as large as the buckets
            known += [np.count_nonzero(self.seen[b][bucket[lo:hi]]) for b, lo, hi in zip(best, off[:-1], off[1:], strict=True)]
        return known / np.maximum(every, 1)


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from rows (text, lang); nulls in either teach nothing. What reaches the driver is bounded by languages times buckets."""
    worker_imports(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, BUCKETS), bool))
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    picked = sample_fraction(rows, share[F.col("lang")], salt=6)
    counts = picked.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((BUCKETS, len(langs)), SMOOTHING)
    at = [langs.index(x) for x in counts["lang"].dictionary_encode().combine_chunks().dictionary.to_pylist()] if counts.num_rows else []
    if counts.num_rows:
        ids = counts["lang"].dictionary_encode().combine_chunks().indices.to_numpy()
        matrix[counts["bucket"].to_numpy(), np.array(at)[ids]] += counts["n"].to_numpy()
    prior = np.array([sizes[x] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(0)).astype(np.float32), np.ascontiguousarray((matrix > SMOOTHING).T))


def identify(docs: DataFrame, model: Model, keep: list[str], share_known: bool = False, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and _lang_pred, _lang_score, if asked _lang_known, of its column ``text``.

    Columns of ``keep`` that have one of the three names are replaced.
    """
    keep = [c for c in keep if c not in ("_lang_pred", "_lang_score", "_lang_known")]
    worker_imports(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    own = text not in keep
    rows = docs.select(*keep, *([text] if own else []))
    at = rows.columns.index(text)

    # with other columns beside the text, and stages to follow in the same workers, smaller slices keep memory low
    room = (1 << 19) if share_known else (2 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, room):
            langs, *scores = shared.value.predict(batch.column(at), share_known)
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), *(pa.array(s) for s in scores if s is not None)], schema.names)
        let_go()

    schema = docs.select(*keep).schema.add("_lang_pred", "string").add("_lang_score", "double")
    if share_known:
        schema = schema.add("_lang_known", "double")
    return rows.mapInArrow(run, schema)


def language_digest(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang", (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out"))
    model = fit(rows.where("not held_out"), per_lang)
    return identify(rows, model, ["doc_id", "held_out"]).withColumnsRenamed({"_lang_pred": "lang_pred", "_lang_score": "score"})
