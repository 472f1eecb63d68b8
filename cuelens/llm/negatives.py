"""Hard-negative mining: for each anchor and positive, the best rows of other labels inside a window of scores.

Every task of a scan grows ball trees over its rows, of a bounded number of bytes each; no vector is shuffled for
that. Anchors, a stated query set, are sent to each tree: a task holds one tree and lets the anchors pass in batches,
so neither grows with the table. Trees give their best rows; a window over each anchor takes the best of all trees.

Two searches run over the same trees: the positives of each anchor, then for each positive its negatives.

Defined cases: rows with a null id, null label, null vector or a component that is null or not finite take no part;
vectors of another length than the anchor's have no score; a row with an anchor's id is not another row; where rows
repeat an id, it counts once for an anchor, with its best score that qualifies, and as an anchor it stands for its
smallest (label, vector); components beyond 2**24 after scaling are clipped to it; ties go to the smaller id; an
anchor without positives and a positive without negatives have no rows; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelens.llm.balltree import NONE, Search, Tree, quantize
from cuelens.llm.session import grown, store, worker_imports

#: Bytes of vectors, as they are stored, under one tree: from the first up to the second as the table grows.
TREE_BYTES, MOST_TREE_BYTES = 4 << 20, 64 << 20
#: Anchors that go down a tree together.
BATCH = 1024
_TREE = "part int, nth int, ids binary, labels binary, dims int, vectors binary"
_PASSING = "tree long, kind int, anchor_id long, label long, embedding array<double>, positives array<struct<score:long,id:long>>, ids binary, labels binary, dims int, vectors binary"
_FOUND = "anchor_id long, nth int, score long, id long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, as long, long and array<double>."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    off = column.offsets.to_numpy().astype(np.int64)
    return off - off[0], column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


def _matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vector, and their quantized vectors."""
    off, flat = _lists(batch.column("embedding"))
    size = np.diff(off)
    for dims in np.unique(size).tolist():
        at = np.flatnonzero(size == dims)
        yield at, quantize(flat[off[at][:, None] + np.arange(dims)].reshape(len(at), dims), scale)


def grow_trees(rows: DataFrame, scale: float) -> DataFrame:
    """Rows of ``usable`` dealt to trees where they are read, one row a tree; the tree itself grows where it is searched."""
    most = grown(rows, TREE_BYTES, MOST_TREE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal nth
            for dims, parts in held.items():
                ids, labels, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
                cells = [part, nth, ids.tobytes(), labels.tobytes(), dims, vectors.tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["part", "nth", "ids", "labels", "dims", "vectors"])
                nth += 1
            held.clear()

        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for at, vectors in _matrices(batch, scale):
                width = 4 * max(1, vectors.shape[1])
                while len(at):
                    room = max(1, (most - size) // width)
                    held.setdefault(vectors.shape[1], []).append((ids[at[:room]], labels[at[:room]], vectors[:room].astype(np.int32)))
                    size += width * min(room, len(at))
                    at, vectors = at[room:], vectors[room:]
                    if size >= most:
                        yield from cut()
                        size = 0
        yield from cut()

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, _TREE)


def _numbered(trees: DataFrame) -> tuple[DataFrame, int]:
    """``trees`` with a number from 0 without gaps, and how many; one row a part is summed on the driver."""
    totals = sorted(map(tuple, trees.groupBy("part").agg(F.count("*")).collect()))
    base = np.cumsum([0, *(n for _, n in totals)]).tolist()
    bases = trees.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "part int, base long")
    return trees.join(F.broadcast(bases), "part").withColumn("tree", F.col("base") + F.col("nth")), base[-1]


def _search(trees: DataFrame, n_trees: int, anchors: DataFrame, k: int, scale: float, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, nth, score, id): the best ``k`` of each tree for each anchor, or for each of its positives inside ``window`` percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, waiting, n = None, None, [], 0
        for batch in batches:
            numbers, kinds = batch.column("tree").to_numpy(), batch.column("kind").to_numpy()
            new = np.flatnonzero(kinds == 0).tolist()
            for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
                if hi > lo:
                    if kinds[lo] == 0:
                        yield from _passed(tree, waiting, k, scale, window)
                        waiting, n, row = [], 0, batch.slice(lo, 1).to_pylist()[0]
                        dims, at = row["dims"], row["tree"]
                        tree = Tree(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(np.float64) if dims else np.zeros((len(row["ids"]) // 8, 0)))
                        lo += 1
                    if hi > lo:
                        if tree is None or (numbers[lo:hi] != at).any():
                            raise ValueError("anchors came before their tree")
                        waiting.append(batch.slice(lo, hi - lo).select(["anchor_id", "label", "embedding", "positives"]))
                        n += hi - lo
                if n >= BATCH:
                    yield from _passed(tree, waiting, k, scale, window)
                    waiting, n = [], 0
        yield from _passed(tree, waiting, k, scale, window)

    names = [f.split()[0] for f in _TREE.split(", ")][2:]
    blank = {"anchor_id": "long", "label": "long", "embedding": "array<double>", "positives": "array<struct<score:long,id:long>>", "ids": "binary", "labels": "binary", "dims": "int", "vectors": "binary"}
    some = lambda df, kind, own: df.select("tree", F.lit(kind).alias("kind"), *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    sent = anchors.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))))
    passing = some(trees, 0, names).unionByName(some(sent, 1, ["anchor_id", "label", "embedding", "positives"]))
    return passing.repartition(2 * n_trees, "tree").sortWithinPartitions("tree", "kind").mapInArrow(run, _FOUND)


def _passed(tree: Tree | None, waiting: list[pa.RecordBatch], k: int, scale: float, window: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    if tree is None or not waiting:
        return
    rows = pa.Table.from_batches(waiting).combine_chunks()
    for whole in rows.to_batches(max_chunksize=BATCH):
        for at, vectors in _matrices(whole, scale):
            if vectors.shape[1] != tree.vectors.shape[1]:
                continue
            own = whole.take(pa.array(at))
            ids, labels = own.column("anchor_id").to_numpy(), own.column("label").to_numpy()
            if window is None:
                low, high = np.full((len(ids), 1), NONE), np.full((len(ids), 1), -NONE)
            else:
                off, _ = _lists_of(own.column("positives"))
                scores = own.column("positives").values.field("score").to_numpy()[off[0] : off[-1]]
                wide = max(1, int(np.diff(off).max()))
                low, high = np.full((len(ids), wide), -NONE), np.full((len(ids), wide), NONE)  # an empty window where there is no positive
                row, col = np.repeat(np.arange(len(ids)), np.diff(off)), np.arange(len(scores)) - np.repeat(off[:-1] - off[0], np.diff(off))
                # bounds of whole numbers: ceil(low% of s), floor(high% of s), without a product that could pass 64 bits
                whole_, rest = scores // 100, scores % 100
                low[row, col] = window[0] * whole_ - (-window[0] * rest) // 100
                high[row, col] = window[1] * whole_ + window[1] * rest // 100
            found = Search(ids, labels, vectors, low, high, k, window is None)
            found.run(tree)
            wide = low.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found.query // wide]), pa.array((found.query % wide).astype(np.int32)), pa.array(found.score), pa.array(found.id)], ["anchor_id", "nth", "score", "id"])


def _lists_of(column: pa.Array) -> tuple[np.ndarray, int]:
    return column.offsets.to_numpy().astype(np.int64), len(column)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` ids of each anchor and window over all trees, with their rank."""
    once = found.groupBy("anchor_id", "nth", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` tells the anchors by vec_id, label or embedding. A positive is among the best ``positives`` other rows
    of the anchor's label; its negatives are the best ``negatives`` rows of other labels whose scores lie within
    ``window`` percent of its own.
    """
    worker_imports(vectors.sparkSession)
    rows = usable(vectors)
    trees, n = _numbered(store(grow_trees(rows, scale), "trees"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], out)
    one = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("own"))
    anchors = one.select(F.col("vec_id").alias("anchor_id"), "own.label", "own.embedding")
    none = F.lit(None).cast("array<struct<score:long,id:long>>").alias("positives")
    best = _best(_search(trees, n, anchors.select("*", none), positives, scale, None), positives)
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("own"))
    lists = lists.select(F.col("anchor_id").alias("_id"), F.transform("own", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives"))
    second = store(anchors.join(lists, F.col("anchor_id") == F.col("_id")).drop("_id"), "positives")
    found = _best(_search(trees, n, second, negatives, scale, window), negatives)
    each = second.select("anchor_id", F.posexplode("positives").alias("nth", "positive"))
    return found.join(each, ["anchor_id", "nth"]).select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def negatives_digest(vectors: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 100; of ids divisible by 7 the label moves on by one, modulo 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
