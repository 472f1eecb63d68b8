"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

A document's set is its distinct runs of five words; a text of one to four words is one run. Sets
that are equal become one node first, so copies are never paired. ``BANDS`` bands of ``ROWS`` minima
find two sets of Jaccard similarity 0.8 with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.99998.
Nodes are shuffled on band hashes and tied to the smallest of their bucket; the components of these
ties hold every candidate pair. A small component's pairs are all verified in one task. In a larger one that is
tight, where most pairs are candidates, all pairs of compatible size meet once, in pairs of blocks. In a larger
one that is loose, a chain of texts each like the next, only pairs that share a bucket meet: buckets are tasks,
large ones in pairs of blocks, and a pair is judged in the first band it shares. Which of the two a component gets
is the one with fewer pairs. Only counts and spanning edges leave a task, never pairs. Components of the verified
edges are the classes.

Texts of candidates alone are shuffled, and of band hashes those of buckets of two or more alone when they are tied,
while a bit set of bounded size can tell them (``bits``); ``keep_first`` shuffles only rows that go or repeat.

A node is named by 64 bits of hash of its set; n nodes share a name by chance in about n*n / 2**65 pairs. Two sets of
one name would be one node.

Defined cases: a null text has no words; a text without words is a class of its own without links,
also beside other such texts; rows that repeat (equal id and text) are documents of their own that are
linked; a null doc_id is an id like any other but never names a class that has another; an empty table
gives no rows; other columns are ignored, ``keep_first`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelens.llm.bits import bit_table, split
from cuelens.llm.components import components
from cuelens.llm.session import drop, store, worker_imports
from cuelens.llm.textkit import Texts, let_go, mix, slices, windows

SHINGLE = 5
#: A pair is linked if 9 * common >= 4 * (sum of sizes): similarity 4/5 at least.
BANDS, ROWS = 36, 6
#: Shingles and nodes of one verification block, and shingles of the small components that share a task.
BLOCK_SHINGLES, BLOCK_NODES, TASK_SHINGLES = 200_000, 1500, 1_000_000
#: Text whose sets a verification task holds at a time, if one component has no more.
SET_BYTES = 1 << 20
#: Text signed at a time.
SIGN_BYTES = 1 << 20
#: A component or bucket beyond so many nodes is dealt over several blocks, however small, up to ``SPREAD``.
FEW_NODES, SPREAD = 400, 8
#: Sizes of linked sets differ by a factor of 1.25 at most, so by one class of this base at most.
SIZE_BASE = 1.26
_MULTIPLIERS = np.random.default_rng(8).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and n+1 offsets."""
    texts = Texts(array)
    words = texts.words()
    hashes = words.hashes(8)
    found, at = windows(words, hashes, SHINGLE)
    owner = words.owner()
    doc = owner[at]
    count = words.count
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = count[short] > k
            whole[has] = mix(whole[has] * np.uint64(3) + hashes[words.first[short[has]] + k] + np.uint64(k + 1))
        found, doc = np.concatenate([found, whole]), np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[fresh], doc[fresh]
    return found, np.searchsorted(doc, np.arange(texts.n + 1))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SIGN_BYTES):
        sets, off = shingle_sets(batch.column("text"))
        size = np.diff(off)
        some = np.flatnonzero(size)
        total = np.append(np.uint64(0), np.cumsum(mix(sets)))
        other = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
        with np.errstate(over="ignore"):
            node = mix((total[off[1:]] - total[off[:-1]]) ^ mix(other[off[1:]] - other[off[:-1]] + size.astype(np.uint64)))
        bands = np.zeros((len(some), BANDS), np.uint64)
        for k, m in enumerate(_MULTIPLIERS):
            b = k // ROWS
            least = np.minimum.reduceat(sets * m, off[some]) if len(some) else sets[:0]
            bands[:, b] = mix(bands[:, b] * np.uint64(3) + least + np.uint64(b + 1))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int32()), pa.array(node.view(np.int64)), lists], ["doc_id", "text_hash", "n", "node", "bands"]
        )
    let_go()


def _verify(table: pa.Table) -> pa.Table:
    """Of one task: each node's links to others, by copies, and the smallest node it is connected to here."""
    frame = {c: table[c].to_numpy(zero_copy_only=False) for c in ("comp", "node", "copies", "side", "band")}
    order = np.lexsort((frame["node"], frame["comp"]))
    comp, node = frame["comp"][order], frame["node"][order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (comp[1:] != comp[:-1]) | (node[1:] != node[:-1])
    order = order[fresh]
    comp, node, copies, side, band = (frame[c][order] for c in ("comp", "node", "copies", "side", "band"))
    text, bands = table["text"].combine_chunks(), table["bands"].combine_chunks()
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)[order])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edge = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
    sets, off, first, end = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0, 0
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        if lo == end:  # sets of the next components, of about ``SET_BYTES`` of text or of one component, are held at a time
            most = (total[lo - 1] if lo else 0) + SET_BYTES
            first, end = lo, max(hi, edge[np.searchsorted(edge, np.searchsorted(total, most, "right"), "right") - 1])
            sets, off = shingle_sets(text.take(pa.array(order[lo:end])))
        if hi - lo > 1:
            own = slice(lo - first, hi - first + 1)
            linked = _linked(sets[off[own][0] : off[own][-1]], off[own] - off[own][0], side[lo:hi])
            if band[lo] > 0:  # pairs that share an earlier band are judged there
                given = bands.take(pa.array(order[lo:hi])).flatten().to_numpy().reshape(hi - lo, -1)
                for k in range(band[lo]):
                    linked &= given[:, k][:, None] != given[:, k][None, :]
            a, b = np.nonzero(linked)
            if len(a):
                links = linked.astype(np.int64) @ copies[lo:hi]
                some = np.flatnonzero(links)
                out.append((node[lo:hi][some], links[some], node[lo:hi][_roots(len(linked), a, b)[some]]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("node", "links", "root"), columns, strict=True)})


def _linked(sets: np.ndarray, off: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which sets are linked: among all where ``side`` is 0, in a task of two blocks (sides 1 and 2) between the sides only.

    A block may be empty, so that a task of two blocks can hold one side alone; it has no links then.
    """
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(sets, kind="stable")
    s, o = sets[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    group = np.cumsum(fresh) - 1
    many = np.bincount(group) > 1
    keep = many[group]
    column, o = np.cumsum(many)[group[keep]] - 1, o[keep]
    common = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (lo, lo + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[o[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    linked = 9 * common.astype(np.int64) >= 4 * (size[:, None] + size[None, :])
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each, by repeated minima and shortcuts."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _blocks(shingles: Column, nodes: Column) -> Column:
    """Blocks of a group: as many as its shingles and nodes need, and a few for a group that is merely large."""
    spread = F.least(F.ceil(nodes / FEW_NODES), F.lit(SPREAD))
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(nodes / BLOCK_NODES), spread).cast("int")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _tasks(members: DataFrame, rows: DataFrame, full: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, task, comp, side, band): every candidate pair meets in one task; ``side`` as in ``_linked``, ``band`` as in ``_verify``. And the stored tables that it reads.

    ``members`` are the nodes of components, ``full`` (b, least, c) the buckets of two or more, ``rows`` (node, k, band) the nodes' band hashes, of those in ``full`` all.
    """
    stats = members.groupBy("comp", "level").agg(F.sum("n").alias("shingles"), F.count("*").alias("nodes"))
    whole = stats.groupBy("comp").agg(F.sum("shingles").alias("all_shingles"), F.sum("nodes").alias("all_nodes"), F.sum(F.col("nodes") * F.col("nodes")).alias("all_pairs"))
    small = (F.col("all_shingles") <= BLOCK_SHINGLES) & (F.col("all_nodes") <= min(FEW_NODES, BLOCK_NODES))
    by_comp = store(stats.join(whole, "comp").select("comp", "level", _blocks(F.col("shingles"), F.col("nodes")).alias("blocks"), small.alias("small"), "all_shingles", "all_pairs"), "blocks")
    total = by_comp.where("small").select("comp", "all_shingles").distinct().agg(F.sum("all_shingles")).first()[0] or 0
    shared = max(1, -(-total // TASK_SHINGLES), int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = by_comp.where("small").select(F.col("comp").alias("c")).distinct()
    easy = members.join(few, F.col("comp") == F.col("c")).select("node", F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(shared)).cast("string")).alias("task"), "comp", F.lit(0).alias("side"), F.lit(0).alias("band"))

    # buckets of the components that are not small, and the pairs in them
    large = by_comp.where("not small")
    at = members.select(F.col("node").alias("m"), F.col("comp").alias("bucket_comp"))
    held = full.join(at, F.col("least") == F.col("m")).join(large.select(F.col("comp").alias("lc"), "all_pairs").distinct(), F.col("bucket_comp") == F.col("lc"))
    held = store(held.select("b", "c", "bucket_comp", "all_pairs"), "large-buckets")
    loose = store(held.groupBy("bucket_comp").agg(F.sum(F.col("c") * F.col("c")).alias("bucket_pairs"), F.first("all_pairs").alias("all_pairs")).where("bucket_pairs < all_pairs").select(F.col("bucket_comp").alias("loose")), "loose")

    tight = large.join(loose, F.col("comp") == F.col("loose"), "left_anti")
    sizes = tight.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("by_level"))
    wide = members.join(sizes.withColumnRenamed("comp", "c"), F.col("comp") == F.col("c"))
    wide = wide.withColumn("i", F.pmod(F.xxhash64("node"), F.col("by_level")[F.col("level")]).cast("int"))

    def name(level, i, other, j):
        return F.concat_ws("-", F.col("comp").cast("string"), level.cast("string"), i.cast("string"), other.cast("string"), j.cast("string"))

    def sided(tasks, i):
        return F.transform(tasks, lambda j: F.struct(name(level, F.least(i, j), level, F.greatest(i, j)).alias("task"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("side")))

    level, i = F.col("level"), F.col("i")
    of = lambda k: F.coalesce(F.try_element_at("by_level", k), F.lit(0))
    same = sided(_upto(of(level)), i)
    up = F.transform(_upto(of(level + 1)), lambda j: F.struct(name(level, i, level + 1, j).alias("task"), F.lit(1).alias("side")))
    down = F.transform(_upto(of(level - 1)), lambda j: F.struct(name(level - 1, j, level, i).alias("task"), F.lit(2).alias("side")))
    hard = wide.select("node", "comp", F.explode(F.concat(same, up, down)).alias("t")).select("node", "t.task", "comp", "t.side", F.lit(0).alias("band"))

    # a bucket of a loose component is a task, or several where it is large
    own = held.join(loose, F.col("bucket_comp") == F.col("loose")).select("b", "bucket_comp")
    inside = rows.join(own, F.col("band") == F.col("b")).join(members.select(F.col("node").alias("m"), "n"), F.col("node") == F.col("m"))
    inside = store(inside.select("node", "k", "b", "bucket_comp", "n"), "loose-buckets")
    parts = inside.groupBy("b").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks")).withColumnRenamed("b", "pb")
    dealt = inside.join(parts, F.col("b") == F.col("pb")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = F.transform(_upto(F.col("blocks")), lambda j: F.struct(F.concat_ws("-", F.lit("b"), F.col("b").cast("string"), F.least(i, j).cast("string"), F.greatest(i, j).cast("string")).alias("task"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("side")))
    chained = dealt.select("node", F.col("b").alias("comp"), "k", F.explode(met).alias("t")).select("node", "t.task", "comp", "t.side", F.col("k").alias("band"))
    return easy.unionByName(hard).unionByName(chained), [by_comp, held, loose, inside]


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, class_id, n_links) of every row of ``docs``.

    ``class`` names the class (null for a text without words), ``class_id`` is the smallest doc_id of the documents connected by links, ``n_links`` the number of
    other documents whose sets are 0.8 similar or more. ``reads``: the stored tables behind the rows, for a caller that is done with them.
    """
    worker_imports(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = store(keyed.mapInArrow(_sign, "doc_id long, text_hash long, n int, node long, bands array<long>"), "signed")
    sets = signed.where("n > 0")
    nodes = store(sets.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("of"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.posexplode("bands").alias("k", "band"))
    full = store(rows.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select(F.col("band").alias("b"), "least", "c"), "full")
    rows, _ = split(rows, F.col("band"), bit_table(F.col("b"), full))  # bands that no other node has are not shuffled again
    ties = rows.join(full, F.col("band") == F.col("b")).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    found = components(ties)
    about = nodes.select(F.col("node").alias("nd"), "n", "copies", "of", F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_BASE))).cast("int").alias("level"), "bands")
    members = store(found.join(about, F.col("node") == F.col("nd")).select("node", F.col("component").alias("comp"), "n", "copies", "of", "level", "bands"), "members")
    tasks, read = _tasks(members, rows, full)
    tasks = tasks.withColumnRenamed("node", "task_node")
    wanted, _ = split(keyed, F.xxhash64("doc_id", "text_hash"), bit_table(F.xxhash64("of.id", "of.hash"), members))
    # rows that repeat are one text: the keys have no nulls, so what is dealt for this is dealt for the join as well
    wanted = wanted.groupBy(F.coalesce("doc_id", F.lit(0)).alias("w_id"), F.col("doc_id").isNull().alias("w_none"), F.col("text_hash").alias("w_hash")).agg(F.first("text").alias("text"))
    owners = members.withColumns({"w_id": F.coalesce("of.id", F.lit(0)), "w_none": F.col("of.id").isNull(), "w_hash": F.col("of.hash")})
    texts = owners.join(wanted, ["w_id", "w_none", "w_hash"])
    ready = tasks.join(texts.select("node", "copies", "text", "bands"), F.col("task_node") == F.col("node")).select("task", "comp", "node", "copies", "side", "band", "bands", "text")
    verified = store(ready.groupBy("task").applyInArrow(_verify, "node long, links long, root long"), "verified")
    drop(members, full, *read)
    classes = components(verified.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.join(links, "node").withColumnRenamed("node", "nd")
    known = nodes.join(linked, F.col("node") == F.col("nd"), "left").select("node", "least_id", "copies", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    known = store(known, "known")
    drop(verified, nodes)
    named = known.groupBy("class").agg(F.min("least_id").alias("class_id")).withColumnRenamed("class", "cl")
    table = store(known.join(named, F.col("class") == F.col("cl")).select(F.col("node").alias("nd"), "class", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "classes")
    drop(known)
    alone = F.col("n") == 0
    rows = signed.join(table, (F.col("node") == F.col("nd")) & ~alone, "left").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "class", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    rows.reads = [signed, table]
    return rows


def jaccard_digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one: that of the smallest doc_id, then text hash.

    Texts without words all stay; of rows that repeat one stays.
    """
    found = jaccard_classes(docs)
    classes = store(found.select("doc_id", "text_hash", "class").where("class is not null"), "classes")
    drop(*found.reads)
    first = classes.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("d"), F.col("k.text_hash").alias("h"))
    every = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    judged = every.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    # rows that go, and rows that repeat: all others stay as they are
    moot = store(judged.where("h is null or n > 1").select("doc_id", "text_hash", F.col("h").isNotNull().alias("stays")).withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), "moot")
    drop(classes)
    may, rest = split(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), bit_table(F.xxhash64("d", "h"), moot))
    packed = may.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    joined = packed.join(moot, F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    order = Window.partitionBy("id", "hash").orderBy(F.xxhash64("row"))
    kept = joined.withColumn("k", F.when(F.col("stays"), F.row_number().over(order))).where("stays is null or k = 1").select("row.*")
    return kept.unionByName(rest)
