"""Benchmark decontamination with DataFrame and SQL functions only.

Words are runs of ASCII digits and letters (A-Z lower-cased) and all characters beyond ASCII. A
window is 13 consecutive words of a benchmark item; an item of fewer words is one window. Each
document's windows are tested against a bit set of the windows' first, middle and last word, inside the row;
the few that pass are joined by their whole text with the table of windows, which verifies them and names the
items. The set has 32 bits and two probes for each window up to ``MOST_BITS`` (two million windows, one place in
270 passes by chance); with more windows more places pass and are verified. The table of windows is broadcast
while it has ``BROADCAST_BYTES`` at most. Beyond, it is shuffled, and each window goes to ``SALTS`` tasks, over
which the documents that hold it are dealt, so that a passage of a third of all documents is no one task's. Only
documents' ids, counts and hits are shuffled; ``remove`` shuffles only documents that a bit set of bounded size
cannot tell from contaminated ones.

Rows are named by their place while their hits are gathered, so ``docs`` that Spark may deliver in another order when a
task is run again are stored first (``steady``).

Defined cases: a null text has no words, is not hit and not contaminated; rows that repeat are judged
one by one; a null item text has no windows; an item with a null id marks words but is not listed or
counted; items may repeat; with an empty benchmark nothing is hit; columns with clashing names do
not matter, since only doc_id, item_id and text are read (``remove`` keeps all columns).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelens.llm.bits import bit_table, split
from cuelens.llm.session import steady, store

WIDTH = 13
#: Bytes of windows and item ids in the broadcast table at most.
BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Bits of the set: 32 for each window within these bounds. It is a literal of the plan, 8 MB at most.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    plain = F.octet_length(text) == F.length(text)  # without other letters than ASCII's, lower() changes A-Z alone
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOW))
    return F.coalesce(F.array_remove(F.split(low, _GAPS), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(gram, size, items): each distinct window's text and word count, and the ids of the items that have it as sorted strings."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    grams = rows.select("item", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("gram"))
    return grams.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _key(size: int, at) -> str:
    """SQL for the hash of a window's first, middle and last word hash, of the array ``h`` from its 0-based place ``at``."""
    return f"xxhash64({size}, get(h, {at}), get(h, {at} + {(size - 1) // 2}), get(h, {at} + {size - 1}))"


def _probes(key: str, bits: int) -> list[str]:
    """SQL of the two places of a key in the set."""
    return [f"pmod({key}, {bits}L)", f"pmod(shiftrightunsigned({key}, 27), {bits}L)"]


def _bit_set(windows: DataFrame) -> tuple[list[int], str, int]:
    """The window sizes that occur, the SQL of an array<bigint> with the bits of all windows' keys, and the number of bits."""
    h = windows.select("size", F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)).alias("h"))
    counts = {r["size"]: r["count"] for r in h.groupBy("size").count().collect()}
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 32 * sum(counts.values())):
        bits *= 2
    table = np.zeros(bits // 64, np.int64)
    for size in counts:
        places = F.explode(F.array(*map(F.expr, _probes(_key(size, 0), bits)))).alias("b")
        # at most `bits` / 64 numbers come back, whatever the size of the benchmark
        words = h.where(F.col("size") == size).select(places).groupBy(F.shiftright("b", 6).alias("i"))
        for r in words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).collect():
            table[r["i"]] |= np.int64(r["v"])
    return sorted(counts), f"cast(split('{','.join(map(str, table.tolist()))}', ',') as array<bigint>)", bits


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items, spans, contaminated for each row of ``docs``.

    ``items`` are the sorted ids, ``spans`` the maximal hit runs as (start, end) word positions from 0.
    """
    windows = store(benchmark_windows(benchmark, width), "windows")
    sizes, bit_set, bits = _bit_set(windows)
    rows = steady(docs.select("doc_id", "text")).select("doc_id", F.struct(F.monotonically_increasing_id().alias("at"), F.xxhash64("text").alias("hash")).alias("row"), words_of(F.col("text")).alias("w"))
    rows = rows.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    test = "(shiftright(get(bits, cast(shiftright({0}, 6) as int)), cast({0} & 63L as int)) & 1L) = 1L"
    passed = []
    for size in sizes:
        keys = f"if(size(h) < {size}, cast(array() as array<bigint>), transform(sequence(0, size(h) - {size}), i -> {_key(size, 'i')}))"
        rows = rows.withColumn(f"k{size}", F.expr(keys))
        both = " and ".join(test.format(p) for p in _probes(f"get(k{size}, i)", bits))
        passed.append(f"filter(if(size(k{size}) = 0, cast(array() as array<int>), sequence(0, size(k{size}) - 1)), i -> {both})")
    if sizes:
        rows = rows.withColumn("c", F.expr(f"transform(array({bit_set}), bits -> array({', '.join(passed)}))[0]"))

    def with_text(k: int, size: int) -> Column:
        return F.transform(F.get("c", F.lit(k)), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice("w", i + 1, size), " ").alias("gram")))

    kind = "array<struct<at:int,size:int,gram:string>>"
    found = F.concat(*[with_text(k, size).cast(kind) for k, size in enumerate(sizes)]) if sizes else F.array().cast(kind)
    thin = rows.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), found.alias("found"))
    thin = thin.select("doc_id", "row", "n_words", F.explode_outer("found").alias("c")).select("doc_id", "row", "n_words", "c.at", "c.size", "c.gram")
    known = windows.select(F.col("gram").alias("g"), F.col("size").alias("s"), "items")
    same = (F.col("gram") == F.col("g")) & (F.col("size") == F.col("s"))
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    held = windows.select(F.sum(F.octet_length("gram") + ids + 64).alias("n")).first()["n"] or 0
    if held <= BROADCAST_BYTES:
        matched = thin.join(F.broadcast(known), same, "left")
    else:
        salted = thin.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        dealt = known.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = salted.join(dealt, same & (F.col("salt") == F.col("of")), "left")
    span = F.when(F.col("g").isNotNull(), F.struct("at", (F.col("at") + F.col("size")).alias("end")))
    by_doc = matched.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set(span)).alias("at"), F.flatten(F.collect_set("items")).alias("items"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def extend(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        fresh = F.concat(done, F.array(F.struct(x["at"].alias("start"), x["end"].alias("end"))))
        return F.when((F.size(done) > 0) & (x["at"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(fresh)

    # starts and ends of maximal runs: a hit that no earlier one reaches starts a run
    reach = F.aggregate(
        "at",
        F.struct(F.lit(-1).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["reach"], x["end"]).alias("reach"), (a["n"] + F.greatest(x["end"] - F.greatest(x["at"], a["reach"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return by_doc.select(
        "doc_id",
        F.col("row.hash").alias("text_hash"),
        "n_words",
        reach.alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.aggregate("at", empty, extend).alias("spans"),
    ).select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = hits(docs, benchmark, width)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents; the others are untouched."""
    found = hits(docs, benchmark, width).where("contaminated").groupBy("doc_id", "text_hash").agg(F.lit(1).alias("one"))
    bad = store(found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")), "contaminated")
    may, clean = split(docs, F.xxhash64("doc_id", F.xxhash64("text")), bit_table(F.xxhash64("bad_id", "bad_hash"), bad))
    packed = may.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return packed.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*").unionByName(clean)
