"""A fixed-size set of 64-bit keys, to leave rows out of a shuffle that surely have no partner.

The set is a table of ``BLOCKS`` rows with ``WORDS`` words of 64 bits each, 8 MB whatever the number of keys, so
its broadcast is bounded. A key sets one bit. A row whose bit is unset has no partner; one whose bit is set may
have one and is joined. With more keys than bits every row may have one, and the join is as if there were no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, WORDS = 1 << 16, 16


def _block(key: Column) -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 16), F.lit(WORDS)).cast("int")


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 24), F.lit(64)).cast("int")


def bit_table(keys: Column, rows: DataFrame) -> DataFrame:
    """(_block, _words) of the set of ``keys``, a bigint column of ``rows`` that is spread evenly (a hash)."""
    own = rows.select(keys.alias("key")).where("key is not null")
    own = own.select(_block(F.col("key")).alias("_block"), _word(F.col("key")).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("key"))).alias("one"))
    words = [F.coalesce(F.bit_or(F.when(F.col("w") == k, F.col("one"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(WORDS)]
    return own.groupBy("_block").agg(*words).select("_block", F.array(*[f"w{k}" for k in range(WORDS)]).alias("_words"))


def split(docs: DataFrame, key: Column, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose key may be in the set, and those whose key is surely not; a null key is not.

    Both read ``docs`` anew. All columns are kept; names may be any, since rows are packed for the join.
    """
    packed = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    small = F.broadcast(table)
    joined = packed.join(small, _block(F.col("_key")) == F.col("_block"), "left")
    may = F.coalesce(F.call_function("shiftright", F.get("_words", _word(F.col("_key"))), _bit(F.col("_key"))).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.where(may).select("_row.*"), joined.where(~may).select("_row.*")
