"""Connected components of an edge table, by alternating stars.

In a large star every node sends its larger neighbours to its smallest one, in a small star its
smaller ones; both keep the components and end with each node at its component's smallest
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014). Each step is aggregations with
a partial step before the shuffle, and joins of written tables, whose skewed keys Spark can split. A round's
tables are deleted as soon as the next one is written.

Defined cases: an empty table gives no rows; edges may repeat, in either direction; an edge from a node to itself
ties nothing and, without another edge, is in no component; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelens.llm.session import drop, store

#: Far more than the logarithm of any number of nodes.
MOST_ROUNDS = 60


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v")


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "star")
    sent = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n"))
    return _pairs(sent.select(F.col("v").alias("u"), F.col("m").alias("v"))), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "star")
    sent = down.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _pairs(sent.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))), least


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: the stars are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v longs): the smallest node it is connected to."""
    edges = store(_pairs(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(edges):
            break
        for star in (_large, _small):
            found, least = star(edges)
            after = store(found, "stars")
            drop(edges, least)
            edges = after
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.groupBy("v").agg(F.lit(1).alias("_one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
