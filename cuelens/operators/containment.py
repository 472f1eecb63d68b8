"""Which texts hold which passages word for word, by an index of anchors and no comparison of all with all.

A passage can only stand in a text that has all its inner words: those with white space on both sides inside the
passage, which are whole words of the text as well. Its anchor is the one that fewest texts have; texts and passages
meet on anchors alone. A passage without an inner word has its longest run of characters looked for in the vocabulary,
by the rarest three characters of that run, and every word that holds the run is an anchor. Candidates are then read
against the text itself.

Work follows the distinct words of each text and the candidates, whatever the number of passages; a word in all texts
is nobody's anchor unless a passage has no other.

Defined cases: null and empty passages are held by no text, null texts hold none; rows that repeat count each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters by which a run is looked for in the vocabulary.
GRAM = 3


def _runs(text: Column) -> Column:
    """Distinct runs of white space and of other characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\S+|\s+"), F.lit(0)))


def _grams(run: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, size)))


def _rarest(rows: DataFrame, frequency: DataFrame, by: str, term: str) -> DataFrame:
    """(by, term): of each ``by`` the term that ``frequency`` (term, n) has least often, the longest of equal ones; none where a term is in no text."""
    known = frequency.select(F.col("term").alias("_t"), "n")
    joined = rows.join(known, F.col(term) == F.col("_t"), "left").groupBy(by)
    best = joined.agg(F.min(F.struct("n", (-F.length(term)).alias("l"), F.col(term).alias("t"))).alias("b"), F.count_if(F.col("n").isNull()).alias("unknown"))
    return best.where("unknown = 0").select(by, F.col("b.t").alias(term))


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage_id, doc_id) of each row of ``passages`` (passage_id, passage) and each of ``docs`` (doc_id, text) that holds it."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    words = texts.select(key.alias("key"), F.explode(_runs(F.col("text"))).alias("word"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("n")).select(F.col("word").alias("term"), "n")

    distinct = passages.where(F.length("passage") > 0).select("passage").distinct()
    split = distinct.select("passage", F.array_distinct(F.regexp_extract_all("passage", F.lit(r"(?<=\s)\S+(?=\s)"), F.lit(0))).alias("inner"))
    anchored = _rarest(split.select("passage", F.explode("inner").alias("word")), vocabulary, "passage", "word")

    # without an inner word: the longest run, words before white space, looked for inside the words of the vocabulary
    runs = F.array_sort(F.transform(_runs(F.col("passage")), lambda r: F.struct(r.rlike(r"\s").alias("space"), (-F.length(r)).alias("l"), r.alias("run"))))
    edge = split.where(F.size("inner") == 0).select("passage", F.element_at(runs, 1)["run"].alias("run"))
    pieces = vocabulary.select(F.col("term").alias("held"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("term"))), lambda k: _grams(F.col("term"), k)))).alias("gram"))
    size = F.least(F.lit(GRAM), F.length("run"))
    needed = edge.select("run").distinct().select("run", F.explode(_grams(F.col("run"), size)).alias("gram"))
    chosen = _rarest(needed, pieces.groupBy(F.col("gram").alias("term")).agg(F.count("*").alias("n")), "run", "gram")
    holders = chosen.join(pieces, "gram").where(F.contains("held", "run")).select(F.col("run").alias("_run"), F.col("held").alias("word"))
    by_run = edge.join(holders, F.col("run") == F.col("_run")).select("passage", "word")

    meant = anchored.unionByName(by_run).withColumnRenamed("word", "anchor")
    candidates = words.join(meant, F.col("word") == F.col("anchor")).select("key", "passage").distinct()
    read = texts.withColumn("_key", key).join(candidates, F.col("_key") == F.col("key")).where(F.contains("text", "passage"))
    named = passages.select("passage_id", F.col("passage").alias("_passage"))
    return read.join(named, F.col("passage") == F.col("_passage")).select("passage_id", "doc_id")
