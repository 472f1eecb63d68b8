"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each one operator over all its input.

Defined cases of all stages: an empty table gives an empty one with the same columns; rows that repeat are rows of
their own, but for the Jaccard join, of which one of each class stays; a null doc_id is an id like any other; columns
other than those a stage is for are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelens.llm import bpe, decontaminate, langid, neardup, substring

#: A predicted language below this probability rejects a document, and so does a smaller share of n-grams seen in it.
LEAST_SCORE, LEAST_KNOWN = 0.5, 0.8


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or in none of the learned languages go; null text goes.

    The probability compares the learned languages with each other only and is near 1 for almost every text.
    A text in another language is told by its n-grams: more than a fifth of them were never seen in the
    predicted one. Languages near a learned one pass. Where no row is labelled no language is learned, and
    only null and letterless texts go.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns' own names, none clashes
    found = langid.identify(docs.toDF(*names), model, names, share_known=True, text=names[docs.columns.index("text")])
    sure = (F.col("_lang_score") >= LEAST_SCORE) & (F.col("_lang_known") >= LEAST_KNOWN)
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & sure).select(*names).toDF(*docs.columns)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class one document stays."""
    return neardup.keep_first(docs)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of repeated windows go from ``text``; every document stays, and n_chars follows its text."""
    cut = substring.dedup_substrings(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which benchmark windows hit a twentieth or more go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ``docs`` with token_ids and the bytes they decode to."""
    return bpe.encode(docs)
