"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelens.llm.session import drop_scratch, scratch_path
from cuelens.llm.stages import drop_unknown_language, keep_one_near_duplicate, remove_contaminated, remove_repeated_spans, tokenize

STAGES = [
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", keep_one_near_duplicate),
    ("substring_dedup", remove_repeated_spans),
    ("benchmark_decontamination", remove_contaminated),
    ("byte_bpe", tokenize),
]

#: Language ID is a fitted model and MinHash decides which pairs are compared: SQL can't say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote to the shared folder, which goes once it is read.

    Nulls, empty texts, empty tables and clashing columns: as ``cuelens.llm.stages`` says of all stages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            if before:
                drop_scratch(spark, before)
            docs, before = spark.read.parquet(path), path
    return docs
