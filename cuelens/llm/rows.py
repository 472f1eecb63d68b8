"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as remainder 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def sample_fraction(rows: DataFrame, fraction: Column, salt: int) -> DataFrame:
    """The rows whose hash of all columns falls in ``fraction``: the same rows whatever the partitions."""
    spread = F.xxhash64(F.lit(salt), *[F.col(c) for c in rows.columns])
    return rows.where((F.pmod(spread, F.lit(1 << 30)) / float(1 << 30)) < fraction)
