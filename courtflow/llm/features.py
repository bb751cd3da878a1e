"""Label handling shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Rows kept out of learning: crc32 of the id as text, by its remainder."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def one_label(labels: DataFrame, column: str, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label): one row per id, rows without label left out; of several the largest."""
    known = labels.filter(F.col(column).isNotNull() & F.col(id_column).isNotNull())
    return known.groupBy(F.col(id_column).alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
