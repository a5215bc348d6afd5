"""Labels of documents and their folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Whether the CRC-32 of the doc_id's digits leaves 1 after division by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0.0 or 1.0) of each labelled document that isn't held out; of several labels the largest counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label"))
    rows = rows.filter("doc_id is not null and label is not null").filter(~held_out())
    return rows.groupBy("doc_id").agg((F.max("label") > 0).cast("double").alias("label"))


def bounded(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of doc_id."""
    return labelled.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
