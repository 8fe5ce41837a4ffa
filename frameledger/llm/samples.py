"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, label: str, size: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of up to `size` ids, by least hash of the id, so that the same rows give the same sample.

    Null ids and labels are left out; an id with several labels counts once, with the largest.
    """
    return (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
            .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))


def with_labels(features: DataFrame, ids: DataFrame, size: int) -> list:
    """Rows (doc_id, label, x) of the driver's sample. Both sides are bounded by `size`: an id with several rows gives one."""
    return features.groupBy("doc_id").agg(F.min("x").alias("x")).join(ids, "doc_id").orderBy("doc_id").limit(size).collect()


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor
