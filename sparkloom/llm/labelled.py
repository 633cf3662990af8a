"""Held-out folds, and the labelled rows outside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds. Null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds))


def outside(labels: DataFrame, label: str, folds: int, held_out: int, rows: int | None = None) -> DataFrame:
    """(doc_id, label) of the labelled documents outside the held-out fold: all, or the first `rows` of them by a hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    return own if rows is None else own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold, chosen by a hash of doc_id.

    The chosen labels, at most `rows` of them, are broadcast to the documents.
    """
    chosen = outside(labels, label, folds, held_out, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
