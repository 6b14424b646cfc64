"""Labelled rows for the two document classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(parts: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod parts is remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents outside the held-out part, by hash of the id.

    Null labels and null ids are left out; of several labels of a document the largest counts, and of
    several rows with its id all stand.
    """
    chosen = labels.filter(~held).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `most` bounds what is broadcast
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
