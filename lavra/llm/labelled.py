"""Rows that models may learn from, and the folds that keep held-out rows away from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; 2 is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")


def held_out(id_col: str | Column = "doc_id") -> Column:
    """A null id is in no fold: it isn't held out, and is never learned from either."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def learnable(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of labelled ids outside the held-out fold; a repeated id counts once, with its least label."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("label is not null").where(fold("doc_id") != 2)
    return known.groupBy("doc_id").agg(F.min("label").alias("label"))


def sample(known: DataFrame, most: int) -> DataFrame:
    """At most `most` of the labelled ids, by the order of a hash of the id: small enough to broadcast, so the texts never move."""
    return F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
