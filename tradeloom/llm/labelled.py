"""The labelled rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """``(id, y)`` outside the held-out fold; a repeated id counts once, with its least label; null labels and ids are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    return rows.where(fold("id") != 0).groupBy("id").agg(F.min("y").alias("y"))


def sample(rows: DataFrame, most: int, salt: int = 0) -> DataFrame:
    """At most ``most`` rows in the order of a hash of their id: a sample that depends on the ids only."""
    return rows.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(most)


def one_text(rows: DataFrame, *others: str) -> DataFrame:
    """One row an id and ``others``, with the text of the least hash, so that repeated rows don't exceed the bound of a sample."""
    return rows.groupBy("id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
