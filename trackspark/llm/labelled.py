"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)), F.lit(-1))


def known(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """``doc_id, y`` of each labelled id for which ``keep`` holds: no nulls, no labels but 0 and 1, no ids labelled both ways."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(keep)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` documents of either label, picked by hash of the id.

    ``keep`` is a condition on ``doc_id``. Ids are chosen first, so only the chosen texts travel, one for each id: of several
    texts under one id that of the smallest hash. Rows without label, without text or with a label other than 0 and 1 are no
    candidates, nor are ids that are labelled both ways.
    """
    rows = sampled(docs, known(labels, label, keep), most)
    return rows["text"].to_pylist(), rows["y"].to_pylist()


def sampled(docs: DataFrame, known: DataFrame, most: int) -> pa.Table:
    """``doc_id, text, y`` of a sample, by id."""
    chosen = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)
    ]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * most rows of two numbers
    found = docs.where("text is not null").join(ids, "doc_id").select("doc_id", "text", "y")
    return one_text(found, "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])


def one_text(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each ``doc_id``: of several texts that of the smallest hash."""
    return rows.groupBy("doc_id", *more).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
