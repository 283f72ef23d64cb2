"""Folds and bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on: its documented bound, whatever the corpus.
SAMPLE_ROWS = 20_000


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text modulo `folds` equals `fold`; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_of(labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label: the `rows` labelled documents outside the held-out fold whose hashed ids are smallest.

    Null ids and labels are left out; an id with several labels takes the largest.
    """
    found = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold("doc_id", folds, held_out))
    found = found.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """text, label of the sampled documents, equal texts once. The bounded sample is broadcast: only its texts move."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label").distinct()
