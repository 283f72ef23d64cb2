"""A corpus through five operators: toxic documents go, one document of each near-duplicate class stays, repeated
passages and benchmark passages are cut out of the texts, and what is left is packed into windows.

Every stage's result is written as Parquet in the shared folder and reread by the next, so a lost executor costs
one stage's tasks at most. An emptied text stays a row: the packing gives it its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontamination, minhash, packing, substrings, toxicity
from lumenfold.llm.common import forget, read, shipped, written
from lumenfold.llm.queries import TOKENIZER

#: The columns of documents; what all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = tuple(c for c in COLUMNS if c != "text")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """COLUMNS with a new text and its length."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring does not reject. A null or empty text is never toxic; rows that repeat are judged each;
    without labels, or with an empty table, nothing goes. Returns COLUMNS; further columns of `docs` are left out.
    """
    shipped(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: its smallest doc_id, once where rows repeat.

    Null texts are empty ones, which are one class; a null doc_id stands for its class only where all are null.
    Returns COLUMNS; further columns are left out; an empty table gives no rows.
    """
    shipped(spark)
    return minhash.one_of_each(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that lie wholly in 50-byte strings of documents with a smaller doc_id.

    Every row stays, also when nothing is left of its text; a null text becomes an empty one; a null doc_id counts as
    the largest, and rows of one doc_id do not repeat each other. Returns COLUMNS with n_chars of the new text.
    """
    shipped(spark)
    docs = docs.select(*COLUMNS)
    return _with_text(substrings.removals(docs, keep=OTHERS, clean="kept_text"), "kept_text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in benchmark windows. Every row stays; a null text becomes an empty one; null ids
    and repeated rows are cleaned like any other. Returns COLUMNS with n_chars of the new text.
    """
    shipped(spark)
    docs = docs.select(*COLUMNS)
    found = decontamination.scan(docs, read(spark, sf_dir, "benchmark"), keep=OTHERS, clean="kept_text")
    return _with_text(found, "kept_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids: columns of `packing.pack`. A null or empty text is its end id."""
    shipped(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the fitted, sampled and packed stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before it wrote."""
    docs = read(spark, sf_dir, "documents")
    last = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
