"""From raw documents to packed sequences: every stage works on what the one before it kept.

``run`` writes each stage's result below the shared folder and reads it again, so a stage is computed once and a lost
executor costs only its own tasks.

Documents need the columns ``doc_id`` and ``text``; others, whatever they are called, go along to the last stage but one.
Defined cases: a null text counts as an empty one and stays null until it is packed as a document without words; null and
empty texts are no near duplicates of each other; a row stands for itself in every stage, whether its id is null, repeated or
reused for another text, but of rows with the same id and text one stays, as of any near duplicates; ties are decided by the
smaller id and then by a hash of the text; texts are taken whole, however long; ``n_chars``, where there is such a column, is
counted anew after masking and stays null where it was; an empty table passes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import decontamination, jaccard, packing, pii, toxicity
from trackspark.llm.labelled import fold
from trackspark.llm.tables import table
from trackspark.session import scratch_dir

#: Vocabulary of the packing stage.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: No SQL: fitted classifiers and a fitted random field decide.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside of its held-out fold, scores under one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id."""
    return jaccard.keep_one(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, their lengths counted anew."""
    masked = pii.redact(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(kind)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
