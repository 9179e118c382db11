"""The corpus pipeline: stages over documents, each written and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of
documents; the last returns token counts and ids. Whole texts go through Python workers in batches of ``BATCH`` rows.

Cases: a null or empty text has no language and goes with the first stage, which a corpus without any labelled text
leaves empty; repeated rows and ids are rows of their own, of which near-duplicates keep one (by id, then any); rows without an
id stay, told apart by numbers of their own; an empty table and an empty benchmark give an empty result and no leak; further
columns are carried to the last stage; texts may be of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bm25, bpe, jaccard, langid, repeats
from tallyloom.llm.common import table
from tallyloom.sources.workspace import stage

BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: a text is some kilobytes, and each of an executor's tasks holds a few batches.
BATCH = 1_000
#: Texts whose n-grams are further from every profile are no text of a known language.
LEAST_LANGUAGE_SCORE = 0.25


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH`` rows, if they are larger."""
    if int(spark.conf.get(BATCHES)) > BATCH:
        spark.conf.set(BATCHES, BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or far from every language learned from the labelled rows."""
    small_batches(spark)
    profiles = langid.learn(docs.where(~langid.held_out()))
    return langid.recognised(docs, profiles, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    small_batches(spark)
    return jaccard.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte that a repeat of 100 bytes or more covers; all documents stay."""
    small_batches(spark)
    return repeats.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return bm25.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Language profiles, near-duplicate groups and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
