"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import blocks, bm25, bpe, collocations, divergence, jaccard, langid, licenses, prefixes, repeats, substrings, token_counts, warc
from tallyloom.llm.common import table


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents")).select(*divergence.COLUMNS)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(table(spark, folder, "documents"), digest=True)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(table(spark, folder, "documents"))


def op11_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove(table(spark, folder, "documents"), digest=True)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_warc": op2_warc,
        "op3_main_text": op3_main_text,
        "op4_jaccard": op4_jaccard,
        "op5_quality": op5_quality,
        "op6_token_counts": op6_token_counts,
        "op7_licenses": op7_licenses,
        "op8_repeats": op8_repeats,
        "op9_decontamination": op9_decontamination,
        "op10_language": op10_language,
        "op11_substrings": op11_substrings,
        "op12_collocations": op12_collocations,
        "op13_prefixes": op13_prefixes,
        "pipeline": corpus_pipeline.run,
    }


def all_oracles() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op5_quality": divergence.SQL, "op11_substrings": substrings.SQL, "op12_collocations": collocations.SQL}
