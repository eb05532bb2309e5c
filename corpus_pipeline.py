"""A training corpus from ``documents``: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of ``documents``, those of unknown names too.

Defined results: null and empty texts go with the quality rules; rows without a doc_id are linked with no others and are
mixed and written like all; rows that repeat a doc_id stay or go together in the near-duplicate stage; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factledger.llm import decontamination, mixing, near_dedup, quality, tokens
from factledger.llm.common import cut, table
from factledger.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in 13-word windows of benchmark items go."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), how="drop")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight gives, at most twice."""
    return mixing.emit(docs, weights=(3, 1, 2), budget=1.5, most=2)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards; what the files say of each document."""
    return tokens.read(tokens.write(docs.select("doc_id", "text"), tokenizer_path(), end_id=2))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Fitted trees and a tokenizer are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
