"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Language identification, line de-duplication, the Jaccard join, decontamination, tokenization.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodemill.llm import decontaminate, jaccard, langid, lines, pieces
from lodemill.llm.common import Shared
from lodemill.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected."""
    return langid.keep_identified(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that an earlier line resembles, and the documents that lose every word."""
    return lines.drop_lines(docs, lines.learn(docs, Shared.create(spark, "lines")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones, that with the smallest id."""
    return jaccard.keep_first(docs, Shared.create(spark, "jaccard"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    index = decontaminate.build_index(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Shared.create(spark, "benchmark"))
    return decontaminate.drop_contaminated(docs, index)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, and the text decoded from them."""
    return pieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("dedup_lines", dedup_lines),
    ("dedup_documents", dedup_documents),
    ("decontaminate", decontaminated),
    ("encode", encode),
]

#: Learned predictions and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    shared = Shared.create(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.table(docs, f"{k}-{name}")
    return docs
