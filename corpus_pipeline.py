"""The corpus pipeline: five stages of the llm subpackage applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir), works on every document that its
predecessor kept, and returns a DataFrame; all but the last return the columns
of ``docs``.  Nulls, empty and very long texts, repeated rows, empty tables and
extra columns have the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lograil.llm import bpe, decontaminate, line_dedup, near_dedup, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, doesn't reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; documents made of such lines alone go."""
    return line_dedup.without_lines(docs, line_dedup.line_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near copies, and all others."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``; documents made mostly of them go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, round_trip) of each document."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: A trained model, an approximate join and BPE merges: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table; each stage's output is written and read again by the next."""
    from lograil.llm.storage import Tables

    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = tables.write(f"stage{i}", docs)
            if i:
                tables.drop(f"stage{i - 1}")
    return docs
