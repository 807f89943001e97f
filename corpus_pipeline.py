"""The corpus pipeline: documents -> good, unique, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knowloom.llm import exact_dedup, mixing, packing, quality, queries, shared, simhash, tokens


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (similarity of five-word shingles of 0.8 or more) the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped towards the target weights of their sources, in a global random order."""
    return mixing.poisson_mixture(docs).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return packing.pack(docs, queries.vocabulary(queries.WORD_BPE), end_id=1, spaces=tokens.DROPPED)


STAGES = [
    ("quality", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Tokens, fingerprints and a trained model are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written and read again as the next one's input.

    Null texts are empty documents, repeated rows are judged alike and merged by exact dedup, null ids and sources are carried
    like any other value, further columns of ``documents`` pass through all stages but the last. Without documents the
    result is empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
