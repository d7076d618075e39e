"""The training-data pipeline: raw documents to token counts and checked encodings.

``STAGES`` are applied in order; each stage's rows are written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``, whatever further columns it has and however they are named.

Defined results: a null text counts as empty in every stage; empty and very long texts are read whole; of equal texts the
largest doc_id stays, of near copies the smallest, and rows whose doc_id is null are near copies of none; equal rows are
one document; ties are settled as each stage's module says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tessella.llm.queries import PATTERN, RANKS
from tessella.llm.shared import load, shared_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of near copies, texts that share four fifths of their five-word shingles: op2's links, verified, and the rest (see the README)."""
    return simhash.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their target weights."""
    return mixing.take(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    # executors have grown in the stages before: workers remember less here, and nothing for the next stages
    return bpe.round_trip(docs, RANKS, PATTERN, bpe.FEW_STATES, bpe.FEW_CHUNKS, keep=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("near_dedup", near_dedup_filter),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the machine of the first stage nor the encoding of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
