"""The subpackage's queries, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, elkan, exact_dedup, mixing, secrets, simhash, substrings, token_counts, token_files, toxicity, trie, url_filter, vamana
from .shared import load

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(token_counts.lengths(load(spark, sf_dir, "documents"), TOKENIZER))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(load(spark, sf_dir, "documents"), TOKENIZER)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"), largest=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), RANKS, PATTERN)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(load(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.codes(load(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(load(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_simhash_near_dedup,
        op3_url_filter,
        op4_token_counts,
        op5_secret_scan,
        op6_token_files,
        op7_exact_dedup,
        op8_byte_bpe,
        op9_nearest_neighbours,
        op10_source_mixing,
        op11_vector_codes,
        op12_conversation_trie,
        op13_substring_dedup,
    )
}

SQL = {
    "op3_url_filter": url_filter.SQL,
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op11_vector_codes": elkan.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_substring_dedup": substrings.SQL,
}
