"""URL filters: a blocked Bloom filter in front of an exact hash join.

Rules are canonical URLs: a host (which stands for itself and its subdomains) and the beginning of a
path.  For every page the candidate keys are its host's suffixes with as many labels, joined to its
path's prefixes with as many characters, as some rule has.  The Bloom filter of the rules' keys has
blocks of 512 bits, so a test touches one block; its size is bounded and only the rate of false hits
grows with a longer list.  What passes goes to an exact hash join with the rules, which removes false
hits; the longest rule wins.

Defined results: null urls and urls without ``://`` have an empty host and path, and fit no rule;
pages that no rule fits get ``DEFAULT``; very long urls are read whole; repeated pages, and pages without a
page_id, are judged each; an empty table gives an empty result; equal rules must agree on
their verdict, else the smaller verdict in code point order holds; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "allow"
#: Bits a rule gets in the filter; words of 64 bits in a block; the most blocks (64 MB).
BITS, WORDS, MOST_BLOCKS = 16, 8, 1 << 20
#: The rules of the contract (fixed values): host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(of: Column) -> Column:
    return F.length(of) - F.length(F.replace(of, F.lit("."), F.lit(""))) + 1


class BlockedBloom:
    """Word ``k`` of a key's block has one bit of the key set; the block comes from the hash's high bits."""

    def __init__(self, keys: DataFrame, n: int):
        self.blocks = 1
        while self.blocks * 64 * WORDS < n * BITS and self.blocks < MOST_BLOCKS:
            self.blocks *= 2
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        words = keys.select(F.xxhash64("key").alias("h")).groupBy(self._block(F.col("h")).alias("block")).agg(*[F.bit_or(bit(k)).alias(f"w{k}") for k in range(WORDS)])
        made = words.toArrow()  # executors merge the keys of a block; one row a block, so MOST_BLOCKS bounds them
        self.table = np.zeros((self.blocks, WORDS), np.int64)
        self.table[made["block"].to_numpy()] = np.column_stack([made[f"w{k}"].to_numpy() for k in range(WORDS)])

    def _block(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 48).bitwiseXOR(F.shiftrightunsigned(h, 28)).bitwiseAND(F.lit(self.blocks - 1)).cast("int")

    def test(self, spark: SparkSession, hashes: Column) -> Column:
        """For an array of hashes, whether each may be of a listed key."""
        table, blocks = spark.sparkContext.broadcast(self.table), self.blocks

        @F.pandas_udf("array<boolean>")
        def may_be_listed(column: pd.Series) -> pd.Series:
            sizes = column.map(len).to_numpy()
            h = np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64).view(np.uint64)
            block = ((h >> np.uint64(48)) ^ (h >> np.uint64(28))) & np.uint64(blocks - 1)
            word = table.value[block.astype(np.int64)].view(np.uint64)
            bit = (h[:, None] >> np.arange(0, 6 * WORDS, 6, dtype=np.uint64)) & np.uint64(63)
            hit = ((word >> bit) & np.uint64(1)).all(axis=1)
            return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

        return may_be_listed(hashes)


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    spark = pages.sparkSession
    listed = (
        rules.select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
        .groupBy("key")
        .agg(F.min("verdict").alias("verdict"), F.first("host").alias("host"), F.first("path").alias("path"))
    )
    # the few forms that rules have, not the rules: label counts times path lengths
    shapes = sorted(tuple(r) for r in listed.select(_labels(F.col("host")), F.length("path")).distinct().collect())
    bloom = BlockedBloom(listed, listed.count())
    page_host, page_path = F.col("host"), F.col("path")
    numbers = lambda k: F.split(F.lit(",".join(str(x[k]) for x in shapes)), ",").cast("array<int>")  # noqa: E731  constants, one expression for all shapes

    def form(labels: Column, length: Column) -> Column:
        fits = (_labels(page_host) >= labels) & (F.length(page_path) >= length)
        return F.when(fits, F.concat(F.call_function("substring_index", page_host, F.lit("."), -labels), F.substr(page_path, F.lit(1), length)))

    forms = F.when(page_host != "", F.zip_with(numbers(0), numbers(1), form)) if shapes else F.lit(None)
    forms = F.coalesce(forms, F.array().cast("array<string>"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    places = parsed.select("host", "path").distinct().withColumn("keys", F.filter(forms, lambda k: k.isNotNull()))
    tested = places.withColumn("hits", bloom.test(spark, F.transform("keys", lambda k: F.xxhash64(k))))
    passed = tested.select(
        "host", "path", F.explode(F.filter(F.arrays_zip("keys", "hits"), lambda x: x["hits"])["keys"]).alias("key")
    )
    best = (
        passed.join(listed.select("key", "verdict").hint("shuffle_hash"), "key")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("key", "verdict"), F.length("key")).alias("best"))
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict")
    )


SQL = """
WITH r(host, path, verdict) AS (VALUES {rules}),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
b AS (
  SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, '{default}') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
""".format(
    rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES),
    upper=string.ascii_uppercase,
    lower=string.ascii_lowercase,
    default=DEFAULT,
)
