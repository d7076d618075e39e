"""Hashed embeddings and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalise, tokens

#: Slots of a hashed bag of words.
SLOTS = 1024


def _slot(token: Column) -> Column:
    """struct(slot, sign): the first five hexadecimal digits of a token's SHA-256 give the slot, the sixth's parity the sign."""
    h = F.sha2(token, 256)
    digit = lambda start, n: F.conv(F.substring(h, start, n), 16, 10).cast("int")
    return F.struct((digit(1, 5) % SLOTS).alias("slot"), F.when(digit(6, 1) % 2 == 0, 1).otherwise(-1).alias("sign"))


def bag(rows: DataFrame, key: str, text: str, every: bool = False) -> DataFrame:
    """(key, slot, n): signed token counts by hashed slot, as rows; collisions cancel out in the mean.

    With ``every`` no key is lost: texts without words have a null slot, and slots of 0 stay.
    """
    unnest = F.explode_outer if every else F.explode
    words = rows.select(key, unnest(tokens(F.col(text))).alias("__t")).groupBy(key, "__t").agg(F.count("*").alias("__n"))
    placed = words.select(key, "__n", _slot(F.col("__t")).alias("__s"))
    summed = placed.groupBy(key, F.col("__s.slot").alias("slot")).agg(F.sum(F.col("__n") * F.col("__s.sign")).alias("n"))
    return summed if every else summed.where("n <> 0")


def bag_cosine(rows: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """(key, similarity) of bags to one profile's ``(slot, m)``, which has SLOTS rows at most and is broadcast."""
    norm = profile.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("__q"))
    met = rows.join(F.broadcast(profile), "slot", "left").join(F.broadcast(norm))
    sums = met.groupBy(key).agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("__d"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__n"), F.first("__q").alias("__q"))
    return sums.select(key, F.coalesce(F.try_divide("__d", F.col("__n") * F.col("__q")), F.lit(0.0)).alias("similarity"))


def text_vector(x: Column, dim: int = 12) -> Column:
    """A repeatable vector of a whole normalised text: component i, in [0, 1), comes from its digest hashed with i."""
    part = lambda h, i: F.conv(F.substring(F.md5(F.concat_ws("/", h, i)), 1, 6), 16, 10).cast("double") / (1 << 24)
    return F.transform(F.array(F.md5(normalise(x))), lambda h: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: part(h, i)))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, empty, zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0)
    return F.coalesce(F.when(fits, dot(a, b) / norms), F.lit(0.0))


def boost(similarity: Column, threshold: float, most: float) -> Column:
    """Nothing up to the threshold, then a straight line that reaches ``most`` at 1."""
    return most * F.greatest(F.lit(0.0), similarity - threshold) / (1 - threshold)
