"""Hashed embeddings, similarity and bounded boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import SPACE, normalise
from ..operators import history
from ..plans.semantic import boosted
from ..registry import query, table
from .scoring import _SCORED, scored_documents

_NORM = "lower(trim(regexp_replace(coalesce({0}, ''), '" + SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')))"


_SLOT = "CAST(CAST('0x' || substr(sha256({0}), 1, 5) AS INT) % 1024 AS INT) AS slot, CASE WHEN CAST('0x' || substr(sha256({0}), 6, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS sign"


@query(
    "token_hash_embed",
    f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS w FROM benchmark), p AS (SELECT item_id, {_SLOT.format('w')} FROM t)
SELECT item_id, slot, CAST(sum(sign) AS BIGINT) AS n FROM p GROUP BY ALL HAVING sum(sign) <> 0""",
)
def token_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed hashed bags of words, a row for each filled slot."""
    return vectors.bag(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    "text_hash_embed",
    f"""WITH d AS (SELECT doc_id, md5({_NORM.format('text')}) AS h FROM documents)
SELECT doc_id, CAST('0x' || substr(md5(h || '/1'), 1, 6) AS INT) / 16777216.0::DOUBLE AS first, CAST('0x' || substr(md5(h || '/12'), 1, 6) AS INT) / 16777216.0::DOUBLE AS last FROM d""",
)
def text_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", vectors.text_vector(F.col("text")).alias("v"))
    return d.select("doc_id", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))


@query(
    "cosine_to_profile",
    """WITH p AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, p""",
)
def cosine_to_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every vector to one profile vector, a row that is broadcast."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    profile = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(F.broadcast(profile)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


_PROFILE = "the and of with this for that"


@query(
    "semantic_boost",
    f"""WITH {_SCORED}, g AS (SELECT doc_id, final_score, text, row_number() OVER (ORDER BY final_score DESC, doc_id) AS rank FROM f),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS w FROM g WHERE rank <= 100),
v AS (SELECT doc_id, slot, sum(sign)::DOUBLE AS n FROM (SELECT doc_id, {_SLOT.format('w')} FROM w) GROUP BY ALL),
q AS (SELECT slot, sum(sign)::DOUBLE AS m FROM (SELECT {_SLOT.format('t')} FROM (SELECT unnest(string_split('{_PROFILE}', ' ')) AS t)) GROUP BY 1),
y AS (SELECT v.doc_id, sum(n * coalesce(m, 0)) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(m * m)) FROM q)) AS sim FROM v LEFT JOIN q USING (slot) GROUP BY v.doc_id),
z AS (SELECT g.doc_id, final_score, rank <= 100 AS evaluated, CASE WHEN rank <= 100 THEN round(coalesce(sim, 0), 6) END AS similarity FROM g LEFT JOIN y USING (doc_id)),
l AS (SELECT *, coalesce(8.0::DOUBLE * greatest(0.0::DOUBLE, similarity - 0.25::DOUBLE) / (1 - 0.25::DOUBLE), 0) AS lift FROM z)
SELECT doc_id, evaluated, CASE WHEN NOT evaluated THEN 'beyond_top' WHEN lift > 0 THEN 'boosted' ELSE 'below_threshold' END AS reason, final_score AS base_score, similarity, round(lift, 6) AS boost,
  CAST(greatest(0, least(100, round_even(final_score + lift, 0))) AS INT) AS boosted_score FROM l""",
)
def semantic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 100 rows are embedded; their score rises by 8 at most, and every row says why."""
    rows = scored_documents(spark, sf_dir).select("doc_id", "final_score", "text")
    return boosted(rows, "doc_id", "final_score", "text", _PROFILE, k=100, threshold=0.25, most=8.0, texts=table(spark, sf_dir, "documents"))


@query(
    "cache_lookup",
    f"""WITH c AS (SELECT DISTINCT sha256({_NORM.format('text')}) AS key, length(text) AS value FROM documents WHERE doc_id % 3 = 0),
u AS (SELECT key, min(value) AS value FROM c GROUP BY key), r AS (SELECT doc_id, value IS NOT NULL AS hit FROM documents d LEFT JOIN u ON u.key = sha256({_NORM.format('d.text')}))
SELECT hit, count(*) AS n, min(doc_id) AS first_doc FROM r GROUP BY hit""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a content-hash cache; misses are computed in the same plan."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalise(F.col("text")), 256).alias("key"), F.length("text").alias("n"))
    cache = d.where("doc_id % 3 = 0").groupBy("key").agg(F.min("n").alias("value"))
    out = history.cached(d, cache, "key", F.col("value").isNotNull(), "value", F.col("n"))
    return out.groupBy("hit").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "semantic_sidecar",
    """WITH p AS (SELECT unnest(['long', 'first']) AS profile), r AS (SELECT profile, doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY profile ORDER BY CASE profile WHEN 'long' THEN -n_chars ELSE doc_id END, doc_id) AS i FROM documents, p),
k AS (SELECT * FROM r WHERE i <= 300), a AS (SELECT DISTINCT t FROM k WHERE profile = 'long'), b AS (SELECT DISTINCT k.t, a.t IS NOT NULL AS hit FROM k LEFT JOIN a ON a.t = k.t WHERE profile = 'first'),
c AS (SELECT 'long' AS profile, (SELECT count(*) FROM a) AS missing, 0 AS hit, (SELECT count(*) FROM k WHERE profile = 'long') AS rows UNION ALL SELECT 'first', count(*) FILTER (NOT hit), count(*) FILTER (hit), (SELECT count(*) FROM k WHERE profile = 'first') FROM b),
u AS (SELECT profile, unnest([('hit', hit), ('missing', missing), ('outdated', 0), ('rows', rows), ('written', missing)]) AS x FROM c)
SELECT profile, x[1] AS counter, x[2]::BIGINT AS n FROM u UNION ALL SELECT 'all', x[1], sum(x[2])::BIGINT FROM u GROUP BY x[1]""",
)
def semantic_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two profiles' first documents through one cache: its counters by profile and for all."""
    from ..interfaces import FolderCache, TextHashBackend
    from ..plans.semantic import merged, sidecar
    from ..session import working_folder

    docs, cached = table(spark, sf_dir, "documents"), FolderCache(working_folder(spark, "vectors"))
    orders = {"long": [F.desc("n_chars"), F.asc("doc_id")], "first": [F.asc("doc_id")]}
    artifacts = [(profile, *sidecar(docs, "doc_id", "text", order, 300, TextHashBackend(), cached)) for profile, order in orders.items()]
    return merged(artifacts, spark)[1]


class _Counting:
    """Answers from a text's own length; none for every third length, and none that is JSON for every fifth."""

    name = "counting"

    def answers(self, texts: list[str]) -> list[str | None]:
        return [None if len(t) % 3 == 0 else "broken" if len(t) % 5 == 0 else f'{{"kind": "by answer", "size": "{len(t)}", "tags": "n{len(t) % 2}, x"}}' for t in texts]


@query(
    "augmented_records",
    """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), p AS (SELECT doc_id, n, n % 3 = 0 OR n % 5 = 0 AS ruled FROM d)
SELECT doc_id, CASE WHEN ruled THEN 'by rule' ELSE 'by answer' END AS kind, least(1000, n)::INT AS size, CASE WHEN ruled THEN 'rule,x' ELSE 'n' || n % 2 || ',x' END AS tags,
  (CASE WHEN NOT ruled AND n % 2 = 1 THEN 2 ELSE 0 END + 1) * 100 // 3 AS score FROM p""",
)
def augmented_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a provider's answers, rules where it has none, and a score of how they match."""
    from ..interfaces import FolderCache
    from ..plans.augment import augmented, match_score
    from ..session import working_folder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = F.concat(F.lit('{"kind": "by rule", "tags": ["rule", "x"], "size": '), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("}"))
    out, _ = augmented(docs, _Counting(), FolderCache(working_folder(spark, "answers")), "text", 1, ruled, ["kind"], {"size": (0, 1000)}, ["tags"])
    return out.select("doc_id", "payload.kind", "payload.size", F.array_join("payload.tags", ",").alias("tags"), match_score(["n1"], ["x"], F.col("payload.tags")).alias("score"))
