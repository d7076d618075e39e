"""Publishing, observed writes, the registry of runs, and providers as tables and streams."""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache
from ..registry import query, table
from ..session import working_folder
from ..sources import publishing, replay, snapshots


@query(
    "publish_latest",
    """SELECT 'r3' AS latest, p_partkey, p_name, p_brand FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'r1', p_partkey, p_name, p_brand FROM part""",
)
def publish_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of the latest run see: after a good run, after a run of which a task failed (the good one still), and after the next."""
    base = working_folder(spark, "published")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    seen = lambda: publishing.published(spark, base).withColumn("latest", F.lit(publishing.latest_run(spark, base)))
    publishing.publish(part, base, "r1")
    broken = F.when(F.col("p_partkey") % 7 == 3, F.raise_error(F.lit("a task that fails"))).otherwise(F.col("p_name"))
    try:
        publishing.publish(part.withColumn("p_name", broken), base, "r2")
    except PySparkException:
        after_failure = seen()  # its files stay when later runs come
    publishing.publish(part.where("p_partkey % 2 = 0"), base, "r3")
    return after_failure.unionByName(seen()).select("latest", "p_partkey", "p_name", "p_brand")


@query(
    "run_health",
    """WITH m AS (SELECT 'documents' AS stage, [('rows', count(*)), ('blank', count(*) FILTER (trim(coalesce(text, '')) = '')), ('chars', sum(length(coalesce(text, ''))))] AS l FROM documents
UNION ALL SELECT 'events', [('rows', count(*)), ('errors', count(*) FILTER (value < 10)), ('users', max(user_id))] FROM events),
v AS (SELECT stage, unnest(l) AS x FROM m)
SELECT stage, x[1] AS metric, CAST(x[2] AS DOUBLE) AS value, CASE WHEN x[1] = 'rows' AND x[2] < 100000000 THEN 'least 1e+08' WHEN x[1] = 'errors' AND x[2] > 5 THEN 'most 5' END AS problem FROM v
UNION ALL SELECT 'pages', 'rows', NULL, 'not observed'""",
)
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that writing jobs collected on their way, against limits."""
    at = working_folder(spark, "health")
    x = F.coalesce("text", F.lit(""))
    documents = {"rows": F.count("*"), "blank": F.count_if(F.trim(x) == ""), "chars": F.sum(F.length(x))}
    events = {"rows": F.count("*"), "errors": F.count_if(F.col("value") < 10), "users": F.max("user_id")}
    stages = [(name, publishing.write_observed(table(spark, sf_dir, name), f"{at}/{name}", m)) for name, m in (("documents", documents), ("events", events))]
    return publishing.health(spark, stages, [("documents", "rows", "least", 1e8), ("events", "rows", "least", 1e8), ("events", "errors", "most", 5), ("pages", "rows", "least", 1)])


@query(
    "run_summary",
    """WITH m AS (SELECT count(*) FILTER (c_acctbal < 0) AS negative, count(*) AS n FROM customer) SELECT 'customer' AS stage, 2::BIGINT AS metrics, CASE WHEN negative > 0 THEN 1 ELSE 0 END::BIGINT AS problems,
  CASE WHEN negative > 0 THEN 'failed' ELSE 'ok' END AS status FROM m UNION ALL SELECT 'supplier', 1, 0, 'ok'""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stage: metrics, problems, status."""
    at = working_folder(spark, "summary")
    customer = publishing.write_observed(table(spark, sf_dir, "customer"), f"{at}/c", {"rows": F.count("*"), "negative": F.count_if(F.col("c_acctbal") < 0)})
    supplier = publishing.write_observed(table(spark, sf_dir, "supplier"), f"{at}/s", {"rows": F.count("*")})
    limits = [("customer", "negative", "most", 0), ("supplier", "rows", "least", 1)]
    return publishing.summary(publishing.health(spark, [("customer", customer), ("supplier", supplier)], limits))


@query(
    "run_registry",
    """WITH r AS (SELECT event_type AS owner, strftime(ts, 'r%Y%m%d') AS run, max(ts) AS at, count(*) AS rows, bool_or(value > 95) AS complete FROM events GROUP BY ALL),
p AS (SELECT owner, min(run) AS run FROM r WHERE owner IN ('click', 'view') GROUP BY owner),
o AS (SELECT r.owner, max(CASE WHEN r.run = p.run THEN r.run END) AS pointed, arg_max(r.run, r.at) FILTER (complete) AS done FROM r LEFT JOIN p ON p.owner = r.owner GROUP BY r.owner)
SELECT how, owner, coalesce(pointed, done) AS run, CASE WHEN pointed IS NOT NULL THEN 'pointer' WHEN done IS NOT NULL THEN 'complete' ELSE 'none' END AS found_by
FROM o, (SELECT unnest(['files', 'read', 'rebuilt', 'rebuilt damaged']) AS how)""",
)
def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by owner resolved from the files, from the index, from an index that was missing, and from one that was damaged: all equal."""
    base = working_folder(spark, "registry")
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("owner"), F.date_format("ts", "'r'yyyyMMdd").alias("run"))
    runs = runs.agg(F.max("ts").cast("timestamp").alias("at"), F.count("*").alias("rows"), F.bool_or(F.col("value") > 95).alias("complete"))
    runs.repartition("owner").write.partitionBy("owner", "run").json(f"{base}/runs")
    pointers = runs.where("owner IN ('click', 'view')").groupBy("owner").agg(F.min("run").alias("run"))
    found, out = {}, None
    found["files"] = publishing.scan_runs(spark, base)
    index, how = publishing.read_index(spark, base)  # there is none yet
    found[how] = index
    index, how = publishing.read_index(spark, base)
    found[how] = index
    broken = f"{base}/broken"
    publishing.write_index(found["files"], broken)
    found["files"].select("owner", "run", F.lit("x").alias("rows"), "complete").write.mode("append").partitionBy("owner").parquet(f"{broken}/index")  # another kind of rows
    runs.write.partitionBy("owner", "run").json(f"{broken}/runs")
    index, how = publishing.read_index(spark, broken)
    found[f"{how} damaged"] = index
    for how, index in found.items():
        rows = publishing.resolve(index, pointers).select(F.lit(how).alias("how"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "registry_update",
    """WITH r AS (SELECT event_type AS owner, strftime(ts, 'r%Y%m%d') AS run, count(*) AS rows FROM events GROUP BY ALL) SELECT owner, count(*) AS runs, sum(CASE WHEN owner = 'click' THEN 2 * rows ELSE rows END)::BIGINT AS rows FROM r GROUP BY owner""",
)
def registry_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's part of the index is replaced; the others' stay."""
    base = working_folder(spark, "registry")
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("owner"), F.date_format("ts", "'r'yyyyMMdd").alias("run"))
    runs = runs.agg(F.max("ts").cast("timestamp").alias("at"), F.count("*").alias("rows"), F.lit(True).alias("complete"))
    publishing.write_index(runs, base)
    publishing.write_index(runs.where("owner = 'click'").withColumn("rows", F.col("rows") * 2), base)
    index, _ = publishing.read_index(spark, base)
    return index.groupBy("owner").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))


def _recorded(spark: SparkSession, rows: DataFrame, by: str, at: str, version: int) -> None:
    """Writes ``rows`` as snapshot number ``version`` of the provider that each row's ``by`` names."""
    folder = F.concat(F.lit("p"), F.col(by).cast("string"))
    rows.withColumns({"provider": folder, "version": F.lit(version)}).repartition("provider").write.mode("append").partitionBy("provider", "version").json(at)


def _providers(spark: SparkSession, at: str) -> dict:
    """A provider for each nation, from their configuration; nation 0 is disabled."""
    config = snapshots.load_config(json.dumps([{"id": f"p{k}", "folder": f"{at}/provider=p{k}", "enabled": k > 0} for k in range(25)]))
    return snapshots.configured(config)


@query(
    "provider_pushdown",
    """SELECT 'p' || s_nationkey AS provider, count(*) AS n, min(s_suppkey) AS first_id, max(s_name) AS last_name FROM supplier WHERE s_nationkey IN (3, 7, 11) GROUP BY 1""",
)
def provider_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers of 24 are read: the filter reaches the source and leaves a partition for each."""
    at = working_folder(spark, "providers")
    _recorded(spark, table(spark, sf_dir, "supplier"), "s_nationkey", at, 0)
    snapshots.register(spark, _providers(spark, at))
    rows = spark.read.format("provider").load().where(F.col("provider").isin("p3", "p7", "p11", "p0"))
    get = lambda name, kind: F.get_json_object("record", f"$.{name}").cast(kind)
    return rows.groupBy("provider").agg(F.count("*").alias("n"), F.min(get("s_suppkey", "long")).alias("first_id"), F.max(get("s_name", "string")).alias("last_name"))


@query(
    "provider_stream",
    """SELECT 'p' || c_nationkey AS provider, c_custkey % 3 AS version, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_nationkey > 0 GROUP BY ALL""",
)
def provider_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as they are recorded, as a stream that stops and starts between them: each comes once."""
    at, customer = working_folder(spark, "provider-stream"), table(spark, sf_dir, "customer")
    for version in range(3):
        _recorded(spark, customer.where(F.col("c_custkey") % 3 == version), "c_nationkey", f"{at}/in", version)
        snapshots.register(spark, _providers(spark, f"{at}/in"))
        stream = spark.readStream.format("provider").load()
        writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    key = F.get_json_object("record", "$.c_custkey").cast("long")
    return spark.read.parquet(f"{at}/out").groupBy("provider", (key % 3).alias("version")).agg(F.count("*").alias("n"), F.sum(key).alias("ids"))


@query(
    "cache_versions",
    """WITH k AS (SELECT sha256(lower(trim(coalesce(text, '')))) AS k, doc_id % 3 = 0 AS early, doc_id % 3 = 1 AS late FROM documents),
c AS (SELECT k, bool_or(early) AS early, bool_or(late) AS late FROM k GROUP BY k)
SELECT 1 AS run, 0 AS hit, count(*) FILTER (early) AS missing, 0 AS outdated, count(*) FILTER (early) AS written FROM c
UNION ALL SELECT 2, count(*) FILTER (early), count(*) FILTER (NOT early), 0, count(*) FILTER (NOT early) FROM c
UNION ALL SELECT 3, count(*), 0, 0, 0 FROM c
UNION ALL SELECT 4, 0, 0, count(*) FILTER (late), count(*) FILTER (late) FROM c
UNION ALL SELECT 5, count(*), 0, 0, 0 FROM c""",
)
def cache_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes cached by content through five runs: a third of the documents, all, all again, a raised version for some, all at the first version."""
    path = working_folder(spark, "cache")
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(low, 256).alias("k"), "text")
    runs = [(docs.where("doc_id % 3 = 0"), 1), (docs, 1), (docs, 1), (docs.where("doc_id % 3 = 1"), 2), (docs, 1)]
    found = []
    for number, (rows, version) in enumerate(runs, 1):
        _, counters = cache.refreshed(rows, path, "k", "kind", version, lambda _: F.when(F.length("text") > 500, "long").otherwise("short"))
        found.append((number, *(counters[c] for c in ("hit", "missing", "outdated", "written"))))
    return spark.createDataFrame(found, "run int, hit long, missing long, outdated long, written long")


@query(
    "cached_attributes",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN length(coalesce(text, '')) > 500 THEN 'long' ELSE 'short' END ELSE
  CASE WHEN length(coalesce(text, '')) > 500 THEN 'long' ELSE 'short' END || CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN ',even' ELSE ',filled' END END AS kinds FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT d.doc_id, CASE WHEN length(coalesce(d.text, '')) > 500 THEN 'long' ELSE 'short' END || CASE WHEN e.text IS NULL THEN '' WHEN length(coalesce(d.text, '')) % 2 = 0 THEN ',even' ELSE ',filled' END
FROM documents d LEFT JOIN (SELECT DISTINCT coalesce(text, '') AS text FROM documents WHERE doc_id % 2 = 0) e ON e.text = coalesce(d.text, '') WHERE d.doc_id % 2 = 1""",
)
def cached_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of attributes: made at version 1, at version 2 upgraded by what is new (backfilled where there is nothing) for even documents' contents."""
    path = working_folder(spark, "cache")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    first = F.array(F.when(F.col("n") > 500, "long").otherwise("short"))
    cache.refreshed(docs, path, "k", "kinds", 1, lambda _: first)
    new = F.when(F.col("n") % 2 == 0, F.array_distinct(F.concat("old_kinds", F.array(F.lit("even")))))
    cache.refreshed(docs.where("doc_id % 2 = 0"), path, "k", "kinds", 2, lambda _: new, fallback=F.concat("old_kinds", F.array(F.lit("filled"))))
    out, _ = cache.refreshed(docs, path, "k", "kinds", 1, lambda _: first)
    return out.select("doc_id", F.array_join("kinds", ",").alias("kinds"))


@query(
    "replay_recalc",
    """SELECT * FROM (VALUES ('same', 'input', 'orders', NULL), ('same', 'config', '', NULL), ('same', 'output', 'kept', NULL), ('same', 'output', 'recalculated', NULL),
  ('other', 'input', 'orders', NULL), ('other', 'config', '', 'changed'), ('other', 'output', 'kept', NULL), ('other', 'output', 'recalculated', 'changed')) v(plan, what, name, problem) WHERE (SELECT count(*) FROM orders) > 0""",
)
def replay_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's archived inputs recalculated by the plan that made it, and by one with another parameter."""
    base = working_folder(spark, "replay")

    def plan(least):
        return lambda inputs: inputs["orders"].where(F.col("o_totalprice") > least).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))

    replay.archive(base, "r1", {"orders": table(spark, sf_dir, "orders")}, plan(1000), {"least": 1000})
    same = replay.recalculate(spark, base, "r1", plan(1000), {"least": 1000.0}).select(F.lit("same").alias("plan"), "*")
    other = replay.recalculate(spark, base, "r1", plan(100_000), {"least": 100_000}).select(F.lit("other").alias("plan"), "*")
    return same.unionByName(other)


@query(
    "input_selection",
    """WITH n AS (SELECT count(*) AS docs FROM documents), r(step, name, there, reason) AS (VALUES
  (1, 'answered', false, 'missing'), (1, 'enriched', true, 'chosen'), (1, 'labelled', true, 'enriched comes first'),
  (2, 'answered', false, 'missing'), (2, 'enriched', true, 'older than labelled'), (2, 'labelled', true, 'chosen'),
  (3, 'answered', true, 'off'), (3, 'enriched', true, 'chosen'), (3, 'labelled', true, 'not asked for'))
SELECT step, name, there, reason, CASE WHEN reason = 'chosen' THEN docs END AS n FROM r, n""",
)
def input_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which artifact a run reads: the refined one, the raw one that is newer, the one that is asked for; with what was read."""
    from ..sources import selection

    at, docs, out = working_folder(spark, "artifacts"), table(spark, sf_dir, "documents").select("doc_id", "lang"), None
    candidates = [(n, f"{at}/{n}") for n in ("answered", "enriched", "labelled")]
    steps = [(("labelled", "enriched"), {}), (("labelled",), {}), (("answered",), {"off": {"answered"}, "only": "enriched"})]
    for step, (made, how) in enumerate(steps, 1):
        for name in made:
            docs.write.mode("overwrite").parquet(f"{at}/{name}")
        best, rows = selection.chosen(candidates, **how)
        read = spark.read.parquet(f"{at}/{best}").agg(F.count("doc_id").alias("n"))
        found = selection.explained(spark, rows).select(F.lit(step).alias("step"), "name", "there", "reason").join(F.broadcast(read))  # one row
        found = found.withColumn("n", F.when(F.col("reason") == "chosen", F.col("n")))
        found.write.parquet(f"{at}/step-{step}")  # what was read changes with the next step
        found = spark.read.parquet(f"{at}/step-{step}")
        out = found if out is None else out.unionByName(found)
    return out
