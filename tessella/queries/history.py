"""As-of lookups, rollups, retention and islands over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc
from ..operators import history
from ..registry import query, table


@query(
    "asof_latest_before",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_run
FROM events""",
)
def asof_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest purchase before each event; the event id settles equal times."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("run"), "event_type")
    found = history.as_of(e.select("event_id", "user_id", "at"), e, "user_id", "at", "run", F.col("event_type") == "purchase")
    return found.select("event_id", "prior_run")


@query(
    "previous_run",
    "SELECT event_id, lag(event_id) OVER w AS previous, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", F.lag("event_id").over(w).alias("previous"), F.floor((micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1000000).alias("gap_s"))


@query(
    "latest_complete_run",
    """SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'click') ORDER BY ts DESC, user_id DESC LIMIT 1""",
)
def latest_complete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return history.latest_with_all(e, "user_id", "event_type", ["purchase", "click"], "ts")


@query(
    "daily_rollup",
    """SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DECIMAL(18, 6)) AS total FROM events GROUP BY ALL""",
)
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd"))


@query(
    "isoweek_rollup",
    """SELECT strftime(ts, '%G-W%V') AS period, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DECIMAL(18, 6)) AS total FROM events GROUP BY ALL""",
)
def isoweek_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, misc.iso_week(F.col("ts")))


def _rollup(spark: SparkSession, sf_dir: str, period) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(period.alias("period"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(18,6)").alias("total"))


@query(
    "rolling_last7",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7)
SELECT event_type, count(*) AS days, sum(n)::BIGINT AS total, string_agg(CAST(n AS VARCHAR), ',' ORDER BY day) AS series FROM k GROUP BY event_type""",
)
def rolling_last7(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return history.rolling(days, "event_type", "day", "n", 7)


@query("retention_keep_n", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS nth FROM events QUALIFY nth <= 3")
def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).drop("ts")


@query("latest_per_day", "SELECT CAST(ts AS DATE) AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "prune_plan",
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders)
SELECT o_custkey, o_orderkey, CAST(nth AS INT) AS nth, nth > 1 AND (nth > 10 OR o_orderdate < now - INTERVAL 900 DAY) AS prune FROM r, m""",
)
def prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By count or age; the newest of each customer always stays. The reference time is a one-row aggregate."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    now = o.agg(F.max("o_orderdate").alias("now"))
    rows = history.prune_plan(o.join(F.broadcast(now)), "o_custkey", "o_orderdate", "o_orderkey", 10, F.col("now"), 900)
    return rows.select("o_custkey", "o_orderkey", "nth", "prune")


@query("list_runs", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS rank FROM orders QUALIFY rank <= 50")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 latest runs; a caller's limit is kept between 1 and 1,000."""
    from ..operators.ranking import top

    limit = max(1, min(1000, 50))
    return top(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], limit).drop("o_orderdate")


@query(
    "identity_merge",
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS event_type, arg_min(event_id, event_id) AS event_id,
  arg_min(props, event_id) FILTER (props IS NOT NULL AND props <> '') AS props FROM events GROUP BY user_id""",
)
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("_ord", F.col("event_id"))
    return history.merge_identities(e, "user_id", ["event_type"], ["event_id", "props"], "_ord")


@query(
    "circuit_breaker",
    """WITH m AS (SELECT user_id, ts, event_id, event_type = 'error' OR value < 20 AS failed FROM events),
g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS length, min(event_id) AS first_event FROM g WHERE failed GROUP BY user_id, island HAVING count(*) >= 3""",
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more failures in a row, as gaps and islands."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    failed = (F.col("event_type") == "error") | (F.col("value") < 20)
    return history.failure_islands(e, "user_id", ["ts", "event_id"], failed, 3, "event_id").withColumnRenamed("first", "first_event")


@query(
    "stage_durations",
    """SELECT event_type, count(*) AS n, round(sum(d), 3) AS seconds, round(max(d), 3) AS longest FROM (SELECT event_type, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) AS d FROM events)
WHERE d IS NOT NULL GROUP BY event_type""",
)
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each kind of step lasted, up to the user's next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    d = table(spark, sf_dir, "events").select("event_type", (F.lead(t).over(w) - t).alias("d")).where("d IS NOT NULL")
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("d") / 1e6, 3).alias("seconds"), F.round(F.max("d") / 1e6, 3).alias("longest"))


@query(
    "stream_last_seen",
    """WITH e AS (SELECT user_id, ts, CAST(floor(value) AS INT) AS score, event_type AS content, event_id % 2 AS batch FROM events),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY batch, user_id ORDER BY ts DESC, score DESC, content DESC) = 1),
j AS (SELECT b.user_id, p.user_id IS NULL AS fresh, b.score - p.score AS moved, b.content <> p.content AS other FROM l b LEFT JOIN l p ON p.batch = 0 AND p.user_id = b.user_id WHERE b.batch = 1)
SELECT 0 AS batch, user_id, 'new' AS kind, NULL::INT AS score_delta FROM l WHERE batch = 0 UNION ALL SELECT 1, user_id, 'new', NULL FROM j WHERE fresh
UNION ALL SELECT 1, user_id, 'score', moved FROM j WHERE abs(moved) >= 10 UNION ALL SELECT 1, user_id, 'content', NULL FROM j WHERE other""",
)
def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of two batches, even ids first: alerts of each batch against the state before it."""
    from ..session import working_folder
    from ..streaming.last_seen import follow

    at, events = working_folder(spark, "last-seen"), table(spark, sf_dir, "events")
    for batch in (0, 1):  # the files that have come since the last run make its batch
        events.where(F.col("event_id") % 2 == batch).write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        rows = rows.select("user_id", "ts", F.floor("value").cast("int").alias("score"), F.col("event_type").alias("content"))
        follow(rows, "user_id", "ts", "score", "content", 10, f"{at}/alerts", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/alerts").select("batch", "user_id", "kind", "score_delta")


@query(
    "baseline_resolution",
    """WITH u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'purchase' AND value > 95 GROUP BY 1),
c AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'click' AND value > 90 GROUP BY 1), l AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT u.user_id, coalesce(p.v, c.v, l.v) AS value, CASE WHEN p.v IS NOT NULL THEN 'pointer' WHEN c.v IS NOT NULL THEN 'complete' WHEN l.v IS NOT NULL THEN 'latest' ELSE 'none' END AS found_by
FROM u LEFT JOIN p USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN l USING (user_id)""",
)
def baseline_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run to compare with: what a pointer names, else the last complete run, else the latest one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    last = lambda keep: e.where(keep).groupBy("user_id").agg(F.max("event_id").alias("v"))
    lookups = [("pointer", last("event_type = 'purchase' AND value > 95"), "v"), ("complete", last("event_type = 'click' AND value > 90"), "v"), ("latest", last("event_id % 2 = 0"), "v")]
    return history.first_found(e.select("user_id").distinct(), "user_id", lookups)


@query(
    "run_guards",
    """WITH m AS (SELECT event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DECIMAL(18, 6)) AS spent, count(*) FILTER (value > 99) AS fresh FROM events GROUP BY 1)
SELECT event_type, array_to_string(list_sort(list_filter([CASE WHEN calls > 1500 THEN 'too_many_calls' END, CASE WHEN spent > 60000 THEN 'over_budget' END], lambda x: x IS NOT NULL)), ',') AS guards,
  fresh > 0 AND NOT (calls > 1500 OR spent > 60000) AS notify FROM m""",
)
def run_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits on a run's totals, and whether its news are sent: only if there are any and no guard holds."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,6)")).alias("spent"), F.count_if(F.col("value") > 99).alias("fresh"))
    guards = misc.codes([("too_many_calls", F.col("calls") > 1500), ("over_budget", F.col("spent") > 60000)])
    return m.select("event_type", F.array_join(guards, ",").alias("guards"), ((F.col("fresh") > 0) & (F.size(guards) == 0)).alias("notify"))


_GONE_S = 86_400


@query(
    "stream_keyed_state",
    f"""WITH e AS (SELECT user_id, ts, CAST(floor(value) AS INT) AS score, event_type AS content, epoch_us(ts) AS us FROM events),
b AS (SELECT *, (us // 1000000 - lo) * 3 // (hi - lo + 1) AS run FROM e, (SELECT min(us) // 1000000 AS lo, max(us) // 1000000 AS hi FROM e)),
w AS (SELECT run, max(us) // 1000 AS mark FROM b GROUP BY run),
l AS (SELECT *, us // 1000 + {_GONE_S * 1000} AS ends FROM b QUALIFY row_number() OVER (PARTITION BY run, user_id ORDER BY ts DESC, score DESC, content DESC) = 1),
p AS (SELECT l.*, lag(l.score) OVER u AS old_score, lag(l.content) OVER u AS old_content, lag(l.ends) OVER u AS old_ends, lead(l.run) OVER u AS next_run FROM l WINDOW u AS (PARTITION BY user_id ORDER BY run)),
s AS (SELECT p.*, coalesce(old_ends > w.mark, false) AS alive FROM p LEFT JOIN w ON w.run = p.run - 1)
SELECT user_id, 'new' AS kind, ts AS at, NULL::INT AS score_delta FROM s WHERE NOT alive
UNION ALL SELECT user_id, 'score', ts, score - old_score FROM s WHERE alive AND abs(score - old_score) >= 10
UNION ALL SELECT user_id, 'content', ts, NULL FROM s WHERE alive AND content <> old_content
UNION ALL SELECT user_id, 'gone', ts, NULL FROM s WHERE exists (SELECT 1 FROM w WHERE w.run >= s.run AND w.run < coalesce(s.next_run, 99) AND s.ends <= w.mark)""",
)
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of three spans of time, the query stopped and started between them: alerts against state by key.

    Keys that are not seen for a day are forgotten by a timer, and new when they come back.
    """
    from ..session import working_folder
    from ..streaming.keyed_state import append, last_seen

    at, events = working_folder(spark, "keyed-state"), table(spark, sf_dir, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    bounds = events.agg(F.min(F.floor(s)).alias("lo"), F.max(F.floor(s)).alias("hi"))
    run = F.floor((F.floor(s) - F.col("lo")) * 3 / (F.col("hi") - F.col("lo") + 1))
    spans = events.join(F.broadcast(bounds)).withColumn("run", run).select(events.columns + ["run"])  # one row
    for k in range(3):
        spans.where(F.col("run") == k).drop("run").write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("int").alias("score"), F.col("event_type").alias("content"))
        append(last_seen(rows, "user_id", "ts", "score", "content", 10, _GONE_S * 1000), f"{at}/alerts", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/alerts").withColumn("at", F.col("at").cast(events.schema["ts"].dataType))


@query(
    "stream_rank_moves",
    """WITH r AS (SELECT o_custkey AS item, (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders)) % 3 AS run, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY ALL),
n AS (SELECT item, CAST(run AS INT) AS run, row_number() OVER (PARTITION BY run ORDER BY total DESC, item) AS rank FROM r)
SELECT item, run, rank, lag(rank) OVER (PARTITION BY item ORDER BY run) AS previous_rank, lag(rank) OVER (PARTITION BY item ORDER BY run) - rank AS move FROM n""",
)
def stream_rank_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by their orders in three runs: each run's ranks against the ranks kept from the runs before."""
    from ..operators.ranking import positions
    from ..session import working_folder
    from ..streaming.keyed_state import append, rank_moves

    at, orders = working_folder(spark, "rank-moves"), table(spark, sf_dir, "orders")
    first = orders.agg(F.min(F.year("o_orderdate")).alias("y"))
    run = ((F.year("o_orderdate") - F.col("y")) % 3).alias("run")
    totals = orders.join(F.broadcast(first)).groupBy(F.col("o_custkey").alias("item"), run).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    ranked = positions(totals, ["run"], [F.desc("total"), F.asc("item")], "place").select("item", "run", (F.col("place") + 1).alias("rank"))
    for k in range(3):
        ranked.where(F.col("run") == k).write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(ranked.schema).parquet(f"{at}/in")
        append(rank_moves(rows, "item", "run", "rank"), f"{at}/moves", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/moves")
