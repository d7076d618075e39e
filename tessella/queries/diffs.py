"""Snapshot differences: two snapshots of orders, and of lineitem with repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest, normalise
from ..operators import diff, filters
from ..plans import insights
from ..registry import query, table

#: before: keys not divisible by 7; after: keys not divisible by 5, with some fields moved.
_SNAPSHOTS = """
a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(floor(o_totalprice / 1000) AS INT) AS score, o_custkey AS cust FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 13 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS priority,
        CAST(floor(o_totalprice / 1000) AS INT) + CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 17 AS INT) ELSE 0 END AS score, o_custkey AS cust FROM orders WHERE o_orderkey % 5 <> 0)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    score = F.floor(F.col("o_totalprice") / 1000).cast("int")
    before = o.where(key % 7 != 0).select(
        key.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), score.alias("score"), F.col("o_custkey").alias("cust")
    )
    after = o.where(key % 5 != 0).select(
        key.alias("id"), F.when(key % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 13 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"))).otherwise(F.col("o_orderpriority")).alias("priority"),
        (score + F.when(key % 3 == 0, (key % 17).cast("int")).otherwise(0)).alias("score"), F.col("o_custkey").alias("cust"),
    )
    return before, after


def _diff_sql(fields: list[str], clean: str = "{0}", gate: str | None = None) -> str:
    differs = {f: f"({clean.format('a.' + f)} IS DISTINCT FROM {clean.format('b.' + f)})" for f in fields}
    names = ", ".join(f"CASE WHEN {differs[f]} THEN '{f}' END" for f in sorted(fields))
    changed = gate or " OR ".join(differs.values())
    return f"""j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed' WHEN {changed} THEN 'changed' ELSE 'same' END AS kind,
        array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS names FROM a FULL JOIN b ON a.id = b.id),
x AS (SELECT id, kind, CASE WHEN kind = 'changed' THEN names ELSE '' END AS changed_fields FROM j)"""


def _flat(d: DataFrame) -> DataFrame:
    return d.withColumn("changed_fields", F.array_join("changed_fields", ","))


_CLEAN = "lower(trim(CAST({0} AS VARCHAR)))"


def _lowered(c):
    return F.lower(F.trim(c.cast("string")))


@query("snapshot_diff_pipeline", f"WITH {_SNAPSHOTS}, {_diff_sql(['status', 'priority', 'score'], gate='a.status IS DISTINCT FROM b.status')} SELECT * FROM x")
def snapshot_diff_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content column decides what counts as changed; the labels come from all fields."""
    return _flat(diff.diff(*snapshots(spark, sf_dir), "id", ["status", "priority", "score"], gate="status"))


@query(
    "snapshot_diff_report",
    f"WITH {_SNAPSHOTS}, {_diff_sql(['status', 'priority', 'score', 'cust'], _CLEAN)} SELECT id, kind, changed_fields, sha256(concat_ws(chr(31), id, kind, changed_fields)) AS digest FROM x WHERE kind <> 'same'",
)
def snapshot_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields are compared trimmed and in lower case."""
    d = _flat(diff.diff(*snapshots(spark, sf_dir), "id", ["status", "priority", "score", "cust"], _lowered)).where("kind <> 'same'")
    return d.withColumn("digest", digest(F.col("id"), F.col("kind"), F.col("changed_fields")))


_DELTA = ["status", "priority", "score"]
_COUNTS = ", ".join(
    [f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("new", "removed", "changed", "same")]
    + [f"count(*) FILTER (list_contains(string_split(changed_fields, ','), '{f}')) AS changed_{f}" for f in _DELTA]
)


@query("snapshot_diff_delta", f"WITH {_SNAPSHOTS}, {_diff_sql(_DELTA, _CLEAN)} SELECT {_COUNTS} FROM x")
def snapshot_diff_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.delta_counts(*snapshots(spark, sf_dir), "id", _DELTA, _lowered)


@query(
    "delta_grid",
    f"""WITH {_SNAPSHOTS}, j AS (SELECT coalesce(a.cust, b.cust) % 4 AS provider, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed'
  WHEN a.status IS DISTINCT FROM b.status OR a.score IS DISTINCT FROM b.score THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.id = b.id AND a.cust = b.cust)
SELECT provider, kind, count(*) AS n FROM j GROUP BY ALL""",
)
def delta_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every provider in one join, with the provider in the key instead of a loop."""
    keyed = [s.withColumn("k", F.struct("id", F.col("cust"))) for s in snapshots(spark, sf_dir)]
    d = diff.diff(*keyed, "k", ["status", "score"])
    return d.groupBy((F.col("k.cust") % 4).alias("provider"), "kind").agg(F.count("*").alias("n"))


@query(
    "snapshot_diff_weekly",
    f"WITH {_SNAPSHOTS}, {_diff_sql(['status', 'priority', 'score', 'cust'], 'CAST({0} AS VARCHAR)')} SELECT kind, count(*) AS n, array_to_string(list(id ORDER BY id)[1:20], ',') AS first_ids FROM x GROUP BY kind",
)
def snapshot_diff_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind with at most 20 ids, the smallest."""
    d = diff.diff(*snapshots(spark, sf_dir), "id", ["status", "priority", "score", "cust"], lambda c: c.cast("string"))
    n = d.groupBy("kind").agg(F.count("*").alias("n"))
    from ..operators.history import last_n

    first = last_n(d.select("kind", "id"), "kind", [F.asc("id")], 20).groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("first_ids"))
    return n.join(first, "kind")


_ALERTS = """r AS (SELECT b.id, 'new' AS kind, NULL::INT AS score_delta FROM b ANTI JOIN a USING (id) UNION ALL SELECT a.id, 'removed', NULL FROM a ANTI JOIN b USING (id)
  UNION ALL SELECT id, 'score', b.score - a.score FROM a JOIN b USING (id) WHERE abs(b.score - a.score) >= 8
  UNION ALL SELECT id, 'content', NULL FROM a JOIN b USING (id) WHERE sha256(a.status) <> sha256(b.status))"""


@query("alerts", f"WITH {_SNAPSHOTS}, {_ALERTS} SELECT * FROM r")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and removed rows, large moves of the score, changed content."""
    a, b = (s.withColumn("content", F.sha2("status", 256)) for s in snapshots(spark, sf_dir))
    return diff.alerts(a, b, "id", "score", 8, "content")


@query(
    "alerts_suppressed",
    f"""WITH {_SNAPSHOTS}, {_ALERTS}, u AS (SELECT id, CASE id % 3 WHEN 0 THEN 'ignored' WHEN 1 THEN 'applied' ELSE 'saved' END AS s FROM (SELECT id FROM a UNION SELECT id FROM b) WHERE id % 4 = 0)
SELECT kind, count(*) AS n FROM r LEFT JOIN u USING (id) WHERE CASE WHEN kind = 'new' THEN coalesce(s, '') NOT IN ('ignored', 'applied') ELSE coalesce(s, '') <> 'ignored' END GROUP BY kind""",
)
def alerts_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = snapshots(spark, sf_dir)
    k = F.col("id")
    ids = a.select("id").union(b.select("id")).distinct().where(k % 4 == 0)
    state = ids.withColumn("user_status", F.when(k % 3 == 0, "ignored").when(k % 3 == 1, "applied").otherwise("saved"))
    kept = filters.suppress(alerts(spark, sf_dir), state, "id", ["ignored", "applied"], ["ignored"])
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "id_set_operations",
    f"""WITH {_SNAPSHOTS} SELECT 'both' AS side, count(*) AS n FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
UNION ALL SELECT 'only_b', count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)""",
)
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.select("id") for s in snapshots(spark, sf_dir))
    parts = {"both": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a), "either": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_LINES = """
a AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS flag, CAST(l_quantity AS INT) AS qty FROM lineitem WHERE l_partkey % 6 <> 0),
b AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_partkey % 10 = 0 THEN 'Z' ELSE l_returnflag END AS flag, CAST(l_quantity AS INT) AS qty FROM lineitem WHERE l_partkey % 9 <> 0)
"""


def line_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    fields = [F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("qty")]
    a = rows.where(part % 6 != 0).select(*fields, F.col("l_returnflag").alias("flag"))
    return a, rows.where(part % 9 != 0).select(*fields, F.when(part % 10 == 0, "Z").otherwise(F.col("l_returnflag")).alias("flag"))


_PAIRED = f"""{_LINES},
na AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, flag, qty) AS k FROM a), nb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, flag, qty) AS k FROM b),
p AS (SELECT coalesce(na.id, nb.id) AS id, coalesce(na.k, nb.k) AS k, CASE WHEN na.id IS NULL OR nb.id IS NULL THEN 0 ELSE (na.flag IS DISTINCT FROM nb.flag)::INT + (na.qty IS DISTINCT FROM nb.qty)::INT END AS diffs,
  CASE WHEN na.id IS NULL THEN 'added' WHEN nb.id IS NULL THEN 'removed' WHEN na.flag IS DISTINCT FROM nb.flag OR na.qty IS DISTINCT FROM nb.qty THEN 'changed' ELSE 'same' END AS kind
  FROM na FULL JOIN nb ON na.id = nb.id AND na.k = nb.k)"""


@query("safety_diff_multiset", f"WITH {_PAIRED} SELECT id, CAST(k AS INT) AS k, kind, CAST(diffs AS INT) AS diffs FROM p")
def safety_diff_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys: the k-th row of one side against the k-th of the other."""
    return diff.pair_duplicates(*line_snapshots(spark, sf_dir), "id", ["line", "flag", "qty"], ["flag", "qty"])


@query(
    "safety_diff_churn",
    f"""WITH {_LINES}, x AS (SELECT DISTINCT flag || ':' || qty || ':' || line AS content, id FROM a), y AS (SELECT DISTINCT flag || ':' || qty || ':' || line AS content, id FROM b),
j AS (SELECT coalesce(x.content, y.content) AS content, coalesce(x.id, y.id) AS id, CASE WHEN y.id IS NULL THEN 'left' WHEN x.id IS NULL THEN 'came' ELSE 'stayed' END AS side
  FROM x FULL JOIN y ON x.content = y.content AND x.id = y.id),
c AS (SELECT content, bool_or(side = 'left') AND bool_or(side <> 'left') OR bool_or(side = 'came') AND bool_or(side <> 'came') AS moved FROM j GROUP BY content)
SELECT sha256(j.content) AS content, j.id AS key, j.side FROM j JOIN c USING (content) WHERE c.moved AND j.side <> 'stayed'""",
)
def safety_diff_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that left or took up content which goes by other keys too."""
    content = F.sha2(F.concat_ws(":", "flag", "qty", "line"), 256)
    a, b = (s.withColumn("content", content) for s in line_snapshots(spark, sf_dir))
    return diff.identity_churn(a, b, "id", "content").withColumnRenamed("id", "key")


@query(
    "safety_diff_risk",
    f"""WITH {_PAIRED}, m AS (SELECT count(*) AS n, count(*) FILTER (kind = 'removed') / count(*)::DOUBLE AS removed, count(*) FILTER (kind = 'changed') / count(*)::DOUBLE AS changed,
  count(*) FILTER (kind = 'added') / count(*)::DOUBLE AS added FROM p)
SELECT n, CAST(least(100, CASE WHEN removed >= 0.05 THEN 30 ELSE 0 END + CASE WHEN removed >= 0.25 THEN 40 ELSE 0 END + CASE WHEN changed >= 0.05 THEN 25 ELSE 0 END + CASE WHEN added >= 0.1 THEN 20 ELSE 0 END) AS INT) AS risk_score,
  array_to_string(list_filter([CASE WHEN removed >= 0.05 THEN 'removed' END, CASE WHEN removed >= 0.25 THEN 'many_removed' END, CASE WHEN changed >= 0.05 THEN 'changed' END, CASE WHEN added >= 0.1 THEN 'added' END],
    lambda x: x IS NOT NULL), ',') AS risk_reasons FROM m""",
)
def safety_diff_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = safety_diff_multiset(spark, sf_dir)
    share = lambda k: (F.count_if(F.col("kind") == k) / F.count("*")).alias(k)
    m = p.agg(F.count("*").alias("n"), share("removed"), share("changed"), share("added"))
    ladder = [("removed", "removed", 0.05, 30), ("many_removed", "removed", 0.25, 40), ("changed", "changed", 0.05, 25), ("added", "added", 0.1, 20)]
    return diff.risk(m, ladder).select("n", "risk_score", F.array_join("risk_reasons", ",").alias("risk_reasons"))


@query(
    "field_completeness",
    """WITH t AS (SELECT avg((coalesce(trim(lang), '') <> '')::INT) AS l, avg((coalesce(trim(source), '') <> '')::INT) AS s, avg((coalesce(trim(CAST(quality AS VARCHAR)), '') <> '')::INT) AS q
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest(['lang', 'source', 'quality']) AS field, unnest([round_even(l, 4), round_even(s, 4), round_even(q, 4)]) AS share FROM t""",
)
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return diff.completeness(rows, ["lang", "source", "quality"])


@query(
    "artifact_equality",
    """WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_partkey % 2 = 0), b AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_partkey % 2 = 1),
x AS (SELECT *, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT *, count(*) AS n FROM b GROUP BY ALL),
j AS (SELECT coalesce(x.n, 0) AS p, coalesce(y.n, 0) AS q FROM x FULL JOIN y ON x.l_returnflag = y.l_returnflag AND x.l_linestatus = y.l_linestatus AND x.l_linenumber = y.l_linenumber)
SELECT sum(p)::BIGINT AS n_a, sum(q)::BIGINT AS n_b, sum(greatest(p - q, 0))::BIGINT AS only_a, sum(greatest(q - p, 0))::BIGINT AS only_b, sum(abs(p - q)) = 0 AS equal FROM j""",
)
def artifact_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    return diff.same_rows(rows.where("l_partkey % 2 = 0").drop("l_partkey"), rows.where("l_partkey % 2 = 1").drop("l_partkey"))


@query(
    "volatile_fields",
    f"""WITH {_SNAPSHOTS} SELECT unnest(['cust', 'priority', 'score', 'status']) AS column_name, unnest([c, p, s, t]) AS n FROM (SELECT count(*) FILTER (a.cust IS DISTINCT FROM b.cust) AS c,
  count(*) FILTER (a.priority IS DISTINCT FROM b.priority) AS p, count(*) FILTER (a.score IS DISTINCT FROM b.score) AS s, count(*) FILTER (a.status IS DISTINCT FROM b.status) AS t FROM a JOIN b USING (id))""",
)
def volatile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_columns(*snapshots(spark, sf_dir), "id")


@query(
    "ordered_append",
    """SELECT p_brand, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT p_brand, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
  SELECT p_brand, list_concat([split_part(min(p_type), ' ', 1), split_part(min(p_type), ' ', 2)], [split_part(max(p_type), ' ', 1), split_part(max(p_type), ' ', 2), split_part(min(p_type), ' ', 2)]) AS l FROM part GROUP BY p_brand))""",
)
def ordered_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list, then the items of another that it lacks."""
    word = lambda c, n: F.split_part(c, F.lit(" "), F.lit(n))
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("lo"), F.max("p_type").alias("hi"))
    lists = F.concat(F.array(word(F.col("lo"), 1), word(F.col("lo"), 2)), F.array(word(F.col("hi"), 1), word(F.col("hi"), 2), word(F.col("lo"), 2)))
    return p.select("p_brand", F.array_join(F.array_distinct(lists), ",").alias("tags"))


_PART = "sum(CAST('0x' || substr(h, {0}, 8) AS BIGINT))::BIGINT"


@query(
    "unchanged_inputs",
    f"""WITH {_SNAPSHOTS}, r AS (SELECT 'a' AS side, sha256(concat_ws(chr(31), id, lower(trim(status)))) AS h FROM a UNION ALL SELECT 'b', sha256(concat_ws(chr(31), id, lower(trim(status)))) FROM b),
s AS (SELECT side, count(*) AS n, {", ".join(f"{_PART.format(k)} AS p{k}" for k in range(1, 65, 8))} FROM r GROUP BY side),
f AS (SELECT side, sha256(concat_ws(chr(31), n, p1, p9, p17, p25, p33, p41, p49, p57)) AS fingerprint FROM s)
SELECT side, fingerprint, count(*) OVER (PARTITION BY fingerprint) > 1 AS skip FROM f""",
)
def unchanged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole inputs, and whether a run over the second may be skipped because the first had the same."""
    from pyspark.sql import Window

    both = None
    for side, rows in zip("ab", snapshots(spark, sf_dir)):
        f = diff.content_fingerprint(rows.select(digest(F.col("id"), normalise(F.col("status"))).alias("h")), "h").select(F.lit(side).alias("side"), "fingerprint")
        both = f if both is None else both.unionByName(f)
    return both.withColumn("skip", F.count("*").over(Window.partitionBy("fingerprint")) > 1)  # one row an input


@query(
    "completeness_delta",
    f"""WITH {_SNAPSHOTS}, x AS (SELECT round_even(avg((status = 'F')::INT), 4) AS s, round_even(avg((score > 100)::INT), 4) AS c FROM a), y AS (SELECT round_even(avg((status = 'F')::INT), 4) AS s, round_even(avg((score > 100)::INT), 4) AS c FROM b)
SELECT 'status' AS field, x.s AS share_before, y.s AS share_after, round_even(y.s - x.s, 4) AS delta FROM x, y UNION ALL SELECT 'score', x.c, y.c, round_even(y.c - x.c, 4) FROM x, y""",
)
def completeness_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often fields are filled than before."""
    blank = lambda d: d.select(F.when(F.col("status") == "F", "F").alias("status"), F.when(F.col("score") > 100, F.col("score")).alias("score"))
    return diff.completeness_delta(*map(blank, snapshots(spark, sf_dir)), ["status", "score"])


@query(
    "alerts_ranked",
    f"""WITH {_SNAPSHOTS}, {_ALERTS}, v AS (SELECT r.*, coalesce(b.score, a.score) AS score FROM r LEFT JOIN a USING (id) LEFT JOIN b USING (id))
SELECT id, kind, score, CAST(row_number() OVER (ORDER BY score DESC, id, kind) AS INT) AS rank FROM v WHERE score >= 150 OR kind = 'removed' QUALIFY rank <= 100""",
)
def alerts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first 100 alerts: by score, with removed rows whatever their score."""
    a, b = snapshots(spark, sf_dir)
    gone = a.join(b.select("id"), "id", "left_anti").select("id", "score")
    return diff.worth_showing(alerts(spark, sf_dir), b.select("id", "score").unionByName(gone), "id", "score", 150, 100).select("id", "kind", "score", "rank")


_PERIOD = f"""WITH {_SNAPSHOTS}, {_diff_sql(['status', 'score'])}, s AS (SELECT x.id, x.kind, b.score FROM x JOIN b USING (id)),
m AS (SELECT (SELECT median(score) FROM a) AS before, (SELECT median(score) FROM b) AS after)
SELECT 'change' AS section, kind AS name, count(*)::DOUBLE AS value FROM x GROUP BY kind
UNION ALL (SELECT 'top_new', id::VARCHAR, score FROM s WHERE kind = 'new' ORDER BY score DESC, id LIMIT 5)
UNION ALL (SELECT 'top_changed', id::VARCHAR, score FROM s WHERE kind = 'changed' ORDER BY score DESC, id LIMIT 5)
UNION ALL (SELECT 'family', priority, count(*) FROM b GROUP BY priority ORDER BY count(*) DESC, lower(priority), priority LIMIT 5)
UNION ALL SELECT 'bucket', '..50', count(*) FILTER (score < 50) FROM b UNION ALL SELECT 'bucket', '50..150', count(*) FILTER (score >= 50 AND score < 150) FROM b UNION ALL SELECT 'bucket', '150..', count(*) FILTER (score >= 150) FROM b
UNION ALL SELECT 'median', 'before', before FROM m UNION ALL SELECT 'median', 'after', after FROM m UNION ALL SELECT 'trend', 'median', round_even(after - before, 3) FROM m"""


@query("period_insights", _PERIOD)
def period_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a period's report needs: changes, top rows, families, buckets, medians and their trend."""
    return insights.period(*snapshots(spark, sf_dir), "id", ["status", "score"], "score", "priority", [50, 150])


@query("insights_reused", f"SELECT run, reused, count(*) AS n FROM ({_PERIOD}), (VALUES (1, false), (2, true), (3, false)) v(run, reused) GROUP BY ALL")
def insights_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report made, reused while its metadata are equal, and made again for another version."""
    from ..session import working_folder
    from ..sources.replay import fingerprint

    path, out = working_folder(spark, "insights"), None
    before, after = snapshots(spark, sf_dir)
    inputs = {"before": fingerprint(before), "after": fingerprint(after)}
    make = lambda: insights.period(before, after, "id", ["status", "score"], "score", "priority", [50, 150])
    for run, version in ((1, 1), (2, 1.0), (3, 2)):
        rows, was = insights.reused(spark, path, {"inputs": inputs, "version": version}, make)
        one = rows.groupBy(F.lit(run).alias("run"), F.lit(was).alias("reused")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
