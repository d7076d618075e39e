"""Policies, audits, costs, secrets and structured properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc, rules
from ..functions.text import mentions
from ..registry import query, table


@query(
    "provider_policy",
    """WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) / count(*)::DOUBLE AS error_rate, count(*) FILTER (event_id % 2 = 0) AS baseline FROM events GROUP BY event_type)
SELECT event_type, n, round(error_rate, 4) AS error_rate, array_to_string(list_sort(list_filter([CASE WHEN n < 1000 THEN 'too_few' END, CASE WHEN n < 1.9 * baseline THEN 'below_baseline' END,
  CASE WHEN error_rate > 0.15 THEN 'errors' END], lambda x: x IS NOT NULL)), ',') AS failures FROM s""",
)
def provider_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few rows, too few against a baseline, too many errors."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), (F.count_if(F.col("value") < 10) / F.count("*")).alias("rate"), F.count_if(F.col("event_id") % 2 == 0).alias("baseline")
    )
    bad = misc.codes([("too_few", F.col("n") < 1000), ("below_baseline", F.col("n") < 1.9 * F.col("baseline")), ("errors", F.col("rate") > 0.15)])
    return e.select("event_type", "n", F.round("rate", 4).alias("error_rate"), F.array_join(bad, ",").alias("failures"))


@query(
    "status_stats",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open_, round(avg((o_orderstatus = 'P')::INT), 6) AS pending_share FROM orders GROUP BY 1""",
)
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open_"), F.round(F.avg((s == "P").cast("int")), 6).alias("pending_share")
    )


@query(
    "cost_decimal",
    """WITH c AS (SELECT o_orderpriority AS model, CAST(round(CAST(o_custkey AS DECIMAL(18, 0)) * CAST('0.0000125' AS DECIMAL(18, 12)), 6) AS DECIMAL(18, 6)) AS cost FROM orders)
SELECT model, count(*) AS calls, CAST(sum(cost) AS DECIMAL(18, 6)) AS total FROM c GROUP BY model UNION ALL SELECT 'all', count(*), CAST(sum(cost) AS DECIMAL(18, 6)) FROM c""",
)
def cost_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal costs by model and in total, in one pass."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), misc.cost(F.col("o_custkey"), "0.0125").alias("cost"))
    r = c.rollup("model").agg(F.grouping("model").alias("g"), F.count("*").alias("calls"), F.sum("cost").cast("decimal(18,6)").alias("total"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("model")).alias("model"), "calls", "total")


@query(
    "json_props",
    """WITH p AS (SELECT event_id, json_keys(props) AS k, props FROM events WHERE json_valid(props))
SELECT unnest(k) AS key, count(*) AS n, min(event_id) AS first_event FROM p GROUP BY 1""",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of valid JSON objects; anything else is passed over."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "secret_patterns",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS mail, len(regexp_extract_all(text, 'AKIA[A-Z0-9]{12,}')) AS access,
  contains(lower(text), 'password') AND contains(text, '=') AS pair FROM d)
SELECT doc_id, CAST(mail AS INT) AS mail, CAST(access AS INT) AS access, pair FROM f WHERE mail > 0 OR access > 0 OR pair""",
)
def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named patterns and a rule that needs two parts."""
    x = F.coalesce("text", F.lit(""))
    n = lambda p: F.regexp_count(x, F.lit(p))
    found = table(spark, sf_dir, "documents").select(
        "doc_id", n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}").alias("mail"), n("AKIA[A-Z0-9]{12,}").alias("access"),
        (F.contains(F.lower(x), F.lit("password")) & F.contains(x, F.lit("="))).alias("pair"),
    )
    return found.where((F.col("mail") > 0) | (F.col("access") > 0) | F.col("pair"))


@query(
    "attribute_inference",
    r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}])(the|and)([^\p{L}\p{N}]|$)') THEN 'english' WHEN regexp_matches(t, '(^|[^\p{L}\p{N}])(und|der)([^\p{L}\p{N}]|$)') THEN 'german'
  WHEN regexp_matches(t, '(^|[^\p{L}\p{N}])(les|pour)([^\p{L}\p{N}]|$)') THEN 'french' ELSE 'other' END AS family,
  array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}])(with)([^\p{L}\p{N}]|$)') THEN 'with' END, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}])(idiot|stupid)([^\p{L}\p{N}]|$)') THEN 'insult' END,
  CASE WHEN regexp_matches(t, '[0-9]{4,}') THEN 'number' END], lambda x: x IS NOT NULL)), ',') AS tags FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def attribute_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family by precedence and sorted tags, by whole words."""
    t = F.lower("text")
    family = F.when(mentions(t, "the|and"), "english").when(mentions(t, "und|der"), "german").when(mentions(t, "les|pour"), "french").otherwise("other")
    tags = misc.codes([("with", mentions(t, "with")), ("insult", mentions(t, "idiot|stupid")), ("number", t.rlike("[0-9]{4,}"))])
    return table(spark, sf_dir, "documents").select("doc_id", family.alias("family"), F.array_join(tags, ",").alias("tags"))


@query(
    "audit_stats",
    """SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS middle FROM documents GROUP BY lang""",
)
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(n > 1000).alias("long_"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.round(F.median(n), 4).alias("middle")
    )


@query(
    "audit_transitions",
    """WITH o AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS a,
  list_filter([CASE WHEN (quality + doc_id) % 3 = 1 THEN 'good' END, CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS b FROM labels),
t AS (SELECT unnest(['good', 'toxic']) AS tag) SELECT tag, count(*) FILTER (list_contains(a, tag) AND NOT list_contains(b, tag)) AS lost, count(*) FILTER (NOT list_contains(a, tag) AND list_contains(b, tag)) AS gained,
  count(*) FILTER (a <> b) AS lists_changed FROM o, t GROUP BY tag""",
)
def audit_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that lists lost and gained."""
    tags = lambda *cases: F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in cases]), lambda x: x.isNotNull())
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    o = table(spark, sf_dir, "labels").select(
        tags(("good", q == 1), ("toxic", t == 1)).alias("a"), tags(("good", (q + d) % 3 == 1), ("toxic", (t == 1) & (d % 2 == 0))).alias("b")
    )
    rows = o.select("a", "b", F.explode(F.array(F.lit("good"), F.lit("toxic"))).alias("tag"))
    before, after = F.array_contains("a", F.col("tag")), F.array_contains("b", F.col("tag"))
    return rows.groupBy("tag").agg(F.count_if(before & ~after).alias("lost"), F.count_if(~before & after).alias("gained"), F.count_if(F.col("a") != F.col("b")).alias("lists_changed"))


@query(
    "failure_codes",
    """WITH e AS (SELECT CAST(80 + (event_id * 37) % 560 AS INT) AS code, value FROM events),
c AS (SELECT *, CASE WHEN code BETWEEN 100 AND 599 THEN ['informational', 'successful', 'redirection', 'client_error', 'server_error'][code // 100] END AS category,
  code IN (408, 421, 425, 429) OR (code BETWEEN 500 AND 599 AND code NOT IN (501, 505)) AS transient FROM e),
k AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN category IS NULL THEN 'invalid_code' END, CASE WHEN category IN ('client_error', 'server_error') THEN 'http' END,
  CASE WHEN value < 5 AND coalesce(category, '') <> 'successful' THEN 'low_value' END], lambda x: x IS NOT NULL)), ',') AS codes FROM c)
SELECT coalesce(category, 'none') AS category, transient, codes, count(*) AS n FROM k GROUP BY ALL""",
)
def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by category, by whether another attempt may help, and by their sorted failure codes."""
    code = (80 + (F.col("event_id") * 37) % 560).cast("int")
    e = table(spark, sf_dir, "events").select(misc.http_category(code).alias("category"), misc.http_transient(code).alias("transient"), "value")
    kind = F.coalesce("category", F.lit("none"))
    failed = misc.codes([("invalid_code", kind == "none"), ("http", kind.isin("client_error", "server_error")), ("low_value", (F.col("value") < 5) & (kind != "successful"))])
    return e.groupBy(kind.alias("category"), "transient", F.array_join(failed, ",").alias("codes")).agg(F.count("*").alias("n"))


@query(
    "user_status_counts",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN lower(trim(r)) IN ('applied', 'ignored', 'saved') THEN lower(trim(r)) END AS status FROM (
  SELECT CASE c_custkey % 4 WHEN 0 THEN ' Applied' WHEN 1 THEN 'IGNORED ' WHEN 2 THEN 'saved' ELSE 'unknown' END AS r FROM customer)) GROUP BY status""",
)
def user_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, " Applied").when(k == 1, "IGNORED ").when(k == 2, "saved").otherwise("unknown")
    c = table(spark, sf_dir, "customer").select(misc.status(raw, ("applied", "ignored", "saved")).alias("status"))
    return c.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "label_upgrade",
    """WITH p AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS sim FROM embeddings, p)
SELECT vec_id, CASE WHEN sim >= 0.2 THEN 'relevant' WHEN label % 2 = 0 THEN 'maybe' ELSE 'irrelevant' END AS relevance FROM s""",
)
def label_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label rises where the similarity to the profile is high enough."""
    from .vectors import cosine_to_profile

    label = F.when(F.col("label") % 2 == 0, "maybe").otherwise("irrelevant")
    e = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("old"))
    s = cosine_to_profile(spark, sf_dir)
    return e.join(s, "vec_id").select("vec_id", F.when(F.col("similarity") >= 0.2, "relevant").otherwise(F.col("old")).alias("relevance"))


@query(
    "json_walk",
    """SELECT path, count(*) AS n, min(value) AS least FROM (SELECT '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT '$.a[0]', json_extract_string(props, '$.k') FROM events WHERE event_id % 2 = 1 UNION ALL SELECT '$.a[1].t', event_type FROM events WHERE event_id % 2 = 1) GROUP BY path""",
)
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of nested records by their path; half of the records are wrapped more deeply."""
    from ..functions.trees import walk

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    deep = F.concat(F.lit('{"a": ['), k, F.lit(', {"t": "'), F.col("event_type"), F.lit('"}]}'))
    e = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(deep).alias("j"))
    return walk(e, "event_id", "j").groupBy("path").agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query(
    "record_problems",
    """SELECT array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN '$.id: missing' END, CASE WHEN event_id % 3 = 0 THEN '$.v: string' END], lambda x: x IS NOT NULL), '; ') AS problems, count(*) AS n
FROM events WHERE event_id % 7 <> 0 GROUP BY 1 UNION ALL SELECT '$: no JSON', count(*) FROM events WHERE event_id % 7 = 0""",
)
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing keys and wrong kinds in JSON records."""
    from ..functions.records import problems

    i = F.col("event_id")
    parts = F.concat_ws(", ", F.when(i % 5 != 0, F.concat(F.lit('"id": '), i)), F.when(i % 3 == 0, F.lit('"v": "x"')).otherwise(F.concat(F.lit('"v": '), F.col("value"))))
    record = F.when(i % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit("{"), parts, F.lit("}")))
    found = table(spark, sf_dir, "events").select(F.array_join(problems(record, {"id": "BIGINT", "v": "DOUBLE"}), "; ").alias("problems"))
    return found.groupBy("problems").agg(F.count("*").alias("n"))


@query(
    "enrichment_state",
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html END AS api, CASE WHEN page_id % 4 <> 1 THEN left(html, CAST(page_id AS INT) * 5) END AS h, CASE WHEN page_id % 5 = 0 THEN 'timeout' END AS e FROM pages),
q AS (SELECT *, length(coalesce(api, '')) AS a, length(coalesce(h, '')) AS b FROM p),
s AS (SELECT *, CASE WHEN a >= 200 OR b >= 200 THEN 'enriched' WHEN e IS NOT NULL AND a + b = 0 THEN 'unavailable' WHEN a + b = 0 THEN 'empty' ELSE 'partial' END AS status,
  CASE WHEN a >= 200 THEN 'api' WHEN b >= 200 THEN 'html' WHEN e IS NOT NULL AND a + b = 0 THEN 'error:' || e WHEN a + b = 0 THEN 'no_text' ELSE 'short_text' END AS reason FROM q)
SELECT status, reason, a < 200 AND status IN ('partial', 'empty') AS needs_fallback, count(*) AS n FROM s GROUP BY ALL""",
)
def enrichment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.records import enrichment

    i = F.col("page_id")
    api, html = F.when(i % 3 == 0, F.col("html")), F.when(i % 4 != 1, F.substr("html", F.lit(1), (i * 5).cast("int")))
    state = enrichment(api, html, F.when(i % 5 == 0, F.lit("timeout")))
    return table(spark, sf_dir, "pages").select(state.alias("s")).select("s.*").groupBy("status", "reason", "needs_fallback").agg(F.count("*").alias("n"))


@query(
    "publish_plan",
    """SELECT 'part-' || p_partkey AS source, 'runs/r1/part-' || p_partkey AS target FROM part UNION ALL SELECT 'part-' || p_partkey, 'latest/part-' || p_partkey FROM part WHERE p_partkey IN (1, 2)""",
)
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every artifact of a run goes; two of them are published as the latest, too."""
    from ..sources import sinks

    names = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("name"))
    return sinks.publish_plan(names, "r1", ["part-1", "part-2"])


@query(
    "artifact_verification",
    """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'extra' ELSE 'changed' END AS problem FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
)
def artifact_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of artifacts against those that were recorded."""
    from ..sources import sinks

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), k).alias("path"))
    found = o.where(k % 5 != 0).select("path", F.sha2(F.when((k % 11 == 0) & (k % 7 != 0), "other").otherwise(F.col("path")), 256).alias("sha256"))
    expected = o.where((k % 7 != 0) | (k % 5 == 0)).select("path", F.sha2("path", 256).alias("sha256"))
    return sinks.verify(found, expected)


@query(
    "payload_coercion",
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS title,
  CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN CAST(event_id % 90 AS INT) END AS score, CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE '' END AS tags FROM events""",
)
def payload_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, numbers and lists of loosely written JSON as the kinds they should have."""
    from ..functions.records import coerced

    i = F.col("event_id")
    title = F.when(i % 4 == 0, '" "').otherwise(F.concat(F.lit('" '), F.col("event_type"), F.lit('"')))
    score = F.when(i % 3 == 0, "250").when(i % 3 == 1, F.concat(F.lit('"'), i % 90, F.lit('.7"'))).otherwise('"many"')
    tags = F.when(i % 4 == 0, '["a", " b", "a", ""]').when(i % 2 == 0, '"a, b,,a"').otherwise("null")
    record = F.concat(F.lit('{"title": '), title, F.lit(', "score": '), score, F.lit(', "tags": '), tags, F.lit("}"))
    found = table(spark, sf_dir, "events").select("event_id", coerced(record, ["title"], {"score": (0, 100)}, ["tags"]).alias("r"))
    return found.select("event_id", "r.title", "r.score", F.array_join("r.tags", "|").alias("tags"))


_PLACES = [("(?i)remote|anywhere", "Remote", "open", "says_remote"), ("(?i)(^|, )(de|germany)$", "Germany", "inside", "country"), ("(?i)^(bonn|kiel)", "Germany", "inside", "city"), ("^ *$", "Unknown", "unclear", "blank")]


@query(
    "location_cascade",
    """WITH l AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Remote - Bonn' WHEN 1 THEN 'Berlin, DE' WHEN 2 THEN 'kiel area' WHEN 3 THEN '  ' WHEN 4 THEN 'Lyon' ELSE 'Model, germany' END AS place FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'Remote' WHEN c_custkey % 6 IN (1, 2, 5) THEN 'Germany' WHEN c_custkey % 6 = 3 THEN 'Unknown' ELSE 'Other' END AS norm,
  CASE WHEN c_custkey % 6 = 0 THEN 'open' WHEN c_custkey % 6 IN (1, 2, 5) THEN 'inside' WHEN c_custkey % 6 = 3 THEN 'unclear' ELSE 'outside' END AS flag,
  CASE WHEN c_custkey % 6 = 0 THEN 'says_remote' WHEN c_custkey % 6 IN (1, 5) THEN 'country' WHEN c_custkey % 6 = 2 THEN 'city' WHEN c_custkey % 6 = 3 THEN 'blank' ELSE 'no_rule' END AS reason FROM l""",
)
def location_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the first rule they fit, with the reason."""
    k = F.col("c_custkey") % 6
    place = F.when(k == 0, "Remote - Bonn").when(k == 1, "Berlin, DE").when(k == 2, "kiel area").when(k == 3, "  ").when(k == 4, "Lyon").otherwise("Model, germany")
    found = table(spark, sf_dir, "customer").select("c_custkey", rules.cascade(place, _PLACES, ("Other", "outside", "no_rule")).alias("p"))
    return found.select("c_custkey", "p.norm", "p.flag", "p.reason")


_SCHEMA = {
    "type": "object",
    "required": ["id", "parts"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "kind": {"enum": ["click", "view", "purchase"]},
        "version": {"const": 2},
        "parts": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["v"], "properties": {"v": {"type": "number", "maximum": 95}, "t": {"type": ["string", "null"], "pattern": "^[a-z]"}}}},
    },
}


@query(
    "schema_errors",
    """WITH e AS (SELECT event_id AS i, event_type AS t, value AS v, event_type NOT IN ('click', 'view', 'purchase') AS odd FROM events),
x AS (SELECT i, unnest(list_filter([
  CASE WHEN i % 7 = 0 THEN {'p': '$', 'e': 'no JSON'} END,
  CASE WHEN i % 7 <> 0 AND i % 5 = 0 THEN {'p': '$.id', 'e': 'missing'} END,
  CASE WHEN i % 7 <> 0 AND i % 5 <> 0 AND i < 1 THEN {'p': '$.id', 'e': 'out of bounds'} END,
  CASE WHEN i % 7 <> 0 AND odd THEN {'p': '$.kind', 'e': 'not among the values allowed'} END,
  CASE WHEN i % 7 <> 0 AND i % 3 = 0 THEN {'p': '$.version', 'e': 'not the constant'} END,
  CASE WHEN i % 7 <> 0 AND i % 11 = 0 THEN {'p': '$.more', 'e': 'not expected'} END,
  CASE WHEN i % 7 <> 0 AND i % 13 = 0 THEN {'p': '$.parts', 'e': 'length out of bounds'} END,
  CASE WHEN i % 7 <> 0 AND i % 13 <> 0 AND v > 95 THEN {'p': '$.parts[0].v', 'e': 'out of bounds'} END,
  CASE WHEN i % 7 <> 0 AND i % 13 <> 0 AND i % 2 = 0 THEN {'p': '$.parts[1].v', 'e': 'missing'} END,
  CASE WHEN i % 7 <> 0 AND i % 13 <> 0 AND i % 2 = 0 THEN {'p': '$.parts[1].t', 'e': 'pattern not found'} END,
  CASE WHEN i % 7 <> 0 AND i % 13 <> 0 AND i % 2 = 1 THEN {'p': '$.parts[1]', 'e': 'string instead of object'} END], lambda z: z IS NOT NULL)) AS z FROM e)
SELECT z.p AS path, z.e AS error, count(*) AS n, min(i) AS first_id FROM x GROUP BY ALL""",
)
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of nested records against a schema, with their paths."""
    from ..functions import trees

    i = F.col("event_id")
    second = F.when(i % 2 == 0, F.lit('{"t": "Upper"}')).otherwise(F.lit('"text"'))
    parts = F.when(i % 13 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"v": '), F.col("value").cast("string"), F.lit(', "t": null}, '), second, F.lit("]")))
    record = F.concat_ws(
        ", ",
        F.when(i % 5 != 0, F.concat(F.lit('"id": '), i)),
        F.concat(F.lit('"kind": "'), F.col("event_type"), F.lit('"')),
        F.concat(F.lit('"version": '), F.when(i % 3 == 0, "2.5").otherwise("2.0")),
        F.when(i % 11 == 0, F.lit('"more": {"deep": [1]}')),
        F.concat(F.lit('"parts": '), parts),
    )
    text = F.when(i % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit("{"), record, F.lit("}")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("record"))
    return trees.schema_errors(rows, "event_id", "record", _SCHEMA).groupBy("path", "error").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_SECRETS = {"access": "AKIA[A-Z0-9]{12,}", "mail": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"}


@query(
    "secret_findings",
    r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, 'AKIA[A-Z0-9]{12,}') AS a, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS m,
  CASE WHEN contains(text, '=') THEN regexp_extract_all(text, '[Pp]assword') ELSE [] END AS p FROM documents),
k AS (SELECT doc_id, text, 'access' AS kind, a AS l FROM d UNION ALL SELECT doc_id, text, 'mail', m FROM d UNION ALL SELECT doc_id, text, 'pair', p FROM d)
SELECT doc_id, kind, len(l) AS n, strpos(text, l[1]) - 1 AS first_start, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS total FROM k WHERE len(l) > 0""",
)
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts by their places, and a kind that needs two parts."""
    from ..functions import trees

    found = trees.text_findings(table(spark, sf_dir, "documents"), "doc_id", "text", _SECRETS, {"pair": ("[Pp]assword", "=")})
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.sum(F.col("end") - F.col("start")).alias("total"))


@query(
    "record_secret_paths",
    r"""WITH d AS (SELECT regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS m, regexp_extract_all(text, 'AKIA[A-Z0-9]{12,}') AS a FROM documents),
k AS (SELECT 'access' AS kind, a AS l FROM d UNION ALL SELECT 'mail', m FROM d)
SELECT '$.body.parts[1].text' AS path, kind, count(*) AS docs, sum(len(l))::BIGINT AS n FROM k WHERE len(l) > 0 GROUP BY kind""",
)
def record_secret_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON records: where in them secrets are."""
    from ..functions import trees

    part = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("note"))
    record = F.to_json(F.struct(F.col("doc_id"), F.struct(F.array(F.struct(F.lit("head").alias("text"), F.lit("x").alias("note")), part).alias("parts")).alias("body")))
    found = trees.record_findings(table(spark, sf_dir, "documents").select("doc_id", record.alias("record")), "doc_id", "record", _SECRETS)
    return found.groupBy("path", "kind").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))
