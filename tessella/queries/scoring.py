"""Scoring, ranking, families and filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import filters, ranking
from ..registry import query, table

MODEL = rules.ScoreModel(
    rules=(
        rules.Rule("english", ("the", "and", "of"), 1),
        rules.Rule("opening", ("with", "this", "for"), 1, "title"),
        rules.Rule("german", ("und", "der", "die"), 1),
        rules.Rule("french", ("les", "des", "une"), 1),
        rules.Rule("spanish", ("que", "los", "una"), 1),
        rules.Rule("past", ("was", "were"), -1),
        rules.Rule("insult", ("idiot", "stupid", "trash", "scum"), -4),
    ),
    attributes=(("label", "1", 12), ("label", "0", -8)),
    bands=(("core", 120, 4), ("near", 105, 1), ("far", 80, 0)),
)
_BAND = [("core", "^src[0-4]$"), ("near", "^src[5-9]$"), ("far", "^src1[5-9]$")]


#: The same with weak texts' losses damped and good rows pinned.
CAREFUL = replace(MODEL, damped=(400, 40), pins=(("label", "1", 35),))


def _rule_sql(model: rules.ScoreModel) -> str:
    tokens = "regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]+)', 1)"
    scope = {"title": "tt", "text": "tx"}
    counts, hits = [], []
    for i, r in enumerate(model.rules):
        terms = ", ".join(f"'{t}'" for t in r.terms)
        counts.append(f"len(list_filter({scope[r.scope]}, lambda t: t IN ({terms}))) AS c{i}")
        points = f"{r.weight} * least({model.ceiling}, c{i} * 1000 // greatest(len({scope[r.scope]}), {model.floor_words}))"
        if r.weight < 0 and model.damped[0]:
            points = f"CASE WHEN len({scope[r.scope]}) < {model.damped[0]} THEN CAST(ceil({points} * {model.damped[1]} / 100.0::DOUBLE) AS INT) ELSE {points} END"
        hits.append((r.name, f"c{i}", points))
    for column, value, points in model.attributes:
        hits.append((f"{column}={value}", f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END", f"CASE WHEN {column} = '{value}' THEN {points} ELSE 0 END"))
    rows = ", ".join(f"{{'o': -abs({d}), 'i': {i}, 'rule': '{n}', 'count': {c}, 'points': {d}}}" for i, (n, c, d) in enumerate(hits))
    base = " + ".join(f"({d})" for *_, d in hits)
    percent, after = (" ".join(f"WHEN '{n}' THEN {v}" for n, v in ((b[0], b[k]) for b in model.bands)) for k in (1, 2))
    pins = "".join(f"WHEN {c} = '{v}' THEN greatest({least}, adjusted_score) " for c, v, least in model.pins)
    pinned = f"CASE {pins}ELSE adjusted_score END" if pins else "adjusted_score"
    return f"""
d AS (SELECT doc_id, lang, source, text, split_part(text, '.', 1) AS title, length(text) AS n_chars, l.label,
        CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'core' WHEN regexp_matches(source, '^src[5-9]$') THEN 'near'
             WHEN regexp_matches(source, '^src1[5-9]$') THEN 'far' ELSE 'other' END AS band
      FROM documents LEFT JOIN (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels) l USING (doc_id)),
t AS (SELECT *, {tokens.format('title')} AS tt, {tokens.format('text')} AS tx FROM d),
n AS (SELECT *, {', '.join(counts)} FROM t),
b AS (SELECT *, {base} AS raw_score, list_sort(list_filter([{rows}], lambda h: h.count > 0)) AS hits FROM n),
s AS (SELECT *, CAST(floor(raw_score * CASE band {percent} ELSE 100 END / 100.0::DOUBLE) + CASE band {after} ELSE 0 END AS INT) AS adjusted_score FROM b),
f AS (SELECT * REPLACE ({pinned} AS adjusted_score), greatest(0, least(100, {pinned})) AS final_score FROM s)
"""


_SCORED = _rule_sql(MODEL)


def scored_documents(spark: SparkSession, sf_dir: str, model: rules.ScoreModel = MODEL) -> DataFrame:
    """documents with title, band and scores; the label is the quality mark where there is one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    d = d.withColumns({"title": F.split_part("text", F.lit("."), F.lit(1)), "band": rules.first_match(F.col("source"), _BAND, "other")})
    return rules.score(d, model, "title", "text", "band")


@query("rule_score", f"WITH {_SCORED} SELECT doc_id, CAST(raw_score AS INT) AS raw_score, adjusted_score, CAST(final_score AS INT) AS final_score FROM f")
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).select("doc_id", "raw_score", "adjusted_score", "final_score")


@query("rule_score_careful", f"WITH {_rule_sql(CAREFUL)} SELECT doc_id, CAST(raw_score AS INT) AS raw_score, CAST(adjusted_score AS INT) AS adjusted_score, CAST(final_score AS INT) AS final_score FROM f")
def rule_score_careful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with damped losses of short texts, and a floor under rows that are marked as good."""
    return scored_documents(spark, sf_dir, CAREFUL).select("doc_id", "raw_score", "adjusted_score", "final_score")


@query(
    "rule_hits_top3",
    f"""WITH {_SCORED} SELECT doc_id,
  array_to_string(list_transform(hits[1:3], lambda h: h.rule || ' x' || h.count || ' (' || h.points || ')'), '; ') AS top_hits, len(hits) AS n_hits FROM f""",
)
def rule_hits_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_documents(spark, sf_dir)
    return s.select("doc_id", rules.explain(F.col("score_hits"), 3).alias("top_hits"), F.size("score_hits").cast("long").alias("n_hits"))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents by falling score: of equal normalised texts the one with the largest original stays."""
    scored = scored_documents(spark, sf_dir).select("doc_id", "source", "final_score", "n_chars", F.sha2(text.normalise(F.col("text")), 256).alias("text_hash"))
    one = ranking.canonical(scored, ["text_hash"], [-F.col("n_chars"), -F.col("final_score")], "doc_id")
    return ranking.top(one.select("doc_id", "source", "final_score", F.col("n_duplicates").cast("int").alias("n_duplicates")), [F.desc("final_score"), F.asc("doc_id")], 100)


_NORM = "lower(trim(regexp_replace(coalesce(text, ''), '" + text.SPACE + "', ' ', 'g')))"


@query(
    "top_n_ranked",
    f"""WITH {_SCORED}, r AS (SELECT doc_id, source, final_score, count(*) OVER h - 1 AS n_duplicates,
    row_number() OVER (PARTITION BY {_NORM} ORDER BY n_chars DESC, final_score DESC, doc_id) AS k FROM f WINDOW h AS (PARTITION BY {_NORM}))
SELECT doc_id, source, final_score, CAST(n_duplicates AS INT) AS n_duplicates, CAST(row_number() OVER (ORDER BY final_score DESC, doc_id) AS INT) AS rank FROM r WHERE k = 1 QUALIFY rank <= 100""",
)
def top_n_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(spark, sf_dir)


@query(
    "canonical_dedupe",
    f"""SELECT doc_id, sha256({_NORM}) AS text_hash, first_value(doc_id) OVER (PARTITION BY {_NORM} ORDER BY length(text) DESC, coalesce(source, '') = '', doc_id) AS kept_doc_id FROM documents""",
)
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the best of its group of equal normalised texts: longest, with a source, first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"), F.sha2(text.normalise(F.col("text")), 256).alias("text_hash"))
    one = ranking.kept_rows(d, ["text_hash"], [-F.col("n"), F.coalesce("source", F.lit("")) == ""], "doc_id")
    return one.select("doc_id", "text_hash", "kept_doc_id")


@query(
    "blend_score",
    f"""WITH {_SCORED}, o AS (SELECT doc_id, quality * 64 + toxic * 9 AS other FROM labels),
j AS (SELECT f.doc_id, final_score, other, abs(other - final_score) AS apart FROM f LEFT JOIN o USING (doc_id))
SELECT doc_id, CAST(CASE WHEN other IS NULL THEN final_score ELSE final_score + sign(other - final_score) * least(apart, floor(1.5::DOUBLE * sqrt(apart))) END AS INT) AS blended FROM j""",
)
def blend_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores pulled toward a second score where there is one."""
    other = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 64 + F.col("toxic") * 9).alias("other"))
    mixed = scored_documents(spark, sf_dir).select("doc_id", "final_score").join(other, "doc_id", "left")
    return mixed.select("doc_id", rules.pull(F.col("final_score"), F.col("other"), 1.5).alias("blended"))


_CASES = [("brass", "BRASS|Brass"), ("steel", "STEEL|Steel"), ("copper", "COPPER|Copper")]


@query(
    "band_and_signals",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS|Brass') THEN 'brass' WHEN regexp_matches(p_type, 'STEEL|Steel') THEN 'steel'
  WHEN regexp_matches(p_type, 'COPPER|Copper') THEN 'copper' ELSE 'other' END AS band,
  array_to_string(list_sort(list_filter([CASE WHEN contains(lower(p_name), 'a') THEN 'has_a' END, CASE WHEN p_size > 25 THEN 'large' END,
     CASE WHEN p_retailprice > 1000 THEN 'costly' END], lambda x: x IS NOT NULL)), ',') AS signals,
  CASE WHEN regexp_matches(lower(p_type), 'promo') THEN 'no' WHEN pts >= 3 THEN 'yes' WHEN pts >= 1 THEN 'maybe' ELSE 'no' END AS relevance,
  regexp_extract(p_brand, '([0-9]+)$', 1) AS level
FROM (SELECT *, CASE WHEN regexp_matches(lower(p_type), 'standard|economy') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(p_type), 'brass|tin') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(lower(p_type), 'small') THEN 1 ELSE 0 END AS pts FROM part)""",
)
def band_and_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered bands, signal tags, a three-way class by points and a captured level."""
    from ..functions.misc import codes

    kind = F.lower(F.col("p_type"))
    signals = codes([("has_a", F.contains(F.lower("p_name"), F.lit("a"))), ("large", F.col("p_size") > 25), ("costly", F.col("p_retailprice") > 1000)])
    return table(spark, sf_dir, "part").select(
        "p_partkey", rules.first_match(F.col("p_type"), _CASES, "other").alias("band"), F.array_join(signals, ",").alias("signals"),
        rules.points_class(kind, ["promo"], [("standard|economy", 2), ("brass|tin", 1), ("small", 1)], 3, 1).alias("relevance"),
        F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("level"),
    )


@query(
    "score_distribution",
    f"""WITH {_SCORED}, l AS (SELECT list_sort(list(final_score)) AS v FROM f)
SELECT CAST(len(v) AS BIGINT) AS n, v[1] AS min_score, v[len(v)] AS max_score,
  v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.9) AS BIGINT) + 1] AS p90,
  CAST(len(list_filter(v, lambda x: x >= 20)) AS BIGINT) AS ge_20, CAST(len(list_filter(v, lambda x: x >= 40)) AS BIGINT) AS ge_40,
  CAST(len(list_filter(v, lambda x: x >= 60)) AS BIGINT) AS ge_60 FROM l""",
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by score, so that the index-based percentiles need no sorted list of all rows."""
    from pyspark.sql import Window

    by = scored_documents(spark, sf_dir).groupBy("final_score").agg(F.count("*").alias("n"))  # at most 101 rows
    run = Window.orderBy("final_score").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("final_score").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = by.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(everything))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * q), F.col("final_score")))
    ge = lambda x: F.sum(F.when(F.col("final_score") >= x, F.col("n")).otherwise(0)).alias(f"ge_{x}")
    return cum.agg(
        F.sum("n").alias("n"), F.min("final_score").alias("min_score"), F.max("final_score").alias("max_score"), at(0.5).alias("p50"), at(0.9).alias("p90"), ge(20), ge(40), ge(60)
    )


@query(
    "exclusive_buckets",
    """SELECT o_orderpriority, sum(CASE WHEN o_totalprice < 1000 THEN 1 ELSE 0 END)::BIGINT AS low,
  sum(CASE WHEN o_totalprice >= 1000 AND o_totalprice < 100000 THEN 1 ELSE 0 END)::BIGINT AS mid, sum(CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END)::BIGINT AS high,
  round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY 1""",
)
def exclusive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(p < 1000).alias("low"), F.count_if((p >= 1000) & (p < 100000)).alias("mid"), F.count_if(p >= 100000).alias("high"), F.round(F.median(p), 4).alias("median_price")
    )


_FALLBACK = """SELECT c_custkey, 'some' AS kind FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT EXISTS (FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT c_custkey, 'none_kept' FROM customer WHERE c_mktsegment = 'NOWHERE' OR NOT EXISTS (FROM customer WHERE c_mktsegment = 'NOWHERE')"""


@query("filter_with_fallback", _FALLBACK)
def filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter that finds rows, and the one that finds none and so keeps all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    keep = lambda v: filters.keep_with_fallback(c, F.col("c_mktsegment") == v, F.col("c_mktsegment") != "")
    return keep("BUILDING").select("c_custkey", F.lit("some").alias("kind")).unionByName(keep("NOWHERE").select("c_custkey", F.lit("none_kept").alias("kind")))


@query(
    "reason_histogram",
    """SELECT o_orderpriority AS reason, count(*) AS n, min(o_orderkey) AS first_seen,
  row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS by_count, row_number() OVER (ORDER BY min(o_orderkey)) AS by_first
FROM orders GROUP BY 1""",
)
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with their place by size and by first appearance."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_seen"))
    place = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")  # noqa: E731  one row a reason
    return n.withColumns({"by_count": place(F.desc("n"), F.asc("reason")), "by_first": place(F.asc("first_seen"))})


@query(
    "shortlist_user_state",
    f"""WITH {_SCORED}, u AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 0 THEN 'deprioritized' ELSE 'saved' END AS user_status FROM labels)
SELECT f.doc_id, final_score, CASE WHEN u.user_status = 'deprioritized' THEN 1 ELSE 0 END AS later,
  row_number() OVER (ORDER BY CASE WHEN u.user_status = 'deprioritized' THEN 1 ELSE 0 END, final_score DESC, f.doc_id) AS rank FROM f LEFT JOIN u USING (doc_id)
WHERE final_score >= 30 AND coalesce(u.user_status, '') <> 'ignored' AND n_chars > 100""",
)
def shortlist_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows above a score whose user state doesn't hide them; ``later`` marks the deprioritised ones, which come last."""
    t = F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 0, "deprioritized").otherwise("saved")
    state = table(spark, sf_dir, "labels").select("doc_id", t.alias("user_status"))
    s = scored_documents(spark, sf_dir).select("doc_id", "final_score", F.when(F.length("text") <= 100, "unavailable").otherwise("ok").alias("status"))
    return filters.shortlist(s, state, "doc_id", 30, "final_score").select("doc_id", "final_score", "later", "rank")


@query(
    "family_best_variants",
    """WITH p AS (SELECT p_partkey, regexp_replace(p_type, ' [^ ]+$', '') AS family, CAST(round_even(p_retailprice, 0) AS INT) AS score FROM part)
SELECT family, arg_max(p_partkey, score * 1000000 - p_partkey) AS best_id, max(score) AS best_score, count(*) AS n,
  array_to_string(list(p_partkey ORDER BY score DESC, p_partkey)[1:5], ',') AS top_variants FROM p GROUP BY family""",
)
def family_best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by type without its last word: the best and the first five variants."""
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_replace("p_type", " [^ ]+$", "").alias("family"), F.bround("p_retailprice", 0).cast("int").alias("score")
    )
    f = ranking.families(p, "family", "score", "p_partkey")
    first = F.array_join(F.transform("variants", lambda v: v["id"].cast("string")), ",")
    return f.select("family", "best_id", "best_score", "n", first.alias("top_variants"))


@query(
    "greedy_budget",
    """WITH RECURSIVE d AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, CASE WHEN cost <= 5000 THEN cost ELSE 0 END AS spent, cost <= 5000 AS selected FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.i, r.spent + CASE WHEN r.spent + d.cost <= 5000 THEN d.cost ELSE 0 END, r.spent + d.cost <= 5000
  FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
SELECT source, doc_id, selected FROM r""",
)
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, in order, while they fit 5,000 estimated tokens; what doesn't fit is passed over."""
    from ..functions.misc import token_estimate

    d = table(spark, sf_dir, "documents").select("source", "doc_id", token_estimate(F.col("text")).alias("cost"))
    return ranking.greedy_budget(d, "source", "doc_id", "cost", 5000)


@query(
    "grid_cap",
    """WITH r AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT o_orderpriority, o_orderstatus, count(*) AS taken, min(o_orderkey) AS least, max(o_orderkey) AS most FROM r WHERE nth <= 5000 GROUP BY ALL""",
)
def grid_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5,000 orders over a grid of priorities and states in its order; the cap falls inside a cell."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_totalprice")
    kept = ranking.capped(o, [F.asc("o_orderpriority"), F.asc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")], 5000)
    return kept.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("taken"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


#: Terms that stand for others: one may stand for several.
_ALIASES = {"y": ("und", "que"), "avec": ("with",), "ces": ("this",)}


@query(
    "match_coverage",
    """WITH want AS (SELECT ['the', 'and', 'of', 'und', 'que', 'les'] AS req, ['with', 'this', 'der', 'los'] AS pref),
w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS t FROM documents),
d AS (SELECT doc_id, list_distinct(list_concat(t, CASE WHEN list_contains(t, 'y') THEN ['und', 'que'] ELSE [] END, CASE WHEN list_contains(t, 'avec') THEN ['with'] ELSE [] END,
  CASE WHEN list_contains(t, 'ces') THEN ['this'] ELSE [] END)) AS t FROM w),
c AS (SELECT doc_id, len(list_intersect(req, t)) AS r, len(list_intersect(pref, t)) AS p FROM d, want)
SELECT doc_id, CAST((2 * r + p) * 100 // 16 AS INT) AS match_score, round(r / 6.0::DOUBLE, 4) AS required_share FROM c""",
)
def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of required terms, which count twice, and preferred ones; aliases stand for the terms they mean."""
    req, pref = ["the", "and", "of", "und", "que", "les"], ["with", "this", "der", "los"]
    wanted = "|".join(sorted({*req, *pref, *_ALIASES}))
    said = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"(?<![a-z0-9])({wanted})(?![a-z0-9])"), F.lit(1))
    d = rules.bound(table(spark, sf_dir, "documents").select("doc_id", "text"), {"t": rules.with_aliases(F.array_distinct(said), _ALIASES)})
    hits = lambda want: F.size(F.array_intersect(F.array(*map(F.lit, want)), "t"))
    d = rules.bound(d, {"r": hits(req), "p": hits(pref)})
    score = F.floor((2 * F.col("r") + F.col("p")) * 100 / (2 * len(req) + len(pref))).cast("int")
    return d.select("doc_id", score.alias("match_score"), F.round(F.col("r") / float(len(req)), 4).alias("required_share"))
