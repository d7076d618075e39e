import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import identity, misc, rules, text, urls, vectors


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.ORG:8443/A/b/?utm_source=x&b=2&a=1#frag", "https://example.org:8443/A/b?a=1&b=2"),
        ("http://example.com", "http://example.com"),
        ("http://example.com/?ref=1", "http://example.com"),
        ("http://example.com/p%20q?x=", "http://example.com/p%20q?x="),
        (" no scheme ", "no scheme"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, urls.canonical(F.col("u")), u=url)[0] == expected


def test_canonical_url_is_stable(spark):
    once = urls.canonical(F.col("u"))
    row = one(spark, once.alias("a"), urls.canonical(once).alias("b"), u="http://X.com/a//?z=1&ref=2&y=3#q")
    assert row["a"] == row["b"]


@pytest.mark.parametrize(
    "link, expected",
    [("/x", "http://h.org/x"), ("y", "http://h.org/a/y"), ("//z.com/q", "http://z.com/q"), ("https://k.net", "https://k.net")],
)
def test_resolve(spark, link, expected):
    assert one(spark, urls.resolve(F.lit("http://h.org/a/b.html"), F.col("l")), l=link)[0] == expected


def test_text(spark):
    r = one(
        spark, text.normalise(F.col("a")).alias("n"), text.shorten(F.col("a"), 5).alias("s"), text.cut_at_marker(F.col("a"), ["APPLY"]).alias("c"),
        text.first_filled(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")).alias("f"), text.mentions(F.col("b"), "on").alias("m"), a=" Ab\t\n C apply now", b="éon on.",
    )
    assert r["n"] == "ab c apply now" and len(r["s"]) <= 5 and r["s"].endswith("…") and r["c"].strip() == "Ab\t\n C".strip() and r["f"] == "x" and r["m"]
    assert not one(spark, text.mentions(F.col("b"), "on"), b="éon")[0]


def test_sections_cover_the_text(spark):
    s = one(spark, text.sections(F.col("a"), "must have", "nice"), a="intro. MUST HAVE x, y. Nice z")[0]
    assert (s.before, s.wanted, s.optional) == ("intro. ", "MUST HAVE x, y. ", "Nice z")
    assert one(spark, text.sections(F.col("a"), "must have", "nice"), a="nothing")[0].before == "nothing"


def test_identities(spark):
    of = lambda **v: one(spark, identity.source_identity(F.col("s"), [F.col("i")], [F.col("u")], [F.col("t")]), **v)[0]
    assert of(s="A", i="REQ-12", u="http://x.com/1", t="a") == of(s=" a ", i="REQ-12", u=None, t="b")
    assert of(s="A", i="http://x.com/12", u="http://x.com/1/", t="a") == of(s="A", i=None, u="HTTP://X.com/1", t="b")
    assert of(s="A", i=None, u=None, t="Some Title") == of(s="A", i="", u=" ", t="some  title")
    assert of(s="A", i="12", u=None, t="") != of(s="B", i="12", u=None, t="")


@pytest.mark.parametrize("score, other, expected", [(50, 99, 60), (50, None, 50), (0, 0, 0), (90, 9, 77), (49, 50, 50), (52, 50, 50)])
def test_pull(spark, score, other, expected):
    assert one(spark, rules.pull(F.lit(score), F.lit(other).cast("int"), 1.5), a=1)[0] == expected


def test_scores_by_density(spark):
    model = rules.ScoreModel(
        rules=(rules.Rule("up", ("good",), 2), rules.Rule("down", ("bad",), -1), rules.Rule("head", ("good",), 1, "title")), floor_words=10, ceiling=200,
        attributes=(("k", "1", 7),), bands=(("b", 50, 3),),
    )
    rows = spark.createDataFrame([("good", "bad good good", "b", 1), ("", "a " * 20 + "bad", None, None), (None, None, None, 2), ("", "Good? goods good_good x", None, None)], "t string, x string, b string, k int")
    got = rules.score(rows, model, "t", "x", band="b").collect()
    # a title of one word and a text of three count as ten words; 2 * 200 - 100 + 100 + 7, then half and 3
    assert (got[0]["raw_score"], got[0]["adjusted_score"], got[0]["final_score"]) == (407, 206, 100)
    assert [(h.rule, h["count"], h.points) for h in got[0]["score_hits"]] == [("up", 2, 400), ("down", 1, -100), ("head", 1, 100), ("k=1", 1, 7)]
    assert (got[1]["raw_score"], got[1]["final_score"]) == (-47, 0)  # one of 21
    assert got[2]["final_score"] == 0 and got[2]["score_hits"] == []
    assert got[3]["score_hits"][0]["count"] == 3


def test_bound_columns_are_computed_once(spark):
    rows = rules.bound(spark.range(3).select(F.col("id").cast("string").alias("x")), {"n": F.regexp_count("x", F.lit("1"))})
    plan = rows.where("n > 0").withColumn("m", F.col("n") + F.col("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") == 1 and rows.where("n > 0").count() == 1


def test_vectors(spark):
    words = [random.Random(1).choice(["aa", "bb", "cc", "dd"]) for _ in range(50)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "z  Y x"), (3, ""), (4, None), (5, "x y z x y z")], "k int, t string")
    bags = vectors.bag(rows, "k", "t")
    got = bags.groupBy("k").agg(F.sum(F.abs("n")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: 50, 2: 3, 5: 6}
    profile = vectors.bag(spark.createDataFrame([(0, "x y z")], "k int, t string"), "k", "t").select("slot", F.col("n").alias("m"))
    near = {r["k"]: r["similarity"] for r in vectors.bag_cosine(bags, profile, "k").collect()}
    assert near[2] == pytest.approx(1) and near[5] == pytest.approx(1) and near[1] < 0.9
    a, b = (one(spark, vectors.text_vector(F.col("a")).alias("v"), a=x)["v"] for x in ("Some  text", "some text "))
    assert a == b and len(a) == 12 and all(0 <= x < 1 for x in a)
    assert one(spark, vectors.cosine(F.array().cast("array<double>"), F.array(F.lit(1.0))), a="x")[0] == 0
    b = [one(spark, vectors.boost(F.lit(s), 0.5, 4.0), a=1)[0] for s in (0.2, 0.5, 0.75, 1.0)]
    assert b == [0, 0, 2, 4]


def test_status_codes(spark):
    codes = [99, 100, 204, 301, 404, 429, 500, 501, 599, 600, None]
    got = spark.createDataFrame([(c,) for c in codes], "c int").select(misc.http_category(F.col("c")), misc.http_transient(F.col("c"))).collect()
    assert [r[0] for r in got] == [None, "informational", "successful", "redirection", "client_error", "client_error", "server_error", "server_error", "server_error", None, None]
    assert [bool(r[1]) for r in got] == [False, False, False, False, False, True, True, False, True, False, False]


def test_misc(spark):
    r = one(
        spark, misc.iso_week(F.lit("2027-01-01").cast("date")).alias("w"), misc.cost(F.lit(1), "0.0125").alias("c"), misc.token_estimate(F.col("a")).alias("t"),
        misc.run_time(F.lit("20260102T030405Z")).cast("string").alias("r"), misc.run_time(F.lit("nothing")).alias("n"), a="abc",
    )
    assert r["w"] == "2026-W53" and str(r["c"]) == "0.000013" and r["t"] == 1 and r["r"] == "2026-01-02 03:04:05" and r["n"] is None
    safe = [one(spark, identity.path_safe(F.col("a")), a=x)[0] for x in ("run-1", "../x", "a/b", "", "a..b")]
    assert safe == [True, False, False, False, False]


def test_unicode_white_space(spark):
    spaces = "".join(map(chr, (0x09, 0x0B, 0x85, 0xA0, 0x1680, 0x2003, 0x2029, 0x202F, 0x3000)))
    assert one(spark, text.normalise(F.col("a")), a=f"{spaces}A{spaces}b ")[0] == "a b"
