import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.sources import html, json_docs, sinks, snapshots
from tessella.streaming import last_seen

PAGE = """<html><head><style>p{}</style><script type="application/ld+json">
{"@graph": [{"@type": "Posting", "title": "A", "url": "http://x/1", "jobLocation": {"address": {"addressLocality": "Ulm", "addressCountry": "DE"}}, "hiringOrganization": {"name": "Org"}},
 {"@type": ["Thing", "Posting"], "title": "B", "url": "http://x/2", "jobLocation": ["", {"name": "Bonn"}]},
 {"@type": "Posting", "title": "C", "url": "http://x/1"}, {"@type": "Posting", "url": "http://x/3"}]}
</script><script id="data">{"a": {"b": [1, {"c": 2}]}}</script><script>window.app = {"k": {"v": "}"}}; x()</script></head>
<body><a href="/j/1">First <b>job</b></a><a href="/j/2"></a><div id="main">""" + "word " * 80 + "</div></body></html>"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>broken")], "page_id int, html string")


def test_linked_data(pages):
    nodes = html.embedded_json(pages, "page_id", "html", node_type="Posting")
    assert nodes.count() == 4
    got = sorted(map(tuple, html.postings(nodes, "page_id").select("url", "title", "organisation", "location").collect()))
    assert got == [("http://x/1", "A", "Org", "Ulm, DE"), ("http://x/2", "B", None, "Bonn")]


def test_script_data_and_assignments(pages):
    found = [json.loads(r["node"]) for r in html.embedded_json(pages, "page_id", "html", script_id="data").collect()]
    assert found == [{"a": {"b": [1, {"c": 2}]}}, {"b": [1, {"c": 2}]}, {"c": 2}]
    assert html.assigned('x = {"a": {"b": "}{"}} + {', "x =") == {"a": {"b": "}{"}} and html.assigned("x = {", "x =") is None and html.assigned("", "x =") is None


def test_links_and_content(pages):
    assert [(r["href"], r["title"]) for r in html.links(pages, "page_id", "html").collect()] == [("/j/1", "First job")]
    text = {r["page_id"]: r["content"] for r in html.contents(pages, "page_id", "html").collect()}
    assert text[1].startswith("word word") and text[2] == "" and text[3] == "broken"


def test_fallback_misses_are_errors(spark, pages):
    cache = pages.where("page_id <> 3").select(F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"), F.lit("v").alias("v"))
    assert html.with_fallback(pages.where("page_id <> 3"), "html", cache, "v").count() == 2
    with pytest.raises(Exception, match="not cached"):
        html.with_fallback(pages, "html", cache, "v").collect()


def test_tolerant_json(spark, tmp_path):
    for name, body in {"a": '[{"x": 1}, 5, {"x": 2}]', "b": "nonsense", "c": '{"records": [{"x": 3}]}', "d": '"text"'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = json_docs.read_tolerant(spark, str(tmp_path))
    assert sorted((r["_ord"], r["x"]) for r in got.select("_ord", json_docs.field(F.col("record"), "y", "x").alias("x")).collect()) == [(0, "1"), (2, "2")]
    assert sorted(r[0] for r in json_docs.read_records(spark, str(tmp_path)).select(json_docs.field(F.col("record"), "x")).collect()) == ["1", "2", "3"]


def test_ids_and_first_wins(spark):
    d = spark.createDataFrame([("", "u", "t", 0), ("i", "u", "t", 1), (None, "U", "T", 2)], "id string, url string, title string, _ord int")
    ids = [r["id"] for r in json_docs.with_ids(d, "id", "url", "title").orderBy("_ord").collect()]
    assert ids[0] == ids[2] and ids[1] == "i"
    assert json_docs.first_wins(d, "url").count() == 2


class Down(snapshots.Provider):
    def live(self):
        raise OSError("down")

    def snapshot(self):
        return [{"id": 1}, "no record", {"id": 2}]


def test_provider_falls_back_to_its_snapshot(spark):
    snapshots.register(spark, {"p": Down()})
    got = spark.read.format("provider").option("ids", "p,p").option("mode", "live").load().orderBy("_ord").collect()
    assert [json.loads(r["record"])["id"] for r in got] == [1, 2]
    with pytest.raises(ValueError):
        snapshots.resolve_ids("q", {"p": Down()})


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, None), (1, "x|y")], "b int, a string")
    sinks.write_json(d, str(tmp_path / "j"), [F.col("b")])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x|y","b":1}', '{"a":null,"b":2}']
    assert sinks.markdown(d, [F.col("b")], 1, ["b", "a"]).splitlines()[-1] == "| 1 | x\\|y |"
    hashes = sinks.file_hashes(spark, str(tmp_path / "j" / "part*")).cache()
    assert sinks.verify(hashes, hashes).count() == 0
    assert sinks.verify(hashes.limit(0), hashes).first()["problem"] == "missing"
    plan = sinks.publish_plan(spark.createDataFrame([("f",), ("g",)], "name string"), "r1", ["f"])
    assert sorted(r["target"] for r in plan.collect()) == ["latest/f", "runs/r1/f", "runs/r1/g"]


def test_stream_follows_state(spark, tmp_path):
    source, schema = tmp_path / "in", "id int, ts int, score int, h string"
    spark.createDataFrame([(1, 1, 10, "a"), (2, 1, 10, "a")], schema).coalesce(1).write.parquet(str(source / "p1"))
    args = dict(key="id", ts="ts", score="score", content="h", threshold=5, alerts_path=str(tmp_path / "a"), checkpoint=str(tmp_path / "c"))
    run = lambda: last_seen.follow(spark.readStream.schema(schema).parquet(str(source / "p*")), **args).awaitTermination(120)
    assert run()
    spark.createDataFrame([(1, 2, 20, "a"), (3, 2, 1, "z"), (2, 2, 11, "b")], schema).coalesce(1).write.parquet(str(source / "p2"))
    assert run()
    got = sorted((r["batch"], r["id"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "a")).collect())
    assert got == [(0, 1, "new"), (0, 2, "new"), (1, 1, "score"), (1, 2, "content"), (1, 3, "new")]
    assert run()  # nothing new: no batch, and nothing twice
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5


def test_late_rows_are_dropped(spark, tmp_path):
    spark.createDataFrame([("u", "2026-01-01 00:10:00", 1), ("u", "2026-01-01 00:20:00", 0)], "u string, t string, f int").selectExpr("u", "timestamp(t) ts", "f").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, ts timestamp, f int").parquet(str(tmp_path / "in"))
    q = last_seen.failing_users(stream, "u", "ts", F.col("f") == 1, "1 hour").writeStream.format("memory").queryName("failing").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["u"], r["failures"], r["n"]) for r in spark.table("failing").collect()] == [("u", 1, 2)]


def test_cards_of_messy_pages():
    from tessella.sources import cards

    page = """<ul><li><h3>Engineer, Data - Search / Paris</h3><a href=/1>Apply</a><span class="posting-team">Search</span><div id=office>Paris
      <li><a href="/2"><h2>Cook (Lyon)</h2><span class=location>Lyon</span></a><li><a href="/3">Two</a> <a href="/4">Three</a><h4>Not theirs</h4></ul>
      <div class="job card"><p>x<p><a href="/5">Paris</a><i class=location>Paris</i></div></b><a href="/6">Alone</a><a href=>No target</a><a href="/7"> </a>"""
    assert cards.cards_of(page) == [
        ("/1", "Engineer, Data", "li", "Search", "Paris"), ("/2", "Cook", "li", None, "Lyon"), ("/3", "Two", "li", None, None), ("/4", "Three", "li", None, None),
        ("/5", "Paris", "div", None, "Paris"), ("/6", "Alone", None, None, None),
    ]
    assert cards.cards_of(None) == [] and cards.stripped("Macbook", ["book"]) == "Macbook"
    deep = "<div>" * 20_000 + '<a href="/x">t</a>'
    assert cards.cards_of(deep) == [("/x", "t", None, None, None)]


def test_strict_pages_are_errors(spark):
    from tessella.sources.cards import parsed

    d = spark.createDataFrame([(1, '<a href="/x">t</a>'), (2, "none")], "id int, h string")
    assert sorted(map(tuple, parsed(d, "id", "h", "T", "data =").collect())) == [(1, "cards", 1), (2, "none", 0)]
    with pytest.raises(PySparkException, match="no rows in page 2"):
        parsed(d, "id", "h", "T", "data =", strict=True).collect()


def test_part_pages_are_dealt_before_they_are_parsed(spark, small):
    """A table of one partition is parsed in as many tasks as there are cores."""
    from tessella.queries.text import _part_pages

    pages = _part_pages(spark, small)
    tasks = pages.select("p_partkey", F.spark_partition_id().alias("t")).groupBy("t").count().count()
    assert tasks > 1 and pages.count() == spark.read.parquet(f"{small}/part.parquet").count()


def test_a_node_is_parsed_once(pages):
    found = html.postings(html.embedded_json(pages, "page_id", "html", node_type="Posting"), "page_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def _locations(spark, *found):
    pages = [(1, '<script type="application/ld+json">' + json.dumps({"@type": "Posting", "title": f"T{i}", "url": f"u{i:03}", "jobLocation": x}) + "</script>") for i, x in enumerate(found)]
    nodes = html.embedded_json(spark.createDataFrame(pages, "page_id int, html string"), "page_id", "html", node_type="Posting")
    return [r["location"] for r in html.postings(nodes, "page_id").orderBy("url").collect()]


def test_a_location_may_stand_anywhere_in_a_list(spark):
    deep = "Ulm"
    for _ in range(50):
        deep = ["", deep]
    lists = [["", {}, "Ulm"], [""] * 500 + [{"name": "Bonn"}, "x"], [[], [None, ["", [" "]]], [{"address": {"addressCountry": "DE"}}]], deep, ["", None, {"name": ""}], []]
    assert _locations(spark, *lists) == ["Ulm", "Bonn", "DE", "Ulm", None, None]


def test_forms_of_a_location(spark):
    forms = ["[Remote] Ulm", "{x}", " ", None, {"address": "Street", "name": "Bonn"}, {"address": {"addressLocality": "Ulm", "addressRegion": " ", "addressCountry": "DE"}, "name": "x"}, {"address": {}, "name": "Köln"}, ["[x]"], 5]
    assert _locations(spark, *forms) == ["[Remote] Ulm", "{x}", None, None, "Bonn", "Ulm, DE", "Köln", "[x]", "5"]


def test_first_wins_within_a_page(spark, pages):
    """Pages that share postings keep theirs, whichever is read first."""
    both = pages.where("page_id = 1").union(pages.where("page_id = 1").select(F.lit(9), "html")).repartition(2, "page_id")
    got = sorted(map(tuple, html.postings(html.embedded_json(both, "page_id", "html", node_type="Posting"), "page_id").select("page_id", "url", "title").collect()))
    assert got == [(p, u, t) for p in (1, 9) for u, t in (("http://x/1", "A"), ("http://x/2", "B"))]
