"""Text, URL and HTML queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, phrases, text, urls
from ..functions.phrases import Lexicon
from ..operators.ranking import kept_rows
from ..registry import query, table
from ..sources import html

_NORM = "lower(trim(regexp_replace(coalesce({0}, ''), '" + text.SPACE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')))"


@query(
    "text_normalize",
    f"""
SELECT doc_id, length({_NORM.format('text')}) AS n_norm, sha256({_NORM.format('text')}) AS text_hash,
       sha256(concat_ws(chr(31), {_NORM.format('source')}, {_NORM.format('lang')}, {_NORM.format('text')})) AS content_fingerprint
FROM documents
""",
)
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    norm = text.normalise(F.col("text"))
    return d.select(
        "doc_id", F.length(norm).cast("long").alias("n_norm"), F.sha2(norm, 256).alias("text_hash"),
        identity.fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("content_fingerprint"),
    )


_CANONICAL = """
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q FROM pages),
v AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND
        lower(split_part(p, '=', 1)) NOT IN ('ref', 'fbclid', 'gclid') AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_'))), '&') AS kept FROM u),
c AS (SELECT page_id, url, path, CASE WHEN scheme = '' THEN trim(url) ELSE scheme || '://' || host || rtrim(path, '/') ||
        CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url_canonical FROM v)
"""


@query("url_canonical", f"WITH {_CANONICAL} SELECT page_id, url_canonical, regexp_extract(path, '/([0-9]+)(?:[.][a-z]+)?/*$', 1) AS path_id FROM c")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(url).alias("url_canonical"), urls.numeric_id(url).alias("path_id"))


@query(
    "url_identity_dedupe",
    f"""WITH {_CANONICAL}
SELECT page_id, sha256(concat_ws(chr(31), 'pages', 'url', url_canonical)) AS identity, min(page_id) OVER w AS kept_page_id FROM c WINDOW w AS (PARTITION BY url_canonical)""",
)
def url_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the first one that shares its canonical URL."""
    key = identity.source_identity(F.lit("pages"), [F.lit(None).cast("string")], [F.col("url")], [])
    rows = table(spark, sf_dir, "pages").select("page_id", key.alias("identity"))
    return kept_rows(rows, ["identity"], [F.col("page_id")], "page_id")


@query(
    "identity_modes",
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'REQ-' || (1000 + p_partkey) WHEN 1 THEN ' ' WHEN 2 THEN 'https://x.org/' || p_partkey ELSE NULL END AS ref,
  CASE WHEN p_partkey % 3 = 0 THEN 'HTTP://Jobs.Example.org/' || p_partkey || '/?b=1&a=2#top' END AS url, lower(trim(p_name)) AS name FROM part),
c AS (SELECT *, 'http://jobs.example.org/' || p_partkey || '?a=2&b=1' AS clean FROM r)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ref END AS requisition,
  CASE WHEN trim(coalesce(ref, '')) <> '' THEN ref WHEN url IS NOT NULL THEN clean ELSE sha256(name) END AS record_id,
  'parts:' || CASE WHEN trim(coalesce(ref, '')) <> '' THEN ref WHEN url IS NOT NULL THEN clean ELSE sha256(name) END AS delta_id,
  sha256(concat_ws(chr(31), 'parts', CASE WHEN p_partkey % 4 = 0 THEN 'id' WHEN url IS NOT NULL THEN 'url' ELSE 'text' END,
    CASE WHEN p_partkey % 4 = 0 THEN ref WHEN url IS NOT NULL THEN clean ELSE name END)) AS source_identity FROM c""",
)
def identity_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requisition numbers, record ids, delta ids and identities within a source, by id, URL or description."""
    k = F.col("p_partkey")
    ref = F.when(k % 4 == 0, F.concat(F.lit("REQ-"), k + 1000)).when(k % 4 == 1, " ").when(k % 4 == 2, F.concat(F.lit("https://x.org/"), k))
    url = F.when(k % 3 == 0, F.concat(F.lit("HTTP://Jobs.Example.org/"), k, F.lit("/?b=1&a=2#top")))
    p = table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"), url.alias("url"), "p_name")
    given = [F.col("ref")], [F.col("url")], [F.col("p_name")]
    return p.select(
        "p_partkey", identity.requisition(F.col("ref")).alias("requisition"), identity.record_id(*given).alias("record_id"),
        identity.delta_id(F.lit(" Parts"), *given).alias("delta_id"), identity.source_identity(F.lit("Parts "), *given).alias("source_identity"),
    )


@query(
    "safe_names",
    """WITH n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'run-' || event_id WHEN 1 THEN '../' || event_id WHEN 2 THEN 'a/' || event_id WHEN 3 THEN 'a..' || event_id ELSE '.' || event_id END AS name FROM events)
SELECT event_id, event_id % 5 = 0 AS safe FROM n""",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names may become folders."""
    i = F.col("event_id")
    forms = [F.concat(F.lit(p), i) for p in ("run-", "../", "a/", "a..", ".")]
    name = F.when(i % 5 == 0, forms[0]).when(i % 5 == 1, forms[1]).when(i % 5 == 2, forms[2]).when(i % 5 == 3, forms[3]).otherwise(forms[4])
    return table(spark, sf_dir, "events").select("event_id", identity.path_safe(name).alias("safe"))


@query(
    "relative_links",
    """WITH b AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages),
d AS (SELECT *, lower(s) || '://' || lower(h) AS root, regexp_extract(p, '^(.*/)', 1) AS folder FROM b)
SELECT page_id, CASE WHEN page_id % 4 <> 0 AND coalesce(s, '') = '' THEN NULL ELSE CASE page_id % 4 WHEN 0 THEN 'https://other.org/x' WHEN 1 THEN lower(s) || '://cdn.org/y' WHEN 2 THEN root || '/top' ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || 'next' END END AS link FROM d""",
)
def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute, protocol-relative, rooted and relative links, as seen from their page."""
    i = F.col("page_id") % 4
    link = F.when(i == 0, "https://other.org/x").when(i == 1, "//cdn.org/y").when(i == 2, "/top").otherwise("next")
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve(F.col("url"), link).alias("link"))


def _postings_html() -> Column:
    """Pages that carry a linked-data record of a part, in one of three forms, and two links."""
    k, name = F.col("p_partkey"), F.col("p_name")
    place = F.when(k % 3 == 0, '"Lyon"').when(k % 3 == 1, '{"address": {"addressLocality": "Bonn", "addressCountry": "DE"}}').otherwise('[{"name": "Remote"}, "x"]')
    record = F.format_string('{"@graph": [{"@type": "JobPosting", "title": "%s", "url": "http://p.org/%d", "hiringOrganization": {"name": "B } Co"}, "jobLocation": %s}]}', name, k, place)
    data = F.format_string('<script>var x = 1; window.__DATA = {"size": %d, "note": "a } brace", "inner": {"brand": "%s"}};</script>', F.col("p_size"), F.col("p_brand"))
    links = F.format_string('<a href="/item/%d">Item %d</a><a href="/empty"></a>', k, k)
    return F.concat(F.lit("<html><body>"), data, F.lit('<script type="application/ld+json">'), record, F.lit("</script>"), links, F.lit("</body></html>"))


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of parts.  A row of some bytes becomes a page that is parsed, and a million rows may be one partition of the file: they are dealt first."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(tasks, "p_partkey").select("p_partkey", _postings_html().alias("html"))


@query(
    "linked_data_postings",
    """SELECT p_partkey, 'http://p.org/' || p_partkey AS url, trim(p_name) AS title, 'B } Co' AS organisation,
  CASE p_partkey % 3 WHEN 0 THEN 'Lyon' WHEN 1 THEN 'Bonn, DE' ELSE 'Remote' END AS location FROM part""",
)
def linked_data_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a type, from the linked data in pages; location is text, an address or a list."""
    nodes = html.embedded_json(_part_pages(spark, sf_dir), "p_partkey", "html", node_type="JobPosting")
    return html.postings(nodes, "p_partkey").select("p_partkey", "url", "title", "organisation", "location")


@query("assigned_data", "SELECT p_partkey, 0 AS n, p_size::BIGINT AS size, NULL AS brand FROM part UNION ALL SELECT p_partkey, 1, NULL, p_brand FROM part")
def assigned_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in data that a script assigns; braces inside its strings don't end it."""
    nodes = html.embedded_json(_part_pages(spark, sf_dir), "p_partkey", "html", assignment="window.__DATA =")
    v = F.parse_json("node")
    return nodes.select("p_partkey", F.col("_ord").alias("n"), F.try_variant_get(v, "$.size", "long").alias("size"), F.try_variant_get(v, "$.brand", "string").alias("brand"))


@query("page_links", "SELECT p_partkey, '/item/' || p_partkey AS href, 'Item ' || p_partkey AS title FROM part")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with text."""
    return html.links(_part_pages(spark, sf_dir), "p_partkey", "html").select("p_partkey", "href", "title")


_HTML = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), "
    "'(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), "
    f"'{text.SPACE}', ' ', 'g'))"
)


@query("html_text", f"SELECT page_id, length({_HTML}) AS n_chars, sha256({_HTML}) AS text_hash FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(found).cast("long").alias("n_chars"), F.sha2(found, 256).alias("text_hash"))


@query(
    "page_validation",
    r"""
SELECT reason, count(*) AS n, min(page_id) AS first_page FROM (
  SELECT page_id, CASE WHEN html IS NULL OR trim(html) = '' THEN 'empty'
    WHEN length(html) < 400 THEN 'too_short'
    WHEN NOT regexp_matches(lower(html), '<html|<body') THEN 'no_markup'
    WHEN contains(lower(html), 'captcha') THEN 'captcha'
    WHEN contains(lower(html), 'access denied') THEN 'denied'
    WHEN NOT regexp_matches(lower(html), '<p|<li|<td') THEN 'no_content'
    WHEN NOT contains(lower(html), '<title') THEN 'no_title' ELSE 'valid' END AS reason FROM pages)
GROUP BY reason
""",
)
def page_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason, in order, for which a page isn't usable."""
    html = F.col("html")
    low = F.lower(html)
    reason = (
        F.when(html.isNull() | (F.trim(html) == ""), "empty")
        .when(F.length(html) < 400, "too_short")
        .when(~low.rlike("<html|<body"), "no_markup")
        .when(F.contains(low, F.lit("captcha")), "captcha")
        .when(F.contains(low, F.lit("access denied")), "denied")
        .when(~low.rlike("<p|<li|<td"), "no_content")
        .when(~F.contains(low, F.lit("<title")), "no_title")
        .otherwise("valid")
    )
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    "text_windows",
    """
WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
p AS (SELECT *, nullif(instr(low, ' with '), 0) AS m1, nullif(instr(low, ' und '), 0) AS m2, instr(low, 'for') AS a, instr(low, 'this') AS b,
      instr(low, 'idiot') AS t1, instr(low, 'pour') AS t2 FROM d),
q AS (SELECT *, least(m1, m2) AS m, length(text) + 1 AS e, coalesce(nullif(t1, 0), nullif(t2, 0)) AS t,
      CASE WHEN t1 > 0 THEN 'idiot' WHEN t2 > 0 THEN 'pour' END AS term FROM p)
SELECT doc_id,
  sha256(CASE WHEN m > 1 THEN rtrim(substr(text, 1, m - 1)) ELSE text END) AS cut_hash,
  length(CASE WHEN a = 0 AND b = 0 THEN text ELSE substr(text, 1, least(CASE WHEN a > 0 THEN a ELSE e END, CASE WHEN b > 0 THEN b ELSE e END) - 1) END) AS n_before,
  length(CASE WHEN a = 0 THEN '' ELSE substr(text, a, CASE WHEN b > a THEN b ELSE e END - a) END) AS n_wanted,
  length(CASE WHEN b = 0 THEN '' ELSE substr(text, b, CASE WHEN a > b THEN a ELSE e END - b) END) AS n_optional,
  term AS trigger_term, substr(text, greatest(1, t - 20), t + length(term) + 20 - greatest(1, t - 20)) AS trigger_context,
  CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substr(text, 1, 39)) || '…' END AS short
FROM q
""",
)
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate cuts, sections, trigger contexts and shortening."""
    x = F.col("text")
    found = table(spark, sf_dir, "documents").select(
        "doc_id", text.cut_at_marker(x, [" with ", " und "]).alias("cut"), text.sections(x, "for", "this").alias("s"),
        text.trigger(x, ["idiot", "pour"]).alias("t"), text.shorten(x, 40).alias("short"),
    )
    size = lambda c: F.length(c).cast("long")
    return found.select(
        "doc_id", F.sha2("cut", 256).alias("cut_hash"), size("s.before").alias("n_before"), size("s.wanted").alias("n_wanted"), size("s.optional").alias("n_optional"),
        F.col("t.term").alias("trigger_term"), F.col("t.context").alias("trigger_context"), "short",
    )


@query(
    "keyword_topk",
    """
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1)) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM t WHERE length(word) >= 4 GROUP BY word)
SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 50
""",
)
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent words of four or more letters."""
    from ..operators.ranking import top

    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).where(F.length("word") >= 4)
    return top(words.groupBy("word").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("word")], 50).withColumn("rank", F.col("rank").cast("long"))


@query(
    "conversation_rollup",
    """
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text)) AS chars,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id
""",
)
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"),
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"),
    )


_LEXICON = Lexicon(
    terms={"the": ("article",), "and": ("joiner",), "of the": ("relation", "article"), "and the": ("joiner", "article"), "password": ("credential",), "token": ("credential",), "in der": ("place",), "idiot": ("insult",), "stupid": ("insult",)},
    gates={"place": "german"},
    triggers={"german": ("und", "für")},
    markers={"api key": "keys", "secret": "keys", "license": "legal"},
)


#: The same lexicon for the oracle: its phrases longest first, words two spaces apart so that matches share none.
_PHRASE_SQL = r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents),
m AS (SELECT doc_id, regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', ' (of  the|and  the|in  der|api  key|the|and|password|token|idiot|stupid|secret|license|und|für) ', 1) AS l FROM d),
e AS (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM m),
s AS (SELECT doc_id, p, i, coalesce(last_value(CASE p WHEN 'api  key' THEN 'keys' WHEN 'secret' THEN 'keys' WHEN 'license' THEN 'legal' END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'other') AS section, bool_or(p IN ('und', 'für')) OVER (PARTITION BY doc_id) AS german FROM e),
t AS (SELECT doc_id, section, german, unnest(CASE p WHEN 'the' THEN ['article'] WHEN 'and' THEN ['joiner'] WHEN 'of  the' THEN ['relation', 'article'] WHEN 'and  the' THEN ['joiner', 'article']
        WHEN 'password' THEN ['credential'] WHEN 'token' THEN ['credential'] WHEN 'in  der' THEN ['place'] WHEN 'idiot' THEN ['insult'] WHEN 'stupid' THEN ['insult'] ELSE [] END) AS term FROM s)
"""


@query("phrase_terms", _PHRASE_SQL + "SELECT doc_id, section, term, count(*) AS n FROM t WHERE term <> 'place' OR german GROUP BY ALL")
def phrase_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of single words and phrases, one-to-many, gated and by section, in one pass over each text."""
    return phrases.find(table(spark, sf_dir, "documents"), "doc_id", "text", _LEXICON).groupBy("doc_id", "section", "term").agg(F.count("*").alias("n"))


@query(
    "routed_terms",
    _PHRASE_SQL
    + """, b AS (SELECT doc_id, term, min(CASE section WHEN 'keys' THEN 1 WHEN 'legal' THEN 2 ELSE 3 END) AS place FROM t WHERE term <> 'place' OR german GROUP BY ALL)
SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms, coalesce(string_agg(term, ',' ORDER BY term) FILTER (place = 1), '') AS keys, coalesce(string_agg(term, ',' ORDER BY term) FILTER (place = 2), '') AS legal FROM b GROUP BY doc_id""",
)
def routed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's terms, each routed to the first of the sections that it occurs in."""
    found = phrases.routed(phrases.find(table(spark, sf_dir, "documents"), "doc_id", "text", _LEXICON), "doc_id", ["keys", "legal"])
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("terms", "keys", "legal")])


@query(
    "numeric_flags",
    r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '([0-9]{2,9})[^0-9a-z]+[a-z]') THEN 'number=' || CAST(regexp_extract(t, '([0-9]{2,9})[^0-9a-z]+[a-z]', 1) AS BIGINT) END,
  CASE WHEN regexp_matches(t, 'akia([0-9]*)') THEN 'access=' || coalesce(TRY_CAST(regexp_extract(t, 'akia([0-9]*)', 1) AS BIGINT)::VARCHAR, '') END, CASE WHEN regexp_matches(t, 'idiot|stupid') THEN 'insult=' END], lambda x: x IS NOT NULL), ';') AS flags FROM d""",
)
def numeric_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with the number that they name."""
    t = F.lower(F.coalesce("text", F.lit("")))
    found = phrases.flags(t, [("number", "([0-9]{2,9})[^0-9a-z]+[a-z]", 1), ("access", "akia([0-9]*)", 1), ("insult", "idiot|stupid", None)])
    joined = F.array_join(F.transform(found, lambda f: F.concat(f["name"], F.lit("="), F.coalesce(f["value"].cast("string"), F.lit("")))), ";")
    return table(spark, sf_dir, "documents").select("doc_id", joined.alias("flags"))


_PAGE_ANCHORS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS title FROM pages),
n AS (SELECT page_id, href, trim(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM a)"""


@query(
    "page_cards",
    f"""WITH {_PAGE_ANCHORS}
SELECT page_id, href, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN rtrim(title, ' -–—|,·([/:') ELSE title END AS title, 'li' AS card, CASE WHEN page_id % 2 = 0 THEN 'Team ' || page_id END AS team, CASE WHEN page_id % 3 = 0 THEN 'Berlin' END AS location, count(*) AS n FROM n WHERE title <> '' GROUP BY ALL""",
)
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of whole pages, whose list items also name teams and places, with the fields of their cards and titles without them."""
    from ..sources.cards import cards

    i = F.col("page_id")
    team, place = F.concat(F.lit("Team "), i.cast("string")), F.lit("Berlin")
    said = F.concat(F.when(i % 2 == 0, F.concat(F.lit(" - "), team)).otherwise(""), F.when(i % 3 == 0, F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""))
    around = F.concat(
        F.lit('<li class="x"><div><a href="$1">$2'), said, F.lit("</a></div>"),
        F.when(i % 2 == 0, F.concat(F.lit('<span class="job-team">'), team, F.lit("</span>"))).otherwise(""), F.when(i % 3 == 0, F.lit('<p data-kind="location">Berlin<p>')).otherwise(""), F.lit("</li>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", F.lit('<li><a href="([^"]*)">([^<]*)</a></li>'), around).alias("html"))
    return cards(pages, "page_id", "html").groupBy("page_id", "href", "title", "card", "team", "location").agg(F.count("*").alias("n"))


@query(
    "page_sources",
    f"""WITH {_PAGE_ANCHORS}, c AS (SELECT page_id, count(*) AS n FROM n WHERE title <> '' GROUP BY 1)
SELECT p.page_id, CASE WHEN p.page_id % 5 = 0 THEN 'linked_data' WHEN p.page_id % 5 = 1 THEN 'assigned' WHEN c.n IS NULL THEN 'none' ELSE 'cards' END AS source,
  CASE WHEN p.page_id % 5 = 0 THEN 2 WHEN p.page_id % 5 = 1 THEN 1 ELSE coalesce(c.n, 0) END AS n FROM pages p LEFT JOIN c USING (page_id)""",
)
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which way whole pages can be read: linked data, assigned data or cards."""
    from ..sources.cards import parsed

    i = F.col("page_id")
    linked = '<script type="application/ld+json">[{"@type": "Posting", "url": "/a"}, {"@graph": [{"@type": ["Posting"]}]}]</script>'
    more = F.when(i % 5 == 0, linked).when(i % 5 == 1, '<script>window.appData = {"url": "/b", "x": "};"};</script>').otherwise("")
    return parsed(table(spark, sf_dir, "pages").select("page_id", F.concat("html", more).alias("html")), "page_id", "html", "Posting", "window.appData")
