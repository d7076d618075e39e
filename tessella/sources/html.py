"""Records embedded in web pages.

Script blocks are found, and data after an assignment is read, in Arrow batches: HTML and JSON need
parsers.  What they hold is then walked and read as columns.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CONTAINERS = {"main", "article", "section", "div"}


class _Reader(HTMLParser):
    """Collects text, script blocks, anchors and the text of containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.scripts, self.links, self.containers = [], [], [], []
        self._open, self._skip, self._script, self._link = [], 0, None, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "script":
            self._script = [attrs.get("type") or "", attrs.get("id") or "", []]
        elif tag == "style":
            self._skip += 1
        elif tag == "a":
            self._link = [attrs.get("href") or "", []]
        if tag in _CONTAINERS:
            self._open.append((tag, attrs.get("id") or "", attrs.get("class") or "", len(self.text)))
        if tag not in _VOID:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            self.scripts.append((self._script[0], self._script[1], "".join(self._script[2])))
            self._script = None
        elif tag == "style":
            self._skip = max(0, self._skip - 1)
        elif tag == "a" and self._link is not None:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None
        elif tag in _CONTAINERS:
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == tag:
                    name, id_, class_, at = self._open.pop(k)
                    self.containers.append((name, id_, class_, " ".join("".join(self.text[at:]).split())))
                    break
        self.text.append(" ")

    def handle_data(self, data):
        if self._script is not None:
            self._script[2].append(data)
        elif not self._skip:
            self.text.append(data)
            if self._link is not None:
                self._link[1].append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def main_content(html: str | None, wanted: tuple[str, ...] = ("main", "article"), least: int = 200) -> str:
    """Text of the first wanted container that is long enough, else of the longest container, else of the page."""
    page = read(html)
    for name in wanted:
        for tag, id_, class_, text in page.containers:
            if name in (tag, id_) or name in class_.split():
                if len(text) >= least:
                    return text
    longest = max((text for *_, text in page.containers), key=len, default="")
    return longest if len(longest) >= least else " ".join("".join(page.text).split())


def objects(value):
    """All objects in parsed JSON, outer ones first."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            yield value
            value = list(value.values())
        if isinstance(value, list):
            waiting += reversed(value)


def assigned(text: str, after: str):
    """The first JSON object or array after ``after``; None if there is none."""
    at = text.find(after)
    start = re.compile(r"[\[{]").search(text, at + len(after)) if at >= 0 else None
    try:
        return json.JSONDecoder().raw_decode(text, start.start())[0] if start else None
    except ValueError:
        return None


def _parse(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _rows(pages: DataFrame, key: str, html: str, schema: str, names: list[str], of) -> DataFrame:
    """(key, *names) for every tuple that ``of(html)`` yields."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in of(page):
                    keys.append(k)
                    out.append(row)
            columns = [pa.array([r[i] for r in out], pa.int32() if n == "_ord" else pa.string()) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), *columns], [key, *names])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, {schema}")


def embedded_json(pages: DataFrame, key: str, html: str, node_type: str | None = None, script_id: str | None = None, assignment: str | None = None) -> DataFrame:
    """(key, _ord, node): objects in the page's JSON, as text.

    ``node_type`` looks into linked-data scripts for objects of that @type; ``script_id`` into the script
    of that id; ``assignment`` into the data that is assigned after that text.
    """

    def of(page):
        found = []
        scripts = read(page).scripts
        if node_type:
            blocks = [_parse(body) for kind, _, body in scripts if kind.strip().lower() == "application/ld+json"]
            wanted = lambda o: node_type in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")])
        elif script_id:
            blocks, wanted = [_parse(body) for _, id_, body in scripts if id_ == script_id], lambda o: True
        else:
            blocks, wanted = [assigned(page or "", assignment)], lambda o: True
        for block in blocks:
            found += [o for o in objects(block) if wanted(o)]
        return [(i, json.dumps(o, sort_keys=True, ensure_ascii=False)) for i, o in enumerate(found)]

    return _rows(pages, key, html, "_ord int, node string", ["_ord", "node"], of)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _ord, href, title): anchors with text, in order."""
    return _rows(pages, key, html, "_ord int, href string, title string", ["_ord", "href", "title"], lambda p: [(i, h, t) for i, (h, t) in enumerate(read(p).links) if h and t])


def contents(pages: DataFrame, key: str, html: str, least: int = 200) -> DataFrame:
    """(key, content): main content of every page."""
    return _rows(pages, key, html, "content string", ["content"], lambda p: [(main_content(p, least=least),)])


def location(value) -> str | None:
    """The place that JSON names: text, an object's address or else its name, or the first of a list that gives one, lists in it opened."""
    waiting = [value]
    while waiting:
        value = waiting.pop()
        if isinstance(value, list):
            waiting += reversed(value)
        elif isinstance(value, dict):
            address = value.get("address")
            parts = [_text(address.get(p)) for p in ("addressLocality", "addressRegion", "addressCountry")] if isinstance(address, dict) else []
            if found := ", ".join(p for p in parts if p) or _text(value.get("name")):
                return found
        elif found := _text(value):
            return found
    return None


def _text(value) -> str:
    return value.strip() if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def postings(nodes: DataFrame, key: str) -> DataFrame:
    """Fields of linked-data nodes: url, title, organisation, location; first wins on url in each page; both must be there.

    A location is text, an object with a name or an address, or a list of which the first that gives one counts,
    however long the list is, lists in it opened.  Spark's JSON parser reads 1,000 levels; a node with more is no posting.
    """
    from ..operators.diff import one_a_key
    from .json_docs import field

    v = F.col("__v")
    get = lambda path: F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))

    @F.pandas_udf("string")
    def place(texts: pd.Series) -> pd.Series:
        return pd.Series([location(_parse(t)) for t in texts], dtype=object)

    fields = F.struct(
        field(v, "url", "sameAs").alias("url"), field(v, "title", "name").alias("title"),
        F.coalesce(get("$.hiringOrganization.name"), get("$.publisher.name"), F.when(~F.startswith(get("$.hiringOrganization"), F.lit("{")), get("$.hiringOrganization"))).alias("organisation"),
        F.to_json(F.try_variant_get(v, "$.jobLocation", "variant")).alias("location"),
    )
    # out of a generator, so that a node is parsed once and not for each use of a field
    parsed = nodes.select(key, "_ord", F.try_parse_json("node").alias("__v"))
    rows = parsed.select(key, "_ord", F.explode(F.array(fields)).alias("__r")).select(key, "_ord", "__r.*")
    first = one_a_key(rows.where("url IS NOT NULL AND title IS NOT NULL"), [key, "url"], "_ord", last=False)
    return first.withColumn("location", place("location"))


def with_fallback(pages: DataFrame, html: str, cache: DataFrame, value: str) -> DataFrame:
    """``pages`` with the cached ``value`` of their content's hash; a miss is an error when it is read."""
    keyed = pages.withColumn("__h", F.sha2(F.coalesce(html, F.lit("")), 256))
    joined = keyed.join(cache.select(F.col("hash").alias("__h"), F.col(value).alias("__v")), "__h", "left")
    found = F.when(F.col("__v").isNotNull(), F.col("__v")).otherwise(F.raise_error(F.concat(F.lit("not cached: "), F.col("__h"))))
    return joined.withColumn(value, found).drop("__h", "__v")
