"""Cards around anchors: a page as a tree with links to parents, and what stands near each anchor in it.

Every anchor with text belongs to the nearest element above it that looks like a card: a list item, a table row, an article,
or an element one of whose classes is named so.  The card's other elements give fields by their classes; the title loses what
only repeats a field at its end.  A page is parsed in an Arrow batch by a worker; unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import _rows, embedded_json

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
#: A start tag of the key ends open elements of the first set, up to a container of the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "p": ({"p"}, {"div", "li", "td", "article", "section", "main", "nav", "body"}),
    "option": ({"option"}, {"select"}),
}
CARD_TAGS = frozenset({"li", "tr", "article"})
CARD_CLASSES = frozenset({"card", "posting", "opening", "job", "item"})
FIELDS = {"team": ("team", "department"), "location": ("location", "office")}
_PARTING = re.compile(r"[\s\-\u2013\u2014|,\u00b7(\[/:]+$")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "inside")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []
        if parent is not None:
            parent.inside.append(self)

    def nodes(self) -> Iterator[Node]:
        """This and all elements below, in the page's order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in _SILENT:
                out.append(" ")
                stack += [" ", *reversed(x.inside)]
        return " ".join("".join(out).split())

    def words(self) -> set[str]:
        """Parts of the element's classes, id and data attributes."""
        named = " ".join(str(v or "") for k, v in self.attrs.items() if k in ("class", "id") or k.startswith("data-"))
        return set(re.split(r"[^a-z0-9]+", named.lower()))

    def above(self, fits) -> Node | None:
        """The nearest element above this that ``fits``."""
        node = self.parent
        while node is not None and not fits(node):
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        (ends, within), node = _ENDS.get(tag, ((), ())), self.at
        while ends and node is not None and node.tag not in within:
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        made = Node(tag, dict(attrs), self.at)
        if tag not in _VOID:
            self.at = made

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def tree(html: str | None) -> Node:
    """The page's root."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def is_card(node: Node) -> bool:
    return node.tag in CARD_TAGS or bool(CARD_CLASSES & node.words())


def stripped(title: str, fields: list[str]) -> str:
    """``title`` without fields that it repeats at its end, and what parts them from it; never blank."""
    again = True
    while again:
        again = False
        for f in sorted(filter(None, fields), key=len, reverse=True):
            tail = title.rstrip(" )]")
            if tail.lower().endswith(f.lower()):
                before = tail[: len(tail) - len(f)]
                rest = _PARTING.sub("", before)
                if rest and rest != before:  # a whole part of the title, not the end of a word
                    title, again = rest, True
    return title


def cards_of(html: str | None, fields: dict[str, tuple[str, ...]] = FIELDS) -> list[tuple]:
    """(href, title, kind of card, *fields) of each anchor with text and a target, in order."""
    out = []
    for a in tree(html).nodes():
        href = (a.attrs.get("href") or "").strip() if a.tag == "a" else ""
        said = a.text() if href else ""
        if not said:
            continue
        card = a.above(is_card)
        inside = list(card.nodes()) if card else []
        own = set(map(id, a.nodes()))
        values = []
        for words in fields.values():
            near = (n for n in inside if n is not card and id(n) not in own and n.words() & set(words))
            values.append(next((t for n in near if (t := n.text())), None))
            if values[-1] is None:  # in the anchor itself, as a part of it
                values[-1] = next((t for n in a.nodes() if n is not a and n.words() & set(words) and (t := n.text())), None)
        heading = next((t for n in a.nodes() if n.tag in _HEADINGS and (t := n.text())), None)
        if heading is None and card and sum(n.tag == "a" and bool(n.attrs.get("href")) for n in inside) == 1:
            heading = next((t for n in inside if n.tag in _HEADINGS and (t := n.text())), None)
        kind = None if card is None else card.tag
        out.append((href, stripped(heading or said, values), kind, *values))
    return out


def cards(pages: DataFrame, key: str, html: str, fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, _ord, href, title, card, *fields) of every page's anchors."""
    fields = fields or FIELDS
    names = ["_ord", "href", "title", "card", *fields]
    schema = "_ord int, " + ", ".join(f"`{n}` string" for n in names[1:])
    return _rows(pages, key, html, schema, names, lambda p: [(i, *row) for i, row in enumerate(cards_of(p, fields))])


def parsed(pages: DataFrame, key: str, html: str, node_type: str, assignment: str, strict: bool = False) -> DataFrame:
    """(key, source, n): which way of reading gives rows of a page, the first of linked_data, assigned and cards, and how many.

    A page that none of them reads has source ``none``; with ``strict`` it is an error when it is read.
    """
    ways = {
        "linked_data": embedded_json(pages, key, html, node_type=node_type).select(key),
        "assigned": embedded_json(pages, key, html, assignment=assignment).where(F.get_json_object("node", "$.url").isNotNull()).select(key),
        "cards": cards(pages, key, html).select(key),
    }
    counts = None
    for k, (name, rows) in enumerate(ways.items()):
        one = rows.select(key, F.lit(k).alias("at"), F.lit(name).alias("source"))
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.groupBy(key, "at", "source").agg(F.count("*").alias("n")).groupBy(F.col(key).alias("__k"))
    best = counts.agg(F.min(F.struct("at", "source", "n")).alias("b"))
    none = F.lit("none")
    if strict:
        none = F.raise_error(F.concat(F.lit("no rows in page "), F.col(key).cast("string"))).cast("string")
    found = pages.select(key).join(best, F.col(key) == F.col("__k"), "left")
    return found.select(key, F.when(F.col("b").isNotNull(), F.col("b.source")).otherwise(none).alias("source"), F.coalesce("b.n", F.lit(0)).alias("n"))
