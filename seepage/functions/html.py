"""Stored pages as arrays of nodes.

``html_nodes`` is the only Python step: it lists the nodes of a page in
document order. A node's descendants are the entries ``id + 1 .. last``, so
every page operator is a Spark array expression over that list.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.functions.pieces import pieces
from seepage.functions.text import let, strip

# Tasks get these helpers with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
TEXT, RAW, COMMENT = "#text", "#raw", "#comment"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_TAGS = frozenset(("script", "style", "template"))


# What stands between "<" and ">" in plainly written markup: a tag with quoted attributes, or the end of one.
_START = re.compile(r'([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"]*")?)*)\s*(/?)').fullmatch
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)\s*").fullmatch
_ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9:_-]*)(?:="([^"]*)")?')
_MIXED = frozenset(("title", "textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp", "template"))


class _NodeList(HTMLParser):
    """The nodes of pages as flat lists; a node's number is its place in ``tags``.

    ``elements`` are the numbers of those with attributes or none, each with
    the end of its own in ``keys`` and ``values``; ``opened`` are those whose
    last descendant is another node, which ``closed`` holds.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.texts, self.elements, self.ends, self.keys, self.values = [], [], [], [], [], []
        self.opened, self.closed = [], []

    def _lists(self):
        return self.tags, self.texts, self.elements, self.ends, self.keys, self.values, self.opened, self.closed

    @property
    def rows(self) -> list[tuple]:
        """(tag, attributes, text) of every node, to look at."""
        own = {e: slice(a, b) for e, a, b in zip(self.elements, [0, *self.ends], self.ends)}
        attrs = [list(zip(self.keys[own[i]], self.values[own[i]])) if i in own else None for i in range(len(self.tags))]
        return list(zip(self.tags, attrs, self.texts))

    @property
    def last(self) -> list[int]:
        """Every node's last descendant, or itself, to look at."""
        return self.last_descendants().tolist()

    def last_descendants(self) -> np.ndarray:
        last = np.arange(len(self.tags), dtype=np.int32)
        last[self.opened] = self.closed
        return last

    def page(self, html):
        """Read a page: plainly written ones by cutting them at their marks, all others with the general parser."""
        sizes, self.stack = [len(x) for x in self._lists()], []
        if not self._plain_page(html):
            for x, size in zip(self._lists(), sizes):
                del x[size:]
            self.stack = []
            self.reset()
            self.feed(html)
            self.close()
        while self.stack:
            self._pop()

    def _plain_page(self, html):
        """True if the whole page is tokens about which all parsers agree: none of them holds "<" but scripts and styles."""
        tags, texts, stack = self.tags, self.texts, self.stack
        parts = iter(html.split("<"))
        text = next(parts)
        if text:
            tags.append(TEXT)
            texts.append(unescape(text) if "&" in text else text)
        for part in parts:
            mark, end, text = part.partition(">")
            if not end:
                return False
            kind = mark[:1]
            if kind == "/":
                if stack and tags[stack[-1]] == mark[1:]:
                    self._pop()
                elif m := _END(mark):
                    self.handle_endtag(m[1].lower())
                else:
                    return False
            elif kind == "!":
                if mark.startswith("!--"):
                    body = mark[3:-2]
                    if len(mark) < 5 or not mark.endswith("--") or "--" in body or body.endswith("-"):
                        return False
                    self._add(COMMENT, body)
                elif mark[1:8].lower() != "doctype" or "[" in mark or "]" in mark:
                    return False
            else:
                m = _START(mark)
                if m is None or (stack and tags[stack[-1]] in _MIXED):
                    return False
                tag, found, closed = m.groups()
                tag = tag.lower()
                if found:
                    plain = "&" not in found
                    found = [(k.lower(), v if plain else unescape(v)) for k, v in _ATTR.findall(found)]
                if closed:
                    self.handle_startendtag(tag, found)
                else:
                    self.handle_starttag(tag, found)
                    if tag in _RAW_TAGS:
                        if tag == "template":
                            return False
                        for part in parts:
                            if part.startswith("/" + tag):
                                break
                            text += "<" + part
                        else:
                            return False
                        if not part.startswith(f"/{tag}>") or f"</{tag}" in text.lower() or "<!--" in text:
                            return False
                        if text:
                            self._add(RAW, text)
                        self.handle_endtag(tag)
                        text = part[len(tag) + 2:]
            if text:
                tags.append(TEXT)
                texts.append(unescape(text) if "&" in text else text)
        return True

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _add(self, tag, text):
        self.tags.append(tag)
        self.texts.append(text)

    def _pop(self):
        self.opened.append(self.stack.pop())
        self.closed.append(len(self.tags) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.stack.append(len(self.tags))
        self.handle_startendtag(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.elements.append(len(self.tags))
        self.tags.append(tag)
        self.texts.append(None)
        for k, v in dict(attrs).items():  # of a repeated attribute the last value holds
            self.keys.append(k)
            self.values.append(v or "")
        self.ends.append(len(self.keys))

    def handle_endtag(self, tag):
        tags, stack = self.tags, self.stack
        if stack and tags[stack[-1]] == tag:
            self._pop()
        elif any(tags[i] == tag for i in stack):
            while tags[stack[-1]] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        self._add(RAW if self.stack and self.tags[self.stack[-1]] in _RAW_TAGS else TEXT, data)

    def handle_comment(self, data):
        self._add(COMMENT, data)


def _nodes_of(pages: pa.Array) -> pa.Array:
    reader, offsets = _NodeList(), [0]
    for page in pages.to_pylist():
        if page:
            reader.page(page)
        offsets.append(len(reader.tags))
    offsets, n = np.array(offsets, dtype=np.int32), len(reader.tags)
    ids = np.arange(n, dtype=np.int32)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    attrs, bare = np.zeros(n + 1, np.int32), np.ones(n + 1, bool)
    attrs[np.array(reader.elements, np.int32) + 1] = np.diff(reader.ends, prepend=0)
    attrs = np.cumsum(attrs, dtype=np.int32)
    bare[reader.elements], bare[n] = False, False
    items = pa.StructArray.from_arrays(
        [
            pa.array(ids - first), pa.array(reader.last_descendants() - first), pa.array(reader.tags, pa.string()),
            pa.MapArray.from_arrays(
                pa.array(attrs, mask=bare), pa.array(reader.keys, pa.string()), pa.array(reader.values, pa.string())),
            pa.array(reader.texts, pa.string()),
        ],
        names=NODE.names,
    )
    return pa.ListArray.from_arrays(pa.array(offsets), items)


@F.arrow_udf(T.ArrayType(NODE))
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for html, in pieces([batch]):  # the nodes of a piece are held, not those of a batch
            yield _nodes_of(html)


def html_nodes(html) -> Column:
    """All nodes of a page; an empty array for a null or empty page."""
    return _parse(html)


def attr(node: Column, name: str) -> Column:
    return F.coalesce(F.element_at(node["attrs"], F.lit(name)), F.lit(""))


def has_attr(node: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(node["attrs"], F.lit(name)), F.lit(False))


def attr_values(nodes: Column) -> Column:
    """The values of all attributes, a line each; entities are read."""
    bearing = F.filter(nodes, lambda n: n["attrs"].isNotNull())
    return F.array_join(F.flatten(F.transform(bearing, lambda n: F.map_values(n["attrs"]))), "\n")


def has_token(node: Column, name: str, token: str) -> Column:
    """Is the token one of the blank-separated words of the attribute."""
    return F.array_contains(F.split(attr(node, name), r"\s+"), token)


def has_class(node: Column, token: str) -> Column:
    return has_token(node, "class", token)


def by_tag(nodes: Column, *tags: str) -> Column:
    """Elements with one of the tags, in page order."""
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def below(nodes: Column, node: Column) -> Column:
    """Descendants of ``node``; an empty array if it has none or is null."""

    def cut(n):
        size = F.coalesce(n["last"] - n["id"], F.lit(0))
        return F.when(size > 0, F.slice(nodes, n["id"] + 2, size)).otherwise(F.slice(nodes, 1, 0))

    return let(node, cut)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def texts(nodes: Column) -> Column:
    """Visible text of a node list: markup, scripts, styles and comments left out."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: n["tag"] == TEXT), lambda n: n["text"]), "")


def text_of(nodes: Column, node: Column) -> Column:
    return texts(below(nodes, node))


def clean_text(nodes: Column) -> Column:
    """Visible text on one line: lines and double blanks split, parts trimmed, joined by one blank."""
    parts = F.transform(F.split(texts(nodes), r"\r\n|[\n\r\x0B\f]|  "), strip)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")

