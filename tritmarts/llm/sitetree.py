"""Main text of pages by a site style tree.

The trees of a host's pages are merged: elements with the same chain of tags and
names become one tree node.  A node's presentation (the sequence of its children) and its
content (the text below it) are distributed over the different pages that have it (copies count once); the entropy of either,
relative to the greatest possible, is 0 for what all pages share and 1 for what no two
pages share.  Both are combined to the node's importance.  A branch that is nearly
constant over the pages of a site whose articles differ is furniture and is removed from
each page, as is what tags and names mark as such; what is left is the text.

Spark counts the distributions: a page gives one narrow row per branch, the counts are
combined before each shuffle, and no host is gathered anywhere.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tritmarts.llm import dom
from tritmarts.llm.tables import in_small_batches, row_key, written

#: different pages of a host that must have a branch before it is judged
LEAST_PAGES = 5
#: a branch below LOW is removed if the site's articles are above HIGH
LOW = 0.1
HIGH = 0.3
#: weight of content against presentation falls with the number of kinds of children
GAMMA = 0.9
#: elements that are judged as branches; headings and paragraphs are never judged alone
BRANCHES = frozenset("div section ul ol dl table figure header center address".split())
_SPACE = re.compile(r"\s+")


def _hash(*parts: object) -> int:
    value = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Page:
    """A parsed page: its article roots, or the whole body if it has none, without furniture."""

    def __init__(self, url: str | None, source: str | None):
        self.top = dom.parse(source)
        self.articles = dom.article_roots(self.top)
        self.roots = self.articles or [self.top]
        self.host = host_of(url)

    def _walk(self) -> Iterator[tuple[dom.Node, int, bool]]:
        """(element, tree node, judged) of what is kept by tag and name; judged: it is a branch below a root."""
        for root in self.roots:
            place = {id(root): _hash(self.host, *[n.label for n in reversed([root, *root.above()])])}
            yield root, place[id(root)], False
            stack = [k for k in reversed(root.kids) if isinstance(k, dom.Node)]
            while stack:
                node = stack.pop()
                if dom.furniture(node, bool(self.articles), bool(self.articles)):
                    place[id(node)] = 0
                    continue
                place[id(node)] = _hash(place[id(node.up)], node.label)
                yield node, place[id(node)], node.tag in BRANCHES
                stack.extend(k for k in reversed(node.kids) if isinstance(k, dom.Node))

    def branches(self) -> list[tuple[int, int, int, int, int]]:
        """(tree node, its root's tree node, content, presentation, kinds of children) of the root and of each branch."""
        walked = list(self._walk())
        digest: dict[int, int] = {}
        for node, *_ in reversed(walked):  # children come before their parents; what was left out has no digest
            digest[id(node)] = _hash(*[" ".join(k.split()) if isinstance(k, str) else digest.get(id(k), 0) for k in node.kids])
        contents: dict[int, list[int]] = {}
        shapes: dict[int, list[str]] = {}
        for node, place, branch in walked:
            if branch or node in self.roots:
                contents.setdefault(place, []).append(digest[id(node)])
                shapes.setdefault(place, []).extend(k.label for k in node.kids if isinstance(k, dom.Node))
        first, out = walked[0][1], []
        for place in contents:
            shape = [s for i, s in enumerate(shapes[place]) if i == 0 or s != shapes[place][i - 1]]
            out.append((place, first, _hash(*contents[place]), _hash(*shape), len(set(shape))))
        return out

    def _text(self, roots: list[dom.Node], removed: frozenset[int]) -> str:
        blocks: list[str] = []
        line: list[str] = []

        def end() -> None:
            if block := _SPACE.sub(" ", "".join(line)).strip():
                blocks.append(block)
            line.clear()

        has_article = bool(self.articles)
        for root in roots:
            stack: list = [(root, True)]
            while stack:
                item, opening = stack.pop()
                if isinstance(item, str):
                    line.append(item)
                    continue
                if opening and item is not root and dom.furniture(item, has_article, has_article):
                    if item.tag in dom.BLOCK:
                        end()
                    continue
                if opening and id(item) in removed:
                    end()
                    continue
                if item.tag == "br":
                    line.append(" ")
                    continue
                if item.tag in dom.BLOCK:
                    end()
                if opening:
                    stack.append((item, False))
                    stack.extend((k, True) for k in reversed(item.kids))
            end()
        return "\n".join(blocks)

    def text(self, noise: set[int]) -> str:
        """The blocks of the roots in page order, without furniture and without branches of the ``noise`` tree nodes."""
        removed = frozenset(id(n) for n, place, branch in self._walk() if branch and place in noise) if noise else frozenset()
        return self._text(self.roots, removed)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, url, html in zip(batch.column("key").to_pylist(), batch.column("url"), batch.column("html")):
            branches = Page(url.as_py(), html.as_py()).branches()
            page = _hash(*branches)  # copies of a page share it
            rows += [(key, *b, page) for b in branches]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)],
                                             names=["key", "node", "root", "content", "shape", "kinds", "page"])


def style_tree(features: DataFrame) -> DataFrame:
    """(node, root, pages, importance) of the merged tree, from one row (node, root, content, shape, kinds, page) a page and node.

    Copies of a page, equal in ``page``, count once.
    """
    features = features.select("node", "root", "content", "shape", "kinds", "page").distinct()

    def spread(value: str) -> DataFrame:
        counts = features.groupBy("node", "root", value).agg(F.count("*").alias("c"), F.sum("kinds").alias("k"))
        pages = F.sum("c")
        return counts.groupBy("node", "root").agg(
            pages.alias("pages"), (F.sum("k") / pages).alias("kinds"),
            F.when(pages > 1, (F.log(pages) - F.sum(F.col("c") * F.log("c")) / pages) / F.log(pages)).otherwise(1.0).alias(value))

    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    return spread("content").join(spread("shape").select("node", "root", "shape"), ["node", "root"]).select(
        "node", "root", "pages", (weight * F.col("content") + (1 - weight) * F.col("shape")).alias("importance"))


def noise_of_pages(pages: DataFrame) -> DataFrame:
    """(key, noise): for pages with low-importance branches the tree nodes to remove."""
    features = written(in_small_batches(pages).select(row_key("page_id", "url", "html").alias("key"), F.col("url").cast("string"),
                                    F.col("html").cast("string")).mapInArrow(
        _branches, "key long, node long, root long, content long, shape long, kinds long, page long"), "branches")
    tree = written(style_tree(features), "style_tree")
    roots = tree.where("node = root").where(F.col("importance") >= HIGH).select("root")
    low = tree.where("node <> root").where((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES))
    noise = low.join(roots, "root", "left_semi").select("node").distinct()
    return features.select("key", "node").join(noise, "node", "left_semi").groupBy("key").agg(
        F.collect_set("node").alias("noise"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(url.as_py(), html.as_py()).text(set(noise.as_py() or ()))
                 for url, html, noise in zip(batch.column("url"), batch.column("html"), batch.column("noise"))]
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"),
            pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()),
            pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page with nothing left, give an empty text.  Repeated
    rows are counted each and get the same text.  A null url, and one without a
    host, belong to one unnamed site.
    """
    noise = written(noise_of_pages(pages), "page_noise")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
                        row_key("page_id", "url", "html").alias("key"))
    if noise.isEmpty():  # nothing to bring to the pages
        marked = rows.withColumn("noise", F.array().cast("array<bigint>"))
    else:
        marked = rows.join(noise, "key", "left")
    return marked.select("page_id", "url", "html", "noise").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long")
