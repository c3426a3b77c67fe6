"""A small tolerant HTML tree: elements, their text, and which of them tags and names mark as furniture."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul").split())
ENDS_P = frozenset((
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul").split())
#: a start tag ends the open elements named first, unless one named second lies between
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
IN_HEAD = frozenset("meta link base title style script noscript template".split())
NOT_SHOWN = frozenset((
    "head nav aside footer form dialog menu search button select label fieldset object svg canvas video audio map "
    "iframe noscript template script style title textarea datalist").split())
# Words in class and id names that mark page furniture.
FURNITURE = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager share sharing social newsletter subscribe subscription signup login "
    "search searchform toolbar widget widgets footer skip").split())
#: marks what is never the article, even if it is made of article elements
NOT_ARTICLE = frozenset((
    "comment comments commentlist disqus respond reply replies related recommended recommendations teaser teasers").split())
SITE_HEAD = frozenset("header masthead topbar branding logo".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|textarea|title|template|iframe|xmp|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMES = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "label", "words", "hidden", "role", "kids", "up", "core_inside", "h1_inside")

    def __init__(self, tag: str, attributes: str, up: Node | None):
        self.tag, self.up, self.kids = tag, up, []
        self.core_inside = self.h1_inside = self.hidden = False
        self.words, self.role, name = frozenset(), "", ""
        if attributes and not attributes.isspace():
            found = {m[1].lower(): html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
                     for m in _ATTRIBUTE.finditer(attributes)}
            name = f"{found.get('class', '')} {found.get('id', '')}"
            self.words = frozenset(_NAMES.split(_HUMP.sub(r"\1 \2", name).lower())) - {""}
            self.role = found.get("role", "").strip().lower()
            self.hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
                           or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower())
        #: what elements of different pages are merged by: tag and presentation, without numbers
        self.label = " ".join([tag, *sorted(self.words)])

    def above(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up


def parse(source: str | None) -> Node:
    """The tree below an unnamed root; unclosed, misnested and stray tags never fail."""
    root = Node("#root", "", None)
    at = root

    def close(tags: set | frozenset, stops: set | frozenset) -> None:
        nonlocal at
        node = at
        while node is not root and node.tag not in stops:
            if node.tag in tags:
                at = node.up
                return
            node = node.up

    def text(piece: str) -> None:
        if piece:
            at.kids.append(html.unescape(piece))

    done = 0
    source = source or ""
    for m in _TOKEN.finditer(source):
        text(source[done:m.start()])
        done = m.end()
        ending, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            node = at
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:
                    node = root
                    break
                node = node.up
            if node is not root:
                at = node.up
            elif tag == "p":
                at.kids.append(Node("p", "", at))
            continue
        if at.tag == "head" and tag not in IN_HEAD:
            at = at.up
        if tag in ("html", "body") and any(n.tag == tag for n in (at, *at.above())):
            continue
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "caption", "button", "object", "table"})
        if tag in ENDS:
            close(*ENDS[tag])
        node = Node(tag, attributes, at)
        at.kids.append(node)
        if tag == "h1":
            for n in node.above():
                n.h1_inside = True
        if tag not in VOID and not attributes.endswith("/"):
            at = node
        elif tag not in VOID and tag in BLOCK:
            at = node
    text(source[done:])
    return root


def nodes(top: Node) -> Iterator[Node]:
    """All elements below ``top`` in page order."""
    stack = [k for k in reversed(top.kids) if isinstance(k, Node)]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def article_roots(top: Node) -> list[Node]:
    """The elements that hold the article: article elements if there are any, else main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    for node in nodes(top):
        kind = "main" if node.tag == "main" or node.role == "main" else node.tag
        if kind in found:
            line = [node, *node.above()]
            if not (any(n.words & NOT_ARTICLE or n.hidden or n.tag in ("nav", "aside", "footer", "head") for n in line)
                    or node.words & FURNITURE & {"ad", "ads", "advert", "sponsored", "promo"}):
                found[kind].append(node)
    chosen = found["article"] or found["main"]
    inside = {id(n) for n in chosen}
    chosen = [n for n in chosen if not any(id(a) in inside for a in n.above())]
    for node in chosen:
        node.core_inside = True
        for n in node.above():
            n.core_inside = True
    return chosen


def furniture(node: Node, in_article: bool, has_article: bool) -> bool:
    """Whether tag, role or names alone tell that an element is not part of the article."""
    if node.core_inside or node.tag in ("html", "body", "main"):
        return False
    if node.hidden or node.tag in NOT_SHOWN - {"form", "fieldset"} or node.role in ROLES - {"form"}:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not has_article and node.h1_inside:
        return False
    words = FURNITURE | NOT_ARTICLE if in_article else FURNITURE | NOT_ARTICLE | SITE_HEAD
    return node.tag in ("form", "fieldset") or node.role == "form" or bool(node.words & words)
