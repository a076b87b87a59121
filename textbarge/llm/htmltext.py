"""HTML extraction by composite text density.

A page becomes a tree of elements (tags may be unclosed, misnested or cut off). For every
node, with C characters, LC of them in links, T tags and LT link tags below it, the
link-adjusted density is (C / T) * log_b(C * T / (LC * LT)) with the base
b = ln(C / (C - LC) * LC + LC_body / C_body * C + e): characters per tag, lowered for links.
A node's density sum adds up its children's densities. The threshold is the least density
on the path from the body to the node of the greatest sum; going down from the body, among
nodes of at least that density the one with the greatest sum is the main subtree. An article
may be spread over sibling blocks: the subtree is widened to every ancestor with another child
that reaches the threshold, or half of its own characters outside links per tag; only blocks
that are mostly links are left out there.

Elements that are never prose (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments) are left out before: by tag, by role, and by class and id where a
whole class token names them (listed words, and words of place, joined by hyphens or
underscores). What a role, a class, an id, "hidden" or a form would leave out stays if it
holds an article, main or h1 or (adverts and consent notices aside) most of the page's text
outside links, unless an article or main outside of it, with text, is not named so; menus,
sidebars, footers and comments stay for their size only on a page without other text. A header
of an article with a heading in it is prose. A title that stands beside the main subtree is
kept with the paragraphs there.

Text: character references are decoded; white space inside a block is one space; blocks are
trimmed and joined in page order by one space. Defined results: null, empty or text-less
pages give the empty string; repeated rows keep their row; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import only, read, ready

# Names of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_DROPPED = frozenset("head nav footer aside button select option dialog menu menuitem label fieldset datalist noscript template svg annotation annotation-xml object canvas audio video".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_BLOCK_NOT_P = _BLOCK - {"p"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element whose start closes an open one of these (up to the nearest of the bounds).
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
           **{b: {"p"} for b in ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul").split()}}
_BOUNDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_WORDS_DROPPED = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted
nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer sidebar aside widget widgets related recommended recommendations
share sharing social cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login
comment comments comment-list disqus replies reply respond masthead topbar toolbar copyright disclaimer skip sr-only hidden""".split())
#: Those of an advert or a consent notice, which is no article however much of the page's text it holds.
_FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr".split())
#: Those of a part beside the article: no amount of text makes it the article if there is other text.
_BESIDE = frozenset("nav navbar navigation menu footer sidebar aside related recommended recommendations comment comments disqus replies reply respond".split())
#: Words that say where or whose a named part is.
_WHERE = frozenset("site page post article main section user reader left right top bottom list item items box block area wrapper container inner bar links".split())
#: Characters of text outside named parts from which on the page has other text.
OTHER_TEXT = 100
_ROLES_DROPPED = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# A quote delimits only directly after "=", and only if it is closed.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|=)*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _RAW}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "drop", "named", "parent", "chars", "tags", "links", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, named: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.drop, self.named = tag in _DROPPED or (parent is not None and parent.drop), named


def _parts(token: str) -> list[str]:
    return [x for x in re.split("[-_]+", token) if x]


def _boilerplate(token: str) -> bool:
    parts = _parts(token)
    return token in _WORDS_DROPPED or any(x in _WORDS_DROPPED for x in parts) and all(x in _WORDS_DROPPED or x in _WHERE for x in parts)


def _named(tag: str, attributes: str) -> str:
    """What tag or attributes name that is not prose, or nothing; _drop_named decides."""
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in _ROLES_DROPPED:
                return name
            if name in ("class", "id"):
                tokens = [t for t in value.split() if _boilerplate(t)]
                if tokens:
                    return next((t for t in tokens if not _FOREIGN.isdisjoint(_parts(t))), tokens[0])
    return "form" if tag == "form" else ""


def parse(page: str) -> Node:
    root = Node("html", None)
    at, place = root, 0
    while m := _TOKEN.match(page, place):
        token, tag, place = m[0], (m[2] or "").lower(), m.end()
        if not tag:
            if token[0] != "<" or token == "<":
                at.children.append(token)
            elif token.startswith("<![CDATA["):
                at.children.append(token[9:].removesuffix("]]>"))
            continue
        if m[1]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            elif tag == "p" or tag == "br":
                at.children.append(Node(tag, at))
            continue
        closes = _CLOSES.get(tag)
        if closes:
            node, bounds = at, _BOUNDS.get(tag, _BLOCK_NOT_P)
            while node is not root and node.tag not in bounds:
                if node.tag in closes:
                    at = node.parent
                    if tag not in ("tr",):
                        break
                node = node.parent
        if tag in ("html", "body"):
            if tag == "body":
                at = root
            continue
        node = Node(tag, at, _named(tag, m[3] or ""))
        at.children.append(node)
        if tag in _VOID or (m[3] or "").rstrip().endswith("/") and tag not in _RAW and tag not in _BLOCK:
            continue
        if tag in _RAW:
            # Inside a raw element only its own end counts.
            end = _RAW_END[tag].search(page, place)
            place = end.start() if end else len(page)
        at = node
    _drop_named(root)
    return root


def _walk(root: Node) -> list[Node]:
    """Elements in page order, parents first, without what is dropped."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.drop)
    return out


def _drop_named(root: Node) -> None:
    """Drops named elements, but not what holds the article."""
    nodes = _walk(root)
    if not any(n.named for n in nodes):
        return
    prose, linked, under, holds, free = {}, {}, {}, {}, []
    for n in nodes:
        linked[n] = n.tag == "a" or n.parent is not None and linked[n.parent]
        under[n] = bool(n.named) or n.parent is not None and under[n.parent]
    own = {n: 0 if linked[n] else sum(len(_SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str)) for n in nodes}
    outside = dict.fromkeys(nodes, 0)
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node) and not c.drop]
        prose[n] = own[n] + sum(prose[c] for c in below)
        outside[n] = 0 if under[n] else own[n] + sum(outside[c] for c in below)
        holds[n] = n.tag in ("article", "main", "h1") or any(holds[c] for c in below)
        if n.tag in ("article", "main") and outside[n]:
            free.append(n)
    # How many free articles are above a node, to tell whether one stands beside it.
    free, above = set(free), {}
    for n in nodes:
        above[n] = (n in free) + (above[n.parent] if n.parent is not None else 0)
        if not n.named:
            continue
        parts = _parts(n.named)
        large = _FOREIGN.isdisjoint(parts) and 2 * prose[n] > prose[root] and (_BESIDE.isdisjoint(parts) or outside[root] < OTHER_TEXT)
        if len(free) > above[n] or not (holds[n] or large):
            n.drop = True


def _site_headers(nodes: list[Node]) -> bool:
    """Marks headers of the page: those outside any article or main, and those without a heading."""
    found = False
    for node in nodes:
        if node.tag != "header":
            continue
        up = node.parent
        while up is not None and up.tag not in ("article", "main", "section"):
            up = up.parent
        if up is None or not any(n.tag in _HEADINGS for n in _walk(node)):
            node.drop = found = True
    return found


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        text = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        own = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.chars = text + sum(c.chars for c in own)
        node.tags = len(own) + sum(c.tags for c in own)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in own)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in own)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if not c:
            node.density = node.total = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * math.log(max(c * t / (max(lc, 1) * lt), 1.0)) / max(base, 1.0)
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.drop)


def _widened(kept: Node, threshold: float) -> Node:
    """The highest ancestor that holds another block of the article; its blocks of links are marked as dropped."""
    prose = (kept.chars - kept.link_chars) / max(kept.tags, 1) / 2
    wide, passed, node = kept, [], kept
    while node.parent is not None:
        others = [c for c in node.parent.children if isinstance(c, Node) and c is not node and not c.drop and c.chars]
        lists = [c for c in others if 2 * c.link_chars > c.chars]
        passed += lists
        node = node.parent
        if any(c.density >= threshold or (c.chars - c.link_chars) / max(c.tags, 1) >= max(prose, 1) for c in others if c not in lists):
            wide = node
            for c in passed:
                c.drop = True
            passed = []
    return wide


def _titled(kept: Node) -> Node:
    """The parent, if a heading of the first two ranks stands there before the subtree: of the other
    children only headings and paragraphs (title, lead, closing lines) come with it."""
    up = kept
    while up is not None:
        if up.tag in ("article", "main"):
            return kept
        up = up.parent
    while kept.parent is not None:
        others = [c for c in kept.parent.children if isinstance(c, Node) and not c.drop]
        if not any(c.tag in ("h1", "h2") and c.chars for c in others[:others.index(kept)]):
            break
        for c in others:
            if c is not kept and (c.tag not in _HEADINGS and c.tag != "p" or 2 * c.link_chars > c.chars):
                c.drop = True
        kept = kept.parent
    return kept


def main_subtree(root: Node) -> Node:
    nodes = _walk(root)
    if _site_headers(nodes):
        nodes = _walk(root)
    _measure(nodes)
    best = max(nodes, key=lambda n: n.total)
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    kept = root
    for node in nodes:
        # A whole article is not cut down to its densest part: only a node with at least its sum replaces it.
        if node.density >= threshold and node.total > kept.total:
            kept = node
    kept = _widened(kept, threshold)
    while kept.parent is not None and kept.tag in _BLOCK - {"article", "main", "div", "section"}:
        kept = kept.parent
    kept = _titled(kept)
    up = kept
    while up is not None:
        if up.tag in ("article", "main"):
            kept = up
        up = up.parent
    return kept


def text_of(root: Node) -> str:
    """The subtree's text: blocks in page order, joined by one space."""
    blocks, now, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            now.append(node)
        elif node is None:
            blocks.append("".join(now))
            now = []
        elif not node.drop:
            if node.tag in _BLOCK:
                stack.append(None)
                blocks.append("".join(now))
                now = []
            stack.extend(reversed(node.children))
    blocks.append("".join(now))
    return " ".join(x for x in (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks) if x)


def extract(page: str) -> str:
    """The main text of a page; without any in the main subtree, that of the whole body."""
    root = parse(page)
    return text_of(main_subtree(root)) or text_of(root)


def _extract_udf():
    def run(page: pa.Array) -> pa.Array:
        return pa.array([extract(p) if p else "" for p in page.to_pylist()], pa.string())

    run.__annotations__ = {"page": pa.Array, "return": pa.Array}
    return arrow_udf(run, "string")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    ready(pages)
    rows = only(pages, page_id=page_id, url=url, page=page)
    return rows.select("page_id", "url", _extract_udf()(F.col("page").cast("string")).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
