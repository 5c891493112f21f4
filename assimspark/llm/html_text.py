"""Main text of web pages by tree scoring.

The page becomes a tree (unclosed and misnested tags as browsers take them, roughly). Elements whose tag or role says that they are menus, page
headers, footers, sidebars, notices, forms or scripts neither give points nor show. Each other block gives the elements around it points
for the length and commas of its words, less the share of link text, fewer with distance; an element's points are discounted by that share
of its own text again. What stands in an element whose class or id is a boilerplate name (``ad``, ``cookie-banner``, but not ``header-story``) gives a tenth of
its points. The element with the most points is the article's container, whatever its tag. Beside it, and beside each element around it, that
is kept which scores like it, is plain text of few links, or lies between two such parts. Elements with boilerplate names go, unless they
hold the container; in paragraphs and headings only the names of adverts count. The blocks, in page order, have character references
decoded and white space runs as one space.

A null, empty or text-less page gives an empty text; a page whose only words are headings gives these; of equal scores the first element
counts; repeated pages are rows of their own; an empty table gives no rows; extra columns are ignored. A page that ends inside a tag loses
that tag only. The work grows with a page's length, however its tags are nested or left open.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed lists: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "caption", "dd", "dt", "html", "legend", "li", "summary", "tbody", "tfoot", "thead", "tr"}
SCOPE = frozenset("article aside body button caption div html main nav object section table td th form footer header blockquote".split())
DROPPED = frozenset("aside button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noscript object script select style svg template textarea title video audio".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Fixed lists: words of boilerplate class and id names, those of adverts and notices, and words that may stand beside them in a name.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising consent cookie cookies gdpr sponsor sponsored".split())
NAMES = ADVERTS | frozenset("banner breadcrumb breadcrumbs comment commentlist comments discussion disclaimer disqus footer form gutter header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related reply replies respond rss search share sharing sidebar signup skip social subscribe subscription tags toc toolbar topbar widget widgets".split())
BESIDE = frozenset("a area aside bar block body box bottom button buttons col column container content div field footer global group header holder icons inner item items item-list left level line link links list main mobile outer page panel primary region right root row secondary section site slot small sticky text the thread top unit widget wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset("blockquote dl figure ol p pre table ul".split())
#: Elements of words rather than of blocks.
WORDY = HEADINGS | frozenset("blockquote caption figcaption p pre".split())
CONTAINERS = frozenset("#root article body div html main section".split())
OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "children", "bad", "named", "within", "score", "chars", "link_chars", "own")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.hidden = (), "", False
        self.bad, self.named, self.within, self.score, self.chars, self.link_chars, self.own = False, False, False, 0.0, 0, 0, []
        if attributes and attributes.strip():
            found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
            self.names = (found.get("class", "") + " " + found.get("id", "")).lower().split()
            self.role = found.get("role", "").lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


class Open:
    """The open elements, and where in their list those of each tag stand, so that none is searched for in vain."""

    def __init__(self, root: Node):
        self.nodes, self.scopes, self.at = [root], [0], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: frozenset[str] | set[str]) -> int:
        """Where the innermost open element with one of the tags stands (0, the root, if there is none)."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, to: int) -> None:
        """Close the elements from there on."""
        while to and len(self.nodes) > to:
            self.at[self.nodes.pop().tag].pop()
        while self.scopes[-1] >= len(self.nodes):
            self.scopes.pop()


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    open_, at = Open(root), 0
    match = TOKEN.search(page)
    while match:
        if match.start() > at:
            open_.nodes[-1].children.append(page[at:match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if tag:
            tag = tag.lower()
            if closing:
                found = open_.last({tag})
                if tag in SCOPE or found > open_.scopes[-1]:
                    open_.close(found)
            elif at < len(page) or page.endswith(">"):
                if tag in CLOSES_P and open_.last({"p"}) > open_.scopes[-1]:
                    open_.close(open_.last({"p"}))
                if tag in OWN and (found := open_.last(OWN[tag])) > open_.last(ENDS_OWN[tag] - OWN[tag]):
                    open_.close(found)
                    if tag == "tr" and open_.nodes[-1].tag == "tr":
                        open_.close(len(open_.nodes) - 1)
                new = Node(tag, attributes, open_.nodes[-1])
                open_.nodes[-1].children.append(new)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif tag not in VOID and not attributes.rstrip().endswith("/"):
                    open_.push(new)
        match = TOKEN.search(page, at)
    if at < len(page):
        open_.nodes[-1].children.append(page[at:])
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _telling(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id name says boilerplate: all of its words are such words, or stand beside them."""
    parts = [w.rstrip("0123456789") for w in re.split("[-_]+", name)]
    return any(w in words for w in parts) and all(not w or w in NAMES or w in BESIDE for w in parts)


def _is_block(n: Node) -> bool:
    return n.tag in BLOCK or n.tag in ("body", "html", "#root", "td", "th")


def _mark(nodes: list[Node]) -> None:
    """bad: boilerplate by tag or role, and all within it, but for elements that hold the page's article or main element; named: by name; within: all in such."""
    inside, own, holds = {}, {}, set()
    for n in nodes:
        inside[id(n)] = n.parent is not None and (inside[id(n.parent)] or n.parent.tag in ("article", "main"))
        own[id(n)] = n.tag not in ("html", "body", "main", "#root") and (n.tag in DROPPED or n.role in ROLES or n.hidden or n.tag == "header" and not inside[id(n)])
    for n in nodes:
        up = n.parent if n.tag in ("article", "main") and not own[id(n)] else None
        while up is not None and id(up) not in holds:
            holds.add(id(up))
            up = up.parent
    for n in nodes:
        n.bad = n.parent is not None and n.parent.bad or own[id(n)] and id(n) not in holds
        words = ADVERTS if n.tag in WORDY else NAMES
        n.named = n.tag not in ("html", "body", "main", "#root") and any(_telling(x, words) for x in n.names)
        n.within = n.named or n.parent is not None and n.parent.within


def _measure(nodes: list[Node]) -> None:
    """Characters, and those in links, of all that isn't boilerplate; and the words of each block that stand in no block inside it."""
    for n in nodes:
        n.score, n.chars, n.link_chars, n.own = 0.0, 0, 0, []
    stack: list = [(nodes[0], nodes[0])]
    while stack:
        n, block = stack.pop()
        if isinstance(n, str):
            if text := " ".join(n.split()):
                block.own.append(text)
            continue
        if not n.bad:
            inner = n if _is_block(n) else block
            stack.extend((c, inner) for c in reversed(n.children))
    for n in reversed(nodes):  # children before parents
        if not n.bad:
            n.chars += sum(len(" ".join(c.split())) for c in n.children if isinstance(c, str))
            if n.tag == "a":
                n.link_chars = n.chars
            if n.parent is not None:
                n.parent.chars += n.chars
                n.parent.link_chars += n.link_chars


def _score(nodes: list[Node]) -> None:
    """Each block's own words give points for length and commas: all to its container, fewer to those further up; links and boilerplate names discount them."""
    for n in nodes:
        if n.bad or not n.own or not _is_block(n):
            continue
        text = " ".join(n.own)
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0) if len(text) >= 25 and n.tag not in HEADINGS else min(len(text), 50) / 100
        up, share, level = n if n.tag in CONTAINERS else n.parent, 0.1 if n.within else 1.0, 1
        points *= 1 - n.link_chars / max(n.chars, 1)
        near = share
        while up is not None and level < 6:
            up.score += points * share
            level += 1
            share = near * (0.5 if level == 2 else 1 / (3 * level))
            up = up.parent
    for n in nodes:
        n.score *= 1 - n.link_chars / max(n.chars, 1)


def _belongs(n: Node, best: Node, peak: dict[int, float]) -> bool:
    """Whether what stands beside the best container, or beside an element around it, is of the article: by score, or as plain text of few links."""
    thin = n.link_chars / max(n.chars, 1)
    return not n.bad and n.chars > 0 and (thin < 0.5 and peak[id(n)] >= 0.2 * best.score or thin < 0.25 and (n.tag in PLAIN or n.tag in HEADINGS))


def _select(nodes: list[Node]) -> list:
    """The best container with those around it that belong to it, in page order. Names make an element boilerplate from here on, unless it holds the container."""
    best = max(nodes, key=lambda n: n.score)  # the first of equals
    if best.score <= 0:
        return []
    peak = {id(n): n.score for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            peak[id(n.parent)] = max(peak[id(n.parent)], peak[id(n)])
    around_best, up = set(), best
    while up is not None:
        around_best.add(id(up))
        up = up.parent
    for n in nodes:
        n.bad = n.bad or id(n) not in around_best and (n.named or n.parent is not None and n.parent.bad)
    befores, afters, at = [], [], best
    while at.parent is not None:
        around = at.parent.children
        fits = [i for i, c in enumerate(around) if c is at or isinstance(c, Node) and _belongs(c, best, peak)]
        before, after, seen, kept = [], [], False, set(fits)
        for i in range(fits[0], fits[-1] + 1):
            c = around[i]
            if c is at:
                seen = True
            # What lies between two parts of the article is of it, bare text also, unless it is boilerplate or mostly links.
            elif i in kept or isinstance(c, str) or not c.bad and 2 * c.link_chars < max(c.chars, 1):
                (after if seen else before).append(c)
        befores.append(before)
        afters.append(after)
        at = at.parent
    return [*(c for part in reversed(befores) for c in part), best, *(c for part in afters for c in part)]


def _blocks(roots: list) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    stack: list = [None, *reversed(roots)]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            held.append(n)
        elif n.bad:
            continue
        elif n.tag in ("br", "td", "th"):
            held.append(" ")
            stack += [" ", *reversed(n.children)]
        elif n.tag in BLOCK:
            flush()
            stack += [None, *reversed(n.children)]
        else:
            stack.extend(reversed(n.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    nodes = _walk(parse(page or ""))
    _mark(nodes)
    _measure(nodes)
    _score(nodes)
    return "\n\n".join(_blocks(_select(nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
