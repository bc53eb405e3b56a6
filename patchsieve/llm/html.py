"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less with every level; an
ancestor's points are discounted by the share of its text in links. The best container is kept with
those siblings that score well or hold prose. Page furniture is told by tag, by role and by class and id names
that consist of furniture words and neutral ones as a whole; a name that may as well be that of a section
counts only if what it holds looks like furniture.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import strings

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "ruby rb rt rp img br wbr picture source math mrow mi mn mo mtext ms mspace msup msub msubsup mfrac msqrt mroot mover munder munderover "
    "mtable mtr mtd mstyle mpadded mphantom mfenced menclose semantics annotation annotation-xml".split())
_SILENT = frozenset(
    "head script style noscript template title iframe object svg canvas audio video map nav footer button select textarea dialog menu input label "
    "annotation annotation-xml".split())
_CONTROLS = frozenset("input select textarea button".split())
_IN_PROSE = frozenset("label button".split())  # words of a sentence if they stand in a paragraph outside a form
_CONTAINERS = frozenset("form fieldset aside".split())  # decided on when the whole page is known
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPES = frozenset("html body div section article main table ul ol dl td th tr form nav aside header footer blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_NEUTRAL = (
    "site|page|top|bottom|left|right|main|primary|secondary|inner|outer|box|bar|wrap|wrapper|container|section|block|list|area|items?|panel|group|row|"
    "col|column|content|posts?|articles?|entry|entries|story|stories|links?|buttons?|icons?|form|field|slot|unit|zone|space|js|text|title|head|header|body|"
    "global|mobile|desktop|sticky|fixed|floating|module|component|region|holder|placeholder|frame|thread|count|news|topics|reading|read|more|also|you|may|"
    "like|email|facebook|twitter|google|dfp|policy|media|trail|tool|tools|us|follow|in|up")
#: kinds of names: always furniture; unless it holds a heading and prose; only if it holds no prose
_KINDS = (
    "ads?|adv|adverts?|advertisements?|advertising|advertorial|sponsored|promos?|cookies?|consent|gdpr|side-?_?bar|comments?|disqus|replies|respond|"
    "newsletter|subscribe|subscription|subscriptions|popup|pop-up|breadcrumbs?|pagination|paginator|pager|nav|navbar|footer|masthead|share|sharing|skip",
    "notices?|banners?|modal|overlay|menu|navigation|toolbar|login|log-in|signin|sign-in|signup|sign-up|widgets?|rail|cta|tags|sponsors?",
    "related|recommend|recommended|recommendations?|promotions?|social")
_NAMED = [re.compile(f"(?:(?:{_NEUTRAL}|{'|'.join(_KINDS)})[^a-z]*)*?(?:{kind})(?:[^a-z]*(?:{_NEUTRAL}|{'|'.join(_KINDS)}))*[^a-z]*") for kind in _KINDS]
_TOP = re.compile(f"(?:(?:{_NEUTRAL})[^a-z]*)*?header(?:[^a-z]*(?:{_NEUTRAL}))*[^a-z]*")
_OWN_TOP = re.compile(r"article|post|entry|content|story")
_BONUS = {"article": 25, "main": 10}
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("tag", "parent", "names", "silent", "chars", "linked", "points", "items", "holds", "home", "within", "controls", "heads", "prose")

    def __init__(self, tag: str, parent: _Node | None, names: str, silent: bool):
        self.tag, self.parent, self.names, self.silent = tag, parent, names, silent
        self.home = parent.home if parent is not None and tag in _INLINE else self  # the block that text goes to
        self.within = parent is not None and (parent.within or tag in ("article", "main"))
        self.chars = self.linked = self.items = self.controls = self.heads = self.prose = 0
        self.points = 0.0
        self.holds = False


_TOKEN = re.compile(
    r"<!--(?:.*?(?P<ended>-->)|.*\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe|xmp)(?=[\s/>])[^>]*>(?:.*?(?P<closed></(?P=raw)(?=[\s/>])[^>]*>)|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<more>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|</?(?P<odd>[a-z][^\s/<>]*)[^>]*>"
    r"|<[!?/][^>]*>", re.I | re.S)
_ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOLD = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Page:
    """Elements in page order and the blocks of text under them.

    Every tag is read in one pass. Inline elements only become elements of the tree if they have a
    class, an id or the like; a comment, script or style without an end takes the rest of the page.
    """

    def __init__(self, html: str):
        self.root = _Node("", None, "", False)
        self.nodes = [self.root]
        self.stack = [self.root]
        self.block = self.root
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[_Node, str, int]] = []
        self.run: list[str] = []
        self.linked = 0
        self.link_depth = 0
        last = html.rfind(">") + 1
        at = 0
        for m in _TOKEN.finditer(html, 0, last):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["odd"]
            if not tag:
                if at == last and (m["raw"] and not m["closed"] or m[0].startswith("<!--") and not m["ended"]):
                    at = len(html)
                continue
            if html[m.start() + 1] == "/":
                self._end(tag.lower())
            else:
                self._start(tag.lower(), m["more"] or "")
        rest = html[at:]
        cut = _CUT.search(rest)  # a tag that the page's end cuts
        self._text(rest[:cut.start()] if cut else rest)
        self.flush()

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((self.block, text, min(self.linked, len(text))))
            self.run, self.linked = [], 0

    def _text(self, raw: str) -> None:
        if self.stack[-1].silent:
            return
        if "&" in raw:
            raw = unescape(raw)
        self.run.append(raw)
        if self.link_depth:
            self.linked += len(" ".join(raw.split()))

    def _close(self, depth: int) -> None:
        """Close the open elements from `depth` on."""
        if self.stack[depth - 1].home is not self.block:
            self.flush()
        for n in self.stack[depth:]:
            self.open[n.tag] -= 1
        del self.stack[depth:]
        if self.link_depth > depth:
            self.link_depth = 0
        self.block = self.stack[-1].home

    def _in_prose(self) -> bool:
        return self.open["p"] > 0 and not self.open["form"] and not self.stack[-1].silent

    def _start(self, tag: str, more: str) -> None:
        stack = self.stack
        inline = tag in _INLINE
        if tag in _CONTROLS:
            stack[-1].controls += 1
        if tag in _IN_PROSE and self._in_prose():
            return
        if inline:
            if tag == "br":
                self.run.append(" ")
                return
            if tag == "a":
                self.link_depth = len(stack)
            if tag in _VOID or stack[-1].silent and not self.open[tag]:
                return
            if not (more and _TOLD.search(more)) and stack[-1].tag != tag and tag not in _SILENT and not stack[-1].silent:
                return
        elif tag in _VOID:
            if tag == "hr":
                self.flush()
            return
        else:
            closed = _CLOSED_BY.get(tag, ())
            if self.open["p"] or closed:
                for depth in range(len(stack) - 1, 0, -1):
                    open_tag = stack[depth].tag
                    if open_tag == "p" or open_tag in closed:
                        self._close(depth)
                        break
                    if open_tag in _SCOPES:
                        break
            self.flush()
        parent = stack[-1]
        names, silent = "", parent.silent or tag in _SILENT
        if more and _TOLD.search(more):
            known = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(more)}
            names = _CAMEL.sub("-", f"{known.get('class', '')} {known.get('id', '')}").lower().strip()
            silent = (
                silent or known.get("role", "").lower() in _ROLES or "hidden" in known or known.get("aria-hidden") == "true"
                or "display:none" in known.get("style", "").replace(" ", "").lower())
        node = _Node(tag, parent, names, silent)
        self.nodes.append(node)
        if more.endswith("/") and tag not in _SCOPES and tag != "p":
            return
        stack.append(node)
        self.open[tag] += 1
        self.block = node.home

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if not self.open[tag]:
            return
        inline = tag in _INLINE
        stack = self.stack
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = stack[depth].tag
            if open_tag == tag:
                self._close(depth)
                return
            if inline and open_tag not in _INLINE:
                return


def _total(page: _Page) -> None:
    """Letters, letters in links, headings, prose and list items of every element, from below."""
    for node in page.nodes:
        node.chars = node.linked = node.items = node.heads = node.prose = 0
    for node, text, linked in page.blocks:
        node.chars += len(text)
        node.linked += linked
        node.heads += node.tag in _HEADINGS
        if len(text) >= 25 and 2 * linked < len(text) and node.tag not in _HEADINGS:
            node.prose += len(text) - linked
    for node in reversed(page.nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.heads += node.heads
            up.prose += node.prose
            up.items += node.tag in ("li", "td") and node.chars > 0
            up.holds |= node.holds or node.tag in ("article", "main", "h1")


def _above(nodes: Iterator[_Node]) -> set[int]:
    """The ids of all elements that hold one of `nodes`."""
    ids: set[int] = set()
    for node in nodes:
        up = node.parent
        while up is not None and id(up) not in ids:
            ids.add(id(up))
            up = up.parent
    return ids


def _spared(page: _Page) -> set[int]:
    """Forms, fieldsets and asides that hold the article or the title or, unless the article is elsewhere, most text."""
    if not any(n.tag in _CONTAINERS and not n.silent for n in page.nodes):
        return set()
    seen = [n for n in page.nodes if not n.silent and n.chars]
    articles = [n for n in seen if n.tag in ("article", "main")]
    holds = _above(articles)
    header = {id(n) for n in seen if n.tag == "header" and not n.within}
    for n in seen:
        if n.parent is not None and id(n.parent) in header:
            header.add(id(n))
    titled = _above([n for n in seen if n.tag == "h1" and id(n) not in header][:1])
    return {id(n) for n in seen if n.tag in _CONTAINERS and (
        id(n) in holds or (n.within or not articles) and (id(n) in titled or 2 * n.chars > page.root.chars))}


@lru_cache(maxsize=1 << 14)
def _kind_of(name: str) -> int | None:
    """The first kind of furniture that a whole name is; names beyond 48 letters are none."""
    return next((k for k, pattern in enumerate(_NAMED) if pattern.fullmatch(name)), None) if len(name) <= 48 else None


def _kind(names: str) -> int | None:
    return min((k for k in map(_kind_of, names.split()) if k is not None), default=None)


def _is_furniture(node: _Node, controls: dict[int, int]) -> bool:
    """Whether an element is named as furniture and, where the name may be a section's, holds what furniture does."""
    kind = _kind(node.names) if node.names else None
    if kind is None:
        return not node.within and (node.tag == "header" or any(len(n) <= 48 and _TOP.fullmatch(n) for n in node.names.split()) and not _OWN_TOP.search(node.names))
    if kind == 0:
        return True
    plain = node.prose > 0 and 2 * node.linked < node.chars and not controls[id(node)]
    if kind == 1:
        return not (plain and node.heads)
    # outside an article, teasers have prose too, but their headings are links
    return not (plain and (node.within or node.heads and 10 * node.linked < node.chars))


def _drop_furniture(page: _Page) -> None:
    """Mark elements named as furniture, unless they hold the article or, on a page without one, most text."""
    _total(page)
    spared = _spared(page)
    for node in page.nodes:
        node.silent |= node.parent is not None and node.parent.silent or node.tag in _CONTAINERS and id(node) not in spared
    page.blocks = [b for b in page.blocks if not b[0].silent]
    _total(page)
    controls = {id(n): n.controls for n in page.nodes}
    for node in reversed(page.nodes):
        if node.parent is not None:
            controls[id(node.parent)] += controls[id(node)]
    for node in page.nodes:
        up = node.parent
        if up is None:
            continue
        node.silent |= up.silent
        if node.silent or node.tag in ("html", "body", "article", "main") or node.tag in _INLINE and not node.names:
            continue
        if _is_furniture(node, controls) and not (node.holds and node.tag != "header") and (page.root.holds or 2 * node.chars <= page.root.chars):
            node.silent = True
        # a list of links in an article is one of its own, like its references
        if node.tag in ("ul", "ol", "table", "dl") and not node.within and node.items >= 3 and node.linked >= 0.8 * node.chars:
            node.silent = True
    page.blocks = [b for b in page.blocks if not b[0].silent]
    _total(page)


def _score(page: _Page) -> None:
    for node, text, linked in page.blocks:
        if len(text) < 25 or node.tag in _HEADINGS:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        # text straight inside a container counts for that container itself
        up, level = (node.parent if node.tag in ("p", "pre", "li", "td", "dd", "blockquote") else node), 1
        while up is not None:
            up.points += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = up.parent, level + 1
            if level > 8:
                break
    for node in page.nodes:
        if node.chars:
            node.points += _BONUS.get(node.tag, 0)
        node.points *= 1 - (node.linked / node.chars if node.chars else 0)


def _lifted(page: _Page, best: _Node) -> _Node:
    """The outermost article that holds `best`, else the nearest main, else the lowest ancestor with nearly all prose."""
    above = []
    up: _Node | None = best
    while up is not None:
        above.append(up)
        up = up.parent
    for node in reversed(above):
        if node.tag == "article":
            return node
    for node in above:
        if node.tag == "main":
            return node
    prose = {id(n): 0 for n in page.nodes}
    for node, text, linked in page.blocks:
        if len(text) >= 25 and node.tag not in _HEADINGS:
            prose[id(node)] += len(text) - linked
    for node in reversed(page.nodes):
        if node.parent is not None:
            prose[id(node.parent)] += prose[id(node)]
    for k, node in enumerate(above):
        if 10 * prose[id(node)] >= 9 * prose[id(page.root)]:
            if 4 * node.linked >= node.chars:
                return best
            # rows of links beside the prose are not part of it
            path = {id(n) for n in above[1:k + 1]}
            for n in page.nodes:
                if n.parent is not None and id(n.parent) in path and n.tag not in _INLINE and n.chars and 5 * n.linked >= 4 * n.chars:
                    n.silent = True
            return node
    return best


def _kept(page: _Page) -> tuple[set[int], _Node]:
    """The best container and the siblings that belong to it."""
    best = max(page.nodes, key=lambda n: n.points)  # the first of equal ones
    if not best.points:
        best = next((n for n in page.nodes if n.tag == "article" and not n.silent), None) or next(
            (n for n in page.nodes if n.tag == "main" and not n.silent), page.root)
    best = _lifted(page, best)
    keep = {id(best)}
    bar = max(10.0, 0.2 * best.points)
    for node in page.nodes:
        if node.parent is not best.parent or node is best or node.silent or node.tag in _HEADINGS:
            continue
        share = node.linked / node.chars if node.chars else 1.0
        prose = node.tag == "p" and share < 0.25 and node.chars > 80
        alike = (best.names and node.names == best.names or node.tag == best.tag == "section") and share < 0.25
        if node.points >= bar or prose or alike:
            keep.add(id(node))
    return keep, best


def _chosen(page: _Page) -> list[str]:
    """The blocks inside what is kept, with headings and unlinked blocks between or directly before it."""
    keep, best = _kept(page)
    inside: dict[int, bool] = {}
    top: dict[int, _Node | None] = {}  # the child of the best container's parent that holds an element
    title = False
    for node in page.nodes:
        up = node.parent
        node.silent |= up is not None and up.silent
        inside[id(node)] = id(node) in keep or up is not None and inside[id(up)]
        top[id(node)] = node if up is best.parent and up is not None else top.get(id(up))
        title |= node.tag == "h1" and node.chars > 0 and inside[id(node)]
    units: list[list] = []  # child or None, kept, only headings, letters, letters in links, texts
    for node, text, linked in page.blocks:
        child = top[id(node)]
        if node.silent or not inside[id(node)] and child is None and node is not best.parent:
            continue
        if not units or child is None or units[-1][0] is not child:
            units.append([child, inside[id(node)], True, 0, 0, []])
        unit = units[-1]
        unit[2] &= node.tag in _HEADINGS
        unit[3] += len(text)
        unit[4] += linked
        unit[5].append(text)
    first = next((n for n, u in enumerate(units) if u[1]), len(units))
    marked = best.tag in ("article", "main")
    out: list[list[str]] = []
    before = after = False
    for n in range(len(units) - 1, -1, -1):
        _, kept, heading, chars, linked, texts = units[n]
        alone = 4 * linked < chars
        if n < first:
            # what a page marks as its article or main needs only a missing title
            before = (before or n == first - 1) and (heading and not title if marked else alone)
        if kept or n < first and before or first < n and after and alone:
            out.append(texts)
            after = True
    return [text for texts in reversed(out) for text in texts]


def main_text(html: str) -> str:
    """The blocks of the main content, joined by line feeds; empty if there are none."""
    page = _Page(html)
    _drop_furniture(page)
    if not page.blocks:
        return ""
    _score(page)
    return "\n".join(_chosen(page))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in strings(batch.column("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html).

    A null or empty page, or one without text, gives an empty text. Broken markup is read as far as it
    goes: open elements end with the page. Rows that repeat are extracted each; ids and urls may be null.
    """
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return columns.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
