"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt legend li optgroup option summary tbody td tfoot th thead tr html body".split())
# Elements that a start tag closes, and the elements that hide an open one of a kind from it.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
HIDES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("p", "tr", "td", "th", "thead", "tbody"), "select": ("option",), "button": ("p",), "td": ("p",), "th": ("p",)}
# Never seen; never part of an article, unless they hold it (a header counts only outside of one) (fixed values).
UNSEEN = frozenset("script style template iframe svg object canvas head title audio video textarea input select".split())
DROPPED = frozenset("nav footer form menu dialog search".split())
# Never seen outside of an article; in it they go if they are thin. So do named elements there, if they hold blocks and are
# not one: a paragraph, heading or list item of any name is the article's (fixed values).
ASIDES = frozenset("aside button noscript".split())
HOLDERS = ASIDES | frozenset("div section ul ol dl table figure details fieldset center".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
# Parts of class and id names: what they tell of, words that tell nothing, and words of an article (fixed values).
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
HEAD_NAMES = frozenset("header masthead banner topbar".split())
DROPPED_NAMES = COMMENT_NAMES | HEAD_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banners breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr menu menus modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended related share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
EMPTY_NAMES = frozenset(
    "list box block wrapper wrap container section area inner outer page site top bottom left right primary secondary global mobile desktop posts articles item items "
    "link links button buttons bar panel module unit slot zone text form row group holder icons main".split()
)
ARTICLE_NAMES = frozenset("article content entry post story".split())
CONTENT = frozenset(["article", "main"])
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW_END = {tag: re.compile(f"</{tag}[\\s/>]", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "own", "chars", "link_chars", "tags", "link_tags", "density", "sum")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.own = None
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def _tags(html: str):
    """(begin, end, slash, name, attributes) of each tag, comment (name None) or declaration, each character read once."""
    at, quoted = 0, True
    last = {c: html.rfind(c) for c in "\"'>"}
    while (lo := html.find("<", at)) >= 0:
        after = html[lo + 1 : lo + 2]
        if html.startswith("<!--", lo):
            end = html.find("-->", lo + 4)
            at = end + 3 if end >= 0 else len(html)
            yield lo, at, False, None, ""
        elif after in ("!", "?"):
            end = html.find(">", lo)
            at = end + 1 if end >= 0 else len(html)
            yield lo, at, False, None, ""
        elif m := _NAME.match(html, lo + 1 + (after == "/")):
            if m.end() > last[">"]:  # a tag that never ends
                yield lo, len(html), False, None, ""
                return
            stop, i = -1, m.end()
            while quoted and (q := _STOP.search(html, i)):
                if q[0] == ">":
                    stop = q.start()
                    break
                if q.start() >= last[q[0]]:  # a quote that never ends: from here on quotes are ordinary characters
                    quoted = False
                    break
                i = html.find(q[0], q.end()) + 1
            if stop < 0:
                stop = html.find(">", m.end())
            name = m[0].lower()
            at = stop + 1
            yield lo, at, after == "/", name, html[m.end() : stop]
        else:
            at = lo + 1


def parse(html: str) -> Node:
    """A tree of the elements and texts; unclosed and misplaced tags are mended by the usual rules.

    Takes time in proportion to the page: which open elements a tag would close is kept beside the stack of open ones,
    so the stack is searched only where elements are taken off it.
    """
    root = Node("#root", "", None)
    stack: list[tuple[Node, frozenset[str]]] = [(root, frozenset())]  # an element, and the kinds open in its scope
    count: dict[str, int] = {}
    at, skip = 0, 0
    kinds = frozenset(("p", *(k for v in CLOSED_BY.values() for k in v)))

    def close(tags) -> None:
        while True:
            x = stack.pop()[0].tag
            count[x] -= 1
            if x in tags:
                return

    for lo, end, slash, tag, attrs in _tags(html):
        if lo < skip:
            continue
        if lo > at:
            stack[-1][0].kids.append(html[at:lo])
        at = end
        if tag is None:
            continue
        if slash:
            if count.get(tag):
                close((tag,))
            continue
        if tag in CLOSES_P and "p" in stack[-1][1]:
            close(("p",))
        if tag in CLOSED_BY:
            while not stack[-1][1].isdisjoint(CLOSED_BY[tag]):
                close(CLOSED_BY[tag])
        node, scope = stack[-1]
        new = Node(tag, attrs, node)
        node.kids.append(new)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            stop = found.start() if found else len(html)
            new.kids.append(html[at:stop])
            at = (html.find(">", stop) + 1 or len(html)) if found else len(html)
            skip = at
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            if tag in HIDES:
                scope = scope.difference(HIDES[tag])
            stack.append((new, scope | {tag} if tag in kinds else scope))
            count[tag] = count.get(tag, 0) + 1
    if at < len(html):
        stack[-1][0].kids.append(html[at:])
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(node.attrs)} if node.attrs.strip() else {}


def _walk(root: Node) -> list[Node]:
    """All elements, each before those in it."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return out


def _told_by_name(a: dict[str, str]) -> str | None:
    """What the class or id tells: "comment", "head" or "other" boilerplate, or None.

    A name counts as a whole: each of its parts, as in "cookie-notice", must tell of boilerplate or nothing at all. So
    "notice-period", "has-sidebar" and "related-work" tell nothing, and "entry-header" is the head of an article.
    """
    told = None
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        hits = parts & DROPPED_NAMES
        if not hits or any(not p.isdigit() for p in parts - DROPPED_NAMES - EMPTY_NAMES - ARTICLE_NAMES):
            continue
        if hits & COMMENT_NAMES:
            return "comment"
        if hits <= HEAD_NAMES:
            if not parts & ARTICLE_NAMES:
                told = told or "head"
        else:
            told = "other"
    return told


def _unseen(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    if "hid" not in node.attrs and "none" not in node.attrs:
        return False
    a = _attributes(node)
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))


def _filtered(root: Node, gone) -> None:
    """Take out the elements for which gone(element, whether in an article) holds, with all in them."""
    todo = [(root, False)]
    while todo:
        x, within = todo.pop()
        within = within or x.tag in CONTENT
        x.kids = [k for k in x.kids if not isinstance(k, Node) or not gone(k, within)]
        todo.extend((k, within) for k in x.kids if isinstance(k, Node))


def _above(nodes) -> set[int]:
    """The nodes and all their ancestors."""
    out: set[int] = set()
    for x in nodes:
        while x is not None and id(x) not in out:
            out.add(id(x))
            x = x.parent
    return out


def _best(root: Node) -> tuple[list[Node], Node, Node]:
    """All elements with their densities, the body, and the element of the largest density sum in it."""
    nodes = _measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    _score(nodes, body)
    best = max(_walk(body), key=lambda x: x.sum)
    return nodes, body, best if best.sum else body


def _prune(root: Node) -> None:
    """Take out menus, adverts and the like, by element, role or name.

    What density says comes first: an element that holds an article or the densest subtree is never taken out for its
    name or role, nor for being a form or a header. In an article, main element or that subtree a name takes nothing out
    by itself: what holds blocks, and an aside, button or noscript, also has to be less than half as dense (in unlinked
    characters a tag) as the thinnest element on the path from the densest subtree to the body, or mostly links. Reader comments always go, unless an article or main
    element is in them.
    """
    _filtered(root, lambda x, within: _unseen(x))
    articles = _above([x for x in _measure(root) if x.tag in CONTENT and x.chars])
    _filtered(root, lambda x, within: x.tag in DROPPED and x.tag != "form" and id(x) not in articles)
    named = {id(x): kind for x in _walk(root) if x.attrs and x.tag not in ("html", "body") and x.tag not in CONTENT and (kind := _told_by_name(_attributes(x)))}
    _filtered(root, lambda x, within: named.get(id(x)) == "comment" and id(x) not in articles)
    _, body, best = _best(root)
    above = _above([best])
    holds = articles | above
    least = min(_plain(x.chars, x.link_chars, x.tags) for x in _walk(body) if id(x) in above)
    inner = {id(x) for x in _walk(best)} if best is not body else set()

    def gone(x: Node, within: bool) -> bool:
        if id(x) in holds:
            return False
        within = within or id(x) in inner
        if x.tag == "form" or x.tag == "header" and not within:
            return True
        if x.attrs and "role" in x.attrs and _attributes(x).get("role", "").lower() in DROPPED_ROLES:
            return True
        kind = named.get(id(x))
        if not within:
            return kind is not None or x.tag in ASIDES
        return (kind == "other" or x.tag in ASIDES) and x.tag in HOLDERS and (2 * _plain(x.chars, x.link_chars, x.tags) < least or 2 * x.link_chars > x.chars)

    _filtered(root, gone)


def _measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for x in reversed(nodes):
        if x.own is None:
            x.own = sum(len(" ".join(unescape(k).split())) for k in x.kids if isinstance(k, str))
        inner = [k for k in x.kids if isinstance(k, Node)]
        x.chars = x.own + sum(k.chars for k in inner)
        x.tags = sum(k.tags + 1 for k in inner)
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags
        else:
            x.link_chars = sum(k.link_chars for k in inner)
            x.link_tags = sum(k.link_tags + (k.tag == "a") for k in inner)
    return nodes


def _score(nodes: list[Node], body: Node) -> None:
    """Composite text density: characters a tag, adjusted by the share of links; and the sum of the children's."""
    for x in nodes:
        if x.chars:
            c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            base = math.log(c / max(c - x.link_chars, 1) * x.link_chars + body.link_chars / max(body.chars, 1) * c + math.e)
            x.density = c / t * max(0.0, math.log(c / lc * (t / lt))) / max(math.log(max(base, 1.0) + 1.0), 0.1)
    for x in nodes:
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node))


def _blocks(top: Node, least: float, inner: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks under top in page order, without link lists thinner than least that are not among the inner ones."""
    out: list[list[str]] = [[]]
    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x is not top and x.tag in BLOCK and id(x) not in inner and x.density < least and x.link_chars > 0.5 * x.chars and x.link_tags > 1:
            continue
        elif x.tag == "br":
            out[-1].append(" ")
        elif x.tag in BLOCK:
            out.append([])
            todo.append(None)
            todo.extend(reversed(x.kids))
        else:
            todo.extend(reversed(x.kids))
    texts = (_SPACE.sub(" ", unescape("".join(b))).strip() for b in out if b)
    return [t for t in texts if t]


def _plain(chars: int, links: int, tags: int) -> float:
    return (chars - links) / max(tags, 1)


def main_text(html: str) -> str:
    """The blocks of the main text, joined by line feeds.

    After pruning, the subtree with the largest density sum is found. If it lies in an article or main element that
    holds most of the text of such elements, that is the main text. Else it is widened, ancestor by ancestor, while what
    the ancestor adds is at least half as dense (unlinked characters a tag) as the thinnest element on the path to the
    body, so an article in several sections stays whole. A first heading that stands before it goes with it.
    """
    root = parse(html)
    _prune(root)
    nodes, body, best = _best(root)
    path, x = [], best
    while x is not None and x is not body.parent:
        path.append(x)
        x = x.parent
    least = min(p.density for p in path)
    thin = min(_plain(p.chars, p.link_chars, p.tags) for p in path)
    top = next((p for p in reversed(path) if p.tag == "article"), None) or next((p for p in reversed(path) if p.tag == "main"), None) or best
    outermost, todo = [], [body]
    while todo:
        x = todo.pop()
        if x.tag in CONTENT:
            outermost.append(x)
        else:
            todo.extend(k for k in x.kids if isinstance(k, Node))
    if top.tag not in CONTENT or 2 * top.chars < sum(x.chars for x in outermost):
        for p in path[path.index(top) + 1 :]:
            if 2 * _plain(p.chars - top.chars, p.link_chars - top.link_chars, p.tags - top.tags) < thin and p.chars > top.chars:
                break
            top = p
    own = {id(y) for x in (best, *outermost) for y in _walk(x)} if best is not body else {id(y) for x in outermost for y in _walk(x)}
    texts = _blocks(top, least, own)
    if not any(x.tag == "h1" for x in _walk(top)):
        x = top
        while x is not body and x is not root:
            before = [k for k in x.parent.kids[: next(i for i, k in enumerate(x.parent.kids) if k is x)] if isinstance(k, Node)]
            heads = [k for k in before if k.tag == "h1" or k.tag in ("hgroup", "header", "div") and any(y.tag == "h1" for y in _walk(k)) and not k.link_chars]
            if heads:
                return "\n".join([*_blocks(heads[-1], 0.0), *texts])
            x = x.parent
    return "\n".join(texts)


def _run(batches):
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column("html")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and main text of every page from its whole html.

    Null or empty html, and pages without text: "". Null or repeated ids and urls are kept row by row. No shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
