"""Main text of web pages, by scoring the element tree.

A page is read into a tree. Elements that never hold an article, by their tag or role, are
left out; forms, and elements whose class or id names what surrounds an article, only where
the points of their paragraphs are few beside the rest of the page, as wrappers of a whole
page bear such names too. Every paragraph then passes points for its length
and its commas to its ancestors, less with each level; the share of a container's text that
is in links lowers its score. The best container is kept, or the whole article or main around it,
together with siblings that score well against it or are running text with few links; under
main all but lists of links.

Reading follows what browsers do with the usual slips: tags that are never closed, quotes
in attributes, ``<`` in text, scripts that hold tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of HTML ---------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: elements that begin and end blocks of text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: a start tag of these ends an open paragraph
ENDS_PARAGRAPH = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split())
#: a start tag ends an open element of the same kind, up to one of the second kind
ENDS_ITSELF = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "optgroup"}),
}

# --- what is no article ------------------------------------------------------------------

DROPPED_TAGS = frozenset(
    "head script style noscript template title nav footer aside button select option textarea input iframe "
    "object embed svg canvas audio video map dialog menu search noembed noframes".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar "
    "tablist status note".split())
#: words of a class or id that name what surrounds an article
SURROUNDING = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer foot masthead "
    "sidebar sidebars aside rail widget widgets comment comments commentlist disqus replies respond discussion "
    "cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup "
    "login popup modal overlay toast share sharing social related recommended recommendations trending "
    "outbrain taboola skip hidden toolbar topbar paywall".split())
#: of those, words that name what readers write
READERS = frozenset("comment comments commentlist disqus replies respond discussion".split())
#: of those, words that a paragraph may bear as its topic
TOPICS = frozenset("social related recommended trending discussion rail".split())
#: "related" names surroundings alone or with words for what is listed, as in "related-posts"
LISTED = frozenset(
    "related post posts article articles link links story stories content contents item items list box block news "
    "reading section widget container wrapper area topics pages products videos grid cards card more media".split())
#: words before or beside the ones above that make a name of layout of them
LAYOUT = frozenset("with has no without".split())
#: of those, words that may also name a wrapper of the article and what stands beside it
WRAPPING = frozenset("sidebar sidebars rail nav navbar menu banner widget widgets".split())
FAVOURED = frozenset("article main content body post entry story text page blog".split())
KEPT_TAGS = frozenset("html body article main".split())
#: elements that hold running text
PARAGRAPHS = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 figcaption".split())
#: points that a page without its marked elements has to keep: those of a paragraph or so
LEAST_REST = 3.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\s\"'>]+)", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "score", "size", "linked")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = 0  # characters of text, of text in links


def parse(page: str) -> Node:
    """The element tree; its root stands above ``html``."""
    root = at = Node("", "", None)
    end = 0
    position, length = 0, len(page)
    while position < length:
        found = _TOKEN.search(page, position)
        if found is None:
            break
        if found.start() > end:
            at.children.append(page[end:found.start()])
        position = end = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                at.children.append(found[0][9:-3])
            continue
        tag = name.lower()
        if found[1] or found[4]:
            at = _closed(at, tag)
            continue
        if tag in ENDS_PARAGRAPH:
            at = _ended(at, {"p"}, BLOCKS - {"p"})
        if tag in ENDS_ITSELF:
            at = _ended(at, *ENDS_ITSELF[tag])
        node = Node(tag, found[3] or found[6] or "", at)
        at.children.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(page, position)
            if tag == "textarea" or tag == "title":
                node.children.append(page[position:stop.start() if stop else length])
            position = end = stop.end() if stop else length
        elif tag not in VOID and not node.attributes.rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            at = node
    if end < length:
        at.children.append(page[end:])
    return root


def _closed(at: Node, tag: str) -> Node:
    """Where an end tag leads. One without its start tag in the same block is ignored."""
    node, inline = at, tag not in BLOCKS
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if inline and node.tag in BLOCKS:
            return at
        node = node.parent
    return at


def _ended(at: Node, tags: set, borders) -> Node:
    """Where a start tag stands that ends the nearest of ``tags`` within ``borders``."""
    node = at
    while node.parent is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in borders:
            return at
        node = node.parent
    return at


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(node.attributes)}


def names(value: str) -> list[list[str]]:
    """The words of each class name or id."""
    return [[w.lower() for w in _NAME_PARTS.findall(x)] for x in value.split()]


def marks(node: Node, own: dict[str, str], holds: bool = False) -> set[str]:
    """The words of an element's class and id that name what surrounds an article.

    With ``holds`` an article is below it, and words that may name a wrapper do not count.
    """
    found: set[str] = set()
    for words in names(f"{own.get('class', '')} {own.get('id', '')}"):
        some = SURROUNDING & set(words)
        if not some or LAYOUT & set(words):
            continue
        if not set(words) <= LISTED:
            some -= {"related"}
        found |= some
    if holds:
        found -= WRAPPING
    if node.tag in PARAGRAPHS:
        found -= TOPICS
    if node.tag == "section":
        found -= {"discussion"}  # as a chapter of an article
    return found


def never(node: Node, own: dict[str, str]) -> bool:
    """Whether an element holds no article whatever its text."""
    if node.tag in DROPPED_TAGS or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    return node.tag not in KEPT_TAGS and bool(DROPPED_ROLES & set(own.get("role", "").lower().split()))


def prune(root: Node) -> None:
    """Takes out what surrounds an article.

    The header of a page goes. Inside an article a header is left with its headings.
    """
    order, inside = in_order(root), {}
    for node in order:
        inside[id(node)] = node.tag in ("article", "main") or node.parent is not None and inside[id(node.parent)]
    holds: set[int] = set()  # elements with an article below or at them
    marked: dict[int, set[str]] = {}
    for node in reversed(order):
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            if child.tag == "header":
                kept += headings(child) if inside[id(node)] else []
                continue
            below = id(child) in holds
            own = attributes(child) if child.attributes else {}
            if never(child, own):
                continue
            kept.append(child)
            words = set() if child.tag in KEPT_TAGS else marks(child, own, below and not inside[id(node)])
            if child.tag == "form":
                words.add("form")
            if words:
                marked[id(child)] = words
            elif below:
                holds.add(id(node))
        node.children = kept
        if node.tag in ("article", "main"):
            holds.add(id(node))
    if marked:
        _drop_marked(root, marked)


def _drop_marked(root: Node, marked: dict[int, set[str]]) -> None:
    """Drops marked elements, but for wrappers of what the page has to say.

    The largest of the outermost ones is a wrapper if next to nothing is left without it, or
    if it holds the page's first heading or main and more points than the rest. Then it stays,
    and the marked ones inside it are looked at in the same way.
    """
    order = in_order(root)
    _measure(root)
    points: dict[int, float] = {}
    first: set[int] = set()  # elements with a first heading or main at or below them
    for node in reversed(order):
        own = _points(node) if _is_running(node) and not re.fullmatch("h[1-6]", node.tag) else 0.0
        points[id(node)] = own + sum(points[id(c)] for c in node.children if isinstance(c, Node))
        if node.tag in ("h1", "main") or any(id(c) in first for c in node.children if isinstance(c, Node)):
            first.add(id(node))
    outer = _outermost(root, marked)
    rest = points[id(root)] - sum(points[id(x)] for x in outer)
    while outer:
        most = max(outer, key=lambda x: points[id(x)])  # the first of equals
        held = points[id(most)]
        own = attributes(most) if most.attributes else {}
        named = [set(x) for x in names(f"{own.get('class', '')} {own.get('id', '')}")]
        content = any(x <= FAVOURED | {"entry", "wrap"} for x in named)
        least = LEAST_REST if content or not marked[id(most)] & READERS else LEAST_REST / 6
        if not (rest < least and rest < held / 10 or id(most) in first and held > rest):
            break
        within = _outermost(most, marked)
        outer = [x for x in outer if x is not most] + within
        rest += held - sum(points[id(x)] for x in within)
    gone = {id(x) for x in outer}
    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]


def _outermost(root: Node, marked: dict[int, set[str]]) -> list[Node]:
    """The marked elements below ``root`` that lie in no other one."""
    found, stack = [], [c for c in reversed(root.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        if id(node) in marked:
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def in_order(root: Node) -> list[Node]:
    """All elements in page order; without recursion, since pages may nest very deep."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def headings(node: Node) -> list[Node]:
    return [x for x in in_order(node) if re.fullmatch("h[1-6]", x.tag)]


def blocks_of(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks below, in page order, white space as one space."""
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            found.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag == "br":
            line.append(" ")
        elif node.tag in BLOCKS:
            flush()
            stack.append(None)
            stack += reversed(node.children)
        else:
            stack += reversed(node.children)
    flush()
    return found


def _measure(node: Node) -> list[Node]:
    """Sizes of all elements, bottom up, and the elements in page order."""
    order = in_order(node)
    for x in reversed(order):
        own = sum(len(" ".join(c.split())) for c in x.children if isinstance(c, str))
        x.size = own + sum(c.size for c in x.children if isinstance(c, Node))
        x.linked = x.size if x.tag == "a" else sum(c.linked for c in x.children if isinstance(c, Node))
    return order


def link_density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _is_running(node: Node) -> bool:
    """Whether an element is a paragraph, or a block with text of its own."""
    loose = node.tag not in PARAGRAPHS and (node.tag in BLOCKS or not node.tag) and any(
        isinstance(c, str) and not c.isspace() for c in node.children)
    return node.size > 0 and (loose or node.tag in PARAGRAPHS)


def _points(node: Node) -> float:
    """The points of a paragraph: its length and commas, less the share of links."""
    text = "".join(c for c in node.children if isinstance(c, str))
    commas = text.count(",") + sum(_commas(c) for c in node.children if isinstance(c, Node) and c.tag not in BLOCKS)
    return (min(node.size / 25.0, 1.0) + commas + min(node.size / 100.0, 3.0)) * (1.0 - link_density(node))


def score(root: Node) -> list[Node]:
    """Scores all containers and returns them in page order."""
    order = _measure(root)
    containers: dict[int, Node] = {}
    for node in order:
        if not _is_running(node):
            continue
        points, loose = _points(node), node.tag not in PARAGRAPHS
        level, above = 1.0, node if loose else node.parent
        while above is not None and above.tag != "html":
            if id(above) not in containers:
                containers[id(above)] = above
                above.score = _favour(above)
            above.score += points / level
            level = 2.0 if level == 1.0 else level * 1.5
            above = above.parent
    return [n for n in order if id(n) in containers]


def _commas(node: Node) -> int:
    return sum(c.count(",") for x in in_order(node) for c in x.children if isinstance(c, str))


def _favour(node: Node) -> float:
    if node.tag in ("article", "main"):
        return 25.0
    own = attributes(node) if node.attributes else {}
    words = {w for x in names(f"{own.get('class', '')} {own.get('id', '')}") for w in x}
    return 10.0 if words & FAVOURED else 5.0 if node.tag == "div" else 0.0


def best_nodes(root: Node) -> list[Node]:
    """The best container, or the article around it, and siblings that belong to it.

    Siblings are looked for on each level up to the element that holds every article and
    main of the page, so that text beside an article and further articles stay.
    """
    containers = score(root)
    if not containers:
        return []
    worth = {id(n): n.score * (1.0 - link_density(n)) for n in containers}
    top = max(containers, key=lambda n: worth[id(n)])  # the first of equals
    around, node = None, top
    while node is not None:
        if node.tag == "article" or node.tag == "main" and around is None:
            around = node
        node = node.parent
    if around is not None:
        top = around
    else:
        # a container whose parts share the text equally scores less than its parent
        while top.parent is not None and worth.get(id(top.parent), 0.0) >= worth[id(top)] and top.parent.tag not in ("body", ""):
            top = top.parent
    # a wrapper without text of its own stands among the siblings of what it wraps
    while top.parent is not None and top.parent.tag not in ("body", "main", "") and top.parent.size == top.size:
        top = top.parent
    if top.tag in ("body", ""):
        return [top]
    best = max(worth.get(id(top), 0.0), max(worth[id(n)] for n in containers))
    least = max(0.2 * best, min(10.0, 0.5 * best))
    articles: dict[int, int] = {}  # with text, at or below each element
    for node in reversed(in_order(root)):
        below = sum(articles[id(c)] for c in node.children if isinstance(c, Node))
        articles[id(node)] = below + (node.tag in ("article", "main") and node.size > 0)
    above = [top.parent]
    while articles[id(above[-1])] < articles[id(root)]:
        above.append(above[-1].parent)
    in_main, node = set(), top.parent  # the levels inside the outermost main
    path = []
    while node is not None:
        path.append(id(node))
        if node.tag == "main":
            in_main = set(path)
        node = node.parent

    inner_size = top.size

    def belongs(node: Node, main: bool) -> bool:
        dense = link_density(node)
        if node.size < inner_size / 2 and _is_teaser(node):
            return False
        if worth.get(id(node), 0.0) >= least or main and dense < 0.5:
            return True
        running = node.tag in PARAGRAPHS or articles.get(id(node), 0) > 0
        return running and (dense < 0.25 if node.size > 80 else dense == 0.0)

    kept, inner = [top], top
    for parent in above:
        main = id(parent) in in_main
        kept = [x for part in _parts(parent, inner) for x in (
            kept if part is inner else [part] if part.size and belongs(part, main) else [])]
        inner = parent
    return kept


def _is_teaser(node: Node) -> bool:
    """Whether an article is a card that leads to another page: all its headings are links."""
    if node.tag != "article":
        inner = [c for c in node.children if isinstance(c, Node)]
        return len(inner) > 0 and all(c.tag == "article" and _is_teaser(c) for c in inner if c.size)
    tops = [h for h in headings(node) if h.size]
    return bool(tops) and all(h.linked == h.size or _in_link(h, node) for h in tops)


def _in_link(node: Node, top: Node) -> bool:
    while node is not top:
        node = node.parent
        if node.tag == "a":
            return True
    return False


def _parts(parent: Node, inner: Node) -> list[Node]:
    """The blocks below ``parent`` and ``inner``; what runs between them is a paragraph each."""
    parts: list[Node] = []
    run: Node | None = None
    for child in parent.children:
        if child is inner or isinstance(child, Node) and child.tag in BLOCKS:
            parts.append(child)
            run = None
            continue
        if run is None:
            run = Node("p", "", parent)
            parts.append(run)
        run.children.append(child)
        run.size += len(" ".join(child.split())) if isinstance(child, str) else child.size
        run.linked += 0 if isinstance(child, str) else child.linked
    return parts


def drop_link_lists(nodes: list[Node]) -> None:
    """Lists and tables inside the article that are mostly links are menus.

    A list that leads to several hosts is one of sources, and stays.
    """
    stack = list(nodes)
    while stack:
        node = stack.pop()
        own = [c for c in node.children if isinstance(c, Node)]
        menus = [c for c in own if c.tag in ("ul", "ol", "dl", "table", "div", "section") and _links(c) > 1 and link_density(c) > 0.6 and len(_hosts(c)) < 2]
        if menus:
            node.children = [c for c in node.children if isinstance(c, str) or c not in menus]
        stack += [c for c in own if c not in menus]


def _hosts(node: Node) -> set[str]:
    found = (_HREF.search(x.attributes) for x in in_order(node) if x.tag == "a")
    return {m[1].lower() for m in found if m}


def _links(node: Node) -> int:
    return sum(x.tag == "a" for x in in_order(node))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    nodes = best_nodes(root)
    drop_link_lists(nodes)
    return " ".join(blocks_of(nodes))


#: rows turned into Python strings at once
SLICE = 128


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``text``, the main text of the whole page.

    Character references are decoded, white space inside a block is one space, and blocks
    are joined by one space in page order. A null or empty page, or one without any text,
    has an empty text. Rows keep their multiplicity; a column ``text`` in ``keep`` is
    replaced.
    """
    kept = [c for c in keep if c != "text"]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_column}`").alias("html"))
    kind = rows.schema["row"].dataType.simpleString()
    texts: Callable = rows.mapInArrow(_extract, f"row {kind}, text string")
    return texts.select("row.*", "text")
