"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters C, tags T, link characters LC and link tags LT,
and the composite density

    C / T * log base ln(C / nLC * LC + LCb / Cb * C + e) of (C / LC * T / LT)

with nLC = C - LC, LCb and Cb those of the body and counts that divide taken as one where they are
zero.  A node's score is the sum of its child blocks' densities, and the node of the greatest score
is the main subtree's core.  Where the core lies in an ``article``, that is the article, with the headings, articles and
dense blocks beside it in a ``main``; outside a ``main`` only other articles that reach the
threshold stay beside it, and a first heading where it has none.  The threshold is the least
density on the way from the core to the body.  A ``main`` without an ``article`` is taken whole.
Where there is neither, the body is taken with all blocks beside that way that reach the
threshold.  Of the others only those go whose characters are mostly those of links, so that
headings, tables, lists and short sections stay.

Before that, parts that are no article by their element, role, class or id are taken out of the
tree: menus, headers and footers of the page, sidebars, notices, adverts, forms, comments,
scripts and styles.  They are judged when the tree is built and counted: no part goes that holds
the article, as a form around the page does, or a menu that is never closed (see ``_prune``).  A
class or id counts as a whole.  Inside the chosen subtree all other text is kept, whole.

A page is read in one pass whose time grows with its length, however damaged its tags are.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_NAME = re.compile(r"</?([a-zA-Z][^\s/>\"']*+)")
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_MARKS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"\s+")

#: Elements as HTML defines them; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes"
                .split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
                   "wbr img br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Opening one of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section "
                     "table ul".split())
#: Opening the key closes an open element of the value, up to the nearest of the listed bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
          "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
          "th": (("td", "th"), ("tr", "table"))}
#: What a page's head holds; any other element ends it.
HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements that are never part of an article.
NO_TEXT = RAW | frozenset("head nav footer aside form button select option input object embed "
                          "svg canvas audio video map dialog menu template".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog "
                    "alert menu menubar toolbar".split())
#: Words of a class or id that name other parts of a page.
NO_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "login share sharing social comment comments respond disqus related recommended widget "
    "toolbar pagination pager skip".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


#: Characters of a piece of text from which on it counts as running text, not as a label.
PROSE = 80

#: Why a part may go: its class or id, its element or role, or an element that is often wrapped
#: around more than it should be (a form, and whatever is never closed).
NAMED, ELEMENT, WRAPPER = 1, 2, 3


class Node:
    __slots__ = ("name", "kind", "parts", "own", "prose", "chars", "tags", "links", "link_tags",
                 "density", "score", "other")

    def __init__(self, name: str):
        self.name, self.parts = name, []
        #: "article" or "main" by its element or role.
        self.kind = name if name in ("article", "main") else ""
        #: Characters of its own text, and those of pieces that are running text.
        self.own = self.prose = 0
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.score = 0.0
        #: Why it may be another part of the page than the article; 0 if it is not.
        self.other = 0


def _judge(node: Node, attributes: str, inside: bool) -> None:
    """Set ``kind`` and ``other`` of a node from its element and attributes.  ``inside`` tells
    whether it lies in an ``article`` or ``main``, where a header belongs to the article."""
    name, named = node.name, False
    if name in NO_TEXT or name == "header" and not inside:
        node.other = ELEMENT if name == "footer" else WRAPPER
    if not attributes or attributes.isspace():
        return
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in ("article", "main"):
            node.kind = value.lower()
        elif node.other or node.kind:
            continue
        elif (key == "role" and value.lower() in NO_ROLE or key == "hidden"
              or key == "aria-hidden" and value.lower() == "true"
              or key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            node.other = ELEMENT
        elif key in ("class", "id"):
            named = named or _names_other(value)
    if named and not node.other and not node.kind:
        node.other = NAMED


def _names_other(value: str) -> bool:
    """Whether a class, or the id, is made of words that name other parts of a page: ``sidebar``
    and ``cookie-notice``, but not ``has-sidebar``."""
    for one in value.split():
        words = _WORDS.findall(one)
        if words and all(w.lower() in NO_CLASS for w in words):
            return True
    return False


def _prune(root: Node) -> None:
    """Count the own characters of all nodes and take out the other parts of the page.

    A part that holds a ``main`` stays.  Where no ``article`` or ``main`` lies outside such parts,
    three more stay: one named by class or id that holds an ``article`` or more than half of the
    body's plain characters; one told by element or role that holds an ``article`` and more plain
    characters than there are outside such parts; and a form, or an element that is never closed,
    with more of them than outside, most in running text.  Inside a part that stays the same holds
    again.
    """
    nodes = _below(root)
    for n in nodes:
        for p in n.parts:
            if isinstance(p, str):
                size = len(_BLANKS.sub("", html.unescape(p) if "&" in p else p))
                n.own += size
                n.prose += size if size >= PROSE else 0
    if not any(n.other for n in nodes):
        return
    plain, prose, mains, articles = {}, {}, {}, {}
    for n in reversed(nodes):
        below = [id(p) for p in n.parts if isinstance(p, Node)]
        link = n.name == "a"
        plain[id(n)] = 0 if link else n.own + sum(plain[p] for p in below)
        prose[id(n)] = 0 if link else n.prose + sum(prose[p] for p in below)
        mains[id(n)] = (n.kind == "main") + sum(mains[p] for p in below)
        articles[id(n)] = (n.kind == "article") + sum(articles[p] for p in below)
    tops = [root]
    for top in tops:
        # What lies below ``top``, but not inside another part of the page.
        free, found = [top], []
        for n in free:
            for p in n.parts:
                if isinstance(p, Node):
                    (found if p.other else free).append(p)
        marked = any(n.kind for n in free)
        outside = plain[id(top)] - sum(plain[id(p)] for p in found)
        for p in found:
            at = id(p)
            if mains[at]:
                stays = True
            elif marked:
                stays = False
            elif p.other == NAMED:
                stays = articles[at] > 0 or 2 * plain[at] > plain[id(root)]
            elif articles[at]:
                stays = plain[at] > outside
            else:
                stays = (p.other == WRAPPER and plain[at] > outside
                         and 2 * prose[at] > plain[at])
            if stays:
                p.other = 0
                tops.append(p)
    for n in nodes:
        n.parts = [p for p in n.parts if isinstance(p, str) or not p.other]


class _Tags:
    """Ends of tags.  A tag without an end is text; finding that out must not cost a scan to the
    end of the page each time, so what leads nowhere is remembered."""

    def __init__(self, page: str):
        self.page, self.damaged = page, False
        self.dead: set[int] = set()
        self.after: dict[int, int] = {}
        self.mark = (0, -1)

    def end(self, at: int) -> int:
        """The place behind the ``>`` of the tag whose name ends at ``at``, or -1."""
        if not self.damaged:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self.damaged = True
        # The first mark from a place on is also that of all places up to it.
        since, mark = self.mark
        if not since <= at <= mark:
            m = _MARKS.search(self.page, at)
            mark = m.start() if m else len(self.page)
            self.mark = (at, mark)
        way = []
        while mark < len(self.page) and mark not in self.dead:
            if self.page[mark] == ">":
                return mark + 1
            way.append(mark)
            if mark not in self.after:
                close = self.page.find(self.page[mark], mark + 1)
                m = _MARKS.search(self.page, close + 1) if close >= 0 else None
                self.after[mark] = m.start() if m else len(self.page)
            mark = self.after[mark]
        self.dead.update(way)
        return -1


class _Stack:
    """Open elements, with the places of each name and of the blocks among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.marked = 0

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.name, []).append(at)
        if node.name not in INLINE:
            self.blocks.append(at)
        self.marked += bool(node.kind)

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.places[node.name].pop()
            if node.name not in INLINE:
                self.blocks.pop()
            self.marked -= bool(node.kind)

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, name: str) -> None:
        """A closing tag.  That of an inline element does not close the blocks inside it."""
        depth = self.last(name)
        if not depth or name in INLINE and depth < self.blocks[-1]:
            return
        if self.nodes[depth].other == WRAPPER and name != "form":
            self.nodes[depth].other = ELEMENT
        self.cut(depth)

    def close_implied(self, name: str) -> None:
        """What the opening of an element closes: a paragraph, an item, a cell, the head."""
        if self.nodes[-1].name == "head" and name not in HEAD:
            self.cut(len(self.nodes) - 1)
        if name in CLOSES_P and self.last("p") == self.blocks[-1]:
            self.cut(max(self.last("p"), 1))
        if name in CLOSES:
            inner, bounds = CLOSES[name]
            bound = max(self.last(b) for b in bounds)
            depths = []
            for one in inner:
                places = self.places.get(one, [])
                i = bisect.bisect_right(places, bound)
                depths.extend(places[i:i + 1])
            if depths:
                self.cut(min(depths))


def parse(page: str) -> Node:
    """The page's tree without the parts that are no article.  Any text gives a tree."""
    root = Node("body")
    stack, tags, at, start, end = _Stack(root), _Tags(page), 0, 0, len(page)
    # Text not yet in the tree begins at ``start``, and the search for the next tag at ``at``.
    while True:
        at = page.find("<", at)
        if at < 0:
            at = end
            break
        after = -1
        m = _NAME.match(page, at)
        if m:
            after = tags.end(m.end())
        elif page.startswith("<!--", at):
            after = page.find("-->", at + 4) + 3
            after = after if after >= 7 else end
        elif page.startswith("<![CDATA[", at):
            after = page.find("]]>", at + 9) + 3
            after = after if after >= 12 else end
        elif page.startswith(("<!", "<?"), at):
            after = page.find(">", at) + 1 or end
        if after < 0:
            at += 1
            continue
        if at > start:
            stack.nodes[-1].parts.append(page[start:at])
        tag, at, start = at, after, after
        if not m:
            if page.startswith("<![CDATA[", tag):
                text = page[tag + 9:after].removesuffix("]]>")
                stack.nodes[-1].parts.append(text.replace("&", "&amp;"))
            continue
        name, attributes = m[1].lower(), page[m.end():after - 1]
        if page[tag + 1] == "/":
            stack.close(name)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = start = stop.end() if stop else end
            continue
        stack.close_implied(name)
        if name == "body" or name == "html":
            continue
        node = Node(name)
        if name not in VOID:
            _judge(node, attributes, stack.marked > 0)
        stack.nodes[-1].parts.append(node)
        if name not in VOID and not attributes.endswith("/"):
            stack.push(node)
    if at > start:
        stack.nodes[-1].parts.append(page[start:at])
    _prune(root)
    return root


def _below(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, for trees of any depth."""
    out = [root]
    for node in out:
        out.extend(p for p in node.parts if isinstance(p, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Set counts, densities and scores of all nodes."""
    nodes = _below(root)
    for node in reversed(nodes):
        node.chars = node.own
        for part in node.parts:
            if isinstance(part, Node):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.links += part.links
                node.link_tags += part.link_tags + (part.name == "a")
        if node.name == "a":
            node.links = node.chars
    share = root.links / max(root.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        chars, tags = node.chars, max(node.tags, 1)
        links, link_tags = max(node.links, 1), max(node.link_tags, 1)
        plain = max(chars - node.links, 1)
        base = math.log(chars / plain * node.links + share * chars + math.e)
        node.density = max(0.0, chars / tags * math.log(chars / links * tags / link_tags)
                           / math.log(base) if base > 1.0001 else chars / tags)
    for node in nodes:
        node.score = sum(p.density for p in node.parts
                         if isinstance(p, Node) and p.name not in INLINE)
    return nodes


def main_node(root: Node) -> Node:
    """The subtree of the article.  What lies beside it is taken out of the tree."""
    nodes = measure(root)
    parent = {id(p): n for n in nodes for p in n.parts if isinstance(p, Node)}

    def way_of(node: Node) -> list[Node]:
        way = [node]
        while way[-1] is not root:
            way.append(parent[id(way[-1])])
        return way

    # Of equal scores the first, which is the outer one and loses no text.
    way = way_of(max(nodes, key=lambda n: n.score))
    if not any(n.kind for n in way):
        # An article of one block, or one of several, is below the core, not above it.
        open_, marked = [root], []
        for n in open_:
            for p in n.parts:
                if isinstance(p, Node):
                    (marked if p.kind else open_).append(p)
        if 2 * sum(n.chars - n.links for n in marked) > root.chars - root.links:
            way = way_of(max(marked, key=lambda n: n.chars - n.links))
    least = min(n.density for n in way)

    def trim(levels: list[Node], stays) -> None:
        for inner, outer in zip(levels, levels[1:]):
            outer.parts = [p for p in outer.parts if p is inner or stays(p)]

    def no_menu(p) -> bool:
        return (isinstance(p, str) or p.name in INLINE or p.density >= least
                or 2 * p.links <= p.chars)

    articles = [i for i, n in enumerate(way) if n.kind == "article"]
    mains = [i for i, n in enumerate(way) if n.kind == "main"]
    top = mains[-1] if mains else len(way) - 1
    if not articles:
        trim(way[:top + 1], no_menu)
        return way[top]
    best = articles[-1]
    if mains and best < top:
        trim(way[best:top + 1], lambda p: isinstance(p, str) or p.kind or p.name in HEADINGS
             or p.density >= least and 2 * p.links <= p.chars)
        return way[top]
    if mains:
        return way[best]
    titled = any(n.name == "h1" for n in _below(way[best]))
    trim(way[best:], lambda p: isinstance(p, Node) and (
        _holds_article(p) and p.density >= least or p.name == "h1" and not titled))
    return root


def _holds_article(node: Node) -> bool:
    return any(n.kind for n in _below(node))


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order: references decoded, blanks folded."""
    out: list[str] = []
    run: list[str] = []
    work: list = [node]

    def close() -> None:
        text = _BLANKS.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    while work:
        item = work.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        else:
            if item.name == "br":
                run.append(" ")
                continue
            block = item.name not in INLINE
            if block:
                close()
                work.append(None)
            work.extend(reversed(item.parts))
    close()
    return out


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by one space; empty where there is none."""
    root = parse(page)
    return " ".join(blocks_of(main_node(root)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns of ``keep``, text and n_chars (code points) for every page.

    Null or empty html, or a page without text, gives the empty text.  Equal rows stay equal
    rows; other columns are ignored.
    """
    slim = pages.select(F.col(id_col), *keep, F.coalesce(html_col, F.lit("")).alias("__html"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]

    def run(batches):
        for batch in pieces(batches, "__html"):
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])

    return slim.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
