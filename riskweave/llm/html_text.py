"""Main text of web pages by composite text density.

A page is read into a tree of its block elements; inline markup only marks links, and scripts,
styles, controls and hidden elements have no text. For every node of the whole page the density is
its characters per tag, adjusted for links:

    C/T * ln(1 + C/LC * T/LT) / (1 + ln ln(C*LC/(C-LC) + C*LCbody/Cbody + e))

with C characters, T tags, LC characters and LT tags of links below it (zeros count as one; the
published formula takes the logarithm of the first factor to the base of the second, which has a
pole where that base is one, as in text without links: one plus its logarithm stands in). A node's
density sum adds its children's densities, a run of its own text being a child. The node of the
largest sum is the article's core; the least density on its path to the body is the threshold.

Elements, roles, classes and ids that name menus, page headers, footers, sidebars, notices,
adverts, forms or comments are a prior: a node in such an element is the core only if its sum is
``DOUBT`` times that of any other node, or if the page's only article or main element lies there;
comments are never the core beside other text. The core's own path is never left out by a name;
other parts with such a name are. The article is the outermost <article> around the core, else
the outermost <main>, else the smallest node with the core and every block of at least half its
mean plain text; all of it stays. Of what lies beside the article's path stay: text of the path's
own; headings, paragraphs, sections and the like that are not mostly links; the last node with an
<h1> ahead of an article without one; and any node that reaches the threshold.

Defined results: null or empty html, or html without text, gives an empty text; broken markup is
read as far as it goes; <br> ends a block; text outside any tag counts as the body's; repeated
rows are extracted each.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements by how they are read.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img picture source input label meta link base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form button select option svg canvas object audio video map dialog menu fieldset datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
# Words of classes, ids and roles that mark what is not the article.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription pagination pager widget "
    "toolbar login signup search masthead contentinfo complementary copyright skip".split()
)
HEADERS = frozenset({"header", "banner", "masthead"})
#: Elements that hold content by themselves, as <div> does not.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p blockquote pre figure figcaption ul ol dl table section article main details".split())


#: Words of reader comments, which alone mark an <article> or <main>.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Elements that are left out whatever they hold, and those that most of the page's text does not save.
ALWAYS = frozenset("button select option svg canvas object audio video map datalist".split())
PLACES = frozenset("nav footer aside header".split())
#: How an element is marked: its text stays out; by a part of a name inside an article, which only counts
#: for what is mostly links; by its element; by a word; as comments.
HIDDEN, MAYBE, PLACE, WORD, COMMENT = 1, 2, 3, 4, 5
#: How many times the density sum of unnamed text a named part must have to be the article.
DOUBT = 4.0
#: Words behind which, or ahead of which, a part of a name says nothing about its element.
BEHIND, AHEAD = frozenset("has no with without".split()), frozenset("open opened closed free".split())


class Node:
    __slots__ = ("chars", "children", "density", "inside", "link_chars", "link_tags", "links", "mark", "out", "parent", "plain", "runs", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, out: bool, inside: bool):
        self.tag, self.parent, self.out, self.inside = tag, parent, out, inside
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.mark = 0
        self.plain = 0  # characters of own text outside links
        self.links = False  # whether an <a> is open here
        self.children: list[Node] = []
        self.runs: list[int] = []  # characters of each run of own text
        self.density = self.sum = 0.0


def _words(value: str) -> list[set[str]]:
    """Words of each class, id or role that say what an element is, not what it has or allows."""
    out = []
    for name in value.split():
        words = [w.lower() for w in PART.findall(name)]
        if words and words[-1] in AHEAD:
            continue
        stop = next((i for i, w in enumerate(words) if w in BEHIND), len(words))
        out.append(set(words[:stop]))
    return out


def _mark(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element opens something that is not the article, and how that is told; 0 if not."""
    if tag in ALWAYS:
        return HIDDEN
    out = 0
    if tag in NEVER or (tag == "header" and not inside):
        out = PLACE if tag in PLACES else WORD
    if not attributes or tag in ("html", "body"):
        return out
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if tag not in ("article", "main") and (name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value))):
            return HIDDEN
        if name in ("class", "id", "role"):
            names = _words(value)
            words = set().union(*names)
            boiler = BOILER - (HEADERS if inside else frozenset())
            if words & COMMENTS:
                out = COMMENT
            elif tag in ("article", "main"):
                continue
            elif words & boiler or ("header" in words and not inside and tag not in ("h1", "h2", "h3")) or {"side", "bar"} <= words:
                whole = not inside or {"side", "bar"} <= words or any(x and x <= boiler for x in names)
                out = max(out, WORD if whole else MAYBE) if out in (0, MAYBE) else out
    return out


def _core(order: list[Node]) -> Node:
    """The node of the largest density sum, with names as a prior; the outermost of equals."""
    mark: dict[int, int] = {}  # the heaviest mark on the way to a node
    for n in order:
        mark[id(n)] = max(n.mark if n.mark != MAYBE else 0, mark[id(n.parent)] if n.parent is not None else 0)
    named_by = lambda n: n.mark not in (0, MAYBE)
    chars = {id(n): n.chars for n in order}  # characters that no deeper name takes away
    for n in reversed(order):
        if n.parent is not None:
            chars[id(n.parent)] -= n.chars if named_by(n) else n.chars - chars[id(n)]
    # sums without named parts: an unnamed child counts by its share of unnamed text
    value = {id(n): n.sum - sum(c.density * (1 - (0 if named_by(c) else chars[id(c)]) / max(c.chars, 1)) for c in n.children) for n in order}
    best = {m: max((n for n in order if mark[id(n)] == m), key=lambda n: value[id(n)], default=None) for m in (0, PLACE, WORD, COMMENT)}
    free = best[0]
    named = max((best[m] for m in (PLACE, WORD) if best[m] is not None), key=lambda n: value[id(n)], default=None)
    text = lambda n: sum(x.plain for x in _below(n) if mark[id(x)] == mark[id(n)])
    articles = [n for n in order if n.tag in ("article", "main") and n.sum and mark[id(n)] < COMMENT]
    own = [n for n in articles if not mark[id(n)]]
    if articles and not own and text(most := max(articles, key=lambda n: n.sum)) >= text(order[0]):
        return max((n for n in _below(most) if mark[id(n)] == mark[id(most)]), key=lambda n: n.sum)
    if named is not None and not own and value[id(named)] > DOUBT * value[id(free)]:
        return named
    if value[id(free)] > 0 or best[COMMENT] is None:
        return free
    return named if named is not None and value[id(named)] > 0 else best[COMMENT]


def _leave_out(root: Node, core: Node) -> list[Node]:
    """Take named parts that do not hold the core out of the tree; what is left, parents first."""
    path = {id(n) for n in _path(core)}
    order = [root]
    for n in order:
        kept = []
        for c in n.children:
            if c.mark and id(c) not in path and (c.mark != MAYBE or 2 * c.link_chars > c.chars):
                for x in _below(c):
                    x.out = True
            else:
                kept.append(c)
        n.children = kept
        order.extend(kept)
    return order


def parse(page: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The body's tree, and its text in page order as (node, block, raw text)."""
    root = Node("body", None, False, False)
    node, items, block, at, link = root, [], 0, 0, False

    def text(raw: str) -> None:
        nonlocal block
        if not node.out and raw and not raw.isspace():
            items.append((node, block, raw))
            n = sum(map(len, _html.unescape(raw).split())) if "&" in raw else len(raw.strip())
            node.runs.append(n)
            node.chars += n
            if link:
                node.link_chars += n
            else:
                node.plain += n
        elif raw and not node.out:
            items.append((node, block, raw))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = not closing
            if not closing and not node.out:
                node.tags += 1
                node.link_tags += 1
            continue
        if tag == "br" or tag == "hr":
            block += 1
            continue
        if tag in INLINE:
            if closing or tag in VOID or not _mark(tag, m[3] or m[6] or "", True):
                continue
            # an inline element that holds what is no article is read as a block of its own
        if tag in ("html", "body"):
            continue
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up is not root:
                node, link = up.parent, False
                block += tag not in INLINE
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        block += tag not in INLINE
        if node.tag == "p" and tag not in INLINE:
            node, link = node.parent, False
        if tag in CLOSES:
            up = node
            while up is not root and up.tag not in LIMITS[tag]:
                if up.tag in CLOSES[tag]:
                    node, link = up.parent, False
                    break
                up = up.parent
        if tag in VOID or attributes.endswith("/") and tag in ("path", "circle", "rect"):
            continue
        mark = _mark(tag, attributes, node.inside)
        new = Node(tag, node, node.out or mark == HIDDEN, node.inside or tag in ("article", "main"))
        new.mark = mark
        if not new.out:
            node.children.append(new)
        node = new
    if at < len(page):
        text(page[at:])
    return root, items


def _measure(root: Node) -> list[Node]:
    """Totals, densities and sums of all nodes; children after their parents in the result."""
    order = [root]
    for n in order:
        order.extend(n.children)
    for n in reversed(order):
        for c in n.children:
            n.chars += c.chars
            n.tags += c.tags + 1
            n.link_chars += c.link_chars
            n.link_tags += c.link_tags
    share = root.link_chars / max(root.chars, 1)

    def density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
        return chars / max(tags, 1) * math.log(1 + chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)) / (1 + math.log(base))

    for n in order:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags)
    for n in order:
        n.sum = sum(c.density for c in n.children) + sum(density(r, 1, 0, 0) for r in n.runs)
    return order


def _below(node: Node) -> list[Node]:
    """The node and all below it, parents first."""
    out = [node]
    for n in out:
        out.extend(n.children)
    return out


def _path(node: Node) -> list[Node]:
    """The node and all around it, inside out."""
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def _article(order: list[Node], core: Node) -> Node:
    """The node that holds the whole article around its core."""
    path = _path(core)
    for tag in ("article", "main"):
        found = [n for n in path if n.tag == tag]
        if found:
            return found[-1]
    own = [n.plain for n in _below(core) if n.plain]
    least = sum(own) / max(len(own), 1) / 2
    place = {id(n): i for i, n in enumerate(path)}
    most = 0
    for n in order:
        if n.plain >= least > 0:
            while id(n) not in place:
                n = n.parent
            most = max(most, place[id(n)])
    return path[most]


def _chosen(order: list[Node], core: Node) -> tuple[set[int], set[int]]:
    """Nodes that stay with all below them, and nodes of which their own text stays."""
    threshold = min(n.density for n in _path(core))
    article = _article(order, core)
    path = _path(article)
    chosen, title = {id(article)}, None
    titled = any(n.tag == "h1" for n in _below(article))
    for inner, n in zip(path, path[1:], strict=False):
        ahead = True
        for c in n.children:
            if c is inner:
                ahead = False
                continue
            if c.density >= threshold > 0 or c.tag in CONTENT and 2 * c.link_chars <= c.chars:
                chosen.add(id(c))
            elif ahead and not titled and any(x.tag == "h1" and x.chars and 2 * x.link_chars <= x.chars for x in _below(c)):
                title = c
        if title is not None or any(x.tag == "h1" for c in n.children if id(c) in chosen for x in _below(c)):
            titled = True
    return chosen | ({id(title)} if title is not None else set()), {id(n) for n in path[1:]}


def extract(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    root, items = parse(page)
    if not items:
        return ""
    core = _core(_measure(root))
    order = _leave_out(root, core)
    chosen, own = _chosen(order, core)
    kept: dict[int, bool] = {}
    for n in order:
        kept[id(n)] = id(n) in chosen or (n.parent is not None and kept[id(n.parent)])
    out: dict[int, list[str]] = {}
    for n, block, raw in items:
        if not n.out and (kept[id(n)] or id(n) in own):
            out.setdefault(block, []).append(raw)
    lines = (" ".join(_html.unescape("".join(x)).split()) for x in out.values())
    return "\n".join(x for x in lines if x)


def html_text(pages: DataFrame, html_col: str = "html", keep_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(kept columns, text, n_chars) of each page."""
    import pyarrow as pa

    pages = pages.select(*keep_cols, F.col(html_col).cast("string").alias("_html"))
    schema = pages.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            sources = [p or "" for p in batch.column(batch.num_columns - 1).to_pylist()]
            for cut in blocks(sources):
                out = [extract(p) for p in sources[cut]]
                part = batch.slice(cut.start, cut.stop - cut.start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return pages.mapInArrow(run, schema)
