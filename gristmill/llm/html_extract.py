"""Main text of web pages by tree scoring.

A page is read into a tree by a tolerant tokenizer. What never is main text (navigation, forms, scripts, and elements
whose whole name says advert, comment, cookie notice and so on) is cut off. A name of which only a part says so
(``social-security``) cuts nothing; it lowers the points of what is in it. Each paragraph passes points for its length and
commas to its ancestors, less with distance; a container's points are discounted by the share of its text in links. The
best container is kept, with those of its siblings that score like it or are headings or link-free paragraphs.

Null, empty or unreadable html has the text ''. Any markup, however broken or deep, gives a result; nothing recurses, and
the work grows with the length of the page (what an end tag or a new block closes is known without climbing). A very
long page is held by one task as a tree, some ten times its size. Of containers with equal points the first is kept.
Repeated rows get equal answers. An empty table gives an empty result. Columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\s(hidden)(?=[\s/]|$)""", re.I)
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
CUT = frozenset("script style noscript template head title nav aside footer form button select option textarea input label iframe svg canvas object dialog menu audio video map xmp noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_ENDS = BLOCK - {"html", "body"}
#: An open element of these ends where another of the same set begins, up to the given containers.
PEERS = (({"p"}, BLOCK - {"p"}), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"}))
#: Of a tag: the place in PEERS of the set that it ends, beside the open paragraph; and all places that it changes.
ENDS = {t: k for k, (tags, _) in enumerate(PEERS) for t in tags} | {"tr": 3}
CHANGES = {t: [k for k, (tags, stop) in enumerate(PEERS) if t in tags or t in stop] for tags, stop in PEERS for t in tags | stop}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words for parts of a page that aren't its text, and words that only say what kind of part.
APART = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promos promotion promotions banner sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer foot pageheader siteheader masthead alert alerts topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets disclaimer comment comments commentlist respond replies disqus skiplink toolbar pager pagination hidden".split())
KIND = frozenset("area bar block bottom box buttons button container content wrapper wrap inner outer left right top main page site list links link icons items item section slot unit text column col form group head header media row up pop skip post posts article articles story stories to on js the 1 2 3 4 5 6 7 8 9".split())
NAME = re.compile(r"[A-Za-z0-9]+")
#: What the points of a text are multiplied by for each element around it whose name has such a word among others.
LOWERED = 0.5
PAGE_HEADER = re.compile(r"(?:^|\s)(?:site|page|main|top|global)?[_-]?header(?=$|\s)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "score", "size", "linked", "near", "inside", "factor")

    def __init__(self, tag: str, parent, cut: bool = False, factor: float = 1.0) -> None:
        self.tag, self.parent, self.children, self.cut = tag, parent, [], cut
        self.score, self.size, self.linked = 0.0, 0, 0
        # the nearest open element of each set of peers; whether an article is around; the factor of the points
        self.near = parent.near if parent is not None else (None,) * len(PEERS)
        if tag in CHANGES:
            near = list(self.near)
            for k in CHANGES[tag]:
                near[k] = self if tag in PEERS[k][0] else None
            self.near = tuple(near)
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.factor = factor if parent is None else max(parent.factor * factor, 1 / 64)


def _named(value: str) -> tuple[bool, bool]:
    """Of the value of a class or id: whether one of its names says wholly, and whether one says in part, that the element isn't text."""
    whole = part = False
    for name in value.lower().split():
        words = NAME.findall(name)
        said = sum(w in APART for w in words)
        part |= said > 0
        whole |= "".join(words) in APART or said > 0 and all(w in APART or w in KIND for w in words)
    return whole, part


def _unlikely(tag: str, attributes: str, inside: bool) -> tuple[bool, float]:
    """Whether an element is cut off, and by how much its points are lowered; inside: within an article, whose own header is its title."""
    if tag in CUT or tag == "header" and not inside:
        return True, 1.0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, 1.0
    factor = 1.0
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if bare or name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES or name == "style" and HIDDEN.search(value):
            return True, 1.0
        if name in ("class", "id"):
            whole, part = _named(value)
            if whole or not inside and PAGE_HEADER.search(value):
                return True, 1.0
            factor = LOWERED if part else factor
    return False, factor


def tree(page: str) -> Node:
    """The page as a tree of nodes and strings, references decoded."""
    root = now = Node("html", None)
    at, n = 0, len(page)
    find, opened = MARK.search, Counter()
    while at < n:
        m = find(page, at)
        if m is None:
            now.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            now.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag]:
                now = _closed(now, tag, opened)
            elif tag == "p":
                now.children.append(Node("p", now))
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                now = root
                opened.clear()
            continue
        # an open peer, or an open paragraph, ends here, with the inline elements left open in it
        ended = now.near[ENDS[tag]] if tag in ENDS else None
        if ended is None and tag in PARAGRAPH_ENDS:
            ended = now.near[0]
        if ended is not None:
            now = _closed(now, ended, opened)
        attributes = m[3] if m[2] else m[6]
        cut, factor = _unlikely(tag, attributes, now.inside or now.tag in ("article", "main"))
        node = Node(tag, now, now.cut or cut, factor)
        now.children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            now = node
            opened[tag] += 1
    return root


def _closed(now: Node, until, opened: Counter) -> Node:
    """What is open after the nearest element ``until`` (a tag or a node) has been closed with all in it."""
    while True:
        opened[now.tag] -= 1
        if now is until or now.tag == until:
            return now.parent
        now = now.parent


def _walk(root: Node) -> list[Node]:
    """Nodes that aren't cut off, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.cut:
            out.append(node)
            todo.extend(c for c in reversed(node.children) if type(c) is Node)
    return out


def blocks(roots: list[Node]) -> list[tuple[Node, str]]:
    """Texts of blocks in page order, each with its block element."""
    out, words, home = [], [], None

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((home, text))
            words.clear()

    todo = [(0, r) for r in reversed(roots)]
    while todo:
        what, x = todo.pop()
        if what == 2:  # the end of a block
            flush()
            home = x
            continue
        if type(x) is str:
            words.append(x)
            continue
        if x.cut:
            continue
        if x.tag in BLOCK or home is None:
            flush()
            todo.append((2, home))
            home = x
        elif x.tag in ("br", "td", "th"):
            words.append(" ")
        todo.extend((0, c) for c in reversed(x.children))
    flush()
    return out


def best(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    nodes = _walk(root)
    for node, text in blocks([root]):
        points = node.factor * (min(len(text) / 100, 3.0) + text.count(",") + (0.0 if node.tag in HEADING else 1.0))
        up, share = node if node.tag in ("div", "article", "section", "main", "html", "td") else node.parent or node, 1.0
        while up is not None and share > 0.01:
            up.score += points * share
            up, share = up.parent, share / 2
    for node in reversed(nodes):
        for c in node.children:
            if type(c) is str:
                n = len(c.strip())
                node.size += n
                node.linked += n if node.tag == "a" else 0
            elif not c.cut:
                node.size += c.size
                node.linked += c.size if node.tag == "a" else c.linked
        if node.tag == "a":
            node.linked = node.size
    density = lambda x: x.linked / x.size if x.size else 0.0
    worth = lambda x: x.score * (1 - density(x)) * (1.5 if x.tag in ("article", "main") else 1.0)
    top = max(nodes, key=worth)
    if not top.score:
        return []
    while top.parent is not None and top.tag not in BLOCK:
        top = top.parent
    if top.parent is None:
        return [top]
    least = SHARE * worth(top)
    kept = []
    for x in top.parent.children:
        if x is top:
            kept.append(x)
        elif type(x) is Node and not x.cut and x.size:
            same = x.score and worth(x) >= least and density(x) < 0.5
            if same or x.tag in HEADING or x.tag == "p" and (density(x) == 0 or x.size > 80 and density(x) < 0.25):
                kept.append(x)
    return kept


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block."""
    if not page:
        return ""
    return "\n".join(text for _, text in blocks(best(tree(page))))


def _extract(at: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = [extract(p) for p in batch.column(at).to_pylist()]
        columns = [batch.column(k) for k in range(batch.num_columns) if k != at]
        names = [n for k, n in enumerate(batch.schema.names) if k != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """The columns of ``pages`` but the html, ``text`` and ``n_chars``; columns that have these names already are replaced."""
    from pyspark.sql import types as T

    carried = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    narrow = pages.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{page}`").cast("string").alias("__html"))
    at = len(carried)
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return narrow.mapInArrow(lambda b: _extract(at, b), schema)
