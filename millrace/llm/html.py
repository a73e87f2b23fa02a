"""Main text of web pages by composite text density.

The page becomes a tree of elements. For every node, its characters per tag are weighed by how much of
its text, and of the whole body's, is link text (Sun, Song and Liao 2011); a node's density sum is the
sum over its children. The subtree with the largest sum holds the article; the smallest density on its
path up to the body is the threshold that siblings on that path must reach to be kept with it.

Before densities, what isn't article goes: elements whose tag says so, and those one of whose class, id or
role names is made of words for such parts only ("site-header", not "side-effects"). Where all that is marked
up as an article stands inside elements that merely have such a name, the name doesn't count. A form around the
page's content is a wrapper. Formulas are text, drawings are not.

Defined results: null and empty pages, and pages without any text of their own, give an empty text;
broken markup is read as far as it goes (a quote that isn't closed before the next "<" is a character); of
equal density sums the first in page order wins; repeated rows each get their row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Markup: comments, declarations, and tags with attributes whose quoted values may hold ">".
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)

#: Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button select option input label fieldset dialog menu head script style noscript template iframe object embed audio video canvas svg textarea annotation annotation-xml".split())
#: A start tag closes an open element of these (up to a barrier).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that can hold an article, and those that can be a part of it beside others.
INLINE = frozenset("a b i span em strong".split())
WRAPPERS = frozenset("article body center div form html main section table tbody td tr".split())
TEXTS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre ul".split())
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
CLOSES_P = BLOCK - {"body", "html", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Words of names of what is not the article, and words that may stand beside them in a name.
NOISE = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner banners cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendation recommendations widget widgets toolbar pagination pager search login signup skip hidden complementary contentinfo".split())
BESIDE = frozenset("a all and app area article articles bar block body bottom box button buttons col column container content desktop first fixed form global group icons inner item items last left link links list lists main me mobile more my of outer page panel post posts primary reader region right row secondary section side site slot small sticky text the thread title to top tree unit us user wrap wrapper zone".split())
#: Names that say that the element holds the page's content, whatever else it is called.
CONTENT = frozenset("article content entry layout main page post story".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that end the search for an open p, and those that lists and tables are made of.
P_SCOPE = frozenset("p table td th button div article section".split())
ITEMS = frozenset(x for part in (*CLOSES.values(), *BARRIER.values()) for x in part)


class Node:
    """scope, item, block: the nearest node, itself included, of P_SCOPE, ITEMS and BLOCK; inside: in an article."""

    __slots__ = ("tag", "up", "parts", "noise", "own", "chars", "tags", "lchars", "ltags", "density", "sum", "inside", "scope", "item", "block", "depth")

    def __init__(self, tag, up, noise=0):
        self.tag, self.up, self.parts, self.noise = tag, up, [], noise
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.scope = self if tag in P_SCOPE else up and up.scope
        self.item = self if tag in ITEMS else up and up.item
        self.block = self if tag in BLOCK else up and up.block
        self.depth = up.depth + 1 if up else 0


def named(value: str, in_article: bool) -> bool:
    """Whether a class, id or role value names what is not the article."""
    names = value.split()
    if any(x.lower() in CONTENT for x in names):
        return False
    for x in names:
        words = {w.lower() for w in PART.findall(x)}
        found = words & NOISE
        if x.lower() == "side" or found and not (in_article and found == {"header"}) and all(w in NOISE or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def noise(tag: str, attrs: str, in_article: bool) -> int:
    """0 for what may be article; 2 where the element says that it isn't; 1 where only a name says so."""
    if tag in DROPPED or tag == "header" and not in_article:
        return 2
    if not attrs or tag in ("body", "html", "main"):
        return 0
    out = 0
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return 2
        if name in ("class", "id", "role") and named(value, in_article):
            out = 1
    return out


def parse(page: str) -> Node:
    """The tree of the page; scripts, styles and other raw elements are read over. Every step costs what it
    opens or closes: closing tags find their element by a stack a tag."""
    root = Node("html", None)
    here, opened = root, {}
    pos, end = 0, len(page)

    def close(top):
        nonlocal here
        while here is not top.up:
            opened[here.tag].pop()
            here = here.up

    while pos <= end:
        m = MARKUP.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text:
            here.parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        pos = max(m.end(), pos + 1)
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            top = opened.get(tag)
            if top and (tag in BLOCK or top[-1].depth > here.block.depth):  # else it would end a block around it
                close(top[-1])
            elif tag == "p":
                here.parts.append(Node("p", here))
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
                pos = stop.end() if stop else end
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and here.scope is not None and here.scope.tag == "p":
            close(here.scope)
        if tag in CLOSES:
            up = here.item
            while up is not None and up.tag not in CLOSES[tag] and up.tag not in BARRIER[tag]:
                up = up.up and up.up.item
            if up is not None and up.tag in CLOSES[tag]:
                close(up)
                if tag == "tr" and here.tag == "tr" and here.up is not None:
                    close(here)
        node = Node(tag, here, noise(tag, m[3], here.inside or here.tag in ("article", "main")))
        here.parts.append(node)
        if tag not in VOID and (tag in BLOCK | INLINE or not m[3].rstrip().endswith("/")):  # a slash on an element that isn't void has no effect
            opened.setdefault(tag, []).append(node)
            here = node
    return root


def lineage(node):
    while node is not None:
        yield node
        node = node.up


def ordered(root: Node, noisy: bool = False) -> list[Node]:
    """All nodes (without noise, unless asked for), parents before children."""
    out = [root]
    for n in out:
        out += [x for x in n.parts if isinstance(x, Node) and (noisy or not x.noise)]
    return out


def count(nodes: list[Node], noisy: bool = False) -> None:
    """Characters, tags, link characters and link tags of every node; what is noise doesn't count for
    the node that holds it, unless asked for (as it must be first, for the nodes' own text)."""
    for n in reversed(nodes):
        if noisy:
            n.own = sum(len("".join(x.split())) for x in n.parts if x.__class__ is str)
        n.chars, n.tags, n.lchars, n.ltags = n.own, 0, 0, 0
        for x in n.parts:
            if x.__class__ is not str and (noisy or not x.noise):
                n.chars += x.chars
                n.tags += x.tags + 1
                n.lchars += x.lchars
                n.ltags += x.ltags + (x.tag == "a")
        if n.tag == "a":
            n.lchars = n.chars


def measure(nodes: list[Node], share: float) -> None:
    """Composite text density and density sum of every node; share is that of link text in the body.

    Text that stands right in a node counts towards its sum as a child without tags. The logarithm's
    base is 2 at least, as a node without links on a page without any would have base 1.
    """
    for n in nodes:
        tags, ltags, plain = max(n.tags, 1), max(n.ltags, 1), max(n.chars - n.lchars, 1)
        base = max(math.log(n.chars / plain * n.lchars + share * n.chars + math.e), 2.0)
        ratio = n.chars * tags / (max(n.lchars, 1) * ltags)
        n.density = n.chars / tags * math.log(ratio) / math.log(base) if ratio > 1 else 0.0
    for n in nodes:
        n.sum = n.own + sum(x.density for x in n.parts if x.__class__ is not str and not x.noise)


def unwrap(root: Node, nodes: list[Node]) -> None:
    """Takes forms for wrappers that hold the page's content: an article, main or h1 of it, or more than half of the
    text of the page that is no link, in paragraphs. Their fields and buttons go nevertheless."""
    forms = [n for n in nodes if n.tag == "form" and n.noise]
    if not forms:
        return
    content, paragraphs = set(), dict.fromkeys(map(id, forms), 0)
    for n in nodes:
        if n.tag in ("article", "main", "h1", "p"):
            around = [x for x in lineage(n) if x.tag == "form" and x.noise]
            if n.tag != "p":
                if all(x.tag == "form" or x.noise < 2 for x in lineage(n)):
                    content.update(map(id, around))
            else:
                for x in around:
                    paragraphs[id(x)] += n.chars - n.lchars
    for f in forms:
        if id(f) in content or 2 * paragraphs[id(f)] > root.chars - root.lchars:
            f.noise = 0


def unname(root: Node, nodes: list[Node]) -> None:
    """Takes names for nothing where all articles (or, without any, all h1) stand inside what only a name
    marks: the elements around them, then, are no such parts."""
    for kind in (("article", "main"), ("h1",)):
        held = [n for n in nodes if n.tag in kind and not n.noise and all(x.noise < 2 for x in lineage(n))]
        if held:
            break
    if held and all(any(x.noise for x in lineage(n)) for n in held):
        for n in held:
            for x in lineage(n):
                x.noise = 0


def select(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order.

    If the node with the largest density sum lies in an article element, all outermost article elements (or
    the main element around it); else the block that holds it, and siblings along its path to the body
    that reach the path's smallest density. Outside of articles, lists of links are no part, unless they stand
    between two paragraphs.
    """
    everything = ordered(root, True)
    count(everything, True)
    share = root.lchars / root.chars if root.chars else 0.0
    unwrap(root, everything)
    unname(root, everything)
    nodes = ordered(root)
    count(nodes)
    if not root.chars:
        return []
    measure(nodes, share)
    best = max(nodes, key=lambda n: n.sum)
    path = list(lineage(best))
    threshold = min(n.density for n in path)
    outer = [n for n in path if n.tag in ("article", "main")]
    if outer:
        keep = [outer[-1]] if outer[-1].tag == "main" else [n for n in nodes if n.tag == "article" and not n.inside]
    else:
        while best.tag not in WRAPPERS and best.up is not None:
            best = best.up
        keep, node = [best], best
        while node.up is not None:
            keep += [x for x in node.up.parts if isinstance(x, Node) and x is not node and not x.noise and x.tag in WRAPPERS | TEXTS and x.density >= threshold and x.chars > 0]
            node = node.up
    around = {id(n) for n in lineage(best)}
    for n in nodes:
        if n.tag in WRAPPERS | {"ul", "ol"} and not n.inside and n.tag not in ("article", "main") and n.ltags > 2 and n.lchars * 5 >= n.chars * 4 and id(n) not in around and not between(n):
            n.noise = 1
    order = {id(n): i for i, n in enumerate(walk(root))}
    return sorted((n for n in keep if not n.noise), key=lambda n: order[id(n)])


def between(n: Node) -> bool:
    """Whether a list stands between two paragraphs of the element that holds it, as references in a text do."""
    if n.tag not in ("ul", "ol") or n.up is None:
        return False
    beside = [x for x in n.up.parts if x is n or x.__class__ is not str and not x.noise and x.chars]
    at = next(i for i, x in enumerate(beside) if x is n)
    return 0 < at < len(beside) - 1 and all(beside[i].tag in ("p", "blockquote", "pre") for i in (at - 1, at + 1))


def walk(root):
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += [x for x in reversed(n.parts) if isinstance(x, Node)]


def text_of(nodes: list[Node]) -> str:
    """Blocks of the nodes in page order, each with its white space collapsed, joined by one newline."""
    blocks, line = [], []

    def flush():
        got = " ".join("".join(line).split())
        if got:
            blocks.append(got)
        line.clear()

    for top in nodes:
        flush()
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                flush()
            elif not (x.noise and x is not top):
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.parts)
        flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(select(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text, n_chars)."""
    schema = T.StructType([*pages.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
