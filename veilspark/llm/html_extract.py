"""Main text of web pages by composite text density.

Each page becomes a small tree. Every node gets its characters, tags, link characters and link tags; its density is
characters per tag, weighed down by the share of links. The densities of a node's children add up to its density sum.
Among nodes that hold blocks, the subtree with the largest sum is the core. The smallest density on the path from body to
the core, on the page as it came, is the threshold: an ancestor of the core joins the article if what it adds is at least
as dense. Parts that markup names as something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
reader comments) are cut off first; no element is taken for the article because of its name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import map_batches

#: Elements that start a block of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video nav aside footer form button select "
    "textarea input dialog menu title xmp noembed noframes".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAME = (
    r"(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscri[a-z]+|"
    r"sidebar|side-bar|related|recommend[a-z]*|share|sharing|social|comments?|disqus|replies|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|login|signup|search|pagination|pager|toolbar|widget|skip-link)"
)
#: Whole classes and ids that mark a part as something else than the article: such names, with words of place and shape.
CUT_NAMES = re.compile(
    rf"(?:(?:site|page|global|main|top|left|right|bottom)[_-])*{NAME}(?:[_-]{NAME})*"
    r"(?:[_-](?:bar|box|list|links?|buttons?|posts?|articles?|items?|form|wrap|wrapper|container|section|area|block|left|right|top|bottom|\d+))*", re.I
)
HEADER_NAMES = re.compile(r"(?:page[_-])?(?:header|masthead)", re.I)
#: A start tag on the left ends an open element on the right, up to the element that holds both.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
HOLDS = frozenset("ul ol dl table select html body td th article section div".split())
NAME_START = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
SPACE = re.compile(r"\s+")

class Node:
    __slots__ = (
        "tag", "parent", "inside", "cut", "main", "in_main", "named", "near", "chars", "tags", "link_chars", "link_tags", "density", "total",
        "blocks", "raw",
    )

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.inside = tag, parent, []
        named = {a.lower(): b or c or d for a, b, c, d in ATTR.findall(attrs)} if attrs.strip() else {}
        role = named.get("role", "").lower()
        self.main = tag in ("article", "main") or role in ("main", "article")
        self.in_main = self.main or parent is not None and parent.in_main
        self.near = self if tag in BLOCK or parent is None else parent.near  # the innermost block around
        names = [x for x in f"{named.get('class', '')} {named.get('id', '')}".split() if CUT_NAMES.fullmatch(x)]
        self.cut = tag in CUT or role in CUT_ROLES or "hidden" in named
        self.named = bool(names) and tag not in ("html", "body")
        if tag == "header" or self.named and all(map(HEADER_NAMES.fullmatch, names)):  # of the page, not of an article
            outside = parent is None or not parent.in_main
            self.cut = outside if tag == "header" else self.cut
            self.named = self.named and outside


def tags(source: str):
    """(start, end, name, closing, attributes) of what stands in angle brackets; name is empty for comments and the like.

    Time is linear on broken pages too: a quote or bracket that is never closed is looked for once, from the page's end.
    """
    last = {c: source.rfind(c) for c in "\"'>"}
    at = yield_from = 0
    while (at := source.find("<", yield_from)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(source)
            yield_from = (yield at, end, "", False, "") or end
            continue
        if last[">"] < at:
            return
        if source.startswith(("<!", "<?"), at):
            end = source.index(">", at) + 1
            yield_from = (yield at, end, "", False, "") or end
            continue
        closing = source.startswith("/", at + 1)
        name = NAME_START.match(source, at + 1 + closing)
        if not name:
            yield_from = at + 1
            continue
        end = name.end()
        while (stop := STOP.search(source, end)) and stop[0] != ">":
            closed = last[stop[0]] > stop.start()
            end = source.index(stop[0], stop.end()) + 1 if closed else stop.end()
        end = stop.end() if stop else source.index(">", at) + 1
        yield_from = (yield at, end, name[0].lower(), closing, source[name.end() : end - 1]) or end


def parse(source: str) -> Node:
    """A tolerant tree: missing end tags are implied, stray ones ignored."""
    root = at = Node("html", None)
    open_tags: Counter[str] = Counter()
    place = 0

    def leave(node: Node) -> Node:
        """The parent of an open node; all that is open in it is closed."""
        nonlocal at
        while True:
            open_tags[at.tag] -= 1
            at, gone = at.parent, at
            if gone is node:
                return at

    scan, skip = tags(source), None
    while True:
        try:
            start, end, tag, closing, attrs = scan.send(skip) if skip else next(scan)
        except StopIteration:
            break
        skip = None
        if text := source[place:start]:
            at.inside.append(html.unescape(text))
        place = end
        if not tag or tag == "html" and at is root:
            continue
        if closing:
            if open_tags[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if tag in BLOCK and at.near.tag == "p" and at.near is not root:  # a block ends an open paragraph
            leave(at.near)
        if tag in ENDS and any(open_tags[x] for x in ENDS[tag]):
            up = at if at.tag in ENDS[tag] else at.near
            while up.tag not in ENDS[tag] and up.tag not in HOLDS and up.parent is not None:
                up = up.parent.near
            while up.tag in ENDS[tag]:
                up = leave(up)
        node = Node(tag, at, attrs)
        at.inside.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, place)
            place = skip = close.end() if close else len(source)
            continue
        at = node
        open_tags[tag] += 1
    if text := source[place:]:
        at.inside.append(html.unescape(text))
    return root


def _walk(root: Node, whole: bool = False) -> list[Node]:
    """Nodes that stay, or all of them, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.inside) if isinstance(x, Node) and (whole or not x.cut))
    return out


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, weighed down by links; ``share`` is the page's share of link characters."""
    c, t, lc, lt = chars, max(1, tags), link_chars, max(1, link_tags)
    base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))
    if base <= 0 or not c:
        return c / t
    return c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt)) / base)


def measure(root: Node, whole: bool = False) -> tuple[list[Node], float]:
    """Nodes with their counts, densities and density sums, and the share of link characters in the body."""
    nodes = _walk(root, whole)
    for n in nodes:
        n.chars = sum(len(SPACE.sub(" ", x).strip()) for x in n.inside if isinstance(x, str))
        n.tags = n.link_chars = n.link_tags = n.blocks = 0
        n.density = n.total = 0.0
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
            p.blocks += n.tag in BLOCK
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, share)
        if n.parent is not None:
            n.parent.total += n.density
    return nodes, share


def cut_named(root: Node) -> None:
    """Cuts the named parts off, unless they hold the page's article.

    If the page marks an article or main part outside of them, it is trusted. Otherwise parts stay that are or hold such
    an element, the core, or most of the page's characters outside links.
    """
    nodes = _walk(root)
    if not any(n.named for n in nodes):
        return
    measure(root)
    inside: dict[int, bool] = {}
    for n in nodes:
        inside[id(n)] = n.named or n.parent is not None and inside[id(n.parent)]
    keep = set()
    if not any(n.main and n.chars > n.link_chars and not inside[id(n)] for n in nodes):
        most = max((n.chars - n.link_chars for n in nodes if n.parent is None), default=0) / 2
        held = [n for n in nodes if n.main and n.chars > n.link_chars]
        core = max((n for n in nodes if n.blocks), key=lambda n: n.total, default=None)
        for n in (*held, *([core] if core is not None else [])):
            while n is not None and id(n) not in keep:
                keep.add(id(n))
                n = n.parent
        keep.update(id(n) for n in nodes if n.chars - n.link_chars > most)
    for n in nodes:
        n.cut = n.cut or n.named and id(n) not in keep


def choose(root: Node) -> Node:
    """The root of the article: the core, and those of its ancestors below body that add text as dense as the threshold.

    Headings beside the core are the article's; a page without body counts as a body.
    """
    for n in measure(root, whole=True)[0]:
        n.raw = n.density
    cut_named(root)
    nodes, share = measure(root)
    top = max((n for n in nodes if n.blocks), key=lambda n: n.total, default=root)
    path, n = [], top
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(n.raw for n in path if n.tag != "html" or n is top)
    for n, up in zip(path, path[1:]):
        if up.tag in ("html", "body"):
            break
        aside = [x for x in up.inside if isinstance(x, Node) and not x.cut and x is not n and x.tag in HEADINGS]
        chars = up.chars - n.chars - sum(x.chars for x in aside)
        tags = up.tags - n.tags - 1 - sum(x.tags + 1 for x in aside)
        if chars and composite(chars, tags, up.link_chars - n.link_chars, up.link_tags - n.link_tags, share) < threshold:
            break
        top = up
    return top


def article_text(source: str | None) -> str:
    """Blocks of the article in page order, joined by line feeds; empty if there is none."""
    if not source:
        return ""
    top = choose(parse(source))
    blocks: list[list[str]] = [[]]
    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif not x.cut:
            inside = x.inside[::-1]
            todo += [None, *inside, None] if x.tag in BLOCK else inside
            if x.tag in BLOCK:
                blocks.append([])
    return "\n".join(t for b in blocks if (t := SPACE.sub(" ", "".join(b)).strip()))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text), one row for each row of ``pages``; null or empty html gives an empty text.

    Pages are independent of each other: one pass, nothing is shuffled. Repeated rows, and rows without page_id or url,
    are treated like others; whole pages are read, however long or broken, in linear time. An empty table gives no rows;
    other columns are ignored.
    """

    def run(batch: pa.RecordBatch):
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": [article_text(h) for h in batch.column(2).to_pylist()]}

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
