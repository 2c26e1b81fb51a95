"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import pieces

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold no main text.
_NOISE = frozenset(
    "nav aside footer script style noscript template svg math iframe object embed button select textarea input "
    "dialog menu head title canvas audio video noembed noframes datalist".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that mark parts around the main text, alone, beside each other and the companions below. A
#: name that has other words too, as ``menu-engineering``, makes a part suspect, and its density decides.
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "promoted sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent "
    "gdpr popup modal newsletter recommended recommendations comment comments disqus widget toolbar pagination pager "
    "copyright signup paywall outbrain taboola".split()
)
#: Words that mark such a part in the same way but do not make it suspect: ``share-price`` is text, ``share-bar`` not.
_DOUBTFUL = frozenset(
    "notice notices overlay subscribe subscription share sharing social related reply replies respond login search skip alert".split()
)
_COMPANIONS = frozenset(
    "bar box block button buttons link links list item items icon icons area section wrapper wrap container holder inner outer "
    "post posts article articles story stories page site content main top bottom left right header form panel group "
    "media tools tool field input to us this on follow the more also by you see read stack row col column "
    "user users reader readers author thread count title date meta primary secondary mobile desktop sticky fixed default "
    "large small full new latest js wp".split()
)
#: Words that are no topics of a text: they mark a part whatever stands beside them.
_SURE = frozenset("comments disqus sidebar navbar breadcrumb breadcrumbs adsense outbrain taboola popup modal paywall".split())
_MAIN_NAMES = frozenset("content article main post entry story body text page wrapper container".split())
#: A name that starts so says what a part has or lacks, not what it is.
_ABOUT = frozenset("with has no without non not show hide is".split())
#: Elements of a form that count as tags of it, though they hold no text.
_CONTROLS = frozenset("input select textarea button".split())
#: A suspect part is text from this share of the unlinked characters a tag of the main text found without suspects, and from
#: this many characters a tag on a page that has no other text.
SUSPECT_SHARE, BARE = 0.5, 40.0
#: Beside an article or main part a box is text too from this share of the sum of densities found in it.
BESIDE_SHARE = 0.5
#: Blocks of text.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table".split())
_READER = frozenset("comment comments reply replies related promo sponsored ad advert respond disqus".split())
#: A start tag ends the open elements named here.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}, "tfoot": {"tr", "tbody"},
}
_SCOPE = frozenset("ul ol dl table article main section div body html td th".split())


#: Ends of these elements do not reach beyond the elements named second.
_KEPT_IN, _KEEPERS = frozenset("li p dt dd td th tr".split()), frozenset("article main body table ul ol dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Elements that a start tag may end.
_ENDED = frozenset({"p"}).union(_HEADINGS, *_ENDS.values())


class Node:
    __slots__ = (
        "tag", "attrs", "up", "parts", "chars", "tags", "link_chars", "links", "density", "total", "noise", "sure", "suspect", "block", "keeper", "scope",
    )

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []
        self.noise = self.sure = self.suspect = False
        # The nearest elements, itself included, that ends of inline tags, of kept tags and starts of blocks do not pass.
        self.block = up.block if up is not None and tag in _INLINE else self
        self.keeper = self if up is None or tag in _KEEPERS else up.keeper
        self.scope = self if up is None or tag in _SCOPE else up.scope


class _Open:
    """How many elements of a tag are open, in all and inside the element that a search for them would stop at.

    A walk towards the root then ends where there is nothing left to find, and what it passes is closed: parsing takes
    time in proportion to the page.
    """

    def __init__(self):
        self.all: dict = defaultdict(int)
        self.near: dict = defaultdict(int)

    def _count(self, x: Node, n: int) -> None:
        # As a search from inside sees it, which is where ``x`` itself stops none.
        tag, up, near = x.tag, x.up, self.near
        self.all[tag] += n
        if tag in _INLINE:
            near[id(up.block), tag, 0] += n
        else:
            if tag in _KEPT_IN:
                near[id(up.keeper), tag, 1] += n
            if tag in _ENDED:
                near[id(up.scope), tag, 2] += n

    def add(self, x: Node) -> None:
        self._count(x, 1)

    def up_to(self, x: Node, end: Node) -> Node:
        """Close the elements from ``x`` to below ``end``."""
        while x is not end:
            self._count(x, -1)
            x = x.up
        return end


def parse(page: str) -> Node:
    """A tree of elements; unclosed and stray tags are repaired as far as blocks need it."""
    root = node = Node("html", "", None)
    open_ = _Open()
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            node = open_.up_to(node, _close(node, tag, open_))
            continue
        attrs = m[3] or m[6] or ""
        if tag in ("html", "body"):
            if tag == "body" and attrs:
                root.attrs = root.attrs or ""
            node = open_.up_to(node, _close(node, "head", open_)) if tag == "body" else node
            continue
        if tag not in _INLINE and tag != "br":
            node = open_.up_to(node, _open_block(node, tag, open_))
        child = Node(tag, attrs, node)
        node.parts.append(child)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in _VOID and not attrs.endswith("/"):
            node = child
            open_.add(child)
    return root


def _open_block(node: Node, tag: str, open_: _Open) -> Node:
    """The parent of a new block: an open paragraph ends, as do the elements that ``tag`` ends by itself."""
    ends = _ENDS.get(tag, frozenset())
    ended = {"p", *ends} | (_HEADINGS if tag in ("p", "div", "ul", "ol") else frozenset())
    if ends & _SCOPE:  # cells, which the search passes
        left = sum(open_.all[t] for t in ended)
    else:
        left = sum(open_.near[(id(node.scope), t, 2)] for t in ended)
    x, out = node, node
    while left > 0 and x.up is not None:
        if x.tag in ended:
            out = x.up
            left -= 1
        elif x.tag in _SCOPE:
            break
        x = x.up
    return out


def _close(node: Node, tag: str, open_: _Open) -> Node:
    """The parent of the element that an end tag ends; ``node`` itself where it ends none."""
    if tag in _INLINE:
        found = open_.near[(id(node.block), tag, 0)]
    elif tag in _KEPT_IN:
        found = open_.near[(id(node.keeper), tag, 1)]
    else:
        found = open_.all[tag]
    x = node
    while found > 0 and x.up is not None:
        if x.tag == tag:
            return x.up
        x = x.up
    return node


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(text)} if text.strip() else {}


def _names_noise(parts: list[str]) -> bool | None:
    """Whether the words of one class or id name mark a part around the main text; None if they only may."""
    if not _SURE.isdisjoint(parts):
        return True
    named = not _NOISE_NAMES.isdisjoint(parts)
    if not named and _DOUBTFUL.isdisjoint(parts):
        return False
    if all(p in _NOISE_NAMES or p in _DOUBTFUL or p in _COMPANIONS or p.isdigit() for p in parts):
        return True
    return None if named else False


def _is_noise(node: Node, in_article: bool, has_main: bool) -> bool | None:
    """Whether a node holds no main text by its element, role and names; None where its density has to tell."""
    tag = node.tag
    if tag in _NOISE:
        return True
    if tag == "header":
        return not in_article
    doubt = None if tag == "form" else False
    if not node.attrs or tag == "main":
        return doubt
    a = _attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    names = [[x.lower() for x in _NAME.findall(t)] for t in (a.get("class", "") + " " + a.get("id", "")).split()]
    names = [parts for parts in names if parts and parts[0] not in _ABOUT]
    told = [_names_noise(parts) for parts in names]
    reader = any(n and not _READER.isdisjoint(parts) for n, parts in zip(told, names, strict=True))
    if tag == "article":
        return reader
    main = any(n is False and not _MAIN_NAMES.isdisjoint(parts) for n, parts in zip(told, names, strict=True))
    if any(told):
        return (not has_main and (reader or not main)) or doubt
    page_header = any("header" in parts and _MAIN_NAMES.difference(("page", "main")).isdisjoint(parts) for parts in names)
    if page_header and not in_article and not has_main and tag in ("div", "section", "table"):
        return True
    return None if None in told and not main and not has_main else doubt


def _mark(root: Node) -> list[Node]:
    """Set ``noise`` and ``suspect``; suspects count as noise at first. Returns the suspects outside of other noise.

    From the leaves comes whether a node holds an article or main part, from the root whether it is in one.
    """
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.parts if isinstance(c, Node))
    main = {id(root): False}
    for x in reversed(order):
        main.setdefault(id(x), False)
        if x.up is not None and (x.tag in ("article", "main") and not _is_noise(x, True, False) or main[id(x)]):
            main[id(x.up)] = True
    inside, suspects = {id(root): False}, []
    for x in order:
        if x.up is None:
            continue
        inside[id(x)] = inside[id(x.up)] or x.up.tag in ("article", "main")
        found = x.up.sure or _is_noise(x, inside[id(x)], main[id(x)])
        x.sure, x.suspect = found is True, found is None
        if x.suspect:
            suspects.append(x)
    _settle(order)
    return suspects


def _settle(order: list[Node]) -> None:
    for x in order:
        x.noise = x.sure or x.suspect or x.up is not None and x.up.noise


def _acquit(suspects: list[Node], least: float) -> bool:
    """Clear the suspects with ``least`` unlinked characters a tag or more, inner ones first; whether there are any.

    Each is measured with what it holds but for noise and the suspects in it that are not cleared. The controls of a form
    are tags.
    """
    order, stack, linked = [], [x for x in suspects if not x.up.noise], {}
    while stack:
        x = stack.pop()
        linked[id(x)] = linked.get(id(x.up), False) or x.tag == "a"
        order.append(x)
        stack.extend(c for c in x.parts if isinstance(c, Node) and not c.sure)
    free, tags, cleared = {}, {}, False
    for x in reversed(order):
        held = [c for c in x.parts if isinstance(c, Node) and not c.sure and not c.suspect]
        own = 0 if linked[id(x)] else sum(len(" ".join(t.split())) for t in x.parts if isinstance(t, str))
        controls = sum(isinstance(c, Node) and c.tag in _CONTROLS for c in x.parts)
        free[id(x)] = own + sum(free[id(c)] for c in held)
        tags[id(x)] = controls + sum(tags[id(c)] for c in held)
        if own or controls or len(held) != 1:  # no mere wrapper of one element
            tags[id(x)] += len(held)
        if x.suspect and free[id(x)] >= least * max(tags[id(x)], 1):
            x.suspect, cleared = False, True
    if cleared:
        _settle(order)
    return cleared


def _measure(root: Node) -> list[Node]:
    """Characters, tags and their linked parts of every node that is not noise; nodes before their descendants."""
    order, stack = [], [(root, False)]
    linked = {}
    while stack:
        x, in_link = stack.pop()
        in_link = in_link or x.tag == "a"
        linked[id(x)] = in_link
        order.append(x)
        stack.extend((c, in_link) for c in reversed(x.parts) if isinstance(c, Node) and not c.noise)
    for x in reversed(order):
        own = sum(len(" ".join(t.split())) for t in x.parts if isinstance(t, str))
        kids = [c for c in x.parts if isinstance(c, Node) and not c.noise]
        x.chars = own + sum(c.chars for c in kids)
        x.tags = len(kids) + sum(c.tags for c in kids)
        x.link_chars = x.chars if linked[id(x)] else sum(c.link_chars for c in kids)
        x.links = sum(c.links + (c.tag == "a") for c in kids)
    return order


def _densities(order: list[Node]) -> None:
    """Composite text density: characters for each tag, less where characters and tags are linked."""
    body = order[0]
    body_share = body.link_chars / max(body.chars, 1)
    for x in order:
        if not x.chars:
            x.density = 0.0
            continue
        free = max(x.chars - x.link_chars, 1)
        base = math.log(x.chars / free * x.link_chars + body_share * x.chars + math.e)
        inner = x.chars / max(x.link_chars, 1) * max(x.tags, 1) / max(x.links, 1)
        x.density = x.chars / max(x.tags, 1) * max(math.log(max(inner, 1.0)) / base, 0.0)
    for x in order:
        kids = [c.density for c in x.parts if isinstance(c, Node) and not c.noise and c.tag not in _INLINE and c.tag != "br"]
        x.total = sum(kids) if kids else x.density


def _emit(node: Node, threshold: float, blocks: list[str]) -> None:
    """The text of a subtree by blocks; lists and boxes made of links, below the threshold, are left out."""
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.noise:
            continue
        elif x.tag == "br" or x.tag == "hr":
            flush()
        else:
            if x is not node and x.links >= 3 and x.link_chars > 0.7 * x.chars and x.density < threshold and x.tag not in _INLINE:
                flush()
                continue
            block = x.tag not in _INLINE
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()


def _with_dense_parts(best: Node, threshold: float) -> Node:
    """The body, reduced to the densest subtree, the text beside its path, and what else is dense.

    Inside the boxes around the densest subtree paragraphs, headings, lists and quotations are text of the same article,
    and so is what stands bare; other boxes have to be as dense as ``threshold``, or within an article or main part to
    be less than half links. Directly in the body, among other boxes of the page, only headings before are text, and
    what is as dense, a bare text having its characters for a density. Where an article or main part is around the
    densest subtree, a box beside that part is text only if its densities sum up to a good part of the article's.
    """
    chain = [best]
    while chain[-1].up is not None:
        chain.append(chain[-1].up)
    marked = [i for i, x in enumerate(chain) if x.tag in ("article", "main")]
    last = marked[-1] if marked else -1
    beside = BESIDE_SHARE * max((x.total for x in chain[: last + 1]), default=0.0)
    for i in range(1, len(chain)):
        x, up = chain[i - 1], chain[i]
        within, outermost = i <= last, up.up is None
        before, kept = True, []
        for c in up.parts:
            if c is x:
                before = False
                kept.append(c)
            elif isinstance(c, str):
                if within or not marked and (not outermost or len(" ".join(c.split())) >= threshold):
                    kept.append(c)
            elif c.noise:
                continue
            elif marked and not within:
                if c.tag not in _INLINE and c.density >= threshold and c.total >= beside:
                    kept.append(c)
            elif c.tag in _INLINE or c.tag == "br":
                if not outermost or not c.link_chars and c.chars >= threshold:
                    kept.append(c)
            elif c.density >= threshold or before and c.tag in ("h1", "h2") or not outermost and c.tag in _TEXT:
                kept.append(c)
            elif within and 2 * c.link_chars <= c.chars:
                kept.append(c)
        up.parts = kept
    return chain[-1]


def _densest(root: Node) -> tuple[Node, float]:
    """The subtree of the greatest sum of densities, and the least density on its path to the body."""
    order = _measure(root)
    _densities(order)
    best = max((x for x in order if x.tag not in _INLINE), key=lambda x: x.total)
    threshold, x = best.density, best
    while x is not None:
        threshold = min(threshold, x.density)
        x = x.up
    return best, threshold


def main_text(page: str | None) -> str:
    """The main text of a page, a line for each block; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    suspects = _mark(root)
    best, threshold = _densest(root)
    if suspects:
        free = best.chars - best.link_chars
        if _acquit(suspects, SUSPECT_SHARE * free / max(best.tags, 1) if free else BARE):
            best, threshold = _densest(root)
    blocks: list[str] = []
    _emit(_with_dense_parts(best, threshold), threshold, blocks)
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    Noise elements (menus, headers, footers, sidebars, notices, adverts, scripts, styles, reader comments) are told by
    element, role and names; forms, and parts with names that only may tell so, are text where they are as dense as
    ``SUSPECT_SHARE`` says. Among the rest the subtree of the greatest sum of child densities is the main text, with the
    threshold of the least density on its path to the body, and with it the parts beside that path as
    ``_with_dense_parts`` says: inside an article or main part those of unlinked text, beside it those of a comparable
    sum of densities. Boxes and lists of three links or more that are less dense than the threshold are left out. A
    line break ends a block. A null or empty page, or one without main text, gives an empty text. Character references
    are decoded; white space in a block becomes one blank. Pages that are no valid HTML are repaired, of any depth.
    Repeated rows stay; no rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
