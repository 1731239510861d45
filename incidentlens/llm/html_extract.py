"""HTML extraction by tree scoring.

A page becomes a tree of elements. Elements that are never part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out. Each paragraph-like block passes
points, ``1 + commas + min(characters / 100, 3)``, to its ancestors: all of them to the parent, half to the next, a
third of that per further level; an ancestor's sum is discounted by the share of its text that stands in links. The
element with the highest score is the container. Its siblings stay if they score well against it or are
prose of few links. A container inside an ``article`` or ``main`` element grows to that element, since the markup already names the article.

Names (class, id, role) only raise a doubt; points settle it before the scoring. An element in doubt goes unless it holds most of the
page's points, is not mostly links, and either holds the named article or, for names of places (sidebar, header, form ...), little stands outside
all doubt; for names of kinds (adverts, notices, comments ...) it must hold the named article or the main heading. If nothing
is left, places with more than a few words are let in again; kinds never are.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined in
page order by one space. Defined results: null or empty html, and a page without text, give an empty text; unclosed
elements end with their parent, an unclosed paragraph at the next block; repeated rows are all returned; an empty
table gives an empty result; very long pages are worked on whole, in batches bounded in bytes. Only key, url and html are read. Each page is worked on by itself, in the task that reads it.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import in_batches, read_table

#: Elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset((
    "head script style noscript template nav footer aside iframe object svg math canvas audio video button select "
    "option textarea input label dialog menu map applet noembed noframes"
).split())
BLOCKS = frozenset((
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption"
).split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 div section article main".split())
#: Elements that end an open element of the same kind, and how far up they look for one.
SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that raise a doubt: of kinds of text that no article is, and of places beside one.
KINDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist "
    "disqus respond reply replies discussion share sharing sharebar recommended recommendations hidden screenreader"
).split())
PLACES = frozenset((
    "banner sidebar aside rail nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar header masthead "
    "topbar footer colophon social related widget widgets contentinfo complementary search searchbox form skip"
).split())
#: Words after which a name tells what an element has, not what it is; and names of readers' texts, which doubt even an article element.
HAVING = frozenset("has have with no without hide hides show shows".split())
READERS = frozenset("comment comments commentlist respond reply replies".split())
#: Share of the page's points outside all doubt from which an element named like a place is one.
OUTSIDE = 0.2
#: Points that text in doubt needs in order to be a page's article: those of some short paragraphs.
ENOUGH = 3.0
NAMED = frozenset({"article", "main"})
SIBLING_SHARE = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|$)", re.I)
_PLACE = re.compile("<form|" + "|".join(sorted(PLACES)), re.I)
_SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("name", "parent", "children", "dropped", "named", "doubt", "score", "size", "linked")

    def __init__(self, name: str, parent: Element | None, dropped: bool = False, named: bool = False, doubt: str | None = None):
        self.name, self.parent, self.children = name, parent, []
        self.dropped, self.named, self.doubt = dropped, named, doubt
        self.score, self.size, self.linked = 0.0, 0, 0


def _name_words(value: str) -> set[str]:
    """Words of a class, id or role, without those that tell what an element has."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _SPLIT_NAME.split(name) if w]
        found.update(w for before, w in zip(["", *words], words) if before not in HAVING)
    return found


def _part(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool, str | None]:
    """Whether an element is left out, whether its markup names it the article, and the doubt its names raise; all attributes are looked at."""
    if name in NEVER or (name == "header" and not inside_article):
        return True, False, None
    named, words = name in NAMED, set()
    told = False
    for found in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        key = found.group(1).lower()
        value = next((g for g in found.groups()[1:] if g is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, False, None
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, None
        elif (key == "itemprop" and value.lower() == "articlebody") or (key == "role" and value.lower() in NAMED):
            told = True
        elif key != "itemprop":
            words |= _name_words(value)
    if told or name in ("body", "html"):
        return False, named or told, None
    if named:
        return False, not words & READERS, "kind" if words & READERS else None
    return False, False, "kind" if words & KINDS else "place" if name == "form" or words & PLACES else None


def parse(page: str) -> Element:
    """The tree of a page: children are elements and decoded strings."""
    root = Element("html", None)
    here, at, articles = root, 0, 0
    end = len(page)
    lowered = None
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            here.children.append(references.unescape(page[at:token.start()]))
        at = max(token.end(), at + 1)
        tag = token.group(2)
        if tag is None:
            if page.startswith("<![CDATA[", token.start()):
                here.children.append(page[token.start() + 9:token.end()].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if token.group(1):
            scan = here
            while scan is not None and scan.name != tag:
                scan = scan.parent
            if scan is not None and scan.parent is not None:
                while here is not scan:
                    articles -= here.named
                    here = here.parent
                articles -= here.named
                here = here.parent
            elif tag in ("br", "p"):
                here.children.append(Element(tag, here))
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:
            scan = here
            while scan is not None and (scan.name not in BLOCKS):
                scan = scan.parent
            if scan is not None and scan.name == "p":
                while here is not scan.parent:
                    articles -= here.named
                    here = here.parent
        if tag in SELF_CLOSING:
            closes, bounds = SELF_CLOSING[tag]
            scan = here
            while scan is not None and scan.name not in closes and scan.name not in bounds:
                scan = scan.parent
            if scan is not None and scan.name in closes and scan.parent is not None:
                while here is not scan.parent:
                    articles -= here.named
                    here = here.parent
        dropped, named, doubt = _part(tag, token.group(3), articles > 0)
        element = Element(tag, here, dropped, named, doubt)
        here.children.append(element)
        if tag in VOID or token.group(3).endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            stop = lowered.find(f"</{tag}", at)
            at = end if stop < 0 else (lowered.find(">", stop) + 1 or end)
            continue
        here = element
        articles += named
    if at < end:
        here.children.append(references.unescape(page[at:]))
    return root


def _blocks(element: Element) -> Iterator[str]:
    """Text of the blocks below an element in page order, white space made one space, without empty ones."""
    parts: list[str] = []
    stack: list = [iter(element.children)]
    owners = [element]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if owners.pop().name in BLOCKS and parts:
                if text := " ".join("".join(parts).split()):
                    yield text
                parts = []
        elif isinstance(child, str):
            parts.append(child)
        elif child.dropped:
            continue
        elif child.name in ("br", "hr", "wbr"):
            parts.append("" if child.name == "wbr" else "\n")
        else:
            if child.name in BLOCKS and parts:
                if text := " ".join("".join(parts).split()):
                    yield text
                parts = []
            stack.append(iter(child.children))
            owners.append(child)
    if parts and (text := " ".join("".join(parts).split())):
        yield text


def _own_text(element: Element) -> str:
    """Text of an element outside the blocks in it."""
    parts, stack = [], list(reversed(element.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            parts.append(child)
        elif not child.dropped and child.name not in BLOCKS:
            stack.extend(reversed(child.children))
    return " ".join("".join(parts).split())


def _in_order(root: Element) -> list[Element]:
    """All elements that are not left out, in page order."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(reversed([c for c in element.children if isinstance(c, Element) and not c.dropped]))
    return order


def _measure(order: list[Element]) -> None:
    """Characters of every element, and those of them in links."""
    for element in order:
        element.size = element.linked = 0
    for element in reversed(order):
        element.size += sum(len(c.strip()) for c in element.children if isinstance(c, str))
        if element.name == "a":
            element.linked = element.size
        if element.parent is not None:
            element.parent.size += element.size
            element.parent.linked += element.linked


def _points(element: Element) -> float:
    """Points of one paragraph-like block."""
    text = _own_text(element) if element.name in PARAGRAPHS else ""
    return 1 + text.count(",") + min(len(text) / 100, 3) if text else 0.0


def settle_names(root: Element) -> None:
    """Leaves out the elements whose names raised a doubt that their points do not remove, outer ones first."""
    order = _in_order(root)
    if not any(element.doubt for element in order):
        return
    _measure(order)
    inside: dict[Element, float] = {}
    articles: set[Element] = set()
    headed: set[Element] = set()
    for element in reversed(order):
        inside[element] = inside.get(element, 0.0) + _points(element)
        named, first = element.named or element in articles, element.name == "h1" or element in headed
        if element.parent is not None:
            inside[element.parent] = inside.get(element.parent, 0.0) + inside[element]
            if named and element.doubt != "kind":
                articles.add(element.parent)
            if first and element.doubt != "kind":
                headed.add(element.parent)
    beneath: dict[Element, Element] = {}
    in_doubt: dict[Element, float] = {}
    for element in order:
        beneath[element] = element if element.doubt or element.parent is None else beneath[element.parent]
        in_doubt[element] = inside[element] if element is beneath[element] else 0.0
    for element in order:
        if element.doubt and element.parent is not None:
            in_doubt[beneath[element.parent]] -= inside[element]
    clear, total = in_doubt[root], inside[root]
    for element in order:
        if element.parent is not None and element.parent.dropped:
            element.dropped = True
        elif element.doubt:
            most = inside[element] > 0.5 * total and element.linked < 0.5 * element.size
            if element.doubt == "place":
                fits = element in articles or (clear < OUTSIDE * total and inside[element] >= ENOUGH)
            else:
                fits = element in articles or element in headed
            if most and fits:
                clear += in_doubt[element]
            else:
                element.dropped = True


def score_tree(root: Element) -> list[Element]:
    """All elements in page order, with sizes, linked sizes and scores."""
    order = _in_order(root)
    _measure(order)
    for element in order:
        points = _points(element)
        if not points:
            continue
        above, share, level = (element if element.name in ("div", "section", "article", "main") else element.parent), 1.0, 0
        while above is not None and share > 1e-6:
            above.score += points * share
            level += 1
            share = 0.5 if level == 1 else share / 3
            above = above.parent
    for element in order:
        element.score *= 1 - element.linked / max(element.size, 1)
    return order


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page)
    settle_names(root)
    text = _main_text(root)
    if not text and _PLACE.search(page):
        root = parse(page)
        for element in _in_order(root):
            element.dropped = element.dropped or element.doubt == "kind"
        if sum(map(_points, _in_order(root))) >= ENOUGH:
            text = _main_text(root)
    return text


def _main_text(root: Element) -> str:
    """Text of the best container and the siblings that stay."""
    order = score_tree(root)
    best = max(order, key=lambda e: e.score)
    scan, outer = best, None
    while scan is not None:
        if scan.named:
            outer = scan
        scan = scan.parent
    if outer is not None:
        best = outer
    if best.parent is None:
        return " ".join(_blocks(best))
    kept = []
    for sibling in best.parent.children:
        if sibling is best:
            kept += _blocks(best)
        elif isinstance(sibling, Element) and not sibling.dropped and sibling.size:
            density = sibling.linked / sibling.size
            prose = sibling.name == "p" and density < 0.25
            if prose or sibling.name in ("h1", "h2", "h3") or (sibling.name in BLOCKS and sibling.score > max(3.0, SIBLING_SHARE * best.score) and density < 0.5):
                kept += _blocks(sibling)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) for page in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_key", "_url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, url, main text and its length in code points of every page."""
    kind = pages.schema[key].dataType.simpleString()
    given = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))
    found = in_batches(given, _extract, f"_key {kind}, _url string, text string, n_chars long")
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
