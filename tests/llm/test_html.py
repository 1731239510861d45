"""HTML extraction: the given pages against their template, and hand-made pages."""

import html
import random
import re

import pytest

from incidentlens.llm.html_extract import extract, extract_pages, op1_html_extract, parse, score_tree
from conftest import TESTDATA

SF = str(TESTDATA / "sf0.01")


def _template_text(page):
    """The article of the given pages, cut by their fixed layout."""
    inside = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>?", " " if "<br" in b else "", b)).split())))


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op1_html_extract(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        assert r.url == page.url and r.n_chars == len(r.text)
        if "</article>" in page.html:
            assert r.text == _template_text(page.html), r.page_id


ARTICLE = "<p>One, two.</p>\n<p>Three <b>fo</b>ur&nbsp;&amp; five.</p>"
CASES = {
    "plain": f"<html><body><nav><a href=x>Home</a></nav><div id=content>{ARTICLE}</div><footer>&copy; us, and, more, commas, here</footer></body></html>",
    "sidebar": f"<div class='main-column'>{ARTICLE}</div><div class='sidebar'><p>Read, this, that, other, more and more words.</p></div>",
    "notice": f"<div class='cookie-notice'><p>We use cookies, ok, yes, no.</p></div><div>{ARTICLE}</div>",
    "comments": f"<article>{ARTICLE}<section id='comments'><p>First, great, post, indeed, yes.</p></section></article>",
    "form": f"<main>{ARTICLE}<form><p>Sign, up, here</p><input name=a></form></main>",
    "script": f"<div><script>if (a < b) document.write('<p>x</p>')</script><style>p {{}}</style>{ARTICLE}<noscript>none</noscript></div>",
    "comment": f"<div><!-- <p>hidden, text</p> -->{ARTICLE}</div>",
    "siblings": "<body><div><p>One, two.</p></div><p>Three <i>fo</i>ur&#160;&#38; five.</p></body>",
    "unclosed": "<div><p>One,\n\t two.<p>Three <b>four &amp five.",
    "header in article": "<header><h2>Site, name</h2></header><article><header>One, two.</header><p>Three four & five.</p></article>",
    "truncated": "<article><p>One, two.</p><p>Three four &amp; five.</p><a href=\"/x",
    "nested": "<article><div><div><p>One, two.</p></div></div><div><p>Three four &amp; five.</p></div></article><div class=ad>Buy, this, now, please, now</div>",
    "wrapper has-sidebar": f"<div class='layout has-sidebar'><div class=text>{ARTICLE}</div><div class='sidebar'><p>Read, this, too.</p></div></div>",
    "wrapper with-header": f"<div id='page-with-header'>{ARTICLE}</div>",
    "wrapper social-history": f"<div class='social-history'>{ARTICLE}</div>",
    "wrapper form": f"<form action=x><div>{ARTICLE}<input name=a></div></form>",
    "wrapper sidebar-layout": f"<div class='sidebar-layout'><main>{ARTICLE}</main><div class=rail><p>Read, this, that, other, more.</p></div></div>",
    "role last": f"<div class='content-widget' role='main'>{ARTICLE}</div>",
    "role first": f"<div role='main' class='content-widget'>{ARTICLE}</div>",
    "long comments": f"<div class=post>{ARTICLE}</div><div id=comments><article class=comment-body><p>{'So, very, true. ' * 30}</p></article></div>",
    "long sidebar": f"<div class=post>{ARTICLE}</div><div class=sidebar>" + "<p><a href=x>More, and, more, links, here, to, read</a></p>" * 9 + "</div>",
    "notice in wrapper": f"<div class='with-nav'><div class='cookie-notice'><p>We, use, cookies.</p></div><div>{ARTICLE}</div></div>",
    "hidden": f"<div hidden><p>a, b, c, d, e, f</p></div><div><p style='display:none'>no</p>{ARTICLE}</div>",
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    assert extract(CASES[name]) == "One, two. Three four & five."


@pytest.mark.parametrize("page", [
    "<div class='cookie-notice'><p>We use cookies, many, many, many, of them.</p></div>", "<div class=header><h1>Site</h1></div>",
    "<div id=comments><p>First, great, post, indeed, yes.</p></div>", "<form><p>Sign up</p></form>", "<nav class=menu><ul><li>a, b, c, d</ul></nav>",
])
def test_nothing_but_surroundings(page):
    assert extract(page) == ""


def test_article_in_several_places():
    texts = [f"{word}, two, three, four, five, six. " * 4 for word in ("Aaaa", "Bbbb", "Cccc")]
    page = "".join(f"<div class='{name}-theory'><p>{text}</p></div>" for name, text in zip(("social", "form", "search"), texts))
    assert extract(page) == "".join(texts).strip()


def _random_page(rng, depth=0):
    """Nested elements as (name, children); texts are strings."""
    name = rng.choice(["div", "section", "p", "span", "a", "blockquote"])
    if depth > 4 or name in ("p", "a", "span"):
        return name, [" ".join(rng.choice(["word", "and,", "more"]) for _ in range(rng.randrange(1, 60)))]
    return name, [_random_page(rng, depth + 1) for _ in range(rng.randrange(1, 4))]


def _markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(_markup, node[1]))}</{node[0]}>"


def _plain_scores(root):
    """Scores by the rule as it is written, for every element in page order: each asks all paragraphs below it."""
    blocks, containers = {"div", "section", "p", "blockquote"}, {"div", "section"}

    def text(node, inner=True):
        return "".join(c if isinstance(c, str) else text(c, inner) if inner or c[0] not in blocks else "" for c in node[1])

    def size(node):
        return sum(len(c.strip()) if isinstance(c, str) else size(c) for c in node[1])

    def linked(node):
        return size(node) if node[0] == "a" else sum(linked(c) for c in node[1] if not isinstance(c, str))

    def points(node):
        own = " ".join(text(node, False).split()) if node[0] in blocks else ""
        return 1 + own.count(",") + min(len(own) / 100, 3) if own else 0

    def share(level):
        return 1 if level == 0 else 0.5 / 3 ** (level - 1)

    def gathered(node, level=0):
        total = points(node) * share(level if node[0] in containers else level - 1) if level or node[0] in containers else 0
        return total + sum(gathered(c, level + 1) for c in node[1] if not isinstance(c, str))

    def walk(node):
        yield gathered(node) * (1 - linked(node) / max(size(node), 1))
        for c in node[1]:
            if not isinstance(c, str):
                yield from walk(c)

    return list(walk(root))


def test_scores_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        page = "div", [_random_page(rng) for _ in range(3)]
        assert [e.score for e in score_tree(parse(_markup(page)))][1:] == pytest.approx(_plain_scores(page))


def test_edges(spark):
    pages = [
        (1, None, None, "a"), (2, "u", "", "b"), (3, "u", "no markup,  at\nall", "c"), (4, "u", "<p>" * 3000 + "deep", "d"),
        (5, "u", "<div>" * 5000 + "<p>very deep</p>", None), (6, "u", "<table><tr><td>a<td>b<tr><td>c</table>", None),
        (7, "u", "<ul><li><a href=x>only, links</a></ul>", None), (8, "u", "a < b and <3 &lt;p&gt; &#x41;&bogus;", None), (1, None, None, "a"),
        (None, "u", "<p>x</p>", "z"), (9, "u", "<p>" + "word, " * 100_000 + "</p>", None), (10, "u", "<", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == ""
    assert by[3] == "no markup, at all" and by[4] == "deep" and by[5] == "very deep" and by[6] == "a b c"
    assert by[8] == "a < b and <3 <p> A&bogus;" and by[None] == "x" and len(by[9]) == 599_999 and by[10] == "<"
    assert extract_pages(df.limit(0)).count() == 0
