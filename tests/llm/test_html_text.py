import math
import random
import time

import pytest

from lotlight.llm import html_text
from lotlight.llm.html_text import extract, main_text, smoothed, threshold

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p><b>First  words
here.<br><p>Second paragraph with quite some text, &quot;quoted&quot; &#233;.</p><p>Short.</p>
<aside>Side</aside><form><p>Mail me</p></form></article>
<div id="comments"><p>Nice post, I liked this very much and would read more of it.</p></div><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == 'Title & more\nFirst words here.\nSecond paragraph with quite some text, "quoted" é.\nShort.'


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<div>a<p>b", "a\nb"), ("<p>x &am</p>", "x &am"), ("<article><p>in<article><p>deep</article></article>", "in\ndeep"),
    ("<p>Hello <b>bold</b> world again</p>", "Hello bold world again"), ("<p>Second <a href='x'>link</a>, text</p>", "Second link, text"), ("<p>Hello <script>x</script>world</p>", "Hello world"),
    ("<p>one <span class='ad'>buy</span>two</p>", "one two"), ("<p>a<![foo[ b ]]></p>", "a"), ("<p>a <!-- never closed <p>b", "a"), ("<p>a</p><!weird b><p>c", "a\nc"), ("<p><b>x<br><p>y</b> z</p>", "x\ny z"),
    ("<article><p>first</p></article><article><p>teaser two</p></article>", "first\nteaser two"), ("<p>a</p></div></b><p>b</p>", "a\nb")])
def test_defined_cases(html, want):
    assert main_text(html) == want


def test_region_without_article_tag():
    body = "".join(f"<p>Paragraph {i} with a good number of words in it, so that its ratio is high.</p>" for i in range(8))
    page = f"<body><div class='menu'><a>x</a></div><div><a>Home</a> <a>News</a> <a>More</a></div><div><div>{body}<p>End.</p></div></div><div><a>1</a><a>2</a></div></body>"
    lines = main_text(page).split("\n")
    assert len(lines) == 9 and lines[0].startswith("Paragraph 0") and lines[-1] == "End."


def test_cluster_helpers():
    assert smoothed([4.0]) == [4.0] and max(smoothed([0, 0, 9, 0, 0])) < 9
    assert 1 < threshold([1, 1, 1, 9, 9]) < 9 and threshold([3, 3]) == 3


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 1), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in extract(df).collect())
    assert got == [(1, 92, 92), (1, 92, 92), (2, 0, 0)] or all(a == b for _, a, b in got)
    assert extract(df.filter("false")).count() == 0


def test_teaser_articles_beside_the_body():
    body = [f"Paragraph {i} of the story with a good number of words in it, so that its ratio is high." for i in range(12)]
    teaser = f"<article><h3><a href='/x'>Another story</a></h3><p>{'One line of the other story that is long enough to count as content. ' * 2}</p></article>"
    links = "".join(f"<li><a>{x}</a></li>" for x in "ABCD")
    page = f"<body><ul>{links}</ul><div class='story'>{''.join(f'<p>{p}</p>' for p in body)}</div><div class='cards'>{teaser}</div></body>"
    assert main_text(page).split("\n") == body


def test_several_articles_that_share_the_content_stay():
    part = "<p>A paragraph with a good number of words in it, so that its ratio is high.</p>" * 4
    page = f"<body><div><a>Home</a></div><div><article>{part}</article><article>{part}</article></div></body>"
    assert len(main_text(page).split("\n")) == 8


def test_an_article_that_holds_the_content_is_whole():
    part = "<p>A paragraph with a good number of words in it, so that its ratio is high.</p>"
    page = f"<body><main><div><p>Before the article.</p></div><article><h1>Title</h1><div>{part * 6}</div><p>Short.</p></article></main></body>"
    lines = main_text(page).split("\n")
    assert lines[0] == "Title" and lines[-1] == "Short." and len(lines) == 8


def test_ratios_decide_on_pages_with_an_article():
    good = "".join(f"<p>Paragraph {i} of the story has a good number of words in it, so its ratio is high.</p>" for i in range(8))
    links = "".join(f"<p><a href='/{i}'>Go</a> <a href='/{i}'>to</a></p>" for i in range(30))
    page = f"<body><article>{links}</article><div>{good}</div></body>"
    assert main_text(page).split("\n")[0].startswith("Paragraph 0")
    other = f"<body><article>{good}</article><div>{links}</div></body>"
    assert len(main_text(other).split("\n")) == 8


def test_broken_pages_never_raise():
    import random

    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div", ">", "<b>", "</b>", "<!--", "-->", "<![x[", "]]>", "<!DOCTYPE", "<?php ", "&#", "&amp", "&#xFFFFFFFF;", "<script>", "</script", "<li>", "</ul>", "text ", "<article>", "</article>", "<", "'", '"', "=", "<td>", "\x00", "<a href='", "<svg/>", "<!", "</", "<textarea>", "<!ELEMENT a [", "<title>"]
    for _ in range(1000):
        assert isinstance(main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))), str)


def test_very_long_page():
    assert main_text("<p>" + "word " * 400_000 + "</p>" + "<div>" * 3000 + "<p>" + "tail " * 50) .count("word") == 400_000


PROSE = "<p>" + "A sentence of the article that goes on for a while. " * 4 + "</p>"


@pytest.mark.parametrize("page", [f'<div class="article with-sidebar">{PROSE * 3}</div>', f'<div class="content-side">{PROSE * 3}</div>', f'<div class="share-price-news">{PROSE * 3}</div>', f'<div id="social-history">{PROSE * 4}</div><div>foot</div>'])
def test_a_name_that_is_a_vote_does_not_cut_the_content(page):
    assert html_text.main_text(page).count("goes on for a while") == 4 * page.count("<p>")


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "cookie-bar", "ad", "nav-main", "widget-social share"])
def test_named_parts_beside_the_content_go(name):
    page = f'<div>{PROSE * 3}</div><div class="{name}"><p>Something that is said beside it.</p></div>'
    assert "beside it" not in html_text.main_text(page) and "goes on" in html_text.main_text(page)


@pytest.mark.parametrize("page", ["<div><p>some text</p>" * 50_000, "<div>" * 50_000 + "x</section>" * 50_000, "<div><u><div>" + "<i>" * 50_000 + "x" + "</u>" * 50_000, "<p><b>x" * 50_000])
def test_deep_and_broken_nesting_takes_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 30


def random_page(rng):
    """Nested divs of link lists, prose and short lines, without any telling name."""
    parts = []
    for _ in range(rng.randint(3, 8)):
        kind = rng.choice(["links", "prose", "short"])
        inner = {"links": "<ul>" + "".join(f'<li><a href="/{i}">go {i}</a></li>' for i in range(rng.randint(4, 14))) + "</ul>", "prose": "".join(f"<p>{'prose words run on here ' * rng.randint(3, 12)}{i}</p>" for i in range(rng.randint(1, 5))), "short": f"<p>line {rng.random():.3f}</p>"}[kind]
        for _ in range(rng.randint(0, 3)):
            inner = f"<div>{inner}</div>"
        parts.append(inner)
    return "<html><body>" + "".join(parts) + "</body></html>"


def brute(page, flat=False):
    """The choice of a region by scanning all lines for every region."""
    parser = html_text.Lines()
    parser.feed(page)
    parser.close()
    parser.line_end()

    def path(r):
        return [0] if r == 0 else [*path(parser.parents[r]), r]

    lines = [(t, tags, path(r)) for t, tags, r in parser.lines]
    raw = [1.0 if flat else len(t) / max(1, tags) for t, tags, _ in lines]
    soft = []
    for i in range(len(raw)):
        near = [(math.exp(-((i - j) ** 2) / (2 * html_text.SIGMA**2)), raw[j]) for j in range(len(raw)) if abs(i - j) <= html_text.RADIUS]
        soft.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    edge = html_text.threshold(soft)
    low, high = [v for v in soft if v < edge], [v for v in soft if v >= edge]
    if low and sum(high) / len(high) < html_text.APART * sum(low) / len(low):
        edge = 0
    held = lambda r: sum(len(t) for (t, _, p), v in zip(lines, soft) if r in p and v >= edge)
    at = 0
    while True:
        inner = sorted({p[p.index(at) + 1] for _, _, p in lines if at in p[:-1]}, key=lambda r: (-held(r), r))
        if not inner or held(inner[0]) < html_text.HELD * held(0):
            return "\n".join(t for t, _, p in lines if at in p)
        at = inner[0]


def test_regions_equal_a_plain_search_and_ratios_decide():
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(300)]
    found = [html_text.main_text(p) for p in pages]
    assert found == [brute(p) for p in pages]
    links = '<div><ul>' + "".join(f'<li><a href="/{i}">a link that leads to page {i}</a></li>' for i in range(40)) + "</ul></div>"
    mixed = [f"<body>{links}<div>{PROSE * n}</div>{links}</body>" for n in range(3, 12)]
    told = [html_text.main_text(p) for p in mixed]
    assert all("a link" not in t for t in told) and sum(a != brute(p, flat=True) for a, p in zip(told, mixed)) > len(mixed) / 2
