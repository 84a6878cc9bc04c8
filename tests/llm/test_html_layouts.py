"""Hand-written page layouts, none of them made by the generator of labelled pages."""

from __future__ import annotations

import time

import pytest

from quillon.llm import html_labelled, html_tree, textops

TEXTS = [
    "The harbour was rebuilt in three stages, and the oldest quay still carries the marks of the first cranes.",
    "Shipping companies moved their offices inland when the river silted up; few of them ever came back.",
    "A survey of the warehouses found that most roofs date from the years after the great fire.",
    "Local historians disagree about the date, but the account books name the spring of that year.",
    "Since then the district has changed hands twice, and every owner has added a floor or a tower.",
    "Visitors can walk along the outer wall at low tide, when the old slipway can be seen for an hour.",
]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in TEXTS)
WANT = " ".join(TEXTS)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Harbour Press. All rights reserved.</p></footer>"
COMMENTS = '<section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I walked there last summer and it was lovely, thank you for writing about it.</p></div><div class="comment"><b>Bob</b><p>The date is wrong, see the other article, which has the right one and the sources.</p></div></section>'


def page(inner: str, before: str = NAV, after: str = FOOT) -> str:
    return f"<!DOCTYPE html><html><head><title>Harbour</title><script>var x='<p>no</p>'</script></head><body>{before}{inner}{after}</body></html>"


def nested(n: int, tag: str = "div") -> str:
    return f"<{tag}>" * n + PARAGRAPHS + f"</{tag}>" * n


TITLE = "<h1>The old harbour</h1>"
LAYOUTS = {
    "flat article": (page(f"<article>{PARAGRAPHS}</article>"), WANT),
    **{f"article and {n} wrappers": (page(f"<article>{nested(n)}</article>"), WANT) for n in (1, 2, 3, 5, 8, 13, 20)},
    "wrapper and column": (page(f'<div class="wrapper"><div class="col">{PARAGRAPHS}</div></div>'), WANT),
    "encyclopedia": (page(f'<div id="bodyContent"><div class="mw-parser-output">{PARAGRAPHS}</div></div>'), WANT),
    "paragraphs in body": (page(PARAGRAPHS), WANT),
    "paragraphs alone": (page(PARAGRAPHS, "", ""), WANT),
    "unnamed divisions": (page(f"<div><div><div>{PARAGRAPHS}</div></div></div>"), WANT),
    "links in every paragraph": (page("<article>" + "".join(f'<p>{t} <a href="/more">Read the whole chapter on this</a></p>' for t in TEXTS) + "</article>"), " ".join(f"{t} Read the whole chapter on this" for t in TEXTS)),
    "blog": (page(f'<div id="page" class="hfeed site"><div id="content" class="site-content"><div class="post hentry">{TITLE}<div class="entry">{PARAGRAPHS}</div><div class="sharedaddy share"><a href="/t">Tweet</a> <a href="/f">Post</a></div></div>{COMMENTS}</div><div id="secondary" class="sidebar"><div class="widget"><h3>Archive</h3><ul><li><a href="/1">January</a></li></ul></div></div></div>'), f"The old harbour {WANT}"),
    "news": (page(f'<main role="main"><div class="grid"><div class="article__body">{TITLE}{"".join(f"<p>{t}</p>" for t in TEXTS[:3])}<aside class="advert"><p>Buy a boat today, with free delivery to your door.</p></aside>{"".join(f"<p>{t}</p>" for t in TEXTS[3:])}</div><aside class="related"><h3>More stories</h3><ul><li><a href="/x">A fire at the mill</a></li><li><a href="/y">New bridge opens</a></li></ul></aside></div></main>'), f"The old harbour {WANT}"),
    "documentation": (page('<div class="document"><div class="documentwrapper"><div class="body" role="main">' + "".join(f'<div class="section"><h2>Part {i}</h2><p>{t}</p></div>' for i, t in enumerate(TEXTS)) + "</div></div></div>"), " ".join(f"Part {i} {t}" for i, t in enumerate(TEXTS))),
    "table layout": (page(f'<table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td>{PARAGRAPHS}</td></tr></table>', "", "<div>&copy; 2001</div>"), WANT),
    "line breaks": (page(f'<div class="content">{"<br><br>".join(TEXTS)}</div>'), WANT),
    "comments longer than the article": (page(f'<article class="post">{TITLE}<p>{TEXTS[0]}</p></article>{COMMENTS}{COMMENTS}'), f"The old harbour {TEXTS[0]}"),
    "cookie notice and newsletter": (page(f'<div class="container"><section class="story">{TITLE}{PARAGRAPHS}</section></div>', f'<div class="cookie-banner"><p>We use cookies to make this site work and to understand how it is used, as our policy says in detail.</p><button>Accept</button></div>{NAV}', f'<div class="newsletter"><p>Sign up for our weekly letter and never miss a story again.</p><form><input name="e"><button>Go</button></form></div>{FOOT}'), f"The old harbour {WANT}"),
    "tables and lists": (page(f'<article><div class="inner">{TITLE}<p>{TEXTS[0]}</p><table><tr><th>Quay</th><th>Built</th></tr><tr><td>North</td><td>1820</td></tr><tr><td>South</td><td>1844</td></tr></table><ul><li>Rope store</li><li>Sail loft</li></ul><p>{TEXTS[1]}</p></div></article>'), f"The old harbour {TEXTS[0]} Quay Built North 1820 South 1844 Rope store Sail loft {TEXTS[1]}"),
    "formulas and objects": (page(f"<article><p>{TEXTS[0]}</p><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object data=a.swf><p>{TEXTS[1]}</p></object></article>"), f"{TEXTS[0]} Here x=2 holds. {TEXTS[1]}"),
    "header inside the article": (page(f'<div class="header"><h1><a href="/">Harbour Press</a></h1><p>News from the coast</p></div><main><article><header>{TITLE}</header>{PARAGRAPHS}</article></main>'), f"The old harbour {WANT}"),
    "menu of bare links": (page(f'<div class="layout"><div class="left"><a href="/a">Fish</a> | <a href="/b">Boats</a> | <a href="/c">Nets</a></div><div class="right">{TITLE}{PARAGRAPHS}</div></div>', ""), f"The old harbour {WANT}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    source, want = LAYOUTS[name]
    assert html_tree.extract(html_tree.train(), [source]) == [want]


def test_layouts_left_out_of_training():
    """For every layout: characters rightly judged on its pages by a model that has not seen it."""
    for layout in html_labelled.LAYOUTS:
        model = html_tree.train(pages=600, without=(layout,))
        right = every = 0
        for source in html_labelled.labelled_pages(60, 5, tuple(x for x in html_labelled.LAYOUTS if x != layout)):
            tree = html_tree.parse(source)
            p, _ = html_tree.marginals(model, html_tree._arrays([tree]))
            for i, text, _ in tree.texts:
                if tree.tag[i] not in html_tree.HIDDEN:
                    every += len(text)
                    right += len(text) * bool((p[i] >= 0.5) == tree.main[i])
        assert right / every > 0.85, (layout, right / every)


@pytest.mark.parametrize("broken", ["<" + "a" * (1 << 20), '<p "' * (1 << 18), '<p a="' * (1 << 18), "<!--" * (1 << 18), "<p title=it's>" * (1 << 16), "<svg " * (1 << 18), "<script><" * (1 << 17), "</p " * (1 << 18), "&#" + "9" * (1 << 20) + ";", "<noscript>" * (1 << 17)])
def test_a_broken_megabyte_takes_seconds(broken):
    start = time.monotonic()
    html_tree.extract(html_tree.train(), [broken])
    assert time.monotonic() - start < 20


def test_quotes_count_only_where_a_value_starts():
    one = html_tree.parse("<p title=it's>x<b a = 'q>r' c>y</b></p><p id=a\"b>z</p><a href=/x/>w")
    assert [t for _, t, _ in one.texts] == ["x", "y", "z", "w"] and [one.tag[i] for i, _, _ in one.texts] == ["p", "b", "p", "a"]
    assert [t for _, t, _ in html_tree.parse("a<!-->b<!-- x --!>c</ d>e").texts] == ["a", "b", "c", "e"]
    assert textops.unescape("&#" + "9" * 5000 + "; &amp;") == "� &"
