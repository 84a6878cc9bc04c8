"""Labelled pages that the extraction model is trained on.

Pages are made from the layouts below, with words of their own, so the labels are
exact: the element with the article is marked ``data-main="1"``, whatever stands in
it without being part of the text ``data-main="0"``, and a mark holds for all within.
A page has a layout (what holds the article, with which wrappers outside and inside),
a style of article (plain, rich in links, tables, many short blocks, sections) and
some chrome, named or not.  ``without`` leaves layouts out, so that a model can be
tried on layouts that it has not seen.  The same seed gives the same pages.
"""

from __future__ import annotations

import itertools
import random

#: Names that layouts give to what isn't main text, each with its usual tags.
CHROME = {
    "menu": ("nav", "ul", "div"), "navigation": ("nav", "div"), "breadcrumbs": ("nav", "ol", "div"), "header": ("header", "div"), "masthead": ("header", "div"),
    "footer": ("footer", "div"), "copyright": ("div", "p", "footer"), "sidebar": ("aside", "div"), "related": ("aside", "div", "section"), "widget": ("div", "aside"),
    "ad": ("div", "aside", "section"), "advert": ("div", "aside"), "sponsored": ("div", "section"), "promo": ("div", "section"), "banner": ("div", "section"),
    "cookie-notice": ("div", "section"), "notice": ("div", "p"), "consent": ("div", "dialog"), "newsletter": ("form", "div", "section"), "subscribe": ("form", "div"),
    "search": ("form", "div"), "login": ("form", "div"), "share": ("div", "ul"), "social": ("div", "ul"), "comments": ("section", "div", "ol"), "comment": ("div", "li"),
    "reply": ("div", "form"), "popup": ("div", "dialog"), "toolbar": ("div", "menu"), "pagination": ("nav", "div"), "tags": ("ul", "div"),
}
#: How layouts mark the element that holds the article.
ARTICLES = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "main-text"), ("div", "main"), ("div", "text"), ("div", "bodyContent"), ("div", "mainArticle"))
#: Names of wrappers that say nothing about what they hold.
NEUTRAL = ("wrapper", "wrap", "container", "row", "col", "col-8", "page", "layout", "grid", "outer", "inner", "box", "column", "site-wrapper", "has-sidebar", "with-sidebar", "clearfix", "parser-output", "block")
#: What can hold an article.
LAYOUTS = ("marked", "marked_wrapped", "named_inside", "plain", "plain_wrapped", "body", "table", "article_header", "lone")

_SYLLABLES = ("ba", "ko", "ri", "tes", "un", "la", "mor", "en")
WORDS = [*_SYLLABLES, *("".join(p) for n in (2, 3) for p in itertools.product(_SYLLABLES, repeat=n))]


class _Page:
    def __init__(self, rng: random.Random, layouts: tuple[str, ...]):
        self.rng, self.layouts, self.out = rng, layouts, []
        self.links = rng.random() < 0.25  # links in most blocks
        self.split = rng.random() < 0.15  # the article is in sections
        self.sparse = rng.random() < 0.15  # few names in class and id

    def words(self, low: int, high: int) -> str:
        r = self.rng
        text = " ".join(r.choices(WORDS, k=r.randint(low, high)))
        return text.capitalize() + r.choice((".", ".", "", "!"))

    def _names(self, name: str) -> str:
        return self.rng.choice((f' class="{name}"', f' id="{name}"', f' class="x {name}"')) if name else ""

    def _keep(self, tag: str, inner: str) -> None:
        self.out.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or self.rng.random() > 0.2 else f"<p>{inner}")

    def chrome(self, name: str) -> None:
        r = self.rng
        tag = r.choice(CHROME[name])
        names = r.choice((f' class="{name}"', f' id="{name}"', f' class="site-{name} box"', f' class="{name}-box"', "" if tag in ("nav", "header", "footer", "aside", "form") else f' class="{name}"'))
        kind = r.random()
        links = tag in ("ul", "ol", "menu", "nav") or (name in ("share", "social", "tags", "menu", "related") and kind < 0.7)
        if self.sparse and links:
            names = ""
        if tag == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(4, 14)}</p>" if kind < 0.5 else "")
        elif links:
            items = "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(r.randint(2, 12)))
            if tag == "div" and r.random() < 0.4:
                inner = " | ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(2, 9)))
            else:
                inner = items if tag in ("ul", "ol", "menu") else f"<ul>{items}</ul>"
        elif kind < 0.35:
            inner = self.words(3, 18)
        elif kind < 0.7:
            inner = "".join(f"<p>{self.words(4, 40)}</p>" for _ in range(r.randint(1, 3)))
        elif kind < 0.85:
            inner = f"<div><h3>{self.words(1, 4)}</h3><div><p>{self.words(3, 20)}</p></div></div>"
        else:
            inner = f"<h3>{self.words(1, 4)}</h3><p>{self.words(3, 20)} <a href='/x'>{self.words(1, 3)}</a></p>"
        if name in ("header", "masthead") and kind > 0.5:
            inner = f'<div><h1><a href="/">{self.words(1, 3)}</a></h1><p>{self.words(2, 9)}</p></div>'
        if name in ("footer", "copyright") and kind > 0.5:
            inner = f"<p>&copy; {self.words(2, 12)}</p>"
        if name in ("comments", "comment"):
            item = r.choice(('<div class="comment">{}</div>', '<article class="comment">{}</article>', "<div><div>{}</div></div>", '<li class="comment-item">{}</li>'))
            inner = "".join(item.format(f"<b>{self.words(1, 2)}</b>" + "".join(f"<p>{self.words(5, 40)}</p>" for _ in range(r.randint(1, 2)))) for _ in range(r.choice((1, 2, 4, 10))))
        self.out.append(f'<{tag}{names} data-main="0">{inner}</{tag}>')

    def _block(self, shortest: int, longest: int) -> None:
        r = self.rng
        kind, inner = r.random(), self.words(shortest, longest)
        if self.links and r.random() < 0.8:
            inner = " ".join(f'{self.words(2, longest)} <a href="/y">{self.words(1, 5)}</a>' for _ in range(r.randint(1, 4))) + r.choice(("", " " + self.words(1, 12)))
        if kind < 0.6:
            if r.random() < 0.25:
                inner += f' <a href="/y">{self.words(1, 3)}</a> {self.words(2, 9)}'
            if r.random() < 0.2:
                inner = f"<b>{self.words(1, 8)}<br>" if r.random() < 0.4 else f"<em>{self.words(1, 5)}</em> {inner}"
            self._keep("p", inner)
        elif kind < 0.7:
            self._keep(r.choice(("h2", "h3", "h4")), self.words(1, 7))
        elif kind < 0.77:
            self._keep("blockquote", f"<p>{inner}</p>" if r.random() < 0.5 else inner)
        elif kind < 0.84:
            item = (lambda: f'<a href="/z">{self.words(1, 6)}</a>') if self.links and r.random() < 0.4 else lambda: self.words(2, 20)
            self._keep(r.choice(("ul", "ol")), "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 6))))
        elif kind < 0.88:
            cell = (lambda: self.words(1, 25)) if r.random() < 0.3 else lambda: self.words(1, 4)
            rows = "".join(f"<tr><td>{cell()}</td><td>{cell()}</td></tr>" for _ in range(r.choice((2, 3, 4, 15))))
            self._keep("table", f"<tbody>{rows}</tbody>" if r.random() < 0.4 else rows)
        elif kind < 0.91:
            self._keep("pre", inner)
        elif kind < 0.93:
            self._keep("dl", "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.words(2, 20)}</dd>" for _ in range(r.randint(1, 4))))
        elif kind < 0.95:
            self._keep("figure", f'<img src="i"><figcaption>{self.words(2, 12)}</figcaption>')
        else:
            deep = r.choice((1, 1, 2, 3))
            self.out.append("<div>" * deep + (inner if r.random() < 0.5 else f"<p>{inner}</p>") + "</div>" * deep)

    def body(self, title: bool = True) -> None:
        r = self.rng
        if title and r.random() < 0.8:
            self._keep(r.choice(("h1", "h1", "h2")), self.words(2, 9))
        long = r.random() < 0.15  # some articles are many short blocks
        shortest, longest = r.choice(((2, 70), (1, 3), (1, 6), (1, 20))) if long else r.choice(((2, 70), (2, 70), (10, 90), (1, 9), (1, 900)))
        count = r.choice((20, 30, 50, 100, 300)) if long else r.randint(1, 9)
        if r.random() < 0.1:  # one element, lines parted by line breaks
            self.out.append("<br><br>".join(self.words(shortest, longest) for _ in range(count)))
            return
        part = r.choice(("section", "div", 'div class="section"'))
        if self.split:
            self.out.append(f"<{part}>")
        for i in range(count):
            if self.split and i and r.random() < 0.3:
                self.out.append(f"</{part.split()[0]}><{part}>")
            self._block(shortest, longest)
            if r.random() < 0.07:
                self.chrome(r.choice(("ad", "advert", "share", "related", "newsletter", "promo")))
        if self.split:
            self.out.append(f"</{part.split()[0]}>")

    def _article(self, layout: str) -> None:
        """The element with the article, its wrappers inside, and the article."""
        r = self.rng
        tag, name = r.choice(ARTICLES)
        if layout in ("plain", "plain_wrapped", "table", "named_inside"):
            tag, name = ("td" if layout == "table" else "div"), r.choice(("", "", *NEUTRAL))
        inside = r.choice((1, 1, 2, 3, 5, 12, 20)) if layout in ("marked_wrapped", "plain_wrapped") else int(layout == "named_inside")
        mark = ' data-main="1"'
        opens, closes = [f"<{tag}{self._names(name)}{mark}>"], [f"</{tag}>"]
        for i in range(inside):
            within = r.choice(ARTICLES)[1] if layout == "named_inside" and i == inside - 1 else r.choice(("", "", "", r.choice(NEUTRAL), r.choice(ARTICLES)[1] if layout == "marked_wrapped" else ""))
            kind = r.choice(("div", "div", "div", "section"))
            opens.append(f"<{kind}{self._names(within)}>")
            closes.append(f"</{kind}>")
        if layout == "table":
            beside = f'<td data-main="0"><ul><li><a href="/">{self.words(1, 2)}</a></li></ul></td>' if r.random() < 0.6 else ""
            opens, closes = ["<table><tr>", beside, *opens], ["</tr></table>", *closes]
        self.out.append("".join(opens))
        if layout == "article_header":
            self.out.append(f"<header><h1>{self.words(2, 9)}</h1>" + (f"<p>{self.words(4, 20)}</p>" if r.random() < 0.5 else "") + "</header>")
        self.body(layout != "article_header")
        if r.random() < 0.25:
            self.chrome(r.choice(("share", "tags", "related", "newsletter", "comments")))
        self.out.append("".join(reversed(closes)))

    def page(self) -> str:
        r = self.rng
        layout = r.choice(self.layouts)
        self.out = [f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"]
        self.out.append('<body data-main="1">' if layout == "body" else "<body>")
        around = layout != "lone"
        if around and r.random() < 0.9:
            for name in r.sample(("menu", "navigation", "header", "masthead", "cookie-notice", "notice", "search", "breadcrumbs", "banner", "ad", "login"), r.randint(1, 4)):
                self.chrome(name)
        outside = [] if layout == "body" else [f"<{r.choice(('div', 'div', 'div', 'section'))}{self._names(r.choice(('', *NEUTRAL, 'content')))}>" for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6)))]
        for tag in outside:
            self.out.append(tag)
            if around and r.random() < 0.2:
                self.chrome(r.choice(("sidebar", "breadcrumbs", "menu", "ad")))
        if layout == "body":
            self.body()
        else:
            self._article(layout)
        if around:
            for _ in range(r.choice((0, 0, 1, 2)) if outside else 0):
                self.chrome(r.choice(("sidebar", "related", "comments", "comments", "widget")))
        self.out.append("".join(f"</{t[1:].split()[0].rstrip('>')}>" for t in reversed(outside)))
        if around:
            for name in r.sample(list(CHROME), r.randint(0, 4)):
                self.chrome(name)
            if r.random() < 0.15:
                self.chrome("comments")
            if r.random() < 0.85:
                self.chrome("footer")
        return "".join(self.out) + ("</body></html>" if r.random() < 0.85 else "")


def labelled_pages(n: int, seed: int = 11, without: tuple[str, ...] = ()) -> list[str]:
    """Pages with their labels in ``data-main``."""
    rng = random.Random(seed)
    layouts = tuple(x for x in LAYOUTS if x not in without)
    return [_Page(rng, layouts).page() for _ in range(n)]
