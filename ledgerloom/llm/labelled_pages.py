"""Labelled pages to train the extraction of main text on, written by a grammar from a seed.

A page is an article among the other parts that pages have. Parts come with or without sectioning elements and with or
without telling class names, but seldom without both, as then only their text could tell. The attribute data-main of a
part says whether it is main text; the parser hands it over, features never see it.
"""

from __future__ import annotations

import random

STEMS = "an ar be co da de el en er fa gi ho in ka la li ma mo na no or pa ra re sa si ta te to un va ve wi yo ää éa 分 по".split()
LINE_ENDS = (".", ".", ".", "!", "?", "。", "")

# Class names that pages commonly give their parts.
NAMES = {
    "nav": ["nav", "menu", "navbar", "top-menu", "main-nav", "breadcrumb", "breadcrumbs", "tabs", "pagination", "toc-nav"],
    "header": ["header", "masthead", "site-header", "top-bar", "branding", "banner", "page-head"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon", "foot-links"],
    "side": ["sidebar", "side", "widget", "aside", "related", "related-posts", "recommended", "trending", "popular", "more-stories", "right-col", "teaser"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adbox", "banner-ad", "commercial"],
    "notice": ["cookie-notice", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer"],
    "comments": ["comments", "comment-list", "comment", "discussion", "replies", "responses", "disqus_thread", "reader-comments"],
    "form": ["search", "login", "signup", "contact-form", "search-box", "feedback"],
    "share": ["share", "social", "share-buttons", "tags", "tag-list", "toolbar", "print-mail"],
    "main": ["content", "article", "post", "story", "entry-content", "article-body", "main", "post-body", "text", "page-content", "hentry", "blog-post"],
}


class PageWriter:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        end = self.rng.choice(("", "", "", "", "", "***", "%%%", "&amp;&amp;")) if self.noisy else ""
        return "".join(self.rng.choice(STEMS) for _ in range(self.rng.randint(1, 4))) + end

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 18).capitalize() + self.rng.choice(LINE_ENDS)

    def prose(self, most: int = 7) -> str:
        if self.rng.random() < 0.15:
            return self.words(1, 3).capitalize() + "."
        if self.rng.random() < 0.06:
            return self.rng.choice(("&copy; ", "(c) ", "Copyright ", "All rights reserved. ", "2024 ")) + self.words(1, 8)
        out = " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))
        if self.rng.random() < 0.15:
            out += f' <a href="/{self.rng.randint(1, 99)}">{self.words(1, 4)}</a> {self.sentence()}'
        return self.rng.choice((out, out, f"<b>{out}", f"<em>{self.word()}</em> {out}"))

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(n)]
        return self.rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def part(self, kind: str, tags: str, inner: str, main: int) -> str:
        """A part with a sectioning element, a telling name, or both; with neither only where links show what it is."""
        tag, plain = self.rng.choice(tags.split()), self.rng.choice(("div", "div", "section"))
        name = self.rng.choice(NAMES[kind])
        place = self.rng.choice(("class", "id", "class"))
        named = self.rng.random() < 0.75
        sectioned = tag != "div" and self.rng.random() < 0.6
        if not named and not sectioned and kind not in ("nav", "main"):
            named = True
        extra = self.rng.choice(("", " wide", " col-2", " clearfix"))
        attribute = f' {place}="{name}{extra if place == "class" else ""}"' if named else ""
        return f'<{tag if sectioned else plain}{attribute} data-main="{main}">{inner}</{tag if sectioned else plain}>'

    def boilerplate(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            return self.part("nav", "nav", self.links(r.randint(3, 9)), 0)
        if kind == "header":
            return self.part("header", "header", f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 9)}</p>" + r.choice(("", self.links(4))), 0)
        if kind == "footer":
            note = r.choice(("&copy; ", "© 2024 ", "Copyright ", "")) + self.words(1, 8)
            return self.part("footer", "footer", f"<p>{note}</p>{r.choice(('', self.links(r.randint(2, 8)), '<p>' + self.prose() + '</p>'))}" if r.random() < 0.6 else note, 0)
        if kind == "side":
            return self.part("side", "aside", f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(r.randint(3, 7)), f"<p>{self.prose(3)}</p>", "".join(f"<div><a href='/x'>{self.words(3, 9)}</a><p>{self.sentence()}</p></div>" for _ in range(3)))), 0)
        if kind == "ad":
            return self.part("ad", "div", r.choice((self.sentence(), f"<p>{self.prose(3)}</p>", f"<a href='/buy'>{self.words(2, 6)}</a>", f"<h4>{self.words(1, 5)}</h4><p>{self.sentence()}</p>")), 0)
        if kind == "notice":
            return self.part("notice", "div dialog", f"<p>{self.prose(3)}</p>" + r.choice(("", "<button>ok</button>", f"<a href='/p'>{self.word()}</a>")), 0)
        if kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input><p>{self.sentence()}</p>"
            return f'<form data-main="0">{inner}</form>' if r.random() < 0.7 else self.part("form", "form", inner, 0)
        if kind == "share":
            return self.part("share", "div", self.links(r.randint(2, 5)), 0)
        one = lambda: f"<p>{self.words(1, 2)}</p><p>{self.prose(4)}</p>"
        n = r.randint(1, 5)
        inner = r.choice(("<ol>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ol>", "".join(f"<div class='comment'>{one()}</div>" for _ in range(n)), "".join(f"<article class='comment'>{one()}</article>" for _ in range(n)), "".join(f"<li>{self.prose(3)}</li>" for _ in range(n))))
        return self.part("comments", "div", f"<h3>{self.words(1, 3)}</h3>{inner}", 0)

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            level = r.choice(("h1", "h1", "h2"))
            title = f"<{level}>{self.words(1, 9)}</{level}>"
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 2, 4, 8, 16, 30))):
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{self.prose()}" + r.choice(("</p>", "</p>", "</p>", "<br>")))
            elif kind < 0.79:
                out.append(f"<h2>{self.words(1, 6)}</h2>" if r.random() < 0.7 else f"<h3>{self.words(1, 6)}</h3>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.92:
                out.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<pre>{self.words(4, 20)}</pre>")
            elif kind < 0.96:
                out.append(f"<div>{self.prose()}</div>")
            else:
                out.append(self.boilerplate(r.choice(("ad", "share", "side", "notice"))))
        if r.random() < 0.12:
            out.append(self.boilerplate("comments"))
        if r.random() < 0.1:
            out.append(f'<footer data-main="0">{self.words(1, 6)}</footer>')
        inner = "".join(out)
        if r.random() < 0.25:
            inner = r.choice((f"<div>{inner}</div>", f'<div class="{r.choice(NAMES["main"])}">{inner}</div>'))
        return self.part("main", r.choice(("article", "article", "main", "div")), inner, 1)

    def framed(self) -> str:
        """The article, in half of the pages within a frame that may hold other parts, too."""
        r, whole = self.rng, self.article()
        if r.random() < 0.5:
            return whole
        for kind in ("comments", "side", "share", "ad"):
            if r.random() < 0.3:
                whole += self.boilerplate(kind)
        if r.random() < 0.2:
            whole = self.boilerplate(r.choice(("ad", "notice", "nav", "form"))) + whole
        return r.choice((f"<main>{whole}</main>", f'<div id="{r.choice(("content", "main", "primary", "page-content", "main-col"))}">{whole}</div>', f'<div class="{r.choice(("wrap", "inner", "column", "row"))}">{whole}</div>'))

    def table(self, before: list[str], after: list[str]) -> str:
        """A page laid out as a table, one part to a cell, known by links and lengths alone."""
        cells = [self.links(4) for _ in before[:1]] + [f'<div data-main="1">{"".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(2, 8)))}</div>'] + ["&copy; 1999 " + self.words(1, 4) for _ in after[:1]]
        return "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in cells) + "</table>"

    def bare(self) -> str:
        """An article's blocks with no element around them that tells what they are."""
        r = self.rng
        return "".join(f'<{tag} data-main="1">{self.prose()}</{tag}>' for tag in r.choices(("p", "p", "div", "h1", "section"), k=r.choice((1, 1, 2, 5))))

    def page(self) -> str:
        r = self.rng
        self.noisy = r.random() < 0.3
        if r.random() < 0.08:  # nothing but text
            return r.choice(("", "<html><head><title>x</title></head><body>", "<body>")) + self.bare()
        before = [k for k, p in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("form", 0.2), ("ad", 0.4), ("side", 0.25)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.4), ("side", 0.4), ("ad", 0.2), ("form", 0.2), ("notice", 0.2), ("nav", 0.15)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.85:
            after.append("footer")
        body = "".join(map(self.boilerplate, before)) + self.framed() + "".join(map(self.boilerplate, after))
        if r.random() < 0.04:
            body = self.table(before, after)
        for tag in r.choice(((), (), ("div",), ("div", "div"))):
            body = f'<{tag} class="{r.choice(("wrap", "container", "page", "layout", "row", "site", "main-wrapper", "outer"))}">{body}</{tag}>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


def write_pages(count: int, seed: int) -> list[str]:
    return [PageWriter(seed * 1_000_003 + i).page() for i in range(count)]
