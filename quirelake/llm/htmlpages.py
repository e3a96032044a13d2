"""Pages made from rules, with the label of every block: what the labeller learns from.

No labelled pages come with the data, so the labeller is trained on pages that are
built here: the article and its surroundings in many layouts, from plain HTML 5
elements to named ``div``s, with unclosed tags and boilerplate inside articles.
The words are random, so the labels follow from structure, lengths and links.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber con der en fi gra hel in ja kon lu men no or per qui ra sen tu un ver wo xa yon zi".split()
#: Names that web pages use for parts of a page (fixed lists).
ARTICLE = ["article", "main", "div class=content", "div id=content", "div id=main", "section class=post", "div class=entry-content", "div class=article-body", "div class=post-body", "div role=main", "div class=story", "section class=text"]
NAVIGATION = ["nav", "div class=nav", "ul class=menu", "div id=navigation", "div class=navbar", "nav class=breadcrumbs", "div class=breadcrumb", "div role=navigation", "ul class=pagination"]
HEADER = ["header", "div class=header", "div id=masthead", "div class=site-header", "div class=top-bar", "div role=banner"]
FOOTER = ["footer", "div class=footer", "div id=footer", "div class=site-info", "div class=copyright", "div role=contentinfo"]
SIDEBAR = ["aside", "div class=sidebar", "div id=secondary", "div class=widget", "aside class=related", "div class=related-posts", "div class=trending"]
NOTICE = ["div class=cookie-notice", "div class=notice", "div id=consent", "div class=banner", "div class=popup", "div role=alert", "div class=gdpr", "div class=modal"]
ADVERT = ["div class=ad", "div class=ads", "div class=advert", "div id=ad-top", "div class=advertisement", "aside class=promo", "div class=sponsored", "ins class=adsbygoogle"]
FORM = ["form", "form class=newsletter", "div class=subscribe", "form id=search", "div class=login"]
COMMENTS = ["section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=disqus", "div class=replies"]
SHARE = ["div class=share", "ul class=social", "div class=tags", "div class=author-bio", "p class=byline", "div class=meta"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return out.capitalize() + self.r.choice([".", ".", "", "!"])

    def text(self) -> str:
        if self.r.random() < 0.2:
            return self.words(1, 3)
        return " ".join(self.words(1, 14) for _ in range(self.r.choice([1, 1, 2, 4, 9])))

    def wrap(self, kind: str, inner: str) -> str:
        tag, _, rest = kind.partition(" ")
        return f"<{tag}{' ' + rest if rest else ''}>{inner}</{tag}>"

    def links(self) -> str:
        n = self.r.randint(2, 8)
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"
        return " ".join(f'<a href="/{i}">{self.words(1, 2)}</a>' for i in range(n))

    def some(self) -> str:
        """Boilerplate text, at times with paragraphs or links."""
        return self.r.choice([lambda: self.text(), lambda: f"<p>{self.text()}</p>", lambda: self.links(), lambda: f"<h3>{self.words(1, 4)}</h3><p>{self.text()}</p>", lambda: f"{self.text()} <a href=#>{self.words(1, 2)}</a>"])()

    def inline(self) -> str:
        t = self.text()
        roll = self.r.random()
        if roll < 0.15:
            return f"<b>{t}"
        if roll < 0.3:
            return f'{t} <a href="/x">{self.words(1, 3)}</a> {self.words(1, 6)}'
        return f"<em>{t}</em>" if roll < 0.35 else t

    def form(self) -> str:
        return f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.text()}</p>" if self.r.random() < 0.5 else "") + ("<select>" + "".join(f"<option>{self.word()}</option>" for _ in range(3)) + "</select>" if self.r.random() < 0.3 else "")

    def comments(self) -> str:
        return "".join(f"<div class=comment><p>{self.text()}</p></div>" if self.r.random() < 0.5 else f"<li>{self.text()}</li>" for _ in range(self.r.randint(1, 5)))

    def article(self) -> str:
        """Blocks of an article; what is in a ``x-no`` element is not part of it."""
        parts = [f"<h1>{self.words(2, 10)}</h1>"] if self.r.random() < 0.85 else []
        if self.r.random() < 0.25:
            parts.append(f"<x-no>{self.wrap(self.r.choice(SHARE), self.some())}</x-no>")
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14, 30])):
            roll = self.r.random()
            if roll < 0.6:
                parts.append(f"<p>{self.inline()}" + ("</p>" if self.r.random() < 0.8 else "<br>"))
            elif roll < 0.68:
                parts.append(f"<h2>{self.words(1, 8)}</h2>")
            elif roll < 0.75:
                parts.append("<ul>" + "".join(f"<li>{self.inline()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif roll < 0.8:
                parts.append(f"<blockquote>{self.text()}</blockquote>")
            elif roll < 0.84:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif roll < 0.88:
                parts.append(f"<div>{self.text()}</div>")
            else:
                kinds = self.r.choice([ADVERT, SHARE, SIDEBAR, FORM])
                parts.append(f"<x-no>{self.wrap(self.r.choice(kinds), self.form() if kinds is FORM else self.some())}</x-no>")
        return "".join(parts)

    def page(self) -> str:
        """HTML of a page; article blocks stand in ``x-yes`` and, inside it, not in ``x-no``."""
        r, before, after = self.r, [], []
        for kinds, chance, where in ((HEADER, 0.5, before), (NAVIGATION, 0.8, before), (NOTICE, 0.3, before), (ADVERT, 0.5, before), (SIDEBAR, 0.25, before), (FORM, 0.15, before), (SHARE, 0.25, after), (COMMENTS, 0.35, after), (SIDEBAR, 0.35, after), (FORM, 0.25, after), (ADVERT, 0.3, after), (NAVIGATION, 0.15, after), (NOTICE, 0.15, after)):
            if r.random() < chance:
                inner = self.links() if kinds is NAVIGATION else self.form() if kinds is FORM else self.comments() if kinds is COMMENTS else f"<h1>{self.words(1, 3)}</h1>" + self.some() if kinds is HEADER and r.random() < 0.3 else self.some()
                where.append(self.wrap(r.choice(kinds), inner))
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.wrap(r.choice(FOOTER), r.choice(["&copy; ", ""]) + self.some()))
        body = f"<x-yes>{self.article()}</x-yes>"
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            body = self.wrap(r.choice(ARTICLE), body)
        if r.random() < 0.3:
            body = self.wrap(r.choice(["div class=container", "div id=page", "div class=wrapper", "div"]), body)
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
