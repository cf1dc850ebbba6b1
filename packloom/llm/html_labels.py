"""Labelled pages to train the extraction model on: page layouts with made-up words and the main part marked.

The main part carries ``data-main``, every piece that is no part of the text ``data-other``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SEED = 20
PAGES = 400

# How layouts name their parts.
MAINS = (
    "article",
    "article",
    'article class="post"',
    "main",
    'div class="content"',
    'div id="main-content"',
    'div class="post-body"',
    'div class="entry-content"',
    'div class="article-body"',
    'section class="story"',
    'div class="text"',
    'div id="article"',
)
MENUS = ("nav", 'div class="menu"', 'nav class="navbar"', 'ul class="nav"', 'div class="breadcrumb"', 'div id="navigation"', 'ul class="social share"')
HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"')
FOOTERS = ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright legal"')
SIDES = ("aside", 'div class="sidebar"', 'aside class="related"', 'div class="widget"', 'div id="sidebar"', 'section class="related-posts"')
NOTICES = ('div class="cookie-notice"', 'div class="notice"', 'div id="consent-banner"', 'div class="banner alert"', 'div class="popup modal"', 'div class="gdpr privacy"', 'div role="dialog"', 'div role="alert"')
ADVERTS = ('div class="ad"', 'div class="advert"', 'div class="ads sponsored"', 'div id="ad-top"', 'div class="promo"', 'aside class="advertisement"', 'section class="sponsor"')
FORMS = ("form", 'form class="search"', 'form id="newsletter"', 'div class="subscribe signup"', 'form class="login"')
COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="replies"', 'div class="discussion responses"')
COMMENT = ('div class="comment"', 'article class="comment"', "li", 'p class="comment"', "p", 'div class="reply"')


def _name(spec: str) -> str:
    return spec.split()[0]


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.chance = lambda p: self.random.random() < p

    def words(self, low: int, high: int) -> str:
        r = self.random
        said = ["".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
        text = " ".join(w + ("." if r.random() < 0.08 else "," if r.random() < 0.08 else "") for w in said)
        return text.capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def prose(self) -> str:
        return self.words(*self.random.choice(((1, 3), (3, 12), (12, 60), (60, 160))))

    def within(self, spec: str, inner: str, mark: str = "") -> str:
        return f"<{spec}{' ' + mark if mark else ''}>{inner}</{_name(spec)}>"

    def links(self, low: int = 2, high: int = 8) -> str:
        items = "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.random.randint(low, high)))
        return f"<ul>{items}</ul>"

    def piece(self) -> str:
        """A part of the page around the main one."""
        r = self.random
        kind = r.randrange(8)
        if kind == 0:
            return self.within(r.choice(MENUS), self.links() if self.chance(0.7) else " | ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(4)))
        if kind == 1:
            return self.within(r.choice(HEADERS), r.choice((f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(3, 9)}</p>", self.words(2, 8))))
        if kind == 2:
            return self.within(r.choice(SIDES), f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(), f"<p>{self.prose()}</p>", f"<div>{self.prose()}</div>")))
        if kind == 3:
            return self.within(r.choice(NOTICES), r.choice((f"<p>{self.words(6, 40)}</p><button>{self.words(1, 2)}</button>", self.words(4, 30), f'{self.words(4, 20)} <a href="/p">{self.words(1, 3)}</a>')))
        if kind == 4:
            return self.within(r.choice(ADVERTS), r.choice((self.words(3, 25), f"<p>{self.words(3, 25)}</p>", f'<a href="/b">{self.words(2, 9)}</a>')))
        if kind == 5:
            fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(r.randint(1, 3)))
            return self.within(r.choice(FORMS), r.choice(("", f"<p>{self.words(3, 15)}</p>", f"<div>{self.words(3, 9)}</div>")) + fields + f"<button>{self.words(1, 2)}</button>")
        if kind == 6:
            spec = r.choice(COMMENT)
            said = "".join(self.within(spec, r.choice((self.prose(), f"<p>{self.prose()}</p>", f"<b>{self.words(1, 2)}</b> {self.prose()}", f"<div>{self.words(1, 3)}</div><p>{self.prose()}</p>"))) for _ in range(r.randint(1, 5)))
            return self.within(r.choice(COMMENTS), r.choice(("", f"<h2>{self.words(1, 3)}</h2>")) + said)
        return self.within(r.choice(FOOTERS), r.choice((f"&copy; x &middot; {self.prose()}", f"<p>{self.words(3, 20)}</p>", self.links(), f"<div>{self.words(3, 12)}</div>")))

    def other(self) -> str:
        return self.piece().replace(">", " data-other>", 1)

    def main(self, mark: str = "") -> str:
        """The main part; ``mark`` goes to each of its elements, for pages that have none around them."""
        r = self.random
        parts = [f"<h1{mark}>{self.words(1, 12)}</h1>"] if self.chance(0.8) else []
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.7:
                parts.append(f"<p{mark}>{self.prose()}</p>")
            elif kind < 0.78:
                parts.append(f"<{(h := r.choice(('h2', 'h3')))}{mark}>{self.words(1, 8)}</{h}><p{mark}>{self.prose()}</p>")
            elif kind < 0.83:
                parts.append(self.within(r.choice(("ul", "ol")), "".join(f"<li>{self.words(1, 25)}</li>" for _ in range(r.randint(2, 6))), mark.strip()))
            elif kind < 0.87:
                parts.append(self.within("blockquote", r.choice((self.prose(), f"<p>{self.prose()}</p>")), mark.strip()))
            elif kind < 0.9:
                parts.append(f"<table{mark}><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                parts.append(f"<div{mark}>{self.prose()}</div>")
            else:
                parts.append(f'<p{mark}>{self.words(2, 20)} <a href="/y">{self.words(1, 4)}</a> {self.words(2, 20)}</p>')
            if self.chance(0.08):
                other = self.within(r.choice((*ADVERTS, *SIDES[1:], *FORMS, *NOTICES[:5])), r.choice((self.words(3, 20), f"<p>{self.words(3, 20)}</p>", self.links())))
                parts.append(other.replace(">", " data-other>", 1))
        return "".join(parts)

    def page(self) -> str:
        r = self.random
        before = "".join(self.other() for _ in range(r.randint(0, 4)))
        after = "".join(self.other() for _ in range(r.randint(0, 4)))
        if self.chance(0.06):
            body = before + self.main(" data-main") + after
        else:
            body = self.within(r.choice(MAINS), self.main(), "data-main")
            if self.chance(0.25):
                body = self.within(r.choice(("main", 'div class="container"', 'div id="page"', "div", 'div class="row"')), r.choice((body, body + self.other(), self.other() + body)))
            body = before + body + after
            if self.chance(0.2):
                body = self.within(r.choice(("div", 'div class="wrapper"', 'div id="page"')), body)
        return f"<html><body>{body}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    writer = _Writer(seed)
    for _ in range(n):
        yield writer.page()
