"""Labelled pages from which the extraction weights are learned.

Pages are put together at random, from a seed, of parts as sites have them:
articles in semantic and in plain elements, navigation, page headers and
footers, sidebars, notices, adverts, forms, comments and hidden parts, beside
and inside the main text and within wrappers.  A page is a list of (HTML, main
text?) pieces; their HTML joined is the page.

``heldout`` pages, for measuring, have names of elements that no learned page has.
"""

from __future__ import annotations

import random

Page = list[tuple[str, bool]]

#: Names that sites give to what isn't main text; those of ``_HELD`` are kept for held-out pages.
NAMES = {
    "nav": "nav navigation navbar menu menubar mainmenu breadcrumb breadcrumbs pagination pager tabs toolbar toc",
    "top": "header masthead banner topbar topnav brand",
    "bottom": "footer foot bottombar copyright colophon imprint",
    "side": "sidebar aside rail related recommended trending popular widget widgets teaser teasers mostread",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup subscription paywall",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion promoted banner-ad",
    "comment": "comment comments commentlist disqus replies reply respond discussion feedback",
    "form": "form login search searchbox signin share sharing social",
}
MAIN_NAMES = "article content entry post story main-content article-body post-content entry-content maincontent body-text".split()
PLAIN_NAMES = "wrapper container page row col inner outer box layout site grid".split()
WRAPPERS = ["page with-comments", "header-fixed wrapper", "has-sidebar", "no-sidebar layout", "site menu-open", "wrapper"]
_HELD = {"mainmenu", "toc", "brand", "imprint", "mostread", "widgets", "paywall", "overlay", "promoted", "banner-ad", "discussion", "searchbox"}


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "er", "an", "re", "on", "st", "ue", "io", "ä", "ç", "la", "mo", "пр", "во", "k", "z")) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, n: int, end: str = ".") -> str:
    words = [_word(r) for _ in range(n)]
    words = [w + r.choice((",", ".", " &amp;", "!")) if r.random() < 0.08 else w for w in words]
    return " ".join(words).capitalize() + end


def _links(r: random.Random, low: int = 3, high: int = 8) -> list[str]:
    return [f'<a href="/{_word(r)}">{_prose(r, r.randint(1, 3), "")}</a>' for _ in range(r.randint(low, high))]


def _attribute(r: random.Random, name: str) -> str:
    more = r.random()
    name = f"{name} {r.choice(PLAIN_NAMES)}" if more < 0.2 else f"{r.choice(('site', 'page', 'top', 'left', 'my'))}-{name}" if more < 0.35 else name
    return f'{r.choice(("class", "class", "id"))}="{name}"'


class _Maker:
    def __init__(self, seed: int, heldout: bool):
        self.r, self.heldout = random.Random(seed), heldout

    def name(self, kind: str) -> str:
        names = [n for n in NAMES[kind].split() if self.heldout or n not in _HELD]
        return self.r.choice(names)

    def aside(self, kind: str) -> str:
        """An element that isn't main text."""
        r = self.r
        if kind == "hidden":
            hide = r.choice(("hidden", 'style="display:none"', 'aria-hidden="true"'))
            return f"<div {hide}>{_prose(r, r.randint(3, 20))}</div>"
        attr = _attribute(r, self.name(kind))
        tag = r.choice(("div", "div", "section", "ul" if kind == "nav" else "div"))
        if kind == "nav":
            items = _links(r)
            inner = "".join(f"<li>{x}</li>" for x in items) if tag == "ul" or r.random() < 0.5 else r.choice((" ", " | ", "<br>")).join(items)
            inner = inner if tag == "ul" or not inner.startswith("<li>") else f"<ul>{inner}</ul>"
            return r.choice((f"<nav>{inner}</nav>", f"<nav {attr}>{inner}</nav>", f"<{tag} {attr}>{inner}</{tag}>", f'<div role="navigation">{inner}</div>'))
        if kind == "top":
            inner = f"<h1>{_prose(r, r.randint(1, 4), '')}</h1>" + (f"<p>{_prose(r, r.randint(3, 9))}</p>" if r.random() < 0.5 else "")
            return r.choice((f"<header>{inner}</header>", f"<div {attr}>{inner}</div>", f"<header {attr}>{inner}</header>"))
        if kind == "bottom":
            inner = f"&copy; {_prose(r, r.randint(3, 20))}" + (" ".join(_links(r, 1, 4)) if r.random() < 0.5 else "")
            return r.choice((f"<footer>{inner}</footer>", f"<footer {attr}><p>{inner}</p></footer>", f"<div {attr}>{inner}</div>"))
        if kind == "side":
            inner = f"<h3>{_prose(r, 2, '')}</h3>" + r.choice((f"<p>{_prose(r, r.randint(6, 25))}</p>", "<br>".join(_links(r)), "<ul>" + "".join(f"<li>{x}</li>" for x in _links(r)) + "</ul>"))
            return r.choice((f"<aside>{inner}</aside>", f"<aside {attr}>{inner}</aside>", f"<{tag} {attr}>{inner}</{tag}>"))
        if kind == "notice":
            inner = f"{_prose(r, r.randint(4, 30))}" + (f"<button>{_prose(r, 2, '')}</button>" if r.random() < 0.6 else "")
            return r.choice((f"<div {attr}>{inner}</div>", f"<div {attr}><p>{inner}</p></div>", f"<dialog>{inner}</dialog>"))
        if kind == "advert":
            inner = r.choice((_prose(r, r.randint(4, 30)), f"<p>{_prose(r, r.randint(4, 20))}</p><a href='/buy'>{_prose(r, 3, '')}</a>"))
            return f"<{tag} {attr}>{inner}</{tag}>"
        if kind == "comment":
            said = [f"<b>{_word(r)}</b> <p>{_prose(r, r.randint(3, 40))}</p>" for _ in range(r.randint(1, 6))]
            item = r.choice(("div", "li", "article"))
            items = "".join(f'<{item} class="comment">{x}</{item}>' for x in said) if r.random() < 0.6 else "".join(said)
            items = items if item != "li" or "<li" not in items else f"<ol>{items}</ol>"
            return f"<{tag} {attr}><h3>{_prose(r, 2, '')}</h3>{items}</{tag}>"
        inner = f"<label>{_prose(r, r.randint(1, 5), '')}</label><input><select><option>{_word(r)}<option>{_word(r)}</select><button>{_prose(r, 2, '')}</button>" + (f"<p>{_prose(r, r.randint(4, 12))}</p>" if r.random() < 0.5 else "")
        return r.choice((f"<form action='/x'>{inner}</form>", f"<form {attr}>{inner}</form>", f"<div {attr}>{inner}</div>"))

    def block(self) -> str:
        """A block of main text."""
        r = self.r
        kind = r.random()
        if kind < 0.6:
            text = _prose(r, r.choice((2, 4, 8, 15, 25, 40, 80)))
            if r.random() < 0.3:
                text = f'{text} <a href="/{_word(r)}">{_prose(r, r.randint(1, 4), "")}</a> {_prose(r, r.randint(3, 10))}'
            return r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<div>{text}</div>"))
        if kind < 0.7:
            return f"<h{r.randint(2, 4)}>{_prose(r, r.randint(1, 6), '')}</h2>"
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{_prose(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{_prose(r, r.randint(5, 30))}</blockquote>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{_prose(r, r.randint(1, 4), '')}</td><td>{_prose(r, r.randint(1, 4), '')}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src=x><figcaption>{_prose(r, r.randint(3, 12))}</figcaption></figure>"

    def main(self) -> Page:
        """The main text in its element, with asides inside."""
        r = self.r
        name = r.choice(MAIN_NAMES)
        open_, close = r.choice((
            ("<article>", "</article>"), ("<main>", "</main>"), (f'<article class="{name}">', "</article>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"),
            (f'<section class="{name}">', "</section>"), ("<main><article>", "</article></main>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("", ""),
        ))
        title = f"<h1>{_prose(r, r.randint(1, 9), '')}</h1>"
        out: Page = [(open_, True)]
        if r.random() < 0.7:
            out.append((f"<header>{title}<p>{_prose(r, 4)}</p></header>" if r.random() < 0.25 and open_.startswith("<article") else title, True))
        for _ in range(r.choice((1, 2, 3, 5, 8))):
            out.append((self.block(), True))
            if r.random() < 0.15:
                out.append((self.aside(r.choice(("advert", "side", "form", "notice", "comment", "nav", "hidden"))), False))
        return [*out, (close, True)]

    def page(self) -> Page:
        r = self.r
        out: Page = [("<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body>", False)]
        wrapped = r.random()
        form = wrapped < 0.12
        open_, close = ('<form method="post">', "</form>") if form else (f'<div class="{r.choice(WRAPPERS)}">', "</div>") if wrapped < 0.5 else ("", "")
        out.append((open_, False))
        for kind in ("hidden", "notice", "top", "nav", "advert", "form"):
            if r.random() < (0.6 if kind in ("top", "nav") else 0.25):
                out.append((self.aside(kind), False))
        out += self.main()
        for kind in ("comment", "side", "advert", "form", "notice", "side", "bottom"):
            if r.random() < (0.8 if kind == "bottom" else 0.3):
                out.append((self.aside(kind), False))
        return [*out, (close + "</body></html>", False)]


def labelled(n: int = 400, seed: int = 4, heldout: bool = False) -> list[Page]:
    maker = _Maker(seed + (1_000_003 if heldout else 0), heldout)
    return [maker.page() for _ in range(n)]
