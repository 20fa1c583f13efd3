"""Labelled pages to train the extraction model on: page layouts filled with invented words.

``data-label`` names the label of an element and of all below it: 1 the article, 0 anything else.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka ro mi ten sol var ul den pra tic ema lor bi sto wen hal dri".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", ".", "!", "?", "", " *"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, *choices: str) -> str:
        """A class or an id with one of the names, rarely none."""
        if self.r.random() < 0.05:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(choices)}"'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.word()}</a>'

    def links(self, low: int = 3, high: int = 9) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(low, high))) + "</ul>"

    def boilerplate(self) -> str:
        r = self.r
        kind = r.choice(["nav", "menu", "ad", "ad", "side", "notice", "form", "share", "related", "comments", "comments", "crumbs", "footer", "header", "loose"])
        label = ' data-label="0"'
        if kind == "nav":
            return f"<nav{label}>{self.links()}</nav>"
        if kind == "menu":
            return f"<div{self.name('menu', 'main-menu', 'navbar', 'navigation', 'topnav')}{label}>{self.links()}</div>"
        if kind == "ad":
            inner = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", self.link()])
            tag = r.choice(["div", "div", "section", "aside"])
            return f"<{tag}{self.name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo')}{label}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div"])
            name = self.name("sidebar", "side", "widget", "sidebar-right") if tag == "div" else r.choice(["", ' class="sidebar"'])
            return f"<{tag}{name}{label}><h3>{self.sentence(1, 4)}</h3><p>{self.prose(1, 3)}</p>{self.links(2, 5)}</{tag}>"
        if kind == "notice":
            tag = r.choice(["div", "section", "dialog"])
            return f"<{tag}{self.name('cookie-notice', 'notice', 'consent', 'alert', 'popup', 'gdpr-banner')}{label}><p>{self.prose(1, 2)}</p></{tag}>"
        if kind == "form":
            return f"<form{label}><p>{self.sentence(2, 8)}</p><label>{self.word()}</label><input name=\"q\"></form>"
        if kind == "share":
            return f"<div{self.name('share', 'social', 'share-buttons')}{label}>{self.link()} {self.link()}</div>"
        if kind == "related":
            return f"<section{self.name('related', 'recommended', 'more-stories')}{label}><h2>{self.sentence(1, 4)}</h2>{self.links()}</section>"
        if kind == "comments":
            items = "".join(
                r.choice(["<li>{}</li>", "<div class=\"comment\"><p>{}</p></div>", "<p>{}</p>", "<article class=\"comment\"><p>{}</p></article>"]).format(self.prose())
                for _ in range(r.choice([1, 2, 3, 4, 5, 5, 30]))
            )
            tag = r.choice(["div", "section", "ol"])
            return f"<{tag} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comment-list', 'comments-area', 'replies', 'disqus_thread', 'user-comments'])}\"{label}>{items}</{tag}>"
        if kind == "crumbs":
            return f"<div{self.name('breadcrumb', 'breadcrumbs', 'pagination')}{label}>{self.link()} / {self.link()}</div>"
        if kind == "header":
            return f"<header{label}>{r.choice(['', '<h1>' + self.sentence(1, 3) + '</h1>'])}<p>{self.sentence(1, 5)}</p>{self.links(2, 4)}</header>"
        if kind == "footer":
            inner = r.choice([f"&copy; {self.word()} {self.sentence()}", f"<p>{self.prose(1, 2)}</p>", self.links(2, 5)])
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{self.name('footer', 'site-footer') if tag == 'div' else ''}{label}>{inner}</{tag}>"
        return f"<div{label}>{self.link()} | {self.link()}</div>"

    def terse(self) -> str:
        """A line of a dialogue, a poem or a list of remarks."""
        return f"<p>{self.sentence(1, 4)}</p>"

    def block(self) -> str:
        r = self.r
        kind = r.choice(["p"] * 12 + ["h2", "h2", "h3", "ul", "ol", "quote", "table", "pre", "figure", "open", "div", "dl"])
        if kind == "p":
            return f"<p>{self.prose()}</p>" if r.random() < 0.8 else f"<p>{self.sentence()} {self.link()} {self.prose(1, 2)}</p>"
        if kind in ("h2", "h3"):
            return f"<{kind}>{self.sentence(1, 8)}</{kind}>"
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + f"</{kind}>"
        if kind == "quote":
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == "pre":
            return f"<pre>{self.prose(1, 2)}</pre>"
        if kind == "figure":
            return f"<figure><img src=\"x\"><figcaption>{self.sentence(2, 9)}</figcaption></figure>"
        if kind == "open":
            return f"<p><b>{self.prose(1, 2)}<br>"
        if kind == "dl":
            return f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl>"
        return f"<div>{r.choice([self.prose(), '<p>' + self.prose() + '</p>'])}</div>"

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.sentence(2, 12)}</h1>"
        blocks = [self.block() for _ in range(r.choice([1, 2, 4, 8, 14]))]
        if r.random() < 0.15:
            blocks += [self.terse() for _ in range(r.choice([5, 15, 40]))]
        if r.random() < 0.3:
            blocks.insert(r.randrange(len(blocks) + 1), self.boilerplate())
        body = (title if r.random() < 0.9 else "") + "".join(blocks)
        if r.random() < 0.6:
            name = "" if r.random() < 0.6 else self.name("post", "article", "entry", "story")
            return f'<article{name} data-label="1">{body}</article>'
        tag = r.choice(["div", "div", "main", "section"])
        name = self.name("content", "post-content", "article-body", "entry-content", "story", "main", "post") if tag != "main" else ""
        return f'<{tag}{name} data-label="1">{body}</{tag}>'

    def page(self) -> str:
        r = self.r
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        inside = before + self.article() + after
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = f"<div{self.name('wrapper', 'container', 'page', 'row')}>{inside}</div>"
        if r.random() < 0.2:
            inside = f"<main>{inside}</main>"
        head = f"<head><title>{self.sentence()}</title><style>p{{margin:0}}</style></head>"
        return f'<html data-label="0">{head}<body>{inside}</body></html>'


def pages(n: int, seed: int = 7) -> list[str]:
    own = [_Writer(seed * 100_003 + k).page() for k in range(n)]
    plain = _Writer(seed)
    return own + [f'<div data-label="1">{plain.block()}{plain.block()}</div>' for _ in range(max(1, n // 40))]
