"""Labelled pages to train the HTML model on: made by rule, seeded, each block element labelled by data-y.

data-y="1": content or what may hold content; data-y="0": menus, headers, footers, sidebars, notices, adverts, forms,
reader comments. A label holds for the element alone; the trainer hands 0 down to all below it.
"""

from __future__ import annotations

import random

_SYLLABLES = ("ka", "lo", "min", "ter", "su", "ra", "vel", "po", "da", "ni", "ost", "er", "in", "al", "que", "th", "en", "la")
#: Words that sites use in class and id attributes, for parts that are not the article and for parts that are.
_AD = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor", "adsense", "promotion")
_NOTICE = ("notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "announcement", "warning", "disclaimer", "message")
_SIDE = ("sidebar", "aside", "widget", "related", "recommended", "related-posts", "more-stories", "trending", "popular", "rail", "secondary")
_COMMENT = ("comments", "comment-list", "respond", "discussion", "disqus", "replies", "comment-section", "reader-comments", "responses")
_ONE_COMMENT = ("comment", "reply", "comment-body", "comment-text", "comment-content", "commenter")
_NAV = ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc-menu", "main-menu", "skip-links", "tabs")
_HEAD = ("header", "masthead", "site-header", "topbar", "branding", "logo", "page-header", "hero-banner")
_FOOT = ("footer", "site-footer", "colophon", "copyright", "legal", "foot", "bottom-bar", "imprint")
_FORM = ("search", "newsletter", "subscribe", "signup", "login", "contact-form", "form", "search-form", "newsletter-signup")
_SOCIAL = ("share", "social", "sharing", "social-links", "tags", "tag-list", "meta-links", "toolbar", "author-box", "byline", "post-meta", "meta")
_BODY = ("article", "post", "entry", "content", "entry-content", "post-content", "article-body", "story", "main", "text", "main-content", "body", "post-body", "page-content", "prose", "story-body")
_WRAP = ("wrapper", "container", "page", "row", "col", "layout", "inner", "site", "grid", "wrap", "outer")


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n)]
        marks = [w + self.r.choice(("", "", "", "", "", "", ",", ".")) for w in out]
        return (" ".join(marks).capitalize() + ".") if n > 3 else " ".join(out)

    def prose(self) -> str:
        return self.words(3, 12) if self.r.random() < 0.25 else self.words(10, 90)

    def tag(self, name: str, y: int, inner: str, names: tuple[str, ...] = (), chance: float = 0.9) -> str:
        attr = ""
        if names and self.r.random() < chance:
            attr = f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names)}{self.r.choice(("", "", " x1", " block"))}"'
        return f'<{name}{attr} data-y="{y}">{inner}</{name}>'

    def links(self, y: int = 0) -> str:
        n = self.r.randint(2, 9)
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        if self.r.random() < 0.6:
            return f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}">{x}</li>' for x in items) + "</ul>"
        return " | ".join(items)

    def note(self) -> str:
        """Prose without links that is no content: what adverts, notices and comments hold."""
        text = self.prose()
        return text if self.r.random() < 0.5 else f'<p data-y="0">{text}</p>' + (f'<p data-y="0">{self.prose()}</p>' if self.r.random() < 0.4 else "")

    def aside_parts(self) -> list[str]:
        r, parts = self.r, []
        maybe = lambda p, f: r.random() < p and parts.append(f())
        maybe(0.45, lambda: self.tag("div", 0, self.note(), _AD, 1))
        maybe(0.25, lambda: self.tag("div", 0, self.note() + "<button>Ok</button>", _NOTICE, 1))
        maybe(0.25, lambda: self.tag("aside", 0, (f'<h3 data-y="0">{self.words(1, 4)}</h3>' if r.random() < 0.5 else "") + (self.links() if r.random() < 0.6 else self.note()), _SIDE, 0.6))
        maybe(0.2, lambda: self.tag("div", 0, self.links() if r.random() < 0.6 else self.note(), _SIDE, 1))
        maybe(0.2, lambda: self.tag("form", 0, f'<label>{self.words(1, 3)}</label><input name="q"><button>Go</button>' + (f'<p data-y="0">{self.words(3, 20)}</p>' if r.random() < 0.4 else ""), _FORM, 0.6))
        maybe(0.1, lambda: self.tag("div", 0, self.note(), _FORM, 1))
        maybe(0.15, lambda: self.tag("div", 0, self.links(), _SOCIAL, 1))
        return parts

    def comments(self) -> str:
        r = self.r
        tag = r.choice(("div", "div", "article", "li", "p"))
        each = [self.tag(tag, 0, (f'<h4 data-y="0">{self.words(1, 2)}</h4>' if r.random() < 0.4 and tag != "p" else "") + (self.note() if tag != "p" else self.prose()), _ONE_COMMENT, 0.8) for _ in range(r.randint(1, 5))]
        inner = (f'<h3 data-y="0">{self.words(1, 3)}</h3>' if r.random() < 0.6 else "") + "".join(each)
        if tag == "li":
            inner = f'<ol data-y="0">{"".join(each)}</ol>'
        return self.tag(r.choice(("div", "section", "section")), 0, inner, _COMMENT, 1)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(f'<h1 data-y="1">{self.words(3, 12)}</h1>')
        for _ in range(r.randint(1, 10)):
            pick = r.random()
            if pick < 0.72:
                text = self.prose()
                if r.random() < 0.15:
                    text += f' <a href="#">{self.words(1, 4)}</a> ' + self.words(2, 10)
                parts.append(f'<p data-y="1">{text}</p>')
            elif pick < 0.8:
                parts.append(f'<{(h := r.choice(("h2", "h3")))} data-y="1">{self.words(2, 8)}</{h}>')
            elif pick < 0.87:
                parts.append('<ul data-y="1">' + "".join(f'<li data-y="1">{self.words(3, 25)}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
            elif pick < 0.91:
                parts.append(f'<blockquote data-y="1"><p data-y="1">{self.prose()}</p></blockquote>')
            elif pick < 0.94:
                parts.append('<table data-y="1">' + "".join('<tr data-y="1">' + "".join(f'<td data-y="1">{self.words(1, 6)}</td>' for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif pick < 0.96:
                parts.append(f'<pre data-y="1">{self.words(5, 30)}</pre>')
            elif pick < 0.98:
                parts.append(f'<section data-y="1"><h2 data-y="1">{self.words(2, 6)}</h2><p data-y="1">{self.prose()}</p></section>')
            else:
                parts.append(f'<div data-y="1">{self.prose()}</div>')
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.4 and (extra := self.aside_parts()):
                parts.insert(r.randint(0, len(parts)), extra[0])
        return "".join(parts)

    def html(self) -> str:
        r = self.r
        kind = r.random()
        inner = self.article()
        if kind < 0.6:
            body = self.tag("article", 1, inner, _BODY, 0.4)
            if r.random() < 0.3:
                body = self.tag("main", 1, body + (self.comments() if r.random() < 0.3 else ""), _BODY, 0.3)
        elif kind < 0.75:
            body = self.tag("main", 1, inner, _BODY, 0.4)
        elif kind < 0.95:
            body = self.tag("div", 1, inner, _BODY, 0.9)
        else:
            body = self.tag("section", 1, inner, _BODY, 0.7)
        before, after = [], []
        if r.random() < 0.45:
            head = f'<h1 data-y="0">{self.words(1, 4)}</h1>' if r.random() < 0.3 else f'<p data-y="0">{self.words(1, 12)}</p>'
            before.append(self.tag(r.choice(("header", "header", "div")), 0, head + (self.links() if r.random() < 0.5 else ""), _HEAD, 1 if r.random() < 0.6 else 0.5) if r.random() < 0.8 else self.tag("header", 0, self.prose(), _HEAD, 0.3))
        if r.random() < 0.7:
            before.append(self.tag("nav", 0, self.links(), _NAV, 0.3))
        elif r.random() < 0.5:
            before.append(self.tag("div", 0, self.links(), _NAV, 1))
        for part in self.aside_parts():
            (before if r.random() < 0.6 else after).append(part)
        if r.random() < 0.3:
            after.append(self.comments())
        r.shuffle(after)
        if r.random() < 0.75:
            foot = self.words(2, 20) if r.random() < 0.5 else (self.links() + f'<p data-y="0">{self.words(2, 30)}</p>')
            after.append(self.tag("footer", 0, "&copy; " + foot, _FOOT, 0.3) if r.random() < 0.8 else self.tag("div", 0, "&copy; " + foot, _FOOT, 1))
        page = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            page = self.tag("div", 1, page, _WRAP, 0.8)
        return f'<!DOCTYPE html><html data-y="1"><head><title>{self.words(2, 6)}</title></head><body data-y="1">{page}</body></html>'


def pages(n: int = 1200, seed: int = 11) -> list[str]:
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
