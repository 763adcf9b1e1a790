"""Pages of many layouts, made from a seed, with their main text known: training data for html_text.py."""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo th ing er st ou an el or um ish que é ö ñ".split()
NOISE = {
    "menu": (["nav", "div", "ul", "header"], ["nav", "menu", "navbar", "main-nav", "breadcrumbs", "top-menu", "site-navigation", "pagination"]),
    "head": (["header", "div"], ["header", "site-header", "masthead", "banner", "page-head"]),
    "foot": (["footer", "div", "section"], ["footer", "site-footer", "bottom", "copyright", "page-foot"]),
    "side": (["aside", "div", "section"], ["sidebar", "widget", "related-posts", "side", "rail", "popular", "recommended"]),
    "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "sponsored", "ad-slot", "advertisement", "promo"]),
    "notice": (["div", "section", "dialog", "p"], ["cookie-notice", "consent", "alert", "notice", "gdpr-banner", "paywall", "popup", "modal"]),
    "comments": (["section", "div", "ol", "aside"], ["comments", "comment-list", "replies", "discussion", "respond", "reader-comments"]),
    "form": (["form", "div"], ["newsletter", "login", "search-form", "subscribe", "signup"]),
    "byline": (["div", "p", "span", "footer"], ["byline", "entry-meta", "post-meta", "author", "meta", "tags", "entry-footer", "author-bio", "date", "published"]),
    "share": (["div", "ul", "p"], ["share", "social", "tags", "byline-tools", "follow-us"]),
}
TITLES = ["entry-header", "post-header", "article-header", "page-title", "headline", "title", "entry-title", "story-head"]
CONTENT = ["content", "article-body", "post", "entry-content", "story", "main", "post-content", "page-content", "text", "body-text"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: set[str] = set()

    def word(self, main: bool) -> str:
        w = "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))
        if main:
            # main words are told apart by a letter that other words lack; the text never enters the features
            w += "x"
            self.main.add(w)
        return w

    def words(self, n: int, main: bool) -> str:
        out = []
        for _ in range(n):
            w = self.word(main)
            u = self.r.random()
            if u < 0.12:
                w += self.r.choice(".,.,;!?")
            out.append(w)
        s = " ".join(out)
        if self.r.random() < 0.7:
            s += " " + self.word(main)
        return s + self.r.choice(["", ".", ".", ".\n"])

    def inline(self, n: int, main: bool) -> str:
        s = self.words(n, main)
        r = self.r.random()
        if r < 0.15:
            s += f' <a href="/{self.word(False)}">{self.words(self.r.randint(1, 4), main)}</a> ' + self.words(self.r.randint(1, 12), main)
        elif r < 0.3:
            s = f"<b>{s}</b> " + self.words(self.r.randint(1, 9), main)
        elif r < 0.38:
            s = f"<b>{s}<br>"
        elif r < 0.45:
            s += "<br>" + self.words(self.r.randint(1, 12), main) + " &amp; " + self.words(2, main)
        return s

    def size(self) -> int:
        return self.r.choice([1, 2, 3, 6, 10, 20, 30, 60, 90])

    def block(self, main: bool) -> str:
        r = self.r.random()
        if r < 0.66:
            return f"<p>{self.inline(self.size(), main)}" + self.r.choice(["</p>", "</p>", "</p>", ""])
        if r < 0.75:
            t = self.r.choice(["h2", "h3"])
            return f"<{t}>{self.words(self.r.randint(1, 8), main)}</{t}>"
        if r < 0.83:
            t = self.r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.inline(self.r.randint(2, 20), main)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{t}>"
        if r < 0.88:
            return f"<blockquote>{self.r.choice(['<p>', ''])}{self.words(self.size(), main)}</blockquote>"
        if r < 0.92:
            return f"<pre>{self.words(self.r.randint(3, 20), main)}</pre>"
        if r < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.words(2, main)}</td><td>{self.words(3, main)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><img src=x.png><figcaption>{self.words(6, main)}</figcaption></figure>"

    def links(self, n: int, items: bool) -> str:
        # unquoted addresses may end in a slash, which closes nothing
        quoted = self.r.random() < 0.8
        address = lambda: f'"/{self.word(False)}"' if quoted else f"/{self.word(False)}/"
        one = [f"<a href={address()}>{self.words(self.r.choice([1, 1, 1, 2, 5]), False)}</a>" for _ in range(n)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in one) + "</ul>" if items else " | ".join(one)

    def attribute(self, tokens: list[str], telling: float) -> str:
        if self.r.random() > telling:
            return self.r.choice(["", f' class="{self.r.choice("abcxyz")}{self.r.randint(1, 99)}"'])
        t = self.r.choice(tokens)
        t = self.r.choice([t, t, t, f"{t}-{self.r.randint(1, 9)}", f"c-{t}", f"{t} clearfix", f"{t}__inner", t.title().replace("-", "")])
        return f' {self.r.choice(["class", "class", "id"])}="{t}"'

    def noise(self, kind: str) -> str:
        tags, tokens = NOISE[kind]
        tag = self.r.choice(tags)
        # an element whose name says it needs no attribute; others mostly have a telling one
        own = tag in ("nav", "header", "footer", "aside", "form")
        a = self.attribute(tokens, 0.45 if own else 0.97)
        r = self.r.random()
        if kind in ("menu", "share"):
            body = self.links(self.r.randint(2, 9), r < 0.7)
        elif kind == "head":
            body = self.r.choice([f"<h1>{self.words(2, False)}</h1>", self.words(2, False), f"<a href=/>{self.words(2, False)}</a>"]) + self.links(self.r.randint(0, 5), True)
        elif kind == "foot":
            body = self.r.choice(["&copy; ", "<p>&copy; ", "<p>"]) + self.words(self.r.choice([3, 8, 20, 40]), False) + self.links(self.r.randint(0, 5), r < 0.5)
        elif kind == "side":
            body = f"<h3>{self.words(2, False)}</h3>" + (self.links(self.r.randint(2, 8), True) if r < 0.6 else self.block(False) + self.block(False))
        elif kind == "comments":
            head = self.r.choice(["<h2>Comments</h2>", "<h3>3 comments</h3>", "", ""])
            item = "li" if tag == "ol" else self.r.choice(["div", "p", "article"])
            body = head + "".join(f"<{item}{self.attribute(['comment', 'reply', 'comment-body'], 0.6)}>{self.r.choice(['', '<b>Nime</b> '])}{self.inline(self.size(), False)}</{item}>" for _ in range(self.r.randint(1, 6)))
        elif kind == "byline":
            body = "By " * (self.r.random() < 0.4) + self.words(self.r.choice([1, 2, 4, 8]), False) + (self.links(self.r.choice([1, 2]), False) if r < 0.4 else "")
        elif kind == "form":
            body = f"<label>{self.words(3, False)}</label><input name=q><p>{self.words(self.r.choice([3, 12, 30]), False)}</p><button>Go</button>"
        elif kind == "notice":
            body = self.r.choice([self.words(self.r.choice([6, 15, 40]), False), f"<p>{self.words(self.r.choice([6, 15, 40]), False)}</p>"]) + (self.links(1, False) if r < 0.5 else "")
            body = body.replace("<p>", "").replace("</p>", "") if tag == "p" else body
        else:
            body = self.r.choice([self.words(self.size(), False), self.block(False), self.links(2, False)])
        return f"<{tag}{a}>{body}</{tag}>"

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        title = f"<h1{self.attribute(TITLES, 0.25)}>{self.words(r.randint(2, 10), True)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.25:
            t = r.choice(["header", "header", "div"])
            title = f"<{t}{self.attribute(TITLES, 0.7)}>{title}{self.noise('byline') if r.random() < 0.3 else ''}</{t}>"
        # some titles stand before the block of the text, with something between
        apart = title if r.random() < 0.2 else ""
        blocks = [title] if title and not apart else []
        if r.random() < 0.1:
            # text that no element but line breaks divides
            blocks.append(r.choice(["<br>", "<br><br>", "<br/>\n<br/>"]).join(self.words(self.size(), True) for _ in range(r.choice([2, 3, 6]))))
        else:
            blocks += [self.block(True) for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
        inside = [k for k in ("advert", "share", "comments", "side", "form", "notice", "menu", "byline") if r.random() < 0.16]
        for k in inside:
            at = len(blocks) if k == "comments" else r.randint(1, len(blocks))
            blocks.insert(at, self.noise(k))
        body = "\n".join(blocks) if r.random() < 0.5 else "".join(blocks)
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        if tag == "td":
            body, apart = apart + body, ""
        if tag == "td" or r.random() < 0.93:
            body = f"<{tag}{self.attribute(CONTENT, 0.4 if tag in ('article', 'main') else 0.85)}>{body}</{tag}>"
        if tag == "td":
            # a page laid out as a table
            rows = [f"<tr><td colspan=2>{self.links(r.randint(2, 6), False)}</td></tr>" if r.random() < 0.5 else "", f"<tr><td>{self.links(4, r.random() < 0.6)}</td>{body}</tr>"]
            rows.append(f"<tr><td colspan=2>{r.choice(['Copyright 1998 ', '&copy; ', ''])}{self.words(r.choice([1, 3, 8]), False)}{self.links(r.choice([0, 2]), False)}</td></tr>" if r.random() < 0.5 else "")
            body = f"<table>{''.join(rows)}</table>"
        if apart:
            between = "".join(self.noise(k) for k in ("byline", "share", "advert") if r.random() < 0.35)
            t = r.choice(["div", "div", "main", "section", "article"])
            body = f"<{t}{self.attribute([*CONTENT, 'wrapper', 'col-8', 'layout'], 0.7)}>{apart}{between}{body}</{t}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            t = r.choice(["div", "main", "section"])
            extra = self.noise(r.choice(["side", "advert", "comments"])) if r.random() < 0.25 else ""
            body = f"<{t}{self.attribute([*CONTENT, 'wrapper', 'container', 'row'], 0.6)}>{body}{extra}</{t}>"
        top = [self.noise(k) for k in ("notice", "head", "menu", "advert") if r.random() < (0.75 if k == "menu" else 0.4)]
        end = [self.noise(k) for k in ("side", "comments", "form", "foot", "notice") if r.random() < (0.75 if k == "foot" else 0.25)]
        r.shuffle(top)
        head = f"<!DOCTYPE html><html><head><title>{self.words(4, False)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        return head + "".join(top) + "<!-- c -->" + body + "".join(end) + r.choice(["</body></html>", ""]), self.main


def pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    for k in range(n):
        yield Maker(seed * 100_003 + k).page()
