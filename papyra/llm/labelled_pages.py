"""Labelled pages to train the extractor: made from layouts, with invented words, by a seed.

Each page is a list of (html, label) parts, the label of its leaf blocks being True in the article. The
layouts differ in their tags, their class names, the order of their parts and in how much hangs on
names alone, so that no single feature decides.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go ha in jo ka lu me no or pe qui ra se ti un ve wo xi ya zu ße ñó é ça".split()

# Class and id names that sites give to parts of a page.
NAMES = {
    "article": "content post entry article story main body text page blog".split(),
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs pagination".split(),
    "header": "header masthead banner top site logo".split(),
    "footer": "footer bottom copyright colophon legal".split(),
    "aside": "sidebar aside related widget rail recommended trending popular".split(),
    "notice": "notice cookie consent alert gdpr banner privacy message".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor".split(),
    "form": "form search subscribe newsletter signup login contact".split(),
    "comment": "comment comments reply discussion respond disqus".split(),
    "share": "share social sharing follow tags meta".split(),
}
TAGS = {"nav": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section"], "ad": ["div", "aside", "ins"], "form": ["form"], "comment": ["section", "div", "ol"], "share": ["div", "ul"]}

Part = tuple[str, bool]


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.cells = self.r.random() < 0.08  # parts side by side in the cells of a table

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) + (self.r.choice(["", "", "", ",", "***", "&amp;"]) if self.r.random() < 0.1 else "")

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice(". . . . ! ?".split())

    def prose(self) -> str:
        # a page may be short: one-word paragraphs are as much article as long ones
        n = self.r.choice([1, 1, 2, 3, 5, 8])
        return " ".join(self.sentence(*self.r.choice([(1, 3), (4, 18), (4, 18)])) for _ in range(n))

    def attrs(self, kind: str, sure: bool = False) -> str:
        if not sure and self.r.random() < 0.25:
            return ""
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.4:
            name = f"{self.r.choice(['site', 'c', 'block', 'js', 'module'])}-{name}"
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def boilerplate(self, kind: str) -> list[Part]:
        tag = "td" if self.cells else self.r.choice(TAGS[kind])
        sure = tag in ("div", "section", "ul", "ol", "td")
        out: list[Part] = [(f"<{tag}{self.attrs(kind, sure)}>", False)]
        r = self.r
        if kind in ("nav", "share"):
            item = r.choice(["<li><a href='/{0}'>{0}</a></li>", "<a href='/x'>{0}</a> "])
            out += [((item.format(self.words(1, 2))), False) for _ in range(r.randint(2, 8))]
            if tag == "nav":
                out = [out[0], ("<ul>", False), *out[1:], ("</ul>", False)]
        elif kind == "footer":
            out.append((f"&copy; {self.words(1, 3)} &middot; {self.sentence(2, 10)}", False))
        elif kind == "form":
            out.append((f"<label>{self.words(1, 3)}</label><input type=text><p>{self.sentence()}</p><button>{self.words(1, 2)}</button>", False))
        elif kind == "comment":
            for _ in range(r.randint(1, 4)):
                out.append((f"<{r.choice(['div', 'li', 'article'])}{self.attrs('comment', True)}><p>{self.words(1, 2)}</p><p>{self.prose()}</p>", False))
                out.append(("</div>" if "<div" in out[-1][0] else "</li>" if "<li" in out[-1][0] else "</article>", False))
        elif kind == "aside":
            out.append((f"<h3>{self.words(1, 3)}</h3>", False))
            out += [(f"<li><a href='#'>{self.words(2, 8)}</a></li>", False) for _ in range(r.randint(1, 5))] if r.random() < 0.6 else [(f"<p>{self.prose()}</p>", False)]
        else:
            body = r.choice([self.sentence(2, 12), self.prose(), f"<p>{self.prose()}</p>", f"<h1>{self.words(1, 4)}</h1>" if kind == "header" else self.sentence(1, 4)])
            out.append((body, False))
        return [*out, (f"</{tag}>", False)]

    def article(self) -> list[Part]:
        r = self.r
        tags = r.choice([["article"], ["article"], ["main", "article"], ["main"], ["div"], ["div", "div"], ["main", "div"], ["div", "div"], []])
        tags = ["td"] if self.cells else tags
        out: list[Part] = [(f"<{t}{self.attrs('article', t in ('div', 'td'))}>", True) for t in tags]
        if r.random() < 0.9:
            out.append((f"<h1>{self.words(1, 9)}</h1>", True))
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            x = r.random()
            if x < 0.62:
                out.append((f"<p>{self.prose()}</p>" if r.random() < 0.7 else f"<p>{self.prose()}", True))
            elif x < 0.72:
                out.append((f"<p><b>{self.sentence()}<br>", True))
            elif x < 0.79:
                out.append((f"<h2>{self.words(1, 6)}</h2>", True))
            elif x < 0.85:
                out.append((r.choice(["<ul>", "<ol>"]) + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>", True))
            elif x < 0.89:
                out.append((f"<blockquote>{self.prose()}</blockquote>", True))
            elif x < 0.92:
                out.append((r.choice([f"<table><tr><th>{self.word()}</th><td>{self.words(1, 4)}</td></tr></table>", f"<pre>{self.words(1, 9)}</pre>", f"<dl><dt>{self.word()}</dt><dd>{self.sentence()}</dd></dl>", f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"]), True))
            elif x < 0.94:
                out.append((f"<p>{self.words(2, 9)} <a href='/x'>{self.words(1, 5)}</a> {self.sentence()}</p>", True))
            else:
                out += self.boilerplate(r.choice(["ad", "share", "aside"]))
        if r.random() < 0.2:
            out += self.boilerplate("comment")
        return [*out, *((f"</{t}>", True) for t in reversed(tags))]

    def page(self) -> list[Part]:
        r = self.r
        title = self.words(2, 9)
        out: list[Part] = [(f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{title}</title><style>p{{margin:0}}</style></head><body>", False)]
        before = [k for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        after = [k for k in ("aside", "comment", "form", "ad", "notice", "share", "nav") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        out.append(("<table><tr>" if self.cells else "", False))
        for kind in before:
            out += self.boilerplate(kind)
        out += self.article()
        out.append(("</tr></table>" if self.cells else "", False))
        self.cells = False
        for kind in [*after, *(["footer"] if r.random() < 0.8 else [])]:
            out += self.boilerplate(kind)
        return [*out, ("</body></html>", False)]


def labelled_page(seed: int) -> tuple[str, list[bool]]:
    """html and the labels of its leaf blocks, which are found by marking each text with its label."""
    from papyra.llm.dom import blocks

    parts = Maker(seed).page()
    marked = "".join(_mark(h, "" if label else "") for h, label in parts)
    labels = ["" in b.text for b in blocks(marked)]
    return "".join(h for h, _ in parts), labels


def _mark(part: str, mark: str) -> str:
    """part with mark after each of its words."""
    import re

    return re.sub(r"(>|^)([^<>]+)", lambda m: m[1] + m[2] + mark if m[2].strip() else m[0], part)
