"""Labelled pages: layouts drawn at random, each part marked as article (1) or not (0)."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from html import escape

import numpy as np

#: Parts of pages that aren't the article: how they are tagged and named.
OTHER = {
    "menu": (["nav", "ul", "div", "header", "table"], "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs links tabs subnav site-nav pagination pager".split()),
    "header": (["header", "div"], "header masthead topbar site-header branding logo banner page-header site-title tagline".split()),
    "footer": (["footer", "div", "section"], "footer site-footer copyright legal bottom colophon imprint credits foot page-footer".split()),
    "side": (["aside", "div", "section"], "sidebar side related widget popular trending archives recommended tagcloud tags rail right-col more-stories most-read teaser".split()),
    "notice": (["div", "section", "aside", "p"], "cookie cookies consent gdpr notice alert privacy popup modal overlay cookie-banner notification warning disclaimer message".split()),
    "advert": (["div", "aside", "section", "ins", "p"], "ad ads advert advertisement sponsored promo promotion sponsor banner-ad adsense commercial ad-slot adbox".split()),
    "form": (["form", "div", "fieldset"], "form newsletter subscribe login search signup contact register search-box poll survey".split()),
    "comments": (["section", "div", "ol", "ul", "article", "aside"], "comments comment commentlist respond replies discussion disqus reader-comments responses comment-list reply".split()),
    "share": (["div", "ul", "section"], "share social sharing share-buttons follow social-links tools".split()),
}
CONTENT = "content post entry story article-body text page-content article entry-content main-content body post-body story-text prose column".split()
NEUTRAL = "container wrapper row col inner box block grid c1 x7 layout page outer section clearfix wrap".split()
SYLLABLES = "an be co da en er fi go hu in is ka la le mo na ne on or pa que ra re sa st ta te ti un vo wa zu ß é ä ñ ó 的 了 да не".split()

VOCABULARY = 4000


@lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    rng = np.random.default_rng(0)
    return ["".join(SYLLABLES[i] for i in rng.integers(0, len(SYLLABLES), n)) for n in rng.integers(1, 5, VOCABULARY)]


class _Page:
    """Pieces of a page with their labels."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.pieces, self.labels = rng, [], []
        self.named = rng.random() < 0.85
        self.tagged = rng.random() < 0.75
        self.marks = rng.random() < 0.15

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, some):
        return some[int(self.rng.integers(len(some)))]

    def put(self, html: str, label: int = 0) -> None:
        self.pieces.append(html)
        self.labels.append(label)

    def words(self, low: int, high: int) -> list[str]:
        return [_vocabulary()[i] for i in self.rng.integers(0, VOCABULARY, int(self.rng.integers(low, high + 1))).tolist()]

    def phrase(self, low: int = 1, high: int = 4) -> str:
        text = " ".join(self.words(low, high))
        return escape(text.capitalize() if self.chance(0.7) else text)

    def sentences(self, low: int, high: int) -> str:
        words, at = self.words(low, high), 0
        while at < len(words):
            words[at] = words[at].capitalize()
            at += int(self.rng.integers(3, 18))
            words[min(at, len(words)) - 1] += self.pick([".", ".", ".", "!", "?", ",", ":"])
        if self.marks:
            words = [w + self.pick(["###", "***", "&", "$$$", "%%%", " |", " ·"]) for w in words]
        return escape(" ".join(words))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.integers(1000)}">{self.phrase(low, high)}</a>'

    def open(self, tag: str, names: list[str], always: bool = False) -> str:
        """A start tag, named for what it holds or for the layout, or not at all."""
        if not (self.named or always):
            return f"<{tag}>"
        name = self.pick(names)
        if self.chance(0.3):
            name = f"{self.pick(NEUTRAL)} {name}"
        if self.chance(0.15):
            name += f"-{self.pick(NEUTRAL)}"
        return f'<{tag} {self.pick(["class", "class", "id"])}="{name}">'

    # --- the article

    def paragraph(self, label: int = 1, long: bool = True) -> None:
        size = self.pick([(1, 3), (4, 15), (15, 60), (30, 120), (60, 300)] if long else [(2, 10), (8, 40)])
        text = self.sentences(*size)
        if self.chance(0.15):
            text += f" {self.link()} {self.sentences(1, 12)}"
        form = self.rng.random()
        if form < 0.75:
            self.put(f"<p>{text}</p>", label)
        elif form < 0.85:
            self.put(f"<p><b>{text}<br>", label)
        elif form < 0.93:
            self.put(f"<p>{text}\n", label)
        else:
            self.put(f"<div><span>{text}</span></div>", label)

    def article_part(self) -> None:
        form = self.rng.random()
        if form < 0.72:
            self.paragraph()
        elif form < 0.82:
            tag = self.pick(["h2", "h3", "h4"])
            self.put(f"<{tag}>{self.phrase(1, 9)}</{tag}>", 1)
        elif form < 0.88:
            tag = self.pick(["ul", "ol"])
            self.put(f"<{tag}>")
            for _ in range(int(self.rng.integers(1, 6))):
                self.put(f"<li>{self.sentences(2, 20)}</li>", 1)
            self.put(f"</{tag}>")
        elif form < 0.92:
            self.put(f"<blockquote><p>{self.sentences(4, 40)}</p></blockquote>", 1)
        elif form < 0.94:
            self.put(f"<pre><code>{self.phrase(2, 30)}</code></pre>", 1)
        elif form < 0.97:
            self.put("<table>")
            for _ in range(int(self.rng.integers(1, 4))):
                self.put(f"<tr><td>{self.phrase()}</td>", 1)
                self.put(f"<td>{self.rng.integers(10000)}</td></tr>", 1)
            self.put("</table>")
        else:
            self.put(f'<figure><img src="x.png"><figcaption>{self.sentences(2, 15)}</figcaption></figure>', 1)

    def article(self) -> None:
        wraps = [self.pick(["main", "article", "article", "div", "section", "td"]) for _ in range(int(self.rng.integers(0 if not self.named else 1, 4)))]
        wraps = [w if self.tagged else "div" for w in wraps]
        if "td" in wraps:
            wraps = ["table", "tr", *[w for w in wraps if w != "td"][:0], "td"]
        for w in wraps:
            self.put(self.open(w, CONTENT if self.chance(0.6) else NEUTRAL) if self.chance(0.7) else f"<{w}>")
        if self.chance(0.75):
            head = self.chance(0.15) and self.tagged
            self.put(f"{'<header>' if head else ''}<h1>{self.sentences(1, 3) if self.chance(0.1) else self.phrase(2, 14)}</h1>{'</header>' if head else ''}", 1)
        if self.chance(0.2):
            self.other("share")
        parts = int(self.rng.integers(1, 25)) if self.chance(0.75) else 1
        for k in range(parts):
            self.article_part()
            if self.chance(0.08):
                self.other(self.pick(["advert", "side", "form", "share", "notice"]), inside=True)
        if self.chance(0.12):
            self.other("comments", inside=True)
        for w in reversed(wraps):
            self.put(f"</{w}>")

    # --- the rest

    def other(self, kind: str, inside: bool = False) -> None:
        tags, names = OTHER[kind]
        tag = self.pick(tags[:1] if self.chance(0.5) else tags) if self.tagged else self.pick([t for t in tags if t in ("div", "ul", "ol", "table", "form", "p", "fieldset")] or ["div"])
        # inside the article, and for comments, only the name tells
        self.put(self.open(tag, names, always=inside or kind in ("comments", "advert", "notice")))
        many = int(self.rng.integers(1, 8))
        if kind in ("menu", "share"):
            form = self.pick(["li", "a", "p"])
            if form == "li" and tag not in ("ul",):
                self.put("<ul>")
            for _ in range(many):
                link = self.link(1, 3)
                self.put(f"<li>{link}</li>" if form == "li" else f"{link} | " if form == "a" else f"<p>{link}</p>")
            if form == "li" and tag not in ("ul",):
                self.put("</ul>")
        elif kind == "header":
            self.put(f"<div>{self.link(1, 3)}</div>" if self.chance(0.5) else f"<h2>{self.phrase(1, 4)}</h2>")
            if self.chance(0.5):
                self.put(f"<p>{self.phrase(2, 8)}</p>")
            if self.chance(0.3):
                self.other("menu")
        elif kind == "footer":
            line = f"{'&copy;' if self.chance(0.8) else ''} {self.pick(['', str(self.rng.integers(1995, 2030))])} {self.phrase()} {self.pick(['&middot;', '|', '-', '.'])} "
            line += self.sentences(2, 25) if self.chance(0.6) else self.link()
            self.put(f"<p>{line}</p>" if self.chance(0.5) else line)
            for _ in range(many if self.chance(0.4) else 0):
                self.put(f"<div>{self.link()}</div>")
        elif kind == "side":
            self.put(f"<h3>{self.phrase(1, 3)}</h3>")
            for _ in range(many):
                self.put(f"<li>{self.link(2, 10)}</li>" if self.chance(0.6) else f"<p>{self.sentences(3, 30)}</p>")
        elif kind == "form":
            if self.chance(0.7):
                self.put(f"<p>{self.sentences(2, 20)}</p>")
            inner = "" if tag == "form" else "<form>"
            self.put(f"{inner}<label>{self.phrase(1, 2)}</label><input name=q><button>{self.phrase(1, 2)}</button>{'</form>' if inner else ''}")
        elif kind == "comments":
            if self.chance(0.6):
                self.put(f"<h3>{self.phrase(1, 2)} ({self.rng.integers(100)})</h3>")
            for _ in range(many):
                item = self.pick(["li", "div", "article"]) if tag not in ("ol", "ul") else "li"
                self.put(self.open(item, OTHER[kind][1]) if self.chance(0.5) else f"<{item}>")
                if self.chance(0.6):
                    self.put(f"<b>{self.phrase(1, 2)}</b> {self.rng.integers(2000, 2030)}-0{self.rng.integers(1, 9)}")
                for _ in range(int(self.rng.integers(1, 3))):
                    self.paragraph(0, long=self.chance(0.5))
                self.put(f"</{item}>")
        else:
            text = self.sentences(2, 40)
            if self.chance(0.3):
                text += " " + self.link()
            self.put(f"<p>{text}</p>" if self.chance(0.4) and tag != "p" else text)
            if self.chance(0.3):
                self.put(f"<button>{self.phrase(1, 2)}</button>")
        self.put(f"</{tag}>")

    def whole(self) -> tuple[str, list[int], list[int]]:
        self.put(f"<!DOCTYPE html><html><head><title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
        bare = self.chance(0.2)  # the article comes first
        for kind, chance in (("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("form", 0.15), ("side", 0.15)):
            if self.chance(chance) and not bare:
                self.other(kind)
        outer = int(self.rng.integers(0, 3)) if self.chance(0.5) else 0
        self.put("".join(self.open("div", NEUTRAL) for _ in range(outer)))
        self.article()
        for kind, chance in (("share", 0.2), ("comments", 0.35), ("side", 0.35), ("advert", 0.25), ("form", 0.2)):
            if self.chance(chance):
                self.other(kind)
        self.put("</div>" * outer)
        for kind, chance in (("menu", 0.2), ("notice", 0.15), ("footer", 0.85)):
            if self.chance(chance):
                self.other(kind)
        if self.chance(0.9):
            self.put("</body></html>")
        begins = np.r_[0, np.cumsum([len(p) for p in self.pieces])[:-1]].tolist()
        return "".join(self.pieces), begins, self.labels


def labelled_page(seed: int) -> tuple[str, list[int], list[int]]:
    """A page, the places where its parts begin, and the label of each part; the same for the same seed."""
    return _Page(np.random.default_rng(seed)).whole()


def label_at(begins: list[int], labels: list[int], place: int) -> int:
    """The label of the part that holds a place of the page."""
    return labels[bisect_right(begins, place) - 1]
