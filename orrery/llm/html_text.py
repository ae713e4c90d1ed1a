"""Main text of web pages by shallow text features and a small decision tree.

A page's html becomes a flat sequence of text blocks (cut at block-level tags).
Each block carries its word count and link density and those of its neighbours, its
place in the page, and what its markup says: a heading or list item, inside an
article, inside an element that HTML means for something else (menus, page heads and
feet, asides, forms), and a hint from the names of its containers.  A decision tree,
trained on the labelled table that ``labelled_pages`` writes out (main blocks are
marked there), decides block by block.  Scripts, styles and other unshown content
never become text.

Names are read as English compounds: the last word of a class or id that is not a
general one (``list``, ``box``) names the thing, so that ``comment-list`` is about
comments, while ``has-sidebar``, ``page-with-menu`` and ``related-work`` say nothing.
Only containers' names count, not those of headings and paragraphs.

Results at the edges: a null or empty html, or one without a main block, has the
empty text; white space inside a block becomes one space; blocks are joined by
one space in page order; unclosed tags end with the page; character references
are decoded; pages of any length are read whole; repeated rows are repeated; an
empty table gives an empty result; other columns pass through, those named like
an output are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# fixed values: the classes of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style noscript template head title iframe object svg math canvas audio video textarea select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEM = frozenset("li dt dd".split())
BESIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
CONTAINER = frozenset("div section ul ol dl table tbody tr td article aside nav header footer form span center details figure".split())
#: What a container's name may name besides the article, and the article itself.
BESIDE_NAMES = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer foot colophon sidebar aside rail widget widgets
    ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    newsletter subscribe subscription signup login signin register form search searchbox comment comments disqus replies reply respond
    related recommended recommendations share sharing social follow tagcloud popup modal overlay dialog pagination pager copyright legal
    disclaimer toolbar complementary contentinfo teaser teasers taboola outbrain paywall feedback""".split()
)
MAIN_NAMES = frozenset("article main post entry story content".split())
#: Last words of names that do not name the thing itself, and words at either end that speak of a page's layout.
GENERAL = frozenset("list item items box block area section container wrapper wrap inner outer slot unit bar links link buttons button text body content contents posts post stories articles panel group row column col left right top bottom thread".split())
LAYOUT = frozenset("has no with without is not hide show layout theme grid template".split())
#: Words of a heading over readers' comments.
COMMENTS = frozenset("comment comments reply replies response responses kommentar kommentare antworten commentaire commentaires réponses comentario comentarios respuestas".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements whose content is raw, and the patterns of their ends.
END = {t: re.compile(rf"</{t}\b", re.I) for t in "script style textarea title noscript iframe".split()}
#: Elements that end an open one of these, where its end tag was left out.
IMPLIED = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
IMPLIED_NOT = frozenset("html head body".split())

#: Features of a block, in order.
FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "words_before2", "words_after2", "around", "place", "from_end",
    "heading", "item", "main", "beside", "hint", "page_has_main", "after_comments", "rights",
)


class Block(NamedTuple):
    text: str
    density: float = 0.0
    heading: bool = False
    item: bool = False
    main: bool = False
    beside: bool = False
    hint: int = 0


def name_hint(name: str) -> int:
    """-1: the name speaks of something beside the article, 1: of the article, 0: neither."""
    parts = [p.lower() for p in PART.findall(name)]
    if not parts or parts[0] in LAYOUT or parts[-1] in LAYOUT | {"page", "site"} or {"with", "without"} & set(parts):
        return 0
    while len(parts) > 1 and parts[-1] in GENERAL:
        parts.pop()
    return -1 if parts[-1] in BESIDE_NAMES else 1 if parts[-1] in MAIN_NAMES else 0


def _context(tag: str, attributes: str) -> tuple[bool, int]:
    """(hidden, hint) of an element by its attributes."""
    hidden, hints = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name in ("class", "id", "role") and tag in CONTAINER:
            hints.update(name_hint(v) for v in value.split())
    return hidden, -1 if -1 in hints else 1 if 1 in hints else 0


def blocks(html: str | None) -> list[Block]:
    """Every text block, in page order."""
    out: list[Block] = []
    if not html:
        return out
    text: list[str] = []
    stack: list[tuple[str, Block, bool]] = []  # tag, what its blocks have, unshown
    outside = ("", Block(""), False)
    linked, in_link, raw = 0, False, ""

    def close() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            out.append((stack[-1] if stack else outside)[1]._replace(text=words, density=min(1.0, linked / len(words))))
        linked = 0

    at, n = 0, len(html)
    while at < n:
        if raw:  # content that no markup ends but the end tag
            end = END[raw].search(html, at)
            at, raw = (end.start() if end else n), ""
            continue
        m = TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        if m[4] is not None:
            if not (stack and stack[-1][2]):
                shown = unescape(m[4])
                text.append(shown)
                if in_link:
                    linked += len(" ".join(shown.split()))
            continue
        tag, ends = (m[2] or "a").lower(), bool(m[1])
        if m[2] is None or tag in INLINE:
            in_link = (not ends) if m[2] and tag == "a" else in_link
            continue
        close()
        in_link = False
        if tag in VOID:
            continue
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in END:
            raw = tag
            continue
        if tag == "body":
            stack.clear()  # a head left open ends here
        while stack and stack[-1][0] in IMPLIED.get(tag, ("p",) if tag not in IMPLIED_NOT else ()):
            stack.pop()  # end tags that may be left out
        hidden, hint = _context(tag, m[3] or "")
        _, up, unshown = stack[-1] if stack else outside
        if tag in ("html", "body"):
            hint = 0  # a whole page is never beside itself
        # an article's own head is part of it; a page has one main element, whatever contains it
        beside = up.beside or tag in BESIDE and not (tag == "header" and up.main)
        if tag == "header" and up.main:
            hint = 0
        hint = up.hint if up.hint < 0 and tag != "main" or not hint else hint
        main = (up.main or tag in MAIN) and not beside and hint >= 0
        own = Block("", 0.0, up.heading or tag in HEADING, up.item or tag in ITEM, main, beside, 1 if tag == "main" else hint)
        stack.append((tag, own, unshown or hidden or tag in UNSHOWN))
    close()
    return out


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x of the block ``by`` places on, 0 beyond the page."""
    out = np.zeros_like(x)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def _about_comments(block: Block) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+", block.text.lower())]
    return 0 < len(words) <= 4 and bool(COMMENTS & set(words))


def _rights(text: str) -> bool:
    low = text[:300].lower()
    return "©" in low or low.startswith("copyright") or "all rights reserved" in low


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words, density = np.array([len(b.text.split()) for b in found], float), np.array([b.density for b in found])
    plain = np.where(density < 0.5, words, 0)
    x[:, 0], x[:, 1] = words, density
    for k, by in enumerate((-1, 1)):
        x[:, 2 + 2 * k], x[:, 3 + 2 * k] = _shifted(words, by), _shifted(density, by)
        x[:, 6 + k] = _shifted(words, 2 * by)
    x[:, 8] = sum(_shifted(plain, by) for by in (-2, -1, 1, 2))
    x[:, 9], x[:, 10] = np.round(np.arange(n) / max(1, n - 1), 2), np.minimum(np.arange(n)[::-1], 20)
    x[:, 11:16] = [(b.heading, b.item, b.main, b.beside, b.hint) for b in found]
    x[:, 16] = any(b.main for b in found)
    x[:, 17] = np.cumsum([_about_comments(b) for b in found]) > 0
    x[:, 18] = [w <= 60 and _rights(b.text) for w, b in zip(words, found, strict=True)]
    return x


# ---- the labelled table ---------------------------------------------------------------
MARK = "\u2063"  # stands before the text of a main block
_SENTENCES = (
    "The council met on Tuesday evening to discuss the new bridge",
    "after three hours of debate the members agreed to send the plan back to the engineers",
    "Residents who spoke at the meeting asked for a footpath on the eastern side",
    "several of them said that the current crossing is too narrow for two people to pass",
    "Snow fell on the hills above the town for the first time this winter",
    "farmers brought their sheep down to the lower fields before the roads were closed",
    "The museum has bought a small landscape that was thought to be lost",
    "it was found behind a cupboard when the old library was painted",
    "Trains will run every ten minutes once the second track is finished",
    "the work is to cost less than was feared and to take a year longer",
    "Researchers measured the water of the lake at forty places",
    "they found fewer weeds than ten years ago and more of the small green mussels",
)
_TITLES = ("Bridge plan sent back", "Snow on the hills", "A lost picture", "Ten minutes", "The lake is clearer than it was", "Opinion")
_CHROME = ("Home", "News", "Contact us", "About the paper", "Sports results", "Weather and traffic", "Print", "Latest stories from our town")


def labelled_pages(pages: int = 300, seed: int = 4) -> list[str]:
    """Pages whose main blocks begin with ``MARK``: combinations of articles with the
    things that surround them, with telling tags, with telling names, with neither."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def prose(least: int, most: int) -> str:
        n, words = rng.randint(least, most), []
        while len(words) < n:
            words += pick(_SENTENCES).split()
        return " ".join(words[:n]) + "."

    def link(text: str) -> str:
        return f"<a href='/{rng.randint(1, 99)}'>{text}</a>"

    def article(own: bool) -> str:
        """``own``: the markup says what the article is, so that any words may be part of it."""
        parts = [f"<h1>{MARK}{pick(_TITLES)}</h1>"] if chance() < 0.8 else []
        for _ in range(rng.randint(2, 7)):
            kind = chance()
            if kind < 0.55:
                words = prose(8, 70).split()
                if chance() < 0.3:
                    at = rng.randrange(len(words))
                    words[at] = link(words[at])
                parts.append(f"<p>{MARK}{' '.join(words)}</p>")
            elif kind < 0.7:
                parts.append(f"<p>{MARK}{prose(1, 6)}</p>")
            elif kind < 0.78:
                parts.append(f"<ul><li>{MARK}{prose(2, 6)}</li><li>{MARK}{prose(2, 9)}</li></ul>")
            elif kind < 0.86:
                parts.append(f"<h2>{MARK}{pick(_TITLES)}</h2><p>{MARK}{prose(15, 50)}</p>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{MARK}{prose(8, 30)}</blockquote>")
            else:
                parts.append(f"<p>{link(MARK + prose(4, 9))}</p><p>{MARK}{prose(10, 40)}</p>")
        if own and chance() < 0.4:
            parts.append(f"<p>{MARK}{pick(['All rights reserved.', '© 2018 by the author.', 'Comments'])}</p>")
        return "".join(parts)

    def links() -> str:
        own = [link(c) for c in rng.sample(_CHROME, rng.randint(2, 6))]
        return "<ul>" + "".join(f"<li>{c}</li>" for c in own) + "</ul>" if chance() < 0.5 else " ".join(own)

    def comments() -> str:
        return "".join(f"<div><p>{link('Ann')} said</p><p>{prose(2, 40)}</p></div>" for _ in range(rng.randint(1, 3)))

    styles = {
        "tags": {
            "head": lambda: f"<header><p>{prose(3, 20)}</p></header><nav>{links()}</nav>", "main": lambda: pick(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<article><header>{}</header></article>"]),
            "ad": lambda: pick(["<aside>{}</aside>", "<div class='ad'>{}</div>", "<aside><p>{}</p></aside>"]).format(prose(4, 40) if chance() < 0.7 else links()), "form": lambda: f"<form><label>{prose(1, 4)}</label> {prose(3, 15)}</form>",
            "comments": lambda: f"<section class='comments'><h3>Comments</h3>{comments()}</section>", "foot": lambda: f"<footer>&copy; 2020 {prose(2, 20)}</footer>",
        },
        "names": {
            "head": lambda: f"<div class='masthead'>{prose(2, 15)}</div><div id='menu'>{links()}</div>", "main": lambda: pick(["<div class='post-content'>{}</div>", "<div id='main' class='no-sidebar content'>{}</div>", "<div class='post has-sidebar'>{}</div>", "<div class='wide'>{}</div>"]),
            "ad": lambda: pick(["<div class='sidebar'><p>{}</p></div>", "<div class='ad-slot'>{}</div>", "<div id='cookie-notice'>{}</div>", "<div class='related-posts'>{}</div>"]).format(prose(4, 40) if chance() < 0.7 else links()), "form": lambda: f"<div class='newsletter-box'><p>{prose(4, 20)}</p></div>",
            "comments": lambda: f"<div id='comments'><h3>2 Comments</h3>{comments()}</div>", "foot": lambda: f"<div class='footer'>{prose(3, 25)}</div>",
        },
        "neither": {
            "head": lambda: f"<div>{links()}</div>", "main": lambda: pick(["<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "{}"]),
            "ad": lambda: f"<div>{links()}</div>", "form": lambda: f"<form>{prose(2, 15)}</form>",
            "comments": lambda: f"<h3>{pick(['3 comments', 'Comments', 'Readers’ comments'])}</h3>{comments()}", "foot": lambda: f"<div>{pick(['© 2021 ', 'Copyright 2019 '])}{prose(2, 20)}</div><p>{link('Privacy')} {link('Terms')}</p>",
        },
    }
    out = []
    for k in range(pages):
        s = styles[("tags", "names", "neither")[k % 3]]
        body = s["head"]() if chance() < 0.8 else ""
        body += s["ad"]() if chance() < 0.5 else ""
        frame = s["main"]()
        inner = article("wide" not in frame and k % 3 < 2)
        if chance() < 0.3 and k % 3 < 2:  # something else in the middle of the article
            cut = inner.index("</p>") + 4 if "</p>" in inner else 0
            inner = inner[:cut] + (s["ad"]() if chance() < 0.6 else s["form"]()) + inner[cut:]
        body += frame.format(inner)
        for part, share in (("ad", 0.4), ("form", 0.3), ("comments", 0.5), ("foot", 0.8)):
            body += s[part]() if chance() < share else ""
        out.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
    return out


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, depth: int = 10, least: int = 6):
        self.depth, self.least, self.root = depth, least, 0.0

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p) * len(y)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return float(y.mean()) if len(y) else 0.0
        best = (self._gini(y) - 1e-9, -1, 0.0)
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, k] < cut
                if min(left.sum(), (~left).sum()) >= self.least:
                    score = self._gini(y[left]) + self._gini(y[~left])
                    if score < best[0] - 1e-12:
                        best = (score, k, float(cut))
        if best[1] < 0:
            return float(y.mean())
        left = x[:, best[1]] < best[2]
        return (best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.root = self._grow(x, y.astype(float), self.depth)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node, at):
            if not len(at):
                return
            if isinstance(node, float):
                out[at] = node
                return
            k, cut, low, high = node
            left = x[at, k] < cut
            walk(low, at[left])
            walk(high, at[~left])

        walk(self.root, np.arange(len(x)))
        return out >= 0.5


def labelled_blocks(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for html in pages:
        found = blocks(html)
        y += [b.text.startswith(MARK) for b in found]
        x.append(features([b._replace(text=b.text.replace(MARK, "")) for b in found]))
    return np.concatenate(x), np.array(y)


@lru_cache(1)
def default_tree() -> Tree:
    return Tree().fit(*labelled_blocks(labelled_pages()))


def main_text(html: str | None, tree: Tree | None = None) -> str:
    found = blocks(html)
    keep = (tree or default_tree()).predict(features(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points)."""
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(h, tree) for h in html.tolist()], dtype=object)

    return pages.withColumn("text", run("html")).withColumn("n_chars", F.char_length("text").cast("long"))
