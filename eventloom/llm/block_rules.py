"""Main text of HTML pages by two passes of block rules.

First each block is judged alone by its place, link density, length and density of stop words: good, bad, near-good
or short.  Then ambiguous blocks inherit from the nearest decided blocks before and after them.  A mark of the article
(``article``, ``main``, ``articleBody``) is one input of the first pass: where the marked blocks hold at least half
of the plain text, it eases the limits for them and lowers the others by one step; elsewhere it counts for nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from eventloom.llm.common import map_texts

GOOD, BAD, NEAR, SHORT = "good", "bad", "near-good", "short"

#: Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe svg textarea select object math canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TAGS = frozenset("nav footer aside form head title menu dialog button option fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Elements that a paragraph's end tag may be missing for; they never hold other blocks.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li option".split())

#: Words in class, id or role that mark what is not the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer form "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary alert".split()
)
HEADER_WORDS = frozenset("header".split())
ARTICLE_WORDS = frozenset("articlebody".split())

#: Frequent function words.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his if in into is it its not of on one or she so that the their there they this to was we were which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind über um und "
    "uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del desde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser si sin sobre son su sus también un una y ya".split()
)

TAG = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass, and what they are eased by inside the article's mark; lengths are in characters."""

    short: int = 70
    long: int = 200
    low_stops: float = 0.20
    high_stops: float = 0.30
    links: float = 0.4
    mark_stops: float = 0.20
    mark_links: float = 0.4


@dataclass
class Block:
    text: str
    tag: str
    outside: bool
    article: bool
    link_chars: int
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.link_chars / max(1, len(self.text))

    @property
    def stop_density(self) -> float:
        words = [w.strip(".,;:!?\"'()").lower() for w in self.text.split()]
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def marks(attributes: str) -> tuple[frozenset[str], bool]:
    """The words of class, id, role and itemprop, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in CAMEL.split(value) if w)
            if name == "itemprop":
                words.add(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return frozenset(words), hidden


class Splitter:
    """Cuts a page into blocks, keeping a stack of the open elements that hold blocks."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # tag, outside, article, heads only
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.tag = ""
        self.breaks = 0
        self.blocks: list[Block] = []

    def close(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, outside, article, heads = self.stack[-1]
            self.blocks.append(Block(text, self.tag, outside or (heads and self.tag not in HEADINGS), article, min(self.linked, len(text))))
        self.parts, self.linked, self.breaks = [], 0, 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        value = html.unescape(raw) if "&" in raw else raw
        self.parts.append(value)
        if not value.isspace():
            self.breaks = 0
            if self.links:
                self.linked += len(value)

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
            return
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.close()
            return
        if tag not in BLOCK_TAGS:
            if tag in ("img", "input"):
                self.parts.append(" ")
            return
        self.close()
        self.tag, self.links = tag, 0
        if tag in LEAF_TAGS:
            while len(self.stack) > 1 and self.stack[-1][0] in LEAF_TAGS and (tag != "li" or self.stack[-1][0] == "li"):
                self.stack.pop()
        if tag == "hr":
            return
        _, outside, article, heads = self.stack[-1]
        words, hidden = marks(attributes) if attributes else (frozenset(), False)
        if tag in ARTICLE_TAGS:
            article = True
            outside = outside or hidden or bool(words & frozenset(("comment", "comments")))
        elif tag not in ("html", "body"):
            if tag == "header" or words & HEADER_WORDS:
                # the article's own header holds its title; a page's header is no part of it
                heads, outside = heads or article, outside or not article
            outside = outside or hidden or tag in OUTSIDE_TAGS or bool(words & OUTSIDE_WORDS)
            article = article or "main" in words and "content" not in words and tag == "div" or bool(words & ARTICLE_WORDS)
        self.stack.append((tag, outside, article, heads))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag not in BLOCK_TAGS:
            return
        self.close()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
            if tag in LEAF_TAGS and self.stack[k][0] not in LEAF_TAGS:
                break  # a stray end of a paragraph closes no container
        self.tag = self.stack[-1][0]


def blocks_of(page: str) -> list[Block]:
    split, at, size = Splitter(), 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            split.text(page[at:])
            break
        split.text(page[at:start])
        m = TAG.match(page, start)
        if not m:
            following = page[start + 1 : start + 2]
            if following.isalpha() or following in ("/", "!", "?", ""):
                if page.find(">", start) < 0:
                    break  # a tag cut off by the page's end
                at = page.find(">", start) + 1
                continue
            split.text("<")
            at = start + 1
            continue
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = size if stop < 0 else stop + 3
            continue
        if m.group(1):
            stop = page.find(">", start)
            at = size if stop < 0 else stop + 1
            continue
        closing, tag, attributes = (m.group(2), m.group(3), m.group(4)) if m.group(3) else (m.group(5), m.group(6), m.group(7))
        tag, at = tag.lower(), m.end()
        if closing:
            split.end(tag)
        elif tag in RAW_TAGS:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else size
        else:
            split.open(tag, attributes)
    split.close()
    return split.blocks


def judge_alone(block: Block, rules: Rules, marked: bool = False) -> str:
    """``marked``: the page marks its article, and the mark holds most of the plain text."""
    inside = marked and block.article
    if block.outside or block.link_density > rules.links + (rules.mark_links if inside else 0):
        return BAD
    if len(block.text) < rules.short or block.tag in HEADINGS:
        return NEAR if inside else SHORT
    stops = block.stop_density + (rules.mark_stops if inside else 0)
    if stops >= rules.high_stops and len(block.text) > rules.long:
        return NEAR if marked and not inside else GOOD
    if stops >= rules.low_stops:
        return SHORT if marked and not inside else NEAR
    return BAD


def nearest(decided: list[str | None]) -> tuple[list[str | None], list[str | None]]:
    """The nearest decided label before each block, and after it."""
    before: list[str | None] = []
    last: str | None = None
    for d in decided:
        before.append(last)
        last = d or last
    after: list[str | None] = [None] * len(decided)
    last = None
    for i in range(len(decided) - 1, -1, -1):
        after[i] = last
        last = decided[i] or last
    return before, after


def inherit(blocks: list[Block], marked: bool = False) -> None:
    """Second pass: both neighbours' common label, else good for near-good blocks and for headings before a good one.

    Marked blocks have only each other for neighbours, without what stands in adverts and the like between them.
    """
    decided = [b.label if b.label in (GOOD, BAD) else None for b in blocks]
    within = [d if b.article and not b.outside else None for b, d in zip(blocks, decided, strict=True)] if marked else decided
    everywhere, inside = nearest(decided), nearest(within)
    for i, (b, d) in enumerate(zip(blocks, decided, strict=True)):
        if d is None:
            x, y = (side[i] for side in (inside if marked and b.article else everywhere))
            if x == y or x is None or y is None:
                b.label = x or y or (GOOD if b.label == NEAR else BAD)
            elif b.label == NEAR or b.tag in HEADINGS:
                b.label = GOOD if b.label == NEAR or y == GOOD else BAD
            else:
                b.label = BAD


def mark_holds_text(blocks: list[Block], rules: Rules) -> bool:
    """Whether marked blocks hold at least half of the text that is neither outside nor links; not so for cards and teasers beside a story."""
    plain = [b for b in blocks if not b.outside and b.link_density <= rules.links]
    inside = sum(len(b.text) for b in plain if b.article)
    return inside > 0 and 2 * inside >= sum(len(b.text) for b in plain)


def labelled_blocks(page: str | None, rules: Rules = Rules()) -> list[Block]:
    blocks = blocks_of(page or "")
    marked = mark_holds_text(blocks, rules)
    for b in blocks:
        b.label = judge_alone(b, rules, marked)
    inherit(blocks, marked)
    return blocks


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    return "\n".join(b.text for b in labelled_blocks(page, rules) if b.label == GOOD)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every whole page.

    Null and empty pages, and pages without a good block, give the empty text.  Rows are read alone: repeated rows
    repeat, an empty table gives no rows, other columns are not read.
    """

    def start():
        def one(value: str | None) -> tuple:
            text = main_text(value, rules)
            return text, len(text)

        return one

    return map_texts(pages, [page_id, url], html, "text string, n_chars long", start)
