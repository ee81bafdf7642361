"""Leaf blocks of web pages: runs of text between block-level tags, with their ancestors and what a labeller looks at.

The reader takes broken markup as it comes: unclosed and crossing tags, upper case, attributes with and without quotes,
comments, raw-text elements. It never fails, keeps all text outside of elements that hold none, and reads a page of any
length and nesting in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of the markup language: elements without content, inside a line, with raw text, and those that hold no text to read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SILENT = frozenset("script style title head template noscript iframe noembed noframes svg math canvas object audio video select textarea datalist".split())
#: A start tag ends open elements of these kinds, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot select nav article main section aside header footer form div body".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Tags and attribute words that features speak of; others say nothing.
TAGS = frozenset("article main section nav header footer aside form ul ol li table td th p div h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button a dl dt dd details summary address center".split())
HINTS = frozenset(
    "article post entry story content body main text page "
    "nav menu navbar breadcrumb breadcrumbs header masthead footer foot sidebar aside widget related recommended share social tags tag meta byline author date "
    "ad ads advert advertisement promo promoted sponsor sponsored banner cookie consent notice alert popup modal overlay newsletter subscribe signup login search form "
    "comment comments reply respond discussion disqus pager pagination copyright legal logo skip toolbar top bottom teaser list".split()
)


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of its ancestors, those that features speak of
    hints: frozenset[str]  # words in their classes, ids and roles, likewise
    link_chars: int
    features: list[str] = field(default_factory=list)
    own: str = "none"  # the innermost ancestor that is no inline element
    last: frozenset[str] = frozenset()  # words of the innermost ancestor that has any


class Open:
    """An open element; what its descendants need of all its ancestors is kept here, shared where it does not change."""

    __slots__ = ("tag", "up", "tags", "hints", "last", "own", "inline", "near")

    def __init__(self, tag: str, words: list[str], up: Open | None) -> None:
        self.tag, self.up = tag, up
        tags, hints, inline = (up.tags, up.hints, up.inline) if up else (EMPTY, EMPTY, EMPTY)
        self.tags = tags | {tag} if tag in TAGS and tag not in tags else tags
        said = frozenset(w for w in words if w in HINTS) if tag not in WHOLE else EMPTY
        self.hints = hints if said <= hints else hints | said
        self.last = said or (up.last if up else EMPTY)
        if tag in INLINE:
            self.own = up.own if up else "none"
            self.inline = inline if tag in inline else inline | {tag}
        else:
            self.own, self.inline = tag, EMPTY
        #: The nearest element, this one included, that can end where a block begins.
        self.near = self if tag in ENDING else up.near if up else None


EMPTY: frozenset[str] = frozenset()
#: Elements whose words speak of the page, not of a block.
WHOLE = ("html", "body")
ENDING = CONTAINERS | {"p"} | frozenset().union(*CLOSES.values())


def words_of(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [w for m in NAMES.finditer(attributes) for w in PART.findall((m[1] or m[2] or m[3] or "").lower())]


class Tags:
    """The tags of a page from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside of quotes; if there is none, at the first one. That there is none is found
    by a walk to the page's end; the places such walks have passed are remembered, so no stretch is walked twice.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.doomed: set[int] = set()

    def end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``."""
        page, first, passed = self.page, at, []
        while at not in self.doomed:
            passed.append(at)
            at = PLAIN.match(page, at).end()
            if at >= len(page):
                break
            q = page[at]
            if q == ">":
                return at
            if self.quotes[q] <= at:
                break
            at = page.index(q, at + 1) + 1
        self.doomed.update(passed)
        return page.index(">", first)

    def find(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """``begin, end, name, closing, attributes`` of the next tag, comment or declaration from ``at``; those without text have no name."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", False, ""
            if at > self.last:
                if (at := page.find("<!--", at)) < 0:
                    return None
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.index(">", at) + 1, "", False, ""
            closing = page.startswith("/", at + 1)
            if m := NAME.match(page, at + 1 + closing):
                end = self.end(m.end())
                return at, end + 1, m[0].lower(), closing, page[m.end() : end]
            at += 1


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page, in its order; the time is linear in the page's length, however it is nested."""
    found: list[Block] = []
    top: Open | None = None
    open_: Counter[str] = Counter()
    parts: list[str] = []
    at, links, silent = 0, 0, 0
    tags = Tags(page)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, top.tags if top else EMPTY, top.hints if top else EMPTY, links, [], top.own if top else "none", top.last if top else EMPTY))
            parts, links = [], 0

    def take(raw: str) -> None:
        nonlocal links
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_["a"]:
                links += len(text.strip())

    def leave(last: Open) -> None:
        """Closes the elements down to ``last``, itself included."""
        nonlocal silent, top
        while True:
            gone, top = top, top.up
            open_[gone.tag] -= 1
            silent -= gone.tag in SILENT
            if gone is last:
                return

    def nearest(name: str) -> Open:
        e = top
        while e.tag != name:
            e = e.up
        return e

    n = len(page)
    while at < n:
        m = tags.find(at)
        if m is None:
            take(page[at:])
            break
        begin, end, name, closing, attributes = m
        take(page[at:begin])
        at = end
        if not name:
            continue
        if name == "br" or name == "wbr":
            if not silent and name == "br":
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            # an inline element ends only where nothing but inline elements is open in it
            if name in top.inline if name in INLINE and top else open_[name]:
                leave(nearest(name))
            continue
        if name in VOID:
            continue
        if name not in INLINE and top:
            # a paragraph ends where another block begins, and inline elements end with it
            kinds, e = CLOSES.get(name, EMPTY), top.near
            while e and e.tag not in kinds and e.tag != "p" and e.tag not in CONTAINERS:
                e = e.up.near if e.up else None
            if e and (e.tag in kinds or e.tag == "p"):
                leave(e)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name not in SILENT:
                take(page[at : stop.start() if stop else n])
            at = stop.end() if stop else n
            continue
        if attributes.rstrip().endswith("/") and name in ("svg", "path", "math"):
            continue
        if name == "body" and silent and open_["head"]:
            leave(nearest("head"))
        top = Open(name, words_of(attributes), top)
        open_[name] += 1
        silent += name in SILENT
    flush()
    return found


PHRASES = re.compile(
    r"©|\bcopyright\b|all rights reserved|cookie|subscribe|newsletter|sign (?:in|up)|log in|advert|sponsored|privacy|terms of|read more|share this|related|repl(?:y|ies)|comments?\b|posted by|click here|menu|search", re.I
)
STOP = tuple(".!?…。\"”»:;)")


def describe(found: list[Block]) -> None:
    """Fills in each block's features, from its ancestors, its text and its place."""
    last, articles = len(found) - 1, any("article" in b.tags for b in found)
    for i, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        path, own = b.tags, b.own
        linked = b.link_chars / n
        f = ["bias", f"own={own if own in TAGS else 'other'}", f"length={min(n.bit_length(), 11)}", f"words={min(words.bit_length(), 8)}"]
        f += [f"in={t}" for t in path]
        f += [f"name={w}" for w in b.hints]
        f += [f"last={w}" for w in b.last]
        if articles and "article" not in path:
            f.append("apart")
        f.append("links=" + ("none" if linked == 0 else "some" if linked < 0.3 else "many" if linked < 0.8 else "all"))
        f.append("stop" if b.text.endswith(STOP) else "no stop")
        if n < 240 and PHRASES.search(b.text):
            f.append("phrase")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            f.append("marks")
        if i == 0:
            f.append("first")
        if i == last:
            f.append("last")
        f.append(f"place={4 * i // (last + 1)}")
        if not path & {"article", "main"}:
            f.append("outside")
            if own == "p" and n > 120 and linked < 0.3:
                f.append("outside paragraph")
        b.features = f
