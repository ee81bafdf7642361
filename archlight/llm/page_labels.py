"""Labelled pages to train on: drawn layouts in which every block is known to be main text or not.

Layouts vary in the article's container, in what surrounds it and in how careful the markup is. Words are drawn from
syllables, so only structure and shape can be learned.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ba be bi co da do en er fa ga hi in ka la le li ma me mi mo na ne no on or pa per ra re ri ro sa se si so ta te ti to un ur va ve vi".split()


def labelled_pages(count: int, seed: int = 7) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Pages, each with its blocks' texts and whether they are main text, in page order."""
    draw = random.Random(seed)
    return [page(draw) for _ in range(count)]


def page(draw: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    out: list[str] = []
    truth: list[tuple[str, bool]] = []
    chance = lambda p: draw.random() < p
    word = lambda: "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    sentence = lambda a=3, b=18: words(a, b).capitalize() + draw.choice("....!?")
    attribute = lambda *names: draw.choice(("", f' class="{draw.choice(names)}"', f" class='{draw.choice(names)}'", f' id="{draw.choice(names)}"'))
    named = lambda *names: f' {draw.choice(("class", "id"))}="{draw.choice(names)}"'

    def say(text: str, main: bool, before: str = "", after: str = "") -> None:
        shown = html.escape(text) if chance(0.8) else text
        out.append(f"{before}{shown}{after}")
        truth.append((text, main))

    def links(tag: str, n: int) -> None:
        for _ in range(n):
            say(words(1, 3).capitalize(), False, f'<{tag}><a href="/{word()}">', f"</a></{tag}>" if chance(0.9) else "</a>")

    def listing(names: tuple[str, ...], outer: str | None) -> None:
        box = outer or draw.choice(("nav", "div", "section"))
        out.append(f"<{box}{named(*names) if box != 'nav' else attribute(*names)}>" + "<ul>")
        links("li", draw.randint(2, 8))
        out.append(f"</ul></{box}>")

    def advert() -> None:
        box = draw.choice(("div", "aside", "section"))
        out.append(f"<{box}{named('ad', 'ads', 'advert', 'ad-slot', 'promo', 'sponsored', 'banner-ad')}>")
        for _ in range(draw.randint(1, 2)):
            say(" ".join(sentence() for _ in range(draw.randint(1, 3))), False, *draw.choice((("", ""), ("<p>", "</p>"), ("<span>", "</span>"))))
            out.append("<hr>")
        out.append(f"</{box}>")

    def notice() -> None:
        out.append(f"<div{named('cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'subscribe-box', 'popup')}>")
        say(draw.choice(("This site uses cookies. ", "Subscribe to our newsletter. ", "Please note. ", "")) + sentence(), False, "<p>", "</p>")
        if chance(0.5):
            say(draw.choice(("Accept", "Close", "OK", "Sign up")), False, "<button>", "</button>")
        out.append("</div>")

    def form() -> None:
        out.append(f"<form{attribute('search', 'login', 'signup', 'contact')}>")
        for _ in range(draw.randint(1, 3)):
            say(words(1, 3).capitalize(), False, "<div><label>", '</label><input type="text"></div>')
        say(draw.choice(("Search", "Send", "Log in", "Submit")), False, "<button>", "</button>")
        out.append("</form>")

    def sidebar() -> None:
        box = draw.choice(("aside", "div"))
        out.append(f"<{box}{named('sidebar', 'side-bar', 'widget', 'related', 'recommended') if box == 'div' else attribute('sidebar', 'related', 'widget')}>")
        say(words(1, 3).capitalize(), False, "<h3>", "</h3>")
        for _ in range(draw.randint(1, 4)):
            if chance(0.5):
                say(sentence(), False, "<p>", "</p>")
            else:
                say(words(2, 7).capitalize(), False, f'<div><a href="/{word()}">', "</a></div>")
        out.append(f"</{box}>")

    def comments() -> None:
        box = draw.choice(("section", "div"))
        out.append(f"<{box}{named('comments', 'comment-list', 'comments-area', 'discussion', 'respond', 'replies')}>")
        title = draw.choice(("Comments", f"{draw.randint(2, 90)} comments", "Discussion", "Replies", f"{draw.randint(1, 9)} thoughts on “{words(2, 6)}”", f"What do you think of {words(1, 4)}?"))
        say(title, False, *draw.choice((("<h3>", "</h3>"), ('<h2 class="comments-title">', "</h2>"), ("<h2>", "</h2>"))))
        for _ in range(draw.randint(1, 6)):
            out.append(draw.choice(('<div class="comment">', "<div>", "<li>", '<li class="comment">', "<article class='comment'>")))
            kind = out[-1].strip("<>").split(" ")[0]
            if chance(0.6):
                say(words(1, 2).title() + draw.choice(("", " says:", ", 3 days ago")), False, "<div>", "</div>")
            say(" ".join(sentence() for _ in range(draw.randint(1, 4))), False, *draw.choice((("<p>", "</p>"), ('<div class="comment-content"><p>', "</p></div>"), ('<div class="comment-body">', "</div>"))))
            if chance(0.3):
                say("Reply", False, '<div><a class="comment-reply-link" href="#">', "</a></div>")
            out.append(f"</{kind}>")
        out.append(f"</{box}>")

    def rough(text: str) -> str:
        """Articles hold lines without stops, separators, marks, numbers, notices and shouting as well."""
        kind = draw.random()
        if kind < 0.12:
            return text.rstrip(".!?")
        if kind < 0.18:
            return " | ".join(text.split(" ")) + (" |" if chance(0.5) else "")
        if kind < 0.23:
            return " ".join(w + draw.choice(("", "", "***", "&&&", "$$$", "!!")) for w in text.split(" "))
        if kind < 0.28:
            return text + draw.choice((f" {draw.randint(10**6, 10**15)}", f" {word()}@{word()}.example", f" {word()}={draw.getrandbits(60):x}"))
        if kind < 0.31:
            return text.upper()
        if kind < 0.36:
            return draw.choice(("All rights reserved.", "Copyright " + words(1, 3), "Subscribe " + words(1, 4) + ".", "Comments on " + words(2, 6), "Licensed under " + words(1, 5) + ".", "Click here " + words(1, 3)))
        return words(1, 3).capitalize() + draw.choice((".", "")) if kind < 0.42 else text

    def paragraph() -> None:
        text = rough(" ".join(sentence() for _ in range(1 if chance(0.25) else draw.randint(2, 9))))
        style = draw.random()
        if style < 0.7:
            say(text, True, "<p>", "</p>" if chance(0.85) else "")
        elif style < 0.8:
            say(text, True, "<p><b>", "<br>" if chance(0.5) else "</b></p>")
        elif style < 0.9:
            say(text, True, "<div>", "</div>")
        else:
            say(text, True, "<P>", "</P>")

    def article() -> None:
        kind = draw.random()
        if kind < 0.5:
            opening, closing = f"<article{attribute('post', 'story', 'entry', 'article')}>", "</article>"
        elif kind < 0.7:
            opening, closing = f"<main{attribute('content', 'main')}>", "</main>"
        else:
            opening, closing = f"<div{named('content', 'post-content', 'article-body', 'entry', 'main-text', 'story')}>", "</div>"
        out.append(opening)
        if chance(0.75):
            say(words(3, 12).capitalize(), True, "<h1>", "</h1>")
        if chance(0.3):
            say(f"By {words(1, 2).title()}, {draw.randint(1, 28)} May", False, f"<div{named('byline', 'meta', 'author')}>", "</div>")
        for k in range(1 if chance(0.12) else draw.randint(2, 14)):
            if k and chance(0.12):
                say(words(2, 6).capitalize(), True, "<h2>", "</h2>")
            if k and chance(0.06):
                advert()
            if chance(0.07):
                out.append("<ul>")
                for _ in range(draw.randint(2, 5)):
                    say(sentence(3, 9) if chance(0.7) else words(2, 6), True, "<li>", "</li>")
                out.append("</ul>")
            elif chance(0.05):
                say(sentence(5, 25), True, "<blockquote>", "</blockquote>")
            else:
                paragraph()
        if chance(0.2):
            out.append(f"<div{named('share', 'social', 'tags')}>")
            links("span", 1)
            out.append("</div>")
        out.append(closing)

    out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(3, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
    if chance(0.4):
        box = draw.choice(("header", "div"))
        out.append(f"<{box}{named('header', 'masthead', 'top') if box == 'div' else attribute('header')}>")
        say(words(1, 3).title(), False, "<div>", "</div>")
        if chance(0.4):
            say(sentence(3, 7), False, "<p>", "</p>")
        out.append(f"</{box}>")
    if chance(0.85):
        listing(("nav", "menu", "navbar", "main-menu"), None)
    for extra in (notice, advert, form, sidebar):
        if chance(0.4):
            if chance(0.3):
                out.append(f"<!-- {word()} -->")
            extra()
    around = draw.choice(("main", "div")) if chance(0.35) else ""
    if around:
        # all but the page's own head and foot lies in one container
        out.append(f"<{around}{named('content', 'main', 'container', 'site-content', 'page')}>")
    if chance(0.2):
        listing(("breadcrumb", "breadcrumbs"), "div")
    article()
    for extra, p in ((comments, 0.4), (sidebar, 0.35), (advert, 0.3), (form, 0.25), (notice, 0.2)):
        if chance(p):
            extra()
    if around:
        out.append(f"</{around}>")
    if chance(0.9):
        box = draw.choice(("footer", "footer", "div"))
        out.append(f"<{box}{named('footer', 'foot', 'copyright') if box == 'div' else attribute('footer')}>")
        say(draw.choice(("© " + word() + ".example · " + sentence(), "Copyright " + words(2, 4) + ". All rights reserved.", sentence())), False, *draw.choice((("", ""), ("<p>", "</p>"))))
        out.append(f"</{box}>")
    if chance(0.9):
        out.append("</body></html>")
    return "".join(out), truth
