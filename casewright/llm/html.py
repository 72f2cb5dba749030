"""Main text of web pages by a linear-chain conditional random field.

A page is read once, without recursion, into leaf blocks: the text between
block-level tags, with references decoded and white space made single. A block
has features of its ancestors (tags, class, id and role words), of its text, and
of the prose that stands in the same element beside it; the field labels blocks
as article or not, and Viterbi's path is taken. It is trained here, on pages
that `labelled_page` writes in many layouts and whose labels are known; tests
hold it against layouts that it hasn't seen.

Defined cases: a null or empty page has no text; tags left open, stray end tags,
broken quotes and pages of any depth are read as far as they go; repeated rows
are pages of their own; an empty table gives no rows; the named columns alone
are read.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: A whole attribute, from left to right: its name, and its value in quotes or bare.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[a-z]+")
#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Open elements that a start tag closes by itself, up to the given bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_BOUNDS = frozenset("article section aside nav main header footer div td th li body html blockquote form table button".split())


class Model:
    """Weights of features, of the two labels' neighbourhoods and of the ends."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.grow = True
        self.weights = np.zeros(0)
        self.moves = np.zeros((2, 2))
        self.begin = np.zeros(2)

    def id(self, name: str) -> int | None:
        found = self.ids.get(name)
        if found is None and self.grow:
            found = self.ids[name] = len(self.ids)
        return found


def _own(model: Model, tag: str, attributes: str) -> tuple[list[int], bool]:
    """The features that an element gives to all within, and whether it is hidden."""
    names, hidden = [f"tag {tag}"] if tag not in INLINE else [], False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif kind == "hidden":
                hidden = True
            elif kind == "aria-hidden":
                hidden |= value == "true"
            elif kind in ("class", "id", "role"):
                found = dict.fromkeys(_WORD.findall(value))
                names += [f"{'role' if kind == 'role' else 'name'} {w}" for w in found]
                names += [f"stem {w}" for w in dict.fromkeys(w[:5] for w in found if len(w) > 4)]
    return [i for i in map(model.id, names) if i is not None], hidden


_BUCKETS = (1, 2, 3, 5, 8, 12, 20, 40, 80)
#: Elements that say what their content is for.
_SECTIONS = frozenset("article main section aside nav header footer form table".split())
#: Words of prose in the element around a block, of all blocks in it.
_KIN = (5, 12, 25, 60, 120, 250)
_HINTS = {
    "rights": re.compile(r"©|\(c\)|copyright|all rights reserved", re.I), "reply": re.compile(r"\b(?:reply|replies|comments?|says|said)\b", re.I), "share": re.compile(r"\b(?:share|tweet|subscribe|newsletter|sign up|log ?in|cookies?|privacy|advert\w*|sponsored|related|read more)\b", re.I),
    "bars": re.compile(r"(?:[^|·•»\n]{1,24}[|·•»] ?){1,12}[^|·•»\n]{1,24}"), "stamp": re.compile(r"\b(?:last (?:edited|updated|modified|changed)|updated on|terms of (?:use|service)|contact us|about us|site ?map|powered by)\b", re.I),
    "onward": re.compile(r"(?:related|more|other|recent|popular|latest|you (?:may|might)|see also|recommended|further)\b.{0,40}", re.I),
}
#: Hints that the whole of a short text must be.
_WHOLE = frozenset(("bars", "onward"))


def blocks(page: str, model: Model) -> tuple[list[str], list[list[int]]]:
    """The texts of a page's leaf blocks in order, and the features of each."""
    texts: list[str] = []
    features: list[list[int]] = []
    # an open element: tag, features of it and all around it, in a link, skipped, its number and that of the block around it
    stack: list[tuple[str, frozenset, bool, bool, int, int]] = [("", frozenset(), False, False, 0, 0)]
    made, kin, prose = 0, [], {}
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    home = stack[0]
    parent = ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                names = [f"parent {parent}", f"within {next((t[0] for t in reversed(stack) if t[0] in _SECTIONS), '')}/{parent}"]
                n = text.count(" ") + 1
                names += [f"words>{b}" for b in _BUCKETS if n > b]
                names += [f"links>{q}" for q in (0, 25, 50, 80) if linked * 100 > q * len(text)]
                names.append("ends" if text[-1] in ".!?…\"”»" else "open")
                commas = text.count(",")
                names += [f"commas>{b}" for b in (0, 2) if commas > b]
                names += [f"hint {k}" for k, rx in _HINTS.items() if (rx.fullmatch(text[:300]) if k in _WHOLE else rx.search(text))]
                features.append([*home[1], *(i for i in map(model.id, names) if i is not None)])
                texts.append(text)
                kin.append(home[5])
                if linked * 2 <= len(text):
                    prose[home[5]] = prose.get(home[5], 0) + n
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal linked, home, parent
        top = stack[-1]
        if raw and not top[3]:
            text = html.unescape(raw) if "&" in raw else raw
            if not parts or not "".join(parts[-1:]).strip():
                home = next(t for t in reversed(stack) if t[0] not in INLINE)
                if top is not home:  # what inline elements around the text say of it
                    home = (home[0], top[1], *home[2:])
                parent = home[0]
            parts.append(text)
            if top[2]:
                linked += len(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        say(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ") if parts else None
            continue
        if tag not in INLINE:
            flush()
        if ends:
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and open_.get("p"):  # a block closes an open paragraph around it
            k = len(stack) - 1
            while k and stack[k][0] != "p" and stack[k][0] not in _P_BOUNDS:
                k -= 1
            if stack[k][0] == "p":
                pop_to(k)
        if tag in CLOSES:
            shut, bounds = CLOSES[tag]
            if any(open_.get(t) for t in shut):
                k = len(stack) - 1
                while k and stack[k][0] not in shut and stack[k][0] not in bounds:
                    k -= 1
                if stack[k][0] in shut:
                    pop_to(k)
        if tag == "body" and open_.get("head"):
            k = len(stack) - 1
            while stack[k][0] != "head":
                k -= 1
            pop_to(k)
        top = stack[-1]
        own, hidden = _own(model, tag, attributes)
        around = top[1].union(own) if own else top[1]
        made += 1
        block = next(t for t in reversed(stack) if t[0] not in INLINE)
        stack.append((tag, around, top[2] or tag == "a", top[3] or hidden or tag in SKIPPED, made, block[4]))
        open_[tag] = open_.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    most = max(prose.values(), default=0)
    few = [i for i in map(model.id, (f"blocks<{b}" for b in (2, 3, 5, 9) if len(texts) < b)) if i is not None]
    for k, own in enumerate(kin):
        n = prose.get(own, 0)
        names = [f"kin>{b}" for b in _KIN if n > b] + (["kin most"] if n and n == most else [])
        features[k] += [*few, *(i for i in map(model.id, names) if i is not None)]
    return texts, features


def viterbi(scores: np.ndarray | list[float], model: Model) -> list[int]:
    """The best labels, where `scores` are those of label 1 against label 0."""
    (m00, m01), (m10, m11) = model.moves.tolist()
    b0, b1 = model.begin.tolist()
    back = []
    s0 = s1 = 0.0
    for k, x in enumerate(scores):
        if k == 0:
            s0, s1 = b0, b1 + x
            continue
        from0, from1 = s0 + m01 > s1 + m11, s0 + m00 >= s1 + m10
        back.append((0 if from1 else 1, 0 if from0 else 1))
        s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11) + x
    label, out = int(s1 > s0), []
    for step in reversed(back):
        out.append(label)
        label = step[label]
    return [label, *reversed(out)] if len(scores) else []


def main_text(page: str | None, model: Model | None = None) -> str:
    """The article of a page: its blocks, joined by a space."""
    if not page:
        return ""
    model = model or trained()
    texts, features = blocks(page, model)
    if not texts:
        return ""
    weights = model.weight_list
    labels = viterbi([sum(weights[i] for i in f) for f in features], model)
    return " ".join(t for t, y in zip(texts, labels, strict=True) if y)


_SYLLABLES = "the and ing er on re an in ed st ti or es at ou ve ma lo sa ka mi ro ne que la des pour ment eau ung sch keit für über ción ado los ñ é ö".split()


def _words(rng: random.Random, n: int, end: str = "") -> str:
    out = [("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3)))) + ("," if rng.random() < 0.08 else "") for _ in range(n)]
    return " ".join(out).strip(",").capitalize() + end


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made page in one of many layouts, and the label of each of its blocks in order."""
    labels: list[int] = []

    def text(n: int, label: int, end: str = "") -> str:
        labels.append(label)
        body = _words(rng, n, end)
        if rng.random() < 0.25 and n > 3:
            a = body.split(" ")
            k = rng.randrange(len(a))
            a[k] = rng.choice(("<b>{}</b>", "<i>{}</i>", "<a href='/x'>{}</a>", "<em>{}</em>", "<code>{}</code>")).format(a[k])
            body = " ".join(a)
        return body + (" &amp; co" if rng.random() < 0.05 else "")

    def prose(label: int) -> str:
        body = text(rng.choice((1, 2, 3, 8, 15, 30, 60, 120)), label, rng.choice((*".....!?", "")))
        if rng.random() < 0.05:  # words of the hints stand anywhere in articles, and at an end of what is around them
            word = rng.choice(("copyright", "said", "comments", "privacy", "related"))
            at = [i for i, c in enumerate(body) if c == " " and "<" not in body]
            if not label:
                body += rng.choice((" All rights reserved.", " Reply", " Share", " Copyright 2024"))
            elif at:
                k = rng.choice(at)
                body = f"{body[:k]} {word}{body[k:]}"
        return body

    def links(n: int, sep: str) -> str:
        out = []
        for _ in range(n):
            labels.append(0)
            out.append(sep.format(f'<a href="/{rng.random()}">{_words(rng, rng.randint(1, 3))}</a>'))
        return "".join(out)

    def name(*choices: str) -> str:
        word = rng.choice(choices)
        word = rng.choice((word, word + str(rng.randint(1, 9)), "site-" + word, word + "-box", word + " " + rng.choice(("wide", "left", "block", "container"))))
        return rng.choice((' class="{}"', ' id="{}"', " class='{}'")).format(word)

    def vague() -> str:
        """Attributes that say nothing."""
        some = (f"c{rng.randint(1, 99)}", f"css-{rng.randrange(16**5):x}", "wrapper", "container", "inner", "row", f"col-md-{rng.randint(2, 12)}", "page", "layout", "grid", "wide", f"x{rng.randint(1, 9)} y{rng.randint(1, 9)}")
        return rng.choice(("", f" class='{rng.choice(some)}'", f' id="{rng.choice(some)}"'))

    def wrapped(body: str) -> str:
        while rng.random() < 0.25:
            tag = rng.choice(("div", "div", "section"))
            body = f"<{tag}{vague()}>{body}</{tag}>"
        return body

    def bar() -> str:
        """A menu in a single block, with or without links."""
        labels.append(0)
        parts = rng.sample(("Home", "About", "Contact", "News", "Shop", "Blog", "Help", _words(rng, 1), _words(rng, 2), _words(rng, 1)), rng.randint(2, 6))
        if rng.random() < 0.5:
            parts = [f"<a href='/{k}'>{p}</a>" for k, p in enumerate(parts)]
        return rng.choice((" | ", "|", " · ", " » ", " • ")).join(parts)

    def menu() -> str:
        if rng.random() < 0.15:
            return rng.choice(("<div{}>{{}}</div>", "<p{}>{{}}</p>", "<table><tr><td{}>{{}}</td></tr></table>", "<center{}>{{}}</center>")).format(vague()).format(bar())
        inner = "<ul>" + links(rng.randint(2, 8), rng.choice(("<li>{}</li>", "<li>{}"))) + "</ul>"
        return rng.choice((f"<nav>{inner}</nav>", f"<div{name('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar')}>{inner}</div>", f'<div role="navigation">{inner}</div>', f"<nav{name('menu', 'main')}>{inner}</nav>"))

    def small() -> str:
        """Something that isn't the article, and that may stand anywhere."""
        kind = rng.randrange(11)
        if kind == 9:  # links without a list or a telling name
            return f"<div{vague()}>" + links(rng.randint(2, 6), rng.choice(("<p>{}</p>", "<div>{}</div>"))) + "</div>"
        if kind == 10:
            labels.append(0)
            return f"<div{vague()}>" + rng.choice((" | ", " ", " &middot; ")).join(f"<a href='/{k}'>{_words(rng, rng.randint(1, 2))}</a>" for k in range(rng.randint(2, 7))) + "</div>"
        if kind == 0:
            return f"<div{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'banner', 'adsense')}>" + rng.choice(("<p>{}</p>", "{}")).format(prose(0)) + "</div>"
        if kind == 1:
            return f"<div{name('cookie', 'consent', 'notice', 'alert', 'popup', 'modal', 'gdpr', 'warning', 'message', 'banner')}>" + rng.choice(("<p>{}</p>", "{}")).format(prose(0)) + "</div>"
        if kind == 2:
            return f"<form action='/s'{name('search', 'newsletter', 'subscribe', 'signup', 'login', 'contact')}><label>" + text(2, 0) + "</label><p>" + prose(0) + "</p><button>" + text(1, 0) + "</button></form>"
        if kind == 3:
            return f"<div{name('share', 'social', 'related', 'tags', 'pagination', 'pager', 'recommended', 'more')}>" + links(rng.randint(1, 5), rng.choice(("<span>{}</span><p></p>", "<p>{}</p>"))) + "</div>"
        if kind == 4:
            return f"<aside{rng.choice(('', name('sidebar', 'widget', 'infobox', 'related')))}><h3>" + text(2, 0) + "</h3><p>" + prose(0) + "</p></aside>"
        if kind == 5:
            return f"<div{name('sidebar', 'widget', 'side', 'rail')}><h4>" + text(2, 0) + "</h4><p>" + prose(0) + "</p><ul>" + links(rng.randint(1, 4), "<li>{}</li>") + "</ul></div>"
        if kind == 6:
            return '<div style="display: none"><p>' + _words(rng, 5) + "</p></div><!-- <p>" + _words(rng, 4) + "</p> -->"
        if kind == 7:
            return "<script>var a = '<p>" + _words(rng, 5) + "</p>';</script><style>p { margin: 0 }</style>"
        return f"<section{name('newsletter', 'subscribe', 'promo', 'notice')}><p>" + prose(0) + "</p></section>"

    def comments() -> str:
        item = lambda: rng.choice(("<div class='comment'><b>{1}</b><p>{0}</p></div>", "<li class='reply'><p>{1}</p><p>{0}</p></li>", "<article class='comment'><p>{1}</p><p>{0}</p></article>"))
        named = name("comments", "responses", "disqus", "discussion", "comment-list", "replies", "respond", "comment-section")
        tag = rng.choice(("section", "div", "ul", "ol"))
        out, close = f"<{tag}{named}>", f"</{tag}>"
        if tag == "section":
            out += "<h2>" + text(2, 0) + "</h2>"
        item = (lambda: rng.choice(("<li><p>{1}</p><p>{0}</p></li>", "<li class='item'><b>{1}</b><p>{0}</p>"))) if tag in ("ul", "ol") else item
        for _ in range(rng.randint(1, 4)):
            form = item()
            who = text(rng.randint(1, 3), 0)
            out += form.format(prose(0), who)
        return out + close

    def article() -> str:
        if rng.random() < 0.08:  # text without paragraphs is one block
            labels.append(1)
            body = rng.choice(("<br><br>", "<br>", "<br />\n")).join(_words(rng, rng.choice((15, 30, 60, 90)), ".") for _ in range(rng.randint(1, 4)))
            return rng.choice((f"<div{vague()}>{body}</div>", f"<article>{body}</article>", f"<div{name('content', 'main', 'text', 'entry')}>{body}</div>", f"<td>{body}</td>"))
        body = ""
        if rng.random() < 0.88:
            title = text(rng.randint(2, 14), 1)
            level = rng.choice(("h1", "h1", "h2"))
            body += f"<header><{level}>{title}</{level}></header>" if rng.random() < 0.2 else f"<{level}>{title}</{level}>"
        if rng.random() < 0.2:
            body += "<p>" + text(rng.randint(2, 5), 1, ".") + "</p>"
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.05:
                body += "<dl>" + "".join("<dt>" + text(rng.choice((1, 2, 4)), 1) + rng.choice(("</dt>", "")) + "<dd>" + prose(1) + rng.choice(("</dd>", "")) for _ in range(rng.randint(1, 5))) + "</dl>"
            elif kind < 0.62:
                body += "<p>" + prose(1) + rng.choice(("</p>", "</p>", "", "<br>"))
            elif kind < 0.7:
                body += "<p><b>" + prose(1) + rng.choice(("<br>", "</b></p>", "</p>"))
            elif kind < 0.76:
                body += "<h2>" + text(rng.randint(1, 8), 1) + "</h2>"
            elif kind < 0.82:
                tag = rng.choice(("ul", "ol"))
                body += f"<{tag}>" + "".join("<li>" + text(rng.choice((2, 6, 14)), 1) + "</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
            elif kind < 0.86:
                body += "<blockquote><p>" + prose(1) + "</p></blockquote>"
            elif kind < 0.89:
                body += "<table><tr><td>" + text(2, 1) + "</td><td>" + text(3, 1) + "</td></tr></table>"
            elif kind < 0.92:
                body += "<pre>" + text(6, 1) + "</pre>"
            elif kind < 0.94:
                body += "<figure><img src='a.png'><figcaption>" + text(5, 1) + "</figcaption></figure>"
            else:
                body += small()
        if rng.random() < 0.15:  # what leads on from the article, in the article's own element
            tag = rng.choice(("h2", "h3", "h4", "p"))
            labels.append(0)
            body += f"<{tag}>" + rng.choice(("Related stories", "Related", "More from this section", "You may also like", "Recent posts", "Popular now", "Recommended for you", f"Other {_words(rng, 1).lower()}")) + f"</{tag}>" + rng.choice(("<ul>{}</ul>", "{}", "<div>{}</div>")).format(links(rng.randint(1, 5), "<li>{}</li>"))
        if rng.random() < 0.12:
            body += comments()
        kind = rng.random()
        if kind < 0.42:
            return f"<article{rng.choice(('', vague(), name('post', 'entry', 'story')))}>{body}</article>"
        if kind < 0.56:
            return f"<main{vague()}>{body}</main>"
        if kind < 0.8:
            return rng.choice((f"<div{vague()}>{body}</div>", f"<section{vague()}>{body}</section>", f"<table><tr><td>{body}</td></tr></table>", body))
        return f"<div{name('content', 'post', 'article', 'entry', 'story', 'main', 'text', 'body')}>{body}</div>"

    if rng.random() < 0.06:  # hardly any markup
        labels.append(1)
        return rng.choice(("{}", "<p>{}", "<p>{}</p>", "<div>{}</div>", "<h1>{}</h1>", "<html><body><p>{}</p></body></html>", "<body>{}</body>")).format(_words(rng, rng.choice((1, 2, 3, 5, 8, 20, 60)), rng.choice((".", "", "!")))), labels
    title = _words(rng, 6)
    out = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    if rng.random() < 0.6:
        out += rng.choice(("<header{}>", "<div{}>")).format(name("header", "masthead", "top", "site-header")) + "<p>" + text(rng.randint(1, 6), 0) + "</p>" + menu() + "{}"
        out = out.replace("{}", "</header>" if "<header" in out else "</div>")
    else:
        out += menu()
    for _ in range(rng.choice((0, 1, 1, 2))):
        out += wrapped(small())
    out += wrapped(article())
    for _ in range(rng.choice((0, 0, 1, 2))):
        out += wrapped(small())
    if rng.random() < 0.35:
        out += comments()
    foot = rng.choice(("&copy; ", "Copyright ", "", "© 2024 "))
    if rng.random() < 0.85:
        tag = rng.choice(("footer", "footer", f"div{name('footer', 'bottom', 'copyright', 'legal', 'foot')}"))
        if rng.random() < 0.35:  # a list of lines or links
            lines = [rng.choice(("This page was last edited on {0}.", "Last updated: {0}", "Contact us", "Terms of use", "{0}", "Powered by {0}", "<a href='/p'>{0}</a>", "Text is available under {0}.")).format(_words(rng, rng.randint(1, 5))) for _ in range(rng.randint(1, 5))]
            labels += [0] * len(lines)
            out += f"<{tag}><ul>" + "".join(f"<li>{x}</li>" for x in lines) + "</ul>" + f"</{tag.split(' ')[0]}>"
            return out + rng.choice(("</body></html>", "")), labels
        labels.append(0)
        out += f"<{tag}>" + foot + _words(rng, rng.choice((2, 6, 12, 25)), rng.choice(("", "."))) + f"</{tag.split(' ')[0]}>"
    return out + rng.choice(("</body></html>", "")), labels


def train(pages: list[tuple[str, list[int]]], rounds: int = 200, penalty: float = 0.002) -> Model:
    """A model from labelled pages: the exact gradient of the field's likelihood, by Adam.

    Pages whose blocks are read otherwise than they were labelled are left out.
    """
    model = Model()
    xs, ys, sizes = [], [], []
    for page, labels in pages:
        texts, features = blocks(page, model)
        if len(texts) == len(labels) and labels:
            xs += features
            ys += labels
            sizes.append(len(labels))
    model.grow = False
    x = np.zeros((len(xs), len(model.ids)), np.float32)
    for k, f in enumerate(xs):
        x[k, f] = 1
    y, n, longest = np.array(ys), len(sizes), max(sizes)
    starts = np.cumsum(sizes) - sizes
    at = starts[:, None] + np.arange(longest)
    real = np.arange(longest)[None, :] < np.array(sizes)[:, None]
    at = np.where(real, at, 0)
    label = y[at]
    w, moves, begin = np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves, begin)]
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for step in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[..., 1] = (x @ w.astype(np.float32))[at]
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = begin + score[:, 0]
        for t in range(1, longest):
            fore[:, t] = np.where(real[:, t, None], lse((fore[:, t - 1, :, None] + moves).transpose(0, 2, 1)) + score[:, t], fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            aft[:, t] = np.where(real[:, t + 1, None], lse(moves[None] + (score[:, t + 1] + aft[:, t + 1])[:, None, :]), aft[:, t + 1])
        total = lse(fore[:, -1])
        p = np.exp(fore + aft - total[:, None, None])
        gap = np.where(real, (label == 1) - p[..., 1], 0.0)
        g_w = x.T @ np.bincount(at[real], gap[real], len(y)).astype(np.float32) / n - penalty * w / 10
        pair = fore[:, :-1, :, None] + moves + (score[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None]
        two = real[:, 1:]
        expected = np.exp(pair)[two].sum(axis=0)
        seen = np.array([[np.sum(two & (label[:, :-1] == a) & (label[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)])
        g_moves = (seen - expected) / n - penalty * moves / 10
        g_begin = np.array([np.mean(label[:, 0] == a) for a in (0, 1)]) - p[:, 0].mean(axis=0) - penalty * begin / 10
        for p_, g, (m, v) in zip((w, moves, begin), (g_w, g_moves, g_begin), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves, model.begin = w, moves, begin
    model.weight_list = w.tolist()
    return model


@functools.lru_cache(maxsize=2)
def trained(seed: int = 0, count: int = 1600) -> Model:
    """The model of `count` made pages."""
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(count)])


_DDL = "page_id bigint, url string, text string, n_chars bigint"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extractor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(page, model) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. The model travels with the tasks."""
    part = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return part.mapInArrow(_extractor(model or trained()), _DDL)
