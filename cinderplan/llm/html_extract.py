"""Main-text extraction from HTML: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A tolerant parser builds the block-level tree. Every block-level node gets features (tag, attribute tokens of its own
and its ancestors, depth, subtree density, link density, sibling statistics) and the trees' log-odds that main text lies
below it. Decoding picks the likeliest labelling in which nothing below a rejected node is accepted (bottom-up sums,
so that ancestor and descendant never contradict each other). Texts of accepted nodes are the blocks of the result.

The trees are trained once a process on pages that ``synthetic_page`` makes with known labels (fixed seed).

Defined results: null and empty html give an empty text, as do pages without any accepted text; white space (Unicode's)
inside a block becomes one space; markup of any brokenness is parsed; repeated rows are extracted each; a page is one
value and the unit of memory.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderplan.llm import boosting
from cinderplan.llm.common import pieces

# Elements by their role in HTML, and words that site authors use in class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg head title iframe object button select option textarea math canvas audio video map datalist".split())
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend hgroup details summary dialog center menu search label".split())
CLOSES_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend", "summary", "label"}
SCOPE = {"html", "body", "article", "main", "section", "div", "td", "th", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "figure", "fieldset", "dd", "details", "dialog"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
LIST_SCOPE = {"ul", "ol", "menu", "dl", "table", "html", "body"}
TAGS = [("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "legend", "search"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre"), ("figure", "figcaption"), ("html", "body")]
LEXICON = [
    "nav navigation navbar navi menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip hamburger",
    "header masthead banner topbar top branding logo site hero tagline",
    "footer bottom copyright colophon legal imprint impressum credits",
    "sidebar side aside rail widget widgets related recommended recommendations popular trending more tags teaser archive complementary seealso",
    "ad ads adv advert advertisement advertising advertorial adsense banner sponsor sponsored promo promotion promoted dfp outbrain taboola gpt partner commercial",
    "comment comments commentlist reply replies discussion disqus respond feedback reviews reader thread",
    "cookie cookies consent gdpr notice notices alert popup modal overlay privacy banner message disclaimer paywall warning announcement info",
    "share sharing social newsletter subscribe subscription signup signin login search follow form poll buttons tools contact register",
    "content article post entry main story body text page blog news prose articlebody maincontent primary copy read",
]
GROUP = {w: {g for g, ws in enumerate(LEXICON) if w in ws.split()} for ws in LEXICON for w in ws.split()}
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: A comment or declaration, or a tag: its slash, name and attributes. Possessive, so that broken markup costs no retries.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^\s>=/]++(?:\s*+=\s*+(?>"[^"]*"|'[^']*'|[^\s>]*+))?+|[\s/=])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s>=/]++)(?:\s*+=\s*+(?>"([^"]*)"|'([^']*)'|([^\s>]*+)))?+""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe")}


class Dom:
    """Block-level nodes (tag, parent, attribute tokens) and text blocks (node, text, characters in links) in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.inline = ["html"], [-1], [frozenset()], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._hidden = 0
        self._links = 0
        self._text: list[str] = []
        self._linked = 0
        self._read(html)
        self._end_block()

    def _read(self, html: str) -> None:
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at and not self._hidden:
                self._data(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW_END:
                end = RAW_END[tag].search(html, at)
                at = end.start() if end else len(html)
            elif m[3].endswith("/") and tag not in VOID and tag not in BLOCK and tag != "html":
                self._close(tag)
        if at < len(html) and not self._hidden:
            self._data(html[at:])

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _pop(self, to: int) -> None:
        self._end_block()
        for tag, _ in self._stack[to:]:
            self._hidden -= tag in HIDDEN
            self._links -= tag == "a"
        del self._stack[to:]

    def _find(self, tags: set[str], stop: set[str]) -> int:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                return i
            if self._stack[i][0] in stop:
                break
        return 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "hr":
            self._text.append(" ")
            return
        if tag in VOID or tag == "html":
            return
        if tag in BLOCK:
            self._end_block()
            if self._hidden and (i := self._find({"head", "title", "button", "select", "option"}, set())):
                self._pop(i)  # left open; no block belongs there
            if tag == "body":
                if any(t == "body" for t, _ in self._stack):
                    return
            if tag in CLOSES_P and (i := self._find({"p"}, SCOPE)):
                self._pop(i)
            if tag in SAME and (i := self._find(SAME[tag], LIST_SCOPE - SAME[tag])):
                while (j := self._find(SAME[tag], LIST_SCOPE - SAME[tag])) and j < i:
                    i = j
                self._pop(i)
            if tag[0] == "h" and tag[1:].isdigit() and self._stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._pop(len(self._stack) - 1)
            node = len(self.tag)
            words = _attribute_words(attributes) if attributes else frozenset()
            self.tag.append(tag)
            self.parent.append(self._stack[-1][1])
            self.words.append(words)
            self.inline.append(0)
            self._stack.append((tag, node))
            return
        if tag == "option" and self._stack[-1][0] == "option":
            self._pop(len(self._stack) - 1)
        self._hidden += tag in HIDDEN
        self._links += tag == "a"
        self.inline[self._stack[-1][1]] += 1
        self._stack.append((tag, self._stack[-1][1]))

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            if i := self._find({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else set()):
                self._pop(i)
            else:
                self._end_block()
        else:
            for i in range(len(self._stack) - 1, 0, -1):
                t = self._stack[i][0]
                if t == tag:
                    if tag in HIDDEN:
                        self._pop(i)
                    else:  # inline: what it holds open stays open
                        self._links -= tag == "a"
                        del self._stack[i]
                    break
                if t in BLOCK and tag not in HIDDEN:
                    break

    def _data(self, data: str) -> None:
        if "&" in data:
            data = unescape(data)
        self._text.append(data)
        if self._links:
            self._linked += len(data.strip())


@functools.lru_cache(10_000)
def _attribute_words(attributes: str) -> frozenset[str]:
    """Words of the attributes by which authors name an element's role, plurals as singulars; ``_hidden`` if it isn't shown."""
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(a or b or c)
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words |= {w for w in SPLIT.split(CAMEL.sub(" ", value).lower()) if w}
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            words.add("_hidden")
    return frozenset(words | {w[:-1] for w in words if w.endswith("s")})


def _mask(words: frozenset[str]) -> int:
    """Bit g for a word of group g of the lexicon; the next bit for hidden elements."""
    m = 0
    for w in words:
        for g in GROUP.get(w, ()):
            m |= 1 << g
        if w == "_hidden":
            m |= 1 << len(LEXICON)
    return m


BELOW = {"article": 1, "main": 2, "nav": 4, "header": 8, "footer": 8, "aside": 16, "form": 32}


def node_features(dom: Dom) -> np.ndarray:
    n = len(dom.tag)
    parent, tag = dom.parent, dom.tag
    own_chars, links, words, stops, blocks = ([0] * n for _ in range(5))
    for node, text, linked in dom.blocks:
        own_chars[node] += len(text)
        links[node] += linked
        words[node] += text.count(" ") + 1
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        blocks[node] += 1
    chars = own_chars.copy()
    tags = [x + 1 for x in dom.inline]
    paras = [int(t == "p") for t in tag]
    items = [int(t == "li") for t in tag]
    fields = [int(t in ("form", "label", "fieldset")) for t in tag]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, words, stops, blocks, tags, paras, items, fields):
            a[p] += a[i]
    depth, above, over, index, same, children, kids_chars, kids_links = ([0] * n for _ in range(8))
    flags = [_mask(w) if w else 0 for w in dom.words]
    kind_of = _kinds()
    kind = [1 << kind_of[t] if t in kind_of else 0 for t in tag]
    seen: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | flags[p]
        over[i] = over[p] | BELOW.get(tag[p], 0)
        index[i] = children[p]
        children[p] += 1
        kids_chars[p] += chars[i]
        kids_links[p] += links[i]
        k = (p, tag[i])
        same[i] = seen.get(k, 0)
        seen[k] = same[i] + 1
    up = np.maximum(np.array(parent), 0)
    base = np.array([depth, index, children, same, chars, words, links, tags, paras, items, fields, stops, blocks, own_chars, kids_chars, kids_links], float)
    depth, index, children, same, chars, words, links, tags, paras, items, fields, stops, blocks, own_chars, kids_chars, kids_links = base
    siblings = children[up]
    safe = lambda a, b: a / np.maximum(b, 1)
    total = max(chars[0], 1)
    cols = [
        depth, index, siblings, siblings - index, safe(index, siblings), children, same,
        np.log1p(chars), np.log1p(words), safe(links, chars), safe(chars, tags), np.log1p(tags), paras, items, fields, chars / total,
        safe(stops, words), safe(chars, blocks), safe(chars, words), safe(own_chars, chars),
        safe(kids_links[up] - links, kids_chars[up] - chars), safe(kids_chars[up] - chars, siblings - 1), safe(chars[up], tags[up]), safe(chars, chars[up]), safe(links[up], chars[up]),
    ]
    bits = lambda m, k: ((np.array(m, np.int64)[:, None] >> np.arange(k)) & 1).astype(float)
    return np.hstack([np.stack(cols, 1), bits(kind, len(TAGS)), bits(flags, len(LEXICON) + 1), bits(above, len(LEXICON) + 1), bits(over, 6)])


@functools.cache
def _kinds() -> dict[str, int]:
    return {t: k for k, ts in enumerate(TAGS) for t in ts}


def decode(margin: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The likeliest labels (True: main text) in which no node below a rejected one is accepted."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    take, drop = yes.copy(), no.copy()
    for i in range(n - 1, 0, -1):
        take[parent[i]] += max(take[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and take[i] > drop[i]
    return out


def main_text(dom: Dom, margin: np.ndarray) -> str:
    kept = decode(margin, np.array(dom.parent))
    return "\n\n".join(text for node, text, _ in dom.blocks if kept[node])


# --- training pages ---


def synthetic_page(rng: random.Random) -> tuple[str, list[bool], str]:
    """(html, label of each block-level node of ``Dom``, main text) of an invented page.

    Labels ride along as attributes that the parser's features never see and are read off the built tree.
    """
    stems = [rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "n", "r", "st", "l"]) for _ in range(40)]

    def word() -> str:
        return "".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))

    def sentence(a: int = 4, b: int = 18) -> str:
        w = [word() for _ in range(rng.randint(a, b))]
        return w[0].capitalize() + "".join((", " if rng.random() < 0.1 else " ") + x for x in w[1:]) + (rng.choice("....!?") if rng.random() < stopped else "")

    stopped = rng.choice([1.0, 1.0, 0.9, 0.5])

    def heading(a: int = 1, b: int = 9) -> str:
        """Titles mostly end without a stop, and some are cut off."""
        t = sentence(a, b)
        return rng.choice([t, t.rstrip(".!?"), t.rstrip(".!?"), t[:60]])

    def prose(a: int = 1, b: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def marked(a: str) -> str:
        """Inline markup, sometimes left open."""
        w = a.split(" ")
        if len(w) > 5 and rng.random() < 0.4:
            i = rng.randrange(len(w) - 3)
            t = rng.choice(["b", "i", "em", "strong", "a", "span", "code"])
            w[i] = f'<{t} href="/{word()}">' + w[i] if t == "a" else f"<{t}>" + w[i]
            w[i + rng.randint(0, 2)] += f"</{t}>" if rng.random() < 0.8 or t in ("a",) else ""
        return " ".join(w)

    def names(group: int, plain: float = 0.15) -> str:
        if rng.random() < plain:
            return ""
        w = rng.choice(LEXICON[group].split())
        w = rng.choice([w, f"{w}-{word()}", f"{word()}-{w}", f"{word()}_{w}", f"site-{w}" if group in (0, 1, 2) else w, f"{w}s"])
        return f' {rng.choice(["class", "class", "class", "id"])}="{w}"'

    def links(k: int) -> str:
        sep, wrap = rng.choice([("", "li"), (" | ", ""), (" ", ""), ("", "li")])
        one = [f'<a href="/{word()}">{rng.choice([word(), word().capitalize(), sentence(2, 6)])}</a>' for _ in range(k)]
        if wrap:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>"
        return sep.join(one)

    def tag(options: str) -> str:
        return rng.choice(options.split())

    def boiler(kind: int) -> str:
        if kind == 0:
            t = tag("nav nav nav div ul")
            return f"<{t}{names(0, 0.0 if t == 'div' else 0.6)}>{links(rng.choice([1, 2, 3, 4, 5, 6, 8]))}</{t}>"
        if kind == 1:
            t = tag("header header div")
            title = rng.choice([f"<h1>{word().capitalize()} {word()}</h1>", f"<a href='/'>{word()}</a>", f"<p>{sentence(3, 8)}</p>", f'<div class="logo">{word()}</div>'])
            return f"<{t}{names(1, 0.0 if t == 'div' else 0.6)}>{title}{links(rng.randint(2, 6)) if rng.random() < 0.5 else ''}</{t}>"
        if kind == 2:
            t = tag("footer footer footer div")
            return f"<{t}{names(2, 0.0 if t == 'div' else 0.6)}>{rng.choice([f'<p>&copy; {word()} {sentence()}</p>', f'&copy; {word()}.example &middot; {prose(1, 3)}', links(5), f'<div>{links(4)}</div><p>{sentence()}</p>'])}</{t}>"
        if kind == 3:
            t = tag("aside aside div section")
            body = rng.choice([f"<h3>{heading(1, 4)}</h3>{links(rng.randint(3, 8))}", f"<p>{prose(1, 3)}</p>", "".join(f'<div class="{word()}"><h4><a href="/{word()}">{heading(3, 9)}</a></h4><p>{prose(1, 2)}</p></div>' for _ in range(rng.randint(2, 5)))])
            return f"<{t}{names(3, 0.0 if t != 'aside' else 0.6)}>{body}</{t}>"
        if kind == 4:
            t = tag("div div div aside section p")
            return f"<{t}{names(4, 0.0)}>{rng.choice([prose(1, 3), f'<p>{prose(1, 2)}</p>', f'<a href=/x>{sentence()}</a>', f'<h3>{heading(2, 5)}</h3><p>{prose(1, 3)}</p>'])}</{t}>"
        if kind == 5:
            t, inner = tag("div section div ol"), tag("div article li p")
            many = "".join(f"<{inner}{names(5, 0.5)}>{rng.choice([f'<b>{word()}</b> ', f'<h4>{word()} {word()}</h4>', f'<span class=author>{word()}</span>: '])}{rng.choice(['<p>' + prose(1, 4) + '</p>' if inner != 'p' else prose(1, 4), prose(1, 3)])}</{inner}>" for _ in range(rng.randint(1, 6)))
            return f"<{t}{names(5, 0.0)}>{f'<h3>{rng.randint(1, 40)} {word()}</h3>' if rng.random() < 0.6 else ''}{many}</{t}>"
        if kind == 6:
            t = tag("div div section aside dialog")
            return f"<{t}{names(6, 0.0)}>{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p><button>{word()}</button>', f'<p>{sentence()} <a href=/p>{word()}</a></p>'])}</{t}>"
        t = tag("form form form div")
        label = f"<label>{sentence(2, 5)}</label>" if rng.random() < 0.6 else ""
        body = f"<p>{sentence()}</p>{label}<input name=q><button>{word()}</button><select><option>{word()}<option>{word()}</select>" if t == "form" else links(rng.randint(2, 6))
        return f"<{t}{names(7, 0.0 if t == 'div' else 0.5)}>{body}</{t}>"

    out: list[str] = []

    def good() -> str:
        r = rng.random()
        if r < 0.72:
            text = marked(prose(1, 9) if rng.random() < 0.75 else sentence(1, 10))
            if rng.random() < 0.1:
                text = text.replace(". ", ".<br>", 1)
            return f"<p>{'<b>' if rng.random() < 0.1 else ''}{text}" + rng.choice(["</p>", "</p>", "</p>", "", "<br>"])
        if r < 0.82:
            return f"<h{(k := rng.randint(2, 4))}>{heading()}</h{k}>"
        if r < 0.89:
            t = tag("ul ol")
            return f"<{t}>" + "".join(f"<li>{marked(sentence(3, 14))}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if r < 0.93:
            return rng.choice([f"<blockquote><p>{prose()}</p></blockquote>", f"<blockquote>{prose()}</blockquote>", f"<pre>{prose()}</pre>"])
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{sentence(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>"

    def good_div() -> str:
        return f"<div>{prose(1, 8)}</div>"

    on = lambda s: f"\x01{s}\x02"  # noqa: E731  what is between is main text
    wrap = rng.choice(["article", "article", "article", "main", "div", "section", "td"])
    wname = names(8, 0.7 if wrap in ("article", "main") else 0.2)
    block = good_div if rng.random() < 0.1 and wrap != "td" else good
    body = [on(f"<h1>{heading(1, 12)}</h1>")] if rng.random() < 0.8 else []
    if body and rng.random() < 0.15:
        body = [f"<header>{body[0]}</header>"]
    for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6, 8, 12, 20])):
        body.append(on(block()))
        if rng.random() < 0.12:
            body.append(boiler(rng.choice([4, 4, 7, 3, 6, 0])))
    if rng.random() < 0.15:
        body.append(boiler(rng.choice([5, 7, 3])))
    core = f"<{wrap}{wname}>{''.join(body)}</{wrap}>"
    if wrap == "td":
        core = f"<table><tr><td{names(0, 0.3)}>{links(6)}</td><td{wname}>{''.join(body)}</td></tr></table>"
    if rng.random() < 0.3:
        core = f"<{(t := tag('div div main section'))}{names(8, 0.4)}>{core}</{t}>"
    before = [boiler(k) for k in (6, 1, 0, 0, 4, 3, 7) if rng.random() < (0.35, 0.45, 0.6, 0.15, 0.35, 0.12, 0.15)[(6, 1, 0, 0, 4, 3, 7).index(k)]]
    after = [boiler(k) for k in (5, 4, 3, 7, 6, 2) if rng.random() < (0.35, 0.2, 0.4, 0.2, 0.12, 0.75)[(5, 4, 3, 7, 6, 2).index(k)]]
    if rng.random() < 0.25:
        core = f"<div>{core}{boiler(3)}</div>"
    out = [*before, core, *after]
    if rng.random() < 0.3:
        out = [f"<div class=\"{rng.choice(['wrapper', 'container', 'row', 'outer', 'layout'])}\">", *out, "</div>"]
    html = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head><body>" + "".join(out) + "</body></html>"
    dom = Dom(html)
    # the marks are text: a block is main text if it lies between them
    labels, texts, inside = [False] * len(dom.tag), [], False
    for k, (node, text, linked) in enumerate(dom.blocks):
        opened, closed = "\x01" in text, "\x02" in text
        clean = text.replace("\x01", "").replace("\x02", "").strip()
        here = inside if not text.startswith("\x01") else True
        if opened or closed:
            inside = text.rfind("\x01") > text.rfind("\x02")
            here = here or (opened and clean != "" and not text.startswith("\x02"))
        if clean and here:
            texts.append(clean)
            labels[node] = True
    for i in range(len(labels) - 1, 0, -1):
        labels[dom.parent[i]] |= labels[i]
    return html.replace("\x01", "").replace("\x02", ""), labels, "\n\n".join(texts)


PAGES, SEED = 1000, 7


@functools.cache
def trained(pages: int = PAGES, seed: int = SEED) -> boosting.Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    while len(xs) < pages:
        html, labels, _ = synthetic_page(rng)
        dom = Dom(html)
        if len(labels) == len(dom.tag):  # the marks changed nothing in the tree
            xs.append(node_features(dom))
            ys.append(np.array(labels, float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    return boosting.fit(x, y, np.ones(len(y)), trees=60)


def extract_all(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    doms = [Dom(h) if h else None for h in pages]
    found = [node_features(d) if d else None for d in doms]
    full = [x for x in found if x is not None]
    margin = trees.margin(np.concatenate(full)) if full else np.empty(0)
    out, at = [], 0
    for d, x in zip(doms, found, strict=True):
        if x is None:
            out.append("")
        else:
            out.append(main_text(d, margin[at : at + len(x)]))
            at += len(x)
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html, ...)``; no shuffle."""
    trees = trained()  # some hundred KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", 1 << 20):
                texts = extract_all(batch.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string")
