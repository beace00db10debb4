"""HTML main-text extraction by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags, each with its path
of open elements.  A logistic classifier gives a block the log-odds of being content
from its text and path and from its page: the share of the page's prose in its box, links
in the box, its place before or after the main text, whether there is an article that
it isn't in, boxes that look alike.  Names in class or id count where they say one thing only and
don't speak against the box that holds most of the prose.  It is fitted on labelled
blocks of pages made for it (train_pages), some of whose names say nothing or wrong things.  The
log-odds are the capacity to one terminal (content or boilerplate); neighbours in the
page, more so within one box, and blocks of boxes that look alike are joined by smoothness edges.
A maximum flow separates the terminals, and the blocks on the content side are the main
text.  Capacities of edges were chosen on made pages of another seed: where names say
nothing, the cut changes 1.8 to 2.0 % of the labels and mends a fifth to two fifths of the
classifier's errors.  What HTML doesn't show as text (scripts, styles, templates, ...) never
becomes a block.

Tags are read in one pass: wherever a tag, comment or quoted value isn't closed, that
is found out once and remembered, so that no part of a page is scanned again and again.

Defined cases: null or empty html gives an empty text; html of any length is read
whole; markup that isn't closed is closed by its parent or the end of the page; a "<"
that begins no tag is text; repeated rows stay.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import map_texts, text_of

#: Elements without text of their own (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article.
NEVER = frozenset("head script style nav footer form aside noscript template iframe svg button select option textarea dialog menu object canvas audio video map".split())
#: Elements that close an open <p>, and those that close an element of their own kind.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that hold parts of a page.
BOXES = frozenset("address article aside blockquote body center details dialog div fieldset figure footer form header html li main nav section table tbody td tr".split())
#: Words in a text that tell rights and consent.
RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s*(?:19|20)\d\d|copyright)|all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos", re.I)
CONSENT = re.compile(r"\bcookies?\b|\bgdpr\b|\bconsent\b|privacy (?:policy|notice)", re.I)
#: Words in class, id or role that speak against and for an article.
AGAINST = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|site-?header|page-?header|top-?bar|header|banner|sidebar|side|aside|widgets?|related|recommend(?:ed|ations?)?|more-?from|read-?more|trending|popular|share|sharing|social|follow|promo|promotion|advert|adverts|advertisement|ads?|adsense|ad-?(?:box|slot|unit|container|wrapper)|sponsor(?:ed)?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|sign-?up|login|comments?|comment-?list|replies|reply|respond|disqus|discussion|pagination|pager|copyright|legal|disclaimer|toolbar|search|skip-?link|hidden|contentinfo|complementary|author-?bio|tags?|tag-?list)(?![a-z])"
)
FOR = re.compile(r"(?<![a-z])(?:article|content|main|post|entry|story|body|text|article-?body|post-?content|entry-?content|story-?body)(?![a-z])")
_HIDES = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Capacities of edges: between neighbours, more where both are in one box, or one's box is in the other's; between a box's block and its next one; between boxes that look alike.
NEXT, SAME, NEAR, ALIKE = 0.05, 0.9, 0.05, 0.9
#: Steps and ridge of the fit; pages that are made for it.
STEPS, RIDGE, TRAIN_PAGES = 400, 1e-3, 240


class Node:
    __slots__ = ("tag", "up", "depth", "holder", "never", "against", "good", "article", "header", "link", "look", "alike", "box")

    def __init__(self, tag: str, up: Node | None, attributes: str):
        self.tag, self.up = tag, up
        self.alike: dict[str, int] = {}  # children by element and class
        self.look = tag
        self.box = self if tag in BOXES or up is None else up.box  # the nearest element that holds parts of a page
        self.depth = up.depth + 1 if up else 0
        self.holder = up.holder if up and tag in INLINE else self  # the nearest element that isn't inside a line
        self.never = tag in NEVER or up is not None and up.never or bool(attributes and _HIDES.search(attributes))
        self.article = tag in ("article", "main") or up is not None and up.article
        self.header = tag == "header" or up is not None and up.header
        self.link = tag == "a" or up is not None and up.link
        self.against, self.good = (up.against, up.good) if up else (False, False)
        if up and tag in BOXES:
            if attributes and (m := _CLASS.search(attributes)):
                self.look = f"{tag}.{m[1] or m[2] or m[3]}"
            up.alike[self.look] = up.alike.get(self.look, 0) + 1
        if attributes and tag not in ("html", "body", "article", "main"):
            for m in _NAMED.finditer(attributes):
                name = (m[1] or m[2] or m[3] or "").lower().replace("_", "-")
                name = re.sub(r"-+", "-", name)
                for_, against = bool(FOR.search(name)), bool(AGAINST.search(name))
                if for_ != against:  # a name that says both says nothing
                    self.good, self.against = self.good or for_, self.against or against


class Block:
    __slots__ = ("parts", "node", "linked", "text", "seen")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked = node, [], 0
        self.seen: list[float] = []


_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_VALUE = re.compile(r"[^\"'>]*")


class Tags:
    """Reads the markup of a page, each part once: ends that aren't there are looked for once only."""

    def __init__(self, html: str):
        self.html, self.n, self.missing, self.quotes = html, len(html), set(), True
        self.lower: str | None = None

    def find(self, what: str, at: int) -> int:
        """Place of what from at on, -1 for none; after a miss it isn't looked for again."""
        if what in self.missing:
            return -1
        got = self.html.find(what, at)
        if got < 0:
            self.missing.add(what)
        return got

    def read(self, at: int) -> tuple[str, str, str, int]:
        """(kind, name or text, attributes, end) of the markup at a "<": text, skip, open or close."""
        html = self.html
        if html.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return "skip", "", "", self.n if end < 0 else end + 3
        if html.startswith("<![CDATA[", at):
            end = self.find("]]>", at + 9)
            return "text", html[at + 9 : self.n if end < 0 else end], "", self.n if end < 0 else end + 3
        if html.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return "skip", "", "", self.n if end < 0 else end + 1
        closing = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + closing)
        if not name:
            return "text", "<", "", at + 1
        p = name.end()
        first = self.find(">", p)
        if first < 0:  # never closed
            return "skip", "", "", self.n
        while self.quotes:  # quoted values may hold ">"; a quote that isn't closed is a character
            p = _VALUE.match(html, p).end()
            if p >= self.n:  # all that is left is in quotes: from now on, quotes are characters
                p, self.quotes = first, False
                break
            if html[p] == ">":
                break
            end = self.find(html[p], p + 1)
            p = p + 1 if end < 0 else end + 1
        else:
            p = first
        return "close" if closing else "open", name[0].lower(), html[name.end() : p], p + 1

    def after(self, tag: str, at: int) -> int:
        """Place after the end tag of an element that holds no markup."""
        if self.lower is None:
            self.lower = self.html.lower() if len(self.html.lower()) == self.n else self.html
        key = "</" + tag
        while key not in self.missing:
            got = self.lower.find(key, at)
            if got < 0:
                self.missing.add(key)
                break
            if self.lower[got + len(key) : got + len(key) + 1] in (">", "/", " ", "\t", "\n", "\r", "\f"):
                end = self.html.find(">", got)
                return self.n if end < 0 else end + 1
            at = got + len(key)
        return self.n


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order."""
    root = node = Node("", None, "")
    out: list[Block] = []
    block: Block | None = None
    at, n = 0, len(html)
    tags, open_ = Tags(html), Counter()

    def leave(tag: str) -> None:
        """Closes the innermost open element of this name and all in it."""
        nonlocal node
        while True:
            tag_ = node.tag
            open_[tag_] -= 1
            node = node.up
            if tag_ == tag:
                return

    def say(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(node.holder)
            out.append(block)
        block.parts.append(text)
        if node.link:
            block.linked += len(text)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            say(unescape(html[at:]))
            break
        if start > at:
            say(unescape(html[at:start]))
        kind, tag, attributes, at = tags.read(start)
        if kind == "text":
            say(unescape(html[start:at]) if tag == "<" else tag)
        if kind in ("text", "skip"):
            continue
        closing = kind == "close"
        if tag not in INLINE:
            block = None
        if closing:
            if open_[tag]:
                leave(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            at = tags.after(tag, at)
            continue
        if tag in CLOSES_P:
            if open_["p"] and node.holder.tag == "p":
                leave("p")
        elif tag in OWN_KIND and any(open_[k] for k in OWN_KIND[tag]):
            up = node
            while up is not root and up.tag not in ("ul", "ol", "dl", "table", "select", "menu") and up.tag not in OWN_KIND[tag]:
                up = up.up
            if up.tag in OWN_KIND[tag]:
                leave(up.tag)
        if not attributes.endswith("/") or tag in INLINE:
            node = Node(tag, node, attributes)
            open_[tag] += 1
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    describe(kept)
    return kept


#: What a block shows, in the order of its features: by itself, and within its page.
FEATURES = ("base", "never", "article", "good", "against", "against_in_article", "header", "paragraph", "heading", "heading_in_article", "sentence", "long", "links", "list",
    "beside", "mass", "header_mass", "box_links", "outside", "repeats", "repeats_outside", "rights", "consent")


AGAINST_AT = FEATURES.index("against")


def describe(blocks: list[Block]) -> None:
    """Features of a page's blocks; those within the page don't hang on names.

    beside: the page has an article, and the block isn't in it; mass: the share of the page's prose in the block's
    box or one around it, up to two levels; box_links: the share of links in the box; outside: before the first or after the
    last prose of the page's main box; repeats: the block's box, or one around it, is one of three or more that look alike.
    """
    prose, chars, links = Counter(), Counter(), Counter()
    for b in blocks:
        n = len(b.text)
        said = n if _prose(b) else 0
        box = b.node.box
        chars[id(box)] += n
        links[id(box)] += min(b.linked, n)
        for weight in (1.0, 0.7, 0.4):  # a box has part of what its parts have
            prose[id(box)] += weight * said
            if box.up is None:
                break
            box = box.up.box
    total = sum(len(b.text) for b in blocks if _prose(b))
    has_article = any(b.node.article and not b.node.never for b in blocks)
    main = max(prose, key=prose.get, default=None)

    def inside(node: Node) -> bool:
        box = node.box
        for _ in range(4):
            if id(box) == main:
                return True
            if box.up is None:
                return False
            box = box.up.box
        return False

    of_main = [i for i, b in enumerate(blocks) if inside(b.node) and _prose(b) and len(b.text) >= 40]
    first, last = (of_main[0], of_main[-1]) if of_main else (0, len(blocks))
    for i, b in enumerate(blocks):
        box = b.node.box
        mass = min(1.0, max(prose[id(x)] for x in (box, box.up.box if box.up else box)) / total) if total else 0.0
        outside = (i < first or i > last) and not inside(b.node)
        node, repeats = box, False
        for _ in range(3):
            if node.up is None:
                break
            repeats |= node.tag != "li" and node.up.alike.get(node.look, 0) >= 3
            node = node.up
        n = len(b.text)
        own = features(b)
        if total and prose[id(box)] > 0.5 * total and (b.node.article or not has_article):  # where most of the page's prose is, names against it count for nothing
            own[AGAINST_AT] = own[AGAINST_AT + 1] = False
        b.seen = own + [has_article and not b.node.article, mass, b.node.header * mass, links[id(box)] / max(1, chars[id(box)]), outside, repeats, repeats and outside, bool(n < 300 and RIGHTS.search(b.text)), bool(n < 600 and not inside(b.node) and CONSENT.search(b.text))]


def _sentence(text: str) -> bool:
    return text[-1] in ".!?…。\"”" or ". " in text


def _prose(b: Block) -> bool:
    """Sentences or a length of text, and few links."""
    return b.linked < 0.3 * len(b.text) and not b.node.never and (len(b.text) >= 60 or _sentence(b.text))


def features(b: Block) -> list[float]:
    node, n = b.node, len(b.text)
    tag = node.tag
    heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    return [1.0, node.never, node.article, node.good, node.against, node.against and node.article, node.header and not (node.article and heading), tag in ("p", "pre", "blockquote"), heading, heading and node.article, _sentence(b.text), min(n, 300) / 300, min(1.0, b.linked / n), tag == "li"]


#: Names that pages made for the fit give their parts.
NAMES = {
    "menu": ("menu", "navbar", "top-bar"), "notice": ("cookie-notice", "consent", "alert", "newsletter"), "ad": ("ad", "promo", "sponsor"), "share": ("share", "related", "follow"),
    "comments": ("comments", "replies", "comment-list"), "side": ("sidebar", "widgets", "aside"), "foot": ("footer", "copyright", "legal"), "body": ("content", "post-body", "article-body", "entry"),
}


def train_pages(n: int = TRAIN_PAGES, seed: int = 17, naming: str | None = None) -> list[tuple[str, list[bool]]]:
    """Labelled pages: html made of the usual parts in usual orders, and for each of its blocks whether it is content.

    Parts come with and without elements and names that tell them.  A page's names are telling ("plain"), of
    no meaning ("odd"), not there ("none"), or those of another part ("wrong"); content holds short and long blocks,
    boilerplate long ones too, so that no one feature decides alone.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    sentence = lambda: words(r.randint(4, 14)).capitalize() + r.choice(".....!?")
    prose = lambda most, least=1: " ".join(sentence() for _ in range(r.randint(least, most)))
    links = lambda k: "".join(f"<li><a href='#'>{words(r.randint(1, 4))}</a></li>" for _ in range(k))
    out = []
    for _ in range(n):
        parts: list[tuple[str, list[bool]]] = []
        kind_of_names = naming or r.choices(["plain", "odd", "none", "wrong"], [0.7, 0.2, 0.07, 0.03])[0]
        code = "".join(r.choice("abcdefgh") for _ in range(3))

        def name(part: str) -> str:
            if kind_of_names == "none":  # noqa: B023
                return ""
            if kind_of_names == "odd":  # noqa: B023
                said = f"{code}-{sum(map(ord, part)) % 97:02d}"  # noqa: B023
            else:
                said = r.choice(NAMES[part if kind_of_names == "plain" else r.choice(list(NAMES))])  # noqa: B023
            return f' {r.choice(["class", "id"])}="{said}"'

        def add(html: str, *labels: bool):
            parts.append((html, list(labels)))  # noqa: B023

        def list_of(wrap: str, k: int):
            add(wrap.format(links(k)), *[False] * k)  # noqa: B023

        if r.random() < 0.8:
            list_of(r.choice(["<nav><ul>{}</ul></nav>", f"<div{name('menu')}><ul>{{}}</ul></div>", "<header><ul>{}</ul></header>"]), r.randint(2, 7))
        if r.random() < 0.5:
            add(f"<header><h1>{words(3)}</h1><p>{sentence()}</p></header>", False, False)
        if r.random() < 0.5:
            told = prose(3)
            add(f"<div{name('notice')}><p>{told if r.random() < 0.5 else 'We use cookies. ' + told}</p></div>", False)
        if r.random() < 0.3:
            add(f"<div{name('ad')}>{prose(2)}</div>", False)
        own: list[tuple[str, list[bool]]] = []
        if r.random() < 0.9:
            own.append((f"<h1>{words(r.randint(2, 9))}</h1>", [True]))
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.6:
                own.append((f"<p>{prose(6)}</p>", [True]))
            elif kind < 0.68:
                own.append((f"<p>{words(r.randint(1, 4)).capitalize()}.</p>", [True]))
            elif kind < 0.75:
                own.append((f"<h2>{words(3)}</h2>", [True]))
            elif kind < 0.82:
                own.append((f"<ul><li>{sentence()}</li></ul>", [True]))
            elif kind < 0.86:
                own.append((f"<div{name('body')}><p>{prose(5, 2)}</p><p>{prose(5)}</p></div>", [True, True]))
            elif kind < 0.94 and kind_of_names in ("plain", "odd"):
                own.append((f"<div{name(r.choice(['ad', 'share']))}><a href='#'>{words(3)}</a> {words(2)}</div>" if r.random() < 0.6 or kind_of_names == "odd" else f"<div{name('ad')}>{prose(2)}</div>", [False]))
            else:
                own.append((f"<aside><p>{prose(4)}</p></aside>", [False]))
        wrap = r.choice(["<article>{}</article>", "<main>{}</main>", f"<div{name('body')}>{{}}</div>", f"<article><div{name('body')}>{{}}</div></article>", "<div>{}</div>"])
        add(wrap.replace("{}", "".join(h for h, _ in own)), *[x for _, xs in own for x in xs])
        if r.random() < 0.6:
            k, t, each = r.randint(1, 5), r.choice(["div", "section"]), r.random() < 0.6
            said = [f"<div{name('comments')}><b>{words(2)}</b><p>{prose(4)}</p></div>" if each else f"<p>{prose(4)}</p>" for _ in range(k)]
            add(f"<{t}{name('comments')}>" + "".join(said) + f"</{t}>", *[False] * (2 * k if each else k))
        if r.random() < 0.5:
            list_of(r.choice(["<aside><ul>{}</ul></aside>", f"<div{name('side')}><ul>{{}}</ul></div>"]), r.randint(1, 5))
        if r.random() < 0.4:
            add(f"<form><p>{sentence()}</p></form>", False)
        if r.random() < 0.8:
            told = prose(2)
            add(r.choice(["<footer>{}</footer>", f"<div{name('foot')}>{{}}</div>", "<footer><p>{}</p></footer>"]).format(told if r.random() < 0.5 else f"&copy; 2020 {told}"), False)
        out.append(("<html><body>" + "".join(h for h, _ in parts) + "</body></html>", [x for _, xs in parts for x in xs]))
    return out


def fitted(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a ridge that leaves none unbounded."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + ridge * np.eye(len(w)), x.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(1)
def weights() -> tuple[float, ...]:
    """The classifier's weights, fitted once for a process; the same everywhere."""
    x, y = [], []
    for html, labels in train_pages():
        blocks = blocks_of(html)
        if len(blocks) != len(labels):
            raise AssertionError("a page made for the fit has other blocks than labels")
        x += [b.seen for b in blocks]
        y += labels
    return tuple(fitted(np.array(x, float), np.array(y, float)).tolist())


def score(b: Block) -> float:
    """Log-odds of content."""
    return float(sum(w * f for w, f in zip(weights(), b.seen, strict=True)))


def shared_depth(a: Node, b: Node) -> int:
    while a.depth > b.depth:
        a = a.up
    while b.depth > a.depth:
        b = b.up
    while a is not b:
        a, b = a.up, b.up
    return a.depth


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of the minimum cut: what the content terminal still reaches after a maximum flow (Dinic)."""
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            add(s, i, x, 0.0)
        elif x < 0:
            add(i, t, -x, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                stop = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[stop] ^ 1]
                del path[stop:]
                continue
            while nth[a] < len(out[a]):
                e = out[a][nth[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nth[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                nth[a] += 1
                continue
            path.append(e)
            a = to[e]


def labels_of(blocks: list[Block]) -> list[bool]:
    """Whether each block is content: the content side of the minimum cut."""
    scores = [score(b) for b in blocks]
    edges = []
    last: dict[object, int] = {}
    for i, b in enumerate(blocks):
        box = b.node.box
        if i:
            other = blocks[i - 1].node.box
            kin = other.up is not None and other.up.box is box or box.up is not None and box.up.box is other
            edges.append((i - 1, i, NEXT + (SAME if other is box else NEAR if kin else 0.0)))
        j = last.get(id(box))  # the block before it in the same box
        if j is not None and j != i - 1:
            edges.append((j, i, SAME))
        last[id(box)] = i
        if box.up is not None and box.up.alike.get(box.look, 0) >= 3:  # and in a box beside that looks alike
            like = (id(box.up), box.look, b.node.tag)
            j = last.get(like)
            if j is not None and blocks[j].node.box is not box:
                edges.append((j, i, ALIKE))
            last[like] = i
    return min_cut(scores, edges)


def extract(html: str) -> str:
    """The main text: content blocks in page order, one space between."""
    blocks = blocks_of(html)
    return " ".join(b.text for b, content in zip(blocks, labels_of(blocks), strict=True) if content)


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """df's columns but the html, plus its main text, which replaces a column of that name."""
    return map_texts(df.withColumn("__text", text_of(html_col)).drop(html_col), lambda pages: {out: pa.array([extract(h) for h in pages], pa.string())}, f"`{out}` string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
