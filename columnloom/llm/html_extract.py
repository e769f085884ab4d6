"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, without comments, scripts, styles and other
hidden elements, character references decoded and white space made one space. Each block is a vector of its tag path
(elements with their class and id words, hashed), its words (hashed) and a few shape features. A bidirectional LSTM in
numpy reads the whole block sequence and labels every block as article or not; article blocks, joined by one space in
page order, are the text.

The labeller trains on the driver on generated layouts (menus, headers, notices, adverts, sidebars, forms, comments and
footers around articles, with varied or no class names) and on a bounded sample of ``SAMPLE_PAGES`` of the given pages
whose blocks lie inside unambiguous elements (article, nav, footer and so on). Its weights, under 1 MB, are broadcast.
Extraction is one narrow map over whole pages.

Edge cases: null or empty html gives an empty text; a head without end tag ends where text or an element of the body starts; any other
hidden element without an end tag hides nothing, and block elements end an open svg or math; quotes that don't enclose a
value are ordinary characters; a page cut off inside a tag, comment, script or style loses that rest; very long pages are read whole, in sequence batches of bounded size; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import bisect
import collections
import functools
import html
import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnloom.llm.common import pieces, to_batch

#: Elements that end a block, elements without text of the page, elements without an end.
BLOCKS = set("html body head title main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend label button select option blockquote pre figure figcaption details summary address hr iframe center menu dialog".split())
HIDDEN = set("script style noscript template textarea svg math canvas object head title iframe select".split())
RAW = set("script style noscript template textarea iframe title".split())
CODE, FOREIGN = {"script", "style"}, {"svg", "math"}
VOID = set("br hr img input meta link area base col embed source track wbr".split())
#: Elements that can start in a head; any other ends it, as text does.
IN_HEAD = set("html head title base basefont bgsound link meta style script noscript noframes template".split())
#: Elements whose start ends a sibling before it that has no end tag: the siblings, and where the search stops.
_LIST, _TERMS, _CELLS = ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"tr", "table"})
SIBLINGS = {"li": _LIST, "dt": _TERMS, "dd": _TERMS, "td": _CELLS, "th": _CELLS, "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "option": ({"option"}, {"select"})}
PATH_SIZE, WORD_SIZE, SHAPE_SIZE = 160, 48, 15
INPUT = PATH_SIZE + WORD_SIZE + SHAPE_SIZE
HIDDEN_UNITS = 20
#: Elements of a path, counted from the block; outer ones don't count.
DEPTH = 48
GENERATED_PAGES, SAMPLE_PAGES, EPOCHS, BATCH_PAGES = 1200, 60, 14, 24
#: Blocks in one labelled batch of pages, unless a single page has more.
BATCH_BLOCKS = 12_000

#: A comment, a declaration, or a tag. A quoted value may hold ``>`` if its quote ends before white space, ``/`` or ``>``;
#: any other quote is an ordinary character, so an odd one can't swallow the text behind the tag.
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "linked", "inside")

    def __init__(self, path: tuple, text: str, linked: float, inside: tuple = ()) -> None:
        self.path, self.text, self.linked, self.inside = path, text, linked, inside


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. A path is a tuple of (element, words of class and id)."""
    out: list[Block] = []
    stack: list[tuple] = []
    serials: list[int] = []
    texts: list[str] = []
    state = {"link": 0, "linked": 0, "hidden": 0, "foreign": 0}
    number = itertools.count()
    open_now: collections.Counter[str] = collections.Counter()
    marks: dict[str, tuple[list[int], list[int]]] = {}
    endless: set[str] = set()

    def close() -> None:
        if texts:
            raw = "".join(texts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(tuple(stack[-DEPTH:]), text, min(1.0, state["linked"] / len(raw)), tuple(serials[-DEPTH:])))
            texts.clear()
            state["linked"] = 0

    def pop() -> None:
        name = stack.pop()[0]
        serials.pop()
        open_now[name] -= 1
        state["hidden"] -= name in HIDDEN
        state["foreign"] -= name in FOREIGN

    def end_head() -> None:
        while stack and stack[-1][0] == "head":
            pop()

    def ends(name: str, at: int) -> bool:
        """Whether the element that starts before ``at`` has an end tag of its own."""
        if name not in marks:
            found = [(m.start(), m[1]) for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.IGNORECASE)]
            marks[name] = [k for k, end in found if not end], [k for k, end in found if end]
        opened, closed = marks[name]
        return len(closed) - bisect.bisect_left(closed, at) > len(opened) - bisect.bisect_left(opened, at)

    at, n = 0, len(page)
    search = _TAG.search
    while at < n:
        m = search(page, at)
        start = m.start() if m else n
        if stack and stack[-1][0] == "head" and page[at:start].strip(" \t\n\f\r"):
            end_head()
        if start > at and not state["hidden"]:
            texts.append(page[at:start])
            if state["link"]:
                state["linked"] += start - at
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if not m[1] and name not in IN_HEAD:
            end_head()
        if m[1]:  # an end tag
            if name == "a":
                state["link"] = 0
            elif name in BLOCKS or name in HIDDEN:
                if open_now[name]:
                    close()
                    while stack[-1][0] != name:
                        pop()
                    pop()
                elif name in BLOCKS:
                    close()
        elif name == "br":
            texts.append(" ")
        elif name == "a":
            state["link"] = 1
        elif name in RAW:
            if name in BLOCKS:
                close()
            end = name not in endless and re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                if name in CODE and not m[3].rstrip().endswith("/"):
                    at = n
        elif name in BLOCKS or name in HIDDEN:
            while name in BLOCKS and state["foreign"]:
                pop()
            close()
            if stack and stack[-1][0] == "p":
                pop()
            if name in SIBLINGS:
                same, around = SIBLINGS[name]
                first = None
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in around:
                        break
                    if stack[k][0] in same:
                        first = k
                while first is not None and len(stack) > first:
                    pop()
            closed = name in VOID or name in FOREIGN and m[3].rstrip().endswith("/") or name in HIDDEN and name != "head" and not ends(name, at)
            if not closed:
                words = tuple(w for g in _NAMES.findall(m[3]) for w in _WORD.findall(" ".join(g).lower())) if m[3] else ()
                stack.append((name, words))
                serials.append(next(number))
                open_now[name] += 1
                state["hidden"] += name in HIDDEN
                state["foreign"] += name in FOREIGN
    close()
    return out


class _Buckets(dict):
    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.size
        return value


_PATHS, _WORDS = _Buckets(PATH_SIZE), _Buckets(WORD_SIZE)


@functools.lru_cache(maxsize=4096)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_SIZE, np.float32)
    for depth, (name, words) in enumerate(reversed(path)):
        weight = 1.0 if depth < 3 else 0.7
        v[_PATHS["<" + name]] += weight
        for w in words:
            v[_PATHS["." + w]] += 1.5 * weight
    return v


def vectors(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, INPUT), np.float32)
    if not n:
        return out
    words = [b.text.lower().split() for b in page]
    sizes = np.array([len(w) for w in words])
    buckets = np.fromiter(map(_WORDS.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    counts = np.bincount(np.repeat(np.arange(n) * WORD_SIZE, sizes) + buckets, minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt((counts**2).sum(1, keepdims=True))
    for i, b in enumerate(page):
        text = b.text
        out[i, :PATH_SIZE] = _path_vector(b.path)
        out[i, PATH_SIZE + WORD_SIZE + 1 : PATH_SIZE + WORD_SIZE + 9] = (b.linked, 10 * (text.count(".") + text.count(",")) / len(text), "©" in text or "opyright" in text, text[-1] in ".!?", 2 * i / n - 1, len(b.path) / 8, text[0].isupper(), min(1.0, 20 / n))
    out[:, PATH_SIZE + WORD_SIZE] = np.log1p(sizes) / 4
    out[:, PATH_SIZE + WORD_SIZE + 9 :] = _surroundings(page)
    return out


def _surroundings(page: list[Block]) -> np.ndarray:
    """Of the elements one, two and three levels around each block: share of the page's text, and share of links in it."""
    size: collections.Counter[int] = collections.Counter()
    linked: collections.Counter[int] = collections.Counter()
    for b in page:
        for k in b.inside[-4:]:
            size[k] += len(b.text)
            linked[k] += len(b.text) * b.linked
    total = sum(len(b.text) for b in page)
    out = np.zeros((len(page), 6), np.float32)
    for i, b in enumerate(page):
        for level in range(3):
            k = b.inside[-2 - level] if len(b.inside) > 1 + level else None
            out[i, 2 * level : 2 * level + 2] = (size[k] / total, linked[k] / size[k]) if size[k] else (1.0, 0.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 9) -> None:
        draw, h = np.random.default_rng(seed), HIDDEN_UNITS
        self.p: dict[str, np.ndarray] = {"out": draw.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for d in "fb":
            self.p["x" + d] = draw.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * h))
            self.p["h" + d] = draw.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states in time order; ``d`` is f (forward) or b (backward). keep: gets what the gradient needs."""
        steps, rows, h = len(x), x.shape[1], HIDDEN_UNITS
        z = x @ self.p["x" + d] + self.p["b" + d]
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        out = np.zeros((steps, rows, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + state @ self.p["h" + d]
            gates, g = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            m = mask[t][:, None]
            new = f * cell + i * g
            bent = np.tanh(new)
            if keep is not None:
                keep.append((t, state, cell, i, f, o, g, bent, m))
            cell, state = new * m, o * bent * m
            out[t] = state
        return out

    def _logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], 2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[: len(page), k], mask[: len(page), k] = page, 1
        return x, mask

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time; a label below 0 is unknown."""
        x, mask = self._padded(pages)
        y, known = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
        for k, own in enumerate(labels):
            y[: len(own), k], known[: len(own), k] = np.maximum(own, 0), own >= 0
        keep: dict = {}
        p = _sigmoid(self._logits(x, mask, keep))
        n = max(1.0, known.sum())
        loss = float(-(known * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        err, h = known * (p - y) / n, HIDDEN_UNITS
        grads = {"out": np.tensordot(err, keep["both"], ([0, 1], [0, 1])), "bias": np.array([err.sum()])}
        for at, d in ((0, "f"), (h, "b")):
            dz = np.zeros((*mask.shape, 4 * h), np.float32)
            dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            gh = np.zeros_like(self.p["h" + d])
            for t, state, cell, i, f, o, g, bent, m in reversed(keep[d]):
                dh = (dh + err[t][:, None] * self.p["out"][at : at + h]) * m
                dc = dc * m + dh * o * (1 - bent**2)
                da = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], 1)
                dz[t] = da
                gh += state.T @ da
                dc, dh = dc * f, da @ self.p["h" + d].T
            grads |= {"x" + d: np.tensordot(x, dz, ([0, 1], [0, 1])), "h" + d: gh, "b" + d: dz.sum((0, 1))}
        return loss, grads

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 5) -> None:
        draw = random.Random(seed)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        groups = [order[k : k + BATCH_PAGES] for k in range(0, len(order), BATCH_PAGES)]
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            draw.shuffle(groups)
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for group in groups:
                _, grads = self.gradients([pages[k] for k in group], [labels[k] for k in group])
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which blocks are article; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            size = max(1, BATCH_BLOCKS // longest)
            group, order = order[-size:], order[:-size]
            logits = self._logits(*self._padded([pages[k] for k in group]))
            for i, k in enumerate(group):
                out[k] = logits[: len(pages[k]), i] > 0
        return out


# --- training pages -------------------------------------------------------------------------------------------------

#: Elements and class words that tell a region; None: no class; a question mark: a made-up word.
_ARTICLE = [("article", None), ("article", "post"), ("main", None), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("section", "story"), ("div", "entry"), ("div", "main-text"), ("main", "page-content"), ("section", None), ("div", "inhalt"), ("div", "contenu"), ("div", "contenido"), ("div", "body text"), ("div", "article"), ("div", "main")]
_ANONYMOUS = [("div", None), ("div", "?"), ("section", "?"), ("div", None), ("div", "? ?")]
_REGIONS = {
    "menu": [("nav", None), ("nav", "menu"), ("div", "nav"), ("ul", "menu"), ("div", "navbar"), ("div", "breadcrumbs"), ("nav", "breadcrumb"), ("div", "site-nav"), ("div", "toc")],
    "header": [("header", None), ("div", "header"), ("header", "site-header"), ("div", "masthead"), ("div", "topbar"), ("div", "logo")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("div", "banner"), ("section", "consent"), ("div", "alert"), ("div", "newsletter"), ("aside", "notice"), ("p", "disclaimer"), ("div", "cookie-bar")],
    "advert": [("div", "ad"), ("div", "advert"), ("div", "ads"), ("aside", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("section", "ad-slot"), ("p", "ad"), ("div", "advertisement"), ("div", "werbung")],
    "side": [("aside", None), ("div", "sidebar"), ("aside", "sidebar"), ("div", "related"), ("section", "related-posts"), ("div", "widget"), ("aside", "popular"), ("aside", None)],
    "form": [("form", None), ("form", "search"), ("form", "subscribe"), ("div", "login"), ("form", "contact")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("section", "discussion"), ("div", "responses"), ("div", "reader-comments"), ("div", "reactions"), ("section", "replies"), ("div", "kommentare"), ("div", "commentaires"), ("div", "comentarios"), ("div", "feedback"), ("section", "reactions")],
    "share": [("div", "share"), ("div", "social"), ("ul", "tags"), ("div", "byline-share"), ("div", "tags")],
    "footer": [("footer", None), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "legal"), ("div", "foot")],
}
_PHRASES = {
    "notice": ["We use cookies. Accept all cookies?", "Subscribe to our newsletter today.", "This site uses cookies to improve your visit.", "Please enable scripts.", "Sign up for free updates."],
    "advert": ["Buy now and save.", "Sponsored content", "Advertisement", "Best offer of the week."],
    "share": ["Share", "Tweet this", "Tags", "Print", "Email"],
    "footer": ["All rights reserved.", "© 2024 example", "Copyright", "Privacy policy", "Terms of use", "Imprint", "Contact", "Last updated"],
    "form": ["Search", "Your name", "Email address", "Submit", "Password", "Send"],
    "comments": ["Reply", "says:", "Posted by guest", "Report", "Leave a comment"],
}
_TOLD = ["Comments", "comments", "Leave a comment", "Replies", "Kommentare", "commentaires", "Comentarios", "Reactions"]


def _prose(draw: random.Random, n: int, stop: bool = True) -> str:
    letters = draw.choice(["etaoinshrdlu", "enisratdhulc", "eaosrnidlctu", "eéasintrulod"])
    words = ["".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(n)]
    for k in range(draw.randint(5, 14), n, draw.randint(6, 16)):
        words[k] += draw.choice([".", ",", ".", ";"])
    return (words[0].capitalize() + " " + " ".join(words[1:])).strip() + ("." if stop else "")


def generated_page(draw: random.Random) -> tuple[list[Block], list[int]]:
    """A page with a random layout and the label of each of its blocks."""
    page: list[str] = []
    labels: list[int] = []
    loose = draw.random() < 0.15  # end tags of paragraphs and items are left out
    table = draw.random() < 0.08  # regions are cells of a table
    plain_page = draw.random() < 0.25  # names tell little

    def named(name: str | None) -> str:
        if not name:
            return ""
        name = name.replace("?", "{}").format(*("".join(draw.choices("abcdefghiklmnoprstuvw", k=draw.randint(2, 7))) for _ in range(2)))
        return f' {draw.choice(["class", "class", "id"])}="{name}{draw.choice(["", "", " x" + str(draw.randint(1, 9)), " wrap"])}"'

    def end(tag: str) -> str:
        return "" if loose and tag in ("p", "li", "dt", "dd") else f"</{tag}>"

    def put(text: str, label: int, tag: str = "p", inner: str | None = None) -> None:
        page.append(f"<{tag}>{inner or text}{end(tag.split()[0])}")
        labels.append(label)

    def region(tag: str, name: str | None, fill) -> None:
        if table and tag not in ("p", "ul", "ol") and draw.random() < 0.7:
            page.append(f"<tr><td{named(name) if draw.random() < 0.3 else ''}>")
            fill()
            page.append("</td></tr>")
            return
        page.append(f"<{tag}{named(name)}>")
        fill()
        page.append(f"</{tag}>")

    def inside(kind: str, fill) -> None:
        tag, name = draw.choice(_REGIONS[kind])
        if plain_page and draw.random() < 0.6:
            tag, name = draw.choice(_ANONYMOUS)
        region("div" if tag in ("p", "ul", "ol") else tag, name, lambda: fill(kind))

    def links(kind: str) -> None:
        if draw.random() < 0.3:
            put(_prose(draw, draw.randint(1, 3), False), 0, draw.choice(["h2", "h3", "h4"]))
        names = [_prose(draw, draw.choice([1, 1, 2, 3, 5, 8]), False) for _ in range(draw.randint(2, 8))]
        way = draw.random()
        if way < 0.35:  # one line of links
            page.append("<p>" * (way < 0.1) + draw.choice([" ", " | ", " - ", " · "]).join(f'<a href="/{draw.random():.4f}">{x}</a>' for x in names) + "</p>" * (way < 0.1))
            labels.append(0)
            return
        tag = "li" if way < 0.9 else "div"
        page.append("<ul>" * (tag == "li"))
        for text in names:
            put(text, 0, tag, f'<a href="/{draw.random():.4f}">{text}</a>')
        page.append("</ul>" * (tag == "li"))

    def words(kind: str) -> None:
        for _ in range(draw.randint(1, 2)):
            text = draw.choice(_PHRASES[kind]) if draw.random() < 0.5 else _prose(draw, draw.randint(2, 14))
            if draw.random() < 0.4:
                text += " " + _prose(draw, draw.randint(2, 10))
            put(text, 0, draw.choice(["p", "div", "p", "div"]) if kind != "form" else draw.choice(["label", "button", "p"]))

    def bare(kind: str) -> None:
        page.append((draw.choice(_PHRASES[kind]) + " " if draw.random() < 0.5 else "") + _prose(draw, draw.randint(2, 14)))
        labels.append(0)

    def comments(kind: str) -> None:
        if draw.random() < 0.5:
            text = draw.choice([f"{draw.choice(_TOLD)} ({draw.randint(1, 40)})", f"{draw.randint(1, 40)} {draw.choice(_TOLD)}", draw.choice(_TOLD)])
            put(text, 0, draw.choice(["h2", "h3", "h4"]))
        tag = draw.choice(["div", "article", "p", "li", "article"])
        named_each = draw.random() < 0.5
        page.append("<ul>" * (tag == "li"))
        for _ in range(draw.randint(1, 5)):
            page.append(f'<{tag} class="comment">' if tag != "p" and named_each else f"<{'div' if tag == 'p' else tag}>")
            if draw.random() < 0.7:
                put(_prose(draw, draw.randint(1, 2), False) + draw.choice(["", " " + draw.choice(_PHRASES[kind])]), 0, draw.choice(["div", "h3", "h4", "p", "div"]))
            put(_prose(draw, draw.randint(3, 50)), 0)
            if draw.random() < 0.2:
                put("Reply", 0, "div", '<a href="#">Reply</a>')
            page.append(f"</{'div' if tag == 'p' else tag}>")
        page.append("</ul>" * (tag == "li"))
        if draw.random() < 0.2:
            put("Leave a comment", 0)

    def filled(kind: str) -> None:
        inside(kind, links if kind in ("menu", "side") and draw.random() < 0.8 else comments if kind == "comments" else bare if kind in _PHRASES and draw.random() < 0.6 else words if kind in _PHRASES else plain)

    def plain(kind: str) -> None:
        for _ in range(draw.randint(1, 2)):
            put(_prose(draw, draw.randint(1, 20), draw.random() < 0.5), 0, draw.choice(["p", "div", "h2", "h3", "div"]) if kind != "header" else draw.choice(["div", "p", "h2"]))

    def items(tag: str) -> None:
        page.append(f"<{tag}>")
        long = draw.random() < 0.4
        for _ in range(draw.randint(2, 5)):
            put(_prose(draw, draw.randint(10, 30) if long else draw.randint(1, 12), draw.random() < 0.6), 1, "li")
        page.append(f"</{tag}>")

    def terms() -> None:
        page.append("<dl>")
        for _ in range(draw.randint(2, 4)):
            put(_prose(draw, draw.randint(1, 3), False), 1, "dt")
            put(_prose(draw, draw.randint(4, 25)), 1, "dd")
        page.append("</dl>")

    def cells() -> None:
        page.append("<table>")
        for _ in range(draw.randint(2, 4)):
            page.append("<tr>")
            for _ in range(2):
                put(draw.choice([_prose(draw, draw.randint(1, 3), False), str(draw.randint(0, 999) / 10)]), 1, draw.choice(["td", "td", "th"]))
            page.append("</tr>")
        page.append("</table>")

    def body() -> None:
        if draw.random() < 0.92:
            put(_prose(draw, draw.randint(1, 12), draw.random() < 0.3), 1, draw.choice(["h1", "h1", "h2"]))
        if draw.random() < 0.12:
            put(draw.choice(["Posted by ", "By ", "Written by ", "Published on "]) + _prose(draw, draw.randint(1, 5), False) + draw.choice(["", f" {draw.randint(1, 28)} May {draw.randint(1999, 2024)}"]), 0, draw.choice(["p class='meta'", "div class='byline'", "p class='date'"]))
        for _ in range(draw.choice([1, 2, 3, 4, 7, 12])):
            kind = draw.random()
            if kind < 0.70:
                text = _prose(draw, draw.choice([draw.randint(1, 6), draw.randint(5, 90), draw.randint(10, 40)]))
                if draw.random() < 0.25:
                    text = text + f' <a href="/x">{_prose(draw, 2, False)}</a> ' + _prose(draw, 5)
                put(text, 1)
            elif kind < 0.78:
                put(_prose(draw, draw.randint(1, 6), False), 1, draw.choice(["h2", "h3"]))
            elif kind < 0.82:
                put(_prose(draw, draw.randint(4, 30)), 1, "blockquote")
            elif kind < 0.87:
                items(draw.choice(["ul", "ol"]))
            elif kind < 0.89:
                terms()
            elif kind < 0.91:
                cells()
            elif kind < 0.94:
                put(_prose(draw, 8), 1, draw.choice(["pre", "figcaption", "p"]))
            else:
                filled(draw.choice(["advert", "share", "notice", "side", "form", "advert", "side"]))
        if draw.random() < 0.1:
            filled("comments")

    def article() -> None:
        way = draw.random()
        if way < (0.25 if plain_page else 0.05):  # no element of its own
            return body()
        tag, name = draw.choice(_ANONYMOUS) if plain_page and way < 0.85 else ("article", None) if way < 0.5 else draw.choice(_ARTICLE)
        nested = draw.random()

        def fill() -> None:
            page.append("<div>" * (nested < 0.25) + "<section>" * (nested < 0.05))
            body()
            page.append("</section>" * (nested < 0.05) + "</div>" * (nested < 0.25))

        region(tag, name, fill)

    page.append("<html><body>")
    depth = draw.choice([0, 0, 0, 0, 1, 1, 2, 4])
    page.append("".join(f'<div{draw.choice(["", named(draw.choice(["page", "wrapper", "container", "site"]))])}>' for _ in range(depth)))
    page.append("<table>" * table)
    for kind in ("header", "notice", "menu", "form", "side", "advert", "share"):
        if draw.random() < (0.75 if kind == "menu" else 0.4 if kind in ("header", "advert") else 0.22):
            filled(kind)
    if draw.random() < 0.95:
        article()
    for kind in ("share", "advert", "side", "comments", "form", "notice", "menu", "footer"):
        if draw.random() < (0.8 if kind == "footer" else 0.4 if kind == "comments" else 0.3):
            filled(kind)
    page.append("</table>" * table + "</div>" * depth + "</body></html>")
    return blocks("".join(page)), labels


_OUTSIDE = {"nav", "footer", "aside", "form"}
_SIGNS = {"ad", "ads", "advert", "advertisement", "sponsored", "sidebar", "comments", "comment", "cookie", "menu", "footer"}


def sure_labels(page: list[Block]) -> np.ndarray:
    """1 inside an article element, 0 inside what is never part of one, -1 where neither tells."""
    out = np.full(len(page), -1, np.float32)
    for i, b in enumerate(page):
        if any(name in _OUTSIDE or _SIGNS & set(words) for name, words in b.path):
            out[i] = 0
        elif any(name == "article" for name, _ in b.path):
            out[i] = 1
    return out


def fit(pages: DataFrame | None = None) -> BlockLabeller:
    """Train on generated pages and on a bounded sample of ``pages`` (html)."""
    draw = random.Random(3)
    made = []
    while len(made) < GENERATED_PAGES:
        page, labels = generated_page(draw)
        if page and len(page) == len(labels):
            made.append((vectors(page), np.array(labels, np.float32)))
    if pages is not None:
        # Drawn by a hash, so that what tasks send doesn't grow with their number; repeated pages count once.
        draw_at = F.pmod(F.xxhash64("html"), F.lit(1 << 30))
        share = min(1.0, 2 * SAMPLE_PAGES / max(1, pages.count()))
        able = pages.select("html", draw_at.alias("draw")).where(F.length("html").between(1, 40_000) & (F.col("draw") < int(share * (1 << 30)) + 1))
        rows = able.distinct().orderBy("draw", "html").limit(SAMPLE_PAGES).collect()
        made += [(vectors(page), sure_labels(page)) for page in map(blocks, [r.html for r in rows]) if page]
    model = BlockLabeller()
    model.train([x for x, _ in made], [y for _, y in made])
    return model


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [blocks(x.as_py() or "") for x in batch.column(2)]
            kept = shared.value.label([vectors(page) for page in found])
            texts = [" ".join([b.text for b, k in zip(page, keep, strict=True) if k]) for page, keep in zip(found, kept, strict=True)]
            yield to_batch({"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, _SCHEMA)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
