"""HTML extraction: a recurrent labeller reads the leaf blocks of a page and keeps the main text.

A page becomes a sequence of leaf blocks. Each block is a vector of its tag path (names, classes
and ids of the elements around it, hashed), of its hashed words and of a few shares such as link
density. A bidirectional LSTM in numpy reads the sequence both ways, so each block is judged in the
light of the whole page. The network is trained here, on the driver, from a bounded sample of
pages: where a page says by its elements what is main text, that is the label; copies of these
pages with renamed elements and added notices, forms and comments teach it to use the rest.

Scripts, styles, frames and fields are read up to their end tag. The text of drawings, templates,
replacements (noscript, object) and choices is left out as a side up to the end of the element, which
a slash, the next option or the end of an element around it may be; formulas are text.

Defined cases: a null page is an empty one; a page without main text gives the empty text; broken
markup is read as far as it goes; rows with equal ids are read one by one; without pages to learn
from, the elements alone decide.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, lowest, small_batches

PATH_SLOTS, WORD_SLOTS, SHARES, HIDDEN = 128, 32, 8, 16
INPUTS = PATH_SLOTS + WORD_SLOTS + SHARES
#: The labeller learns from at most this many pages, those with the smallest digests, each of at
#: most SAMPLE_CHARS characters.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 50_000
COPIES = 6  # of each page, with other elements and sides

# Element names by the way they are read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr math annotation annotation-xml maction menclose merror mfenced mfrac mi "
    "mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable "
    "mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose text is a side that is not shown as part of the text around; blocks go on across them.
ASIDE = frozenset("svg template noscript object select datalist optgroup option".split())
#: Elements that end an open drawing or choice, which cannot hold them.
BREAKS = frozenset("article blockquote div dl dt dd h1 h2 h3 h4 h5 h6 li main ol p pre section table ul".split())
SIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notification pagination popup promo related reply replies share sharing sidebar signup social sponsor sponsored "
    "subscribe tags toolbar widget".split())
FIRM = frozenset(
    "nav footer aside dialog menu related promo sponsor sponsored ad ads advert adverts advertisement comments replies "
    "newsletter cookie cookies consent popup modal widget".split())
MAIN_WORDS = frozenset("article content entry main post story text body-text".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_EMPTY = re.compile(r"""(?<![^\s"'])/\s*\Z|(?:\A|\s)[^\s"'=/]+/\s*\Z""")  # a slash that is not in a bare value
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between the borders of block elements."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    path: tuple[str, ...] = ()
    parts: list[str] = []
    linked = links = 0
    at, lower = 0, None
    lasts: dict[str, int] = {}
    hidden = -1  # place in the stack of the outermost element whose text is left out

    def last_end(name: str) -> int:
        """Where the last end tag of this name begins."""
        if name not in lasts:
            lasts[name] = max((x.start() for x in re.finditer(f"</{name}(?![a-z0-9:-])", page, re.I)), default=-1)
        return lasts[name]

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, path, linked))
            parts.clear()
        linked = 0

    while (tag := _TAG.search(page, at)) is not None:
        if tag.start() > at and hidden < 0:
            parts.append(page[at : tag.start()])
            linked += (tag.start() - at) * (links > 0)
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing = bool(tag[1] or tag[4])
        drawn = hidden >= 0 and any(x == "svg" for x, _ in stack[hidden:])
        empty = not closing and (drawn or name in ASIDE) and _EMPTY.search(tag[3] or tag[6] or "") is not None
        if hidden >= 0:
            kind = stack[hidden][0]
            if closing and name not in INLINE:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None and depth < hidden:  # the end of an element around it
                    del stack[hidden:]
                    hidden = -1
            elif not closing and name in BREAKS and kind not in ("template", "noscript", "object"):
                if not any(x == "foreignobject" for x, _ in stack[hidden:]):
                    del stack[hidden:]
                    hidden = -1
        if empty:
            continue
        if name == "br":
            parts.append(" ")
        elif hidden >= 0 and name not in RAW:
            if closing:
                depth = next((i for i in range(len(stack) - 1, hidden - 1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
                    hidden = hidden if depth > hidden else -1
            elif name not in VOID and name not in INLINE:
                if name in ("option", "optgroup") and stack[-1][0] == "option":
                    stack.pop()
                    hidden = hidden if len(stack) > hidden else len(stack)
                stack.append((name, ()))
        elif name in ASIDE:
            # without any end tag only an option, which may do without one, hides what follows
            if not closing and (name in ("option", "optgroup") or last_end(name) >= at):
                hidden = len(stack)
                stack.append((name, ()))
        elif name in RAW:
            if not closing:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
                at = len(page) if end < 0 else end
        elif name in INLINE:
            links = max(0, links + (-1 if closing else 1)) if name == "a" else links
        elif name not in VOID or name == "hr":
            close()
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
                    links = 0
            elif name != "hr":
                if stack and stack[-1][0] == "p":
                    stack.pop()
                elif stack and stack[-1][0] == name and name in ("li", "td", "tr", "dd", "dt"):
                    stack.pop()
                attributes = (tag[3] or tag[6] or "").lower()
                named = " ".join(next(filter(None, x), "") for x in _NAMED.findall(attributes)) if "=" in attributes else ""
                stack.append((name, (f"<{name}", *_PART.findall(named))))
            path = tuple(word for _, words in stack for word in words)
    if at < len(page) and hidden < 0:
        parts.append(page[at:])
    close()
    return found


def elements_of(path: tuple[str, ...]) -> list[tuple[str, set[str]]]:
    """Name and words of each element of a path, innermost first; the page's own words do not count."""
    found: list[tuple[str, set[str]]] = []
    for word in path:
        if word[0] == "<":
            found.append((word[1:], set()))
        elif found and found[-1][0] not in ("html", "body"):
            found[-1][1].add(word)
    return found[::-1]


def told(path: tuple[str, ...]) -> float:
    """What the elements say: 1 main text, 0 not, 0.5 nothing.

    The nearest element that says anything decides; main text does not stand inside FIRM sides, though.
    """
    around = elements_of(path)
    for i, (name, words) in enumerate(around):
        if name in SIDE or words & SIDE_WORDS or name == "head":
            return 0.0
        if name in ("article", "main") or words & MAIN_WORDS:
            return 0.0 if any(x in FIRM or y & FIRM for x, y in around[i + 1 :]) else 1.0
    return 0.5


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages in turn."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), INPUTS), np.float32)
    if not flat:
        return out
    slots, owners = [], []
    for i, block in enumerate(flat):
        for depth, word in enumerate(reversed(block.path)):
            slots.append(zlib.crc32(word.encode()) % PATH_SLOTS)
            owners.append(i)
            if depth < 4:  # the nearest elements count twice
                slots.append(zlib.crc32(b"near " + word.encode()) % PATH_SLOTS)
                owners.append(i)
    np.add.at(out, (owners, slots), 1)
    words = [b.text.encode().split() for b in flat]
    counts = np.array([len(x) for x in words])
    codes = np.fromiter((zlib.crc32(w) for x in words for w in x), np.int64, counts.sum()) % WORD_SLOTS
    rows = np.repeat(np.arange(len(flat)), counts)
    bags = np.bincount(rows * WORD_SLOTS + codes, minlength=len(flat) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    out[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.log1p(bags)
    at = PATH_SLOTS + WORD_SLOTS
    chars = np.array([len(b.text) for b in flat], np.float32)
    out[:, at] = np.log1p(counts) / 5
    out[:, at + 1] = np.minimum(1, np.array([b.linked for b in flat]) / np.maximum(1, chars))
    out[:, at + 2] = [b.text[-1] in ".!?:;\"'" for b in flat]
    out[:, at + 3] = [len(b.path) / 12 for b in flat]
    place = 0
    for page in pages:
        n = len(page)
        out[place : place + n, at + 4] = np.arange(n) / max(1, n)
        place += n
    out[:, at + 5] = chars / np.maximum(1, counts) / 10
    out[:, at + 6] = ["©" in b.text for b in flat]
    out[:, at + 7] = 1
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.parts = []
        for _ in range(2):
            self.parts += [
                draw.normal(0, 0.1, (INPUTS, 4 * HIDDEN)), draw.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)),
                np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])]
        self.parts += [draw.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)]

    def _padded(self, rows: np.ndarray, lengths: np.ndarray):
        """Places of every block in a (time, page) grid, read forwards and backwards."""
        firsts = np.cumsum(lengths) - lengths
        page = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(rows)) - np.repeat(firsts, lengths)
        return page, time, np.repeat(lengths, lengths) - 1 - time

    def _read(self, rows, page, time, shape, part, keep=False):
        """Hidden states of one direction, at every block; what going back needs, if kept."""
        weights, recurrent, bias = self.parts[3 * part : 3 * part + 3]
        gates = np.zeros((*shape, 4 * HIDDEN))
        gates[time, page] = rows @ weights + bias
        inside = np.zeros(shape, bool)
        inside[time, page] = True
        h = np.zeros((shape[1], HIDDEN))
        c = np.zeros_like(h)
        states, tape = np.zeros((*shape, HIDDEN)), []
        for t in range(shape[0]):
            z = gates[t] + h @ recurrent
            f, i, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            live = inside[t][:, None]
            before = (h, c)
            c = np.where(live, new, c)
            h = np.where(live, o * np.tanh(new), h)
            states[t] = h
            if keep:
                tape.append((before, f, i, o, g, new, live))
        return states, tape

    def scores(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of main text for every block of pages with these numbers of blocks."""
        out = np.zeros(len(rows))
        if not len(rows):
            return out
        firsts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        for chosen in np.array_split(order, len(order) // 64 + 1):  # pages of like length together
            chosen = chosen[lengths[chosen] > 0]
            if len(chosen):
                index = np.concatenate([np.arange(firsts[k], firsts[k] + lengths[k]) for k in chosen])
                out[index] = self._forward(rows[index], lengths[chosen])[0]
        return out

    def _forward(self, rows, lengths, keep=False):
        page, time, back = self._padded(rows, lengths)
        shape = (int(lengths.max()), len(lengths))
        one, tape_one = self._read(rows, page, time, shape, 0, keep)
        two, tape_two = self._read(rows, page, back, shape, 1, keep)
        both = np.concatenate([one[time, page], two[back, page]], axis=1)
        z = both @ self.parts[6] + self.parts[7]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), (page, time, back, shape, both, tape_one, tape_two)

    def gradients(self, rows, lengths, labels, weight):
        """Loss gradients of all parts, by going back through time."""
        shown, (page, time, back, shape, both, tape_one, tape_two) = self._forward(rows, lengths, True)
        error = (shown - labels) * weight / max(1.0, weight.sum())
        grads = [np.zeros_like(p) for p in self.parts]
        grads[6], grads[7] = both.T @ error, np.array([error.sum()])
        down = error[:, None] * self.parts[6]
        for part, (places, tape) in enumerate(((time, tape_one), (back, tape_two))):
            recurrent = self.parts[3 * part + 1]
            given = np.zeros((*shape, HIDDEN))
            given[places, page] = down[:, part * HIDDEN : (part + 1) * HIDDEN]
            dh, dc = np.zeros((shape[1], HIDDEN)), np.zeros((shape[1], HIDDEN))
            dz_all = np.zeros((*shape, 4 * HIDDEN))
            for t in range(shape[0] - 1, -1, -1):
                (h, c), f, i, o, g, new, live = tape[t]
                dh = dh + given[t]
                bent = np.tanh(new)
                dnew = np.where(live, dc + dh * o * (1 - bent**2), 0)
                dz = np.concatenate([
                    dnew * c * f * (1 - f), dnew * g * i * (1 - i),
                    np.where(live, dh * bent, 0) * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                grads[3 * part + 1] += h.T @ dz
                dc = np.where(live, dnew * f, dc)
                dh = np.where(live, dz @ recurrent.T, dh)
            flat = dz_all[places, page]
            grads[3 * part] = rows.T @ flat
            grads[3 * part + 2] = flat.sum(0)
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 9, rate: float = 0.02,
              batch: int = 32) -> Labeller:
        """Adam over batches of pages in a fixed random order; labels of 0.5 are left out."""
        draw = np.random.default_rng(5)
        first, second = ([np.zeros_like(p) for p in self.parts] for _ in range(2))
        step, last = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = [pages[k] for k in order[at : at + batch] if len(pages[k][1])]
                if not chosen:
                    continue
                rows = np.concatenate([x for x, _ in chosen]).astype(float)
                labels = np.concatenate([y for _, y in chosen])
                lengths = np.array([len(y) for _, y in chosen])
                grads = self.gradients(rows, lengths, labels, (labels != 0.5).astype(float))
                step += 1
                for p, g, m, v in zip(self.parts, grads, first, second):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    p -= rate * (1 - 0.9 * step / last) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


_ADDED = (
    ("div", "cookie notice", "We use cookies"), ("aside", "", "Most read"), ("div", "sidebar", "Related"),
    ("form", "", "Your e-mail Send"), ("section", "comments", "Great post, thanks for sharing"),
    ("div", "c{n}", "Sign in"), ("header", "", "Home"))
#: What an article may hold besides paragraphs, as paths, and whether such blocks are often short.
_INSIDE = (
    (("<ul", "<li"), True), (("<ul", "<li"), True), (("<ol", "<li"), True), (("<table", "<tr", "<td"), True), (("<table", "<tr", "<th"), True),
    (("<table", "<tbody", "<tr", "<td"), True), (("<dl", "<dt"), True), (("<dl", "<dd"), False), (("<section", "<h2"), True),
    (("<section", "<h3"), True), (("<section", "<p"), False), (("<h2",), True), (("<h4",), True), (("<blockquote", "<p"), False),
    (("<pre",), False), (("<figure", "<figcaption"), True), (("<div", "<p"), False), (("<div", "box", "<ul", "<li"), True))
#: Whole sides: the element and its words, and the paths of the blocks that it holds.
_SIDES = (
    (("<div", "sidebar"), (("<h3",), ("<ul", "<li"), ("<ul", "<li"), ("<ul", "<li"))),
    (("<aside",), (("<h2",), ("<p",), ("<p",))), (("<div", "related"), (("<h4",), ("<a",), ("<p",))),
    (("<section", "comments"), (("<h3",), ("<div", "comment", "<p"), ("<div", "comment", "<p"), ("<div", "comment", "<p"))),
    (("<ol", "comment", "list"), (("<li", "<p"), ("<li", "<p"))), (("<footer",), (("<p",), ("<ul", "<li"), ("<ul", "<li"))),
    (("<div", "footer"), (("<table", "<tr", "<td"), ("<table", "<tr", "<td"))), (("<nav",), (("<ul", "<li"),) * 5),
    (("<div", "menu"), (("<ul", "<li"),) * 4), (("<form",), (("<dl", "<dt"), ("<dl", "<dd"), ("<p",))),
    (("<div", "widget"), (("<h3",), ("<table", "<tr", "<td"), ("<p",))), (("<div", "cookie", "notice"), (("<p",), ("<p",))))
_PAGE_WORDS = (
    (), (), ("home", "page"), ("has", "sidebar", "comments", "open"), ("single", "post", "logged"), ("no", "js", "menu", "closed"))
_RENAMED = ("div content", "div post", "main ", "div c{n}", "section entry", "div x{n}", "article ")


def varied(page: list[Block], draw: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A copy of a page with other element names and some more side blocks; labels stay."""
    names = {}
    for old in ("<article", "<main", "<nav", "<footer", "<header", "<aside"):
        choice = str(draw.choice(_RENAMED if old in ("<article", "<main") else ("div c{n}", "div x{n}", "nav ", "div menu", "footer ")))
        element, _, word = choice.replace("{n}", str(draw.integers(10))).partition(" ")
        names[old] = (f"<{element}", *_PART.findall(word))
    labels = [told(b.path) for b in page]
    words = _PAGE_WORDS[int(draw.integers(len(_PAGE_WORDS)))]
    wrap = (("<div", f"c{int(draw.integers(10))}"), ("<div", "wrap"), ("<div", "layout"), ())[int(draw.integers(4))]
    opened = {"<body": ("<body", *words, *wrap)} | names
    main_words = [b.text.split() for b, y in zip(page, labels) if y == 1]
    out, going = [], 0
    for b, y in zip(page, labels):
        text, path = b.text, tuple(w for x in b.path for w in opened.get(x, (x,)))
        if y == 1 and path[-1] == "<h1" and draw.random() < 0.4:  # an article need not begin with a title
            path = (*path[:-1], *((("<h2",), ("<section", "<h2"), ("<p",), ("<div", "<h3"))[int(draw.integers(4))]))
            text = " ".join(text.split()[: int(draw.integers(1, 9))])
        elif y == 1 and path[-1] == "<p":
            if not going and draw.random() < 0.25:  # a list or table goes on for some blocks
                inside, short = _INSIDE[int(draw.integers(len(_INSIDE)))]
                going = int(draw.integers(1, 6))
            if going:
                going -= 1
                path = (*path[:-1], *inside)
                if short and draw.random() < 0.8:
                    text = " ".join(text.split()[: int(draw.integers(1, 9))])
        out.append(Block(text, path, min(b.linked, len(text))))
    texts = [b.text for b, y in zip(page, labels) if y == 1] or [""]
    for _ in range(int(draw.integers(0, 4))):
        element, word, text = _ADDED[int(draw.integers(len(_ADDED)))]
        path = ("<html", "<body", f"<{element}", *_PART.findall(word.replace("{n}", str(draw.integers(10)))))
        main = [k for k, y in enumerate(labels) if y == 1]
        edges = [0, len(out)] + ([main[0], main[-1] + 1] if main else [])
        place = int(draw.choice(edges))
        if word == "comments":
            text = texts[int(draw.integers(len(texts)))][:200] or text
            path = (*path, "<p")
        out.insert(place, Block(text, path, len(text) * int(draw.integers(2))))
        labels.insert(place, 0.0)
    for _ in range(int(draw.integers(1, 4))):  # sides with words like the article's, beside or inside it
        element, leaves = _SIDES[int(draw.integers(len(_SIDES)))]
        if draw.random() < 0.4:
            element = (str(draw.choice(["<div", "<section", "<ul"])), str(draw.choice(sorted(SIDE_WORDS))))
        main = [k for k, y in enumerate(labels) if y == 1]
        place = int(draw.choice([0, len(out), *([main[0], main[-1] + 1, *main[:3]] if main else [])]))
        within = place < len(out) and place and labels[place] == labels[place - 1] == 1
        around = out[place].path[: next((i for i, x in enumerate(out[place].path) if i and x == "<p"), 3)] if within else ("<html", "<body", *words, *wrap)
        side = []
        for leaf in leaves:
            said = main_words[int(draw.integers(len(main_words)))] if main_words else ["Home"]
            text = " ".join(said[: int(draw.integers(1, 30))])
            side.append(Block(text, (*around, *element, *leaf), len(text) * int(draw.random() < 0.6)))
        out[place:place] = side
        labels[place:place] = [0.0] * len(side)
    return out, np.array(labels)


def train_from(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller | None:
    """A labeller from a bounded sample of pages whose elements say what is main text."""
    short = pages.select(F.col("html").cast("string").alias("html")).where(F.length("html") <= SAMPLE_CHARS)
    rows = lowest(short, ["html"], sample_pages).collect()
    parsed = [x for x in (blocks(r["html"]) for r in rows) if x]
    known = [x for x in parsed if any(told(b.path) == 1 for b in x) and any(told(b.path) == 0 for b in x)]
    if not known:
        return None
    draw = np.random.default_rng(11)
    taught = []
    for page in known:
        taught.append((vectors([page]), np.array([told(b.path) for b in page])))
        for _ in range(COPIES):
            copy, labels = varied(page, draw)
            taught.append((vectors([copy]), labels))
    return Labeller().train(taught)


def extract(pages: list[str], labeller: Labeller | None, least: float = 0.5) -> list[str]:
    """Main text of each page: the blocks that the labeller keeps, joined by one space."""
    parsed = [blocks(page) for page in pages]
    if labeller is None:
        return [" ".join(b.text for b in page if told(b.path) > 0) for page in parsed]
    lengths = np.array([len(x) for x in parsed], np.int64)
    kept = labeller.scores(vectors(parsed), lengths) >= least
    out, at = [], 0
    for page in parsed:
        out.append(" ".join(b.text for b, k in zip(page, kept[at : at + len(page)]) if k))
        at += len(page)
    return out


def extracted(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # a fixed number of weights
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))

    def work(batch: pa.RecordBatch) -> dict:
        found = extract([x or "" for x in batch.column("html").to_pylist()], shared.value)
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found,
                "n_chars": [len(x) for x in found]}

    return arrow_map(rows, work, "page_id bigint, url string, text string, n_chars bigint")
