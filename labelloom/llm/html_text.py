"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, each with the path of elements above it. A
bidirectional LSTM in numpy reads a vector per block (hashed path elements, hashed words,
a few shares) and labels every block as article or not, with the whole page as context.
It is trained here, on pages put together from a bounded sample of the table's own text
and a list of page furniture, so that the label of every block is known.
"""

from __future__ import annotations

import html as html_module
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, as_key, small_batches

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend"
    " li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style textarea title iframe".split())
#: What may stand in a head; it ends where any other element or text begins.
HEAD_TAGS = frozenset("head title meta link base style script noscript template".split())
#: An open element of the key ends where one of the values begins.
ENDS = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>"'<]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>\"'<]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Element:
    """An open element; blocks hold the innermost one above them, so that a path is shared by all blocks below it, however deep it is."""

    __slots__ = ("above", "depth", "name", "tag", "vector")

    def __init__(self, tag: str, name: str, above: Element | None):
        self.tag, self.name, self.above, self.vector = tag, name, above, None
        self.depth: int = above.depth + 1 if above else 1

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at:
            out.append(at.name)
            at = at.above
        return tuple(out[::-1])


class Stack:
    """The open elements, with the places of each tag, so that no tag looks through all of them."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    def push(self, tag: str, name: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK_TAGS:
            self.block_places.append(len(self.open))
        self.open.append(Element(tag, name, self.open[-1] if self.open else None))

    def cut(self, place: int) -> None:
        """Close the elements from a place on."""
        for e in self.open[place:]:
            self.places[e.tag].pop()
            if e.tag in BLOCK_TAGS:
                self.block_places.pop()
        del self.open[place:]

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def end(self, tag: str) -> None:
        """An end tag closes the last element of its name; one that is no block reaches out of no block."""
        if self.has(tag):
            place = self.places[tag][-1]
            if tag in BLOCK_TAGS or not self.block_places or self.block_places[-1] < place:
                self.cut(place)


def _raw_end(page: str, at: int, tag: str, open_ended: set[str]) -> int:
    """Where the content of a raw element ends. One that is never closed takes the rest if it is a script or a style, else the text up to the next tag."""
    if tag not in open_ended:
        end = re.compile(rf"</{tag}\b", re.I).search(page, at)
        if end:
            close = page.find(">", end.end())
            return len(page) if close < 0 else close + 1
        open_ended.add(tag)
    if tag in ("script", "style"):
        return len(page)
    following = page.find("<", at)
    return len(page) if following < 0 else following


def leaf_blocks(page: str, starts: list[int] | None = None) -> list[tuple[Element | None, str, int]]:
    """(innermost element, text, code points within links) of every leaf block that has text; into starts goes where each one's text starts. Time grows with the page's length, whatever is left open in it.

    Character references are decoded in each piece of text by itself: one that a tag cuts is none.
    """
    out: list[tuple[Element | None, str, int]] = []
    stack, text, open_ended = Stack(), [], set()
    linked, at, n, began, blank = 0, 0, len(page), 0, True
    last = page.rfind(">")

    def close_block() -> None:
        nonlocal linked, blank
        if text:
            said = " ".join("".join(text).split())
            if said and not stack.has("head"):
                out.append((stack.open[-1] if stack.open else None, said, linked))
                if starts is not None:
                    starts.append(began)
            text.clear()
        linked, blank = 0, True

    def close_head() -> None:
        close_block()
        stack.cut(stack.places["head"][0])

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            if stack.open and stack.open[-1].tag == "head" and not page[at:start].isspace():
                close_head()
            if blank:
                began, blank = at, page[at:start].isspace()
            text.append(html_module.unescape(page[at:start]))
            if any(e.tag == "a" for e in stack.open[-3:]):
                linked += start - at
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        # behind the last > nothing is a tag
        m = (_TAG.match(page, start) or _LOOSE.match(page, start)) if start < last else None
        if not m:
            began, blank = start if blank else began, False
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                close_block()
            stack.end(tag)
            continue
        if tag not in HEAD_TAGS and stack.has("head") and (tag == "body" or not stack.has("template")):
            close_head()
        if tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                at = _raw_end(page, at, tag, open_ended)
            continue
        if tag in BLOCK_TAGS:
            close_block()
            while stack.open and (tag in ENDS.get(stack.open[-1].tag, ()) or (stack.open[-1].tag not in BLOCK_TAGS and any(tag in ENDS.get(e.tag, ()) for e in stack.open[-4:]))):
                stack.cut(len(stack.open) - 1)
        elif tag == "br":
            text.append(" ")
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            names = " ".join(w for g in _NAMES.finditer(m[3]) for w in _PART.findall((g[1] or g[2] or g[3] or "").lower())) if m[3] else ""
            stack.push(tag, f"{tag} {names}" if names else tag)
    close_block()
    return out


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, code points within links) of every leaf block that has text; a path element is 'tag name name'."""
    return [(e.path() if e else (), text, linked) for e, text, linked in leaf_blocks(page)]


PATH_DIMS, WORD_DIMS, SHARES = 512, 16, 7
DIMS = PATH_DIMS + WORD_DIMS + SHARES
NO_PATH = np.zeros(PATH_DIMS, np.float32)


@lru_cache(maxsize=50_000)
def _places(name: str) -> tuple[int, ...]:
    """An element's places in the vector of a path: two a token, so that hardly two tokens share both. Names of the page's own elements say nothing of its blocks."""
    tag, *names = name.split()
    tokens = (f"<{tag}", *(names if tag not in ("html", "body") else ()))
    return tuple(zlib.crc32(salt + token.encode()) % PATH_DIMS for token in tokens for salt in (b"", b"2"))


def _path_vector(element: Element | None) -> np.ndarray:
    """1 at the places of all elements of a path; elements that add none share the vector of the one above."""
    todo = []
    while element and element.vector is None:
        todo.append(element)
        element = element.above
    v = element.vector if element else NO_PATH
    for e in reversed(todo):
        places = list(_places(e.name))
        if not v[places].all():
            v = v.copy()
            v[places] = 1
        e.vector = v
    return v


def chain(path: tuple[str, ...]) -> Element | None:
    """The innermost element of a path."""
    element = None
    for name in path:
        element = Element(name.split()[0], name, element)
    return element


def vectors(page: list[tuple[Element | tuple[str, ...] | None, str, int]]) -> np.ndarray:
    """A row for each block of leaf_blocks() or blocks()."""
    out = np.zeros((len(page), DIMS), np.float32)
    for i, (above, text, linked) in enumerate(page):
        element = chain(above) if isinstance(above, tuple) else above
        out[i, :PATH_DIMS] = _path_vector(element)
        words = text.encode().split()
        counts = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_DIMS, minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = counts / max(1, len(words))
        size = len(text)
        out[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(size) / 8, min(1.0, linked / size), min(1.0, 8 * (text.count(".") + text.count(",")) / size),
            len(words) < 4, len(words) > 15, i / len(page), min(1.0, (element.depth if element else 0) / 12),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """One LSTM layer each way, and a logistic output over both states and the block's own vector."""

    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator) -> BlockLabeller:
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.15, (DIMS, 4 * hidden)).astype(np.float32)
            p[f"h{way}"] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
            p[f"b{way}"] = np.r_[np.ones(hidden), np.zeros(3 * hidden)].astype(np.float32)
        p["o"] = rng.normal(0, 0.1, 2 * hidden + DIMS).astype(np.float32)
        p["c"] = np.zeros(1, np.float32)
        return cls(p)

    def _way(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: steps x pages x dims; padding stands where mask is 0 and carries the state on."""
        wh, hidden = self.params[f"h{way}"], len(self.params[f"h{way}"])
        drive = x @ self.params[f"x{way}"] + self.params[f"b{way}"]
        h = np.zeros((x.shape[1], hidden), np.float32)
        c = np.zeros_like(h)
        states, tape = np.zeros((*x.shape[:2], hidden), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = drive[t] + h @ wh
            f, i, o = (_sigmoid(g[:, k * hidden : (k + 1) * hidden]) for k in range(3))
            z = np.tanh(g[:, 3 * hidden :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * z, c)
            tanh_c = np.tanh(c_new)
            h_new = np.where(m, o * tanh_c, h)
            if keep:
                tape.append((t, h, c, f, i, o, z, tanh_c, m))
            h, c = h_new, c_new
            states[t] = h
        return states, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._way(x, mask, "f", False)[0], self._way(x, mask, "b", False)[0], x], axis=2)
        return both @ self.params["o"] + self.params["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        (sf, tf), (sb, tb) = self._way(x, mask, "f", True), self._way(x, mask, "b", True)
        both = np.concatenate([sf, sb, x], axis=2)
        p = _sigmoid(both @ self.params["o"] + self.params["c"])
        n = mask.sum()
        loss = -(np.where(y > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n
        d = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.tensordot(d, both, ([0, 1], [0, 1])), "c": np.array([d.sum()], np.float32)}
        hidden = sf.shape[2]
        for way, tape, at in (("f", tf, 0), ("b", tb, hidden)):
            wh = self.params[f"h{way}"]
            gx, gh = np.zeros_like(self.params[f"x{way}"]), np.zeros_like(wh)
            gb = np.zeros(4 * hidden, np.float32)
            dh = np.zeros((x.shape[1], hidden), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, f, i, o, z, tanh_c, m in reversed(tape):
                dh = dh + d[t][:, None] * self.params["o"][at : at + hidden]
                live, rest = np.where(m, dh, 0), np.where(m, 0, dh)
                dcc = np.where(m, dc, 0) + live * o * (1 - tanh_c**2)
                dg = np.concatenate([dcc * c * f * (1 - f), dcc * z * i * (1 - i), live * tanh_c * o * (1 - o), dcc * i * (1 - z**2)], axis=1)
                gx += x[t].T @ dg
                gh += h.T @ dg
                gb += dg.sum(axis=0)
                dh = dg @ wh.T + rest
                dc = dcc * f + np.where(m, 0, dc)
            grads |= {f"x{way}": gx, f"h{way}": gh, f"b{way}": gb}
        return float(loss), grads

    def label(self, pages: list[np.ndarray], group: int = 256) -> list[np.ndarray]:
        """Whether each block belongs to the article; pages of like lengths go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            size = max(1, min(group, 20_000 // len(pages[order[min(at + group, len(order)) - 1]])))
            own = order[at : at + size]
            at += size
            x, mask = padded([pages[i] for i in own])
            yes = self.logits(x, mask) > 0
            for j, i in enumerate(own):
                out[i] = yes[: len(pages[i]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


# Openings of page furniture; 'L' takes link lists, 'T' short text, 'P' paragraphs.
FURNITURE = [
    ("<nav>", "L"), ("<nav class='menu'>", "L"), ("<div class='navbar nav'>", "L"), ("<ul class='menu'>", "L"), ("<div id='navigation'>", "L"), ("<div class='breadcrumb breadcrumbs'>", "L"),
    ("<header>", "LT"), ("<header class='masthead'>", "LT"), ("<div id='header' class='site header'>", "LT"), ("<div class='banner top'>", "T"),
    ("<footer>", "TL"), ("<footer class='site footer'>", "TL"), ("<div id='footer'>", "TL"), ("<div class='copyright legal'>", "T"),
    ("<aside>", "LTP"), ("<aside class='sidebar'>", "LTP"), ("<div class='sidebar'>", "LTP"), ("<div id='sidebar'>", "LTP"), ("<div class='widget'>", "LT"), ("<section class='related recommended'>", "LT"), ("<div class='related posts'>", "LT"),
    ("<div class='ad'>", "TP"), ("<div class='ads advert'>", "TP"), ("<div class='advertisement'>", "TP"), ("<div class='sponsored sponsor promo'>", "TP"), ("<section class='promo'>", "TP"), ("<ins class='adsbygoogle'>", "T"), ("<div id='ad'>", "TP"),
    ("<div class='cookie notice'>", "TP"), ("<div class='cookie banner consent'>", "TP"), ("<div class='notice'>", "TP"), ("<div id='notice'>", "TP"), ("<div class='alert popup modal'>", "TP"), ("<div role='alert'>", "T"), ("<dialog>", "TP"),
    ("<form>", "TP"), ("<form action='/s'>", "TP"), ("<form method='post'>", "TP"), ("<form class='search'>", "TP"), ("<form id='contact'>", "TP"), ("<form class='newsletter subscribe'>", "TP"), ("<div class='newsletter subscribe signup'>", "TP"), ("<div class='login'>", "T"),
    ("<div class='comments'>", "PT"), ("<section class='comments'>", "PT"), ("<section id='comments'>", "PT"), ("<div class='comment'>", "PT"), ("<ol class='comment list'>", "P"), ("<div class='discussion replies reply'>", "PT"), ("<div id='disqus thread'>", "PT"),
    ("<div class='skip link'>", "L"), ("<div class='logo brand'>", "T"), ("<nav class='toc'>", "L"), ("<div class='toc contents'>", "L"), ("<div class='author bio'>", "PT"), ("<div class='previous next links'>", "L"), ("<section class='reviews ratings'>", "PT"), ("<div class='toolbar actions'>", "LT"),
    ("<div class='social share'>", "L"), ("<div class='tags'>", "L"), ("<div class='pagination pager'>", "L"), ("<div class='byline author meta'>", "T"),
]
ARTICLES = ["<article>", "<article class='post'>", "<main>", "<main><article>", "<div class='content'>", "<div id='content'>", "<div class='post entry'>", "<div class='article body'>", "<section class='story'>", "<div id='main'>", "<article class='entry content'>", "<article class='hentry'>", "<main class='site main'>", "<div role='main' class='document body'>", "<div class='text'>", "<section>", "<div>", ""]
#: Openings within an article, around its title and around the rest.
TITLES = ["", "", "", "<header>", "<header class='entry header'>", "<div class='title headline'>"]
BODIES = ["", "", "", "<div class='entry content'>", "<div class='article body'>", "<div class='text'>", "<section>", "<section id='part'>", "<div>"]


def made_page(texts: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page of known labels: furniture around, and some within, an article."""
    page = ["<html><body>"]

    def text(kind: str) -> str:
        t = rng.choice(texts)
        words = t.split() or ["x"]
        size = {"T": rng.randint(1, 14), "P": rng.randint(6, 120), "L": rng.randint(1, 3)}[kind]
        start = rng.randrange(max(1, len(words) - size))
        return html_module.escape(" ".join(words[start : start + size]) or "x")

    def named(opening: str) -> str:
        """With names of no meaning, so that what is not in the lists does not look like what is."""

        def more(m: re.Match) -> str:
            own = [m[1], *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice((0, 0, 0, 1, 1, 2))))]
            return f"<{own[0]}" if len(own) == 1 else f"<{own[0]} data-x='' id='{' '.join(own[1:])}'"

        return re.sub(r"<([a-z]+)", more, opening)

    def furniture() -> None:
        opening, kinds = rng.choice(FURNITURE)
        kind = rng.choice(kinds)
        page.append(named(opening))
        for _ in range(rng.randint(2, 8) if kind == "L" else rng.randint(1, 5 if "comment" in opening else 2)):
            inner = text(kind)
            if kind == "L":
                inner = rng.choice(["<li><a href='/x'>{}</a></li>", "<div><a href='/x'>{}</a></div>"]).format(inner)
            elif kind == "P" or rng.random() < 0.3:
                inner = f"<p>{inner}</p>" if "<ol" not in opening else f"<li><p>{inner}</p></li>"
            else:
                inner = rng.choice(["<div>{}</div>", "<span>{}</span><br>", "<label>{}</label>"]).format(inner) if "<form" in opening else f"<div>{inner}</div>"
            page.append(inner)
        page.append("".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening))))

    ends_at: list[tuple[int, bool]] = []

    def add(yes: bool, action) -> None:
        action()
        ends_at.append((sum(map(len, page)), yes))

    for _ in range(rng.randint(0, 4)):
        add(False, furniture)
    opening = rng.choice(ARTICLES)
    wrap = rng.choice(["", "", "<div class='wrapper container'>", "<div id='page'>"])
    page.append(named(wrap + opening))
    ends = lambda opening: "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))
    if rng.random() < 0.8:
        around = rng.choice(TITLES)
        add(True, lambda: page.append(f"{named(around)}<h1>{text('T')}</h1>{ends(around)}"))
    body = rng.choice(BODIES)
    page.append(named(body))
    for _ in range(rng.randint(1, 14)):
        if rng.random() < 0.07:
            add(False, furniture)
            continue
        shape = rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}<br><p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<p>{} <a href='/y'>{}</a> {}</p>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<ol><li>{}<li>{}</ol>", "<ul><li>{}</li><li>{}</li></ul>", "<h3>{}</h3>"])
        short = rng.random() < 0.2 or shape.startswith("<h")
        add(True, lambda s=shape, k=short: page.append(s.format(*(text("T" if k else "P") for _ in range(s.count("{}"))))))
    page.append(ends(wrap + opening + body))
    for _ in range(rng.randint(0, 5)):
        add(False, furniture)
    page.append("</body></html>")
    starts: list[int] = []
    leaf_blocks("".join(page), starts)
    # a block is of the part that its text starts in
    parts = np.searchsorted([end for end, _ in ends_at], starts, side="right")
    return "".join(page), [ends_at[k][1] for k in parts if k < len(ends_at)]


def train(texts: list[str], n_pages: int = 1200, epochs: int = 12, hidden: int = 12, seed: int = 11) -> BlockLabeller:
    """Adam over made pages; the same texts and seed give the same weights."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    texts = [t for t in texts if t.strip()] or ["some words of a page"]
    made = []
    while len(made) < n_pages:
        page, labels = made_page(texts, draw)
        found = leaf_blocks(page)
        if len(found) == len(labels) and found:
            made.append((vectors(found), np.array(labels, np.float32)))
    model = BlockLabeller.new(hidden, rng)
    m1 = {k: np.zeros_like(v) for k, v in model.params.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 32):
            own = [made[i] for i in order[at : at + 32]]
            x, mask = padded([v for v, _ in own])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(own):
                y[: len(labels), j] = labels
            _, grads = model.gradients(x, mask, y)
            step += 1
            rate = 0.012 * (1 - epoch / epochs) + 0.001
            for k, g in grads.items():
                g = np.clip(g, -1, 1) + 1e-4 * model.params[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model.params[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
    return model


SAMPLE_PAGES, SAMPLE_CHARS = 200, 8000


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BlockLabeller:
    """Trained on the words of SAMPLE_PAGES pages, chosen by a hash of their id, SAMPLE_CHARS of each at most."""
    keyed = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("k"), F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, SAMPLE_CHARS).alias("html"))
    # keys first, as every task hands in as many as are asked for; then the html of the chosen ones
    chosen = [r.k for r in keyed.select("k").orderBy("k").limit(SAMPLE_PAGES).collect()]
    rows = keyed.where(F.col("k").isin(chosen)).orderBy("k", "html").limit(SAMPLE_PAGES)
    return train([t for r in rows.collect() for _, t, _ in leaf_blocks(r.html)])


def main_text(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, n_kept.

    text: the article's blocks in page order, joined by two newlines; empty if there are
    none or the html is null. An empty table gives an empty result. Within a block white space is one space; br is white space.
    Null ids and urls are returned as they are; other columns are ignored.
    """
    model = model or fit(pages, id_col, html_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at : at + 1024]
                found = [leaf_blocks(h) for h in part["html"]]
                yes = model.label([vectors(b) for b in found])
                texts = ["\n\n".join(t for (_, t, _), y in zip(b, keep, strict=True) if y) for b, keep in zip(found, yes, strict=True)]
                yield pd.DataFrame({
                    "page_id": list(part["page_id"]), "url": list(part["url"]), "text": texts, "n_chars": [len(t) for t in texts],
                    "n_blocks": [len(b) for b in found], "n_kept": [int(k.sum()) for k in yes],
                })

    chosen = pages.select(as_key(F.col(id_col)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return as_id(small_batches(chosen).mapInPandas(run, "page_id string, url string, text string, n_chars long, n_blocks long, n_kept long"), "page_id")
