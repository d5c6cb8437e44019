"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf sequence: blocks of text between block-level tags, in page order, each with
the tags, classes and ids on its path. Every block gets a vector: the mean of learned vectors of its
hashed path tokens, the mean of learned vectors of its hashed words, and a few measures (length, link
density, depth). A bidirectional LSTM reads the whole page's sequence, so a block is labelled in the
context of all others, and blocks labelled as main text are joined.

The net is numpy, trained here (``page_sample`` makes labelled pages of many templates from a rule
and a seed; TRAIN_PAGES of them, a fixed number). Training is repeatable and done once a process.

Defined results: a null, empty or text-free page gives an empty text; text that no tag closes (a cut
page) counts up to its end; a self-closed hidden element is empty, and one that no tag closes inside
its parent block hides nothing (script and style, as in browsers, the rest); the text of math, object
and noscript is page text; repeated rows are labelled each; null keys and addresses are carried; an
empty table gives an empty result. Pages are taken whole; a page of many thousand blocks runs alone.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import ship

PATH_SPACE, WORD_SPACE = 2048, 2048
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 20, 8, 6, 24
WORD_SHRINK = 4             # a block of few words says little by them
TRAIN_PAGES, EPOCHS, BATCH = 1600, 4, 32

# fixed values: elements whose text is never page text (code; plain text without elements; elements),
# elements that end a block, and void elements
CODE_TAGS = ("script", "style")
PLAIN_TAGS = ("iframe", "textarea", "title")
HELD_TAGS = frozenset(("template", "svg", "select", "button"))
BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul").split())
BREAKS = frozenset(("hr",))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<code>" + "|".join(CODE_TAGS) + r")(?=[\s/>])(?:[^<>]*+(?<=/)>|.*?(?:</(?P=code)\s*>|\Z))"
    r"|<(?P<plain>" + "|".join(PLAIN_TAGS) + r")(?=[\s/>])(?:[^<>]*+(?<=/)>|(?:[^<]++|<(?!/?(?P=plain)[\s/>]))*+</(?P=plain)\s*>)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    links: float
    depth: int


@dataclass
class _Held:
    """An open element of HELD_TAGS, and where the page stood before it."""

    tag: str
    depth: int
    parts: list[str]
    n_parts: int
    n_out: int
    in_link: int
    linked: int
    gone: bool = False


def _ids(*tokens: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(t.encode()) % PATH_SPACE for t in tokens)


def _element(tag: str, attrs: str) -> tuple[int, ...]:
    tokens = [f"tag {tag}"]
    if attrs and "=" in attrs:
        for match in _NAMES.finditer(attrs):
            tokens += [f"name {part.lower()}" for part in _PART.findall(match[1] or match[2] or match[3] or "")]
    return _ids(*tokens)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with character references decoded and white space joined."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    held: list[_Held] = []                                             # open ones, the innermost last
    open_of: dict[str, list[_Held]] = {name: [] for name in HELD_TAGS}  # the same by tag
    in_link, linked = 0, 0

    def let_go() -> _Held:
        """The innermost open element ends; ones that were taken out before go with it. Every element goes once."""
        last = held.pop()
        open_of[last.tag].pop()
        while held and held[-1].gone:
            held.pop()
        return last

    def flush() -> None:
        nonlocal linked, parts
        if parts:
            text = " ".join("".join(parts).split())
            parts = []  # the old list may be taken up again when a held element closes
            if text:
                path = tuple(i for _, tokens in stack for i in tokens) + (_ids(f"last {stack[-1][0]}") if stack else ())
                out.append(Block(text, path, min(1.0, linked / len(text)), len(stack)))
        linked = 0

    for match in _TOKEN.finditer(page or ""):
        text = match["text"]
        if text is not None:
            decoded = entities.unescape(text) if "&" in text else text
            parts.append(decoded)
            if in_link:
                linked += len(decoded.strip())
            continue
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if match["close"] else 1
        elif tag in HELD_TAGS:
            same = open_of[tag][-1] if open_of[tag] else None
            if match["close"]:
                if same:  # all since its start goes
                    parts, in_link, linked = same.parts, same.in_link, same.linked
                    del parts[same.n_parts:], out[same.n_out:], stack[same.depth:]
                    while let_go() is not same:
                        pass
            elif not match["attrs"].endswith("/"):
                if same and tag in ("select", "button"):  # not nested: the open one was never closed
                    if held[-1] is same:
                        let_go()
                    else:
                        open_of[tag].pop().gone = True
                held.append(_Held(tag, len(stack), parts, len(parts), len(out), in_link, linked))
                open_of[tag].append(held[-1])
        elif tag in BREAKS:
            flush()
        elif tag in BLOCK_TAGS:
            flush()
            while held and held[-1].tag == "svg":  # blocks are not part of a drawing
                let_go()
            if match["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        while held and held[-1].depth > i:  # not closed inside its parent
                            let_go()
                        break
            else:
                while len(stack) > (held[-1].depth if held else 0) and tag in _CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                stack.append((tag, _element(tag, match["attrs"])))
    flush()
    return out


def measures(blocks: list[Block]) -> np.ndarray:
    rows = [(np.log1p(len(b.text)) / 6, b.links, min(b.depth, 20) / 10, float(b.text[-1] in ".!?:;\"”»"),
             i / len(blocks), np.log1p(b.text.count(" ")) / 5) for i, b in enumerate(blocks)]
    return np.array(rows, dtype=np.float32).reshape(len(blocks), MEASURES)


@dataclass
class Sequences:
    """Blocks of several pages, flat: measures, and hashed path tokens and words with n + 1 offsets."""

    first: np.ndarray       # pages' first blocks, n + 1
    measures: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray


def sequences(pages: list[list[Block]]) -> Sequences:
    flat = [b for page in pages for b in page]
    found = W.scan(pa.array([b.text for b in flat], pa.large_string()), lower=True)
    sizes = [len(b.path) for b in flat]
    return Sequences(
        np.concatenate(([0], np.cumsum([len(p) for p in pages]))).astype(np.int64),
        np.concatenate([measures(p) for p in pages if p]) if flat else np.zeros((0, MEASURES), np.float32),
        np.array([i for b in flat for i in b.path], dtype=np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        (found.hashes() % W.U64(WORD_SPACE)).astype(np.int64), found.first)


def _means(table: np.ndarray, ids: np.ndarray, at: np.ndarray, shrink: int = 0) -> np.ndarray:
    """Mean vector of each range of ids (zero for an empty range), as if ``shrink`` zero vectors stood with it."""
    n = np.diff(at)
    out = np.zeros((len(n), table.shape[1]), dtype=np.float32)
    full = np.flatnonzero(n)
    for i in range(0, len(full), 4096):  # bounded memory, whatever a block's length
        own = full[i:i + 4096]
        part = table[ids[at[own[0]]:at[own[-1] + 1]]]
        out[own] = np.add.reduceat(part, at[own] - at[own[0]]) / (n[own, None] + shrink)
    return out


@dataclass
class Labeller:
    """Weights: vectors of path tokens and words, two LSTMs (input, recurrent, bias), the output."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        p = {"path": r.normal(0, 0.3, (PATH_SPACE, PATH_DIM)), "word": r.normal(0, 0.1, (WORD_SPACE, WORD_DIM)),
             "out": r.normal(0, 0.2, (2 * HIDDEN, 1)), "out_b": np.zeros(1)}
        for way in ("f", "b"):
            p[f"{way}_x"] = r.normal(0, d ** -0.5, (d, 4 * HIDDEN))
            p[f"{way}_h"] = r.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
            p[f"{way}_b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, s: Sequences) -> np.ndarray:
        return np.concatenate((_means(self.p["path"], s.path, s.path_at), _means(self.p["word"], s.word, s.word_at, WORD_SHRINK), s.measures), axis=1)

    def _lstm(self, way: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN); a page's state stays still where ``live`` is 0."""
        w, u, b = (self.p[f"{way}_{k}"] for k in "xhb")
        steps, n, _ = x.shape
        gates = x @ w + b
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ u
            g = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            cell = f * c + i * a
            if keep is not None:
                keep.append((t, h, c, i, f, o, a, cell))
            m = live[t][:, None]
            c = m * cell + (1 - m) * c
            h = m * (o * np.tanh(cell)) + (1 - m) * h
            out[t] = h
        return out

    def _laid_out(self, s: Sequences, pages: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = s.first[pages + 1] - s.first[pages]
        spot = s.first[pages][None, :] + np.arange(n.max())[:, None]
        live = (np.arange(n.max())[:, None] < n[None, :])
        spot = np.where(live, spot, 0)
        return x[spot] * live[:, :, None], live.astype(np.float32), spot

    def scores(self, s: Sequences) -> np.ndarray:
        """Log-odds of each block; pages of like length run side by side."""
        x, out = self.inputs(s), np.zeros(len(s.measures), dtype=np.float32)
        n = np.diff(s.first)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 256 and n[order[j]] * (j - i + 1) <= 20_000:
                j += 1
            data, live, spot = self._laid_out(s, order[i:j], x)
            h = np.concatenate((self._lstm("f", data, live), self._lstm("b", data, live)), axis=2)
            z = (h @ self.p["out"])[:, :, 0] + self.p["out_b"]
            out[spot[live > 0]] = z[live > 0]
            i = j
        return out

    def gradients(self, s: Sequences, pages: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the blocks of some pages, and its gradients (through time, both ways)."""
        x = self.inputs(s)
        data, live, spot = self._laid_out(s, pages, x)
        kept = {"f": [], "b": []}
        h = np.concatenate([self._lstm(way, data, live, kept[way]) for way in "fb"], axis=2)
        z = (h @ self.p["out"])[:, :, 0] + self.p["out_b"]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        target, total = y[spot], live.sum()
        loss = -(live * (target * np.log(q + 1e-7) + (1 - target) * np.log(1 - q + 1e-7))).sum() / total
        dz = (live * (q - target) / total)[:, :, None].astype(np.float32)
        g = {"out": np.einsum("tnh,tno->ho", h, dz), "out_b": dz.sum(axis=(0, 1))}
        dh_all, dx = dz @ self.p["out"].T, np.zeros_like(data)
        for k, way in enumerate("fb"):
            w, u = self.p[f"{way}_x"], self.p[f"{way}_h"]
            gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros_like(self.p[f"{way}_b"])
            dh, dc = np.zeros((data.shape[1], HIDDEN), np.float32), np.zeros((data.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, a, cell in reversed(kept[way]):
                m = live[t][:, None]
                dh = dh + dh_all[t, :, k * HIDDEN:(k + 1) * HIDDEN]
                tanh = np.tanh(cell)
                dcell = m * (dc + dh * o * (1 - tanh * tanh))
                d = np.concatenate((dcell * a * i * (1 - i), dcell * c0 * f * (1 - f), m * dh * tanh * o * (1 - o), dcell * i * (1 - a * a)), axis=1)
                gw += data[t].T @ d
                gu += h0.T @ d
                gb += d.sum(axis=0)
                dx[t] += d @ w.T
                dh = d @ u.T + (1 - m) * dh
                dc = dcell * f + (1 - m) * dc
            g |= {f"{way}_x": gw, f"{way}_h": gu, f"{way}_b": gb}
        flat = np.zeros_like(x)
        flat[spot[live > 0]] = dx[live > 0]
        for name, ids, at, cols, shrink in (("path", s.path, s.path_at, slice(0, PATH_DIM), 0),
                                            ("word", s.word, s.word_at, slice(PATH_DIM, PATH_DIM + WORD_DIM), WORD_SHRINK)):
            n = np.diff(at)
            each = np.repeat(flat[:, cols] / np.maximum(n + shrink, 1)[:, None], n, axis=0)
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, each)
        return float(loss), g


# fixed values: names by which sites mark their parts, for training pages
_NAV = "nav menu navbar navigation topnav breadcrumb breadcrumbs mainmenu links".split()
_HEAD = "header masthead top branding banner head sitehead".split()
_FOOT = "footer foot bottom colophon copyright legal".split()
_SIDE = "sidebar side aside widget rail related recommended popular trending more secondary".split()
_AD = "ad ads advert advertisement sponsor sponsored promo promotion adbox".split()
_NOTICE = "cookie cookies consent notice alert gdpr popup modal newsletter subscribe message warning".split()
_FORM = "form login signup search contact register".split()
_TALK = "comments comment discussion replies disqus responses respond feedback reviews".split()
_SHARE = "share social tags meta byline pagination toolbar".split()
_MAIN = "article post entry content main story text body articlebody maincontent page news single".split()
_SAID = ("home about contact login sign subscribe cookies privacy policy terms share reply comments advertisement sponsored related "
         "copyright rights reserved menu search newsletter accept startseite impressum datenschutz accueil mentions inicio contacto").split()


class _Maker:
    """One labelled page: html, and a label for every block in page order."""

    def __init__(self, r: np.random.Generator):
        self.r, self.html, self.labels = r, [], []
        onset, vowel, coda = "bcdfghlmnprstvw", "aeiouéäó", ("", "n", "r", "s", "t", "nd")
        parts = r.integers(0, 1 << 30, (40, 3))
        syllables = [onset[a % len(onset)] + vowel[b % len(vowel)] + coda[c % len(coda)] for a, b, c in parts.tolist()]
        self.known = ["".join(syllables[i] for i in own[:n]) for own, n in zip(r.integers(40, size=(250, 3)).tolist(), r.integers(1, 4, 250).tolist())]
        self.odd = r.random() < 0.15  # a site whose names say nothing
        self.style = self.pick("", "", "", "", "shout", "repeat", "marks")  # of the main text's words

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def words(self, low: int, high: int, said: float = 0.0) -> str:
        n = int(self.r.integers(low, high + 1))
        made = [self.known[i] for i in self.r.integers(len(self.known), size=n).tolist()]
        if said:
            made = [self.pick(*_SAID) if x < said else w for w, x in zip(made, self.r.random(n).tolist())]
        if self.r.random() < 0.1:
            made.insert(int(self.r.integers(len(made) + 1)), self.pick("&amp;", "&quot;x&quot;", "&copy;", "###", "|", "2024", "%%%"))
        return " ".join(made).capitalize()

    def styled(self, low: int, high: int) -> str:
        """A paragraph of the main text in the page's style."""
        if self.style == "shout":
            return self.words(1, 30).upper().replace(" ", "!! ") + "!!" if self.r.random() < 0.8 else self.sentences(low, high)
        if self.style == "repeat" and self.r.random() < 0.5:
            return " ".join([self.words(1, 2)] * int(self.r.integers(2, 80)))
        if self.style == "marks":
            return self.words(1, 60).replace(" ", self.pick(" | ", "### ", "&amp;&amp;&amp; ", "%%% "))
        return self.sentences(low, high)

    def sentences(self, low: int, high: int, said: float = 0.0) -> str:
        out = [self.words(1, 16, said) + "." for _ in range(int(self.r.integers(low, high + 1)))]
        if self.r.random() < 0.25:
            begin, end = self.pick(("<b>", "</b>"), ("<em>", "</em>"), ('<a href="/x">', "</a>"), ("<b>", "<br>"))
            out[0] = begin + out[0] + end
        return " ".join(out)

    def block(self, tag: str, inner: str, label: int) -> None:
        close = "" if tag in ("p", "li") and self.r.random() < 0.1 else f"</{tag}>"
        self.html.append(f"<{tag}>{inner}{close}")
        self.labels.append(label)

    def named(self, names: list[str], tags: tuple[str, ...]) -> tuple[str, str]:
        tag, name = self.pick(*tags), self.pick(*names)
        if self.r.random() < 0.3:
            name = self.pick(f"site-{name}", f"{name}-{self.pick('wrap', 'box', 'inner', 'area', 'list')}", f"{name}{self.r.integers(9)}", f"js {name}")
        if self.odd or self.r.random() < 0.05:
            name = self.pick("x", "c1", "box", "css-a", "wrapper", "col", "row")
        kind = self.pick("class", "class", "id")
        return f'<{tag} {kind}="{name}">', f"</{tag}>"

    def part(self, names: list[str], element: str, fill) -> None:
        if element and self.r.random() < 0.5:
            begin, end = (f"<{element}>", f"</{element}>") if self.r.random() < 0.6 else (f'<{element} class="{self.pick(*names)}">', f"</{element}>")
        else:
            begin, end = self.named(names, ("div", "div", "section", "ul" if fill == self.items else "div"))
        self.html.append(begin)
        fill()
        self.html.append(end)

    def items(self) -> None:
        self.html.append("<ul>")
        for _ in range(int(self.r.integers(2, 9))):
            self.block("li", f'<a href="/{self.r.integers(99)}">{self.words(1, 3, 0.2)}</a>', 0)
        self.html.append("</ul>")

    def lines(self) -> None:
        for _ in range(int(self.r.integers(1, 4))):
            self.block(self.pick("p", "div", "span") if self.r.random() < 0.8 else "h3", self.sentences(1, 2, 0.1), 0) if self.r.random() < 0.5 else self.bare(0)

    def bare(self, label: int) -> None:
        self.html.append("<div>")
        self.html.append(self.sentences(1, 3, 0.05))
        self.html.append("</div>")
        self.labels.append(label)

    def loose(self) -> None:
        """Text directly inside the part, as in small adverts and footers."""
        self.html.append(self.pick("&copy; ", "", "") + self.sentences(1, 3, 0.05))
        self.labels.append(0)

    def talk(self) -> None:
        self.block("h3", self.words(1, 2, 0.5), 0)
        for _ in range(int(self.r.integers(1, 6))):
            self.html.append(self.pick('<div class="comment">', '<li class="reply">', "<div>", "<article class='comment'>"))
            closing = {"<l": "</li>", "<a": "</article>"}.get(self.html[-1][:2], "</div>")
            for _ in range(int(self.r.integers(1, 3))):
                self.block("p", self.sentences(1, 5), 0)
            self.html.append(closing)

    def entry_form(self) -> None:
        self.html.append('<form action="/go">')
        for _ in range(int(self.r.integers(1, 4))):
            self.block(self.pick("p", "div", "fieldset"), self.words(1, 8, 0.3), 0)
        self.html.append("</form>")

    def other(self, inside: bool = False) -> None:
        kinds = [(_AD, "", self.loose), (_AD, "aside", self.lines), (_NOTICE, "", self.loose), (_NOTICE, "", self.lines), (_SHARE, "", self.items), (_SIDE, "aside", self.lines),
                 (_SIDE, "aside", self.items), (_FORM, "", self.entry_form)]
        names, element, fill = kinds[int(self.r.integers(len(kinds)))]
        self.part(names, element, fill)

    def main(self) -> None:
        form = self.r.random()
        if form < 0.55:
            begin, end = "<article>" if self.r.random() < 0.6 else f'<article class="{self.pick(*_MAIN)}">', "</article>"
        elif form < 0.7:
            begin, end = "<main>", "</main>"
        else:
            begin, end = self.named(_MAIN, ("div", "div", "section", "td"))
        self.html.append(begin)
        if self.r.random() < 0.85:
            self.block(self.pick("h1", "h1", "h2"), self.words(3, 12), 1)
        short = self.r.random() < 0.3
        for _ in range(int(self.r.integers(20, 60) if self.r.random() < 0.08 else self.r.integers(1, 22))):
            kind = self.r.random()
            if kind < 0.8:
                self.block("p", self.words(1, 3) if short and self.r.random() < 0.3 else self.styled(1, 7), 1)
            elif kind < 0.84:
                self.block(self.pick("h2", "h3"), self.words(1, 6), 1)
            elif kind < 0.89:
                self.html.append("<ul>")
                for _ in range(int(self.r.integers(2, 5))):
                    self.block("li", self.sentences(1, 1), 1)
                self.html.append("</ul>")
            elif kind < 0.93:
                self.block(self.pick("blockquote", "pre", "div"), self.sentences(1, 3), 1)
            else:
                self.other(inside=True)
        self.html.append(end)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>')
        plain = r.random() < 0.3
        if not plain and r.random() < 0.6:
            self.part(_HEAD, "header", self.lines)
        if plain or r.random() < 0.8:
            self.part(_NAV, "nav", self.items)
        for _ in range(int(r.integers(0, 3))):
            self.html.append("<!-- part -->")
            self.other()
        if not plain and r.random() < 0.3:
            self.html.append(self.pick("<div>", '<div class="wrapper">', '<div id="container">'))
        self.main()
        if not plain and r.random() < 0.5:
            self.part(_TALK, "", self.talk)
        for _ in range(0 if plain else int(r.integers(0, 3))):
            self.other()
        if plain or r.random() < 0.85:
            self.part(_FOOT, "footer", self.pick(self.loose, self.lines, self.items))
        self.html.append("</body></html>")
        return "".join(self.html), self.labels


def page_sample(n: int, seed: int) -> tuple[list[list[Block]], np.ndarray]:
    """``n`` made pages as blocks, with a label per block; some pages are cut at a random place."""
    r = np.random.default_rng(seed)
    pages, labels = [], []
    while len(pages) < n:
        text, own = _Maker(r).page()
        found = blocks_of(text)
        if len(found) != len(own):
            continue
        if r.random() < 0.15:
            found = blocks_of(text[:int(len(text) * r.uniform(0.4, 1))])[:len(own)]
            own = own[:len(found)]
        if found:
            pages.append(found)
            labels += own
    return pages, np.array(labels, dtype=np.float32)


_TRAINED: dict[int, Labeller] = {}


def trained(seed: int = 7) -> Labeller:
    """The labeller, fitted on TRAIN_PAGES made pages by Adam; words and path tokens are dropped at
    random while training, so that neither alone decides."""
    if seed in _TRAINED:
        return _TRAINED[seed]
    pages, y = page_sample(TRAIN_PAGES, seed)
    net, r = Labeller.start(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    at = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    order, step, steps = np.argsort([len(p) for p in pages], kind="stable"), 0, EPOCHS * -(-len(pages) // BATCH)
    for _ in range(EPOCHS):
        for i in r.permutation(range(0, len(order), BATCH)):
            own = order[i:i + BATCH]
            batch = [[Block(b.text, tuple(x for x in b.path if r.random() > 0.05), b.links, b.depth) for b in pages[p]] for p in own]
            labels = np.concatenate([y[at[p]:at[p + 1]] for p in own])
            _, g = net.gradients(sequences(batch), np.arange(len(own)), labels)
            step += 1
            rate = 0.02 * min(1, step / 10) * (1 - 0.9 * step / steps)
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    _TRAINED[seed] = net
    return net


def main_texts(net: Labeller, pages: list[str | None], threshold: float = 0.0) -> list[str]:
    """Main text of each page: its main blocks, joined by a line break."""
    blocks = [blocks_of(p) for p in pages]
    s = sequences(blocks)
    main = net.scores(s) > threshold
    return ["\n".join(b.text for b, m in zip(own, main[a:z]) if m) for own, a, z in zip(blocks, s.first[:-1], s.first[1:])]


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page; one pass, no shuffle."""
    ship(df.sparkSession)
    net = trained()
    source = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField(url, source.schema["url"].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "html"):
                texts = main_texts(net, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
