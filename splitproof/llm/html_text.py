"""Main-text extraction from HTML by a recurrent block labeller.

A page is cut into its leaf blocks in page order. Each block gives a vector: its tag path (tags, class and id words
of its ancestors), its words, both hashed, and a few counts. A bidirectional LSTM in numpy reads the whole
sequence, so that every block is labelled in the light of the whole document; the blocks labelled as main text
are joined. The labeller is trained here, on the driver, on pages that a seeded generator writes in many layouts
with menus, headers, footers, sidebars, notices, adverts, forms and comments; no label comes from the input.

Defined cases: a null or empty html, or a page without main text, gives the empty text. Unclosed and crossed tags
are repaired as they are met; an unclosed script, style or comment lasts to the end of the page. What noscript,
template, svg, iframe and object hold is left out; without an end tag their start tag is passed over. A ``<`` that no
``>`` follows is text, as is all after it. Once an attribute's quote is never closed, later tags end at their first ``>``.
Repeated rows are each extracted; further columns are ignored. Nothing is capped: long pages are read whole, in time
and memory in proportion to their length however deep or broken they are.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")  # quoted values may hold >
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"\w+")
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object"}
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul video audio canvas input".split()
)
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH_SLOTS, WORD_SLOTS, COUNTS = 2048, 512, 8
MEMO = 100_000


def _slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % slots


class Node:
    """An open element: its parent, and the slots of what its tag and names add to the path, so that a path of any depth is
    shared by all blocks below it."""

    __slots__ = ("parent", "tag", "names", "depth", "new", "vector")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...], new: tuple[int, ...]):
        self.parent, self.tag, self.names, self.new = parent, tag, names, new
        self.depth = parent.depth + 1 if parent else 1
        self.vector = None


@dataclass
class Block:
    node: Node | None  # the innermost element
    text: str
    link: int  # characters inside links


def _names(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role."""
    if not attributes or not ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes):
        return ()
    names = (p.lower() for m in NAMES.finditer(attributes) for p in PIECE.findall(m[1] or m[2] or m[3] or ""))
    return tuple(dict.fromkeys(names))


class _Open:
    """The open elements, with what makes each step take constant time: where each tag is open, where blocks are, and how
    often each slot is on the path."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.slots: dict[int, int] = {}
        self.counted: list[list[int]] = []

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        mine = list(dict.fromkeys([_slot(f"t:{tag}", PATH_SLOTS), *(_slot(f"c:{n}", PATH_SLOTS) for n in names)]))
        new = tuple(x for x in mine if not self.slots.get(x))
        for x in mine:
            self.slots[x] = self.slots.get(x, 0) + 1
        place = len(self.nodes)
        self.nodes.append(Node(self.nodes[-1] if place else None, tag, names, new))
        self.counted.append(mine)
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)

    def pop(self) -> None:
        tag = self.nodes.pop().tag
        for x in self.counted.pop():
            self.slots[x] -= 1
        self.at[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """Close the innermost element of the tag and what is open in it; an inline element doesn't close a block."""
        places = self.at.get(tag)
        if not places or (tag not in BLOCK and self.blocks and self.blocks[-1] > places[-1]):
            return
        for _ in range(len(self.nodes) - places[-1]):
            self.pop()


def blocks_of(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in order."""
    if not page:
        return []
    out: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    link = in_link = 0
    at: Node | None = None

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(at, text, min(link, len(text))))
            parts.clear()
        link = 0

    pos, end = 0, len(page)
    greater = page.find(">")  # the first from pos on, or -1
    quoted = True  # attribute values are read as quoted
    never_closed: set[str] = set()  # of RAW: no end tag from here on
    while pos < end:
        if greater >= 0 and greater < pos:
            greater = page.find(">", pos)
        m = None
        if page[pos] == "<":
            if page.startswith("<!--", pos):
                close = page.find("-->", pos + 4)
                pos = end if close < 0 else close + 3
                continue
            if greater < 0:
                text, pos = page[pos:], end
            elif page.startswith(("<!", "<?"), pos):
                pos = greater + 1
                continue
            else:
                m = TAG.match(page, pos) if quoted else PLAIN_TAG.match(page, pos)
                if m is None and quoted and (m := PLAIN_TAG.match(page, pos)):
                    quoted = False
                if m is None:
                    text, pos = "<", pos + 1
                else:
                    pos = m.end()
        else:
            less = page.find("<", pos)
            less = end if less < 0 else less
            text, pos = page[pos:less], less
        if m is None:
            if not parts:
                if text.isspace():
                    continue
                at = stack.nodes[-1] if stack.nodes else None
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if in_link:
                link += len(text.strip())
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        is_block = tag in BLOCK
        if closing:
            if is_block:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            stack.close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in never_closed:
                close = RAW_END[tag].search(page, pos) if page.find(">", pos) >= 0 else None
                if close:
                    pos = close.end()
                elif tag in ("script", "style"):
                    pos = end
                else:
                    never_closed.add(tag)
            if tag in ("noscript", "iframe", "object"):
                flush()
            continue
        if is_block:
            flush()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        shut = CLOSES.get(tag)
        if shut is None and is_block:
            shut = {"p"} if tag not in ("label", "button", "select", "option", "textarea") else None
        while shut and stack.nodes and stack.nodes[-1].tag in shut:
            stack.pop()
        names = _names(attributes)
        if is_block or names:
            stack.push(tag, names)
    flush()
    return out


def _path_slots(node: Node | None) -> list[int]:
    """The slots of a block's path: of all tags and names on it, and of the innermost tag."""
    if node is None:
        return []
    out = [_slot(f"l:{node.tag}", PATH_SLOTS)]
    at: Node | None = node
    while at:
        out += at.new
        at = at.parent
    return out


@dataclass
class Labeller:
    """Input layer, two LSTMs and an output layer."""

    weights: dict[str, np.ndarray]
    added: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "added": {}, "words": {}}

    def _added(self, slots: tuple[int, ...]) -> np.ndarray:
        known = self.added.get(slots)
        if known is None:
            if len(self.added) >= 20_000:
                self.added.clear()
            known = self.added[slots] = self.weights["path"][list(slots)].sum(0)
        return known

    def _vector(self, node: Node) -> np.ndarray:
        """The sum of the path's slots. Each node's is its parent's and what it adds, shared where that is nothing."""
        todo: list[Node] = []
        at: Node | None = node
        while at is not None and at.vector is None:
            todo.append(at)
            at = at.parent
        vector = at.vector if at else np.zeros(self.weights["path"].shape[1])
        for n in reversed(todo):
            if n.new:
                vector = vector + self._added(n.new)
            n.vector = vector
        return vector

    def word_slots(self, text: str) -> np.ndarray:
        memo, out = self.words, []
        for w in WORD.findall(text.lower()):
            s = memo.get(w)
            if s is None:
                if len(memo) >= MEMO:
                    memo.clear()
                s = memo[w] = _slot(w, WORD_SLOTS)
            out.append(s)
        return np.array(out, np.int64)

    def embed(self, blocks: list[Block]) -> np.ndarray:
        """Input vectors of a page's blocks."""
        w = self.weights
        x = np.empty((len(blocks), w["path"].shape[1]))
        for i, b in enumerate(blocks):
            x[i] = 0 if b.node is None else self._vector(b.node) + self._added((_slot(f"l:{b.node.tag}", PATH_SLOTS),))
        words, counts = self.word_features(blocks)
        for i, s in enumerate(words):
            if len(s):
                x[i] += np.bincount(s, minlength=WORD_SLOTS) @ w["word"] / len(s)
        return x + counts @ w["count"] + w["bias"]

    def word_features(self, blocks: list[Block]) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashed words of each block, and its counts."""
        n = len(blocks)
        counts = np.zeros((n, COUNTS))
        words = [self.word_slots(b.text) for b in blocks]
        for i, (b, s) in enumerate(zip(blocks, words, strict=True)):
            counts[i] = count_features(b, len(s), i, n)
        return words, counts

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each page's blocks, the probability to be main text; pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        begin = 0
        while begin < len(order):
            longest = len(pages[order[min(begin + 63, len(order) - 1)]])
            take = order[begin : begin + max(1, min(64, 200_000 // max(1, longest)))]
            begin += len(take)
            width = max(len(pages[i]) for i in take)
            x = np.zeros((len(take), width, self.weights["path"].shape[1]))
            mask = np.zeros((len(take), width))
            for r, i in enumerate(take):
                x[r, : len(pages[i])] = self.embed(pages[i])
                mask[r, : len(pages[i])] = 1
            p, _ = run_network(self.weights, x, mask)
            for r, i in enumerate(take):
                out[i] = p[r, : len(pages[i])]
        return out


def count_features(b: Block, words: int, i: int, n: int) -> tuple[float, ...]:
    size = max(1, len(b.text))
    marks = sum(map(b.text.count, ".,;!?"))
    return (
        np.log1p(words) / 4,
        b.link / size,
        min(1.0, 20 * marks / size),
        float(b.text[-1] in ".!?…\"'”»"),
        i / n,
        (n - 1 - i) / n,
        float(words <= 4),
        (b.node.depth if b.node else 0) / 10,
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states (B, T, H) of an LSTM and, with ``keep``, what its gradient needs; padding carries the state on."""
    n, steps, _ = x.shape
    size = wh.shape[0]
    h, c = np.zeros((n, size)), np.zeros((n, size))
    states, kept = np.zeros((n, steps, size)), []
    for t in range(steps):
        if t % 1024 == 0:
            drive = x[:, t : t + 1024] @ wx + b
        z = drive[:, t % 1024] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
        m = mask[:, t : t + 1]
        fresh = f * c + i * g
        tanh = np.tanh(fresh)
        if keep:
            kept.append((h, c, i, f, o, g, tanh, m))
        c = m * fresh + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        states[:, t] = h
    return states, kept


def _lstm_gradient(d_states: np.ndarray, kept: list, x: np.ndarray, wx: np.ndarray, wh: np.ndarray):
    n, steps, size = d_states.shape
    dz_all = np.zeros((n, steps, 4 * size))
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((n, size)), np.zeros((n, size))
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, tanh, m = kept[t]
        dh = dh + d_states[:, t]
        do = m * dh * tanh
        df_c = m * (dc + dh * o * (1 - tanh * tanh))
        dz = np.concatenate([df_c * g * i * (1 - i), df_c * c0 * f * (1 - f), do * o * (1 - o), df_c * i * (1 - g * g)], 1)
        dz_all[:, t] = dz
        dwh += h0.T @ dz
        dh = dz @ wh.T + (1 - m) * dh
        dc = df_c * f + (1 - m) * dc
    flat = dz_all.reshape(-1, 4 * size)
    return dz_all @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def run_network(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    y = np.tanh(x)
    forward, kept_f = _lstm(y, mask, w["f_x"], w["f_h"], w["f_b"], keep)
    backward, kept_b = _lstm(y[:, ::-1], mask[:, ::-1], w["b_x"], w["b_h"], w["b_b"], keep)
    both = np.concatenate([y, forward, backward[:, ::-1]], 2)
    return _sigmoid(both @ w["out"] + w["out_b"]), (y, both, kept_f, kept_b)


# ---- training pages -----------------------------------------------------------------------------------------

SYLLABLES = ("a", "be", "cin", "do", "er", "fo", "gal", "hi", "in", "ka", "lo", "mi", "né", "or", "pü", "qui", "re", "st", "tion", "ßa", "un", "ve", "wh", "xe", "za", "th", "on")
MARK = "\ue000"  # begins each block of main text in a training page
MENU = "Home About Contact Login Search News Products Services Archive Help Shop Account Sitemap Careers Blog Sports Weather Start Kontakt Accueil Inicio".split()
SAID = {
    "ad": "Advertisement Sponsored Buy now Sale offer deal discount promo Anzeige publicité anuncio",
    "notice": "This site uses cookies accept consent privacy policy settings subscribe newsletter close",
    "comment": "says replied reply comment comments ago posted report like share Antworten répondre responder",
    "footer": "© Copyright rights reserved terms privacy imprint Impressum contact all",
    "side": "Related popular recent posts most read trending tags categories archive more",
    "form": "Name Email Message Send Submit Search Password Subscribe Sign up Your",
}
MAIN = [
    "article", "article", "article", "article class='post'", "article class='hentry story'", "main", "main id='main'", "main|article", "div class='content'",
    "div id='content'", "div class='post-content'", "div class='entry-content'", "div class='article-body'", "div class='story'", "div class='post'",
    "section class='article'", "div class='main-content'", "div role='main'", "div id='main'|div class='text'", "main|div class='body'", "div class='page'|article",
    "section class='content'|article", "div class='wrapper'|main|article", "table|tr|td class='content'",
]
OFF = {
    "ad": ["div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div id='banner-ad'", "section class='sponsored'", "div class='promo'", "aside class='ad'", "div class='ad-slot'", "ins class='adsbygoogle'|p"],
    "notice": ["div class='cookie-notice'", "div class='notice'", "div id='cookie-banner'", "div class='alert'", "div class='gdpr consent'", "div class='popup'", "div class='modal'", "div role='alert'", "section class='notice'", "div class='banner'", "dialog", "aside class='notice'"],
    "comment": ["section class='comments'", "div id='comments'", "div class='comments'", "ol class='comment-list'|li", "div class='comment'", "div class='reader-comments'|div class='comment'", "section id='comments'|article class='comment'", "ul class='commentlist'|li class='comment'", "div class='discussion'|div class='reply'", "aside class='comments'", "div class='responses'|p"],
    "footer": ["footer", "footer class='site-footer'", "div class='footer'", "div id='footer'", "div class='bottom copyright'", "footer|div class='copyright'"],
    "side": ["aside", "aside class='sidebar'", "div class='sidebar'", "div id='sidebar'", "div class='related'", "div class='widget'", "aside|section class='widget'", "div class='right-column side'", "div class='recommended'", "section class='related-posts'"],
    "form": ["form", "form class='search'", "div class='newsletter'|form", "form id='contact'", "section class='signup'|form"],
    "header": ["header", "div class='header'", "div id='header'", "header class='site-header'", "div class='masthead'", "header|div class='top'", "div class='topbar'"],
    "menu": ["nav", "nav class='menu'", "div class='nav'", "div id='menu'", "div class='navbar'", "ul class='menu'", "header|nav", "nav class='breadcrumbs'", "div class='breadcrumb'", "div class='share social'", "div class='pagination'", "div class='tags'"],
}


class PageWriter:
    """Writes random pages whose main blocks begin with MARK."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, options):
        return options[int(self.rng.random() * len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(self.rng.randrange(1, 5)))

    def prose(self, low: int = 4, high: int = 60, said: str | None = None) -> str:
        n = self.rng.randrange(low, high + 1)
        words = [self.word() for _ in range(n)]
        if said and self.chance(0.6):
            for _ in range(self.rng.randrange(1, 4)):
                words[self.rng.randrange(n)] = self.pick(SAID[said].split())
        elif not said and self.chance(0.25):
            words[self.rng.randrange(n)] = self.pick(SAID[self.pick(list(SAID))].split() + MENU)
        text = ""
        for i, w in enumerate(words):
            mark = self.pick((".", ".", ",", "!")) if self.chance(0.12) else ""
            text += (w.capitalize() if i == 0 or text.endswith(". ") else w) + mark + " "
        return text.strip() + ("." if self.chance(0.8) else "") + self.pick(("", "", "", " &amp; ", "&nbsp;", ""))

    def inside(self, path: str, content: str) -> str:
        tags = path.split("|")
        opened = "".join(f"<{t}>" for t in tags)
        return opened + content + "".join(f"</{t.split()[0]}>" for t in reversed(tags))

    def links(self, n: int, tag: str | None = None) -> str:
        one = lambda: f"<a href='/x'>{self.pick(MENU) if self.chance(0.5) else ' '.join(self.word() for _ in range(self.rng.randrange(1, 4)))}</a>"
        if tag is None:
            tag = self.pick(("li", "li", "li", "span", "div", ""))
        body = "".join(f"<{tag}>{one()}</{tag}>" if tag else one() + " " for _ in range(n))
        return f"<ul>{body}</ul>" if tag == "li" else body

    def off(self, kind: str) -> str:
        path = self.pick(OFF[kind])
        if kind == "menu":
            return self.inside(path, self.links(self.rng.randrange(2, 9)))
        if kind == "header":
            body = self.pick((f"<h1>{self.prose(1, 4)}</h1>", f"<a href='/'>{self.prose(1, 3)}</a>", f"<p>{self.prose(2, 12)}</p>", f"<h2>{self.prose(1, 5)}</h2><p>{self.prose(3, 9)}</p>"))
            return self.inside(path, body + (self.links(4) if self.chance(0.4) else ""))
        if kind == "form":
            body = "".join(f"<label>{self.prose(1, 3, 'form')}</label><input name='q'>" for _ in range(self.rng.randrange(1, 4)))
            body += f"<p>{self.prose(3, 20, 'form')}</p>" if self.chance(0.5) else ""
            body += "<select><option>One<option>Two</select>" if self.chance(0.3) else ""
            return self.inside(path, body + f"<textarea>{self.prose(1, 4)}</textarea><button>{self.prose(1, 2, 'form')}</button>")
        if kind == "side":
            body = f"<h3>{self.prose(1, 4, 'side')}</h3>" if self.chance(0.6) else ""
            body += self.pick((self.links(5), f"<p>{self.prose(5, 50, 'side')}</p>", f"<p>{self.prose(5, 60)}</p><p>{self.prose(5, 40)}</p>", self.prose(4, 40)))
            return self.inside(path, body)
        if kind == "comment":
            body = f"<h3>{self.prose(1, 3, 'comment')}</h3>" if self.chance(0.5) else ""
            for _ in range(self.rng.randrange(1, 6)):
                who = f"<div class='author'>{self.word()} {self.pick(SAID['comment'].split())}</div>" if self.chance(0.6) else ""
                body += who + self.pick((f"<p>{self.prose(4, 50, 'comment')}</p>", f"<div>{self.prose(4, 50)}</div>", f"<p>{self.prose(4, 40)}</p>"))
            return self.inside(path, body)
        if kind == "footer":
            body = self.pick((self.prose(3, 25, "footer"), f"<p>&copy; {self.prose(3, 30, 'footer')}</p>", f"&copy; {self.word()}.com &middot; {self.prose(3, 40)}", self.links(4) + f"<p>{self.prose(3, 12, 'footer')}</p>"))
            return self.inside(path, body)
        body = self.pick((self.prose(3, 40, kind), f"<p>{self.prose(3, 40, kind)}</p>", f"<p>{self.prose(3, 40)}</p>", self.prose(3, 40), f"<p>{self.prose(3, 20, kind)}</p><a href='/y'>{self.prose(1, 3, kind)}</a>"))
        return self.inside(path, body)

    def main_block(self) -> str:
        m, r = MARK, self.rng.random()
        text = self.prose(1, 120) if self.chance(0.8) else self.prose(1, 8)
        if self.chance(0.25):
            text = f"<b>{self.prose(1, 5)}</b> " + text if self.chance(0.7) else text + f" <a href='/z'>{self.prose(1, 4)}</a> {self.prose(1, 6)}"
        if r < 0.66:
            return f"<p>{m}{text}</p>" if self.chance(0.85) else f"<p>{m}{text}"
        if r < 0.72:
            return f"<h{self.pick('234')}>{m}{self.prose(1, 8)}</h2>".replace("</h2>", "") + "<p>" + m + text + "</p>"
        if r < 0.79:
            return "<ul>" + "".join(f"<li>{m}{self.prose(1, 20)}</li>" for _ in range(self.rng.randrange(2, 6))) + "</ul>"
        if r < 0.84:
            return f"<blockquote>{m}{text}</blockquote>" if self.chance(0.5) else f"<blockquote><p>{m}{text}</p></blockquote>"
        if r < 0.88:
            return f"<div>{m}{text}</div>"
        if r < 0.92:
            return "<table><tr>" + "".join(f"<td>{m}{self.prose(1, 6)}</td>" for _ in range(3)) + "</tr></table>"
        if r < 0.95:
            return f"<figure><img src='i.png'><figcaption>{m}{self.prose(2, 12)}</figcaption></figure>"
        return f"<p>{m}<b>{text}<br>{m}{self.prose(2, 30)}</p>"

    def page(self) -> str:
        head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.prose(1, 12)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        before = [self.off(k) for k in ("header", "menu", "ad", "notice", "form", "side") if self.chance(0.45)]
        after = [self.off(k) for k in ("comment", "side", "ad", "form", "menu", "notice") if self.chance(0.3)]
        if self.chance(0.8):
            after.append(self.off("footer"))
        self.rng.shuffle(before)
        body = ""
        if not self.chance(0.03):
            if self.chance(0.75):
                title = f"<h1>{MARK}{self.prose(1, 14)}</h1>"
                body += f"<header>{title}</header>" if self.chance(0.1) else title
            for _ in range(self.rng.randrange(1, 14)):
                body += self.main_block()
                if self.chance(0.05):
                    body += self.off(self.pick(("ad", "side", "form", "menu", "notice")))
            if self.chance(0.15):
                body += self.off(self.pick(("comment", "menu", "side")))
            body = self.inside(self.pick(MAIN), body)
        shell = self.pick(("", "", "", "div class='container'", "div id='page'", "div", "div class='site'|div class='row'"))
        whole = "".join(before) + body + "".join(after)
        return head + (self.inside(shell, whole) if shell else whole) + ("</body></html>" if self.chance(0.9) else "")


def training_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    writer, out = PageWriter(seed), []
    while len(out) < n:
        blocks = blocks_of(writer.page())
        if not blocks:
            continue
        y = np.array([MARK in b.text for b in blocks], float)
        for b in blocks:
            b.text = " ".join(b.text.replace(MARK, "").split()) or "-"
        out.append((blocks, y))
    return out


class _Slots:
    """Slots of many blocks with weights: sums of a table's rows by block, and the gradient of the table."""

    def __init__(self, slots: list[np.ndarray], mean: bool):
        n = np.array([len(s) for s in slots])
        self.blocks = len(slots)
        self.slot = np.concatenate(slots).astype(np.int64)
        self.block = np.repeat(np.arange(len(n)), n)
        self.share = 1 / np.maximum(n, 1)[self.block] if mean else np.ones(len(self.block))
        self.order = np.argsort(self.slot, kind="stable")

    @staticmethod
    def _sums(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows with each key; keys ascend."""
        out = np.zeros((size, values.shape[1]))
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            out[keys[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def rows(self, table: np.ndarray) -> np.ndarray:
        return self._sums(table[self.slot] * self.share[:, None], self.block, self.blocks)

    def gradient(self, d: np.ndarray, size: int) -> np.ndarray:
        at = self.order
        return self._sums(d[self.block[at]] * self.share[at, None], self.slot[at], size)


class _Batch:
    """Pages of like length: slots of all their blocks, counts, labels, and where each block is in the padded sequences."""

    def __init__(self, pages: list[tuple]):
        steps = max(len(p[3]) for p in pages)
        self.paths = _Slots([np.array(s, np.int64) for p in pages for s in p[0]], False)
        self.words = _Slots([s for p in pages for s in p[1]], True)
        self.counts = np.concatenate([p[2] for p in pages])
        self.place = np.concatenate([np.arange(len(p[3])) + r * steps for r, p in enumerate(pages)])
        self.mask, self.y = np.zeros((len(pages), steps)), np.zeros((len(pages), steps))
        self.mask.ravel()[self.place] = 1
        self.y.ravel()[self.place] = np.concatenate([p[3] for p in pages])


_TRAINED: dict[tuple, Labeller] = {}


def train(pages: int = 900, epochs: int = 9, width: int = 24, hidden: int = 16, seed: int = 4) -> Labeller:
    """Train on generated pages with Adam; the same parameters give the same labeller. Kept for the session."""
    key = (pages, epochs, width, hidden, seed)
    if key in _TRAINED:
        return _TRAINED[key]
    rng = np.random.default_rng(seed)
    w = {
        "path": rng.normal(0, 0.1, (PATH_SLOTS, width)),
        "word": rng.normal(0, 0.1, (WORD_SLOTS, width)),
        "count": rng.normal(0, 0.3, (COUNTS, width)),
        "bias": np.zeros(width),
        "out": rng.normal(0, 0.2, width + 2 * hidden),
        "out_b": np.zeros(1),
    }
    for d in "fb":
        w[f"{d}_x"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
        w[f"{d}_h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"{d}_b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    model = Labeller(w)
    data = []
    for blocks, y in training_pages(pages, seed):
        words, counts = model.word_features(blocks)
        data.append(([_path_slots(b.node) for b in blocks], words, counts, y))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step, batch = 0, 24
    by_length = sorted(range(len(data)), key=lambda i: len(data[i][3]))
    batches = [_Batch([data[j] for j in by_length[i : i + batch]]) for i in range(0, len(data), batch)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            part = batches[k]
            counts, place, mask, y = part.counts, part.place, part.mask, part.y
            flat = part.paths.rows(w["path"]) + part.words.rows(w["word"]) + counts @ w["count"] + w["bias"]
            x = np.zeros((*mask.shape, width))
            x.reshape(-1, width)[place] = flat
            p, (inner, both, kept_f, kept_b) = run_network(w, x, mask, True)
            d_out = (p - y) * mask / mask.sum()
            g = {"out": np.tensordot(d_out, both, ([0, 1], [0, 1])), "out_b": np.array([d_out.sum()])}
            d_both = d_out[:, :, None] * w["out"]
            d_in = d_both[:, :, :width].copy()
            for d, kept, lo, flip in (("f", kept_f, width, False), ("b", kept_b, width + hidden, True)):
                d_states, seen = d_both[:, :, lo : lo + hidden], inner
                if flip:
                    d_states, seen = d_states[:, ::-1], inner[:, ::-1]
                dx, g[f"{d}_x"], g[f"{d}_h"], g[f"{d}_b"] = _lstm_gradient(d_states, kept, seen, w[f"{d}_x"], w[f"{d}_h"])
                d_in += dx[:, ::-1] if flip else dx
            d_flat = (d_in * (1 - inner * inner)).reshape(-1, width)[place]
            g["count"], g["bias"] = counts.T @ d_flat, d_flat.sum(0)
            g["path"], g["word"] = part.paths.gradient(d_flat, PATH_SLOTS), part.words.gradient(d_flat, WORD_SLOTS)
            step += 1
            rate = 0.01 * (0.5 ** max(0, epoch - 4))
            for name, grad in g.items():
                grad = np.clip(grad, -1, 1) + (1e-5 * w[name] if name in ("path", "word") else 0)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad * grad
                w[name] = w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    model = Labeller(w)
    _TRAINED[key] = model
    return model


def main_text(model: Labeller, pages: list[str | None]) -> list[str]:
    parsed = [blocks_of(p) for p in pages]
    return [
        " ".join(b.text for b, q in zip(blocks, p, strict=True) if q >= 0.5)
        for blocks, p in zip(parsed, model.probabilities(parsed), strict=True)
    ]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id") -> DataFrame:
    """id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            for begin in range(0, len(pdf), 512):
                part = pdf.iloc[begin : begin + 512]
                texts = main_text(shared.value, list(part["html"]))
                yield pd.DataFrame(
                    {"id": part["id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}
                )

    rows = pages.select(F.col(id_col).cast("string").alias("id"), "url", "html")  # as text: pandas has no whole numbers with nulls
    out = rows.mapInPandas(releasing(run), "id string, url string, text string, n_chars long")
    return out.select(F.col("id").cast("long").alias(id_col), "url", "text", "n_chars")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), train())
