"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: text between block-level tags, with its path of
open elements. Every block becomes a vector (its path's elements and class words,
hashed; its words, hashed; a few counts), and a bidirectional LSTM reads the
blocks of the whole page in order and labels each one main text or not. The main
blocks, in page order, are the page's text.

The network is trained here, in numpy, on pages put together from a grammar of
page layouts (`training_pages`): menus, headers, banners, notices, sidebars,
adverts, forms, reader comments and footers around articles, under usual and
less usual element and class names, with words drawn from a bounded sample of
real blocks (`sample` pages, the first by a hash of the page). No page's own
structure decides by rule.

Null or empty html gives the empty text. Scripts, styles, comments and other
elements without text are never blocks. Unclosed and stray tags are taken as
browsers mostly do: a block-level start tag ends an open paragraph, a stray end
tag is dropped. Rows with one page_id are extracted each by itself. A very long
page goes through the network in stretches of `LONG` blocks that hand their state
on. An empty table gives no rows. Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import first_rows, small

#: Fixed values of the HTML standard: elements that do not break a block, elements without an end, and elements whose content is not text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object head title textarea select option canvas audio video".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())

DIMS, WIDTH, EPOCHS, RATE, PAGES, SAMPLE = 160, 20, 12, 0.015, 640, 200
_COUNTS = 8
#: Blocks of a page that go through the network at once.
LONG = 4096


def blocks(page: str) -> list[tuple[str, tuple[str, ...]]]:
    """(text, path) of the page's leaf blocks, in order; the path has an entry for each open element, with its class words."""
    out: list[tuple[str, tuple[str, ...]]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    silent, at, end = 0, 0, len(page)

    def close() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, tuple(x[1] for x in stack if x[0] not in INLINE)))

    def leave(depth: int) -> None:
        nonlocal silent
        for name, _ in stack[depth:]:
            silent -= name in SILENT
        del stack[depth:]

    while m := _TAG.search(page, at):
        if not silent and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and not (name in INLINE and any(x[0] not in INLINE for x in stack[depth + 1 :])):
                if name not in INLINE:
                    close()
                leave(depth)
            continue
        if name == "br":
            if not silent:
                parts.append(" ")
            continue
        if name not in INLINE:
            close()
            while stack and stack[-1][0] in INLINE:  # an unclosed inline element does not reach past a block's start
                stack.pop()
            if stack and stack[-1][0] in _CLOSED_BY_BLOCK or name in ("li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                leave(len(stack) - 1)
        if name in VOID or m[3].endswith("/"):
            continue
        marks = " ".join(a or b or c for _, a, b, c in _ATTR.findall(m[3])).lower() if m[3] else ""
        stack.append((name, f"{name} {marks}".strip()))
        silent += name in SILENT
        if name in _RAW:  # what follows is not markup
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = stop.start() if stop else end
    if not silent and at < end:
        parts.append(page[at:])
    close()
    return out


_hashes: dict[str, int] = {}


def _place(word: str) -> int:
    """A place in the vector for a word, by FNV-1a over its characters."""
    if word not in _hashes:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = 2166136261
        for c in word.encode("utf-8", "replace"):
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        _hashes[word] = (h ^ h >> 15) % DIMS
    return _hashes[word]


_paths: dict[tuple[str, ...], np.ndarray] = {}
_split = re.compile(r"[^a-z0-9]+").split
_digit = re.compile(r"\d").search


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(DIMS, np.float32)
        for entry in path:
            name, _, marks = entry.partition(" ")
            if name in ("html", "body"):
                continue
            v[_place("<" + name)] = 1
            for w in _split(marks):
                if w and not w.isdigit():
                    v[_place("." + w)] = 1
        _paths[path] = v
    return _paths[path]


def vectors(page: list[tuple[str, tuple[str, ...]]], before: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, DIMS + DIMS + counts): path, words (the mean over all of the block's), counts; of a page's blocks from `before` on, of `total`."""
    n, total = len(page), len(page) if total is None else total
    out = np.zeros((n, 2 * DIMS + _COUNTS), np.float32)
    seen: dict[tuple[str, ...], int] = {}
    which = [seen.setdefault(path, len(seen)) for _, path in page]
    out[:, :DIMS] = np.stack([_path_vector(path) for path in seen])[which]
    heads = [text.lower().split(" ") for text, _ in page]
    each = [len(h) for h in heads]
    places = np.fromiter((_place(w) for h in heads for w in h), np.int64, sum(each))
    row = np.repeat(np.arange(n), each)
    np.add.at(out, (row, DIMS + places), np.repeat(1 / np.array(each, np.float32), each))
    count = np.array([text.count(" ") + 1 for text, _ in page])
    flags = [(text[-1] in ".!?:", "\u00a9" in text, _digit(text) is not None) for text, _ in page]
    out[:, 2 * DIMS] = np.minimum(count, 100) / 100
    out[:, 2 * DIMS + 1], out[:, 2 * DIMS + 2] = count < 4, count < 10
    out[:, 2 * DIMS + 3 : 2 * DIMS + 6] = flags
    out[0, 2 * DIMS + 6] = before == 0
    out[:, 2 * DIMS + 7] = np.arange(before, before + n) / total
    return out


class Labeller:
    """Bidirectional LSTM over block vectors, with a logistic output a block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        inner = 2 * DIMS + _COUNTS
        self.p = {"out": rng.normal(0, 0.2, 2 * WIDTH), "bias": np.zeros(1)}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.08, (inner, 4 * WIDTH))
            self.p["h" + side] = rng.normal(0, 0.15, (WIDTH, 4 * WIDTH))
            self.p["c" + side] = np.concatenate([np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh(0.5 * x)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states (batch, time, WIDTH) in one direction, what gradients need, and the last state; masked steps carry the state on."""
        n, steps, _ = x.shape
        a_all = x @ self.p["x" + side] + self.p["c" + side]
        h, c = state or (np.zeros((n, WIDTH), x.dtype), np.zeros((n, WIDTH), x.dtype))
        out, saved = np.zeros((n, steps, WIDTH), x.dtype), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = a_all[:, t] + h @ self.p["h" + side]
            i, f, o = (self._sigmoid(a[:, k * WIDTH : (k + 1) * WIDTH]) for k in range(3))
            g = np.tanh(a[:, 3 * WIDTH :])
            m = mask[:, t, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                saved.append((t, h, c, i, f, o, g, th))
            c, h = np.where(m, c2, c), np.where(m, o * th, h)
            out[:, t] = h
        return out, saved, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]
        return f @ self.p["out"][:WIDTH] + b @ self.p["out"][WIDTH:] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        sides = {s: self._pass(x, mask, s, True) for s in "fb"}
        z = sides["f"][0] @ self.p["out"][:WIDTH] + sides["b"][0] @ self.p["out"][WIDTH:] + self.p["bias"][0]
        total = mask.sum()
        loss = float((np.logaddexp(0, np.where(y, -z, z)) * mask).sum() / total)
        d = ((self._sigmoid(z) - y) * mask / total).astype(np.float32)
        g = {"out": np.concatenate([np.einsum("nt,ntw->w", d, sides[s][0]) for s in "fb"]), "bias": np.array([d.sum()])}
        for k, s in enumerate("fb"):
            w, wide = self.p["out"][k * WIDTH : (k + 1) * WIDTH], self.p["h" + s]
            g["h" + s] = np.zeros_like(wide)
            da_all = np.zeros((*x.shape[:2], 4 * WIDTH), np.float32)
            dh, dc = np.zeros((2, len(x), WIDTH), np.float32)
            for t, h0, c0, i, f, o, gg, th in reversed(sides[s][1]):
                m = mask[:, t, None]
                dh = dh + d[:, t, None] * w
                dcell = np.where(m, dc + dh * o * (1 - th * th), 0)
                da = np.concatenate([dcell * gg * i * (1 - i), dcell * c0 * f * (1 - f), np.where(m, dh * th, 0) * o * (1 - o), dcell * i * (1 - gg * gg)], axis=1)
                da_all[:, t] = da
                g["h" + s] += h0.T @ da
                dh, dc = np.where(m, 0, dh) + da @ wide.T, np.where(m, dcell * f, dc)
            g["x" + s] = x.reshape(-1, x.shape[2]).T @ da_all.reshape(-1, 4 * WIDTH)
            g["c" + s] = da_all.sum(axis=(0, 1))
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, batch: int = 32) -> Labeller:
        """Adam on mini-batches of pages (vectors, labels) of like length."""
        pages = sorted(pages, key=lambda p: len(p[1]))
        groups = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        rng, first, second, step = np.random.default_rng(5), {}, {}, 0
        steps = epochs * len(groups)
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask, y = _padded([p[0] for p in groups[k]], [p[1] for p in groups[k]])
                x[rng.random(len(x)) < 0.5, :, DIMS : 2 * DIMS] = 0  # words alone shall not decide
                x[rng.random(len(x)) < 0.25, :, 2 * DIMS : 2 * DIMS + 6] = 0  # nor marks and lengths
                _, g = self.gradients(x, mask, y)
                step += 1
                now = rate * (1.02 - step / steps)  # falls to almost nothing, so that the last steps settle
                for name, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * v
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * v * v
                    self.p[name] -= (now / (1 - 0.9**step)) * first[name] / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list[list[tuple[str, tuple[str, ...]]]]) -> list[np.ndarray]:
        """Which blocks are main text, for each page. Pages of like length go through the network together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for i, p in enumerate(pages):
            if len(p) > LONG:
                out[i] = self._label_long(p)
        order = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= LONG), key=lambda i: len(pages[i]))
        while order:
            most = max(1, 20_000 // max(1, len(pages[order[0]])))
            now, order = order[:most], order[most:]
            while len(now) > 1 and len(pages[now[-1]]) > 2 * len(pages[now[0]]) + 8:
                order.insert(0, now.pop())
            x, mask, _ = _padded([vectors(pages[i]) for i in now], None)
            z = self.logits(x, mask)
            for i, row in zip(now, z, strict=True):
                out[i] = row[: len(pages[i])] > 0
        return out


    def _label_long(self, page: list[tuple[str, tuple[str, ...]]]) -> np.ndarray:
        """One page of very many blocks, by stretches that hand their state on: only the hidden states of all blocks are held."""
        z = np.full(len(page), self.p["bias"][0])
        begins = list(range(0, len(page), LONG))
        for side, w in (("f", self.p["out"][:WIDTH]), ("b", self.p["out"][WIDTH:])):
            state = None
            for at in begins if side == "f" else reversed(begins):
                x = vectors(page[at : at + LONG], at, len(page))[None]
                h, _, state = self._pass(x, np.ones(x.shape[:2], bool), side, False, state)
                z[at : at + LONG] += h[0] @ w
        return z > 0


def _padded(xs: list[np.ndarray], ys: list[np.ndarray] | None):
    steps = max(len(x) for x in xs)
    x = np.zeros((len(xs), steps, xs[0].shape[1]), np.float32)
    mask, y = np.zeros((len(xs), steps), bool), np.zeros((len(xs), steps))
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)] = v, True
        if ys is not None:
            y[i, : len(v)] = ys[i]
    return x, mask, y


#: Element and class names by the part of a page that they are used for, for the layouts of training.
PARTS = {
    "menu": (["nav", "div", "ul"], ["", "menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "links", "topnav"]),
    "header": (["header", "div"], ["", "header", "site-header", "masthead", "banner", "logo", "topbar"]),
    "footer": (["footer", "div"], ["", "footer", "site-footer", "bottom", "copyright", "legal"]),
    "side": (["aside", "div", "section"], ["", "sidebar", "side", "related", "widget", "popular", "recommended", "share", "social"]),
    "notice": (["div", "section", "p"], ["notice", "cookie", "cookie-banner", "consent", "alert", "banner", "popup", "newsletter", "subscribe"]),
    "advert": (["div", "section", "aside"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"]),
    "form": (["form", "div"], ["", "form", "search", "login", "signup", "contact"]),
    "comment": (["section", "div", "ol"], ["comments", "comment-list", "comment", "discussion", "replies", "responses"]),
}
ARTICLE = (["article", "main", "div", "section"], ["", "article", "content", "post", "entry", "entry-content", "main", "story", "body-text"])


def training_pages(words: list[str], count: int = PAGES, seed: int = 23) -> list[tuple[list[tuple[str, tuple[str, ...]]], np.ndarray]]:
    """Pages from the layout grammar, as blocks with labels. The labels travel as marks inside the words and are taken out again."""
    rng = np.random.default_rng(seed)
    words = words or ["word"]
    pick = lambda xs: xs[rng.integers(len(xs))]

    def some(low: int, high: int) -> str:
        return " ".join(pick(words) for _ in range(rng.integers(low, high + 1)))

    def sentence(low: int, high: int, end: str = ".") -> str:
        return some(low, high).capitalize() + end

    def element(kind: tuple[list[str], list[str]], inner: str) -> str:
        name, mark = pick(kind[0]), pick(kind[1])
        if name in ("div", "section", "p", "ol", "ul", "form") and not mark:
            mark = pick([c for c in kind[1] if c])
        mark = f' {pick(["class", "class", "id"])}="{mark}"' if mark else ""
        return f"<{name}{mark}>{inner}</{name}>"

    def part(name: str) -> str:
        items = range(rng.integers(1, int(pick([7, 7, 14]))))
        if name == "menu":
            inner = "<ul>" + "".join(f'<li><a href="#">{some(1, 2)}</a></li>' for _ in items) + "</ul>" if rng.random() < 0.8 else " ".join(f"<a>{some(1, 2)}</a>" for _ in items)
        elif name == "footer":
            inner = pick(["&copy; ", "© ", ""]) + some(1, 3) + " &middot; " + sentence(2, 14) if rng.random() < 0.7 else "".join(f"<p>{some(1, 6)}</p>" for _ in items)
        elif name == "form":
            inner = f"<label>{some(1, 3)}</label><input type=text><button>{some(1, 2)}</button>"
        elif name == "comment":
            inner = "".join(f"<{t}><b>{some(1, 2)}</b> {sentence(2, 40)}</{t}>" for t in ("li", "div", "p") for _ in range(rng.integers(0, 3)))
        elif name == "side":
            inner = f"<h3>{some(1, 4)}</h3>" * int(rng.random() < 0.6) + "".join(f"<li>{some(2, 9)}</li>" if rng.random() < 0.5 else f"<p>{sentence(3, 20)}</p>" for _ in items)
        else:
            inner = f"<p>{sentence(1, 25)}</p>" if rng.random() < 0.4 else sentence(1, 25)
        return element(PARTS[name], inner)

    def odd() -> str:
        """Lines that articles hold as footers do: licences, notes, numbers, lists, shouting."""
        n = int(rng.integers(1, 10_000))
        return pick([
            f"Licensed under {some(1, 4)} {n % 9}.0.", f"This work is licensed under {some(2, 6)}, version {n % 4}.", f"{some(1, 2).upper()},!!", " | ".join(some(1, 1) for _ in range(n % 9 + 2)),
            f"{n % 256}.{n % 99}.{n % 77}.{n % 200} {sentence(2, 8)}", f"{some(1, 3)} = \"{n}{n}\" {some(1, 8)}", some(1, 1), f"{n}", f"{some(1, 2)}: {n}", sentence(2, 4), f"{some(1, 1)}@{some(1, 1)}.org", " ".join([some(1, 1)] * (n % 20 + 2)),
        ])

    out = []
    for _ in range(count):
        body = []
        if rng.random() < 0.9:
            body.append(f"<h1>\u0001{some(1, 12)}</h1>")
        for _ in range(rng.integers(0, 14)):
            kind, text = rng.random(), sentence(1, int(pick([3, 12, 60, 200])), pick([".", "", "!", "!!"]))
            if kind < 0.08:
                body.append(f"<p>\u0001{odd()}</p>")
            elif kind < 0.14:
                body += [f"<p>\u0001{sentence(1, 5)}</p>"] * int(rng.integers(2, 12))
            elif kind < 0.7:
                body.append(f"<p>\u0001{text}" + "</p>" * int(rng.random() < 0.9))
            elif kind < 0.78:
                body.append(f"<h{rng.integers(2, 5)}>\u0001{some(1, 6)}</h2>".replace("</h2>", ""))
                body.append(f"<p>\u0001{text}</p>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>\u0001{some(1, 20)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>\u0001{text}</blockquote>")
            elif kind < 0.94:
                body.append(f"<table><tr><td>\u0001{some(1, 4)}</td><td>\u0001{some(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                body.append(f"<p><b>\u0001{text}<br><p>\u0001{sentence(2, 40)}</p>")
            else:
                body.append(part(pick(["advert", "side", "form", "notice"])))
        before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "side") if rng.random() < 0.45]
        after = [part(k) for k in ("side", "comment", "advert", "form", "menu", "notice") if rng.random() < 0.4] + [part("footer")] * int(rng.random() < 0.85)
        rng.shuffle(before)
        if not any("\u0001" in b for b in body):
            body.append(f"<p>\u0001{sentence(3, 60)}</p>")
        style = rng.random()
        if style < 0.14:  # no element of its own, or nothing else on the page
            main = "".join(body) if rng.random() < 0.6 else f"<p>\u0001{sentence(3, 60)}</p>"
        elif style < 0.22:  # a table of columns, or old centring
            main = pick(["<table><tr><td>{}</td></tr></table>", "<table><tbody><tr><td><div>{}</div></td></tr></tbody></table>", "<center>{}</center>", "<div>{}</div>"]).format("".join(body))
            if rng.random() < 0.5 and main.startswith("<table><tr>"):
                main = main.replace("<td>", "<td>" + part(pick(["menu", "side"])) + "</td><td>", 1)
        else:
            main = element(ARTICLE, "".join(body))
        if rng.random() < (0.5 if style < 0.14 else 0.06):
            before, after = [], []
        if rng.random() < 0.3:
            main = f'<div class="{pick(["wrap", "container", "page", "row"])}">{main}</div>'
        found = blocks("<html><body>" + "".join(before) + main + "".join(after) + "</body></html>")
        out.append(([(t.replace("\u0001", "") or "x", p) for t, p in found], np.array(["\u0001" in t for t, _ in found], float)))
    return [p for p in out if p[0]]


def train(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller; up to `sample` pages give 40 words each for the training layouts, from places spread over the whole page."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [[w for t, _ in blocks(page) for w in t.split(" ")] for page in b.column("html").to_pylist()]
            found = [w for e in each for w in e[:: max(1, -(-len(e) // 40))]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    some = first_rows(pages.where("html is not null").select("html", F.xxhash64("html").alias("h")), "h", sample).dropDuplicates(["h"])
    vocabulary = sorted(r.word for r in some.select("html").mapInArrow(words, "word string").collect())
    return Labeller().fit([(vectors(p), y) for p, y in training_pages([w for w in vocabulary if not set(w) & set("<>&\u0001")])])


def extracted(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row of pages(page_id, url, html)."""
    labeller = labeller or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 512):
            found = [blocks(p or "") for p in b.column("html").to_pylist()]
            main = labeller.label(found)
            texts = [" ".join(t for (t, _), keep in zip(page, m, strict=True) if keep) for page, m in zip(found, main, strict=True)]
            numbers = [[len(t) for t in texts], [len(p) for p in found], [int(m.sum()) for m in main]]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
