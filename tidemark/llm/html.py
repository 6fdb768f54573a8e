"""Main text of web pages by a recurrent block labeller.

A page is read once into leaf blocks: runs of text between block-level tags or line
breaks, with the path of open elements.  A block's vector is the sum of vectors for its
path's tags, classes and ids (hashed), the mean of vectors for its words (hashed), and
how long and how linked it is.  A bidirectional LSTM in numpy reads the blocks of the
whole page in order and labels each as part of the article or not.

The labeller is trained on the driver, from a seed, on pages that ``training_page`` lays
out: articles in many kinds of containers among menus, headers, footers, sidebars,
notices, adverts, forms, related links and reader comments, in invented words of several
languages.  That cost is fixed; labelling is row-local and needs no shuffle.

Defined results: null or empty html, and a page without any article block, give the empty
text; unclosed or stray tags, comments and quotes end with the page; repeated rows are
read each on its own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(script|style|title|template|noscript|textarea|select|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*)>"""
    r"""|<[/!?a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[0-9]+")

#: Elements that do not break a block, and those without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens ends these if they are open inside the same parent.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

PATHS, WORDS = 1024, 1024
PATH_DIM, WORD_DIM, SCALARS, HIDDEN = 16, 8, 4, 16
PAGES, EPOCHS = 700, 7


def blocks(page: str | None) -> list[tuple[tuple, str, float]]:
    """(path, text, share of characters in links) of every leaf block, in page order."""
    page = page or ""
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = at = 0
    links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(stack), text, min(1.0, linked / len(text))))
            parts, linked = [], 0

    for m in TAG.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw.strip())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m[2] else 1
            continue
        flush()
        if name in VOID:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        links = 0
        if name in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        ended = ENDS.get(name)
        while ended and stack and stack[-1][0] in ended:
            stack.pop()
        attributes = m[4]
        if "=" in attributes:
            attributes = " ".join(a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes))
        else:
            attributes = ""
        stack.append((name, attributes))
    if at < len(page):
        parts.append(unescape(page[at:]))
    flush()
    return out


def path_features(path: tuple) -> list[int]:
    """Hash buckets of the path's tags and of the words in its classes and ids; the last three tags also by depth."""
    names = set()
    for tag, attributes in path:
        names.add("t:" + tag)
        for p in PIECE.findall(attributes):
            names.add("c:" + p.lower())
    for depth, (tag, _) in enumerate(reversed(path[-3:])):
        names.add(f"d{depth}:{tag}")
    return sorted({zlib.crc32(n.encode()) % PATHS for n in names} or {0})


class Vectors:
    """Caches of hashed features for one worker."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def page(self, found: list[tuple[tuple, str, float]]) -> tuple[list[np.ndarray], list[list[int]], np.ndarray]:
        paths, words, scalars = [], [], np.zeros((len(found), SCALARS), "f4")
        if len(self.words) > 300_000:
            self.words.clear()
        if len(self.paths) > 50_000:
            self.paths.clear()
        get = self.words.get
        for k, (path, text, linked) in enumerate(found):
            ids = self.paths.get(path)
            if ids is None:
                ids = self.paths[path] = np.array(path_features(path), np.int64)
            paths.append(ids)
            own = []
            for w in text.split(" "):
                h = get(w)
                if h is None:
                    h = self.words[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
                own.append(h)
            words.append(own)
            scalars[k] = (np.log1p(len(own)) / 4, linked, text[-1] in ".!?:;", (k + 1) / len(found))
        return paths, words, scalars


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    NAMES = ("path", "word", "wx_f", "wh_f", "b_f", "wx_b", "wh_b", "b_b", "out", "out_b")

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + SCALARS
        self.path = r.normal(0, 0.3, (PATHS, PATH_DIM)).astype("f4")
        self.word = r.normal(0, 0.1, (WORDS, WORD_DIM)).astype("f4")
        for way in "fb":
            setattr(self, f"wx_{way}", r.normal(0, d**-0.5, (d, 4 * HIDDEN)).astype("f4"))
            setattr(self, f"wh_{way}", r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype("f4"))
            bias = np.zeros(4 * HIDDEN, "f4")
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            setattr(self, f"b_{way}", bias)
        self.out = r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN).astype("f4")
        self.out_b = np.zeros(1, "f4")

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray, dict]:
        """Padded block vectors, their mask, and what the backward pass needs."""
        sizes = [len(p[0]) for p in pages]
        t = max(sizes)
        mask = (np.arange(t)[None] < np.array(sizes)[:, None]).astype("f4")
        flat_p = [i for p in pages for i in p[0]]
        flat_w = [i for p in pages for i in p[1]]
        np_, nw = np.array([len(i) for i in flat_p]), np.array([len(i) for i in flat_w])
        ids_p, ids_w = np.concatenate(flat_p), np.fromiter((h for ws in flat_w for h in ws), np.int64, int(nw.sum()))
        v = np.concatenate(
            [
                np.add.reduceat(self.path[ids_p], np.cumsum(np_) - np_, axis=0),
                np.add.reduceat(self.word[ids_w], np.cumsum(nw) - nw, axis=0) / nw[:, None],
                np.concatenate([p[2] for p in pages]),
            ],
            1,
        )
        x = np.zeros((len(pages), t, v.shape[1]), "f4")
        x[mask > 0] = v
        return x, mask, {"ids_p": ids_p, "np": np_, "ids_w": ids_w, "nw": nw}

    def run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, dict]:
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        if way == "b":
            x, mask = x[:, ::-1], mask[:, ::-1]
        n, t, _ = x.shape
        z_in = x @ wx + b
        h = c = np.zeros((n, HIDDEN), "f4")
        keep = {k: np.zeros((t, n, HIDDEN), "f4") for k in "ifogchk"}  # k: the cell before
        k3 = 3 * HIDDEN
        for s in range(t):
            z = z_in[:, s] + h @ wh
            gates = sigmoid(z[:, :k3])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, k3:])
            m = mask[:, s, None]
            keep["k"][s] = c
            c = (f * c + i * g) * m
            h = o * np.tanh(c) * m
            for k, v in (("i", i), ("f", f), ("o", o), ("g", g), ("c", c), ("h", h)):
                keep[k][s] = v
        out = keep["h"].transpose(1, 0, 2)
        return (out[:, ::-1] if way == "b" else out), keep

    def back(self, x: np.ndarray, mask: np.ndarray, way: str, keep: dict, dout: np.ndarray) -> tuple[np.ndarray, dict]:
        wx, wh = getattr(self, f"wx_{way}"), getattr(self, f"wh_{way}")
        if way == "b":
            x, mask, dout = x[:, ::-1], mask[:, ::-1], dout[:, ::-1]
        n, t, _ = x.shape
        dz_all = np.zeros((t, n, 4 * HIDDEN), "f4")
        dh = dc = np.zeros((n, HIDDEN), "f4")
        dwh = np.zeros_like(wh)
        for s in range(t - 1, -1, -1):
            i, f, o, g, c, before = (keep[k][s] for k in "ifogck")
            m = mask[:, s, None]
            dh = (dh + dout[:, s]) * m
            tc = np.tanh(c)
            dc = (dc + dh * o * (1 - tc**2)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            dz_all[s] = dz
            if s:
                dwh += keep["h"][s - 1].T @ dz
            dh, dc = dz @ wh.T, dc * f
        dz_all = dz_all.transpose(1, 0, 2)
        dx = dz_all @ wx.T
        grads = {f"wx_{way}": np.einsum("ntd,ntk->dk", x, dz_all, optimize=True), f"wh_{way}": dwh, f"b_{way}": dz_all.sum((0, 1))}
        return (dx[:, ::-1] if way == "b" else dx), grads

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[float, dict]:
        x, mask, seen = self.inputs(pages)
        hf, kf = self.run(x, mask, "f")
        hb, kb = self.run(x, mask, "b")
        h = np.concatenate([hf, hb], 2)
        p = sigmoid(h @ self.out + self.out_b[0])
        y = np.zeros_like(mask)
        y[mask > 0] = np.concatenate(labels)
        d = ((p - y) * mask / mask.sum()).astype("f4")
        loss = float(-(mask * np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / mask.sum())
        g = {"out": np.einsum("nth,nt->h", h, d), "out_b": d.sum(keepdims=True).reshape(1)}
        dh = d[:, :, None] * self.out
        dxf, gf = self.back(x, mask, "f", kf, dh[:, :, :HIDDEN])
        dxb, gb = self.back(x, mask, "b", kb, dh[:, :, HIDDEN:])
        dv = (dxf + dxb)[mask > 0]
        g |= gf | gb
        g["path"], g["word"] = np.zeros_like(self.path), np.zeros_like(self.word)
        np.add.at(g["path"], seen["ids_p"], np.repeat(dv[:, :PATH_DIM], seen["np"], 0))
        np.add.at(g["word"], seen["ids_w"], np.repeat(dv[:, PATH_DIM : PATH_DIM + WORD_DIM] / seen["nw"][:, None], seen["nw"], 0))
        return loss, g

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def hidden(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """What ``run`` gives, without what only training needs."""
        wx, wh, b = (getattr(self, f"{n}_{way}") for n in ("wx", "wh", "b"))
        n, t, _ = x.shape
        out = np.zeros((n, t, HIDDEN), "f4")
        h = c = np.zeros((n, HIDDEN), "f4")
        k3 = 3 * HIDDEN
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = x[:, s] @ wx + b + h @ wh
            gates = sigmoid(z[:, :k3])
            m = mask[:, s, None]
            c = (gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, k3:])) * m
            h = gates[:, 2 * HIDDEN :] * np.tanh(c) * m
            out[:, s] = h
        return out

    def probabilities(self, pages: list, rows: int = 128, room: int = 60_000) -> list[np.ndarray]:
        """For each page the chance of each block to be part of the article.

        Pages of like size go together, as many as fit in ``room`` blocks with what fills them up.
        """
        out: list = [np.zeros(0, "f4")] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < min(len(order), at + rows) and (end + 1 - at) * len(pages[order[end]][0]) <= room:
                end += 1
            some, at = order[at:end], end
            x, mask, _ = self.inputs([pages[k] for k in some])
            h = self.hidden(x, mask, "f") @ self.out[:HIDDEN] + self.hidden(x, mask, "b") @ self.out[HIDDEN:]
            p = sigmoid(h + self.out_b[0])
            for j, k in enumerate(some):
                out[k] = p[j, : len(pages[k][0])]
        return out


#: What sites call the parts of a page.
REGIONS = {
    "menu": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "topnav", "tabs", "pagination"],
    "header": ["header", "masthead", "site-header", "top-bar", "banner", "branding", "page-header"],
    "footer": ["footer", "site-footer", "colophon", "bottom", "copyright", "foot", "legal"],
    "sidebar": ["sidebar", "aside", "widget", "rail", "side-col", "secondary", "right-column", "toc"],
    "notice": ["notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "disclaimer", "paywall", "cookie-notice"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "banner-ad", "advertisement", "sponsored", "adsense", "dfp-slot"],
    "form": ["form", "newsletter", "subscribe", "signup", "search", "login", "contact-form"],
    "related": ["related", "recommended", "more-stories", "read-next", "popular", "trending", "share", "social", "tags", "author-box"],
    "comments": ["comments", "comment-list", "disqus", "replies", "discussion", "responses", "comment", "user-comments"],
}
ARTICLE = ["content", "post", "entry", "article-body", "story", "post-content", "entry-content", "main-content", "article", "text", "body-copy", "page-content", "blog-post"]
SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "is", "ou", "ng", "lich", "schü", "ung", "keit", "ción", "ñe", "que", "aux", "éo", "tion", "ment", "ß", "è", "ла", "но", "ст", "wor", "ld"]


def training_page(seed: int) -> str:
    """A page; its article's words all begin with \\x01."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chance = lambda p: bool(r.random() < p)
    noisy = pick(["", "", "", "!!", "%%%", "&amp;&amp;&amp;", "***"])

    def words(lo: int, hi: int, main: bool = False) -> str:
        out = []
        for _ in range(int(r.integers(lo, hi))):
            w = "".join(pick(SYLLABLES) for _ in range(int(r.integers(1, 5)))) + (noisy if main else "")
            out.append(("\x01" if main else "") + (w.capitalize() if chance(0.1) else w))
        return " ".join(out) + pick([".", ".", ".", "", "!", "?"])

    def region(kind: str, deep: int = 0) -> str:
        name = pick(REGIONS[kind])
        links = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(int(r.integers(2, 9))))
        body = {
            "menu": lambda: f"<ul>{links}</ul>",
            "header": lambda: f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>" if chance(0.5) else f"<div><a href='/'>{words(1, 3)}</a></div><p>{words(1, 6)}</p>",
            "footer": lambda: pick([f"&copy; {words(1, 3)} &middot; {words(1, 22)}", f"<p>&copy; 2024 {words(2, 10)}</p><ul>{links}</ul>", f"<p>{words(3, 20)}</p>"]),
            "sidebar": lambda: f"<h3>{words(1, 4)}</h3>" + pick([f"<ul>{links}</ul>", f"<p>{words(4, 40)}</p>", f"<div>{words(3, 30)}</div><p>{words(3, 25)}</p>"]),
            "notice": lambda: f"<p>{words(4, 40)}</p><button>{words(1, 3)}</button>" if chance(0.6) else words(4, 40),
            "ad": lambda: pick([words(2, 30), f"<p>{words(3, 30)}</p>", f"<a href='#'>{words(2, 12)}</a>", f"<span>{words(3, 25)}</span>"]),
            "form": lambda: f"<label>{words(1, 6)}</label><input type='text'><p>{words(2, 14)}</p><button>{words(1, 3)}</button>",
            "related": lambda: f"<h4>{words(1, 4)}</h4><ul>{links}</ul>" if chance(0.6) else f"<div>{words(3, 25)}</div>" * 2,
            "comments": lambda: f"<h3>{words(1, 4)}</h3>" + "".join(
                pick(["<div class='comment'><b>{a}</b><p>{b}</p></div>", "<li><p>{b}</p></li>", "<article class='comment'><p>{b}</p></article>", "<p>{b}</p>"]).format(a=words(1, 3), b=words(4, 60))
                for _ in range(int(r.integers(1, 5)))
            ),
        }[kind]()
        tag = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "form": ["form", "div"]}.get(kind, ["div", "section", "aside"] if kind != "comments" else ["div", "section", "ol", "ul"])
        tag = pick(tag)
        bare = tag in ("nav", "header", "footer", "aside", "form") and chance(0.5)
        return f"<{tag}>{body}</{tag}>" if bare else f'<{tag} {pick(["class", "class", "id"])}="{name}{pick(["", "", " " + pick(["box", "wrap", "x1", "col-3", "left"])])}">{body}</{tag}>'

    def paragraph() -> str:
        kind = r.random()
        text = words(1, pick([4, 25, 80, 200]), True)
        if kind < 0.62:
            return f"<p>{text}</p>" if chance(0.9) else f"<p>{text}"
        if kind < 0.72:
            return f"<p><b>{text}<br>"
        if kind < 0.78:
            return f"<h2>{words(1, 8, True)}</h2><p>{text}</p>"
        if kind < 0.84:
            return f"<{(t := pick(['ul', 'ol']))}>" + "".join(f"<li>{words(2, 14, True)}</li>" for _ in range(int(r.integers(2, 6)))) + f"</{t}>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.92:
            return f"<div>{text}</div>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{words(1, 5, True)}</td><td>{words(1, 5, True)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<p>{words(1, 12, True)} <a href='/x'>{words(1, 4, True)}</a> <em>{words(1, 4, True)}</em> {text}</p>"

    body = f"<h1>{words(1, 14, True)}</h1>" if chance(0.9) else ""
    for _ in range(int(r.integers(0, pick([3, 8, 25])))):
        body += paragraph()
        if chance(0.05):
            body += region(pick(["ad", "notice", "related", "form"]))
    if chance(0.15):
        body += region(pick(["comments", "related"]))
    name = pick(ARTICLE)
    body = pick(
        [
            lambda: f"<article>{body}</article>",
            lambda: f"<article>{body}</article>",
            lambda: f'<article class="{name}">{body}</article>',
            lambda: f"<main>{body}</main>",
            lambda: f"<main><article>{body}</article></main>",
            lambda: f'<div class="{name}">{body}</div>',
            lambda: f'<div id="{name}"><section>{body}</section></div>',
            lambda: f'<div id="main"><div class="{name}">{body}</div></div>',
        ]
    )()
    before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("ad", 0.5), ("form", 0.2), ("sidebar", 0.2)) if chance(p)]
    after = [k for k, p in (("related", 0.35), ("comments", 0.35), ("ad", 0.3), ("sidebar", 0.35), ("form", 0.25), ("notice", 0.15), ("footer", 0.85)) if chance(p)]
    page = "".join(map(region, before)) + body + "".join(map(region, after))
    if chance(0.3):
        page = f'<div class="{pick(["wrapper", "container", "page", "site"])}">{page}</div>'
    end = "" if chance(0.1) else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>{page}{end}"


def trained(seed: int = 11, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    vectors, made, labels = Vectors(), [], []
    for k in range(pages):
        found = blocks(training_page(seed * 1_000_003 + k))
        if not found:
            continue
        labels.append(np.array(["\x01" in text for _, text, _ in found], "f4"))
        made.append(vectors.page([(path, text.replace("\x01", ""), linked) for path, text, linked in found]))
    net = Labeller(seed)
    r = np.random.default_rng(seed)
    m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    step = 0
    size = np.array([len(p[0]) for p in made])
    for epoch in range(epochs):
        order = np.argsort(size + r.random(len(made)) * 8)
        groups = [order[at : at + 16] for at in range(0, len(order), 16)]
        for b in r.permutation(len(groups)):
            _, g = net.gradients([made[k] for k in groups[b]], [labels[k] for k in groups[b]])
            step += 1
            rate = 0.01 * (0.6**epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n in net.NAMES:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                setattr(net, n, (getattr(net, n) - rate * m[n] / (np.sqrt(v[n]) + 1e-8)).astype("f4"))
    return net


def label_blocks(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), net: Labeller | None = None) -> DataFrame:
    """The kept columns and every block of each page: text and chance to be part of the article."""
    net = net or trained()
    shipped = pages.sparkSession.sparkContext.broadcast({n: getattr(net, n) for n in net.NAMES})
    df = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("__html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1])
    kind = pa.list_(pa.struct([("text", pa.string()), ("p", pa.float32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(0)
        vars(model).update(shipped.value)
        vectors = Vectors()
        for batch in batches:
            for part in slices(batch):
                found = [blocks(h) for h in part.column(len(keep)).to_pylist()]
                chances = model.probabilities([vectors.page(f) if f else ([], [], None) for f in found])
                rows = [[{"text": b[1], "p": float(p)} for b, p in zip(f, c)] for f, c in zip(found, chances)]
                yield pa.RecordBatch.from_arrays(part.columns[: len(keep)] + [pa.array(rows, kind)], names=[*keep, "blocks"])

    return df.mapInArrow(scan, f"{kept}, blocks array<struct<text:string,p:float>>")


def extract(pages: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The kept columns and the main text: article blocks in page order, one line each."""
    found = label_blocks(pages, **options)
    main = F.transform(F.filter("blocks", lambda b: b["p"] >= threshold), lambda b: b["text"])
    return found.select(*[c for c in found.columns if c != "blocks"], F.array_join(main, "\n").alias("text"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
