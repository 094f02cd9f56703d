"""Main text of web pages: a recurrent block labeller in numpy.

A page is cut into leaf blocks, the text between block-level tags. Each block is a vector of its tag path (tags,
classes and ids of the open elements, hashed), its words (hashed) and a few numbers (length, share of link text,
sentence marks, place). A bidirectional LSTM runs over the page's blocks, so every block is classified with
the whole page in view; the blocks it takes for the article are joined. It is trained here on pages that
``training_page`` makes up: layouts with menus, headers, footers, sidebars, notices, adverts, forms and
comments in many namings, around and inside articles.

Scripts, styles, templates, framed documents, the title and comments of the markup are no text at all and do not end a block. Character references are decoded,
white space inside a block becomes one space, ``<br>`` is white space. Defined results: a null or empty page
gives an empty text; unclosed and stray tags are borne as browsers do (a new paragraph ends the last one);
pages of any length are read whole; repeated rows give equal texts; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.llm.common import bounded_batches, slices, without

PATH_DIMS, WORD_DIMS, EXTRA, HIDDEN = 96, 48, 5, 16
FIT_PAGES = 700
#: Blocks of a page that are scored at once.
SLAB = 4096

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>|[^<>]*+>)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORDS = re.compile(r"[^\W\d_]+")
SILENT = {"script", "style", "template", "title", "iframe"}
INLINE = set("canvas math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder noscript object svg a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: tag: open elements that a new one ends, looked for no further than CONTAINERS
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body", "main", "nav"}


def blocks(page: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, slots of the names on its tag path, share of its characters in links) of each block with text, in page order."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    open_tags: list[tuple[str, tuple[int, ...]]] = []
    held = [0] * PATH_DIMS  # names of open_tags by slot, so that a block's path costs the same however deep it lies
    opened: Counter = Counter()  # of the tags in open_tags
    endless: set[str] = set()  # silent tags of which no end is left
    parts: list[str] = []
    path: tuple[int, ...] = ()
    linked = 0

    def text(raw: str) -> None:
        nonlocal path, linked
        if raw and not raw.isspace():
            if not parts or not path:
                path = tuple(n for n, times in enumerate(held) if times)
            if opened["a"]:
                linked += len(raw)
        parts.append(raw)

    def close() -> None:
        nonlocal path, linked
        if path or parts:
            joined = " ".join(html.unescape("".join(parts)).split())
            if joined:
                out.append((joined, path, min(1.0, linked / max(1, sum(map(len, parts))))))
        parts.clear()
        path, linked = (), 0

    def end_last() -> str:
        last, names = open_tags.pop()
        opened[last] -= 1
        for n in names:
            held[n] -= 1
        return last

    def leave(tag: str) -> None:
        """End the innermost element of a tag, and all in it."""
        while opened[tag] and end_last() != tag:
            pass

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # a closing tag ends its element and all in it; a stray one nothing
            if tag not in INLINE:
                close()
            leave(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in SILENT:
            end = None if tag in endless else re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            if tag == "title":
                close()
            at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag not in INLINE:
            close()
            leave("p")  # any new block ends an open paragraph
            if tag in ENDS:
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] in ENDS[tag]:
                        while len(open_tags) > k:
                            end_last()
                        break
                    if open_tags[k][0] in CONTAINERS:
                        break
        if tag not in VOID and not m[3].endswith("/>"):
            names = [tag]
            for a in NAMES.findall(m[3]):
                names += ["." + w for w in WORDS.findall("".join(a).lower())]
            slots = tuple(slot(n, PATH_DIMS) for n in names) if tag not in INLINE or tag == "a" else ()
            open_tags.append((tag, slots))
            opened[tag] += 1
            for n in slots:
                held[n] += 1
    text(page[at:])
    close()
    return out


@lru_cache(200_000)
def slot(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims


def features(found: list[tuple[str, tuple[int, ...], float]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Of a page's blocks, or of those from lo to hi."""
    some = found[lo:hi]
    x = np.zeros((len(some), PATH_DIMS + WORD_DIMS + EXTRA), "f4")
    for k, (text, path, linked) in enumerate(some):
        x[k, list(path)] = 1
        words = WORDS.findall(text.lower())
        for w in words:
            x[k, PATH_DIMS + slot(w, WORD_DIMS)] += 1
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= max(1.0, len(words))
        x[k, -EXTRA:] = (np.log1p(len(text)) / 6, linked, text[-1] in ".!?…。", (lo + k) / len(found), np.log1p(text.count(" ")) / 4)
    return x


class BiLstm:
    """Two LSTMs of HIDDEN units, one from either end, and a logistic unit on both states and the block itself."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        d = PATH_DIMS + WORD_DIMS + EXTRA
        make = lambda *s: g.normal(0, 1 / np.sqrt(s[0]), s).astype("f4")
        self.p = {"out": make(2 * HIDDEN, 1)[:, 0], "skip": np.zeros(d, "f4"), "bias": np.zeros(1, "f4")}
        for side in "fb":
            self.p |= {"wx" + side: make(d, 4 * HIDDEN), "wh" + side: make(HIDDEN, 4 * HIDDEN), "bb" + side: np.repeat([0, 1, 0, 0], HIDDEN).astype("f4")}

    def steps(self, x: np.ndarray, mask: np.ndarray, side: str, h: np.ndarray, c: np.ndarray):
        """Walk over x (steps x pages x features) from one end: (step, states before and after it, gates)."""
        z_in = x @ self.p["wx" + side] + self.p["bb" + side]
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ self.p["wh" + side]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            was_h, was_c = h, c
            c = np.where(m, f * c + i * g, c)
            h = np.where(m, o * np.tanh(c), h)
            yield t, h, (i, f, o, g, c, was_h, was_c)

    def side(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States (steps x pages x HIDDEN) and what the backward pass of a fit needs."""
        start = np.zeros((x.shape[1], HIDDEN), "f4")
        states, kept = np.zeros((*x.shape[:2], HIDDEN), "f4"), [None] * len(x)
        for t, h, gates in self.steps(x, mask, side, start, start):
            states[t], kept[t] = h, gates
        return states, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.scored(lambda lo, hi: x[lo:hi], mask)

    def scored(self, part, mask: np.ndarray) -> np.ndarray:
        """Scores (steps x pages) of features that part(from, to) gives, SLAB steps at a time: either side's walk adds its share of a step's
        score and goes on from its state, so no states, gates or features are kept but one slab's."""
        total = np.zeros(mask.shape, "f4")
        for k, side in enumerate("fb"):
            h = c = np.zeros((mask.shape[1], HIDDEN), "f4")
            slabs = range(0, len(mask), SLAB)
            for lo in slabs if side == "f" else reversed(slabs):
                x = part(lo, min(lo + SLAB, len(mask)))
                if side == "f":
                    total[lo : lo + SLAB] += x @ self.p["skip"] + self.p["bias"]
                for t, h, gates in self.steps(x, mask[lo : lo + SLAB], side, h, c):
                    c = gates[4]
                    total[lo + t] += h @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        sides = {s: self.side(x, mask, s) for s in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], 2)
        score = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"], -30, 30)))
        err = (score - want) * mask / mask.sum()
        grad = {"out": np.einsum("tp,tph->h", err, both), "skip": np.einsum("tp,tpd->d", err, x), "bias": np.array([err.sum()])}
        for k, side in enumerate("fb"):
            kept = sides[side][1]
            d_out = err[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            d_z = np.zeros((*err.shape, 4 * HIDDEN), "f4")
            d_h = d_c = np.zeros((x.shape[1], HIDDEN), "f4")
            d_wh = np.zeros_like(self.p["wh" + side])
            for t in range(len(x) - 1, -1, -1) if side == "f" else range(len(x)):
                i, f, o, g, c, was_h, was_c = kept[t]
                m = mask[t][:, None]
                own_h, th = (d_h + d_out[t]) * m, np.tanh(c)
                own_c = (d_c * m) + own_h * o * (1 - th * th)
                z = np.concatenate([own_c * g * i * (1 - i), own_c * was_c * f * (1 - f), own_h * th * o * (1 - o), own_c * i * (1 - g * g)], 1)
                d_z[t] = z
                d_wh += was_h.T @ z
                d_h = np.where(m, z @ self.p["wh" + side].T, d_h)
                d_c = np.where(m, own_c * f, d_c)
            grad |= {"wx" + side: np.einsum("tpd,tpz->dz", x, d_z, optimize=True), "wh" + side: d_wh, "bb" + side: d_z.sum((0, 1))}
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH_DIMS + WORD_DIMS + EXTRA), "f4")
    mask = np.zeros((steps, len(pages)), bool)
    for k, f in enumerate(pages):
        x[: len(f), k], mask[: len(f), k] = f, True
    return x, mask


# Names that layouts give to what is not the article, and to what is.
ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb topnav links toc".split(),
    "header": "header masthead banner site-header logo topbar".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related widget recommended trending popular share social".split(),
    "notice": "cookie notice consent alert popup newsletter gdpr modal".split(),
    "ad": "ad ads advert advertisement sponsored promo adsbox banner-ad".split(),
    "form": "form login search signup subscribe register contact".split(),
    "comments": "comments comment replies disqus respond discussion reader-comments".split(),
}
MAIN = "content post entry article main story text body article-body post-content page".split()


def training_page(g: np.random.Generator) -> tuple[str, list[bool]]:
    """A made-up page and, for each of its blocks, whether it belongs to the article. Words are made of random
    syllables; what differs is the layout, as text of adverts and articles may be alike."""
    syllables = ["".join(p) for p in zip(g.choice(list("bcdfglmnprst"), 30), g.choice(list("aeiouéäñ"), 30))]
    word = lambda: "".join(g.choice(syllables, g.integers(1, 4)))
    line = lambda lo, hi: " ".join(word() for _ in range(g.integers(lo, hi))).capitalize() + g.choice([".", ".", ".", "!", "", " &amp;"])
    labels: list[bool] = []

    def block(tag: str, text: str, main: bool, cls: str = "") -> str:
        labels.append(main)
        inner = f"<b>{text}</b>" if g.random() < 0.1 else text
        return f"<{tag}{cls}>{inner}" + ("" if tag in ("p", "li") and g.random() < 0.2 else f"</{tag}>")

    def other(kind: str) -> str:
        name = g.choice(ASIDE[kind])
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and g.random() < 0.5 else g.choice(["div", "section", "div"])
        attr = "" if tag == kind and g.random() < 0.6 else f' {g.choice(["class", "id"])}="{name}"'
        if kind == "nav" or (kind in ("aside", "footer", "header") and g.random() < 0.4):
            body = "<ul>" + "".join(block("li", f'<a href="/{word()}">{line(1, 3)}</a>', False) for _ in range(g.integers(2, 8))) + "</ul>"
        elif kind == "form":
            body = block("p", line(1, 6), False) + '<input name="q">' + block("button", line(1, 3), False)
        elif kind == "comments":
            body = block("h3", line(1, 4), False) + "".join(block(g.choice(["p", "div"]), line(3, 50), False) for _ in range(g.integers(1, 6)))
        elif g.random() < 0.5:
            labels.append(False)
            return f"<{tag}{attr}>{line(3, 25)}</{tag}>"
        else:
            body = "".join(block("p", line(2, 30), False) for _ in range(g.integers(1, 4)))
        return f"<{tag}{attr}>{body}</{tag}>"

    kinds = list(ASIDE)
    some = lambda names, most: "".join(other(k) for k in g.choice(names, g.integers(0, most + 1)))
    head = "<!DOCTYPE html><html><head><title>" + line(2, 8) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
    before = some(["nav", "header", "notice", "ad", "form", "nav", "ad"], 4)
    shell = g.choice(["article", "main", "div", "section", "none"], p=[0.45, 0.15, 0.25, 0.05, 0.1])
    cls = f' {g.choice(["class", "id"])}="{g.choice(MAIN)}"' if shell in ("div", "section") or g.random() < 0.3 else ""
    body = block("h1", line(1, 10), True) if g.random() < 0.8 else ""
    terse = g.random()  # share of short paragraphs, which differs between articles
    for _ in range(g.choice([1, 2, 3, 5, 8, 12, 25, 60], p=[0.1, 0.1, 0.15, 0.2, 0.15, 0.15, 0.1, 0.05])):
        r = g.random()
        if r < 0.78:
            body += block("p", line(1, 6) if g.random() < 0.6 * terse else line(1, 90) + (" " + line(3, 20)) * int(g.integers(0, 3)), True)
        elif r < 0.84:
            body += block(g.choice(["h2", "h3"]), line(1, 7), True)
        elif r < 0.89:
            body += "<ul>" + "".join(block("li", line(2, 20), True) for _ in range(g.integers(1, 5))) + "</ul>"
        elif r < 0.92:
            body += f"<blockquote>{block('p', line(4, 30), True)}</blockquote>"
        elif r < 0.94:
            body += "<table><tr>" + "".join(block("td", line(1, 5), True) for _ in range(3)) + "</tr></table>"
        elif shell != "none":
            body += other(g.choice(["ad", "aside", "form", "notice"]))
    shelled = body if shell == "none" else f"<{shell}{cls}>{body}</{shell}>"
    after = some(["aside", "comments", "ad", "form", "nav", "notice", "comments"], 3) + (other("footer") if g.random() < 0.8 else "")
    return head + before + shelled + after + ("</body></html>" if g.random() < 0.8 else ""), labels


def fit(pages: int = FIT_PAGES, epochs: int = 7, batch: int = 20, seed: int = 5) -> BiLstm:
    g, net = np.random.default_rng(seed), BiLstm(seed)
    made = []
    for _ in range(pages):
        page, labels = training_page(g)
        found = blocks(page)
        if found and len(found) == len(labels):
            made.append((features(found), np.array(labels, "f4")))
    made.sort(key=lambda m: len(m[0]))
    moments = {n: [np.zeros_like(v, dtype="f8"), np.zeros_like(v, dtype="f8")] for n, v in net.p.items()}
    step, batches = 0, [made[i : i + batch] for i in range(0, len(made), batch)]
    for epoch in range(epochs):
        for k in g.permutation(len(batches)):
            x, mask = padded([f for f, _ in batches[k]])
            want = np.zeros(mask.shape, "f4")
            for j, (_, labels) in enumerate(batches[k]):
                want[: len(labels), j] = labels
            step += 1
            for n, grad in net.gradients(x, mask, want).items():
                m = moments[n]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.99 * m[1] + 0.01 * np.square(grad)
                rate = 0.015 if epoch < epochs - 2 else 0.004
                net.p[n] = (net.p[n] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype("f4")
    return net


@lru_cache(1)
def default_model() -> BiLstm:
    return fit()


def extract(net: BiLstm, pages: list[str | None], room: int = 60_000) -> list[str]:
    """The main texts; pages of like length go through the network together, up to room blocks at once."""
    found = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(found[order[hi]]) <= room:
            hi += 1
        own = order[lo:hi]
        if len(own) == 1 and len(found[own[0]]) > SLAB:  # a page of very many blocks: its features are made a slab at a time
            one = found[own[0]]
            score = net.scored(lambda a, b: features(one, a, b)[:, None], np.ones((len(one), 1), bool))
        else:
            score = net.scores(*padded([features(found[k]) for k in own]))
        for j, k in enumerate(own):
            out[k] = "\n".join(b[0] for b, s in zip(found[k], score[:, j]) if s >= 0.5)
        lo = hi
    return out


def main_text(pages: DataFrame, net: BiLstm | None = None, html_col: str = "html") -> DataFrame:
    """pages with ``text`` and ``n_chars`` (its code points); columns of these names are replaced."""
    bounded_batches(pages.sparkSession)
    model = net or default_model()

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([t for lo, hi in slices(b) for t in extract(model, b[lo:hi].to_pylist())], pa.string())

    out = without(pages, "text", "n_chars").withColumn("text", text(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
