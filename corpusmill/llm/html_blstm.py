"""HTML main-text extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: the text between block-level borders, with the path of open elements above it.
Each block is a vector of hashed tag-path parts (tags, words of class and id), hashed words and a few shapes (length, share of link
text, punctuation, place). A bidirectional LSTM in numpy reads the whole sequence, so every block is classified with the
context of the whole page, and the blocks labelled main text are joined.

No page comes with labels. The network learns from a bounded sample of pages whose own mark-up says what is what (text in
article or main, outside of navigation, asides, footers, forms and the like), and from the same texts re-dressed in other
templates: sections carry class names in place of tags, or names that say nothing; sidebars, notices, forms and reader comments
stand around the main text and inside its element, and the main text has headings, lists, tables and quotations.

Defined cases: null, empty and text-less pages give an empty text; broken mark-up is read leniently (implied end tags, stray end
tags and unclosed elements; a tag without an end stops at the next `<`), in time linear in the page; a very long page is labelled whole
by one task; ties (a block as likely main text as not) count as main text; repeated rows give equal texts; an empty table gives an empty
result; other columns pass through only if in `keep`.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import _words

#: Bounds of the training sample: pages, bytes of a page, and blocks of a window within a page.
SAMPLE_PAGES, SAMPLE_BYTES, SAMPLE_BLOCKS = 240, 500_000, 80
PATH_DIMS, WORD_DIMS, SHAPES, HIDDEN = 96, 24, 11, 12
#: Open inline elements beyond so many leave no trace in paths; their text stays.
INLINE_DEPTH = 200

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea select option svg math iframe object canvas audio video head button".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

# Words of element names, classes and ids that mark what isn't main text, and those of main text.
ASIDE = frozenset(
    "nav aside footer header form menu sidebar ad ads advert advertisement banner comment comments discussion replies reply respond cookie consent notice popup promo related share social newsletter subscribe login breadcrumb breadcrumbs pagination widget disclaimer navbar".split()
)
MAIN = frozenset("article main".split())

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_PLAIN = re.compile(r"[^<>\"']*")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    path: int  # bits of the hashed parts of all open elements
    link: int  # characters of link text
    main: bool  # inside an element that the mark-up calls main text
    aside: bool  # inside one that it calls something else


@dataclass
class Tag:
    name: str
    path: int
    main: bool
    aside: bool


def _tag_end(page: str, at: int, no_more: set[str]) -> int:
    """Past-last place of the tag whose attributes begin at `at`: its `>`, else the next `<` or the page's end. no_more: quotes known to have no partner."""
    while True:
        at = _PLAIN.match(page, at).end()
        c = page[at : at + 1]
        if c == ">":
            return at + 1
        if c in ("", "<"):
            return at
        end = -1 if c in no_more else page.find(c, at + 1)
        if end < 0:
            no_more.add(c)
        at = at + 1 if end < 0 else end + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): texts ("text"), start tags with their attributes ("start") and end tags ("end"), each part of the page read once."""
    at, no_more, n = 0, set(), len(page)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", "", page[at : lt if lt >= 0 else n]
            if lt < 0:
                return
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            opening, closing = ("<!--", "-->") if page.startswith("<!--", lt) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", lt) else ("<!", ">")
            end = page.find(closing, lt + len(opening))
            inner, at = page[lt + len(opening) : end if end >= 0 else n], end + len(closing) if end >= 0 else n
            if opening == "<![CDATA[":
                yield "cdata", "", inner
            continue
        name = _NAME.match(page, lt + 1 + (mark == "/"))
        if not name:
            yield "text", "", "<"
            at = lt + 1
            continue
        at = _tag_end(page, name.end(), no_more)
        rest = page[name.end() : at].removesuffix(">")
        low = name[0].lower()
        yield ("end" if mark == "/" else "start"), low, rest
        if mark != "/" and low in RAW and not rest.endswith("/"):
            end = _RAW_END[low].search(page, at)
            yield "end", low, ""
            at = end.end() if end else n


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; white space inside a block is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[Tag] = []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    link = skip = inline = 0

    def flush() -> None:
        nonlocal link
        joined = " ".join("".join(text).split())
        if joined:
            top = stack[-1] if stack else Tag("", 0, False, False)
            out.append(Block(joined, top.path, min(link, len(joined)), top.main, top.aside))
        text.clear()
        link = 0

    def pop(name: str) -> None:
        """Closes the last open element of the name and all inside it."""
        nonlocal skip, inline
        k = len(stack) - 1
        while stack[k].name != name:
            k -= 1
        if any(t.name not in INLINE for t in stack[k:]):
            flush()
        for t in stack[k:]:
            skip -= t.name in SKIPPED
            inline -= t.name in INLINE
            open_tags[t.name] -= 1
        del stack[k:]

    for kind, tag, rest in tokens(page or ""):
        if kind in ("text", "cdata"):
            if not skip:
                decoded = html.unescape(rest) if kind == "text" and "&" in rest else rest
                text.append(decoded)
                link += len(decoded.strip()) if open_tags["a"] else 0
            continue
        if kind == "end":
            if open_tags[tag]:
                pop(tag)
            elif tag not in INLINE:
                flush()
            continue
        if tag in VOID or rest.endswith("/"):
            if tag == "br" or tag not in INLINE:
                text.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in HEAD and stack and stack[-1].name == "head":  # an implied end of head
            pop("head")
        if tag not in INLINE:
            flush()
            close = CLOSES.get(tag, ("p",))
            if any(open_tags[t] for t in close):
                for t in reversed(stack):
                    if t.name in close:
                        pop(t.name)
                        break
                    if t.name not in INLINE and not (tag in ("tr", "td", "th") and t.name in ("td", "th")):
                        break
        elif inline >= INLINE_DEPTH:
            continue
        words = {n for v in _NAMES.findall(rest) for n in _PART.findall(v.lower())} if rest else set()
        above = stack[-1] if stack else Tag("", 0, False, False)
        path = above.path
        for p in (f"<{tag}", *words):
            path |= 1 << zlib.crc32(p.encode()) % PATH_DIMS
        words.add(tag)
        stack.append(Tag(tag, path, above.main or bool(words & MAIN), above.aside or bool(words & ASIDE)))
        open_tags[tag] += 1
        skip += tag in SKIPPED
        inline += tag in INLINE
    flush()
    return out


def vectors(seq: list[Block]) -> np.ndarray:
    n = len(seq)
    x = np.zeros((n, PATH_DIMS + WORD_DIMS + SHAPES))
    if not n:
        return x
    bits = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIMS // 8, "little") for b in seq), np.uint8).reshape(n, -1)
    x[:, :PATH_DIMS] = np.unpackbits(bits, axis=1, bitorder="little")
    raw = [b.text.encode("utf-8", "replace") for b in seq]
    w = _words.split_words(raw)
    count = np.diff(w.first)
    words = np.bincount(w.doc * WORD_DIMS + (w.hash % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.log1p(words) / 3
    size = np.array([len(b.text) for b in seq], float)
    marks = np.array([r.count(b".") + r.count(b",") for r in raw], float)
    place = np.arange(n) / max(1, n - 1)
    link = np.array([b.link for b in seq]) / size
    called = [np.array([b.main for b in seq], float), np.array([b.aside for b in seq], float)]
    x[:, -SHAPES:] = np.column_stack([*called, np.log1p(size) / 8, np.log1p(count) / 6, link, marks / np.maximum(count, 1), place, 1 - place, np.arange(n) == 0, np.arange(n) == n - 1, np.ones(n)])
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Per direction: input and recurrent weights of the four gates; then the read-out."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    out: np.ndarray

    def _run(self, x: np.ndarray, size: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (pages x time x hidden); states stand still past a page's end."""
        pages, steps, _ = x.shape
        h = c = np.zeros((pages, HIDDEN))
        out = np.zeros((pages, steps, HIDDEN))
        pre = x @ self.wx[side]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            live = (t < size)[:, None]
            gates = pre[:, t] + h @ self.wh[side]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            c2 = np.where(live, f * c + i * g, c)
            th = np.tanh(c2)
            h2 = np.where(live, o * th, h)
            if keep is not None:
                keep.append((t, live, h, c, i, f, o, g, th))
            h, c = h2, c2
            out[:, t] = h
        return out

    def score(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, size, 0), self._run(x, size, 1), x], axis=2)
        return _sigmoid(both @ self.out)

    def gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over blocks and its gradient, through time in both directions."""
        kept: list[list] = [[], []]
        hid = [self._run(x, size, s, kept[s]) for s in (0, 1)]
        both = np.concatenate([*hid, x], axis=2)
        p = _sigmoid(both @ self.out)
        mask = np.arange(x.shape[1])[None, :] < size[:, None]
        d = np.where(mask, p - y, 0) / mask.sum()
        loss = -np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / mask.sum()
        grads = [np.zeros_like(w) for w in (*self.wx, *self.wh)] + [np.einsum("pt,ptk->k", d, both)]
        for side in (0, 1):
            dh_out = d[:, :, None] * self.out[side * HIDDEN : (side + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            dpre = np.zeros((len(x), x.shape[1], 4 * HIDDEN))
            for t, live, h, c, i, f, o, g, th in reversed(kept[side]):
                dh = dh + dh_out[:, t]
                do = dh * th
                dct = dc + dh * o * (1 - th**2)
                gates = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - g**2)], axis=1)
                gates = np.where(live, gates, 0)
                dpre[:, t] = gates
                grads[2 + side] += h.T @ gates
                dh = np.where(live, gates @ self.wh[side].T, dh)
                dc = np.where(live, dct * f, dc)
            grads[side] += np.einsum("ptd,ptk->dk", x, dpre)
        return float(loss), grads


def weak_labels(seq: list[Block]) -> np.ndarray:
    """What the mark-up itself says; where it names no main text, long blocks with little link text count."""
    marked = any(b.main for b in seq)
    return np.array([(b.main if marked else b.path > 0 and len(b.text.split()) >= 10 and b.link < 0.3 * len(b.text)) and not b.aside for b in seq], float)


def dress(rng: np.random.Generator, main: list[str], other: list[str], neutral: bool = False) -> tuple[str, list[str]]:
    """(page, its main blocks): known texts in a template that names its sections by tag or by class, or (neutral) by names that say nothing."""
    pick = lambda *x: x[rng.integers(len(x))]
    e = html.escape
    take = lambda n: [e(other[rng.integers(len(other))]) for _ in range(n)]
    short = lambda: e(" ".join(other[rng.integers(len(other))].split()[: int(rng.integers(1, 5))]))
    chance = lambda p: rng.random() < p

    def wrap(kinds: tuple[str, ...], inner: str) -> str:
        tag, _, cls = pick(*kinds).partition(".")
        if neutral:
            tag, cls = pick("div", "div", "section", "td"), pick("c", "box", "row", "col", "x", "blk", "a", "inner") + str(rng.integers(1, 9))
        return f"<{tag}{f' {pick("class", "id")}="{cls}"' if cls else ''}>{inner}</{tag}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>"
    paras = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    comments = lambda: wrap(("section.comments", "div.comments", "div.comment", "ol.comments", "div.replies", "section.discussion"), ("<h3>" + short() + "</h3>") * chance(0.4) + paras(take(int(rng.integers(1, 5)))))
    form = lambda: wrap(("form", "form.login", "form.comment", "div.newsletter"), f"<label>{short()}</label><input name=q><p>{pick(short(), take(1)[0])}</p><button>{short()}</button>")
    side = lambda: wrap(("aside", "div.sidebar", "div.related", "div.promo", "div.share"), paras(take(int(rng.integers(1, 3)))) + links(int(rng.integers(0, 4))))
    advert = lambda: wrap(("div.ad", "div.advert", "aside", "div.banner"), pick(paras(take(1)), take(1)[0]))

    body, told = [], []
    for k, t in enumerate(main):
        kind = "h1" if k == 0 and chance(0.7) else pick("p", "p", "p", "p", "p", "h2", "li", "blockquote", "td")
        told.append(t)
        one = e(t)
        body.append({"li": f"<ul><li>{one}</li></ul>", "td": f"<table><tr><td>{one}</td></tr></table>", "blockquote": f"<blockquote><p>{one}</p></blockquote>"}.get(kind, f"<{kind}>{one}</{kind}>"))
    inside = "".join(body)
    if not neutral:  # what isn't main text may stand inside the main element, between its blocks or at its end
        if chance(0.3):
            at = int(rng.integers(0, len(body) + 1))
            inside = "".join(body[:at]) + pick(side, advert, form)() + "".join(body[at:])
        inside = ("<header>" + short() + "</header>") * chance(0.15) + inside + comments() * chance(0.4) + form() * chance(0.3) + ("<footer>" + short() + "</footer>") * chance(0.15)
    parts = [
        wrap(("header", "div.header", "div.top"), short() + links(int(rng.integers(1, 6)))),
        wrap(("nav", "div.menu", "div.nav", "ul.navbar"), links(int(rng.integers(2, 9)))),
        advert(),
        wrap(("div.cookie", "div.notice", "div.consent"), paras(take(1))),
        wrap(("article", "main", "div.content", "div.post", "div.entry", "section.story", "div.article", "div"), inside),
        side(),
        form(),
        comments(),
        wrap(("footer", "div.footer"), f"&copy; {short()} &middot; " + pick(short(), take(1)[0])),
    ]
    if neutral:  # names say nothing: link lists and short lines around the text
        parts = [parts[0], parts[1], "", wrap(("div",), short()), parts[4], wrap(("div",), links(int(rng.integers(1, 6)))), "", "", wrap(("div",), f"&copy; {short()}")]
    keep = [p for k, p in enumerate(parts) if k == 4 or chance(0.6)]
    return "<html><head><title>x</title></head><body>" + "".join(keep) + "</body></html>", told


def _labelled_dress(rng: np.random.Generator, main: list[str], other: list[str], neutral: bool) -> tuple[list[Block], np.ndarray]:
    page, told = dress(rng, main, other, neutral)
    seq, left = blocks(page), list(told)
    y = np.zeros(len(seq))
    for k, b in enumerate(seq):  # main blocks stand in their order, outside of what is named otherwise
        if left and b.text == left[0] and not b.aside:
            y[k] = 1
            left.pop(0)
    return seq, y


def fit(pages: list[str], steps: int = 240, seed: int = 3) -> Model:
    """A network after about `steps` steps of Adam, each over a group of pages of like length."""
    rng = np.random.default_rng(seed)
    data: list[tuple[np.ndarray, np.ndarray]] = []

    def add(seq: list[Block], y: np.ndarray) -> None:
        """A window of the page, wherever it lies; its vectors are those of the whole page."""
        at = int(rng.integers(0, max(1, len(seq) - SAMPLE_BLOCKS + 1)))
        data.append((vectors(seq)[at : at + SAMPLE_BLOCKS], y[at : at + SAMPLE_BLOCKS]))

    known = [(s, weak_labels(s)) for s in map(blocks, pages)]
    known = [(s, y) for s, y in known if s]
    for s, y in known:
        add(s, y)
    prose = [b.text for s, y in known for b, v in zip(s, y, strict=True) if v] or ["text"]
    for s, y in known:
        main = [b.text for b, v in zip(s, y, strict=True) if v]
        at = int(rng.integers(0, max(1, len(main) - 29)))
        if main:
            for neutral in (False, False, True):
                add(*_labelled_dress(rng, main[at : at + 30], prose, neutral))
    d = PATH_DIMS + WORD_DIMS + SHAPES
    small = lambda *s: rng.normal(0, 0.1, s)
    model = Model([small(d, 4 * HIDDEN), small(d, 4 * HIDDEN)], [small(HIDDEN, 4 * HIDDEN), small(HIDDEN, 4 * HIDDEN)], small(2 * HIDDEN + d))
    weights = [*model.wx, *model.wh, model.out]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    data.sort(key=lambda s: len(s[1]))
    groups = [pad(data[k : k + 48]) for k in range(0, len(data), 48)]
    epochs = -(-steps // len(groups)) if data else 0
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, size, y = groups[k]
            noisy = x.copy()
            noisy[:, :, :PATH_DIMS] *= rng.random((len(x), 1, PATH_DIMS)) > 0.1
            _, grads = model.gradient(noisy, size, y)
            t += 1
            rate = 0.02 * (1 - epoch / epochs) + 1e-4
            for q, (w, g) in enumerate(zip(weights, grads, strict=True)):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.99 * v[q] + 0.01 * g**2
                w -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.99**t)) + 1e-8)
    return model


def pad(data: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(y) for _, y in data])
    x = np.zeros((len(data), max(1, size.max()), data[0][0].shape[1]))
    y = np.zeros(x.shape[:2])
    for k, (a, b) in enumerate(data):
        x[k, : len(b)], y[k, : len(b)] = a, b
    return x, size, y


def label(sequences: list[list[Block]], model: Model) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages run side by side, in groups of like length."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(sequences)
    order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[min(at + 127, len(order) - 1)]])
        many = max(1, min(128, 40_000 // longest))
        group = order[at : at + many]
        x, size, _ = pad([(vectors(sequences[k]), np.zeros(len(sequences[k]))) for k in group])
        p = model.score(x, size)
        for row, k in enumerate(group):
            out[k] = p[row, : size[row]] >= 0.5
        at += many
    return out


def train(pages: DataFrame) -> Model:
    usable = pages.where(F.col("html").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES))
    sample = usable.select("html").orderBy(F.xxhash64("html"), "html").limit(SAMPLE_PAGES).toArrow()
    return fit(sample["html"].to_pylist())


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, text and n_chars of every row."""
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in _words.chunks(batches, "html"):
            seqs = [blocks(h) for h in part.column("html").to_pylist()]
            texts = ["\n".join(b.text for b, v in zip(s, y, strict=True) if v) for s, y in zip(seqs, label(seqs, model), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, *([] if "html" in keep else ["html"])).mapInArrow(run, schema)
