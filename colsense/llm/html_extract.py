"""Main-text extraction by a recurrent block labeller (operator 1).

A page is cut into leaf blocks: runs of text between block-level tags, comments,
scripts and styles left out.  A block's input vector is made of its tag path
(hashed tag names and words of class, id and role attributes of all open
elements), its hashed words, and a few ratios (link share, length, position).  A
bidirectional LSTM in numpy reads the whole sequence of a page, so that a block
is judged in the context of the document, and labels each block article or not.

Training needs labelled pages, and the table has none.  Of a bounded sample of
distinct pages (SAMPLE, those of smallest hash) the first BLOCKS blocks of either
kind, GOOD_CHARS and BAD_CHARS characters of each, that stand under unmistakable mark-up (article,
main, nav, footer, ...) are taken as texts of known kind and dealt into random
page layouts: other wrappers, class names and names that say nothing, lists,
tables, code and captions of few words anywhere in the article and at its end,
side bars, notices, adverts, forms, reader comments, unclosed paragraphs.  (Where
no name says anything, a last short paragraph beside a block of links may still
go with the links.)  The network learns from those layouts with
their known labels, on the driver, in a fixed number of steps.  Labelling is one
scan over whole pages without a shuffle; pages of similar length are run together.

Cases: a null, empty or textless page gives the empty text; unclosed, stray and
upper-case tags, comments without end, bare text and markup-free pages are read
as a browser would, bare text being a block; a head without end tag ends at the
first element or text that cannot stand in it, an unclosed svg, object, select,
video or the like at an enclosing end tag or the next block, and only script,
style and textarea go on to the end of the page; very long pages go through whole;
repeated and tied rows are labelled each for itself; null ids and urls pass;
other columns are not read; an empty table gives no rows (training then uses
neutral filler texts).
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_contents, table

SAMPLE = 300
BLOCKS, GOOD_CHARS, BAD_CHARS = 40, 600, 300
LAYOUTS = 1400
STEPS, RATE, BATCH = 320, 0.01, 24
HIDDEN = 20
PATH_DIM, WORD_DIM, RATIOS = 96, 24, 8
INPUT = PATH_DIM + WORD_DIM + RATIOS

#: Elements whose content is no text of the page: read up to their end tag or the end of the page, and the others.
RAW = "script|style|textarea"
SKIP = frozenset("noscript template svg math iframe object head select canvas audio video".split())
IN_HEAD = frozenset("title meta link base basefont bgsound noscript template".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_SKIP_END = re.compile(rf"</({'|'.join(sorted(SKIP))})\s*>", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr button input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the second set.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
for _t in ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure "
           "details").split():
    CLOSES[_t] = {"p"}
_BARRIER = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table tbody td th ul".split()) | SKIP
#: Skipped elements that don't end a block, as they stand in the middle of a line.
_IN_LINE = frozenset("svg math canvas noscript".split())


def _hash(word: str, dim: int) -> int:
    return zlib.crc32(word.encode()) % dim


class Block:
    __slots__ = ("text", "path", "link", "tag")

    def __init__(self, text: str, path: tuple[str, ...], link: float, tag: str):
        self.text, self.path, self.link, self.tag = text, path, link, tag


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """Words that tell what an element is: its tag and its class, id and role."""
    out = [f"<{tag}>"]
    if attrs:
        for m in _ATTR.finditer(attrs):
            out += [w.lower() for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, character references decoded and
    white space inside a block made one space."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    skip: int | None = None  # place in the stack of the outermost skipped element
    ends: dict[str, int] | None = None  # last end tag of each of SKIP

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                shown = stack[:skip]
                block_tag = next((t for t, _ in reversed(shown) if t not in INLINE), "")
                blocks.append(Block(text, tuple(n for t, names in shown if t not in INLINE for n in names), min(1.0, linked / len(text)), block_tag))
            parts.clear()
        linked = 0

    def cut(at: int) -> None:
        nonlocal skip
        del stack[at:]
        if skip is not None and skip >= at:
            skip = None

    def ended(tag: str, at: int) -> bool:
        """Whether an end tag of a skipped element follows."""
        nonlocal ends
        if ends is None:
            ends = {m[1].lower(): m.start() for m in _SKIP_END.finditer(page)}
        return ends.get(tag, -1) >= at

    for m in _TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                if skip is None:
                    flush()
            elif m[0][0] != "<" or m[0] == "<":
                # bare text ends a head without end tag
                if skip is not None and stack[-1][0] == "head" and m[0].strip() and not ended("head", m.start()):
                    cut(len(stack) - 1)
                if skip is None:
                    parts.append(m[0])
                    if any(t == "a" for t, _ in stack):
                        linked += len(m[0])
            continue
        tag = tag.lower()
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if (skip is None or at is not None and at <= skip) and tag not in INLINE and tag not in _IN_LINE:
                flush()
            if at is not None:
                cut(at)
            continue
        if skip is not None:
            inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in SKIP)
            if stack[skip][0] == "head" and (tag == "body" or stack[-1][0] == "head" and tag not in IN_HEAD
                                             or "p" in CLOSES.get(tag, ()) and inner == skip):
                flush()
                cut(skip)
            # a block ends a skipped element whose end tag is missing
            while skip is not None and "p" in CLOSES.get(tag, ()) and not ended(stack[inner][0], m.start()):
                flush()
                cut(inner)
                inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in SKIP), 0)
        if skip is None:
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE and tag not in _IN_LINE:
                flush()
        closes = CLOSES.get(tag)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    cut(i)
                    break
                if stack[i][0] in _BARRIER:
                    break
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append((tag, _names(tag, m[4])))
            if skip is None and tag in SKIP:
                skip = len(stack) - 1
    flush()
    return blocks


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        for name in b.path:
            x[i, _hash(name, PATH_DIM)] = 1
        words = b.text.lower().split(" ")
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_hash(w, WORD_DIM) for w in words], minlength=WORD_DIM) / len(words)
        letters = len(b.text)
        x[i, PATH_DIM + WORD_DIM :] = (b.link, min(2.0, np.log1p(letters) / 4), b.text[-1] in ".!?:…\"", i / n,
                                       b.text.count(",") / (1 + letters) * 20, b.tag == "p", b.tag in ("h1", "h2", "h3"), b.tag == "li")
    return x


class BiLstm:
    """One LSTM layer each way and a logistic output for every block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.standard_normal((INPUT + h, 4 * h)) / np.sqrt(INPUT / 4 + h)
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = rng.standard_normal((2 * h + INPUT, 1)) * 0.1
        self.p["c"] = np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        t, b, _ = x.shape
        h = HIDDEN
        w, bias = self.p["W" + d], self.p["c" + d]
        fed = x @ w[:INPUT] + bias
        out = np.zeros((t, b, h), x.dtype)
        s, c, kept = np.zeros((b, h), x.dtype), np.zeros((b, h), x.dtype), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = fed[i] + s @ w[INPUT:]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            u = np.tanh(z[:, 3 * h :])
            new = g[:, h : 2 * h] * c + g[:, :h] * u
            th = np.tanh(new)
            m = mask[i][:, None]
            if keep:
                kept.append((i, s, c, g, u, th, m))
            s, c = m * (g[:, 2 * h :] * th) + (1 - m) * s, m * new + (1 - m) * c
            out[i] = s
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (blocks, pages, INPUT); mask: 1 where a page has a block."""
        f, kf = self._pass(x, mask, "f", keep)
        b, kb = self._pass(x, mask, "b", keep)
        top = np.concatenate([f, b, x], axis=2)
        return (top @ self.p["o"])[..., 0] + self.p["c"][0], (top, kf, kb)

    def gradient(self, x, mask, y) -> dict:
        z, (top, kf, kb) = self.logits(x, mask, True)
        h = HIDDEN
        dz = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
        g = {"o": np.einsum("tbk,tb->k", top, dz)[:, None], "c": np.array([dz.sum()])}
        dtop = dz[..., None] * self.p["o"][:, 0]
        for d, kept, part in (("f", kf, dtop[..., :h]), ("b", kb, dtop[..., h : 2 * h])):
            w = self.p["W" + d]
            gw, gc = np.zeros_like(w), np.zeros_like(self.p["c" + d])
            ds, dc = np.zeros(part.shape[1:]), np.zeros(part.shape[1:])
            for i, s, c, gate, u, th, m in reversed(kept):
                ds = ds + part[i]
                dn, hold_s, hold_c = ds * m, ds * (1 - m), dc * (1 - m)
                inp, forget, out = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                dcell = dc * m + dn * out * (1 - th * th)
                da = np.concatenate([dcell * u * inp * (1 - inp), dcell * c * forget * (1 - forget), dn * th * out * (1 - out),
                                     dcell * inp * (1 - u * u)], axis=1)
                gw[:INPUT] += x[i].T @ da
                gw[INPUT:] += s.T @ da
                gc += da.sum(axis=0)
                ds, dc = hold_s + da @ w[INPUT:].T, hold_c + dcell * forget
            g["W" + d], g["c" + d] = gw, gc
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            x, mask, y = padded([pages[i] for i in rng.integers(0, len(pages), BATCH)])
            for k, g in self.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                rate = RATE * (1 - 0.8 * step / steps)
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(1, max(len(x) for x, _ in pages))
    x, mask, y = np.zeros((t, len(pages), INPUT)), np.zeros((t, len(pages))), np.zeros((t, len(pages)))
    for i, (a, b) in enumerate(pages):
        x[: len(a), i], mask[: len(a), i], y[: len(a), i] = a, 1, b
    return x, mask, y


#: What the layouts are built of: (opening tags, closing tags) of wrappers by kind.
ARTICLE_WRAPS = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"),
                 ('<div class="post-body">', "</div>"), ('<section class="entry-content">', "</section>"), ('<div class="article-text">', "</div>"),
                 ('<main><article class="post">', "</article></main>"), ('<div role="main">', "</div>"), ('<div class="story">', "</div>"),
                 ('<main><div class="article">', "</div></main>"), ('<div id="content"><div class="post">', "</div></div>")]
OTHER_WRAPS = {
    "menu": ["nav", 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'nav class="toc"', 'div role="navigation"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header banner"', 'div class="topbar"'],
    "footer": ["footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright"', 'div role="contentinfo"'],
    "side": ["aside", 'div class="sidebar"', 'div id="side"', 'div class="related-posts"', 'div class="widget"', 'aside class="recommended"', 'section class="related"'],
    "notice": ['div class="cookie-notice"', 'div class="cookie-banner"', 'div id="consent"', 'div class="notice"', 'div class="gdpr"', 'div class="alert"',
               'div class="popup modal"', 'div role="dialog"', 'div class="newsletter"', 'div class="subscribe"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="ad-slot"',
           'aside class="ad"', 'ins class="adsbygoogle"'],
    "form": ["form", 'form class="search"', 'form id="signup"', 'div class="form"'],
    "comments": ['div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div id="disqus"', 'section class="discussion"',
                 'div class="replies"', 'section class="reader-comments"', 'ul class="responses"'],
    "share": ['div class="share"', 'div class="social"', 'ul class="tags"', 'div class="pagination pager"'],
}


def _layout(rng, good: list[list[str]], bad: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A random page of known texts, as vectors and labels.  Texts of one kind
    carry a marker that tells the label and is taken out of the text again."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    mark = lambda s, y: entities.escape(s) + ("\u0001" if y else "\u0002")

    def text(article_like: float) -> str:
        if rng.random() < article_like:
            return pick(pick(good))
        words = pick(bad).split()
        return " ".join(words[: int(rng.integers(1, 9))]) or "x"

    def few() -> str:
        words = pick(pick(good)).split()
        at = int(rng.integers(len(words))) if words else 0
        return " ".join(words[at : at + int(rng.integers(1, 9))]) or "x"

    def opaque(tag: str = "div") -> str:
        name = lambda: f"{chr(97 + int(rng.integers(26)))}{int(rng.integers(100))}"
        return f"{tag} id={name()}" if rng.random() < 0.4 else f'{tag} class="{name()} {name()}"' if rng.random() < 0.6 else tag

    bare = rng.random() < 0.15  # a page whose names say nothing

    def wrapped(kind: str) -> str:
        opening = pick(OTHER_WRAPS[kind])
        if bare and kind in ("menu", "share", "header", "footer"):
            opening = opaque()
        tag = opening.split()[0]
        n = int(rng.integers(1, 5))
        if kind in ("menu", "share") or kind in ("side", "footer") and rng.random() < 0.5:
            items = [f'<a href="#">{mark(text(0.02), 0)}</a>' for _ in range(n + 1)]
            body = "".join(f"<li>{a}</li>" for a in items)
            body = body if tag == "ul" else f"<ul>{body}</ul>" if rng.random() < 0.8 else "<br>".join(items)
        elif kind == "form":
            body = "".join(f"<label>{mark(text(0), 0)}</label><input><p>{mark(text(0.1), 0)}" for _ in range(n)) + f"<button>{mark('ok', 0)}</button>"
        elif kind == "comments":
            item = "li" if tag in ("ol", "ul") else pick(["div", "p", 'div class="comment"', 'div class="comment-body"'])
            body = ("" if rng.random() < 0.5 else f"<h3>{mark(text(0), 0)}</h3>") + "".join(
                f"<{item}>" + (f"<p>{mark(text(0.6), 0)}</p>" if rng.random() < 0.5 else mark(text(0.6), 0)) + f"</{item.split()[0]}>" for _ in range(n))
        else:
            many = n if rng.random() < 0.5 else 1
            body = "".join((f"<p>{mark(text(0.35), 0)}</p>" if rng.random() < 0.6 else f"<div>{mark(text(0.35), 0)}</div>") for _ in range(many)) if rng.random() < 0.7 else mark(text(0.35), 0)
            if rng.random() < 0.3:
                body = f"<h3>{mark(text(0), 0)}</h3>" + body
        return f"<{opening}>{body}</{tag}>"

    def short() -> str:
        """Lists, tables, code, captions and headings of few words each."""
        part = lambda tag, n: "".join(f"<{tag}>{mark(few(), 1)}</{tag}>" for _ in range(n))
        n, r = int(rng.integers(1, 7)), rng.random()
        if r < 0.35:
            tag = pick(["ul", "ul", "ol"])
            return f"<{tag}>{part('li', n)}</{tag}>"
        if r < 0.55:
            width = int(rng.integers(1, 5))
            return "<table>" + "".join(f"<tr>{part('th' if i == 0 and width > 1 else 'td', width)}</tr>" for i in range(n)) + "</table>"
        if r < 0.7:
            return f"<pre><code>{mark(few(), 1)}</code></pre>" if rng.random() < 0.6 else f"<pre>{mark(few(), 1)}</pre>"
        return f"<figure><img>{part('figcaption', 1)}</figure>" if r < 0.85 else part("h3", 1)

    def article() -> str:
        out = []
        texts = [t for _ in range(int(rng.integers(1, 3))) for t in pick(good)][: int(rng.integers(1, 14))]
        if rng.random() < 0.8:
            h = f"<h1>{mark(text(0.1), 1)}</h1>"
            out.append(f"<header>{h}</header>" if rng.random() < 0.1 else h)
        for t in texts:
            r = rng.random()
            t = mark(t, 1)
            out.append(f"<p>{t}</p>" if r < 0.6 else f"<p>{t}" if r < 0.7 else f"<p><b>{t}<br>" if r < 0.75 else f"<h2>{t}</h2>" if r < 0.82
                       else f"<ul><li>{t}</li></ul>" if r < 0.88 else f"<blockquote><p>{t}</p></blockquote>" if r < 0.92 else f"<div>{t}</div>" if r < 0.96
                       else f"<table><tr><td>{t}</td></tr></table>")
            if rng.random() < 0.2:
                out.append(short())
            if rng.random() < 0.06:
                out.append(wrapped(pick(["ad", "side", "notice", "share", "form", "comments"])))
        while rng.random() < 0.25:
            out.append(short())
        if rng.random() < 0.12:
            out.append(wrapped("comments"))
        a, b = (f"<{opaque()}>", "</div>") if bare else pick(ARTICLE_WRAPS)
        return a + "".join(out) + b

    kinds = list(OTHER_WRAPS)
    before = [wrapped(k) for k in kinds if rng.random() < (0.6 if k in ("menu", "header") else 0.22)]
    after = [wrapped(k) for k in kinds if rng.random() < (0.6 if k == "footer" else 0.25)]
    body = [*before, article(), *after]
    if rng.random() < 0.4:
        wrap = pick(["div", 'div class="container"', 'div id="page"', 'div class="wrapper"', 'div class="row"', "section"])
        body = [f"<{wrap}>", *body, f"</{wrap.split()[0]}>"]
    blocks = leaf_blocks("<html><body>" + "".join(body) + "</body></html>")
    y = np.array(["\u0001" in b.text for b in blocks], float)
    for b in blocks:
        b.text = " ".join(b.text.replace("\u0001", " ").replace("\u0002", " ").split()) or "x"
    return vectors(blocks), y


_SURE_GOOD, _SURE_BAD = {"<article>", "<main>"}, {"<nav>", "<footer>", "<aside>", "<form>"}


def _known_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a page's blocks that its mark-up names article or not."""
    for b in batches:
        good, bad = [], []
        for page in b.column(0):
            blocks = [(set(x.path), x.text) for x in leaf_blocks(page.as_py())]
            bad.append([t[:BAD_CHARS] for names, t in blocks if names & _SURE_BAD][:BLOCKS])
            good.append([t[:GOOD_CHARS] for names, t in blocks if names & _SURE_GOOD and not names & _SURE_BAD][:BLOCKS])
        kind = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(good, kind), pa.array(bad, kind)], names=["good", "bad"])


def train(pages: DataFrame, sample: int = SAMPLE) -> BiLstm:
    """The network, fitted on layouts of texts from at most `sample` pages."""
    drawn = drawn_contents(pages.where("html is not null").select(F.col("html").cast("string").alias("html")), ["html"], sample, 3).select("html")
    found = sorted((r.good, r.bad) for r in drawn.mapInArrow(_known_blocks, "good array<string>, bad array<string>").collect())
    good = [g for g, _ in found if g]
    bad = [x for _, b in found for x in b]
    filler = ["A short line", "Plain words in a row, and a few more of them, end here."]
    good, bad = good or [filler], bad or filler
    rng = np.random.default_rng(1)
    net = BiLstm()
    net.fit([p for p in (_layout(rng, good, bad) for _ in range(LAYOUTS)) if len(p[0])])
    return net


def labels(net: BiLstm, pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
    """Of each page, which blocks are article; pages of like length together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        n = max(1, cells // len(pages[order[-1]]))
        some, order = order[-n:], order[:-n]
        xs = [vectors(pages[i]) for i in some]
        x, mask, _ = padded([(a, np.zeros(len(a))) for a in xs])
        z, _ = net.logits(x.astype(np.float32), mask.astype(np.float32))
        for j, i in enumerate(some):
            out[i] = z[: len(xs[j]), j] > 0
    return out


def extract(pages: DataFrame, net: BiLstm) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page."""
    small = BiLstm()
    small.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    known = pages.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                found = [leaf_blocks(h) for h in b.column(2).to_pylist()]
                texts = ["\n\n".join(x.text for x, y in zip(p, m) if y) for p, m in zip(found, labels(known.value, found))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array([len(p) for p in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
