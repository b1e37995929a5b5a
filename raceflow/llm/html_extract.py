"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (runs of text between block-level tags). Each block
is described by its tag path (tags with their class, id and role words) and by hashed
word vectors and a few sizes; a bidirectional LSTM in numpy reads the whole page's
sequence of blocks forwards and backwards and labels every block as main text or not.
Pages are batched and sorted by length, so a step of the recurrence handles the pages
that still have blocks; nothing is cut off, whatever the page's length.

The weights come from train(), which fits generated pages (a few hundred, a documented
parameter) and is deterministic; they are stored beside this module.

A null or empty page, or one without main text, gives an empty string and n_chars 0. A
page without any recognised element is one block. Rows repeat as they come; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from raceflow.llm import common as C

WEIGHTS = Path(__file__).with_name("html_weights.npz")
#: Hashed dimensions of path tokens and of words, sizes of a block, and units in each direction.
PATH_DIM, WORD_DIM, SIZES, UNITS = 256, 32, 6, 16

#: Elements whose content is no text of the page.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "object", "title")
#: What a head may hold: elements with content of their own (below RAW otherwise), and tags without. Anything else begins the body, also without </head>.
HEAD = ("title", "script", "style", "noscript", "template")
HEAD_TAGS = ("base", "basefont", "bgsound", "link", "meta", "head")
#: Elements that stand inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of these kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
} | {t: ("p",) for t in "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer form blockquote pre figure main hr address fieldset details".split()}
_WALLS = frozenset("table ul ol dl div section article aside nav header footer main form body html blockquote select details figure td th li dd".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<head>head)\b[^>]*>(?:\s|<!--.*?(?:-->|\Z)|<(?P<held>{'|'.join(HEAD)})\b[^>]*>.*?(?:</(?P=held)\s*>|\Z)|<(?:{'|'.join(HEAD_TAGS)})\b[^>]*>)*(?:</head\s*>)?"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*+>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[^a-zA-Z]+")


def _tokens(name: str, attrs: str) -> tuple[str, ...]:
    """Path tokens of an opening tag: its name, and each word of its class, id and role."""
    if not attrs or "=" not in attrs:
        return (name,)
    words = [w.lower() for m in _ATTR.finditer(attrs) for w in _PARTS.split(m[1] or m[2] or m[3] or "") if w]
    return (name, *(f".{w}" for w in words))


class Block:
    __slots__ = ("path", "text", "linked", "tag")

    def __init__(self, path: tuple, text: str, linked: int, tag: str):
        self.path, self.text, self.linked, self.tag = path, text, linked, tag


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: path tokens, text with single spaces, characters in links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    where: tuple | None = None
    linked = links = 0

    def flush() -> None:
        nonlocal where, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(where or (), text, min(linked, len(text)), where[-1][0] if where else ""))
            parts.clear()
        where, linked = None, 0

    def add(text: str) -> None:
        nonlocal where, linked
        if where is None and not text.isspace():
            where = tuple(t for _, t in stack)
        if links:
            linked += len(text)
        parts.append(text)

    def pop(kinds: tuple[str, ...] | frozenset, walls: frozenset) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                links -= sum(n == "a" for n, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["head"] or m["raw"]:
                flush()
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name not in INLINE:
                flush()
            pop((name,), frozenset() if name not in INLINE else _WALLS)
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES:
                pop(CLOSES[name], _WALLS - {*CLOSES[name]})
        if name not in VOID:
            if name == "a":
                links += 1
            stack.append((name, _tokens(name, m["attrs"] or "")))
    if at < len(page):
        add(page[at:])
    flush()
    return out


# --- features -------------------------------------------------------------------------------------


def path_vector(path: tuple) -> np.ndarray:
    """Hashed counts of the path's tokens, of its last element and of its pairs of neighbours."""
    out = np.zeros(PATH_DIM, dtype=np.float32)
    put = lambda s, w: out.__setitem__(i := zlib.crc32(s.encode()) % PATH_DIM, out[i] + w)
    for level in path:
        for t in level:
            put(t, 1.0)
    if path:
        put("last:" + path[-1][0], 1.0)
    return np.minimum(out, 2.0)


def features(page: list[Block]) -> tuple[np.ndarray, list[tuple]]:
    """Word vectors and sizes of each block (n, WORD_DIM + SIZES), and its path."""
    n = len(page)
    lists = [b.text.lower().encode().split() for b in page]
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    hashes = np.fromiter((zlib.crc32(w) for x in lists for w in x), dtype=np.uint32, count=int(lengths.sum()))
    at = np.repeat(np.arange(n, dtype=np.int64), lengths) * WORD_DIM + hashes % WORD_DIM
    words = np.bincount(at, minlength=n * WORD_DIM).reshape(n, WORD_DIM) / np.maximum(np.sqrt(lengths), 1)[:, None]
    chars = np.array([len(b.text) for b in page])
    place = (np.arange(n) + 0.5) / max(n, 1)
    sizes = np.stack(
        [np.log1p(chars) / 8, np.log1p(lengths) / 6, np.array([b.linked for b in page]) / np.maximum(chars, 1), place, np.array([b.text[-1] in ".!?…\"'" for b in page]), np.log1p(n) * np.ones(n) / 6], axis=1
    )
    return np.concatenate([words, sizes], axis=1).astype(np.float32), [b.path for b in page]


# --- the network ----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[f"p{d}"] = rng.normal(0, 0.15, (PATH_DIM, 4 * UNITS))
        w[f"x{d}"] = rng.normal(0, 0.15, (WORD_DIM + SIZES, 4 * UNITS))
        w[f"h{d}"] = rng.normal(0, 0.25, (UNITS, 4 * UNITS))
        w[f"c{d}"] = np.r_[np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)]
    w["o"], w["oc"] = rng.normal(0, 0.3, (2 * UNITS, 1)), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _steps(z: np.ndarray, lengths: np.ndarray, hidden: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, pages, UNITS) of one direction; pages are in order of falling length, z has the inputs' share of the gates."""
    steps, pages = z.shape[:2]
    out = np.zeros((steps, pages, UNITS), dtype=np.float32)
    h, c = np.zeros((pages, UNITS), np.float32), np.zeros((pages, UNITS), np.float32)
    for t in range(steps):
        k = int(np.searchsorted(-lengths, -t, side="left"))  # pages with more than t blocks
        a = z[t, :k] + h[:k] @ hidden
        i, f, o, g = _sigmoid(a[:, :UNITS]), _sigmoid(a[:, UNITS : 2 * UNITS]), _sigmoid(a[:, 2 * UNITS : 3 * UNITS]), np.tanh(a[:, 3 * UNITS :])
        if keep is not None:
            keep.append((k, i, f, o, g, c[:k].copy(), h[:k].copy()))
        c[:k] = f * c[:k] + i * g
        h[:k] = o * np.tanh(c[:k])
        out[t, :k] = h[:k]
    return out


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray], threshold: float = 0.5):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.cut = float(np.log(threshold / (1 - threshold)))
        self.paths: dict[tuple, np.ndarray] = {}

    def _path(self, path: tuple) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = path_vector(path)
            self.paths[path] = got = np.concatenate([v @ self.w["pf"] + self.w["cf"], v @ self.w["pb"] + self.w["cb"]])
        return got

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each block is main text."""
        out = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        start = 0
        while start < len(order):  # groups of pages of like length, and a bounded number of padded blocks
            most = len(pages[order[start]])
            stop = start + 1
            while stop < len(order) and (stop - start + 1) * most <= 60_000 and 4 * len(pages[order[stop]]) >= most:
                stop += 1
            for i, x in zip(order[start:stop], self._group([pages[i] for i in order[start:stop]])):
                out[i] = x
            start = stop
        return out

    def _group(self, pages: list[list[Block]]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        zf = np.zeros((lengths[0], len(pages), 4 * UNITS), np.float32)
        zb = np.zeros_like(zf)
        x = [features(p) for p in pages]
        both = np.concatenate([a for a, _ in x]) @ np.concatenate([self.w["xf"], self.w["xb"]], axis=1)
        both += np.stack([self._path(p) for _, paths in x for p in paths])
        at = 0
        for k, n in enumerate(lengths):
            zf[:n, k], zb[:n, k] = both[at : at + n, : 4 * UNITS], both[at : at + n, 4 * UNITS :][::-1]
            at += n
        f, b = _steps(zf, lengths, self.w["hf"]), _steps(zb, lengths, self.w["hb"])
        o = self.w["o"][:, 0]
        return [(f[:n, k] @ o[:UNITS] + b[:n, k][::-1] @ o[UNITS:] + self.w["oc"][0]) > self.cut for k, n in enumerate(lengths)]


def extracted(page: list[Block], main: np.ndarray) -> str:
    return "\n".join(b.text for b, keep in zip(page, main) if keep)


# --- training -------------------------------------------------------------------------------------

_MARK = ""


def generated(rng: np.random.Generator) -> str:
    """A page of random words; the blocks of its main text begin with a mark."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    syllables = [c + v for c in "b d f g l m n r s t th sh".split() for v in "a e i o u an en er ou".split()]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda lo, hi: " ".join(word() for _ in range(int(rng.integers(lo, hi))))
    stop = lambda: pick(".", ".", ".", "", "!", "?", " |", "&amp;")
    some = lambda p: rng.random() < p
    attr = lambda *xs: f' {pick("class", "class", "id")}="{pick(*xs)}"'

    def block(main: bool, text: str) -> str:
        return (_MARK if main else "") + text

    def ad(tag: str = "div") -> str:
        t = pick(tag, "div", "aside", "section", "ins")
        return f"<{t}{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'adbox')}>{pick('', '<p>', '<span>')}{words(1, 14).capitalize()}{stop()}</{t}>"

    def menu(tag: str) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(int(rng.integers(2, 9))))
        return f"<{tag}><ul>{items}</ul></{tag}>" if tag == "nav" else f"<{tag}{attr('menu', 'nav', 'navbar', 'main-menu', 'breadcrumb', 'breadcrumbs', 'topnav', 'navigation', 'toc')}><ul>{items}</ul></{tag}>"

    def notice() -> str:
        t = pick("div", "div", "section", "p", "aside")
        text = pick("We use cookies on this site.", "Accept all cookies", "Subscribe to our newsletter", "Sign in to continue", words(2, 15).capitalize() + ".")
        return f"<{t}{attr('cookie', 'cookie-banner', 'notice', 'alert', 'consent', 'gdpr', 'newsletter', 'popup', 'modal', 'message', 'subscribe', 'warning')}>{pick('', '<p>')}{text}{pick('', '<button>OK</button>')}</{t}>"

    def sidebar() -> str:
        t = pick("aside", "aside", "div", "section")
        a = "" if t == "aside" and some(0.5) else attr("sidebar", "side", "related", "widget", "recommended", "more", "popular", "trending", "share", "social", "tags")
        body = "".join(pick(f"<p>{words(2, 18).capitalize()}{stop()}</p>", f'<p><a href="/{word()}">{words(2, 8)}</a></p>', f"<h3>{words(1, 3)}</h3>", f'<ul><li><a href="#">{words(1, 5)}</a></li></ul>') for _ in range(int(rng.integers(1, 5))))
        return f"<{t}{a}>{body if some(0.8) else words(2, 12)}</{t}>"

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 3)}</label><input name="q">{pick("", f"<p>{words(2, 9)}</p>", f"<select><option>{word()}<option>{word()}</select>")}<button>{words(1, 2)}</button></form>'

    def comments() -> str:
        t = pick("section", "div", "ol", "aside")
        inner = pick("div", "p", "li", "article")
        body = "".join(f"<{inner}{pick('', attr('comment', 'reply', 'comment-body'))}>{pick('', '<p>')}{words(2, 30).capitalize()}{stop()}</{inner}>" for _ in range(int(rng.integers(1, 6))))
        return f"<{t}{attr('comments', 'comment-list', 'discussion', 'responses', 'reader-comments', 'replies', 'disqus')}>{pick('', f'<h2>{words(1, 3)}</h2>')}{body}</{t}>"

    def paragraph() -> str:
        text = words(1, 70).capitalize() + stop()
        if some(0.2):
            text += f' <a href="/{word()}">{words(1, 3)}</a> {words(1, 20)}{stop()}'
        if some(0.15):
            text = f"{pick('<b>', '<em>', '<i>')}{text}"
            return f"<p>{block(True, text)}<br>" if some(0.5) else f"<p>{block(True, text)}</p>"
        kind = rng.random()
        if kind < 0.05:
            return f"<blockquote>{pick('', '<p>')}{block(True, text)}</blockquote>"
        if kind < 0.11:
            t = pick("ul", "ol")
            return f"<{t}>" + "".join(f"<li>{block(True, words(1, 15))}{stop()}</li>" for _ in range(int(rng.integers(1, 6)))) + f"</{t}>"
        if kind < 0.16:
            return f"<{(h := pick('h2', 'h3', 'h4'))}>{block(True, words(1, 6))}</{h}>"
        if kind < 0.19:
            return f"<pre>{block(True, text)}</pre>"
        if kind < 0.22:
            return "<table>" + "".join(f"<tr><td>{block(True, word())}</td><td>{block(True, words(1, 4))}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>"
        if kind < 0.24:
            return f"<figure><img src='x.png'><figcaption>{block(True, text)}</figcaption></figure>"
        if kind < 0.28:
            return f"<div>{block(True, text)}</div>"
        return f"<p>{block(True, text)}" + pick("</p>", "</p>", "</p>", "")

    inside = [paragraph() for _ in range(int(rng.integers(1, 4) if some(0.3) else rng.integers(2, 25)))]
    if some(0.2):  # long runs of short or repeated paragraphs are main text too
        few = [words(1, 5).capitalize() + stop() for _ in range(int(rng.integers(1, 4)))]
        line = lambda: block(True, pick(*few) if some(0.8) else words(1, 4).capitalize() + stop())
        at = int(rng.integers(len(inside) + 1))
        inside[at:at] = [f"<p><b>{line()}<br>" if some(0.3) else f"<p>{line()}</p>" for _ in range(int(rng.integers(3, 110)))]
    for extra, p in ((ad, 0.25), (comments, 0.12), (sidebar, 0.1), (notice, 0.08), (form, 0.06), (lambda: menu(pick("nav", "div")), 0.06)):
        if some(p):
            inside.insert(int(rng.integers(len(inside) + 1)), extra())
    title = f"<h1>{block(True, words(1, 9).capitalize())}</h1>"
    title = f"<header>{title}</header>" if some(0.08) else title if some(0.9) else ""
    t = pick("article", "article", "article", "article", "main", "div", "section")
    a = "" if t in ("article", "main") and some(0.7) else attr("content", "post", "article", "entry", "main", "article-body", "entry-content", "story", "text", "body-text", "post-content", "main-content")
    main = f"<{t}{a}>{title}{''.join(inside)}</{t}>"
    if t == "article" and some(0.2):
        main = f"<main>{main}</main>"
    head = [pick(menu("nav"), menu("div"), menu("nav"))] if some(0.9) else []
    if some(0.35):
        head.insert(0, f"<header{pick('', attr('header', 'site-header', 'masthead', 'top'))}>{pick(f'<h1>{words(1, 4)}</h1>', f'<a href=/>{words(1, 3)}</a>', f'<p>{words(1, 8)}</p>')}{menu('nav') if some(0.5) else ''}</header>")
    for extra, p in ((ad, 0.5), (notice, 0.3), (sidebar, 0.2), (form, 0.15)):
        if some(p):
            head.insert(int(rng.integers(len(head) + 1)), extra())
    tail = []
    for extra, p in ((sidebar, 0.35), (comments, 0.35), (ad, 0.25), (form, 0.2), (notice, 0.2)):
        if some(p):
            tail.insert(int(rng.integers(len(tail) + 1)), extra())
    if some(0.9):
        ft = pick("footer", "footer", "footer", "div")
        tail.append(f"<{ft}{attr('footer', 'site-footer', 'bottom', 'copyright', 'legal') if ft == 'div' or some(0.2) else ''}>{pick('', '<p>')}{pick('&copy; ', '', 'Copyright 2020 ')}{words(1, 12)}{stop()}{pick('', menu('nav'))}</{ft}>")
    wrap = (f'<div{attr("page", "wrapper", "container", "row")}>', "</div>") if some(0.3) else ("", "")
    return f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{wrap[0]}{"".join(head)}{main}{"".join(tail)}{wrap[1]}</body></html>'


def labelled(rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    page = blocks(generated(rng))
    main = np.array([_MARK in b.text for b in page])
    for b in page:
        b.text = b.text.replace(_MARK, "") or "x"
    return page, main


def train(pages: int = 4000, epochs: int = 12, seed: int = 7, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on generated pages."""
    rng = np.random.default_rng(seed)
    data = [(p, y) for p, y in (labelled(rng) for _ in range(pages)) if p]
    rows = [(features(p)[0], np.stack([path_vector(b.path) for b in p]), y.astype(np.float32)) for p, y in data]
    w = fresh(rng)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 32):
            batch = sorted((rows[i] for i in order[s : s + 32]), key=lambda r: -len(r[2]))
            grads = _gradients(w, batch)
            step += 1
            lr = rate * (0.5 ** (epoch / 4))
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k[0] == "p":
                    w[k] *= 1 - 1e-4
    return {k: x.astype(np.float16) for k, x in w.items()}


def _gradients(w: dict[str, np.ndarray], batch: list) -> dict[str, np.ndarray]:
    lengths = np.array([len(y) for *_, y in batch])
    steps, pages = int(lengths[0]), len(batch)
    state, kept, inputs = {}, {}, {}
    for d in ("f", "b"):
        x, p = np.zeros((steps, pages, WORD_DIM + SIZES), np.float32), np.zeros((steps, pages, PATH_DIM), np.float32)
        for k, (a, b, _) in enumerate(batch):
            n = lengths[k]
            x[:n, k], p[:n, k] = (a, b) if d == "f" else (a[::-1], b[::-1])
        inputs[d] = (x, p)
        kept[d] = []
        state[d] = _steps(x @ w[f"x{d}"] + p @ w[f"p{d}"] + w[f"c{d}"], lengths, w[f"h{d}"], kept[d])
    g = {k: np.zeros_like(x) for k, x in w.items()}
    dh = {d: np.zeros((steps, pages, UNITS), np.float32) for d in ("f", "b")}
    total = float(lengths.sum())
    for k, (*_, y) in enumerate(batch):
        n = lengths[k]
        both = np.concatenate([state["f"][:n, k], state["b"][:n, k][::-1]], axis=1)
        e = (_sigmoid(both @ w["o"] + w["oc"])[:, 0] - y) / total
        g["o"] += both.T @ e[:, None]
        g["oc"] += e.sum()
        back = e[:, None] @ w["o"].T
        dh["f"][:n, k], dh["b"][:n, k] = back[:, :UNITS], back[:, UNITS:][::-1]
    for d in ("f", "b"):
        hn, cn = np.zeros((pages, UNITS), np.float32), np.zeros((pages, UNITS), np.float32)
        x, p = inputs[d]
        for t in range(steps - 1, -1, -1):
            k, i, f, o, a, c0, h0 = kept[d][t]
            c1 = np.tanh(f * c0 + i * a)
            h = dh[d][t, :k] + hn[:k]
            dc = cn[:k] + h * o * (1 - c1 * c1)
            dz = np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), h * c1 * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            g[f"x{d}"] += x[t, :k].T @ dz
            g[f"p{d}"] += p[t, :k].T @ dz
            g[f"h{d}"] += h0.T @ dz
            g[f"c{d}"] += dz.sum(axis=0)
            hn[:k], cn[:k] = dz @ w[f"h{d}"].T, dc * f
    return g


# --- the operator ---------------------------------------------------------------------------------


def main_text(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    weights = weights or dict(np.load(WEIGHTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(weights)
        for b in C.slices(batches, "html"):
            found = [blocks(x.decode("utf-8", "replace")) for x in C.texts(b.column("html"))]
            text = [extracted(p, y) for p, y in zip(found, labeller.label(found))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return C.only(pages, "page_id", "url", "html").mapInArrow(C.tidy(run), "page_id long, url string, text string, n_chars long")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.read(spark, sf_dir, "pages"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train())
