"""Main-text extraction by a recurrent block labeller.

A page is parsed into leaf blocks in page order.  Each block has a tag-path
vector (hashed tags, classes and ids on the way to it), a hashed-word vector and
a few measures of shape.  A bidirectional LSTM in numpy reads the blocks of the
whole page and labels each as main text or not.  It is trained here on pages
drawn from a seeded generator of site layouts; no labels are needed.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, EXTRA = 192, 64, 8
HIDDEN, DENSE_DIM = 16, PATH_DIM + WORD_DIM + EXTRA
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1500, 8, 30, 7
# Elements of HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
SILENT = frozenset("script style noscript template svg head title iframe textarea datalist".split())
RAW = frozenset("script style textarea title iframe".split())  # what follows the tag is no markup up to the end tag
NESTED = frozenset("template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body html optgroup option caption tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
_MARK = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*)(?=>)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
# White space as Unicode lists it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE = re.compile(f"[{WHITE}]+")


class Block:
    __slots__ = ("path", "depth", "marked", "text", "linked", "tag")

    def __init__(self, path, depth, marked, tag):
        self.path, self.depth, self.marked, self.tag, self.text, self.linked = path, depth, marked, tag, [], 0


class Stack:
    """Open elements, with what is asked of them kept up to date, so that depth costs nothing."""

    def __init__(self):
        self.tags, self.tokens, self.blocks = [], [], []
        self.places: dict[str, list[int]] = {}
        self.path: dict[int, int] = {}  # hash bucket of a token -> how many there are
        self.depth, self.marked, self.links = 0, 0, 0

    def push(self, tag: str, tokens: list[str]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.tokens.append(tokens)
        self._count(tokens, 1)
        self.links += tag == "a"

    def _count(self, tokens: list[str], k: int) -> None:
        for token in tokens:
            bucket = _path_bucket(token)
            self.path[bucket] = held = self.path.get(bucket, 0) + k
            if not held:
                del self.path[bucket]
            self.marked += k * (token == ".mainmark")
        self.depth += k * len(tokens)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def outer(self, place: int) -> bool:
        """Whether a block is open inside the element at ``place``."""
        return bool(self.blocks) and self.blocks[-1] > place

    def close(self, place: int) -> bool:
        """Close all elements from ``place`` on; whether a block was among them."""
        had = bool(self.blocks) and self.blocks[-1] >= place
        while len(self.tags) > place:
            tag = self.tags.pop()
            self._count(self.tokens.pop(), -1)
            if tag:
                self.places[tag].pop()
                self.links -= tag == "a"
            if tag in BLOCKS:
                self.blocks.pop()
        return had

    def forget(self, place: int) -> None:
        """Take the end tag of the innermost element of its name, an inline one that blocks were opened in; its tokens stay until those close."""
        tag, self.tags[place] = self.tags[place], ""
        self.places[tag].pop()
        self.links -= tag == "a"


def _after_tag(page: str, at: int) -> tuple[int, str] | None:
    """(place after the tag whose name ends at ``at``, its attributes); a quote that hides the end is an ordinary character."""
    m = _ATTRIBUTES.match(page, at)
    end = m.end() if m else page.find(">", at)
    return None if end < 0 else (end + 1, page[at:end])


def parse_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order; character references are decoded and white space is folded.

    Of a silent element without an end tag only the tag is skipped (so an open
    head ends at what can't be in it); a script, style, textarea, title or
    iframe without one takes the rest of the page.  Formulas and what stands in
    for an object, a sound or a picture are text.  A tag without an end is text.
    The time is linear in the page.
    """
    blocks, stack, block, at = [], Stack(), None, 0
    unclosed, open_head = set(), False

    def say(raw):
        nonlocal block
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if block is None:
            if not text.strip(WHITE):
                return
            block = Block(list(stack.path), stack.depth, stack.marked > 0, stack.tags[stack.blocks[-1]] if stack.blocks else "body")
            blocks.append(block)
        block.text.append(text)
        if stack.links > 0:
            block.linked += len(text)

    def close(place):
        nonlocal block
        if stack.close(place):
            block = None

    while True:
        m = _MARK.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(mark, at)
            at = len(page) if end < 0 else end + len(mark)
            continue
        if (tail := _after_tag(page, at)) is None:  # no tag ends from here on
            say(page[m.start() :])
            break
        at, attributes = tail
        name = m[2].lower()
        if m[1]:
            place = stack.last(name)
            if place >= 0 and (name in BLOCKS or not stack.outer(place)):
                close(place)
            elif place >= 0:
                stack.forget(place)
            continue
        if name == "br":
            say(" ")
            continue
        if name in SILENT:
            if not attributes.rstrip().endswith("/"):
                end = None if name in unclosed else _end_of(name).search(page, at)
                if end is None:
                    unclosed.add(name)  # there is no end tag from here on
                if name == "head":
                    open_head = end is None
                elif end and name not in RAW | NESTED and _start_of(name).search(page, at, end.start()):
                    end = None  # that tag ends a later element
                elif end is None and name in RAW and open_head:
                    end = _BODY.search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(page)
            continue
        if name in VOID:
            if name == "hr":
                block = None
            continue
        open_head = False
        if name in CLOSES_P and (p := stack.last("p")) >= 0 and not stack.outer(p):
            close(p)
        if name in SIBLINGS and (place := stack.last(*SIBLINGS[name])) > stack.last(*SCOPES[name]):
            close(place)
        if name in BLOCKS:
            block = None
        tokens = [name]
        if attributes:
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                if k.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    tokens += [f".{w}" for w in _SPLIT.split((a or b or c).lower()) if w]
                elif k.lower() == "hidden" or (k.lower() == "style" and "display:none" in (a or b).replace(" ", "")):
                    tokens.append(".hidden")
        stack.push(name, tokens)
    out = []
    for b in blocks:
        b.text = _SPACE.sub(" ", "".join(b.text)).strip(" ")
        if b.text:
            out.append(b)
    return out


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


@lru_cache(maxsize=64)
def _start_of(name: str) -> re.Pattern:
    return re.compile(rf"<{re.escape(name)}\b", re.I)


_BODY = re.compile(r"(?=<body\b)", re.I)


@lru_cache(maxsize=100_000)
def _path_bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_DIM


@lru_cache(maxsize=200_000)
def _word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_DIM


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, DENSE_DIM): tag path, all words, shape."""
    x = np.zeros((len(blocks), DENSE_DIM), np.float32)
    for i, b in enumerate(blocks):
        x[i, b.path] = 1.0
        x[i, _path_bucket(f"leaf:{b.tag}")] = 1.0
        words = b.text.lower().split(" ")
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(list(map(_word_bucket, words)), minlength=WORD_DIM)
        n, chars = len(words), len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 4, min(2.0, 10 * marks / max(1, chars)), b.linked / max(1, chars), b.text[-1] in ".!?", i / max(1, len(blocks) - 1), np.log1p(len(blocks)) / 5, min(b.depth, 100) / 10, b.text[:1] in "©@|»#")
    words = x[:, PATH_DIM : PATH_DIM + WORD_DIM]
    words /= np.maximum(1.0, words.sum(1, keepdims=True)) / 2
    return x


# -- the network ---------------------------------------------------------------------------------


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def new_weights(rng) -> dict[str, np.ndarray]:
    w = {}
    for side in ("f", "b"):
        w[f"{side}x"] = rng.normal(0, 0.15, (DENSE_DIM, 4 * HIDDEN))
        w[f"{side}h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        w[f"{side}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["o"], w["p"], w["c"] = rng.normal(0, 0.2, (2 * HIDDEN, 1)), rng.normal(0, 0.05, (DENSE_DIM, 1)), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w, side, x, mask, keep):
    """One direction over (pages, steps, DENSE_DIM); hidden states and, with ``keep``, what the backward pass needs."""
    pages, steps = mask.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    given = x @ w[f"{side}x"] + w[f"{side}c"]
    out, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = given[:, t] + h @ w[f"{side}h"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        on = mask[:, t : t + 1]
        c2 = (f * c + i * g) * on + c * (1 - on)
        s = np.tanh(c2)
        h2 = o * s * on + h * (1 - on)
        if keep:
            tape.append((t, i, f, o, g, c, s, h, on))
        h, c = h2, c2
        out[:, t] = h
    return out, tape


def logits(w, x, mask, keep=False):
    hf, tf = _run(w, "f", x, mask, keep)
    hb, tb = _run(w, "b", x, mask, keep)
    h = np.concatenate([hf, hb], axis=2)
    return (h @ w["o"] + x @ w["p"])[..., 0] + w["c"], h, tf, tb


def gradients(w, x, mask, y):
    z, h, tf, tb = logits(w, x, mask, keep=True)
    d = (_sigmoid(z) - y) * mask / mask.sum()
    g = {"o": np.einsum("pth,pt->h", h, d)[:, None], "p": np.einsum("ptd,pt->d", x, d)[:, None], "c": np.array([d.sum()])}
    into = d[..., None] * w["o"][:, 0]
    for side, tape, dh_out in (("f", tf, into[..., :HIDDEN]), ("b", tb, into[..., HIDDEN:])):
        dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
        gh = np.zeros_like(w[f"{side}h"])
        dh, dc = np.zeros((len(mask), HIDDEN), np.float32), np.zeros((len(mask), HIDDEN), np.float32)
        for t, i, f, o, gg, c, s, h0, on in reversed(tape):
            dh = dh + dh_out[:, t]
            dc2 = (dc + dh * o * (1 - s * s)) * on
            dz = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), dh * s * on * o * (1 - o), dc2 * i * (1 - gg * gg)], axis=1)
            dz_all[:, t] = dz
            gh += h0.T @ dz
            dc = dc2 * f + dc * (1 - on)
            dh = dz @ w[f"{side}h"].T + dh * (1 - on)
        g[f"{side}x"] = np.einsum("ptd,ptk->dk", x, dz_all, optimize=True)
        g[f"{side}h"], g[f"{side}c"] = gh, dz_all.sum((0, 1))
    loss = -(mask * np.log(np.where(y > 0, _sigmoid(z), 1 - _sigmoid(z)) + 1e-9)).sum() / mask.sum()
    return g, float(loss)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, DENSE_DIM), np.float32), np.zeros((len(pages), steps), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1.0
    return x, mask


# -- generated training pages ----------------------------------------------------------------------


class Layouts:
    """Seeded pages of invented words in many layouts: (html, set of main block texts is told by markers).

    Main blocks carry an attribute ``data-main`` that the parser ignores, so the
    marker can't be learned; ``labelled`` reads it from a second parse.
    """

    SYLLABLES = "an be ci do en fa ge hi in jo ka le mi no or pa qu re si ta un ve wi xo ya ze th sch ch ion ing er ät ó ê eux ung ado".split()
    #: Names that sites give to what isn't main text, and to what is.
    OTHER = {
        "menu": "nav menu navbar navigation main-menu topbar breadcrumb breadcrumbs links site-nav", "header": "header site-header masthead banner top branding logo", "footer": "footer site-footer colophon bottom copyright legal",
        "side": "sidebar aside widget related recommended popular trending rail more-stories right-column tags tag-list", "ad": "ad ads advert advertisement sponsor sponsored promo promoted adbox banner-ad", "notice": "cookie cookie-notice consent gdpr notice alert banner-notice newsletter subscribe popup modal paywall",
        "form": "form search login signup subscribe-form contact-form", "comments": "comments comment-list comment reply replies discussion disqus responses comment-body user-comment", "share": "share social social-share share-buttons follow author-bio byline meta pagination pager",
    }
    MAIN = "content article post entry main story article-body post-content entry-content text body-text main-content"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low=3, high=18):
        style = self.style
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if style == "noisy":
            words = [w + self.r.choice(("###", "***", "&amp;&amp;&amp;", "%%%", "$$$")) for w in words]
        elif style == "loud":
            words = [w.upper() + "!!" for w in words]
        elif style == "bars":
            words = " | ".join(words).split(" ")
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def named(self, kind):
        return self.r.choice((self.OTHER[kind] if kind in self.OTHER else self.MAIN).split())

    def attribute(self, kind):
        return self.r.choice((f' class="{self.named(kind)}"', f' id="{self.named(kind)}"', f' class="{self.named(kind)} {self.word()}"'))

    def list_of_links(self, low, high, text=1):
        items = "".join(f'<li><a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 2 * text)))}</a></li>' for _ in range(self.r.randint(low, high)))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("<li>", "").replace("</li>", " ")

    def other(self, kind):
        r, tag = self.r, {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        open_tag = f"<{tag}{self.attribute(kind) if r.random() < 0.5 else ''}>" if tag != "div" and r.random() < 0.65 else f"<{(tag := r.choice(('div', 'div', 'section')))}{self.attribute(kind)}>"
        if kind == "menu":
            body = self.list_of_links(3, 9)
        elif kind == "header":
            body = r.choice((f"<div>{self.word()}</div>", f'<a href="/">{self.word()}</a><p>{self.sentence(2, 6)}</p>', f"<h1>{self.word()} {self.word()}</h1>", self.sentence(2, 8)))
        elif kind == "footer":
            body = r.choice((f"&copy; {self.word()}.example.com", f"<p>&copy; 20{r.randint(10, 25)} {self.word()}. {self.sentence(2, 8)}</p>", self.list_of_links(2, 5), f"<p>{self.sentence()}</p>"))
        elif kind == "side":
            body = f"<h3>{self.sentence(1, 4)}</h3>" * (r.random() < 0.7) + r.choice((self.list_of_links(2, 7, 3), "".join(f"<p>{self.sentence()}</p>" for _ in range(r.randint(1, 3))), f"<div>{self.sentence()}</div>"))
        elif kind == "form":
            body = f"<label>{self.word()}</label><input name=q><button>{self.word()}</button>" + r.choice(("", f"<p>{self.sentence(2, 9)}</p>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>"))
        elif kind == "comments":
            one = lambda: r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.sentence()}</p></div>', f"<li><p>{self.sentence()} {self.sentence()}</p></li>", f"<p>{self.sentence()}</p>", f"<article><h4>{self.word()}</h4><p>{self.sentence()}</p></article>"))
            body = f"<h2>{self.sentence(1, 3)}</h2>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6)))
        elif kind == "share":
            body = r.choice((self.list_of_links(2, 5), f"<span>{self.sentence(2, 7)}</span>", f"<p>{self.sentence(2, 9)}</p>"))
        else:
            body = r.choice((self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.sentence()} {self.sentence()}</p><button>{self.word()}</button>", f'<a href="#">{self.sentence(2, 8)}</a>'))
        return f"{open_tag}{body}</{tag}>"

    def article(self):
        r, mark, parts = self.r, " data-main=1", []
        if r.random() < 0.85:
            parts.append(f"<h1{mark}>{self.sentence(2, 9)}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 21, 30))):
            body = " ".join(self.sentence() for _ in range(r.choice((1, 1, 2, 4, 7))))
            if r.random() < 0.15:
                body = " ".join(self.word() for _ in range(r.randint(1, 4))) + r.choice((".", ".", ""))
            if r.random() < 0.2:
                w = self.word()
                body += r.choice((f' <a href="/{w}">{w}</a> ', f" <b>{w}</b> ", f" <em>{w}</em>."))
            kind = r.random()
            if kind < 0.68:
                parts.append(f"<p{mark}>{body}</p>")
            elif kind < 0.78:
                parts.append(f"<p{mark}><b>{body}<br>")
            elif kind < 0.84:
                parts.append(f"<h{(n := r.randint(2, 4))}{mark}>{self.sentence(1, 6)}</h{n}>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li{mark}>{self.sentence(2, 9)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p{mark}>{body}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table>" + "".join(f"<tr><td{mark}>{self.sentence(1, 4)}</td><td{mark}>{self.word()}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                parts.append(f"<pre{mark}>{body}</pre>")
            if r.random() < 0.05:
                parts.append(self.other(r.choice(("ad", "side", "share", "notice", "form"))))
        return "".join(parts)

    def page(self):
        r = self.r
        self.style = r.choice(("plain",) * 6 + ("noisy", "loud", "bars"))
        some = lambda p, *kinds: "".join(self.other(k) for k in kinds if r.random() < p)
        wrap = r.choice(("article", "article", "article", "main", "div", "section"))
        body = f"<{wrap}{self.attribute('main') if wrap in ('div', 'section') or r.random() < 0.4 else ''}>{self.article()}" + some(0.15, "share", "comments") + f"</{wrap}>"
        if r.random() < 0.3:
            body = f"<main>{body}</main>" if wrap != "main" else body
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("container", "wrapper", "page", "row", self.word()))}">{body}</div>'
        page = some(0.35, "notice", "header") + some(0.8, "menu") + some(0.35, "ad", "form", "header") + body + some(0.35, "comments", "share", "side", "ad", "form") + some(0.8, "footer") + some(0.2, "notice")
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body>{page}</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a generated page and whether each is main text."""
    marked = parse_blocks(re.sub(r"<(\w+)([^>]*) data-main=1", r'<\1\2 class="mainmark"', page))
    plain = parse_blocks(page.replace(" data-main=1", ""))
    return plain, np.array([b.marked for b in marked], np.float32)


def fit(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights trained by Adam on ``pages`` generated pages; the same for the same arguments."""
    layouts, rng = Layouts(seed), np.random.default_rng(seed)
    data = [(features(b), y) for b, y in (labelled(layouts.page()) for _ in range(pages)) if len(b)]
    w = new_weights(rng)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 10)
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            x, mask = padded([data[i][0] for i in batches[k]])
            y, _ = padded_labels([data[i][1] for i in batches[k]])
            g, _ = gradients(w, x, mask, y)
            norm, step = np.sqrt(sum(float((a * a).sum()) for a in g.values())), step + 1
            rate = 0.02 * (0.6**epoch)
            for name in w:
                a = g[name] * min(1.0, 1.0 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.99 * v[name] + 0.01 * a * a
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def padded_labels(labels: list[np.ndarray]) -> tuple[np.ndarray, None]:
    y = np.zeros((len(labels), max(map(len, labels))), np.float32)
    for k, v in enumerate(labels):
        y[k, : len(v)] = v
    return y, None


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    return fit()


def label_pages(parsed: list[list[Block]], w) -> list[np.ndarray]:
    """Probability of main text for the blocks of each page; pages of like length run together."""
    out = [np.zeros(0, np.float32)] * len(parsed)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and n < 256 and len(parsed[order[at + n]]) * (n + 1) <= 8192 and len(parsed[order[at + n]]) <= 2 * len(parsed[order[at]]) + 8:
            n += 1
        part = order[at : at + n]
        x, mask = padded([features(parsed[i]) for i in part])
        p = _sigmoid(logits(w, x, mask)[0])
        for k, i in enumerate(part):
            out[i] = p[k, : len(parsed[i])]
        at += n
    return out


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", weights=None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row.

    ``text`` joins the blocks labelled main, in page order, by two line breaks;
    empty if there are none.  A null or empty page has no blocks; broken markup
    is read as far as it goes; null ids and urls stay null; repeated rows each
    give a row; an empty table gives no rows; further columns are ignored.
    """
    w = weights or trained()

    def extract(batches):
        for batch in batches:
            ids, urls, raw = batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("h")
            for a in range(0, len(ids), 200):
                parsed = [parse_blocks(h) if h else [] for h in raw[a : a + 200].to_pylist()]
                kept = [[b.text for b, p in zip(blocks, ps) if p >= 0.5] for blocks, ps in zip(parsed, label_pages(parsed, w))]
                text = ["\n\n".join(k) for k in kept]
                columns = ((ids[a : a + 200], pa.int64()), (urls[a : a + 200], pa.string()), (text, pa.string()), ([len(t) for t in text], pa.int64()), ([len(b) for b in parsed], pa.int32()), ([len(k) for k in kept], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("h"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")
