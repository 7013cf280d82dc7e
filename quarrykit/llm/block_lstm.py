"""Main-text extraction: a bidirectional LSTM in numpy labels every leaf block of a page."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

PATH, WORDS, EXTRA, HIDDEN = 96, 48, 8, 24
WIDTH = PATH + WORDS + EXTRA
#: A block's tag path names so many elements, from the nearest; elements may be nested deeper without end.
NEAR = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_SKIPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("noscript", "template", "object", "svg", "math")}
_TITLE_END = re.compile(r"</title\s*>", re.I)
_IN_HEAD = frozenset("html head title meta link base basefont bgsound noframes noscript template script style".split())
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br center nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre figure address hr fieldset".split())
_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of link text) of each leaf block with text, in page order.

    Comments, head, scripts and styles hold no text. Inline elements do not part blocks;
    a line break is white space. Character references are decoded after the markup is
    cut, white space is collapsed, and unclosed or stray tags are tolerated: head ends at
    its end tag, body, or the first tag or text that can't stand in it; svg and math may
    close themselves; noscript, template, object, svg and math without an end tag hide
    nothing.
    """
    html = html or ""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    said: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if said:
            text = " ".join(unescape("".join(said)).split())
            if text:
                out.append((tuple(x for _, x in stack[-NEAR:]), text, min(1.0, linked / len(text))))
            said.clear()
            linked = 0

    def shut(k: int) -> None:
        for gone, _ in stack[k:]:
            opened[gone] -= 1
        del stack[k:]

    opened: dict[str, int] = {}
    in_head, unclosed = False, set()
    while m := _TAG.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            in_head = in_head and not piece.strip()
            if not in_head:
                said.append(piece)
                if in_link:
                    linked += len(piece.strip())
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, close = name.lower(), m[2] or m[5]
        if name == "head" or (in_head and name not in _IN_HEAD):
            in_head = name == "head" and not close
        if in_head and name == "title" and not close and (end := _TITLE_END.search(html, at)):
            at = end.end()
            continue
        if name in _SKIPPED and not close:
            empty = name in ("svg", "math") and (m[4] if m[3] else m[7]).endswith("/")
            end = None if empty or name in unclosed else _SKIPPED[name].search(html, at)
            if end:
                at = end.end()
            elif not empty:
                unclosed.add(name)
            continue
        if name in _INLINE:
            if name == "br":
                said.append(" ")
            elif name == "a":
                in_link = 0 if close else 1
            continue
        flush()
        if close:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                shut(k)
            in_link = 0
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            shut(len(stack) - 1)
        elif name in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[name]:
                    break
                if stack[k][0] == name or (name in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    shut(k)
                    break
        attrs = m[4] if m[3] else m[7]
        marks = " ".join(x.strip("\"'").lower() for x in _CLASS.findall(attrs)) if attrs else ""
        stack.append((name, f"{name} {marks}".strip()))
        opened[name] = opened.get(name, 0) + 1
    if at < len(html):
        said.append(html[at:])
    flush()
    return out


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed bag of a tag path: tags, their class and id words, and the last tags by place."""
    v = np.zeros(PATH, np.float32)

    def add(token: str, weight: float) -> None:
        h = crc32(token.encode("utf-8", "surrogatepass"))
        v[h % PATH] += weight if h >> 16 & 1 else -weight

    for depth, part in enumerate(reversed(path)):
        tag, *marks = re.split(r"[\s_-]+", part)
        add(f"t {tag}", 1.0)
        if depth < 2:
            add(f"{depth} {tag}", 1.0)
        for w in marks:
            add(f"m {w.rstrip('s0123456789')}", 1.5)
    return np.clip(v, -3, 3)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return h


_BUCKETS = _Buckets()


def features(pages: list[list[tuple[tuple[str, ...], str, float]]]) -> np.ndarray:
    """One row of WIDTH numbers per block, pages one after the other."""
    n = sum(map(len, pages))
    out = np.zeros((n, WIDTH), np.float32)
    flat, owner, k = [], [], 0
    for page in pages:
        total = len(page)
        for pos, (path, text, links) in enumerate(page):
            w = text.lower().split()
            flat.extend(map(_BUCKETS.__getitem__, w))
            owner.append(len(w))
            x = out[k]
            x[:PATH] = _path_vector(path)
            size = len(text)
            x[PATH + WORDS :] = (np.log1p(size) / 5, np.log1p(len(w)) / 3, links, pos / total, (total - pos) / total, text[-1] in ".!?…\"'", "©" in text, len(path) / 8)
            k += 1
    if n:
        rows = np.repeat(np.arange(n), owner)
        counts = np.bincount(rows * WORDS + np.array(flat, np.int64), minlength=n * WORDS).reshape(n, WORDS)
        out[:, PATH : PATH + WORDS] = np.log1p(counts) / np.sqrt(1 + np.array(owner))[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Labeller:
    """Bidirectional LSTM with one output per block, trained by backpropagation through time."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.08, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"b{d}"] = bias
        self.p["v"] = rng.normal(0, 0.1, (2 * HIDDEN + WIDTH, 1)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """Hidden states (time, batch, HIDDEN); x is (time, batch, WIDTH), mask (time, batch, 1)."""
        steps, n, _ = x.shape
        z_all = (x.reshape(-1, WIDTH) @ self.p[f"w{d}"] + self.p[f"b{d}"]).reshape(steps, n, 4 * HIDDEN)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        u, k = self.p[f"u{d}"], HIDDEN
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_all[t] + h @ u
            s = _sigmoid(z[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 3 * k :])
            m = mask[t]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, tc))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, tapes: dict[str, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._run(x, mask, d, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"]
        seen = np.concatenate([*parts, x], axis=2)
        return (seen @ self.p["v"])[..., 0] + self.p["c"], seen

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tapes: dict[str, list] = {}
        z, seen = self.scores(x, mask, tapes)
        p, m = _sigmoid(z), mask[..., 0]
        total = m.sum()
        loss = float((m * np.logaddexp(0, np.where(y > 0, -z, z))).sum() / total)
        dz = ((p - y) * m / total).astype(np.float32)
        g = {"v": (seen.reshape(-1, seen.shape[2]).T @ dz.reshape(-1, 1)), "c": np.array([dz.sum()], np.float32)}
        d_seen = dz[..., None] * self.p["v"][:, 0]
        k = HIDDEN
        for at, d in enumerate("fb"):
            dh_out = d_seen[..., at * k : (at + 1) * k]
            u = self.p[f"u{d}"]
            gu = np.zeros_like(u)
            gz = np.zeros((*x.shape[:2], 4 * k), np.float32)
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            for t, h0, c0, i, f, o, gg, tc in reversed(tapes[d]):
                m_t = mask[t]
                dh = dh + dh_out[t]
                live = m_t * dh
                dc2 = m_t * dc + live * o * (1 - tc * tc)
                q = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c0 * f * (1 - f), live * tc * o * (1 - o), dc2 * i * (1 - gg * gg)], axis=1)
                gz[t] = q
                gu += h0.T @ q
                dh = (1 - m_t) * dh + q @ u.T
                dc = (1 - m_t) * dc + dc2 * f
            flat = gz.reshape(-1, 4 * k)
            g |= {f"u{d}": gu, f"w{d}": x.reshape(-1, WIDTH).T @ flat, f"b{d}": flat.sum(0)}
        return loss, g

    def keep(self, pages: list[list]) -> list[np.ndarray]:
        """For each page, which of its blocks belong to the main text."""
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        out = [np.zeros(0, bool)] * len(pages)
        while order:
            most, group = len(pages[order[-1]]), []
            while order and len(group) < 256 and len(pages[order[-1]]) * 2 >= most and most * (len(group) + 1) <= 65_536 or order and not group:
                group.append(order.pop())
            x, mask = _padded([pages[k] for k in group])
            z, _ = self.scores(x, mask)
            for col, k in enumerate(group):
                out[k] = z[: len(pages[k]), col] > 0
        return out


def _padded(pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    rows = features(pages)
    x = np.zeros((sizes.max(), len(pages), WIDTH), np.float32)
    mask = np.zeros((sizes.max(), len(pages), 1), np.float32)
    at = 0
    for col, n in enumerate(sizes):
        x[:n, col], mask[:n, col] = rows[at : at + n], 1
        at += n
    return x, mask


class _Writer:
    """Invents pages with a known main text, in many layouts, some with broken markup."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.letters = rng.choice(["etaoinshrdlu", "enisratdhulcg", "eaosrnidlctu", "éèaeiouxlnrst", "абвгдеиклмнорст"])

    def word(self) -> str:
        return "".join(self.r.choices(self.letters, k=self.r.randint(1, 9)))

    def text(self, low: int, high: int) -> str:
        w = [self.word() for _ in range(self.r.randint(low, high))]
        mark = self.r.choice(["", "", "", "", "!!", "%%%", "&amp;&amp;", "###"])
        out = " ".join(x + mark + ("," if self.r.random() < 0.08 else "") for x in w).capitalize()
        return out + self.r.choice([".", ".", ".", ".", "", "!", "?"])

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.text(1, 4)}</a>'

    def wrap(self, inside: str, plain: list[str], marks: list[str]) -> str:
        if plain and self.r.random() < 0.5:
            tag = self.r.choice(plain)
            extra = f' class="{self.r.choice(marks)}"' if self.r.random() < 0.3 else ""
        else:
            tag = self.r.choice(["div", "div", "section", "aside", "ul"] if "<li" in inside else ["div", "div", "section", "aside"])
            extra = f' {self.r.choice(["class", "id"])}="{self.r.choice(["", "", "site-", "page_", "main-"])}{self.r.choice(marks)}{self.r.choice(["", "", "-box", " block", "s"])}"'
        return f"<{tag}{extra}>{inside}</{tag}>"

    def lines(self, tags: list[str], few: int, many: int, low: int, high: int, links: float = 0.0) -> str:
        out = []
        for _ in range(self.r.randint(few, many)):
            tag = self.r.choice(tags)
            own = self.link() if self.r.random() < links else self.text(low, high)
            out.append(f"<{tag}>{own}</{tag}>" if tag else own)
        return "".join(out)

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.wrap("<ul>" + self.lines(["li"], 2, 9, 1, 3, 0.95) + "</ul>" if r.random() < 0.7 else "".join(self.link() for _ in range(r.randint(2, 8))), ["nav"], ["nav", "menu", "navigation", "navbar", "breadcrumb", "tabs", "toc"])
        if kind == "header":
            return self.wrap(self.lines(["h1", "h2", "p", "div", "a", "span", ""], 1, 3, 1, 8, 0.3), ["header"], ["header", "masthead", "topbar", "logo", "branding", "top"])
        if kind == "ad":
            return self.wrap(self.lines(["p", "", "", "div", "a", "span"], 1, 2, 2, 25, 0.3), [], ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "adbox", "promotion"])
        if kind == "notice":
            return self.wrap(self.lines(["p", "", "div"], 1, 2, 3, 30, 0.1), ["dialog"], ["cookie", "notice", "alert", "consent", "gdpr", "popup", "modal", "overlay", "message", "newsletter", "subscribe"])
        if kind == "side":
            return self.wrap(self.lines(["p", "li", "h3", "h4", "div"], 2, 7, 1, 20, 0.5), ["aside", "aside"], ["sidebar", "widget", "related", "side", "rail", "recommended", "popular", "share", "social", "tags"])
        if kind == "form":
            return f'<form action="/{self.word()}"{r.choice(["", " class=search", " id=login"])}>' + self.lines(["label", "p", "div", "legend"], 1, 3, 1, 6) + f'<input name="q">{r.choice(["<select><option>" + self.text(1, 2) + "</option></select>", ""])}<button>{self.text(1, 2)}</button></form>'
        if kind == "comments":
            inside = "".join(self.wrap(self.lines(["p", "p", "div", "span"], 1, 2, 2, 50), [], ["comment", "reply", "comment-body", "author"]) for _ in range(r.randint(1, 5)))
            return self.wrap(self.lines(["h2", "h3"], 0, 1, 1, 3) + inside, [], ["comments", "comment-list", "discussion", "replies", "respond", "disqus", "feedback"])
        return self.wrap(r.choice(["&copy; ", "© ", "", "Copyright "]) + self.text(1, 14) + r.choice(["", f" &middot; {self.text(2, 14)}"]) + r.choice(["", self.lines(["p", "li"], 1, 3, 1, 8, 0.6)]), ["footer", "footer"], ["footer", "copyright", "bottom", "legal", "colophon"])

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append((1, f"<h1>{self.text(1, 12)}</h1>"))
        for _ in range(r.randint(1, 16)):
            x = r.random()
            if x < 0.72:
                own = self.text(1, 90) if r.random() < 0.8 else self.text(1, 3)
                if r.random() < 0.2:
                    own += f" {self.link()} {self.text(1, 20)}"
                out.append((1, r.choice([f"<p>{own}</p>", f"<p>{own}</p>", f"<p>{own}", f"<p><b>{own}<br>", f"<div>{own}</div>", f"<p><em>{own}</em></p>"])))
            elif x < 0.82:
                out.append((1, r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figcaption>{}</figcaption>"]).format(self.text(1, 25))))
            elif x < 0.88:
                out.append((1, r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(self.lines(["li"], 1, 5, 1, 20))))
            elif x < 0.91:
                out.append((1, "<table><tr>" + self.lines(["td"], 2, 4, 1, 5) + "</tr></table>"))
            elif x < 0.96:
                out.append((0, self.noise(r.choice(["ad", "ad", "side", "notice", "form"]))))
        if r.random() < 0.12:
            out.append((0, self.noise("comments")))
        shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="post">{}</article>', None, None])
        if shell is None:
            shell = f'<{(tag := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{r.choice(["content", "article", "post", "entry", "story", "article-body", "main", "post-content", "entry-content", "text", "body"])}">{{}}</{tag}>'
        return shell.replace("{}", "".join(f"\0{k}\1{x}" for k, x in out) + "\0" + "0\1")

    def page(self) -> str:
        """HTML in which NUL, 0 or 1, SOH precede pieces that are (1) or aren't (0) main text."""
        r = self.r
        before = [self.noise(k) for k in ("header", "nav", "ad", "notice", "side", "form") if r.random() < 0.4]
        after = [self.noise(k) for k in ("comments", "side", "ad", "nav", "form", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.noise("footer"))
        body = "\0" + "0\1" + "".join(before) + self.main() + "".join(after)
        if r.random() < 0.2:
            body = f'<div id="{r.choice(["wrapper", "page", "container"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.text(1, 9)}</title><style>p{{margin:0}}</style></head><body>{body}" + r.choice(["</body></html>", ""])


def invented_page(rng: random.Random) -> tuple[list, np.ndarray]:
    """(blocks, labels) of one invented page."""
    html = _Writer(rng).page()
    state, cut = 0, re.compile("\0([01])\1")
    page = blocks(cut.sub("<hr>", html))
    at, out, pieces = 0, [], []  # the same page again, a marker word before each text
    for m in cut.finditer(html):
        pieces.append((state, html[at : m.start()]))
        state, at = int(m[1]), m.end()
    pieces.append((state, html[at:]))
    tagged = "<hr>".join(re.sub(r">(?=[^<]*[^<\s])", lambda _: f">q{s}q ", x) for s, x in pieces)
    for _, text, _ in blocks(tagged):
        m = re.search(r"q([01])q", text)
        out.append(int(m[1]) if m else 0)
    labels = np.array(out, np.float32)
    return (page, labels) if len(page) == len(labels) else invented_page(rng)


@lru_cache(maxsize=4)
def trained(pages: int = 1200, epochs: int = 6, seed: int = 11) -> Labeller:
    """The labeller, trained on invented pages only; deterministic, once per process (about 25 s of one core)."""
    rng = random.Random(seed)
    data = [x for x in (invented_page(rng) for _ in range(pages)) if x[0]]
    model = Labeller()
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rng.shuffle(data)
        data.sort(key=lambda x: len(x[0]) // 12)
        batches = [data[k : k + 32] for k in range(0, len(data), 32)]
        rng.shuffle(batches)
        rate = 0.008 * 0.75**epoch
        for batch in batches:
            x, mask = _padded([p for p, _ in batch])
            y = np.zeros(mask.shape[:2], np.float32)
            for col, (_, own) in enumerate(batch):
                y[: len(own), col] = own
            _, g = model.gradients(x, mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def extract(html: list[str | None], model: Labeller) -> list[str]:
    pages = [blocks(h) for h in html]
    return ["\n".join(b[1] for b, k in zip(page, keep) if k) for page, keep in zip(pages, model.keep(pages))]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = 1200) -> DataFrame:
    """One row per page: id, url, text (kept blocks in page order, one line end between), n_chars.

    The whole page is read; every block is labelled with the context of all its page's
    blocks and kept whole or left whole. The labeller is trained on ``train_pages``
    invented pages, never on the input. Null or empty html gives an empty text, and so does
    markup without words; pages of any length and depth are read whole; repeated rows give
    equal rows, null ids and urls stay null; an empty table gives an empty result. Only the
    three named columns are read, whatever the others are called.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trained(train_pages))
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "h", 4 << 20, 1024):
            text = extract(b.column("h").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
