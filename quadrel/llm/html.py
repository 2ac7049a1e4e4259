"""Main-text extraction: a bidirectional LSTM labels every block of a page.

A page is cut into leaf blocks in page order.  A block's vector holds hashed
tag-path tokens (tags, classes, ids of its ancestors), hashed words, and a few
numbers (length, link share, punctuation).  A two-way LSTM reads the whole
page's sequence, so that each block is judged in the context of all others.
It is trained in numpy on made-up pages of many layouts, whose labels are
known by construction; no page of the input is used.

Defined results: a null or empty html, and a page without main text, give the
empty text; repeated rows each give a row; broken or unclosed markup is read as
far as it goes; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import inspect
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm.common import scratch, small_batches, tidied
from quadrel.storage import shared_root

HIDDEN, PATH_DIM, WORD_DIM = 16, 14, 6
#: Elements above a block that its tag path holds, the nearest ones.
DEPTH = 64
#: Blocks times pages run side by side, positions of a chunk of a run, and characters of html parsed before labelling.
CELLS, STEPS, CHARS = 1 << 15, 1 << 12, 4 << 20
PATH_BUCKETS, WORD_BUCKETS = 1 << 11, 1 << 11
NUMBERS = 9
#: Made-up pages for training, and passes over them.
PAGES, EPOCHS = 2000, 10

# Fixed values of HTML: elements that break text into blocks, whose content is
# no text, that close by themselves, and that close an open element of a kind.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option output p pre search section select summary table tbody td textarea tfoot th thead tr ul video".split())
SILENT = frozenset("script style template title textarea iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
SCOPES = frozenset("table ul ol dl select body html".split())
PHRASING = BLOCKS - {"body", "html", "button", "label", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "select", "output", "textarea", "canvas", "video", "legend"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Element:
    """An open or closed element: its tag, its path token (tag, classes, id, role), its parent."""

    tag: str
    token: str
    up: Element | None


@dataclass(slots=True)
class Block:
    within: Element | None
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        """Path tokens of the nearest DEPTH elements, the nearest last."""
        out, at = [], self.within
        while at is not None and len(out) < DEPTH:
            out.append(at.token)
            at = at.up
        return tuple(out[::-1])

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Stack:
    """Open elements.  What is open, and what is open in the innermost scope (a table, a list, the body), is known by counts, so that each element costs the same however deep it lies."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.counts: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, tag: str, token: str) -> None:
        self.open.append(Element(tag, token, self.open[-1] if self.open else None))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.counts[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def has(self, tag: str) -> bool:
        return self.counts.get(tag, 0) > 0

    def shut(self, tags: tuple[str, ...]) -> None:
        """Close these where they are open in the innermost scope, with all that is open in them."""
        left = sum(self.scopes[-1].get(t, 0) for t in tags)
        while left > 0:
            left -= self.pop() in tags


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack = _Stack()
    now: Block | None = None
    html = html or ""
    at = 0

    def take(raw: str) -> None:
        nonlocal now
        text = unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip():
                return
            now = Block(stack.open[-1] if stack.open else None)
        now.parts.append(text)
        if stack.has("a"):
            now.linked += len(text)

    def end() -> None:
        nonlocal now
        if now is not None:
            out.append(now)
            now = None

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            take(html[at:])
            break
        if m.start() > at:
            take(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if stack.has(tag):
                while True:
                    t = stack.pop()
                    if t in BLOCKS:
                        end()
                    if t == tag:
                        break
            elif tag in BLOCKS:
                end()
            continue
        if tag in SILENT:
            if not m[3].endswith("/>"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html)
            if tag in BLOCKS:
                end()
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCKS:
            end()
        if tag in VOID:
            continue
        stack.shut((*CLOSES.get(tag, ()), *(("p",) if tag in PHRASING else ())))
        if tag == "head":
            close = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(html, at)
            if close:
                at = close.start() if close[0].lower().startswith("<body") else close.end()
            continue
        token = tag
        if "=" in m[3]:
            token += "".join(f" {'#' if a.lower() == 'id' else '.'}{q or r or s}" for a, q, r, s in _NAME.findall(m[3]))
        stack.push(tag, token)
    end()
    return [b for b in out if "".join(b.parts).strip()]


def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=20_000)
def path_tokens(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of a tag path: tags by how near the leaf they are, and the parts of class and id names."""
    found: dict[str, None] = {}
    flow = [p for p in path if p.split(" ")[0] in BLOCKS]
    for up, element in enumerate(reversed(flow)):
        tag, *names = element.split(" ")
        found[f"tag {tag}"] = None
        if up < 3:
            found[f"up{up} {tag}"] = None
            found[f"pair {tag} {flow[-up - 2].split(' ')[0] if up + 1 < len(flow) else ''}"] = None
        for name in names:
            for part in _PART.findall(name[1:]):
                found[f"name {part.lower()}"] = None
    return tuple(_hash(t, PATH_BUCKETS) for t in found)


def numbers(block: Block, text: str, words: list[str], k: int, n: int) -> list[float]:
    size = max(1, len(text))
    marks = text.count(".") + text.count("!") + text.count("?") + text.count(",")
    return [np.log1p(len(text)) / 5, np.log1p(len(words)) / 4, min(1.0, block.linked / size), min(1.0, 8 * marks / size), float(text[-1:] in ".!?"),
            float(len(words) <= 3), k / max(1, n), float(k < 3), float(n - k <= 3)]


@dataclass
class Page:
    texts: list[str]
    path: list[tuple[int, ...]]
    words: list[np.ndarray]
    nums: np.ndarray


def page(html: str | None, mark: str = "") -> tuple[Page, np.ndarray]:
    """A page's blocks as vectors' sources; labels: whether mark stood in the block (training)."""
    found = blocks(html)
    texts, labels = [], []
    for b in found:
        t = b.text()
        labels.append(bool(mark) and mark in t)
        texts.append(" ".join(t.replace(mark, "").split()) if mark else t)
    split = [t.lower().split(" ") for t in texts]
    return Page(texts, [path_tokens(b.path) for b in found],
                [np.fromiter((_hash(w, WORD_BUCKETS) for w in ws), np.int64, len(ws)) for ws in split],
                np.array([numbers(b, t, ws, k, len(found)) for k, (b, t, ws) in enumerate(zip(found, texts, split, strict=True))], np.float32).reshape(-1, NUMBERS)), np.array(labels, float)


class Labeller:
    """The network and its training."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + NUMBERS, HIDDEN
        self.p = {"path": np.zeros((PATH_BUCKETS, PATH_DIM)), "word": np.zeros((WORD_BUCKETS, WORD_DIM)), "skip": rng.normal(0, 0.1, d), "out": rng.normal(0, 0.2, 2 * h), "off": np.zeros(1)}
        for k in "fb":
            self.p |= {k + "x": rng.normal(0, 0.25, (d, 4 * h)), k + "h": rng.normal(0, 0.25, (h, 4 * h)), k + "c": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}

    def freeze(self) -> Labeller:
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, dict]:
        """Vectors (pages, blocks, size), mask, and what the backward pass needs."""
        lens = np.array([len(p.texts) for p in pages])
        path = [t for p in pages for t in p.path]
        words = [w for p in pages for w in p.words]
        kind = self.p["skip"].dtype
        flat = np.zeros((len(path), PATH_DIM + WORD_DIM + NUMBERS), kind)
        pn, wn = np.array([max(1, len(t)) for t in path]), np.array([len(w) for w in words])
        pid = np.fromiter((x for t in path for x in (t or (0,))), np.int64)
        wid = np.concatenate(words)
        pw, ww = 1 / np.sqrt(pn), 1 / (wn + 3.0)
        flat[:, :PATH_DIM] = np.add.reduceat(self.p["path"][pid], np.cumsum(pn) - pn) * pw[:, None].astype(kind)
        flat[:, PATH_DIM:-NUMBERS] = np.add.reduceat(self.p["word"][wid], np.cumsum(wn) - wn) * ww[:, None].astype(kind)
        flat[:, -NUMBERS:] = np.concatenate([p.nums for p in pages])
        mask = np.arange(lens.max())[None, :] < lens[:, None]
        x = np.zeros((*mask.shape, flat.shape[1]), kind)
        x[mask] = flat
        return x, mask, {"pid": pid, "wid": wid, "pn": pn, "wn": wn, "pw": pw, "ww": ww}

    def _run(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        h = np.zeros((len(x), HIDDEN), x.dtype)
        c = np.zeros_like(h)
        out = np.zeros((*mask.shape, HIDDEN), x.dtype)
        gates, steps = x @ self.p[k + "x"] + self.p[k + "c"], []
        order = range(x.shape[1]) if k == "f" else range(x.shape[1] - 1, -1, -1)
        for t in order:
            z = gates[:, t] + h @ self.p[k + "h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                steps.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[:, t] = h
        return out, steps

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, fs = self._run("f", x, mask, keep)
        b, bs = self._run("b", x, mask, keep)
        z = x @ self.p["skip"] + f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + self.p["off"][0]
        return z, (f, b, fs, bs)

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> tuple[dict, float]:
        x, mask, src = self.inputs(pages)
        z, (f, b, fs, bs) = self.logits(x, mask, keep=True)
        y = np.zeros(mask.shape)
        y[mask] = np.concatenate(labels)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -float(np.sum(np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0)) / mask.sum())
        dz = np.where(mask, p - y, 0) / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["skip"] = np.einsum("btd,bt->d", x, dz)
        g["off"][0] = dz.sum()
        g["out"] = np.concatenate([np.einsum("bth,bt->h", f, dz), np.einsum("bth,bt->h", b, dz)])
        dx = dz[..., None] * self.p["skip"]
        for k, steps, w in (("f", fs, self.p["out"][:HIDDEN]), ("b", bs, self.p["out"][HIDDEN:])):
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h0, c0, i, ff, o, gg, tc, m in reversed(steps):
                dh = dh + dz[:, t, None] * w
                live = dh * m
                dct = dc + live * o * (1 - tc * tc)
                dct = np.where(m, dct, 0)
                d = np.concatenate([dct * gg * i * (1 - i), dct * c0 * ff * (1 - ff), live * tc * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                g[k + "x"] += x[:, t].T @ d
                g[k + "h"] += h0.T @ d
                g[k + "c"] += d.sum(axis=0)
                dx[:, t] += d @ self.p[k + "x"].T
                dh = np.where(m, d @ self.p[k + "h"].T, dh)
                dc = np.where(m, dct * ff, dc)
        flat = dx[mask]
        np.add.at(g["path"], src["pid"], np.repeat(flat[:, :PATH_DIM] * src["pw"][:, None], src["pn"], axis=0))
        np.add.at(g["word"], src["wid"], np.repeat(flat[:, PATH_DIM:-NUMBERS] * src["ww"][:, None], src["wn"], axis=0))
        return g, loss

    def _ahead(self, k: str, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One direction's part of the logits; the gates of STEPS positions at a time."""
        h = np.zeros((len(x), HIDDEN), x.dtype)
        c = np.zeros_like(h)
        n = x.shape[1]
        z, w = np.zeros(mask.shape, x.dtype), self.p["out"][:HIDDEN] if k == "f" else self.p["out"][HIDDEN:]
        step = max(1, STEPS // len(x))
        for lo in range(0, n, step):
            at = range(lo, min(lo + step, n))
            if k == "b":
                at = range(n - 1 - lo, max(n - 1 - lo - step, -1), -1)
            first = min(at[0], at[-1])
            gates = x[:, first:first + len(at)] @ self.p[k + "x"] + self.p[k + "c"]
            for t in at:
                g = gates[:, t - first] + h @ self.p[k + "h"]
                s = 1 / (1 + np.exp(-np.clip(g[:, :3 * HIDDEN], -30, 30)))
                m = mask[:, t, None]
                c = np.where(m, s[:, HIDDEN:2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN:]), c)
                h = np.where(m, s[:, 2 * HIDDEN:] * np.tanh(c), h)
                z[:, t] = h @ w
        return z

    def label(self, pages: list[Page], cells: int = CELLS) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length run together, as many as make so many cells."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i].texts), key=lambda i: len(pages[i].texts))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]].texts) <= cells:
                to += 1
            some = order[at:to]
            x, mask, _ = self.inputs([pages[i] for i in some])
            z = x @ self.p["skip"] + self._ahead("f", x, mask) + self._ahead("b", x, mask) + self.p["off"][0]
            for row, i in enumerate(some):
                out[i] = z[row, :len(pages[i].texts)] > 0
            at = to
        return out


def fit(pages: list[tuple[Page, np.ndarray]], epochs: int = EPOCHS, batch: int = 48, rate: float = 0.03, seed: int = 3) -> Labeller:
    """Adam on the blocks' logistic loss."""
    rng = np.random.default_rng(seed)
    net = Labeller()
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    pages = [p for p in pages if p[0].texts]
    step = 0
    for epoch in range(epochs):
        by_length = sorted(range(len(pages)), key=lambda i: (len(pages[i][0].texts), rng.random()))
        groups = [by_length[i:i + batch] for i in range(0, len(by_length), batch)]
        for k in rng.permutation(len(groups)):
            g, _ = net.gradients([pages[i][0] for i in groups[k]], [pages[i][1] for i in groups[k]])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            g["word"] += 1e-4 * net.p["word"]
            for n in net.p:
                x = g[n] * min(1.0, 1.0 / (norm + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * x
                v[n] = 0.999 * v[n] + 0.001 * x * x
                net.p[n] = net.p[n] - now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return net.freeze()


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller, trained on made-up pages; the same on every run."""
    from quadrel.llm.html_pages import MARK, made_up

    return fit([page(h, MARK) for h in made_up(PAGES)])


def stored(spark: SparkSession) -> Labeller:
    """trained(), kept in the shared folder under a name that depends on its making, so that other drivers find it."""
    from quadrel.llm import html_pages

    making = zlib.crc32("".join(inspect.getsource(m) for m in (html_pages, sys.modules[__name__])).encode())
    path = f"{shared_root(spark)}/quadrel-html-{making:08x}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "name string, shape array<int>, data binary"
    if not fs.exists(there):
        rows = [(k, list(v.shape), v.tobytes()) for k, v in trained().p.items()]
        new = scratch(spark, "html-net")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(new)
        fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), there)  # whole or not at all
    net = Labeller()
    net.p = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in spark.read.schema(schema).parquet(path).collect()}
    return net


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) for every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession, 500)
    net = net or stored(pages.sparkSession)

    def labelled(some: pa.RecordBatch) -> pa.RecordBatch:
        found = [page(h.as_py())[0] for h in some.column("html")]
        main = net.label(found)
        texts = [" ".join(t for t, k in zip(p.texts, keep, strict=True) if k) for p, keep in zip(found, main, strict=True)]
        return pa.RecordBatch.from_arrays(
            [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p.texts) for p in found], pa.int32()), pa.array([int(k.sum()) for k in main], pa.int32())],
            ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("html")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(batch):  # pages of about CHARS characters together
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS)))
                yield labelled(batch.slice(at, to - at))
                at = to

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return some.mapInArrow(rows, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")
