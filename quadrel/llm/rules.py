"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted exactly over each whole text.  A small boosted ensemble
is fitted in numpy to a bounded sample of labelled rows; chosen features are
monotone (more symbols, repeats or duplicate lines never raise quality).  For
scoring, all trees lie in flat node arrays that are walked level by level for
a whole batch of documents at once.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows each give a row; an empty table gives none; without labels of
both classes every document that passes the base rule is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import labelled_sample, small_batches, tidied

#: Labelled rows of each class (at most) on which the trees are fitted.
PER_CLASS = 1500

# White space that parts words, and the counted symbols.
SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "end_rate", "upper_rate", "shout_rate", "line_words")
#: Direction of quality with each feature: -1 never rises, 0 free.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, -1, 0)


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    span = int(ids.max()) + 1
    pair = ids[:-1] * span + ids[1:]
    if span > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, at, count = np.unique(pair[:-1] * span + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    mark = np.zeros(len(ids), bool)
    mark[:-2] |= again
    mark[1:-1] |= again
    mark[2:] |= again
    return int(mark.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, SPACE))
    symbols = sum(map(raw.count, SYMBOLS))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = _repeat_words(ids)
    per = max(1, n)
    upper = sum(w[:1].isupper() for w in seen)
    shout = sum(len(w) > 2 and w.isupper() for w in seen)
    features = (
        float(np.log1p(n)), chars / per, symbols / per, dup / max(1, len(lines)), repeat / per, len(seen) / per,
        (raw.count(b".") + raw.count(b"?") + raw.count(b"!")) / per, upper / max(1, len(seen)), shout / max(1, len(seen)), n / max(1, len(lines)),
    )
    return (n, chars, symbols, dup, repeat), features


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


@dataclass
class Trees:
    """Flat ensemble: node arrays, a root per tree; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boost logistic loss with second-order splits.

    A split on a monotone feature must order its children's values, and the
    children inherit the midpoint as a bound, so that whole trees stay monotone.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes: list[list[float]] = []
    roots: list[int] = []
    rate0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, left: int) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + l2), lo, hi))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, -1)
        if left:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(code[rows, j], g[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(code[rows, j], h[rows], len(c) + 1))[:-1]
                vl = np.clip(-gs / (hs + l2), lo, hi)
                vr = np.clip(-(total_g - gs) / (total_h - hs + l2), lo, hi)
                gain = -(gs * vl + 0.5 * (hs + l2) * vl**2) - ((total_g - gs) * vr + 0.5 * (total_h - hs + l2) * vr**2) + total_g * value + 0.5 * (total_h + l2) * value**2
                count = np.cumsum(np.bincount(code[rows, j], minlength=len(c) + 1))[:-1]
                bad = (count < least) | (len(rows) - count < least) | (monotone[j] * (vr - vl) < 0)
                gain[bad] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] >= 0:
            _, j, k = best
            low = code[rows, j] <= k
            lo_l, hi_l, lo_r, hi_r = lo, hi, lo, hi
            if monotone[j]:
                v = [float(np.clip(-g[r].sum() / (h[r].sum() + l2), lo, hi)) for r in (rows[low], rows[~low])]
                mid = (v[0] + v[1]) / 2
                if monotone[j] < 0:
                    lo_l, hi_r = mid, mid
                else:
                    hi_l, lo_r = mid, mid
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = grow(rows[low], g, h, lo_l, hi_l, left - 1)
            nodes[me][3] = grow(rows[~low], g, h, lo_r, hi_r, left - 1)
        return me

    def walk(root: int) -> np.ndarray:
        at = np.full(len(y), root)
        flat = np.array(nodes)
        for _ in range(depth):
            go = x[np.arange(len(y)), flat[at, 0].astype(int)] <= flat[at, 1]
            at = np.where(go, flat[at, 2], flat[at, 3]).astype(int)
        return flat[at, 4]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth))
        margin = margin + walk(roots[-1])
    flat = np.array(nodes)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees | None:
    """Trees fitted to a bounded sample of labelled rows; None without both classes."""
    rows = labelled_sample(docs, labels, per_class)
    y = np.array([q for _, q in rows], float)
    if len(set(y)) < 2:
        return None
    return fit(np.array([statistics(t)[1] for t, _ in rows]), y)


def apply(docs: DataFrame, model: Trees | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    small_batches(docs.sparkSession)

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            failed = np.array([base_failed(c) for c, _ in found], bool)
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            score = model.probability(x) if model is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
