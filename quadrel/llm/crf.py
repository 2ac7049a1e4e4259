"""Language identification by a linear-chain conditional random field over words.

A word's features are its whole form (lexicon), prefixes, suffixes and letter
n-grams, hashed to one weight table; transitions between neighbouring words
are learned, from training texts spliced of several languages.  Labels are
scored by forward-backward.  All words of a batch form one chain that starts
anew at each text; it is cut into segments whose transfer matrices are
multiplied side by side.  A long text is read in blocks, forward for the vectors
at their borders and then back, so one of any length is handled exactly and in
bounded memory.  A text's language has the largest mean probability.

Defined results: a null text or one without a letter gives `und` and score 0,
as every text does when no language is learned; repeated rows each give a row;
an empty table gives none; null languages are never learned from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import SAMPLE_BYTES, id_bucket, small_batches, tidied

BUCKETS = 1 << 14
#: Texts of each language (about) on which the model is fitted.
PER_LANG = 250
#: Words of a training chain: a longer text gives several, so that every word is learned from.
CHAIN_WORDS = 120
#: Words of more letters are hashed one by one.
SHORT = 30
#: Languages up to which segments are worked side by side; with more, transfer
#: matrices would cost more than they save, so chains are.  No limit on languages.
SEGMENT_LANGS = 64
#: Word forms whose scores a worker keeps.
CACHE = 400_000
SEGMENT = 64
#: Words worked at once, divided by a measure of the labels; texts of more letters than LONG are read piece by piece.
BLOCK_WORDS, LONG = 1 << 16, 1 << 20
FOLDS, HELD = 4, 2

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs that have a letter; numerals such as fractions alone are no words."""
    found = _WORD.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1)


def _whole(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed feature columns of lower-case words of up to SHORT letters: (bucket of each word, whether the word has that feature).

    Columns: the whole form (lexicon), prefix and suffix of three letters, and
    letter pairs and triples with marked word ends, which hold the shorter
    affixes.
    """
    chars = np.array([f"<{w}>" for w in words], dtype=f"U{SHORT + 2}").view(np.uint32).reshape(len(words), SHORT + 2)
    length = (chars != 0).sum(axis=1)
    everyone = np.ones(len(words), bool)

    def gram(at: np.ndarray | int, n: int, tag: int) -> np.ndarray:
        h = np.full(len(words), tag, np.uint32)
        row = np.arange(len(words))
        for k in range(n):
            h = h * np.uint32(0x01000193) + (chars[:, at + k] if isinstance(at, int) else chars[row, at + k])
        return _bucket(h)

    yield np.array([_whole(w) for w in words], np.uint32), everyone
    yield gram(0, 4, 4), length >= 4
    yield gram(np.maximum(length - 4, 0), 4, 5), length >= 4
    for n in (2, 3):
        for i in range(int(length.max()) - n + 1):
            yield gram(i, n, n), length >= i + n


def long_features(word: str) -> np.ndarray:
    """Buckets of the same features of one word, from all its letters, however many."""
    chars = np.frombuffer(f"<{word}>".encode("utf-32-le", "surrogatepass"), np.uint32)

    def grams(part: np.ndarray, n: int, tag: int) -> np.ndarray:
        size = len(part) - n + 1
        h = np.full(size, tag, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + part[k:k + size]
        return _bucket(h)

    return np.concatenate([np.array([_whole(word)], np.uint32), grams(chars[:4], 4, 4), grams(chars[-4:], 4, 5), grams(chars, 2, 2), grams(chars, 3, 3)])


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Label scores of words: their features' weights, summed and scaled by the number of features."""
    out, count = np.zeros((len(words), weights.shape[1]), weights.dtype), np.zeros(len(words), weights.dtype)
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(size <= SHORT)
    if len(short):
        some, n = np.zeros((len(short), weights.shape[1]), weights.dtype), np.zeros(len(short), weights.dtype)
        for at, has in features([words[i] for i in short]):
            some += np.where(has[:, None], weights[at], 0)
            n += has
        out[short], count[short] = some, n
    for i in np.flatnonzero(size > SHORT):
        at = long_features(words[i])
        out[i] = weights[at].sum(axis=0) if len(at) < BUCKETS else np.bincount(at, minlength=BUCKETS).astype(weights.dtype) @ weights
        count[i] = len(at)
    if words:
        out /= np.sqrt(count)[:, None]
    return out


@dataclass
class Chain:
    langs: list[str]
    weights: np.ndarray  # BUCKETS, K
    start: np.ndarray  # log
    trans: np.ndarray  # log; row: label before


def _block(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, segment: int, before: np.ndarray, after: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray]:
    """Some positions in a row.  before: weights ahead of them; after: those behind them, None for a look ahead only.

    Gives the marginals and the weights ahead of these positions seen from
    behind; or None and the weights behind them (whole segments only).
    Segments of equal length run side by side: first their transfer matrices,
    then the vectors at their borders, then the positions.
    """
    n, k = emit.shape
    count = -(-n // segment)
    pad = count * segment - n
    kind = emit.dtype
    e = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -30))
    e = np.concatenate([e, np.ones((pad, k), kind)]).reshape(count, segment, k)
    cut = np.concatenate([first, np.ones(pad, bool)]).reshape(count, segment)
    t = np.exp(np.maximum(trans - trans.max(), -20)).astype(kind)
    s = np.exp(np.maximum(start - start.max(), -20)).astype(kind)

    def step(x: np.ndarray, i: int) -> np.ndarray:
        """Rows x (count, ..., K) of weights before position i to those at it."""
        y = (x.reshape(-1, k) @ t).reshape(x.shape)
        new = np.flatnonzero(cut[:, i])
        if len(new):
            y[new] = x[new].sum(axis=-1, keepdims=True) * s
        y *= e[:, i].reshape((-1,) + (1,) * (x.ndim - 2) + (k,))
        return y

    move = np.broadcast_to(np.eye(k, dtype=kind), (count, k, k)).copy()
    for i in range(segment):
        move = step(move, i)
        if i % 4 == 3 or i == segment - 1:
            move /= move.max(axis=(1, 2), keepdims=True)
    ahead, back = np.empty((count, k), kind), np.empty((count, k), kind)
    v = before
    for j in range(count):
        ahead[j] = v
        v = v @ move[j]
        v = v / v.sum()
    if after is None:
        return None, v
    v = after
    for j in range(count - 1, -1, -1):
        back[j] = v
        v = move[j] @ v
        v = v / v.max()
    behind = v
    alpha = np.empty((count, segment, k), kind)
    a = ahead
    for i in range(segment):
        a = step(a, i)
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = back
    for i in range(segment - 1, -1, -1):
        p = alpha[:, i] * b
        alpha[:, i] = p / p.sum(axis=1, keepdims=True)
        z = e[:, i] * b
        b = z @ t.T
        new = np.flatnonzero(cut[:, i])
        if len(new):
            b[new] = (z[new] @ s)[:, None]
        b = b / b.max(axis=1, keepdims=True)
    return alpha.reshape(-1, k)[:n], behind


def posteriors(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Marginals of every label at every position.

    emit: log scores (n, K); first: whether a position starts a chain (the first
    position must).
    """
    n, k = emit.shape
    if n == 0:
        return np.zeros((0, k))
    if k > SEGMENT_LANGS:
        return _by_chain(emit, first, start, trans)[0]
    return _block(emit, first, start, trans, segment, np.full(k, 1 / k, emit.dtype), np.ones(k, emit.dtype))[0]


def _by_chain(emit: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected transitions of all chains together; chains run side by side, position by position."""
    n, k = emit.shape
    kind = emit.dtype
    e = np.exp(np.maximum(emit - emit.max(axis=1, keepdims=True), -30))
    t, s = np.exp(np.maximum(trans - trans.max(), -20)).astype(kind), np.exp(np.maximum(start - start.max(), -20)).astype(kind)
    begins = np.flatnonzero(first)
    lengths = np.diff(np.append(begins, n))
    # The longest chains first, so that those still running are a prefix.
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    longest = int(lengths[0])
    running = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains of more than i positions
    alpha, beta = np.zeros((n, k), kind), np.ones((n, k), kind)
    for i in range(longest):
        at = begins[:running[i]] + i
        a = (s if i == 0 else alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        at = begins[:running[i + 1]] + i
        b = (e[at + 1] * beta[at + 1]) @ t.T
        beta[at] = b / b.max(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    # A pair's weights are alpha_i t_ij b_j; their sum over positions is one product of matrices.
    at = np.flatnonzero(~first)
    b = e[at] * beta[at]
    b /= ((alpha[at - 1] @ t) * b).sum(axis=1, keepdims=True)
    return post, t * (alpha[at - 1].T @ b)


def _pair_counts(emit: np.ndarray, first: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals and expected transitions of short training chains, and how often each label starts one."""
    post, pairs = _by_chain(emit, first, *model)
    return post, pairs, post[first].sum(axis=0)


def fit(texts: list[str], langs: list[str], steps: int = 90, batch: int = 64, rate: float = 0.3, seed: int = 11) -> Chain:
    """AdaGrad on the conditional likelihood of spliced word chains."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k = len(names)
    batch *= max(1, k // SEGMENT_LANGS)
    if not any(map(words_of, texts)):
        return Chain(names, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    code = {x: i for i, x in enumerate(names)}

    chains = []
    for text, lang in zip(texts, langs, strict=True):
        ws = words_of(text)
        chains += [(ws[at:at + CHAIN_WORDS], code[lang]) for at in range(0, len(ws), CHAIN_WORDS)]
    forms = {x: i for i, x in enumerate(sorted({x for c, _ in chains for x in c}))}
    # Buckets of each form one after the other, and where they begin.
    parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(forms)
    short = [x for x in forms if len(x) <= SHORT]
    if short:
        cols = list(features(short))
        bucket, has = np.stack([a for a, _ in cols], axis=1).astype(np.int64), np.stack([b for _, b in cols], axis=1)
        for x, row, own in zip(short, bucket, has, strict=True):
            parts[forms[x]] = row[own]
    for x in forms:
        if len(x) > SHORT:
            parts[forms[x]] = long_features(x).astype(np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    bucket, begin = np.concatenate(parts), np.cumsum(sizes) - sizes
    w, start, trans = np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k))
    gw, gs, gt = np.full((BUCKETS, k), 1e-2), np.full(k, 1.0), np.full((k, k), 1.0)
    done = 0
    while chains and done < steps:
        order = rng.permutation(len(chains))
        done += -(-len(chains) // batch)
        for lo in range(0, len(order), batch):
            some = [chains[i] for i in order[lo:lo + batch]]
            ws, ys, first = [], [], []
            for j, (c, y) in enumerate(some):
                other, z = some[(j + 1) % len(some)]
                cut = int(rng.integers(1, len(c) + 1)) if rng.random() < 0.4 else len(c)
                tail = other[: int(rng.integers(1, len(other) + 1))] if cut < len(c) else []
                ws += c[:cut] + tail
                ys += [y] * cut + [z] * len(tail)
                first += [True] + [False] * (cut + len(tail) - 1)
            form = np.array([forms[x] for x in ws])
            size = sizes[form]
            ahead = np.cumsum(size) - size
            flat = bucket[np.repeat(begin[form] - ahead, size) + np.arange(int(size.sum()))]
            emit = np.add.reduceat(w[flat], ahead) / np.sqrt(size)[:, None]
            y, cut1 = np.array(ys), np.array(first)
            post, pairs, starts = _pair_counts(emit, cut1, (start, trans))
            d = post.copy()
            d[np.arange(len(y)), y] -= 1
            g = np.zeros_like(w)
            np.add.at(g, flat, np.repeat(d / np.sqrt(size)[:, None], size, axis=0))
            at = np.flatnonzero(~cut1)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[at - 1], y[at]), 1)
            dt = (pairs - seen) / len(some) + 0.01 * trans
            ds = (starts - np.bincount(y[cut1], minlength=k)) / len(some)
            g = g / len(some) + 1e-4 * w
            gw += g * g
            gs += ds * ds
            gt += dt * dt
            w -= rate * g / np.sqrt(gw)
            start -= rate * ds / np.sqrt(gs)
            trans -= rate * dt / np.sqrt(gt)
    return Chain(names, w, start, trans)


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Chain | None:
    """Model fitted to a bounded sample of rows that have a language and are not held out.

    Texts of more than SAMPLE_BYTES are left out; of a language with no other
    text, the shortest is taken.
    """
    size = F.octet_length("text")
    rows = docs.where(F.col("lang").isNotNull() & (id_bucket("doc_id", FOLDS) != HELD) & F.col("text").isNotNull())
    least = {r["lang"]: r["least"] for r in rows.groupBy("lang").agg(F.min(size).alias("least")).collect()}
    if not least:
        return None
    huge = [F.col("lang").eqNullSafe(g) & (size == n) for g, n in least.items() if n > SAMPLE_BYTES]
    rows = rows.where(reduce(Column.__or__, huge, size <= SAMPLE_BYTES))
    counts = rows.groupBy("lang").count().collect()
    scale = 1 << 30
    share = docs.sparkSession.createDataFrame([(r["lang"], min(scale, per_lang * scale // r["count"] + 1)) for r in counts], "lang string, __share long")
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(scale))
    some = rows.select("lang", "text", "doc_id").join(F.broadcast(share), "lang").where(draw < F.col("__share"))
    found = some.select("lang", "text", "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_lang * len(counts)).select("lang", "text").collect()
    return fit([r["text"] for r in found], [r["lang"] for r in found]) if found else None


class Scorer:
    """Word scores of one model, kept per form."""

    def __init__(self, model: Chain):
        self.model = model
        self.weights = model.weights.astype(np.float32)
        self.wide = max(1, len(model.langs) // SEGMENT_LANGS)  # rows of so many labels are so much larger
        self.index: dict[str, int] = {}
        self.table = np.empty((1024, len(model.langs)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > CACHE // self.wide:
            self.index = {}
        index = self.index
        new = list(set(words).difference(index))
        while len(index) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[len(index):len(index) + len(new)] = emissions(new, self.weights)
        index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
        return self.table[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]

    def _long(self, text: str) -> tuple[np.ndarray, int]:
        """Mean marginals of one long text, and its words: forward to every block's border, then back block by block."""
        k = len(self.model.langs)
        block = max(1, BLOCK_WORDS // max(1, k // 8) // SEGMENT) * SEGMENT
        text = text.lower()
        # Borders lie between words, block words apart, so that a block's words can be read again.
        edges, n, end = [0], 0, 0
        for m in _WORD.finditer(text):
            if m[0].isalpha() or any(map(str.isalpha, m[0])):
                n, end = n + 1, m.end()
                if n % block == 0:
                    edges.append(end)
        if n == 0:
            return np.zeros(k), 0
        if edges[-1] < end:
            edges.append(end)

        def part(j: int) -> tuple[np.ndarray, np.ndarray]:
            emit = self.rows(words_of(text[edges[j]:edges[j + 1]])).astype(np.float64)
            first = np.zeros(len(emit), bool)
            first[0] = j == 0
            return emit, first

        before = [np.full(k, 1 / k)]
        for j in range(len(edges) - 2):
            before.append(_block(*part(j), self.model.start, self.model.trans, SEGMENT, before[-1], None)[1])
        total, after = np.zeros(k), np.ones(k)
        for j in range(len(edges) - 2, -1, -1):
            post, after = _block(*part(j), self.model.start, self.model.trans, SEGMENT, before[j], after)
            total += post.sum(axis=0)
        return total / n, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; a text's don't depend on the others."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        words, owner, sizes = [], [], []

        def tell(i: int, mean: np.ndarray) -> None:
            mean = mean.round(9)  # beyond the rounding of sums in another order
            best = int(mean.argmax())
            langs[i], score[i] = self.model.langs[best], min(1.0, float(mean[best]))

        def flush() -> None:
            if not words:
                return
            first = np.zeros(len(words), bool)
            begin = np.cumsum(sizes) - sizes
            first[begin] = True
            post = posteriors(self.rows(words).astype(np.float64), first, self.model.start, self.model.trans)
            mean = np.add.reduceat(post, begin) / np.array(sizes)[:, None]
            for j, i in enumerate(owner):
                tell(i, mean[j])
            words.clear(), owner.clear(), sizes.clear()

        for i, text in enumerate(texts):
            if text and len(text) > LONG:
                mean, n = self._long(text)
                if n:
                    tell(i, mean)
                continue
            ws = words_of(text)
            if ws:
                words += ws
                owner.append(i)
                sizes.append(len(ws))
            if len(words) > BLOCK_WORDS // self.wide:
                flush()
        flush()
        return langs, score


def predict(docs: DataFrame, model: Chain | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is read."""
    small_batches(docs.sparkSession)

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, score = scorer.predict(texts) if scorer else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double")
