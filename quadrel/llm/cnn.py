"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes run over the UTF-8 bytes of the whole document.
Activations are max-pooled over overlapping chunks (two units of UNIT positions
each, one unit apart), a dense layer turns each chunk's pools into a logit, and
the mean over chunks is the document's logit.  For scoring, the filters become
tables over byte pairs, so a position costs WIDTH / 2 look-ups.

Defined results: a null or empty text is scored like any other (one chunk of
padding); repeated rows each give a row; an empty table gives none; without
labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import id_bucket, labelled_sample, small_batches, unused, with_columns

WIDTH = 6
FILTERS = 16
UNIT = 256
#: Labelled rows of each class (at most) on which the network is trained.
PER_CLASS = 1200
#: Positions convolved at once: bounds a worker's memory whatever a text's length.
BLOCK_UNITS = 1024
#: Rows with this remainder of the id's checksum are held out.
FOLDS, HELD = 3, 1


@dataclass
class Network:
    filters: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray
    dense: np.ndarray
    offset: float

    def pairs(self) -> list[np.ndarray]:
        """A table over byte pairs for each second offset."""
        w = self.filters.astype(np.float32)
        return [(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def _units(raw: bytes) -> int:
    """Units of a text with WIDTH - 1 bytes of padding."""
    return -(-(len(raw) + WIDTH - 1) // UNIT)


def _pools(stream: np.ndarray, last: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Max of each filter over each unit of a stream of whole units plus WIDTH - 1 bytes.

    last: units that end a text; their last positions, which lie in padding and
    would reach into the next text, don't count.
    """
    n = len(stream) - WIDTH + 1
    pair = (stream[:-1].astype(np.uint16) << 8) | stream[1:]
    h = tables[0].take(pair[:n], axis=0)
    for k, t in enumerate(tables[1:], 1):
        h += t.take(pair[2 * k:2 * k + n], axis=0)
    h = h.reshape(-1, UNIT, FILTERS)
    h[last, UNIT - WIDTH + 1:] = -np.inf
    return np.maximum(h.max(axis=1) + bias, 0)


def logits(texts: list[bytes], net: Network, tables: list[np.ndarray]) -> np.ndarray:
    """Document logits; all texts lie in one stream, each padded to whole units."""
    counts = np.array([_units(t) for t in texts])
    pooled = np.empty((int(counts.sum()), FILTERS), np.float32)
    pad = [UNIT * int(c) - len(t) for c, t in zip(counts, texts, strict=True)]
    stream = np.frombuffer(b"".join(x for t, p in zip(texts, pad, strict=True) for x in (t, bytes(p))) + bytes(WIDTH), np.uint8)
    bias = net.bias.astype(np.float32)
    first = np.cumsum(counts) - counts
    last = np.zeros(len(pooled), bool)
    last[first + counts - 1] = True
    for at in range(0, len(pooled), BLOCK_UNITS):
        to = min(at + BLOCK_UNITS, len(pooled))
        pooled[at:to] = _pools(stream[at * UNIT:to * UNIT + WIDTH - 1], last[at:to], tables, bias)
    chunk = pooled.copy()  # a chunk is its unit and the next one of the same document
    chunk[:-1][~last[:-1]] = np.maximum(pooled[:-1], pooled[1:])[~last[:-1]]
    z = chunk @ net.dense + net.offset
    z[last & (np.repeat(counts, counts) > 1)] = 0  # the last unit alone is no chunk
    return np.add.reduceat(z, first) / np.maximum(1, counts - 1)


def _padded(raw: bytes) -> np.ndarray:
    """A whole training text, padded to units."""
    return np.frombuffer(raw + bytes(_units(raw) * UNIT + WIDTH - 1 - len(raw)), np.uint8)


def fit(texts: list[str], y: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on logistic loss; the gradient reaches each filter through the positions that won the pooling."""
    rng = np.random.default_rng(seed)
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    p = {"filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.zeros(FILTERS), "dense": rng.normal(0, 0.3, FILTERS), "offset": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            now = rate * (1 - 0.9 * min(1.0, step / steps))
            g = {k: np.zeros_like(x) for k, x in p.items()}
            for r in rows:
                s = _padded(raws[r])
                n = len(s) - WIDTH + 1
                h = p["filters"][0][s[:n]]
                for k in range(1, WIDTH):
                    h = h + p["filters"][k][s[k:k + n]]
                units = n // UNIT
                h = h.reshape(units, UNIT, FILTERS)
                win = h.argmax(axis=1) + (np.arange(units) * UNIT)[:, None]
                top = h.max(axis=1) + p["bias"]
                if units > 1:
                    pick = top[1:] > top[:-1]
                    win, top = np.where(pick, win[1:], win[:-1]), np.where(pick, top[1:], top[:-1])
                act = np.maximum(top, 0)
                z = float((act @ p["dense"]).mean() + p["offset"][0])
                d = weight[r] * (1 / (1 + np.exp(-z)) - y[r]) / len(rows)
                g["offset"] += d
                g["dense"] += d * act.mean(axis=0)
                back = d / len(act) * p["dense"] * (top > 0)
                g["bias"] += back.sum(axis=0)
                col = np.broadcast_to(np.arange(FILTERS), win.shape)
                for k in range(WIDTH):
                    np.add.at(g["filters"][k], (s[win + k], col), back)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(p["filters"], p["bias"], p["dense"].astype(np.float32), float(p["offset"][0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """Network trained on a bounded sample of labelled rows that are not held out; None without both classes."""
    rows = labelled_sample(docs, labels.where(id_bucket("doc_id", FOLDS) != HELD), per_class)
    y = np.array([q for _, q in rows], float)
    return fit([t for t, _ in rows], y) if len(set(y)) == 2 else None


def _scored(docs: DataFrame, net: Network | None, score: str, predicted: str) -> DataFrame:
    """docs with two more columns of the given names."""
    small_batches(docs.sparkSession)

    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        tables = net.pairs() if net is not None else []
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(at)]
            p = np.full(len(texts), 0.5)
            if net is not None and texts:
                p = 1 / (1 + np.exp(-np.clip(logits(texts, net, tables).astype(float), -60, 60)))
            yield [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return with_columns(docs, rows, [score, predicted], ["double", "int"])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with score double and predicted int, which replace columns of these names; the text is read whole."""
    return _scored(docs.drop("score", "predicted"), net, "score", "predicted")


def keep(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows that the network doesn't reject, with their own columns."""
    score, predicted = unused(docs, "score", "predicted")
    return _scored(docs, net, score, predicted).where(F.col(predicted) == 1).drop(score, predicted)
