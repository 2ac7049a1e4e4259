"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints have 64 bits: bit b is 1 if over half of the document's shingle
hashes (XXH64, seed 42) have it.  Two fingerprints link if at most THRESHOLD
bits differ.  The search groups correlated bits into m partitions and gives
partition i a threshold t_i with sum(t_i + 1) = THRESHOLD + 1: linked pairs
then differ by at most t_i bits in some partition i.  Dynamic programming over
estimated candidate counts picks m and the t_i.  Each fingerprint probes, for
partition i, all keys within t_i bits; what meets there is verified over all
64 bits.  Components come from alternating large-star and small-star steps.

Only distinct fingerprints are searched, so any number of copies costs one.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; fewer words than a shingle make one shingle; a null doc_id
keeps its row and never names a component unless all ids there are null;
repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import materialise, measured, small_batches, tidied, unused

THRESHOLD = 4
SHINGLE = 4
#: Fingerprints (at most) on which partitions and thresholds are fitted; every fingerprint is searched.
FIT_SAMPLE = 8192


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns: 255 rows at a time fit a byte."""
    out = np.zeros(bits.shape[1], np.int64)
    whole = len(bits) // 255 * 255
    if whole:
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += _column_sums(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp) of every row; fp's 64 bits are the fingerprint, th is a hash of the text."""
    small_batches(docs.sparkSession)

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return some.withColumn("th", F.xxhash64("text")).mapInArrow(rows, "doc_id long, th long, fp long")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bit positions in m groups of like size, correlated bits together.  bits: a 0/1 row per fingerprint."""
    if len(bits) > 1:
        x = bits - bits.mean(axis=0)
        scale = np.sqrt((x * x).sum(axis=0))
        scale[scale == 0] = 1
        x = x / scale
        corr = np.abs(x.T @ x)
    else:
        corr = np.zeros((64, 64))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        mine = [left.pop(int(np.argmax([corr[b, left].sum() for b in left])))]
        while len(mine) < size:
            mine.append(left.pop(int(np.argmax(corr[np.ix_(left, mine)].sum(axis=1)))))
        groups.append(sorted(mine))
    return groups


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def allocate(sample: np.ndarray, total: int, threshold: int = THRESHOLD, choices: tuple[int, ...] = (1, 2, 3, 4, 5)) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated work for total fingerprints.

    Work of a partition under t: probes (every key within t bits) plus expected
    candidates (share of sample pairs within t bits there, times all pairs).
    t = -1 leaves a partition out.  Dynamic programming spends threshold + 1
    units over the partitions, t + 1 on each.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    probe = sample[: min(len(sample), 512)]
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in choices:
        groups = group_bits(bits, m)
        cost = np.full((m, threshold + 2), np.inf)
        for i, g in enumerate(groups):
            mask = np.uint64(sum(1 << b for b in g))
            d = _popcount((probe[:, None] ^ sample[None, :]) & mask)
            seen = np.bincount(d.ravel(), minlength=65) / max(1, d.size)
            # What the sample can't see (rare coincidences) is estimated as for independent bits.
            size, keys = len(g), 0.0
            cost[i, 0] = 0.0
            for t in range(threshold + 1):
                if t > size:
                    break
                ball = len(list(combinations(range(size), t)))
                keys += ball
                if keys > 4096:
                    break
                share = max(seen[: t + 1].sum() - 1.0 / max(1, len(sample)), keys / 2.0**size)
                cost[i, t + 1] = total * (keys + 1) + share * total * total / 2
        spend = np.full((m + 1, threshold + 2), np.inf)
        take = np.zeros((m + 1, threshold + 2), int)
        spend[0, 0] = 0
        for i in range(m):
            for u in range(threshold + 2):
                for k in range(u + 1):
                    if (c := spend[i, u - k] + cost[i, k]) < spend[i + 1, u]:
                        spend[i + 1, u], take[i + 1, u] = c, k
        if best is None or spend[m, threshold + 1] < best[0]:
            u, ts = threshold + 1, []
            for i in range(m, 0, -1):
                ts.append(take[i, u] - 1)
                u -= take[i, u]
            best = (spend[m, threshold + 1], groups, [int(t) for t in ts[::-1]])
    assert best is not None and sum(t + 1 for t in best[2]) == threshold + 1
    return best[1], best[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) for linked fingerprints a < b of distinct (column fp, no value twice)."""
    total = distinct.count()
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(FIT_SAMPLE).collect()], np.int64).view(np.uint64)
    if total < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    groups, thresholds = allocate(sample, total, threshold)
    index, probes = [], []
    for p, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        mask = F.lit(_signed(sum(1 << b for b in g))).cast("long")
        key = F.col("fp").bitwiseAND(mask)
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(g, k)]
        index.append(F.struct(F.lit(p).alias("p"), key.alias("key")))
        probes.append((p, key, flips))
    held = distinct.select(F.explode(F.array(*index)).alias("k"), F.col("fp").alias("a")).select("k.p", "k.key", "a")
    asked = None
    for p, key, flips in probes:
        part = distinct.select(F.lit(p).alias("p"), F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("x"), F.col("fp").alias("b"), key.alias("base"))
        part = part.select("p", F.col("base").bitwiseXOR(F.col("x")).alias("key"), "b")
        asked = part if asked is None else asked.unionByName(part)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return held.join(asked, ["p", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches.

    Alternating large-star and small-star steps; every step writes its edges to
    the shared folder, and the driver sees two counters only.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), tag)
    last = None
    while True:
        # Large star: each node points its larger neighbours to the smallest node near it.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: each node points itself and its smaller neighbours to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if last == tuple(state):
            break
        last = tuple(state)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def dedup(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp, component_id, component_th) for every row of docs (doc_id, text): the component's smallest id and text hash."""
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("th").alias("low")), "distinct")
    comps = components(links(distinct, threshold))
    rooted = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("low").alias("component_th"))
    named = rooted.join(smallest, "root").select("fp", "component_id", "component_th")
    return fps.join(named, "fp").select("doc_id", "th", "fp", "component_id", "component_th")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest id (without any id: with its smallest text hash)."""
    d, t = unused(docs, "doc", "th")
    named = dedup(docs, threshold, shingle)
    stays = F.when(F.col("component_id").isNull(), F.col("th") == F.col("component_th")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    gone = measured(named.where(~stays).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "near-duplicates")
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (th == F.col(t)), "left_anti")


def hexed(found: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) with 16 lowercase hex digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
