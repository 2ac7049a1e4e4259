"""Line dedup by a segment-partition edit join.

Lines that equal an earlier line go, and lines within a few edits of an earlier
different line go.  "Earlier" is by document id, then line number.  A line of
n code points tolerates tolerance(n) edits (the shorter line of a pair counts).

Equal lines fall into classes by two hashes.  Near lines: a line of tolerance t
is cut into t + 1 segments, one of which any line within t edits contains,
shifted by few positions.  Every line thus indexes its segments under (length,
ordinal, hash) and probes, for each length it may be near to, the substrings at
the shifts that can't be excluded.  Index and probe rows of a key meet in one
task, sorted, and stream through it.  A row carries a 64-bit sketch of its line
that bounds the edits from below, so that lines which share a segment only
don't become pairs.  Pairs are verified by a banded bit-parallel edit distance,
run over many pairs at once.

A key that more than HOT_LINES lines share makes no pairs there.  Its lines are
dealt over tasks: all are first held against the key's earliest lines, and those
that none of these settles are then held against all others, in a grid of parts.
A line needs one earlier near line to go, so this gives a row per line, not per
pair.

Defined results: blank lines stay and link to nothing; a null text stays null;
lines of rows with a null id come after all others; rows that repeat both id
and text keep the same lines; very long lines are treated whole; an empty table
gives none; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.common import materialise, measured, quoted, small_batches, tidied, unused
from quadrel.operators.ordering import ordinals

MAX_EDITS = 2
MARGIN = 8
#: Code points a line needs for each tolerated edit.
CHARS_PER_EDIT = 16
#: Lines that share a segment (at most) to be paired where they meet.
HOT_LINES = 256
#: Lines of a hot segment that a task holds; as many of the earliest are tried first.
HELD_LINES, EARLIEST = 4096, 64
#: Hashes of lines that a task remembers, to sign a repeated line once.
SEEN_LINES = 1 << 18
#: Code points (about) whose segments are hashed at once; a longer line is taken alone.
BLOCK = 1 << 20

_BLANK = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def tolerance(n: np.ndarray) -> np.ndarray:
    """Edits that a line of n code points tolerates."""
    return np.minimum(MAX_EDITS, n // CHARS_PER_EDIT)


def _grow(size: int) -> None:
    """Powers of the hash base and of its inverse up to size."""
    global _powers, _inverse
    if len(_powers) < size:
        size = max(size, BLOCK + (BLOCK >> 1))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, np.uint64))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])


def _forget() -> None:
    """Drop the powers: a worker outlives its task."""
    global _powers, _inverse
    _powers = _inverse = np.ones(1, np.uint64)


def segments(n: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of parts in lines of n code points; later segments take the remainder."""
    short, more = n // parts, n % parts
    long_before = np.maximum(0, i - (parts - more))
    return short * i + long_before, short + (i >= parts - more)


def sketches(code: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Parities of hashed letter pairs, 64 bits a line: an edit flips at most four of them."""
    with np.errstate(over="ignore"):
        pair = (code[:-1] * np.uint64(0x9E3779B1) + code[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    bit = np.concatenate([np.uint64(1) << (pair >> np.uint64(58)), np.zeros(1, np.uint64)])
    bit[begin + length - 1] = 0  # no pair across lines
    return np.bitwise_xor.reduceat(bit, begin)


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line ordinal, key, sketch of each line); a key's last bit is 0 for index rows and 1 for probe rows."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(length) - length
    _grow(int(length.sum()) + 1)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ordinal, key = [], []
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * _powers[:len(code)], dtype=np.uint64)])

        def put(rows: np.ndarray, at: np.ndarray, size: np.ndarray, whole: np.ndarray, i: int, kind: int) -> None:
            a = begin[rows] + at
            h = (prefix[a + size] - prefix[a]) * _inverse[a]
            h = (h ^ (whole.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(i)) * np.uint64(0xFF51AFD7ED558CCD)
            ordinal.append(rows)
            key.append((((h ^ (h >> np.uint64(33))) << np.uint64(1)) | np.uint64(kind)).view(np.int64))

        for t in range(1, MAX_EDITS + 1):
            rows = np.flatnonzero(tolerance(length) == t)
            for i in range(t + 1):
                at, size = segments(length[rows], t + 1, i)
                put(rows, at, size, length[rows], i, 0)
            for delta in range(t + 1):  # this line is longer by delta than the indexed one
                rows = np.flatnonzero(tolerance(length - delta) == t)
                for i in range(t + 1):
                    at, size = segments(length[rows] - delta, t + 1, i)
                    for shift in range(max(-i, delta - (t - i)), min(i, delta + (t - i)) + 1):
                        ok = (at + shift >= 0) & (at + shift + size <= length[rows])
                        put(rows[ok], (at + shift)[ok], size[ok], (length[rows] - delta)[ok], i, 1)
    return np.concatenate(ordinal), np.concatenate(key), sketches(code, begin, length)


def long_signature(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch) of one line, as signatures() gives them, worked BLOCK code points at a time."""
    n = len(line)
    _grow(BLOCK + 1)

    def codes(at: int, to: int) -> np.ndarray:
        return np.frombuffer(line[at:to].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def key(at: int, size: int, whole: int, i: int, kind: int) -> int:
        h, scale = 0, 1
        for lo in range(at, at + size, BLOCK):
            part = codes(lo, min(lo + BLOCK, at + size)) + np.uint64(1)
            h += scale * int((part * _powers[:len(part)]).sum(dtype=np.uint64))
            scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
        h = ((h ^ (whole * 0xD6E8FEB86659FD93) ^ i) * 0xFF51AFD7ED558CCD) % (1 << 64)
        return ((h ^ (h >> 33)) << 1 | kind) % (1 << 64)

    keys, t = [], MAX_EDITS
    one = lambda size, i: tuple(int(x[0]) for x in segments(np.array([size]), t + 1, i))
    for i in range(t + 1):
        keys.append(key(*one(n, i), n, i, 0))
    for delta in range(t + 1):
        for i in range(t + 1):
            at, size = one(n - delta, i)
            for shift in range(max(-i, delta - (t - i)), min(i, delta + (t - i)) + 1):
                if at + shift >= 0 and at + shift + size <= n:
                    keys.append(key(at + shift, size, n - delta, i, 1))
    sketch = 0
    for lo in range(0, n - 1, BLOCK):
        code = codes(lo, min(lo + BLOCK + 1, n))  # the last letter begins the next block's first pair
        sketch ^= int(sketches(code, np.zeros(1, np.int64), np.array([len(code)]))[0])
    return np.array(keys, np.uint64).view(np.int64), np.array([sketch], np.uint64)


@tidied
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to signature rows (key, id, sketch) of their distinct lines; a task signs a line it remembers once."""
    import xxhash

    def out(some: dict[int, str]) -> pa.RecordBatch:
        ids = np.fromiter(some, np.uint64, len(some)).view(np.int64)
        lines = list(some.values())
        if len(lines) == 1 and len(lines[0]) > BLOCK:
            key, sketch = long_signature(lines[0])
            ordinal = np.zeros(len(key), np.int64)
        else:
            ordinal, key, sketch = signatures(lines)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[ordinal]), pa.array(sketch[ordinal].view(np.int64))], ["key", "id", "sketch"])

    seen: set[int] = set()
    for batch in batches:
        lines = {x for t in batch.column("text") if t.is_valid for x in t.as_py().split("\n") if len(x) >= CHARS_PER_EDIT and x.strip(_BLANK)}
        some, size = {}, 0
        for x in lines:
            mark = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42)
            if mark in seen:
                continue
            seen.add(mark)
            if len(x) > BLOCK:
                yield out({mark: x})
                continue
            some[mark] = x
            size += len(x)
            if size >= BLOCK:
                yield out(some)
                some, size = {}, 0
        if some:
            yield out(some)
        if len(seen) > SEEN_LINES:
            seen.clear()
    _forget()


@tidied
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id to rows (a, b, hot).

    Not hot: a pair of different lines that meet as index and probe and whose
    sketches don't rule them out.  Hot: a segment of more than HOT_LINES rows
    and the id of a line that has it.
    """

    def batch_of(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def pairs(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        role = key & 1
        start = np.flatnonzero(np.concatenate([[True], (key[1:] >> 1) != (key[:-1] >> 1)]))
        size = np.diff(np.append(start, len(key)))
        probes = np.add.reduceat(role, start)
        low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
        for k in np.flatnonzero((low != high) & (probes > 0) & (probes < size)):
            part = slice(start[k], start[k] + size[k])
            if size[k] > HOT_LINES:
                yield batch_of(key[part] >> 1, ids[part], True)
                continue
            index, probe = role[part] == 0, role[part] == 1
            i0, i1, s0, s1 = ids[part][index], ids[part][probe], sketch[part][index].view(np.uint64), sketch[part][probe].view(np.uint64)
            x, y = np.nonzero((np.bitwise_count(s0[:, None] ^ s1[None, :]) <= 4 * MAX_EDITS) & (i0[:, None] != i1[None, :]))
            if len(x):
                yield batch_of(np.minimum(i0[x], i1[y]), np.maximum(i0[x], i1[y]), False)

    def gathered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in found:
            held.append(x)
            n += len(x)
            if n >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def runs() -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        hot: int | None = None  # the last segment, if it is hot and may go on
        for batch in batches:
            cols = [np.concatenate([r, batch.column(n).to_numpy(zero_copy_only=False)]) for r, n in zip(rest, ("key", "id", "sketch"), strict=True)]
            if not len(cols[0]):
                continue
            # What several tasks signed comes in a row and counts once.
            fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            cols = [c[fresh] for c in cols]
            if hot is not None:
                same = int(np.searchsorted(cols[0] >> 1, hot, side="right"))
                if same:
                    yield batch_of(cols[0][:same] >> 1, cols[1][:same], True)
                    cols = [c[same:] for c in cols]
                if not len(cols[0]):
                    rest = cols
                    continue
                hot = None
            cut = int(np.searchsorted(cols[0] >> 1, cols[0][-1] >> 1))  # the last run may go on
            if cut:
                yield from pairs(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
            if len(rest[0]) > HOT_LINES:
                hot = int(rest[0][-1] >> 1)
                yield batch_of(rest[0] >> 1, rest[1], True)
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield from pairs(*rest)

    return gathered(runs())


def edit_distances(longer: list[str], shorter: list[str], limit: int = MAX_EDITS) -> np.ndarray:
    """Edit distances up to limit (limit + 1 beyond it) of pairs whose lengths differ by at most limit.

    Bit 2 * limit of a pair's word is the diagonal that leads to the band's
    lower edge; the band moves down one row with each column, and at the last
    row the score is carried along it instead.
    """
    n1 = np.fromiter(map(len, longer), np.int64, len(longer))
    n2 = np.fromiter(map(len, shorter), np.int64, len(shorter))
    width = 2 * limit + 1
    rows, cols = int(n1.max(initial=0)), int(n2.max(initial=0))
    a = np.zeros((len(longer), rows + 2 * width), np.uint32)
    b = np.full((len(shorter), cols), 0xFFFFFFFF, np.uint32)
    for k, (x, y) in enumerate(zip(longer, shorter, strict=True)):
        a[k, width:width + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        b[k, :len(y)] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    a, b = np.asfortranarray(a), np.asfortranarray(b)
    full = np.uint32((1 << width) - 1)
    vp = np.full(len(n1), ((1 << (limit + 1)) - 1) << limit, np.uint32)
    vn = np.zeros(len(n1), np.uint32)
    score = np.full(len(n1), limit, np.int64)
    one, top = np.uint32(1), np.uint32(2 * limit)
    for j in range(cols):
        eq = np.zeros(len(n1), np.uint32)
        for k in range(width):  # bit k: row j - limit + k
            eq |= (a[:, width + j - limit + k] == b[:, j]).astype(np.uint32) << np.uint32(k)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        down = j < n1 - limit
        score += np.where(down, 1 - ((d0 >> top) & one).astype(np.int64), 0)
        over = np.flatnonzero(~down & (j < n2))
        if len(over):
            bit = (2 * limit - 1 - (j - (n1[over] - limit))).astype(np.uint32)
            score[over] += ((hp[over] >> bit) & one).astype(np.int64) - ((hn[over] >> bit) & one).astype(np.int64)
        d0 >>= one
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
    return np.minimum(score, limit + 1)


def _alike(same: Callable[[int], bool], most: int) -> int:
    """The largest k up to most with same(k), which holds up to some k and fails beyond."""
    low, step = 0, 64
    while low + step <= most and same(low + step):
        low, step = low + step, 2 * step
    high = min(low + step, most + 1)  # same(high) fails, or high is beyond most
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if same(mid) else (low, mid)
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two lines without what they begin and end with alike, which takes no edits; MARGIN code points of it stay, for the band to start in."""
    head = max(0, _alike(lambda k: a[:k] == b[:k], min(len(a), len(b))) - MARGIN)
    a, b = a[head:], b[head:]
    tail = max(0, _alike(lambda k: k == 0 or a[-k:] == b[-k:], min(len(a), len(b))) - MARGIN)
    return (a[:-tail], b[:-tail]) if tail else (a, b)


def _near(x: list[str], y: list[str]) -> np.ndarray:
    """Whether lines, pair by pair, are within the shorter one's tolerance."""
    edits = tolerance(np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64))
    left = [_trimmed(max(a, b, key=len), min(b, a, key=len)) for a, b in zip(x, y, strict=True)]
    order = sorted(range(len(left)), key=lambda i: len(left[i][1]))
    keep = np.zeros(len(x), bool)
    for at in range(0, len(order), 512):
        part = order[at:at + 512]
        keep[part] = edit_distances([left[i][0] for i in part], [left[i][1] for i in part]) <= edits[part]
    return keep


@tidied
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lines (line_a, line_b) to the keys (h1, h2) of the later of each near pair; order: whether a is the later."""
    for batch in batches:
        keep = _near(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())
        kept = batch.filter(pa.array(keep))
        late = kept.column("a_late").to_numpy(zero_copy_only=False).astype(bool)
        pick = lambda a, b: pa.array(np.where(late, kept.column(a).to_numpy(), kept.column(b).to_numpy()))
        yield pa.RecordBatch.from_arrays([pick("a1", "b1"), pick("a2", "b2")], ["h1", "h2"])


class _Side:
    """Some lines of a hot segment, with what tells quickly that two aren't near."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        lines = [r["line"] for r in rows]
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sketch = sketches(code, np.cumsum(self.size) - self.size, self.size) if lines else np.zeros(0, np.uint64)
        self.first = np.fromiter((r["place"] for r in rows), np.int64, len(rows))

    def take(self, at: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        out.rows, out.size, out.sketch, out.first = [self.rows[i] for i in at], self.size[at], self.sketch[at], self.first[at]
        return out


def _settled(later: _Side, earlier: _Side) -> np.ndarray:
    """Which of later have an earlier near line among earlier; a line that has one is held against no more."""
    done = np.zeros(len(later.rows), bool)
    for at in range(0, len(earlier.rows), 32):
        left, some = np.flatnonzero(~done), np.arange(at, min(at + 32, len(earlier.rows)))
        edits = tolerance(np.minimum(later.size[left, None], earlier.size[None, some]))
        may = (np.bitwise_count(later.sketch[left, None] ^ earlier.sketch[None, some]) <= 4 * edits) & (np.abs(later.size[left, None] - earlier.size[None, some]) <= edits)
        x, y = np.nonzero(may & (earlier.first[None, some] < later.first[left, None]))
        if len(x):
            near = _near([later.rows[left[i]]["line"] for i in x], [earlier.rows[some[j]]["line"] for j in y])
            done[left[x[near]]] = True
    return done


def _hold(held_is_late: bool):
    """Rows sorted by (part, streamed): of each part, the held lines come first and stay; the others stream by.  Gives the lines that an earlier near line settles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: object = None
        held: list[dict] = []
        side: _Side | None = None

        def out(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], pa.int64()) for c in ("h1", "h2")], ["h1", "h2"])

        for batch in batches:
            found = batch.to_pylist()
            at = 0
            while at < len(found):
                key = (found[at]["seg"], found[at]["x"], found[at]["y"])
                if key != part:
                    part, held, side = key, [], None
                to = at
                while to < len(found) and not found[to]["streamed"] and (found[to]["seg"], found[to]["x"], found[to]["y"]) == key:
                    to += 1
                held += found[at:to]
                at = to
                while to < len(found) and found[to]["streamed"] and (found[to]["seg"], found[to]["x"], found[to]["y"]) == key:
                    to += 1
                if to > at:
                    side = side or _Side(held)
                    by = _Side(found[at:to])
                    if held_is_late:
                        done = _settled(side, by)
                        if done.any():
                            yield out([side.rows[i] for i in np.flatnonzero(done)])
                            side = side.take(np.flatnonzero(~done))
                    else:
                        done = _settled(by, side)
                        if done.any():
                            yield out([by.rows[i] for i in np.flatnonzero(done)])
                at = to

    return tidied(rows)


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """A document's place: its id, nulls last, then a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, no, line) of the lines that aren't blank."""
    doc, th = _place(docs)
    return docs.where(F.col("text").isNotNull()).select(doc.alias("doc"), th.alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(r"\S"))


def _parts(df: DataFrame, lines: DataFrame, x: Column, y: Column, streamed: bool) -> DataFrame:
    """(seg, x, y, streamed, h1, h2, place, line): lines (seg, h1, h2) as rows of the parts x, y of their segment; the lines' texts are joined here."""
    at = df.select("seg", "h1", "h2", x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(streamed).alias("streamed"))
    return at.join(lines, ["h1", "h2"]).select("seg", "x", "y", "streamed", "h1", "h2", "place", "line")


def _held(rows: DataFrame, held_is_late: bool) -> DataFrame:
    by = ["seg", "x", "y"]
    return rows.repartition(*by).sortWithinPartitions(*by, "streamed").mapInArrow(_hold(held_is_late), "h1 long, h2 long").distinct()


def _hot_late(hot: DataFrame, lines: DataFrame, held: int = HELD_LINES, earliest: int = EARLIEST) -> DataFrame:
    """(h1, h2) of the lines of hot segments that have an earlier near line there.

    hot: (seg, id); lines: (h1, h2, line, place).  Targets are all lines, then those not settled yet.
    """
    members = materialise(hot.distinct().join(lines.select("h1", "h2", "place"), F.col("id") == F.col("h1")).select("seg", "h1", "h2", "place"), "line-hot")
    spread = lambda n, of: F.pmod(F.xxhash64(F.lit(of), "h1", "h2"), n)
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / held))
    sizes = members.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    known = members.join(sizes, "seg").withColumn("w", parts(F.col("n")))
    # First the earliest lines of each segment against all of it: they go to every part, the others to one.
    order = Window.partitionBy("seg").orderBy("place")
    early = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= earliest).drop("rank")
    early = materialise(early, "line-early")
    zero = F.lit(0)
    asked = _parts(known, lines, spread(F.col("w"), 1), zero, True)
    told = _parts(early.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))), lines, F.col("k"), zero, False)
    settled = materialise(_held(asked.unionByName(told), False), "line-late-early")
    # Then what is left against all lines: left lines in t parts, all lines in w parts, each part of one meets each of the other.
    left = members.join(settled, ["h1", "h2"], "left_anti").join(early.select("seg", "h1", "h2"), ["seg", "h1", "h2"], "left_anti")
    left = materialise(left, "line-left")
    more = left.groupBy("seg").agg(parts(F.count(F.lit(1))).alias("t"))
    both = known.join(more, "seg")
    told = _parts(both.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))), lines, spread(F.col("w"), 1), F.col("k"), True)
    asked = left.join(both.select("seg", "w", "t").distinct(), "seg")
    asked = _parts(asked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))), lines, F.col("k"), spread(F.col("t"), 2), False)
    return settled.unionByName(_held(asked.unionByName(told), True))


def late_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that an earlier, different line is near to."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(_sign, "key long, id long, sketch long")
    met = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "id").mapInArrow(_meet, "a long, b long, hot boolean").distinct()
    met = materialise(met, "line-pairs")
    pairs, hot = met.where(~F.col("hot")), met.where("hot").select(F.col("a").alias("seg"), F.col("b").alias("id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h1")).unionByName(hot.select(F.col("id").alias("h1")))
    wanted = materialise(wanted.distinct(), "line-ids")
    h1, h2 = _hashes(F.col("line"))
    some = _lines(docs).select("doc", "th", "no", h1.alias("h1"), h2.alias("h2"), "line").join(wanted, "h1", "left_semi")
    texts = some.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(F.struct("doc", "th", "no")).alias("first"))
    texts = materialise(texts, "line-texts")
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("line_a"), F.col("first").alias("first_a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("line_b"), F.col("first").alias("first_b"))
    both = pairs.join(a, F.col("a") == F.col("a1")).join(b, F.col("b") == F.col("b1")).where(F.abs(F.length("line_a") - F.length("line_b")) <= MAX_EDITS)
    late = both.select("a1", "a2", "b1", "b2", "line_a", "line_b", (F.col("first_a") > F.col("first_b")).alias("a_late")).mapInArrow(_verify, "h1 long, h2 long")
    if not hot.isEmpty():
        lines = texts.join(hot.select(F.col("id").alias("h1")).distinct(), "h1", "left_semi")
        late = late.unionByName(_hot_late(hot, ordinals(lines, "first", "place").select("h1", "h2", "line", "place")))
    return late.distinct()


def decisions(docs: DataFrame) -> DataFrame:
    """(doc, th, no, near) of every line to drop; near: not a plain copy."""
    h1, h2 = _hashes(F.col("line"))
    lines = materialise(_lines(docs).select("doc", "th", "no", h1.alias("h1"), h2.alias("h2")), "lines")
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    late = materialise(late_lines(docs).withColumn("late", F.lit(True)), "line-late")
    # Only classes that lose a line meet their lines again.  They are written first: only between plain reads can Spark split the lines of a hot class.
    losing = measured(first.join(late, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("late")).drop("n"), "line-losing")
    again = F.struct("doc", "th", "no") != F.col("first")
    return lines.join(losing, ["h1", "h2"]).where(again | F.col("late")).select("doc", "th", "no", (~again).alias("near")).distinct()


def _rebuilt(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with text rid of its dropped lines and three more columns (long): lines, plain copies and near copies; their names."""
    doc_, th_, no_, near_, *made = unused(docs, "doc", "th", "no", "near", "lines", "exact", "nears")
    drop = decisions(docs).groupBy(F.col("doc").alias(doc_), F.col("th").alias(th_)).agg(
        F.collect_list("no").alias(no_), F.sum(F.col("near").cast("long")).alias(near_))  # lines of one document
    doc, th = _place(docs)
    # By shuffle at every size: what is dropped grows with the documents.
    joined = docs.join(drop.hint("shuffle_hash"), (doc == F.col(doc_)) & (th == F.col(th_)), "left")
    gone = F.col(no_)
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)  # by a hash set, in order
    left = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(left)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"\S"))), F.lit(0)))
    near = F.coalesce(F.col(near_), F.lit(0))
    exact = F.coalesce(F.size(gone), F.lit(0)) - near
    return joined.select(*[text.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns],
                         *[x.cast("long").alias(name) for x, name in zip((n, exact, near), made, strict=True)]), made


def annotate(docs: DataFrame) -> DataFrame:
    """docs with text rid of its dropped lines, and n_lines, n_exact, n_near (long), which replace columns of these names."""
    found, made = _rebuilt(docs)
    names = ("n_lines", "n_exact", "n_near")
    return found.drop(*names).withColumnsRenamed(dict(zip(made, names, strict=True)))


def dedup(docs: DataFrame) -> DataFrame:
    """docs, texts rid of lines that repeat or nearly repeat an earlier line."""
    found, made = _rebuilt(docs)
    return found.drop(*made)
