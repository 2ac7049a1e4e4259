"""BPE encoding and decoding by a table of distinct words.

The corpus is dealt into chunks of bounded size by a hash of the rows.  Each
chunk's distinct words go, sorted and packed, to the word table's buckets: a
word belongs to one bucket, so it is encoded once however many chunks hold it.
The ids travel back to the chunks, where every document gets its ids by word
position.  Decoding joins the distinct ids of some documents to the vocabulary's
(id, piece) table, whose size the tokenizer file fixes, and puts the pieces back
by position.

Defined results: a null text is an empty text (no ids, empty decoded text);
repeated rows each give a row; very long texts are encoded whole; an empty
table gives an empty result; other columns of the input don't matter.  An id
that the vocabulary lacks fails decoding.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import small_batches, tidied, tidy, with_columns

#: Raw bytes of text in a chunk, about; of a small table, that makes fewer than LEAST_CHUNKS, at least LEAST_BYTES.
CHUNK_BYTES = 8 << 20
LEAST_CHUNKS, LEAST_BYTES = 48, 1 << 19
#: Documents whose ids a task works out at once.
PART_ROWS = 512
#: Distinct words a task holds before it hands them on; a later repeat costs a few bytes, not a result.
HELD_WORDS = 250_000

# Character classes of the split pattern within Latin-1.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_SIMPLE = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa0-\xff]*")
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


@lru_cache(maxsize=1)
def _told(path: str) -> tuple[dict[str, int], pa.Table]:
    """What the tokenizer file tells: added tokens, and (id, piece) of all; the only thing that a worker keeps."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = {a["content"]: a["id"] for a in told["added_tokens"]}
    ids = told["model"]["vocab"] | added
    return added, pa.table({"id": pa.array(ids.values(), pa.int32()), "piece": pa.array(ids.keys(), pa.string())})


class Splitter:
    """Splits a text as the tokenizer does: added tokens, normaliser, split pattern."""

    def __init__(self, path: str):
        self.path = path
        self.added = _told(path)[0]
        self.parts = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    @cached_property
    def tokenizer(self):
        """Loaded where merges or other scripts need it only: it takes much of a worker's memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """Words in order; an added token stands for itself behind a NUL, which no split word starts with."""
        if self.parts is not None and "<|" in text:
            out: list[str] = []
            for piece in self.parts.split(text):
                out += ["\0" + piece] if piece in self.added else self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _SIMPLE.fullmatch(text):
            return _WORDS.findall(text.lower())
        # The pattern's own engine decides for other scripts; spans refer to the normalised text.
        text = self.tokenizer.normalizer.normalize_str(text)
        return ["\1" + w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, word: str) -> list[int]:
        """Ids of one split word, by the tokenizer's merges."""
        if word[0] == "\0":
            return [self.added[word[1:]]]
        if word[0] == "\1":
            mapped = word[1:]
        else:
            mapped = "".join(_BYTE_CHARS[b] for b in word.encode("utf-8"))
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


_BYTE_CHARS = _byte_chars()


def _pack(words: list[str]) -> bytes:
    import zstandard

    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(struct.pack("<I", len(raw)) + np.array([len(r) for r in raw], np.uint32).tobytes() + b"".join(raw), 3)


def _unpack(blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4)).tolist()
    at, out = 4 + 4 * n, []
    start = at
    for e in ends:
        out.append(data[start:at + e])
        start = at + e
    return out


def _flush(chunk: int, words: set[str], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    parts: dict[int, list[str]] = {}
    for w in words:
        parts.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    for b, ws in parts.items():
        yield b, chunk, _pack(sorted(ws))


def _collect_words(path: str, buckets: int):
    """The distinct words of each chunk, packed by bucket; a task holds whole chunks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        split, expand = Splitter(path), zstandard.decompress
        seen: dict[int, set[str]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for c, words in seen.items():
                found = list(_flush(c, words, buckets))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                        ["bucket", "chunk", "words"])

        for batch in batches:
            texts = batch.column("text")
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                mine = seen.setdefault(chunk, set())
                before = len(mine)
                mine.update(split.words(expand(texts[i].as_py()).decode("utf-8", "surrogatepass")))
                held += len(mine) - before
                if held > HELD_WORDS:
                    yield from out()
                    seen, held = {}, 0
        yield from out()

    return tidied(rows)


def _encode_bucket(path: str):
    """One bucket of the word table: every distinct word is encoded once, ids go back to each chunk."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        split = Splitter(path)
        known: dict[bytes, bytes] = {}
        ids_out = []
        for blob in table.column("words"):
            words = _unpack(blob.as_py())
            ids = []
            for w in words:
                got = known.get(w)
                if got is None:
                    got = known[w] = np.array(split.encode(w.decode("utf-8", "surrogatepass")), np.uint32).tobytes()
                ids.append(got)
            lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
            ids_out.append(zstandard.compress(lengths.tobytes() + b"".join(ids), 3))
        known.clear()
        tidy()
        return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "words": table.column("words").cast(pa.binary()), "ids": pa.array(ids_out, pa.binary())})

    return run


@tidied
def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go compressed to their chunk."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        k = batch.schema.get_field_index("text")
        packed = pa.array([squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(k)], pa.binary())
        yield batch.set_column(k, "text", packed)


def _word_ids(table: pa.Table) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words with their numbers; by number, where a word's ids begin and how many they are; all ids."""
    import zstandard

    index: dict[str, int] = {}
    lengths, flats = [], []
    for words, ids in zip(table.column("words"), table.column("ids"), strict=True):
        names = _unpack(words.as_py())
        data = zstandard.decompress(ids.as_py())
        size = np.frombuffer(data, np.uint32, len(names)).astype(np.int64)
        flat = np.frombuffer(data, np.uint32, offset=4 * len(names))
        fresh = np.zeros(len(names), bool)  # a word that came from two tasks keeps its first ids
        for i, w in enumerate(names):
            before = len(index)
            index.setdefault(w.decode("utf-8", "surrogatepass"), before)
            fresh[i] = len(index) > before
        if not fresh.all():
            flat, size = flat[np.repeat(fresh, size)], size[fresh]
        lengths.append(size)
        flats.append(flat)
    size = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    flat = np.concatenate(flats).astype(np.int32) if flats else np.empty(0, np.int32)
    return index, np.cumsum(size) - size, size, flat


def _apply_chunk(path: str, decoded: bool):
    """Reduce side: the ids of each document of a chunk, joined back by word position; its pieces too, if asked for."""

    def run(_key, docs: pa.Table, table: pa.Table) -> pa.Table:
        import zstandard

        split, expand = Splitter(path), zstandard.decompress
        index, start, size, flat = _word_ids(table)
        pieces = vocabulary(path) if decoded else None
        out = []
        for lo in range(0, docs.num_rows, PART_ROWS):
            part = docs.slice(lo, PART_ROWS)
            values, ends = [], [0]
            for packed in part.column("text"):
                text = expand(packed.as_py()).decode("utf-8", "surrogatepass")
                at = np.fromiter(map(index.__getitem__, split.words(text)), np.int64)
                n = size[at]
                total = int(n.sum())
                first = np.repeat(start[at] - (np.cumsum(n) - n), n)
                values.append(flat[first + np.arange(total)])
                ends.append(ends[-1] + total)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int32()))
            found = {"doc_id": part.column("doc_id").cast(pa.int64()), "ids": ids}
            if pieces is not None:
                found["text"] = _joined(ids, pieces)
            out.append(pa.table(found))
        made = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded
        result = pa.concat_tables(out) if out else pa.schema(made).empty_table()
        tidy()
        return result

    return run


def encode(docs: DataFrame, tokenizer: str, chunk_bytes: int = CHUNK_BYTES, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text), added tokens recognised, none put in.

    decoded adds text, which decode() would give, where the ids are made: they need not travel again.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    chunks = max(1, -(-size // chunk_bytes), min(LEAST_CHUNKS, -(-size // LEAST_BYTES)))
    buckets = max(1, round(chunks**0.75))  # distinct words grow more slowly than text
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    # One exchange of the texts serves both the word table and the join back; a task has one chunk, on both sides.
    packed = docs.mapInArrow(_pack_texts, "doc_id long, text binary, chunk int").repartitionById(chunks, F.col("chunk"))
    found = packed.mapInArrow(_collect_words(tokenizer, buckets), "bucket int, chunk int, words binary")
    coded = found.groupBy("bucket").applyInArrow(_encode_bucket(tokenizer), "chunk int, words binary, ids binary").repartitionById(chunks, F.col("chunk"))
    schema = "doc_id long, ids array<int>" + ", text string" * decoded
    return packed.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_apply_chunk(tokenizer, decoded), schema)


def vocabulary(tokenizer: str) -> pa.Table:
    """(id, piece); the tokenizer file bounds the number of rows."""
    return _told(tokenizer)[1]


def _joined(ids: pa.ListArray, pieces: pa.Table) -> pa.Array:
    """Texts of lists of ids: each distinct id is joined to its piece once, the pieces go back by position."""
    flat = ids.flatten().dictionary_encode()
    wanted = pa.table({"id": flat.dictionary, "at": pa.array(np.arange(len(flat.dictionary)), pa.int64())})
    found = wanted.join(pieces, "id", join_type="inner", use_threads=False).sort_by("at")
    if found.num_rows != len(wanted):
        raise ValueError("an id is not in the vocabulary")
    by_position = found.column("piece").combine_chunks().take(flat.indices).cast(pa.large_string())
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), by_position)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds text (in place of a column of that name): the pieces of ids in order, joined as a tokenizer without a decoder does, by one space."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop("text")

    at = encoded.columns.index("ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        pieces = vocabulary(tokenizer)
        for batch in batches:
            yield [_joined(batch.column(at).fill_null([]), pieces)]

    return with_columns(encoded, rows, ["text"], ["string"])


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
