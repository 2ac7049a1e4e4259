"""The training-data operators against brute force, round trips and held-out accuracy; edge cases of each."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.llm import bpe, cnn, crf, decontam, html, html_pages, linedup, pii, rules, simhash, warc
from quadrel.llm.common import scratch

LONG = "wort " * 30_000
TEXTS = [None, "", " \n\t ", "The quick brown fox, it's 42!", "The quick brown fox, it's 42!", "ÄÖÜ ß Straße naïve 日本語 👍🏽 İstanbul ΣΑΣ", "<|endoftext|>a<|startoftext|> b́ \u0085x\xa0y", LONG]


def docs(spark, texts=TEXTS, extra=True):
    """Documents with a null id, a repeated row and columns whose names clash with results."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3] if len(texts) > 3 else "x"), (None, "orphan line of no one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.withColumns({"score": F.lit("s"), "words": F.lit(1), "key": F.lit(2), "th": F.lit(3), "n_lines": F.lit(9), "predicted": F.lit("p"), "__x": F.lit(0)})
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# BPE

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    table = docs(spark)
    got = bpe.decode(bpe.encode(table, tokenizer, chunk_bytes=1000), tokenizer)
    want = []
    for r in table.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], ids, t.decode(ids, skip_special_tokens=False)))
    assert rows(got, "doc_id", "ids", "text") == sorted(want, key=repr)
    assert bpe.digests(bpe.decode(bpe.encode(empty(spark), tokenizer), tokenizer)).count() == 0


# Line dedup

def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def change(r, line, k):
    out = list(line)
    for _ in range(k):
        how, at = r.randrange(3), r.randrange(len(out))
        if how == 0:
            out.insert(at, r.choice("abé"))
        elif how == 1 and len(out) > 1:
            out.pop(at)
        else:
            out[at] = r.choice("abé")
    return "".join(out)


def test_edit_distance_and_signatures():
    r = random.Random(5)
    pairs = []
    for _ in range(600):
        a = "".join(r.choice("abé") for _ in range(r.randint(3, 50)))
        b = change(r, a, r.randint(0, 4))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((max(a, b, key=len), min(b, a, key=len)))
    got = linedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [min(3, edits(a, b)) for a, b in pairs]
    for (a, b), d in zip(pairs, got, strict=True):
        if a != b and len(b) >= 16 and d <= linedup.tolerance(np.array([len(b)]))[0]:
            ordinal, key, sketch = linedup.signatures([a, b])
            assert set(key[(ordinal == 1) & (key & 1 == 0)] >> 1) & set(key[(ordinal == 0) & (key & 1 == 1)] >> 1)
            assert bin(int(sketch[0] ^ sketch[1])).count("1") <= 4 * linedup.MAX_EDITS


def test_long_lines(monkeypatch):
    """A line longer than a block has the same signature, and alike ends of two lines don't count."""
    r = random.Random(31)
    monkeypatch.setattr(linedup, "BLOCK", 50)
    for n in (50, 51, 99, 100, 101, 730):
        line = "".join(r.choice("abcdé👍 ") for _ in range(n))
        _, key, sketch = linedup.signatures([line])
        keys, one = linedup.long_signature(line)
        assert sorted(keys) == sorted(key) and one == sketch
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("ab") for _ in range(r.randint(16, 300)))
        b = change(r, a, r.randint(0, 3))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
        assert all(linedup._alike(lambda k, m=m: k <= m, 300) == m for m in (r.randint(0, 300), 300, 0))
    assert linedup._trimmed("p" * 900 + "X" + "q" * 700, "p" * 900 + "YY" + "q" * 700) == ("p" * 8 + "X" + "q" * 8, "p" * 8 + "YY" + "q" * 8)
    got = linedup._near([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [edits(a, b) <= min(2, min(len(a), len(b)) // 16) for a, b in pairs]


def test_linedup(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 60))).strip() or "x" for _ in range(40)]
    texts = ["\n".join(change(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) if r.random() < 0.9 else "" for _ in range(r.randint(1, 8))) for _ in range(60)]
    lines = [(i, no, x) for i, t in enumerate(texts) for no, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for i, no, x in lines:
        first.setdefault(x, (i, no))
    tol = lambda a, b: min(2, min(len(a), len(b)) // 16)
    late = {x for x in first for y in first if x != y and first[y] < first[x] and abs(len(x) - len(y)) <= 2 and edits(x, y) <= tol(x, y)}
    want = []
    for i, t in enumerate(texts):
        kept = [x for no, x in enumerate(t.split("\n")) if not x.strip() or ((i, no) == first[x] and x not in late)]
        want.append((i, "\n".join(kept)))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit(1))
    assert late
    assert rows(linedup.dedup(table), "doc_id", "text") == sorted(want, key=repr)


def test_linedup_hot_segments(spark):
    """Many lines that share segments, near ones and others: the same lines go, in whatever parts they are worked."""
    r = random.Random(21)
    base, head = "the terms of use of this page were changed on day 000", "all rights reserved by the owner of "
    lines = list(dict.fromkeys([change(r, base, r.randint(0, 3)) for _ in range(420)] + [head + "".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(300)]))
    assert len(lines) > linedup.HOT_LINES * 2
    r.shuffle(lines)
    n = len(lines)
    pairs = [(i, j) for i in range(n) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= 2]
    far = linedup.edit_distances([max(lines[i], lines[j], key=len) for i, j in pairs], [min(lines[j], lines[i], key=len) for i, j in pairs])
    late = {i for (i, j), d in zip(pairs, far, strict=True) if d <= linedup.tolerance(np.array([min(len(lines[i]), len(lines[j]))]))[0]}
    assert 200 < len(late) < n
    docs_ = spark.createDataFrame([(k, "\n".join(lines[at:at + 7])) for k, at in enumerate(range(0, n, 7))], "doc_id long, text string")
    kept = [x for _, t in sorted(rows(linedup.dedup(docs_), "doc_id", "text"), key=lambda x: x[0]) for x in t.split("\n") if x]
    assert kept == [x for i, x in enumerate(lines) if i not in late]
    # The same by small parts: every pair of parts meets once.
    table = spark.createDataFrame([(7 * i, i % 3, x, i) for i, x in enumerate(lines)], "h1 long, h2 long, line string, place long")
    hot = spark.createDataFrame([(seg, 7 * i) for seg in (1, 2) for i in range(n) if seg == 1 or i % 2], "seg long, id long")
    got = {x["h1"] // 7 for x in linedup._hot_late(hot, table, held=50, earliest=3).collect()}
    assert got == late


def test_linedup_edges(spark):
    table = docs(spark)
    out = linedup.dedup(table)
    assert out.columns == table.columns and {n for n, in rows(out, "n_lines")} == {9}
    got = rows(out, "doc_id", "text")
    assert len(got) == table.count() and (None, None) in got and (0, None) in got and (2, " \n\t ") in got
    assert got.count((3, TEXTS[3])) == 2 and (4, "") in got  # row 4 repeats row 3's line
    assert linedup.annotate(empty(spark)).count() == 0


@pytest.mark.parametrize("keep", ["linedup", "cnn", "simhash", "decontam", "pii"])
def test_clashing_columns_pass(spark, keep):
    """Columns with the names that operators use, or with dots and quotes, come out as they went in."""
    names = ["__d", "__th", "__quadrel_doc", "__QUADREL_TH", "__quadrel_score", "a.b", "c`d", "Start", "pos", "rank", "component_id", "term"]
    quote = lambda x: "`" + x.replace("`", "``") + "`"
    texts = ["one lone line of text", "one lone line of text", None, "", "mail a@b.de now"]
    table = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *[f"{quote(n)} string" for n in names]]))
    bench = spark.createDataFrame([(0, "never seen words"), (1, "lone line")], "item_id long, text string")
    net = cnn.Network(np.zeros((cnn.WIDTH, 256, cnn.FILTERS)), np.zeros(cnn.FILTERS), np.zeros(cnn.FILTERS, np.float32), 1.0)
    out = {"linedup": lambda: linedup.dedup(table), "cnn": lambda: cnn.keep(table, net), "simhash": lambda: simhash.keep_one(table), "decontam": lambda: decontam.decontaminate(table, bench), "pii": lambda: pii.sanitise(table)}[keep]()
    assert out.columns == table.columns
    got = {r["doc_id"]: [r[n] for n in names] for r in out.collect()}
    assert set(got) == {"linedup": {0, 1, 2, 3, 4}, "cnn": {0, 1, 2, 3, 4}, "simhash": {0, 2, 4}, "decontam": {2, 3, 4}, "pii": {0, 1, 2, 3, 4}}[keep]
    assert all(v == [f"{n}{i}" for n in names] for i, v in got.items())


# SimHash

def slow_fingerprint(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def test_simhash(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeÉf") for _ in range(4))
    texts = TEXTS + [None, "One two"]
    for _ in range(25):
        ws = [word() for _ in range(120)]
        texts += [" ".join(ws)] + [" ".join([*ws[:k], word(), *ws[k + 1:]]) for k in (r.randrange(120) for _ in range(r.randrange(4)))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    fp = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [(i, f"{fp[i]:016x}", find(i)) for i in range(len(texts))]
    assert rows(simhash.hexed(simhash.dedup(table)), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert [d for d, in rows(simhash.keep_one(table), "doc_id")] == sorted({find(i) for i in range(len(texts))}, key=lambda x: repr((x,)))


def test_simhash_edges(spark):
    assert simhash.dedup(empty(spark)).count() == 0
    out = simhash.keep_one(docs(spark))
    assert out.columns == docs(spark).columns
    ids = [d for d, in rows(out, "doc_id")]
    assert 0 in ids and 1 not in ids and 2 not in ids and ids.count(3) == 2 and 4 not in ids
    lone = spark.createDataFrame([(None, "a b c d e"), (None, "A b c d e")], "doc_id long, text string")
    assert simhash.keep_one(lone).count() == 1


def test_pigeonhole_finds_every_link(spark):
    r = random.Random(1)
    some = {r.getrandbits(64) for _ in range(300)}
    for x in list(some)[:150]:
        for _ in range(2):
            some.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    some = sorted(simhash._signed(x) for x in some)
    got = {(a["a"], a["b"]) for a in simhash.links(spark.createDataFrame([(x,) for x in some], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(some) for b in some[i + 1:] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100


# WARC

def test_warc(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20 + "</p>"
    data = [(5, "http://a.example/x", big), (3, "http://b.example/", big), (9, None, None), (7, "u\nv", ""), (8, "http://c", "tiny"), (2, "http://d", "tiny"), (None, "http://n", big), (3, "http://b.example/", big), (11, "http://e", LONG)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch(spark, "warc-test")
    warc.write_archives(pages, path)
    out = warc.assemble(spark, path)
    want = []
    for i, u, h in data:
        raw = (h or "").encode()
        again = h == big and i != 3
        want.append((i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None, None if again else raw))
    got = [(r["page_id"], r["url"], r["response"]["payload_bytes"], r["response"]["payload_digest"], r["record_type"], r["refers_to"], None if r["response"]["payload"] is None else bytes(r["response"]["payload"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["request"]["concurrent"] if "concurrent" in r["request"] else r["request"]["record_id"] for r in out.collect())
    none = scratch(spark, "warc-none")
    warc.write_archives(pages.limit(0), none)
    assert warc.assemble(spark, none).count() == 0


def test_warc_members(spark, tmp_path):
    """Archives whose records are compressed each on its own, or cut anywhere, are read whole."""
    import gzip

    def record(kind, rid, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    records, want = [], []
    for i in range(7):
        body = f"<p>{i}\r\n\r\nWARC/1.1 ".encode() * (1 + 9000 * (i == 3))
        digest = hashlib.sha256(body).hexdigest()
        records += [record("request", f"<r{i}>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To=f"<c{i}>"), record("response", f"<c{i}>", b"HTTP/1.1 200 OK\r\n\r\n" + body, WARC_Payload_Digest=f"sha256:{digest}"),
                    record("metadata", f"<m{i}>", f'{{"page_id": {i}}}'.encode(), WARC_Concurrent_To=f"<c{i}>")]
        want.append((i, len(body), digest, body))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records[:12]))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[12:])))
    (tmp_path / "c.warc.gz").write_bytes(b"")
    got = [(r["page_id"], r["response"]["payload_bytes"], r["response"]["payload_digest"], bytes(r["response"]["payload"])) for r in warc.assemble(spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == want
    whole = b"".join(records)
    for step in (1, 7, 1000):
        assert len(list(warc.parse(whole[k:k + step] for k in range(0, len(whole), step)))) == 21
    for broken in (whole[:-1], whole[:-30], b"x" + whole, whole + b"WARC"):
        with pytest.raises(ValueError):
            list(warc.parse([broken]))
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(whole)[:-9]))


# Decontamination

def test_decontam(spark):
    r = random.Random(4)
    vocab = ["alpha", "beta", "É", "the", "of", "k9"] + [f"w{i}" for i in range(12)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(30), say(12), say(4), say(10), ["solo"], []]
    texts = [None, "", "...!", "solo", "SOLO é solo", LONG]
    for _ in range(30):
        ws = say(r.randint(0, 40))
        part = r.choice(items)
        k = r.randrange(max(1, len(part)))
        texts.append(", ".join(ws + part[k:k + r.randint(1, 30)] + say(5)).title().replace("É", "É"))
    bench = spark.createDataFrame([(i, " ".join(x) if x else None) for i, x in enumerate(items)] + [(2, " ".join(items[2]))], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(texts)) + [(3, "solo")], "doc_id long, text string").withColumn("pos", F.lit(1))
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for d, t in [*enumerate(texts), (3, "solo")]:
        w, hit, seen = find(t), set(), set()
        for i, x in enumerate(items):
            x = find(" ".join(x))
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == x[k:k + n]:
                        hit |= set(range(s, s + n))
                        seen.add(str(i))
        want.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    got = rows(decontam.contamination(table, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr)
    kept = decontam.decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(d for d, in rows(kept, "doc_id")) == sorted(x[0] for x in want if not x[5])
    assert decontam.contamination(empty(spark), bench).count() == 0
    none = decontam.contamination(docs(spark), bench.limit(0))
    assert none.count() == docs(spark).count() and not any(x for x, in rows(none, "contaminated"))


def test_proximity(spark):
    table = spark.createDataFrame([(1, "red a b blue c"), (2, "blue a a a a red")], "doc_id long, text string")
    pairs = spark.createDataFrame([("red", "blue")], "a string, b string")
    got = decontam.proximity_matches(decontam.build_index(table), pairs, 3)
    assert rows(got, "doc_id", "pos_a", "pos_b") == [(1, 0, 3)]


def test_proximity_by_brute_force(spark):
    r = random.Random(17)
    texts = [" ".join(r.choice(["Red", "blue", "É", "a", "b"]) for _ in range(r.randint(0, 30))) for _ in range(20)] + [None]
    want = sorted((i, a, b, p, q) for i, t in enumerate(texts) for w in [[x.lower() if x != "É" else x for x in (t or "").split()]] for a, b in (("red", "blue"), ("É", "É"))
                  for p, x in enumerate(w) for q, y in enumerate(w) if x == a and y == b and p != q and abs(p - q) <= 4)
    pairs = spark.createDataFrame([("red", "blue"), ("É", "É"), ("red", "blue")], "a string, b string")
    table = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    assert rows(decontam.proximity(table, pairs, 4), "doc_id", "a", "b", "pos_a", "pos_b") == sorted(want, key=repr)


# Classifiers

def quality_rows(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "re", "ti", "on", "é"]) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        if i % 2:
            text = " ".join((" ".join(word() for _ in range(8)).capitalize() + ".") for _ in range(r.randint(5, 30)))
        else:
            text = " ".join(word() + r.choice(["###", "***", "$$$"]) for _ in range(r.randint(60, 200)))
        out.append((i, text, i % 2))
    return out


def test_cnn(spark):
    data = quality_rows(240, 1)
    table = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in data] + [(None, 1), (5, None)], "doc_id long, quality int")
    net = cnn.train(table, labels, per_class=60)
    got = {r["doc_id"]: r for r in cnn.score(table, net).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == q for i, _, q in held]) > 0.95
    odd = cnn.score(docs(spark), net)
    assert odd.count() == docs(spark).count() and all(0 <= s <= 1 for s, in rows(odd, "score"))
    kept = cnn.keep(docs(spark), net)
    assert kept.columns == docs(spark).columns and {tuple(r) for r in kept.select("score", "predicted").collect()} <= {("s", "p")}
    assert cnn.train(table, labels.limit(0)) is None and {s for s, in rows(cnn.score(table, None), "score")} == {0.5}
    assert cnn.score(empty(spark), net).count() == 0


def test_cnn_reads_whole_texts():
    """The pooled pass equals a plain convolution over every byte."""
    rng = np.random.default_rng(0)
    net = cnn.Network(rng.normal(0, 1, (cnn.WIDTH, 256, cnn.FILTERS)), rng.normal(0, 1, cnn.FILTERS), rng.normal(0, 1, cnn.FILTERS).astype(np.float32), 0.3)
    texts = [b"", b"abc", bytes(rng.integers(1, 255, 256).tolist()), bytes(rng.integers(1, 255, 3000).tolist())]
    tables, want = net.pairs(), []
    for t in texts:
        units = cnn._units(t)
        s = np.frombuffer(t + bytes(units * cnn.UNIT + cnn.WIDTH - len(t)), np.uint8)
        h = sum(net.filters[k][s[k:k + units * cnn.UNIT]] for k in range(cnn.WIDTH))
        h = h.reshape(units, cnn.UNIT, -1)
        h[-1, 1 - cnn.WIDTH:] = -np.inf  # padding
        pool = np.maximum(h.max(axis=1) + net.bias, 0)
        chunk = pool if units == 1 else np.maximum(pool[1:], pool[:-1])
        want.append((chunk @ net.dense + net.offset).mean())
    assert np.allclose(cnn.logits(texts, net, tables), want, atol=1e-3)
    assert np.allclose(cnn.logits(texts[::-1], net, tables), want[::-1], atol=1e-3)  # neighbours don't matter


def slow_counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_rules(spark):
    data = quality_rows(200, 2)
    table = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in data], "doc_id long, quality int")
    model = rules.train(table, labels, 80)
    got = {r["doc_id"]: r for r in rules.apply(table, model).collect()}
    assert all(tuple(got[i][c] for c in rules.COUNTS) == slow_counts(t) for i, t, _ in data[:60])
    assert np.mean([got[i]["kept"] == bool(q) for i, t, q in data if slow_counts(t)[0] >= 50]) > 0.95
    for t in [*TEXTS[:7], "a b c a b c\n\na b c\x0b x | <y>\na b c", "x " * 99]:
        assert rules.statistics(t)[0] == slow_counts(t)
    assert rules.apply(empty(spark), model).count() == 0 and rules.apply(docs(spark), None).count() == docs(spark).count()


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((800, len(rules.MONOTONE)))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 2]) + 0.1 * rng.normal(size=800) > 0.5).astype(float)
    model = rules.fit(x, y)
    for j, sign in enumerate(rules.MONOTONE):
        if sign:
            probe = np.repeat(x[:50], 20, axis=0)
            probe[:, j] = np.tile(np.linspace(0, 1, 20), 50)
            steps = np.diff(model.margin(probe).reshape(50, 20), axis=1)
            assert (sign * steps >= -1e-9).all()


def test_crf_posteriors():
    rng = np.random.default_rng(0)
    n, k = 300, 3
    emit, first = rng.normal(size=(n, k)) * 2, rng.random(n) < 0.05
    first[0] = True
    start, trans = rng.normal(size=k), rng.normal(size=(k, k))
    got = crf.posteriors(emit, first, start, trans, segment=16)
    cuts = [*np.flatnonzero(first), n]
    for a, b in zip(cuts, cuts[1:]):
        alpha, beta = [np.exp(start + emit[a])], [np.ones(k)]
        for i in range(a + 1, b):
            v = alpha[-1] @ np.exp(trans) * np.exp(emit[i])
            alpha.append(v / v.sum())
        for i in range(b - 2, a - 1, -1):
            v = np.exp(trans) @ (np.exp(emit[i + 1]) * beta[-1])
            beta.append(v / v.sum())
        p = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], p / p.sum(axis=1, keepdims=True))


def test_crf(spark):
    r = random.Random(8)
    parts = {"en": ["the", "ing", "ed", "wh"], "de": ["sch", "ung", "ein", "tz"], "fr": ["eau", "oi", "é", "que"]}
    data = [(i, " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) for _ in range(30)).capitalize(), g) for i, g in enumerate(["en", "de", "fr"] * 60)]
    table = spark.createDataFrame([*data, (900, None, "en"), (901, "no tongue", None)], "doc_id long, text string, lang string")
    model = crf.train(table, per_lang=30)
    got = {x["doc_id"]: x for x in crf.predict(table, model).collect()}
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in held]) > 0.95 and all(0 <= x["score"] <= 1 for x in got.values())
    assert got[900]["lang_pred"] == "und" and got[900]["score"] == 0
    odd = crf.predict(docs(spark), model)
    assert odd.count() == docs(spark).count() and all(x == "und" for i, x in rows(odd, "doc_id", "lang_pred") if i in (0, 1, 2))
    assert crf.words_of("½ x² ²") == ["x²"] and crf.words_of("12 ½_") == []
    mixed = crf.Scorer(model)
    words = ["thewhing", "edthe", "thewh", "schung", "eintz", "tzsch"]
    post = crf.posteriors(mixed.rows(words), np.array([True] + [False] * 5), model.start, model.trans)
    assert [model.langs[i] for i in post.argmax(axis=1)] == ["en"] * 3 + ["de"] * 3
    assert crf.train(table.where("lang IS NULL")) is None and crf.predict(empty(spark), None).count() == 0


def test_crf_long_texts_and_neighbours(spark, monkeypatch):
    """A text's language and score depend neither on its neighbours nor on whether it is read in blocks."""
    r = random.Random(12)
    parts = {"en": ["the", "ing", "ed", "wh"], "de": ["sch", "ung", "ein", "tz"]}
    say = lambda g, n: " ".join("".join(r.choice(parts[g]) for _ in range(r.randint(1, 3))) + r.choice(["", ",", " 7 ½"]) for _ in range(n))
    langs = ["en", "de"] * 30
    model = crf.fit([say(g, 30) for g in langs], langs)
    texts = [say("en", 5), say("de", 700) + " " + say("en", 900), say("en", 129), say("de", 128), "½ 7 _", say("de", 3000)]
    plain = crf.Scorer(model).predict(texts)
    for t, g, x in zip(texts, *plain, strict=True):
        assert crf.Scorer(model).predict([t])[0] == [g] and crf.Scorer(model).predict([t])[1][0] == x
    monkeypatch.setattr(crf, "LONG", 3)
    monkeypatch.setattr(crf, "BLOCK_WORDS", 128)
    blocks = crf.Scorer(model).predict(texts)
    assert blocks[0] == plain[0] and np.allclose(blocks[1], plain[1], atol=1e-8)


def test_crf_many_languages(spark):
    """Languages beyond the 64th, the rarest too, are learned and found."""
    names = [f"l{i:02d}" for i in range(70)]
    tongue = {g: [chr(0x4E00 + 40 * i + k) * 2 for k in range(12)] for i, g in enumerate(names)}
    r = random.Random(4)
    langs = [g for g in names for _ in range(16 if g < "l64" else 8)]
    table = spark.createDataFrame([(i, " ".join(r.choice(tongue[g]) for _ in range(20)), g) for i, g in enumerate(langs)], "doc_id long, text string, lang string")
    model = crf.train(table, per_lang=30)
    assert model.langs == names
    got = {x["doc_id"]: x["lang_pred"] for x in crf.predict(table, model).collect()}
    rare = [got[i] == g for i, g in enumerate(langs) if g >= "l64"]
    assert np.mean(rare) > 0.9 and np.mean([got[i] == g for i, g in enumerate(langs)]) > 0.9
    rng = np.random.default_rng(1)
    emit, first, start, trans = rng.normal(size=(300, 5)), rng.random(300) < 0.05, rng.normal(size=5), rng.normal(size=(5, 5))
    first[0] = True
    post, pairs = crf._by_chain(emit, first, start, trans)
    assert np.allclose(post, crf.posteriors(emit, first, start, trans)) and np.isclose(pairs.sum(), (~first).sum())


def test_crf_long_runs():
    """Every letter of a run counts, however long it is, and its suffix is its real end."""
    r = random.Random(6)
    letters = {"a": "bcdfgh", "b": "klmnpq"}
    run = lambda g, n: "".join(r.choice(letters[g]) for _ in range(n))
    langs = ["a", "b"] * 40
    head = "x" * 30
    model = crf.fit([head + run(g, 60) for g in langs], langs)
    texts = [head + run(g, n) for n in (60, 5_000, 300_000) for g in langs[:6]]
    assert crf.Scorer(model).predict(texts)[0] == langs[:6] * 3
    weights = np.random.default_rng(2).normal(size=(crf.BUCKETS, 3))
    word = run("a", 30)
    flat = np.array([a[0] for a, has in crf.features([word]) if has[0]])
    assert np.array_equal(flat, crf.long_features(word))
    many = run("a", 40_000)
    at = crf.long_features(many)
    assert np.allclose(crf.emissions([word, many], weights), [weights[flat].sum(0) / len(flat) ** 0.5, weights[at].sum(0) / len(at) ** 0.5])


# Personal data

def slow_spans(text):
    def luhn(d):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, p) in enumerate(plain.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if x.isdigit()), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PII = ["é👍 mail a.b@c.de, a@b@c.d x@y z@q.r_s@t.u", "1.2.3.4.5.6.7.8 and 300.1.1.1 or 0255.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 and +49 30 12 +123456789012345678", "1" * 3000 + "@" + "a." * 3000 + "b", "5" + " 5" * 4000]


def test_pii_base(spark):
    table = docs(spark, TEXTS + PII)
    got = rows(pii.report(table), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for r in table.collect():
        s = slow_spans(r["text"])
        want.append((r["doc_id"], *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pii.report(empty(spark)).count() == 0


def test_pii_terms(spark):
    near = [f"Grüße von Zaphod an zaphod@example.org wegen Sache {x}." for x in ("eins", "zwei", "drei")]
    fill = [f"Grüße von allen wegen der Sache an {x}" for x in "abcdefghij"]
    table = spark.createDataFrame(list(enumerate(near + fill)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = {r["doc_id"]: r for r in pii.report(table).collect()}
    at = near[0].index("Zaphod")
    assert f"term:{at}:{at + 6}" in out[0]["spans"] and out[0]["n_email"] == 1
    assert "term" not in "".join(out[i]["spans"] for i in range(3, 13))
    assert all("term:" not in s or "term:0:" not in s for s in (out[0]["spans"],))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "Zaphod" not in clean[0] and "[EMAIL]" in clean[0] and clean[5] == fill[2]


def test_pii_terms_far_from_the_entity(spark):
    """A term many words, or many code points without words, away tells as much, and every occurrence is marked."""
    gap = "der Brief geht noch am selben Tag an alle Leute im Haus"
    far = [f"Zaphod grüßt. {gap} {'0 ' * 200}{x} an zaphod@example.org. {gap} Nochmals ZAPHOD, Zaphod!" for x in ("eins", "zwei")]
    fill = [f"{gap}, auch {x} grüßt: {x}@example.org" for x in "abcdefghij"]
    table = spark.createDataFrame(list(enumerate(far + fill)), "doc_id long, text string")
    out = {r["doc_id"]: r["spans"].split(",") for r in pii.report(table).collect()}
    for i, text in enumerate(far):
        assert [x for x in out[i] if x.startswith("term:")] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("zaphod(?!@)|nochmals", text.lower())]
    assert not any("term" in x for i in range(2, 12) for x in out[i])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert all("zaphod" not in clean[i].lower() for i in (0, 1)) and clean[2] == fill[0].replace("a@example.org", "[EMAIL]")


def plain_terms(texts):
    """text -> telling terms and their shares, from sets of distinct texts; at most one address a text."""
    distinct = sorted({t or "" for t in texts})
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    words = {t: {w.lower() for w in re.findall(r"[^\W_]{2,}", mail.sub(" ", t)) if re.search(r"[^\W\d_]", w)} for t in distinct}
    value = {t: m[0] for t in distinct if (m := mail.search(t))}
    nodes = {}
    for t, v in value.items():
        for node in ((0, v), (1, v.rpartition("@")[2].lower()), (2, "")):
            nodes.setdefault(node, set()).add(t)
    classes = {}
    for (level, _), held in nodes.items():
        if len(held) >= pii.SUPPORT:
            classes[frozenset(held)] = classes.get(frozenset(held), False) or level == 0
    df = {}
    for t in distinct:
        for w in words[t]:
            df[w] = df.get(w, 0) + 1
    told = {}
    for held, exact in classes.items():
        info = np.log2(len(distinct) / len(held))
        for w in {w for t in held for w in words[t]}:
            both = [t for t in held if w in words[t]]
            if len(both) < pii.SUPPORT or info <= 0:
                continue
            p = len(both) / df[w]
            if not exact:
                cases = sum(1 / sum(value[u] == value[t] for u in held) for t in both)
                n, z = df[w] * cases / len(both), pii.Z
                p = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            share = min(1.0, 1 + np.log2(p) / info)
            if share >= pii.GENERALISE:
                for t in both:
                    told.setdefault((held, t), {})[w] = share
    out = {}
    for (_, t), some in told.items():
        if len(some) <= pii.FEW or len(some) <= pii.COPIED * len(words[t]):
            for w, share in some.items():
                out.setdefault(t, {})[w] = max(share, out.get(t, {}).get(w, 0))
    return out


def test_pii_terms_by_brute_force(spark):
    """Telling terms of values, classes and kinds, among copies and near copies."""
    r = random.Random(14)
    vocab = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in ("", "mn", "7x")]
    texts = [None, "", "a 1 22"]
    for k in range(240):
        ws = [r.choice(vocab) for _ in range(r.randint(3, 40))]
        if k % 4 == 0:
            person = r.randrange(12)
            ws.insert(r.randrange(len(ws)), f"p{person if person < 8 else k}@host{person % 3}.org")
            if person < 5:
                ws += [f"name{person}", "Write", "to"]
            elif person < 8:
                ws += ["Host", f"street{person % 3}"]
            else:
                ws += ["mailto"]
        texts.append(" ".join(ws))
        if k % 10 == 0:
            texts += [texts[-1]] * 3 + [texts[-1] + f" {r.choice(vocab)}"]
    want = {(t, w): s for t, some in plain_terms(texts).items() for w, s in some.items()}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    th = {x["th"]: x["text"] for x in table.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text")).collect()}
    got = {(th[x["th"]], x["term"]): x["share"] for x in pii._work(table)["terms"].collect()}
    assert len(want) > 30 and any(w == "mailto" for _, w in want) and any(w.startswith("name") for _, w in want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pii_terms_of_near_copies(spark):
    """Words that only near copies share tell nothing; one that other texts of the entity have too tells in the copies as well."""
    rare = " ".join(f"selten{i}" for i in range(12))
    near = [f"{rare} Sternberg {x} s@t.example" for x in ("heute", "morgen", "gestern")]
    texts = near + ["Sternberg schrieb s@t.example", "damals Sternberg s@t.example"] + [f"heute morgen gestern damals schrieb wort{i}" for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x["spans"] for x in pii.report(table).collect()}
    for i, t in enumerate(texts[:5]):
        assert [t[int(a):int(b)] for k, a, b in (x.split(":") for x in out[i].split(",")) if k == "term"] == ["Sternberg"]
    got = {(x["doc_id"], x["n_terms"]) for x in pii.report(table.where("doc_id < 3 OR doc_id > 4")).collect() if x["doc_id"] < 3}
    assert got == {(0, 0), (1, 0), (2, 0)}


def test_pii_secrets_and_other_words(spark):
    """Keys and passwords are spans; names of two letters, codes and words of unparted scripts can be terms."""
    secret = ["AKIA" + "Q7" * 8, 'token = "' + "a1b2" * 8 + '"', "password: hunter2hunter2", "ghp_" + "aB3" * 13]
    plain = ["The password is easily forgotten", "token ring", "password: forgotten", "AKIAshort", "key = value"]
    table = spark.createDataFrame(list(enumerate(secret + plain)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_secret"] for x in pii.report(table).collect()}
    assert [got[i] for i in range(9)] == [1] * 4 + [0] * 5
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(table).collect()}
    assert clean[1] == 'token = "[SECRET]"' and clean[2] == "password: [SECRET]" and clean[4] == plain[0]
    near = [f"{x} {c} gab 王明 an boss@firm.example" for x, c in (("Heute hat Li", "AX7"), ("Gestern kam Li", "AX7"), ("Morgen geht Li", "AX7"))]
    fill = [f"{x} gab es an {x} viel zu tun, heute hat gestern kam morgen geht" for x in ("hier", "dort", "oben", "unten", "drinnen", "daheim", "abends", "nachts")]
    out = {x["doc_id"]: x["spans"] for x in pii.report(spark.createDataFrame(list(enumerate(near + fill)), "doc_id long, text string")).collect()}
    for i, t in enumerate(near):
        found = {t[int(a):int(b)] for k, a, b in (x.split(":") for x in out[i].split(",")) if k == "term"}
        assert found == {"Li", "AX7", "王明"}


def test_pii_ladder(spark):
    """A term is replaced by a beginning that tells little, else masked; what tells most is removed."""
    rest = [f"wort{i} und text{i}" for i in range(30)]
    texts = [f"Sternberg {x} s@t.de" for x in rest[:9]] + ["Sternberg ohne alles"] + [f"Sternwarte Stern{i} {x}" for i, x in enumerate(rest[10:])] + [f"nur {x}" for x in rest]
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(out[i] == f"stern\u2026 {rest[i]} [EMAIL]" for i in range(9)) and out[9] == texts[9] and out[12] == texts[12]
    texts = [t.replace("Sternwarte Stern", "Mond ") for t in texts]
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(out[i] == f"[TERM] {rest[i]} [EMAIL]" for i in range(9))


def test_pii_long_texts_take_linear_time(spark):
    """Many spans in one text, and cuts across blocks of text."""
    import time

    def took(n):
        table = spark.createDataFrame([(0, " ".join(f"mail{i}@host.example 4111 1111 1111 1111" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert [x["n_email"] for x in pii.base_report(pii.find(table)).collect()] == [n]
        return time.time() - began

    took(100)
    few, many = took(2_000), took(16_000)
    assert many < 8 * 3 * max(0.5, few)
    r = random.Random(2)
    texts = ["".join(r.choice(["é", "👍", "a b ", f" x{i}@y{i}.de "]) for _ in range(r.choice([3, 400, 3000]))) for i in range(12)]
    want = [re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t) for t in texts]
    got = {x["doc_id"]: x["text"] for x in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(12)] == want


# HTML

@pytest.fixture(scope="module")
def net():
    return html.trained()


def test_html_blocks():
    got = [(b.path, b.text()) for b in html.blocks("<body><nav><ul><li><a href=x>A &amp; B<li>C</ul></nav><!-- <p>no --><article class='x y'><h1>T</h1><p>one<br>two <b>th</b>ree<p>four &eacute;&#x41;&nbsp;5<script>var a='</p>';</script></article>tail < 3 <i")]
    assert [t for _, t in got] == ["A & B", "C", "T", "one two three", "four éA 5", "tail < 3"]
    assert got[2][0][-2:] == ("article .x y", "h1")
    for odd in (None, "", "<", "<p", "<p title='x", "<!--", "<script>", "</p></div>", "<a" * 500, "<p " + "a" * 5000):
        html.blocks(odd)


def test_html_formulas_and_fallbacks():
    """Text of math and object is the labeller's to judge; scripts and styles stay silent."""
    got = html.blocks("<p>so <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds</p><object data=f><param name=a><p>A fallback</p></object><p>end<style>p{}</style>")
    assert [b.text() for b in got] == ["so x = 2 holds", "A fallback", "end"]


def test_html_labels(net):
    held = [html.page(h, html_pages.MARK) for h in html_pages.made_up(150, seed=99)]
    found = net.label([p for p, _ in held])
    right = sum(int((f == (y > 0)).sum()) for f, (_, y) in zip(found, held, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.985


def test_html_extract(spark, net):
    page = "<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A tale of two words</h1><p>It was &lt;the&gt;  best\n of times, it was the worst of times.</p><p>And then it went on for a good while, as tales do.</p></article><div class='comments'><div class='comment'><p>Nice one!</p></div></div><footer>&copy; me</footer></body></html>"
    data = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<nav><a href=/>x</a></nav>")]
    table = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = rows(html.extract(table, net), "page_id", "url", "text", "n_chars")
    want = "A tale of two words It was <the> best of times, it was the worst of times. And then it went on for a good while, as tales do."
    assert got.count((1, "u", want, len(want))) == 2 and (2, None, "", 0) in got and (3, "v", "", 0) in got and len(got) == 5
    assert html.extract(table.limit(0), net).count() == 0
