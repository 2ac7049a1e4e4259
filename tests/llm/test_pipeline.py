"""The corpus pipeline over a small folder, against a plain version of each stage; every registered query."""

import glob
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrel.llm import cnn, linedup, registry
from test_operators import edits, slow_fingerprint

DATA = "/root/testdata/sf0.001"
#: Columns that each query must give at least.
CONTRACT = {
    "op1_html": "page_id url text n_chars", "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_decontam": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6_cnn": "doc_id held_out score predicted",
    "op7_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_crf": "doc_id held_out lang_pred score", "op10_simhash": "doc_id fingerprint component_id",
}


def test_registry():
    names = list(registry.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registry.ORACLES) <= set(names)


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["the", "an", "re", "ti", "on", "wh"]) for _ in range(r.randint(1, 3)))
    good = lambda: "\n".join(" ".join(" ".join(word() for _ in range(8)).capitalize() + "." for _ in range(6)) for _ in range(3))
    junk = lambda: " ".join(word() + r.choice(["###", "***", "$$$"]) for _ in range(150))
    item = " ".join(f"bench{word()}" for _ in range(20))
    texts = [good() if i % 2 else junk() for i in range(160)]
    copy, leak = 161, 163
    texts += [good(), texts[1], good(), good() + "\n" + item + "."]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name.replace(' ', '-')}")
        seen.append(spark.read.parquet(f"{path}/{name.replace(' ', '-')}"))
    ids = [{x["doc_id"] for x in s.collect()} for s in seen]
    clean = {i for i in range(160) if i % 2}
    assert len(ids[1] & clean) > 0.95 * len(clean) and not ids[1] & {i for i in range(160) if not i % 2}
    assert ids[2] == ids[1] and seen[2].where(F.col("doc_id") == copy).head()["text"].strip() == ""
    assert copy in ids[3] and len(ids[3] - ids[2]) == 0 and leak in ids[3] and leak not in ids[4] and ids[3] - ids[4] == {leak}
    result = corpus_pipeline.run(spark, path)
    assert {x["doc_id"] for x in result.collect()} == ids[4] and {"doc_id", "n_tokens", "ids", "text"} == set(result.columns)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_each_query(spark, name):
    """Every registered query gives a row per row of its table, and what its SQL gives if it has one."""
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert set(CONTRACT.get(name, "").split()) <= set(cols)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert len(got) == db.sql(f"SELECT count(*) FROM {'pages' if 'page_id' in cols else 'documents'}").fetchall()[0][0]
    if name in registry.ORACLES:
        assert got == sorted(map(repr, db.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()))


def plain_quality(net, text):
    """The network, position by position."""
    raw = (text or "").encode()
    units = -(-(len(raw) + cnn.WIDTH - 1) // cnn.UNIT)
    s = np.frombuffer(raw + bytes(units * cnn.UNIT + cnn.WIDTH - len(raw)), np.uint8)
    h = sum(net.filters[k][s[k:k + units * cnn.UNIT]] for k in range(cnn.WIDTH)).reshape(units, cnn.UNIT, -1)
    h[-1, 1 - cnn.WIDTH:] = -np.inf
    pool = np.maximum(h.max(axis=1) + net.bias, 0)
    chunk = pool if units == 1 else np.maximum(pool[1:], pool[:-1])
    return float((chunk @ net.dense + net.offset).mean())


def plain_lines(docs):
    first = {}
    for i, t in sorted(docs.items()):
        for no, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(x, (i, no))
    late = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= 2 and edits(x, y) <= min(linedup.MAX_EDITS, min(len(x), len(y)) // 16)}
    return {i: t if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, no) and x not in late)) for i, t in docs.items()}


def plain_near(docs):
    fp = {i: slow_fingerprint(t) for i, t in docs.items()}
    seen, keep = set(), {}
    for i in sorted(fp):
        if i in seen:
            continue
        keep[i] = docs[i]
        group = [i]
        seen.add(i)
        for j in group:
            more = [k for k in fp if k not in seen and bin(fp[j] ^ fp[k]).count("1") <= 4]
            seen.update(more)
            group += more
    return keep


def plain_clean(docs, items):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k:k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(words(t))}


def test_pipeline_against_plain_stages(spark, tmp_path):
    """run() gives the rows of plain versions of its stages, one after the other."""
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(16)
    word = lambda: "".join(r.choice(["the", "an", "re", "ti", "on", "wh"]) for _ in range(r.randint(1, 3)))
    line = lambda: " ".join(word() for _ in range(7)).capitalize() + "."
    docs, items = {}, [" ".join(word() for _ in range(14)), "re on"]
    for i in range(70):
        kind = r.random()
        some = [t for t in docs.values() if t]
        if kind < 0.35 or i < 6:
            docs[i] = "\n".join(line() for _ in range(r.randint(3, 7)))
        elif kind < 0.5:
            docs[i] = " ".join(word() + r.choice(["###", "***", "$$$"]) for _ in range(60))
        elif kind < 0.62:
            docs[i] = r.choice(some)
        elif kind < 0.75:
            t = list(r.choice(some))
            t[r.randrange(len(t))] = "é"
            docs[i] = "".join(t)
        elif kind < 0.85:
            docs[i] = line() + "\n" + line() + "\n" + items[0].title() + "!"
        else:
            docs[i] = r.choice([None, "", "\n \n", "Short one."])
    labels = {i: int("###" not in (t or "") and "***" not in (t or "") and "$$$" not in (t or "")) for i, t in docs.items()}
    path = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    net = cnn.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    left = {i: t for i, t in docs.items() if plain_quality(net, t) >= 0}
    assert 5 < len(left) < len(docs)
    left = plain_clean(plain_near(plain_lines(left)), items)
    t = Tokenizer.from_file(public_tokenizers.path(registry.TOKENIZER))
    want = []
    for i, text in left.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, t.decode(ids, skip_special_tokens=False)))
    got = sorted((x["doc_id"], x["n_tokens"], x["ids"], x["text"]) for x in corpus_pipeline.run(spark, path).collect())
    assert got == sorted(want)
