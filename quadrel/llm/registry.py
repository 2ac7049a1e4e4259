"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import bpe, cnn, crf, decontam, html, linedup, pii, rules, simhash, simhash_sql, warc
from quadrel.llm.common import id_bucket, scratch, table

TOKENIZER = "word_bpe_49k.json"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), decoded=True))


def op3_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.assemble(spark, path, payloads=False).select(
        "page_id", "response.payload_bytes", "response.payload_digest", "record_type", "refers_to"
    )


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = cnn.score(docs, cnn.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_bucket("doc_id", cnn.FOLDS) == cnn.HELD).alias("held_out"), "score", "predicted")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = crf.predict(docs, crf.train(docs))
    return found.select("doc_id", (id_bucket("doc_id", crf.FOLDS) == crf.HELD).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hexed(simhash.dedup(table(spark, sf_dir, "documents")))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7_rules, which SQL can express, without the trees' verdict."""
    return rules.apply(table(spark, sf_dir, "documents"), None).drop("kept", "score")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op8_pii, which SQL can express, without the method's."""
    return pii.base_report(pii.find(table(spark, sf_dir, "documents")))


QUERIES = {
    "rules_base": rules_base,
    "pii_base": pii_base,
    "op1_html": op1_html,
    "op2_bpe": op2_bpe,
    "op3_linedup": op3_linedup,
    "op4_warc": op4_warc,
    "op5_decontam": op5_decontam,
    "op6_cnn": op6_cnn,
    "op7_rules": op7_rules,
    "op8_pii": op8_pii,
    "op9_crf": op9_crf,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op10_simhash": simhash_sql.oracle(simhash.SHINGLE, simhash.THRESHOLD),
    "rules_base": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), l AS (
            SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), x AS (
            SELECT r, k, count(*) OVER (PARTITION BY r, a, b, c) AS n
            FROM (SELECT r, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d))
        ), y AS (
            SELECT r, count(DISTINCT k + o) AS n_repeat_words FROM x, (VALUES (0), (1), (2)) AS s(o) WHERE n > 1 GROUP BY r
        ), z AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM d LEFT JOIN l USING (r) LEFT JOIN y USING (r)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM z
    """,
    "pii_base": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
        ), p AS (
            SELECT * FROM (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')) AS v(rank, kind)
        ), h AS (
            SELECT r, rank, kind, hits, CASE rank WHEN 0 THEN regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_split_to_array(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
                   WHEN 2 THEN regexp_split_to_array(t, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS gaps
            FROM (SELECT *, CASE rank WHEN 0 THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
                  WHEN 2 THEN regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+') ELSE regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') END AS hits FROM d, p) WHERE len(hits) > 0
        ), m AS (
            SELECT r, rank, kind, hits[i] AS v, gaps[i] AS g, i FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM h)
        ), s AS (
            SELECT r, rank, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS dg, CAST(sum(length(g) + length(v)) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM m
        ), ok AS (
            SELECT * FROM s WHERE CASE rank
                WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
                WHEN 2 THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(dg)), lambda i:
                     CASE WHEN i % 2 = 1 THEN ascii(dg[length(dg) - i + 1]) - 48 ELSE 2 * (ascii(dg[length(dg) - i + 1]) - 48) - CASE WHEN ascii(dg[length(dg) - i + 1]) - 48 > 4 THEN 9 ELSE 0 END END)) % 10 = 0
                WHEN 3 THEN length(dg) BETWEEN 10 AND 15 ELSE true END
        ), a AS (
            SELECT r, count(*) FILTER (rank = 0) AS e, count(*) FILTER (rank = 1) AS ip, count(*) FILTER (rank = 2) AS c, count(*) FILTER (rank = 3) AS ph,
                   string_agg(kind || ':' || (stop - length(v)) || ':' || stop, ',' ORDER BY stop - length(v), rank) AS spans FROM ok GROUP BY r
        )
        SELECT doc_id, CAST(coalesce(e, 0) AS BIGINT) AS n_email, CAST(coalesce(ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(c, 0) AS BIGINT) AS n_card, CAST(coalesce(ph, 0) AS BIGINT) AS n_phone,
               sha256(coalesce(spans, '')) AS base_sha256
        FROM d LEFT JOIN a USING (r)
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY d) AS lo FROM p
        )
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> lo THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> lo THEN lo END AS refers_to
        FROM f
    """,
    "op5_decontam": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM bw))
        ), m AS (
            SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n
        ), h AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM m) GROUP BY doc_id
        ), i AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
    # A line within two edits holds one of the other's thirds (or halves) unchanged: that thins the pairs.
    "op3_linedup": r"""
        WITH l AS (
            SELECT doc_id, no, line, length(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AS real
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL)
        ), c AS (
            SELECT line, min((doc_id, no)) AS first, length(line) AS n FROM l WHERE real GROUP BY line
        ), s AS (
            SELECT *, least(2, n // 16) AS t FROM c WHERE n >= 16
        ), x AS (
            SELECT a.line AS la, b.line AS lb, a.first AS fa, b.first AS fb, a.t
            FROM s a JOIN s b ON b.n BETWEEN a.n AND a.n + a.t AND a.line <> b.line
            WHERE contains(b.line, substr(a.line, 1, a.n // (a.t + 1)))
               OR contains(b.line, substr(a.line, a.n // (a.t + 1) + 1, a.n // (a.t + 1)))
               OR (a.t = 2 AND contains(b.line, substr(a.line, 2 * (a.n // 3) + 1)))
        ), late AS (
            SELECT DISTINCT CASE WHEN fa < fb THEN lb ELSE la END AS line FROM x WHERE levenshtein(la, lb) <= t
        ), k AS (
            SELECT l.doc_id, l.no, l.line, l.real, l.real AND (l.doc_id, l.no) <> c.first AS exact_, l.real AND (l.doc_id, l.no) = c.first AND late.line IS NOT NULL AS near_
            FROM l LEFT JOIN c ON l.line = c.line LEFT JOIN late ON l.line = late.line
        ), g AS (
            SELECT doc_id, count(*) FILTER (real) AS n_lines, count(*) FILTER (exact_) AS n_exact, count(*) FILTER (near_) AS n_near,
                   string_agg(line, chr(10) ORDER BY no) FILTER (NOT (coalesce(exact_, false) OR coalesce(near_, false))) AS text
            FROM k GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
               sha256(coalesce(g.text, '')) AS text_sha256
        FROM documents d LEFT JOIN g USING (doc_id)
    """,
}
