"""Queries of the training-data operators over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, html_extract, line_dedup, minhash, packing, secrets, token_store, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_multi_index": embeddings.op1,
    "op2_bag_minhash": minhash.op2,
    "op3_line_chunks": line_dedup.op3,
    "op4_warc_salvage": warc.op4,
    "op5_secret_ledger": secrets.op5,
    "op6_toxicity_chain": toxicity.op6,
    "op7_main_text": html_extract.op7,
    "op8_token_frames": token_store.op8,
    "op9_packing": packing.op9,
    "op10_decontamination": decontaminate.op10,
}

SQL: dict[str, str] = {
    "op4_warc_salvage": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, first, sha1(h) AS x FROM f),
b AS (SELECT h, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1), '' ORDER BY g, k) AS b32
      FROM (SELECT h, first, g, k, (n >> CAST(5 * (7 - k) AS BIGINT)) & 31 AS v
            FROM (SELECT h, first, g, CAST('0x' || substr(x, CAST(g * 10 + 1 AS BIGINT), 10) AS BIGINT) AS n FROM d, range(4) r(g)), range(8) s(k))
      GROUP BY h, first)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, b.b32 AS payload_digest,
       CASE WHEN p.page_id = b.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = b.first THEN NULL ELSE b.first END AS refers_to
FROM p JOIN b ON p.h = b.h
""",
    "op5_secret_ledger": r"""
WITH m AS (
  SELECT doc_id, 0 AS kind, 'assign' AS name, 6 AS least,
    string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS found,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS held
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 1, 'access', 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+')
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 2, 'hex', 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+')
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
e AS (SELECT doc_id, kind, name, least, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS hit, unnest(held) AS own, generate_subscripts(found, 1) AS i
      FROM m WHERE len(found) > 0),
s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
f AS (SELECT doc_id, kind, name, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE length(own) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
""",
    "op10_decontamination": r"""
WITH dw AS (
  SELECT doc_id, w, CAST(pos AS BIGINT) AS pos
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents) d,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS pos)),
iw AS (
  SELECT item_id, w, CAST(pos AS BIGINT) AS pos, n, least(n, 10) AS size
  FROM (SELECT item_id, ws, len(ws) AS n FROM (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)) b,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS pos)),
windows AS (
  SELECT a.item_id, a.pos, a.size, string_agg(b.w, ' ' ORDER BY b.pos) AS g
  FROM iw a JOIN iw b ON a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + a.size - 1
  WHERE a.pos + a.size - 1 <= a.n GROUP BY ALL),
grams AS (SELECT DISTINCT item_id, size, g FROM windows),
sizes AS (SELECT DISTINCT size FROM grams),
known AS (SELECT DISTINCT w FROM iw),
run AS (SELECT dw.doc_id, dw.w, dw.pos, dw.pos - row_number() OVER (PARTITION BY dw.doc_id ORDER BY dw.pos) AS island
        FROM dw JOIN known USING (w)),
long_run AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n FROM run)
             WHERE n >= (SELECT min(size) FROM sizes)),
dgram AS (
  SELECT a.doc_id, a.pos, s.size, string_agg(b.w, ' ' ORDER BY b.pos) AS g
  FROM long_run a CROSS JOIN sizes s
  JOIN long_run b ON a.doc_id = b.doc_id AND a.island = b.island AND b.pos BETWEEN a.pos AND a.pos + s.size - 1
  GROUP BY ALL HAVING count(*) = s.size),
hit AS (SELECT d.doc_id, d.pos, d.size, g.item_id FROM dgram d JOIN grams g ON d.g = g.g AND d.size = g.size),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS p FROM hit) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ks, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
""",
}
