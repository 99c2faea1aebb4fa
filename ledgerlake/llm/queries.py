"""The training-data queries (one for each operator) and their DuckDB SQL."""

from __future__ import annotations

from .chroma_print import op10_rows
from .common import table
from .embedding_e8 import embedding_links
from .pii_bootstrap import find_pii
from .quality_bayes import quality, trained
from .secret_scan import scan_secrets
from .sentencepiece_nbest import encode_documents
from .simhash_golay import op1_rows
from .source_mixing import op3_rows
from .token_counts import count_tokens
from .warc_fixity import op9_rows


def op1_simhash_golay(spark, sf_dir):
    return op1_rows(table(spark, sf_dir, "documents"))


def op2_quality_bayes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality(docs, trained(docs, table(spark, sf_dir, "labels")))


def op3_source_mixing(spark, sf_dir):
    return op3_rows(table(spark, sf_dir, "documents"))


def op4_sentencepiece_nbest(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_pii_bootstrap(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op8_embedding_e8(spark, sf_dir):
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op9_warc_fixity(spark, sf_dir):
    return op9_rows(table(spark, sf_dir, "pages"))


def op10_chroma_print(spark, sf_dir):
    return op10_rows(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_golay, op2_quality_bayes, op3_source_mixing, op4_sentencepiece_nbest, op5_secret_scan, op6_token_counts, op7_pii_bootstrap, op8_embedding_e8, op9_warc_fixity, op10_chroma_print)}
SQL: dict[str, str] = {
    "op3_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS x,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) || md5(coalesce(text, '')) AS mark
  FROM documents
), t AS (SELECT k, CAST(sum(x) AS BIGINT) AS t FROM d GROUP BY k HAVING sum(x) > 0
), p AS (SELECT k, t, t / CAST(sum(t) OVER () AS DOUBLE) AS p, CAST(sum(t) OVER () AS DOUBLE) AS budget FROM t
), g AS (
  SELECT list(p) AS ps, list(p / t) AS pt, list(t) AS ts, any_value(budget) AS budget, count(*) AS n, -sum(p * ln(p)) AS h FROM p
), g2 AS (SELECT *, h + 0.5 * (ln(n) - h) AS target FROM g
), e(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN ln(z) - a * zl / z >= target THEN a ELSE low END, CASE WHEN ln(z) - a * zl / z >= target THEN high ELSE a END
  FROM (SELECT i, low, high, (low + high) / 2 AS a, target, list_sum(list_transform(ps, lambda q: pow(q, (low + high) / 2))) AS z,
               list_sum(list_transform(ps, lambda q: pow(q, (low + high) / 2) * ln(q))) AS zl FROM e, g2 WHERE i < 60) y
), m(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN most / z * budget <= 4 THEN low ELSE a END, CASE WHEN most / z * budget <= 4 THEN a ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS a, budget, list_sum(list_transform(ps, lambda q: pow(q, (low + high) / 2))) AS z,
               list_max(list_transform(list_zip(ps, ts), lambda q: pow(q[1], (low + high) / 2) / q[2])) AS most FROM m, g2 WHERE i < 60) y
), x AS (
  SELECT CASE WHEN n < 2 THEN 1 WHEN list_max(list_transform(ts, lambda q: budget / n / q)) <= 4 THEN round(e.low, 9) ELSE round(greatest(e.low, m.high), 9) END AS a
  FROM g2, e, m WHERE e.i = 60 AND m.i = 60
), w AS (SELECT k, t, CAST(round(pow(p, a) / sum(pow(p, a)) OVER () * budget) AS BIGINT) AS quota, CAST(ceil(budget / 1000000) AS BIGINT) AS blocks FROM p, x
), o AS (
  SELECT d.*, t, quota, blocks, CAST(coalesce(sum(x) OVER (PARTITION BY d.k ORDER BY mark, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM d JOIN w ON d.k = w.k
), c AS (
  SELECT *, unnest(range(0, quota // t + CASE WHEN begins < quota % t THEN 1 ELSE 0 END)) AS epoch FROM o
)
SELECT doc_id, source, x AS n_tokens, epoch, CAST(floor((epoch * t + begins) / CAST(quota AS DOUBLE) * greatest(blocks, 1)) AS BIGINT) AS block,
       md5(concat(mark, ':', epoch)) AS slot
FROM c
""",
    "op8_embedding_e8": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON v.vec_id = n.vec_id
""",
    "op9_warc_fixity": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT CASE WHEN (page_id >> 1) % 43 = 2 THEN xor(page_id, 1) ELSE page_id END AS page_id, url,
         CASE WHEN page_id % 31 = 7 THEN substr(html, 2) || 'x' ELSE html END AS html, unnest(range(CASE WHEN page_id % 41 = 3 THEN 2 ELSE 1 END)) AS again
  FROM p WHERE coalesce(page_id % 37, 0) <> 5
), b AS (
  SELECT 1 AS side, page_id, url, html FROM p UNION ALL SELECT 2, page_id, url, html FROM r
), t AS (
  SELECT side, page_id, chr(13) || chr(10) AS nl,
         'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: '
         || octet_length(encode(html)) || nl || nl || html || nl || nl AS record
  FROM b
), h AS (SELECT side, page_id, sha256(record) AS sha, octet_length(encode(record)) AS record_length FROM t
), f AS (
  SELECT *, coalesce(page_id >> 10, -1 - ((strpos('0123456789abcdef', sha[1]) - 1) * 256 + (strpos('0123456789abcdef', sha[2]) - 1) * 16 + strpos('0123456789abcdef', sha[3]) - 1)) AS file_no,
         coalesce(page_id & 1023, 1024) AS slot
  FROM h
), n AS (
  SELECT file_no, slot, page_id, sha, any_value(record_length) AS record_length, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2
  FROM f GROUP BY file_no, slot, page_id, sha
), i AS (SELECT file_no, slot, bool_or(n2 > n1) AS instead FROM n GROUP BY file_no, slot
), own AS (
  SELECT page_id, file_no, slot, sha, record_length, row_number() OVER w - 1 AS seq, row_number() OVER (PARTITION BY file_no, slot, sha) - 1 AS copy,
         coalesce(sum(record_length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset
  FROM f WHERE side = 1 WINDOW w AS (PARTITION BY file_no ORDER BY slot, sha)
)
SELECT own.page_id, own.file_no, CAST(seq AS BIGINT) AS seq, CAST(record_offset AS BIGINT) AS record_offset, CAST(own.record_length AS BIGINT) AS record_length, own.sha,
       CASE WHEN copy < n2 THEN 'same' WHEN instead THEN 'changed' ELSE 'missing' END AS state
FROM own JOIN n ON n.file_no = own.file_no AND n.slot = own.slot AND n.sha = own.sha JOIN i ON i.file_no = own.file_no AND i.slot = own.slot
UNION ALL
SELECT page_id, file_no, NULL, NULL, CAST(record_length AS BIGINT), sha, 'extra' FROM (SELECT *, unnest(range(n1, n2)) AS copy FROM n WHERE n2 > n1) e
""",
}
