"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from . import queries as Q
from . import vector_codes
from .common import SHINGLE
from .decontam import LEAST as LEAST_CONTAINED
from .license_scan import LEAST, NOTICE_K, NOTICES, PHRASE_K, PHRASES, SLACK, STRETCH
from .sharding import fill_table
from .topk import SCALE
from .url_reputation import LEAST_BOUND, STRONGEST, TWO_LABEL_SUFFIXES, WEAKEST, Z
from .warc_fixity import FILE_PAGES

_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in Q.RULES)


def _shrink(child: str, parent: str, key: str) -> str:
    return f"""
{child}_m AS (SELECT c.*, p.post AS mean FROM {child}_n c JOIN {parent} p USING ({key})),
{child}_v AS (
  SELECT (sum(n * pow(good::DOUBLE / n - mean, 2)) - sum(mean * (1 - mean)))
           / nullif(sum(n) - sum(n * n)::DOUBLE / sum(n), 0) AS v,
         sum(n * mean * (1 - mean)) / sum(n) AS u
  FROM {child}_m WHERE n > 0),
{child}_s AS (
  SELECT least({STRONGEST!r}::DOUBLE, greatest({WEAKEST!r}::DOUBLE,
         coalesce(CASE WHEN v > 0 THEN u / v - 1 END, {STRONGEST!r}::DOUBLE))) AS s FROM {child}_v),
{child} AS (
  SELECT *, a / (a + b) AS post FROM (
    SELECT m.*, mean * s + good AS a, (1 - mean) * s + n - good AS b FROM {child}_m m, {child}_s))"""


OP4 = f"""
WITH pg AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
lab AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels GROUP BY 1),
host_n AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS good,
    array_to_string(string_split(host, '.')[-2:], '.') AS two,
    CASE WHEN two IN ({_TWO}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS dom,
    CASE WHEN two IN ({_TWO}) THEN two ELSE string_split(host, '.')[-1] END AS suf
  FROM pg LEFT JOIN lab USING (page_id) GROUP BY host),
dom_n AS (SELECT dom, suf, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM host_n GROUP BY ALL),
suf_n AS (SELECT suf, 0 AS root, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM dom_n GROUP BY ALL),
top AS (SELECT root, (sum(good) + 1) / (sum(n) + 2.0) AS post FROM suf_n GROUP BY root),
{_shrink('suf', 'top', 'root')},
{_shrink('dom', 'suf', 'suf')},
{_shrink('host', 'dom', 'dom')},
rules(rule, rhost, rpath, verdict) AS (VALUES {_RULES}),
fixed AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM pg) u JOIN rules r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, pg.host, pg.path, f.rule,
  coalesce(f.verdict, CASE WHEN h.post - {Z!r} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {LEAST_BOUND!r}
                      THEN 'allow' ELSE 'block' END) AS verdict,
  h.n, h.good
FROM pg JOIN host h USING (host) LEFT JOIN fixed f ON f.host = pg.host AND f.path = pg.path
"""

OP9 = f"""
WITH t AS (SELECT string_split('{','.join(map(str, fill_table(Q.SHARDS, Q.TABLE_SIZE)))}', ',') AS o),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {Q.TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(o[slot + 1], 2, '0') AS shard FROM d, t
"""

_TEMPLATES = ", ".join(f"({i}, '{t}', '{label}', {k})" for i, (t, label, k) in enumerate(
    [(t, label, PHRASE_K) for t, label in PHRASES] + [(t, label, NOTICE_K) for t, label in NOTICES]))

OP10 = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
given(t, words, label, k) AS (VALUES {_TEMPLATES}),
pos AS (
  SELECT t, label, k, len(string_split(words, ' ')) AS size, unnest(range(0, size - k + 1)) AS tpos,
    array_to_string(string_split(words, ' ')[tpos + 1:tpos + k], ' ') AS gram
  FROM given),
g AS (
  SELECT r, k, p - 1 AS p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT k FROM given)
  WHERE p + k - 1 <= len(w)),
votes AS (
  SELECT r, t, label, g.k, size, p - tpos AS diagonal, list(DISTINCT tpos) AS ats, min(p) AS p0, max(p) AS p1
  FROM g JOIN pos ON g.gram = pos.gram AND g.k = pos.k GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= CASE WHEN k = {PHRASE_K} THEN 0 ELSE floor(size * {SLACK}) END
            THEN 0 ELSE 1 END AS fresh
  FROM votes WINDOW o AS (PARTITION BY r, t ORDER BY diagonal)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT r, label, k, min(p0) AS p0, max(p1) + k - min(p0) AS len,
    len(list_distinct(flatten(list(ats))))::DOUBLE / (size - k + 1) AS cover,
    CASE WHEN k = {PHRASE_K} THEN cover = 1 ELSE cover >= {LEAST} AND len <= {STRETCH} * size END AS ok
  FROM numbered GROUP BY r, t, label, k, size, span),
s AS (
  SELECT r, count(*) FILTER (ok AND k = {PHRASE_K}) AS n_base, min(p0) FILTER (ok AND k = {PHRASE_K}) AS first_word,
    max(p0) FILTER (ok AND k = {PHRASE_K}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok AND k = {PHRASE_K}) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels,
    max(CASE WHEN ok THEN cover ELSE cover * {LEAST} END) AS score
  FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w
           FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w,
        least({SHINGLE}, len(w)) AS k FROM benchmark WHERE text IS NOT NULL),
si AS (SELECT DISTINCT q, item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i WHERE len(w) > 0)),
n AS (SELECT q, count(*) AS n FROM si GROUP BY q),
sd AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), (SELECT DISTINCT k FROM si)
       WHERE p + k - 1 <= len(w))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n AS containment
FROM sd JOIN si USING (k, s) JOIN n USING (q) GROUP BY r, q, doc_id, item_id, n HAVING count(*) >= {LEAST_CONTAINED} * n
"""

OP2 = f"""
WITH rec AS (
  SELECT coalesce(floor(page_id / {FILE_PAGES})::BIGINT, -1) AS file, page_id AS record_id,
    encode('WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
      || '>\r\nWARC-Target-URI: ' || coalesce(regexp_replace(url, '[\r\n]', '', 'g'), '') || '\r\nContent-Length: '
      || octet_length(encode(coalesce(html, ''))) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n') AS bytes
  FROM pages),
placed AS (
  SELECT *, octet_length(bytes) AS length,
    ('0x' || substr(md5(coalesce(record_id, -1)::VARCHAR), 1, 8))::BIGINT AS drawn,
    coalesce(sum(octet_length(bytes)) OVER (PARTITION BY file ORDER BY record_id, sha256(bytes)
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM rec)
SELECT file, "offset", record_id, length, CASE WHEN drawn % {Q.LOST_EVERY} = 1 THEN 'missing' ELSE 'corrupt' END AS kind
FROM placed WHERE drawn % {Q.LOST_EVERY} = 1 OR drawn % {Q.CORRUPT_EVERY} = 0
"""

OP7 = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {Q.QUERY_EVERY} = 0
  GROUP BY ALL),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {Q.BEST}
"""

def _assigned(name: str, book: str) -> str:
    """CTE: the nearest entry of each part of each vector, ties to the lower one, and its distance."""
    return f"""
{name} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, p, e, sum((v - b) * (v - b))::BIGINT AS d FROM part JOIN {book} USING (p, i) GROUP BY r, p, e)
  GROUP BY r, p)"""


def _moved(name: str, book: str, near: str) -> str:
    """CTE: the codebook after the entries took the floors of their parts' means."""
    return f"""
{name} AS MATERIALIZED (
  SELECT p, e, i, coalesce(m, b) AS b
  FROM {book} LEFT JOIN (SELECT p, e, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m
                         FROM part JOIN {near} USING (r, p) GROUP BY p, e, i) USING (p, e, i))"""


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
part AS MATERIALIZED (
  SELECT r, (k - 1) // (len(x) // {vector_codes.PARTS}) AS p, (k - 1) % (len(x) // {vector_codes.PARTS}) AS i, x[k] AS v
  FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, v AS b FROM part WHERE r <= {vector_codes.ENTRIES}),
{_assigned('near0', 'book0')},
{_moved('book1', 'book0', 'near0')},
{_assigned('near1', 'book1')},
{_moved('book2', 'book1', 'near1')},
{_assigned('near2', 'book2')},
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(b::VARCHAR, ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""

ORACLE: dict[str, str] = {
    "op2_fixity_audit": OP2, "op4_url_reputation": OP4, "op7_best_vectors": OP7, "op8_contained_items": OP8,
    "op9_shard_documents": OP9, "op10_licenses": OP10,
    "op12_vector_codes": OP12}
