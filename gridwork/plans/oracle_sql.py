"""DuckDB SQL for the correctness check.

Each registered query has an ANSI-SQL twin that DuckDB runs on the same
parquet tables. The twins are written independently of the Spark plans and,
where it is cheap enough at sf0.01, by brute force: the carry-over of sheet
units simulates the reference's stack with a recursive CTE, the split search
joins every candidate with every cell, numbers are multiplied as DECIMALs.

Fragments are plain strings so queries can share the fixture CTEs.
"""

from __future__ import annotations

import unicodedata

from gridwork.sources.rules import LINE_RULES, PREFIX_RULES

WS = ("\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
      "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
NUM_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
FW_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FW_TO = "".join(chr(c) for c in range(0x21, 0x7F))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def doc_sql(custkey: str) -> str:
    s = f"CAST({custkey} AS VARCHAR)"
    return f"('S' || lpad({s}, CAST(greatest(7, length({s})) AS INTEGER), '0'))"


def ymd(ts: str) -> str:
    return (f"(CAST(year({ts}) AS VARCHAR) || '年' || CAST(month({ts}) AS VARCHAR) || '月' || "
            f"CAST(day({ts}) AS VARCHAR) || '日')")


def num(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(15,2)) AS VARCHAR)"


GRID = f"""
lines AS (
  SELECT l.*, o.o_custkey,
         row_number() OVER (PARTITION BY l.l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
tabs AS (
  SELECT o_orderkey, o_custkey, {doc_sql('o_custkey')} AS doc_id, o_orderkey % 4 AS k
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
),
cols AS (SELECT unnest([0, 1, 2, 3, 4]) AS c),
raw_grid AS (
  SELECT t.doc_id, t.doc_id || '-0000000-tab' || CAST(t.o_orderkey AS VARCHAR) AS table_id,
         t.o_orderkey AS table_ord, CAST(0 AS BIGINT) AS r, cols.c,
         CASE cols.c WHEN 0 THEN CASE WHEN t.k = 3 THEN '(単位:百万円)' ELSE '' END
                     WHEN 1 THEN '数量'
                     WHEN 2 THEN CASE WHEN t.k = 0 THEN '金額(千円)' WHEN t.k = 1 THEN '金額(百万円)'
                                      ELSE '金額' END
                     WHEN 3 THEN CASE WHEN t.k < 2 THEN '割引(%)' ELSE '割引' END
                     ELSE '出荷日' END AS t
  FROM tabs t, cols
  UNION ALL
  SELECT {doc_sql('l.o_custkey')}, {doc_sql('l.o_custkey')} || '-0000000-tab' || CAST(l.l_orderkey AS VARCHAR),
         l.l_orderkey, l.r, cols.c,
         CASE cols.c WHEN 0 THEN '品目' || CAST(l.r AS VARCHAR)
                     WHEN 1 THEN {num('l.l_quantity')}
                     WHEN 2 THEN CASE WHEN l.l_orderkey % 4 >= 2 AND (l.l_orderkey // 4) % 5 = 0 AND l.r = 1
                                      THEN '千米ドル' || {num('l.l_extendedprice')}
                                      ELSE {num('l.l_extendedprice')} END
                     WHEN 3 THEN {num('l.l_discount')}
                     ELSE {ymd('l.l_shipdate')} END
  FROM lines l, cols
),
hashed AS (
  SELECT *, r > 0 AND c > 0 AS inner_slot,
         r > 0 AND c > 0 AND (table_ord * 7 + r * 3 + c) % 23 = 0 AS unfilled,
         r > 0 AND c > 0 AND (table_ord * 5 + r * 11 + c) % 19 = 0 AS blank,
         table_ord * 1103 + r * 131 + c * 31 AS h
  FROM raw_grid
),
weights AS (
  SELECT *, h % 17 AS n0, (h // 17) % 13 AS n1, (h // 221) % 11 AS n2, (h // 2431) % 45 AS n3
  FROM hashed
),
grid AS (
  SELECT doc_id, doc_id || '/part' || CAST(table_ord % 3 AS VARCHAR) || '.html' AS page_id,
         table_id, table_ord, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c,
         CAST(r * 5 + c AS INTEGER) AS src_ord,
         CASE WHEN unfilled OR (table_ord + r + c) % 29 = 0 THEN NULL
              ELSE table_id || '-R' || CAST(r AS VARCHAR) || 'C' || CAST(c AS VARCHAR) END AS cell_id,
         CASE WHEN unfilled THEN NULL WHEN blank THEN '' ELSE t END AS text,
         CASE WHEN unfilled OR (table_ord + r * 2 + c) % 31 = 0 THEN NULL
              WHEN inner_slot THEN [n0, n1, n2, 100 - n0 - n1 - n2]
              WHEN r = 0 THEN [n0, 100 - n0 - n2 - n3, n2, n3]
              ELSE [n0, n1, 100 - n0 - n1 - n3, n3] END AS w
  FROM weights
),
slots AS (
  SELECT doc_id, page_id, table_id, table_ord, r, c, src_ord, cell_id, text,
         CASE WHEN w IS NULL OR text IS NULL THEN NULL
              ELSE list_transform(w, lambda v: CAST(v AS DOUBLE) / CAST(100.0 AS DOUBLE)) END AS type
  FROM grid
)"""


def ascii_fold(x: str) -> str:
    return f"translate({x}, {q(FW_FROM)}, {q(FW_TO)})"


def nfkc(x: str) -> str:
    """Each character that has a compatibility form is replaced by all of it; DuckDB puts in order and composes."""
    forms = {c: d for c in map(chr, range(0x110000)) if unicodedata.decomposition(c)
             and (d := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c)}
    codes = [*map(ord, forms)]
    ends = [(a, b) for i, (a, b) in enumerate(zip([-9, *codes], [*codes, -9])) if b != a + 1]  # (last of a run, first of the next)
    ranges = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for (_, first), (last, _) in zip(ends, ends[1:]))
    known = "MAP {" + ", ".join(f"{q(c)}: {q(d)}" for c, d in forms.items()) + "}"
    return (f"(CASE WHEN regexp_matches({x}, {q('[' + ranges + ']')}) THEN nfc_normalize(list_aggregate(list_transform("
            f"regexp_extract_all({x}, '(?s).'), lambda ch: coalesce({known}[ch], ch)), 'string_agg', '')) ELSE nfc_normalize({x}) END)")


def norm_text(x: str, c1=ascii_fold) -> str:
    """C1-C6; by default C1 is the full-width ASCII fold, :func:`nfkc` is the whole of it."""
    t = c1(x)
    t = f"regexp_replace({t}, '[{WS}]', '', 'g')"
    t = f"translate({t}, '▲△▴▵,', '----')"
    t = (f"(CASE WHEN ({t}) = '0百万円' THEN '0' "
         f"WHEN ends_with({t}, '百万円') THEN replace({t}, '百万円', '000000') "
         f"WHEN ends_with({t}, '千円') THEN replace({t}, '千円', '000') ELSE {t} END)")
    return f"rtrim({t}, '円株個')"


def pre_rules(x: str) -> str:
    """C11 then C12."""
    t = (f"(CASE WHEN regexp_matches({x}, '^※[0-9][0-9]+') "
         f"THEN regexp_extract({x}, '^※[0-9]([0-9]+)', 1) ELSE {x} END)")
    return f"regexp_replace({t}, '〔[0-9]+〕', '', 'g')"


def _iso(x: str, pat: str) -> str:
    m = f"regexp_extract({x}, {q(pat)}, 0)"
    iso = (f"regexp_extract({x}, {q(pat)}, 1) || '-' || lpad(regexp_extract({x}, {q(pat)}, 2), 2, '0')"
           f" || '-' || lpad(regexp_extract({x}, {q(pat)}, 3), 2, '0')")
    return f"(CASE WHEN {m} <> '' THEN replace({x}, {m}, {iso}) ELSE {x} END)"


def post_rules(x: str) -> str:
    """C11, C12, C7, C8, C9, C10."""
    t = pre_rules(x)
    st = "株式の状況\\(1単元の株式数([0-9]+)株\\)"
    t = f"(CASE WHEN regexp_matches({t}, {q(st)}) THEN regexp_extract({t}, {q(st)}, 1) ELSE {t} END)"
    t = _iso(t, "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日")
    t = _iso(t, "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日生")
    ys = "([0-9]+)円([0-9]+)銭"
    sen = f"CAST(CAST(regexp_extract({t}, {q(ys)}, 2) AS HUGEINT) AS VARCHAR)"
    t = (f"(CASE WHEN regexp_matches({t}, {q(ys)}) THEN regexp_extract({t}, {q(ys)}, 1) || '.' || "
         f"CASE WHEN length({sen}) < 2 THEN lpad({sen}, 2, '0') ELSE {sen} END ELSE {t} END)")
    return t


def is_num(x: str) -> str:
    return f"regexp_matches({x}, {q(NUM_RE)})"


def times(x: str, mult: str) -> str:
    """Exact product text for the fixture's 2-decimal numbers."""
    scale = len(mult.split(".")[1]) if "." in mult else 0
    return (f"CAST(CAST({x} AS DECIMAL(18,2)) * CAST({q(mult)} AS DECIMAL(18,{scale})) AS VARCHAR)")


def anchor_case(x: str) -> str:
    whens = " ".join(f"WHEN ends_with({x}, {q(k)}) THEN {q(m)}" for k, m in LINE_RULES)
    return f"(CASE {whens} END)"


def prefix_case(x: str) -> str:
    whens = []
    for k, m in reversed(PREFIX_RULES):
        rest = f"substr({x}, {len(k) + 1})"
        whens.append(f"WHEN starts_with({x}, {q(k)}) AND {is_num(rest)} THEN {times(rest, m)}")
    return f"(CASE {' '.join(whens)} END)"


def line_times(x: str, mult_col: str) -> str:
    whens = " ".join(f"WHEN {mult_col} = {q(m)} THEN {times(x, m)}" for m in sorted({m for _, m in LINE_RULES}))
    return f"(CASE {whens} END)"


def _pre(c1) -> str:
    folded = "slots" if c1 is ascii_fold else f"(SELECT * REPLACE ({c1('text')} AS text) FROM slots)"
    text = norm_text("text") if c1 is ascii_fold else norm_text("text", lambda x: x)
    return f"""
pre AS (
  SELECT doc_id, page_id, table_id, table_ord, r, c, src_ord, cell_id, type,
         {pre_rules(text)} AS text
  FROM {folded}
),"""


_NORMALIZE = f"""
marked AS (
  SELECT *, {anchor_case('text')} AS anchor, {prefix_case('text')} AS prefixed,
         {is_num('text')} AS isnum, contains(text, '(単位:百万円)') AS marker
  FROM pre
),
col_first AS (
  SELECT doc_id, table_id, c, min(r) AS ar, arg_min(anchor, r) AS am
  FROM marked WHERE anchor IS NOT NULL GROUP BY ALL
),
row_first AS (
  SELECT doc_id, table_id, r, min(c) AS ac, arg_min(anchor, c) AS am
  FROM marked WHERE anchor IS NOT NULL GROUP BY ALL
),
tstat AS (
  SELECT doc_id, page_id, table_id, max(table_ord) AS table_ord,
         CASE WHEN bool_or(anchor IS NOT NULL OR prefixed IS NOT NULL) THEN 'F'
              WHEN bool_or(coalesce(marker, false)) AND bool_or(coalesce(isnum, false)) THEN 'U'
              ELSE 'N' END AS status
  FROM marked GROUP BY ALL
),
seqd AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY table_ord, table_id) AS pos FROM tstat
),
walk(doc_id, page_id, pos, table_id, status, stack, carried) AS (
  SELECT doc_id, page_id, pos, table_id, status,
         CASE WHEN status = 'N' THEN []::VARCHAR[] ELSE [status] END, false
  FROM seqd WHERE pos = 1
  UNION ALL
  SELECT s.doc_id, s.page_id, s.pos, s.table_id, s.status,
         CASE WHEN s.status <> 'N' THEN list_append(w.stack, s.status)
              WHEN len(w.stack) > 0 AND w.stack[len(w.stack)] = 'F' THEN w.stack[1:len(w.stack) - 1]
              ELSE w.stack END,
         s.status = 'N' AND len(w.stack) > 0 AND w.stack[len(w.stack)] = 'U'
  FROM walk w JOIN seqd s ON s.doc_id = w.doc_id AND s.page_id = w.page_id AND s.pos = w.pos + 1
),
scaled AS (
  SELECT m.doc_id, m.table_id, m.table_ord, m.r, m.c, m.src_ord, m.cell_id, m.type,
         CASE WHEN t.status = 'F' THEN coalesce(
                m.prefixed,
                CASE WHEN m.isnum AND cf.ar < m.r THEN {line_times('m.text', 'cf.am')}
                     WHEN m.isnum AND rf.ac < m.c THEN {line_times('m.text', 'rf.am')} END,
                m.text)
              WHEN (t.status = 'U' OR w.carried) AND m.isnum THEN {times('m.text', '1000000')}
              ELSE m.text END AS text
  FROM marked m
  JOIN tstat t USING (doc_id, table_id)
  JOIN walk w USING (doc_id, table_id)
  LEFT JOIN col_first cf ON cf.doc_id = m.doc_id AND cf.table_id = m.table_id AND cf.c = m.c
  LEFT JOIN row_first rf ON rf.doc_id = m.doc_id AND rf.table_id = m.table_id AND rf.r = m.r
),
norm AS (
  SELECT doc_id, table_id, table_ord, r, c, src_ord, cell_id, {post_rules('text')} AS text, type
  FROM scaled
)"""

NORMALIZE = _pre(ascii_fold) + _NORMALIZE
#: With the whole of C1.
NORMALIZE_NFKC = _pre(nfkc) + _NORMALIZE


def split_ctes(src: str = "norm", min_split: int = 0, count_empty: bool = False) -> str:
    counted = "text IS NOT NULL" + ("" if count_empty else " AND text <> ''")
    return f"""
cells AS (
  SELECT doc_id, table_id, r, c,
         coalesce(list_position(type, list_max(type)) - 1, 0) AS label,
         CASE WHEN type IS NULL THEN CAST(0 AS DECIMAL(18,12))
              ELSE CAST(type[1] AS DECIMAL(18,12)) + CAST(type[2] AS DECIMAL(18,12))
                   + CAST(type[3] AS DECIMAL(18,12)) END AS wnd,
         CASE WHEN type IS NULL THEN CAST(0 AS DECIMAL(18,12))
              ELSE CAST(type[4] AS DECIMAL(18,12)) END AS wd
  FROM {src} WHERE {counted}
),
dims AS (SELECT doc_id, table_id, max(r) AS mr, max(c) AS mc FROM {src} GROUP BY ALL),
cands AS (
  SELECT doc_id, table_id, rs, cs
  FROM dims, generate_series({min_split}, least(10, mr)) g1(rs), generate_series({min_split}, least(10, mc)) g2(cs)
),
regions AS (
  SELECT k.doc_id, k.table_id, k.rs, k.cs,
         count(x.r) FILTER (WHERE x.r >= k.rs AND x.c >= k.cs) AS d_n,
         count(x.r) FILTER (WHERE NOT (x.r >= k.rs AND x.c >= k.cs)) AS nd_n,
         count(x.r) FILTER (WHERE x.r >= k.rs AND x.c >= k.cs AND x.label = 3) AS d_a,
         count(x.r) FILTER (WHERE NOT (x.r >= k.rs AND x.c >= k.cs) AND x.label <> 3) AS nd_a,
         coalesce(sum(x.wd) FILTER (WHERE x.r >= k.rs AND x.c >= k.cs), 0) AS d_p,
         coalesce(sum(x.wnd) FILTER (WHERE NOT (x.r >= k.rs AND x.c >= k.cs)), 0) AS nd_p
  FROM cands k LEFT JOIN cells x ON x.doc_id = k.doc_id AND x.table_id = k.table_id
  GROUP BY ALL
),
scores AS (
  SELECT doc_id, table_id, rs, cs, v.variant,
         CASE WHEN nd_n = 0 OR d_n = 0 THEN 0.0
              WHEN v.variant = 'argmax_micro' THEN CAST(nd_a + d_a AS DOUBLE) / CAST(nd_n + d_n AS DOUBLE)
              WHEN v.variant = 'argmax_macro' THEN (CAST(nd_a AS DOUBLE) / CAST(nd_n AS DOUBLE)
                                                   + CAST(d_a AS DOUBLE) / CAST(d_n AS DOUBLE)) / 2.0
              WHEN v.variant = 'probability_micro' THEN CAST(nd_p + d_p AS DOUBLE) / CAST(nd_n + d_n AS DOUBLE)
              ELSE (CAST(nd_p AS DOUBLE) / CAST(nd_n AS DOUBLE) + CAST(d_p AS DOUBLE) / CAST(d_n AS DOUBLE)) / 2.0
         END AS score
  FROM regions, (SELECT unnest(['argmax_micro', 'argmax_macro', 'probability_micro',
                                'probability_macro']) AS variant) v
),
best AS (
  SELECT doc_id, table_id, variant, CAST(rs AS INTEGER) AS row_split, CAST(cs AS INTEGER) AS col_split, score
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, table_id, variant
                                     ORDER BY score DESC, rs, cs) AS rk FROM scores)
  WHERE rk = 1
)"""


def sentence_ctes(src: str = "norm", split: str = "chosen", keep_empty: bool = False) -> str:
    data_filter = "" if keep_empty else "AND s.text <> ''"
    return f"""
sx AS (
  SELECT s.*, p.row_split AS rs, p.col_split AS cs
  FROM {src} s JOIN {split} p USING (doc_id, table_id) WHERE s.text IS NOT NULL
),
colh AS (
  SELECT doc_id, table_id, c,
         regexp_replace(string_agg(text, '、' ORDER BY pos), '^、+', '') AS col_header
  FROM (SELECT doc_id, table_id, c, text, min(r) AS pos FROM sx WHERE r < rs AND text <> '' GROUP BY ALL)
  GROUP BY ALL
),
rowh AS (
  SELECT doc_id, table_id, r,
         regexp_replace(string_agg(text, '、' ORDER BY pos), '^、+', '') AS row_header
  FROM (SELECT doc_id, table_id, r, text, min(c) AS pos FROM sx WHERE c < cs AND text <> '' GROUP BY ALL)
  GROUP BY ALL
),
sent AS (
  SELECT s.doc_id, s.table_id, s.r, s.c, s.cell_id, s.text AS data,
         CASE WHEN coalesce(rh.row_header, '') = '' THEN coalesce(ch.col_header, '') || 'は' || s.text || 'です。'
              WHEN coalesce(ch.col_header, '') = '' THEN rh.row_header || 'は' || s.text || 'です。'
              ELSE ch.col_header || 'の' || rh.row_header || 'は' || s.text || 'です。' END AS sentence
  FROM sx s
  LEFT JOIN colh ch ON ch.doc_id = s.doc_id AND ch.table_id = s.table_id AND ch.c = s.c
  LEFT JOIN rowh rh ON rh.doc_id = s.doc_id AND rh.table_id = s.table_id AND rh.r = s.r
  WHERE s.r >= s.rs AND s.c >= s.cs {data_filter}
),
sentences AS (
  SELECT doc_id, table_id, CAST(arg_min(r, r * 100000 + c) AS INTEGER) AS r,
         CAST(arg_min(c, r * 100000 + c) AS INTEGER) AS c, sentence, cell_id, data
  FROM sent GROUP BY doc_id, table_id, sentence, cell_id, data
)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip().rstrip(",") for c in ctes)


def clean_heading(x: str) -> str:
    t = f"regexp_replace({x}, '^[(（]?[０-９0-9]+[)）]?[ 　]*', '')"
    t = f"regexp_replace({t}, '[【】]', '', 'g')"
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


EXPECTED_EXTRACT = """
ek AS (SELECT *, table_ord % 4 AS k FROM slots),
expected AS (
  SELECT doc_id, table_id,
         CAST(dense_rank() OVER (PARTITION BY doc_id, page_id ORDER BY table_ord) - 1 AS BIGINT) AS table_ord, r, c,
         CASE WHEN k = 2 AND r = 0 AND c = 4 THEN lag(cell_id) OVER (PARTITION BY table_id, r ORDER BY c)
              WHEN k = 1 AND r = 2 AND c = 0 THEN lag(cell_id) OVER (PARTITION BY table_id, c ORDER BY r)
              ELSE cell_id END AS cell_id,
         CASE WHEN k = 2 AND r = 0 AND c = 4 THEN '割引'
              WHEN k = 1 AND r = 2 AND c = 0 THEN '品目1'
              WHEN text IS NULL AND c = 4 THEN NULL
              ELSE coalesce(text, '') END AS text
  FROM ek
)"""

EXPECTED_CONTEXT = f"""
tabs2 AS (SELECT DISTINCT doc_id, page_id, table_id, table_ord FROM slots),
paras AS (
  SELECT t.doc_id, t.page_id, t.table_id, t.table_ord,
         CASE WHEN t.table_ord % 6 = 0 THEN NULL
              WHEN t.table_ord % 6 = 1 THEN 'div#pageDIV' || CAST(t.table_ord AS VARCHAR)
              ELSE '(' || CAST(t.table_ord % 9 AS VARCHAR) || ') 【' || o.o_orderpriority || '】 '
                   || o.o_orderstatus END AS p
  FROM tabs2 t JOIN orders o ON o.o_orderkey = t.table_ord
),
ctx AS (
  SELECT doc_id, table_id,
         coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id, page_id ORDER BY table_ord
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '報告書 ' || doc_id) AS above
  FROM paras
),
context AS (
  SELECT doc_id, table_id, '以下の文書は「' || {clean_heading('above')} || '」について記述されています。' AS sentence,
         table_id || '-aboveparagraph' AS cell_id, '' AS data
  FROM ctx WHERE NOT starts_with(above, 'div#pageDIV')
)"""


# ----------------------------------------------------------- more twins --
def is_float_text(x: str) -> str:
    return ("regexp_matches(" + x + ", '(?i)^[+-]?(([0-9]+(_[0-9]+)*([.]([0-9]+(_[0-9]+)*)?)?|[.][0-9]+(_[0-9]+)*)"
            "(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$')")


JAVA_WS = "\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def needs_translation(x: str) -> str:
    return f"NOT regexp_matches({x}, '^[\\p{{L}}\\p{{M}}\\p{{Nd}}_{JAVA_WS}\\p{{P}}]*$')"


def doc_of(custkey: str) -> str:
    return doc_sql(custkey)


CONV = f"""
conv_t AS (
  SELECT v.conv_id, v.turn, v.role, v.text, {doc_sql('o.o_custkey')} AS doc_id,
         {doc_sql('o.o_custkey')} || '-0000000-tab' || CAST(o.o_orderkey AS VARCHAR) AS table_id
  FROM conversations v JOIN orders o ON v.conv_id = o.o_orderkey
),
questions AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, text AS question, doc_id, table_id,
         table_id || '-R' || CAST(turn // 2 + 1 AS VARCHAR) || 'C2' AS cell_id
  FROM conv_t WHERE role = 'user'
),
csent AS (
  SELECT doc_id, table_id, text AS sentence,
         CASE WHEN role = 'assistant' THEN table_id || '-R' || CAST((turn - 1) // 2 + 1 AS VARCHAR) || 'C2' END
           AS cell_id
  FROM conv_t WHERE role <> 'user'
)"""

GOLD = f"""
gold0 AS (
  SELECT {doc_sql('o_custkey')} AS doc_id,
         {doc_sql('o_custkey')} || '-0000000-tab' || CAST(o_orderkey AS VARCHAR) AS table_id,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS row_split,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END AS col_split
  FROM orders
),
gold AS (
  SELECT g.doc_id, g.table_id,
         EXISTS (SELECT 1 FROM questions q WHERE q.doc_id = g.doc_id AND q.table_id = g.table_id) AS is_include,
         CAST(g.row_split AS INTEGER) AS row_split, CAST(g.col_split AS INTEGER) AS col_split
  FROM gold0 g
),
glab AS (SELECT * FROM gold WHERE is_include AND row_split IS NOT NULL AND col_split IS NOT NULL)"""

NLI = """
nli AS (
  SELECT CASE WHEN event_type = 'view' THEN 'entailment' WHEN event_type = 'click' THEN 'neutral'
              ELSE 'contradiction' END AS label,
         event_type || ':' || CAST(user_id AS VARCHAR) AS s1, coalesce(props, '') AS s2
  FROM events
),
nk AS (
  SELECT *, md5(concat_ws('|', '42', coalesce(label, '␀'), coalesce(s1, '␀'), coalesce(s2, '␀'))) AS k
  FROM nli
),
nsize AS (
  SELECT label, count(*) AS n FROM nk GROUP BY label
),
halved AS (
  SELECT label, s1, s2, k FROM (
    SELECT nk.*, n, row_number() OVER (PARTITION BY nk.label ORDER BY k) AS rk FROM nk JOIN nsize USING (label))
  WHERE label = 'entailment'
     OR rk <= CASE WHEN n % 2 = 0 THEN n // 2 WHEN (n // 2) % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END
),
balanced AS (
  SELECT CAST(CASE WHEN label = 'entailment' THEN 1 ELSE 0 END AS INTEGER) AS label, s1, s2 FROM halved
),
bk AS (
  SELECT *, md5(concat_ws('|', '42', coalesce(CAST(label AS VARCHAR), '␀'), coalesce(s1, '␀'),
                          coalesce(s2, '␀'))) AS k
  FROM balanced
)"""
